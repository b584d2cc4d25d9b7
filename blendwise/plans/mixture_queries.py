"""Queries over mixtures: names, reports, synthesis, config files, plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from blendwise.functions import names
from blendwise.operators import runs, stats, synthesis, weights
from blendwise.plans import views
from blendwise.plans.views import (
    BRANDS,
    CORPUS,
    DISTRIBUTION,
    MIXTURE,
    r,
    rounded,
    sql_digest,
    sql_dirichlet,
    sql_uniform,
    with_ctes,
)
from blendwise.session import scratch
from blendwise.sources import configs, tables

SEED = synthesis.SEED
CHOSEN = 512
CANDIDATES = CHOSEN * synthesis.SAMPLE_MULTIPLIER
COARSE = 0.02
GRID = synthesis.strength_grid()

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


# --- shares ----------------------------------------------------------------------------------------------------


@query(
    "a2_normalize_weights",
    with_ctes(f'SELECT "index", domain, {r("weight")} AS weight FROM mix', MIXTURE),
)
def normalize_weights(spark, folder):
    return views.mixtures(spark, folder).withColumn("weight", rounded("weight"))


@query(
    "a3_temper",
    with_ctes(
        f"""SELECT "index", domain, {r('sqrt(weight) / sum(sqrt(weight)) OVER (PARTITION BY "index")')} AS weight
            FROM mix""",
        MIXTURE,
    ),
)
def temper(spark, folder):
    return weights.temper(views.mixtures(spark, folder)).withColumn("weight", rounded("weight"))


@query(
    "a4_usage_bounds",
    with_ctes(
        f"SELECT domain, {r('prior')} AS prior, {r('least(prior * 15, 1e0)')} AS bound FROM prior", CORPUS, DISTRIBUTION
    ),
)
def usage_bounds(spark, folder):
    bounds = weights.usage_bounds(views.distribution(spark, folder))
    return bounds.select("domain", rounded("prior").alias("prior"), rounded("bound").alias("bound"))


# --- names and numbers -----------------------------------------------------------------------------------------


@query(
    "p5_names",
    with_ctes(
        """SELECT domain AS brand, domain AS short, 'metric/demo_' || domain || '_val_loss' AS metric,
                  count(*)::BIGINT AS n FROM mix GROUP BY domain""",
        MIXTURE,
    ),
)
def short_names(spark, folder):
    """Short names out of prefixed ones, and metric names."""
    long = views.mixture_units(spark, folder).withColumn("full", F.concat(F.lit("train_demo_"), "domain"))
    found = long.select(
        F.col("domain").alias("brand"),
        names.short_domain(F.col("full"), "demo").alias("short"),
        names.metric_name(names.short_domain(F.col("full"))).alias("metric"),
    )
    return found.groupBy("brand", "short", "metric").agg(F.count(F.lit(1)).alias("n"))


RAW = """
raw AS (SELECT "index", CASE WHEN "index" % 5 = 0 THEN 'other_' ELSE 'train_' END || domain AS domain,
               CASE WHEN "index" % 7 = 1 THEN 'n/a'
                    WHEN "index" % 7 = 2 THEN units::BIGINT::VARCHAR
                    ELSE '0.' || lpad(units::BIGINT::VARCHAR, 7, '0') END AS value
        FROM units)
"""


def raw_entries(spark, folder):
    """Config entries as text: whole numbers, decimals, and some that are no numbers."""
    units = views.mixture_units(spark, folder)
    whole = F.col("weight").cast("long").cast("string")
    number = F.pmod("index", F.lit(7))
    return units.select(
        "index",
        F.concat(F.when(F.pmod("index", F.lit(5)) == 0, "other_").otherwise("train_"), "domain").alias("domain"),
        F.when(number == 1, "n/a")
        .when(number == 2, whole)
        .otherwise(F.concat(F.lit("0."), F.lpad(whole, 7, "0")))
        .alias("value"),
    )


@query(
    "p6_clean_weights",
    with_ctes(
        """SELECT "index", domain,
                  CASE WHEN regexp_matches(value, '^\\s*[+-]?\\d+\\s*$') THEN value::DOUBLE
                       ELSE printf('%.5f', value::DOUBLE)::DOUBLE END AS weight
           FROM raw WHERE starts_with(domain, 'train_') AND try_cast(value AS DOUBLE) IS NOT NULL""",
        MIXTURE,
        RAW,
    ),
)
def clean_weights(spark, folder):
    return weights.clean_weights(raw_entries(spark, folder))


@query(
    "p6_rejected_weights",
    with_ctes(
        """SELECT "index", domain, value FROM raw
           WHERE starts_with(domain, 'train_') AND try_cast(value AS DOUBLE) IS NULL""",
        MIXTURE,
        RAW,
    ),
)
def rejected_weights(spark, folder):
    return weights.rejected_weights(raw_entries(spark, folder))


ON_GRID = f"""
grid AS (SELECT "index", domain, round_even(weight / {synthesis.MINIMUM!r}::DOUBLE, 0) * {synthesis.MINIMUM!r}::DOUBLE AS weight
         FROM mix)
"""


def grid_mixtures(spark, folder):
    """Mixtures rounded to the grid."""
    units = F.bround(F.col("weight") / synthesis.MINIMUM, 0)
    return views.mixtures(spark, folder).withColumn("weight", units * F.lit(synthesis.MINIMUM))


FORMATTED = "regexp_replace(regexp_replace(printf('%.5f', weight), '0+$', ''), '\\.$', '')"


@query(
    "p7_format_weight",
    with_ctes(f'SELECT "index", domain, {FORMATTED} AS value FROM mix', MIXTURE),
)
def format_weight(spark, folder):
    return views.mixtures(spark, folder).select("index", "domain", names.format_weight(F.col("weight")).alias("value"))


# --- reports ---------------------------------------------------------------------------------------------------


@query(
    "a5_weight_stats",
    with_ctes(
        f"""SELECT domain, count(*)::BIGINT AS n, {r('min(weight)')} AS min, {r('max(weight)')} AS max,
                   {r('avg(weight)')} AS mean, {r('stddev_samp(weight)')} AS stddev,
                   {r('quantile_cont(weight, 0.25)')} AS q25, {r('quantile_cont(weight, 0.5)')} AS q50,
                   {r('quantile_cont(weight, 0.75)')} AS q75
            FROM mix GROUP BY domain""",
        MIXTURE,
    ),
)
def weight_stats(spark, folder):
    found = stats.weight_stats(views.mixtures(spark, folder))
    return found.select("domain", "n", *[rounded(c).alias(c) for c in found.columns if c not in ("domain", "n")])


def histogram_sql(bins: int) -> str:
    return with_ctes(
        f"""SELECT ends.domain, bin::BIGINT AS bin, {r(f'lo + bin * (hi - lo) / {bins}')} AS lo,
                   {r(f'lo + (bin + 1) * (hi - lo) / {bins}')} AS hi, coalesce(n, 0)::BIGINT AS n
            FROM (SELECT *, unnest(range({bins})) AS bin FROM ends) AS ends LEFT JOIN counted USING (domain, bin)""",
        MIXTURE,
        """ends AS (SELECT domain, min(weight) - CASE WHEN min(weight) = max(weight) THEN 5e-1 ELSE 0e0 END AS lo,
                           max(weight) + CASE WHEN min(weight) = max(weight) THEN 5e-1 ELSE 0e0 END AS hi
                    FROM mix GROUP BY domain)""",
        f"""counted AS (SELECT domain, least(floor((weight - lo) / (hi - lo) * {bins}), {bins - 1})::BIGINT AS bin,
                               count(*) AS n
                        FROM mix JOIN ends USING (domain) GROUP BY 1, 2)""",
    )


def weight_histogram(spark, folder, bins: int):
    found = stats.histogram(views.mixtures(spark, folder), "weight", ("domain",), bins)
    return found.withColumn("lo", rounded("lo")).withColumn("hi", rounded("hi"))


@query("a6_histogram", histogram_sql(stats.TEXT_BINS))
def histogram(spark, folder):
    return weight_histogram(spark, folder, stats.TEXT_BINS)


@query("a6_plot_histogram", histogram_sql(stats.PLOT_BINS))
def plot_histogram(spark, folder):
    return weight_histogram(spark, folder, stats.PLOT_BINS)


# --- synthesis -------------------------------------------------------------------------------------------------


GRID_SQL = "[" + ", ".join(f"{s!r}::DOUBLE" for s in GRID) + "]"
STRENGTH_U = sql_uniform(sql_digest(SEED, "'strength'", "sample_id"))
STRENGTH_PLACE = f"floor({STRENGTH_U} * {len(GRID)})::BIGINT + 1"


def sampled_sql(candidates: int) -> str:
    """CTEs up to ``rounded_units``: drawn, bounded, cut and rounded candidates."""
    return f"""
smooth AS (SELECT domain, sqrt(prior) / sum(sqrt(prior)) OVER () AS prior FROM prior),
bounds AS (SELECT domain, least(prior * {weights.MAXIMUM_USAGE}, 1e0) AS bound FROM prior),
samples AS (SELECT sample_id, {GRID_SQL}[{STRENGTH_PLACE}] AS strength
            FROM (SELECT unnest(range({candidates})) AS sample_id)),
{sql_dirichlet('samples', 'smooth', SEED)},
inside AS (SELECT sample_id FROM simplex JOIN bounds USING (domain) GROUP BY sample_id
           HAVING bool_and(weight >= 0 AND weight <= bound)),
bounded AS (SELECT simplex.* FROM simplex JOIN inside USING (sample_id))
"""


def units_sql(source: str, minimum: float) -> str:
    return f"""
cut AS (SELECT sample_id, domain, CASE WHEN weight < {minimum!r}::DOUBLE THEN 0e0 ELSE weight END AS weight FROM {source}),
filled AS (SELECT sample_id, domain, round(weight / sum(weight) OVER (PARTITION BY sample_id), 12) AS weight FROM cut),
rounded_units AS (SELECT sample_id, domain, round_even(weight / {minimum!r}::DOUBLE, 0)::INTEGER AS units FROM filled)
"""


KEYS = """
vectors AS (SELECT sample_id, list(units ORDER BY domain) AS units FROM rounded_units GROUP BY sample_id),
firsts AS (SELECT min(sample_id) AS sample_id, units FROM vectors GROUP BY units)
"""


def candidates(dist):
    smooth = weights.temper(dist.select("domain", "prior"), by=(), value="prior")
    return synthesis.dirichlet_sample(smooth, CANDIDATES, SEED, GRID)


def bounded_candidates(dist):
    return synthesis.reject_out_of_bounds(candidates(dist), weights.usage_bounds(dist))


def sample_rows(dist, samples, keys=("sample_id",)):
    return synthesis.explode_samples(samples, dist, keys).withColumn("weight", rounded("weight"))


@query(
    "m1_strength_grid",
    f"""WITH samples AS (SELECT unnest(range((SELECT count(*) FROM lineitem))) AS sample_id)
        SELECT {r('strength')} AS strength, count(*)::BIGINT AS n
        FROM (SELECT {GRID_SQL}[{STRENGTH_PLACE}] AS strength FROM samples) GROUP BY 1""",
)
def strength_grid(spark, folder):
    """How often each strength is picked, with one candidate per line item."""
    n = views.table(spark, folder, "lineitem").count()
    samples = spark.range(n).withColumnRenamed("id", "sample_id")
    picked = synthesis.pick_strength(samples, GRID)
    return picked.groupBy(rounded("strength").alias("strength")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "m2_dirichlet_sample",
    with_ctes(
        f"SELECT sample_id, domain, {r('weight')} AS weight FROM simplex",
        CORPUS,
        DISTRIBUTION,
        sampled_sql(CANDIDATES),
        recursive=True,
    ),
)
def dirichlet_sample(spark, folder):
    dist = views.stored_distribution(spark, folder)
    return sample_rows(dist, candidates(dist))


@query(
    "m3_reject_out_of_bounds",
    with_ctes(
        f"SELECT sample_id, domain, {r('weight')} AS weight FROM bounded",
        CORPUS,
        DISTRIBUTION,
        sampled_sql(CANDIDATES),
        recursive=True,
    ),
)
def reject_out_of_bounds(spark, folder):
    dist = views.stored_distribution(spark, folder)
    return sample_rows(dist, bounded_candidates(dist))


@query(
    "m4_quantize",
    with_ctes(
        f"SELECT sample_id, domain, {r(f'units * {synthesis.MINIMUM!r}::DOUBLE')} AS weight FROM rounded_units",
        CORPUS,
        DISTRIBUTION,
        sampled_sql(CANDIDATES),
        units_sql("bounded", synthesis.MINIMUM),
        recursive=True,
    ),
)
def quantize(spark, folder):
    dist = views.stored_distribution(spark, folder)
    return sample_rows(dist, synthesis.quantize(bounded_candidates(dist)))


@query(
    "m5_dedup_mixtures",
    with_ctes(
        "SELECT sample_id, array_to_string(units, ' ') AS units FROM firsts",
        CORPUS,
        DISTRIBUTION,
        sampled_sql(CANDIDATES),
        units_sql("simplex", COARSE),
        KEYS,
        recursive=True,
    ),
)
def dedup_mixtures(spark, folder):
    """Candidates on a coarse grid, on which many are equal."""
    dist = views.stored_distribution(spark, folder)
    kept = synthesis.dedup_mixtures(synthesis.quantize(candidates(dist), COARSE))
    return kept.select("sample_id", F.array_join(F.col("units").cast("array<string>"), " ").alias("units"))


CLOSE = f"""
shifted AS (SELECT "index" * 2 AS sample_id, domain, weight FROM mix
            UNION ALL
            SELECT "index" * 2 + 1, domain, weight + CASE domain WHEN '{BRANDS[0]}' THEN 1e-6 WHEN '{BRANDS[1]}' THEN -1e-6 ELSE 0e0 END
            FROM mix),
rows_in_order AS (SELECT sample_id, v, row_number() OVER (ORDER BY list_reverse(v)) AS place FROM (
                    SELECT sample_id, list(weight ORDER BY domain) AS v FROM shifted GROUP BY sample_id)),
walk AS (SELECT place, sample_id, v AS last, true AS keep FROM rows_in_order WHERE place = 1
         UNION ALL
         SELECT place, sample_id, CASE WHEN far THEN v ELSE last END AS last, far AS keep FROM (
           SELECT o.place AS place, o.sample_id AS sample_id, v, last,
                  list_sum(list_transform(list_zip(v, last), lambda p: abs(p[1] - p[2]))) > {synthesis.DUPLICATE_DISTANCE!r}::DOUBLE AS far
           FROM walk JOIN rows_in_order AS o ON o.place = walk.place + 1))
"""


@query(
    "m5_dedup_close",
    with_ctes("SELECT sample_id, 25::BIGINT AS n_domains FROM walk WHERE keep", MIXTURE, CLOSE, recursive=True),
)
def dedup_close(spark, folder):
    """The sequential rule on the mixtures of all configs, each with a copy moved by less than the distance."""
    mix = views.mixtures(spark, folder)
    step = F.when(F.col("domain") == BRANDS[0], 1e-6).when(F.col("domain") == BRANDS[1], -1e-6).otherwise(0.0)
    both = mix.select((F.col("index") * 2).alias("sample_id"), "domain", "weight").unionByName(
        mix.select((F.col("index") * 2 + 1).alias("sample_id"), "domain", (F.col("weight") + step).alias("weight"))
    )
    vector = F.transform(F.sort_array(F.collect_list(F.struct("domain", "weight"))), lambda p: p["weight"])
    found = synthesis.dedup_close(both.groupBy("sample_id").agg(vector.alias("weights")))
    return found.select("sample_id", F.size("weights").cast("long").alias("n_domains"))


CHOOSE = f"""
chosen AS (SELECT sample_id, row_number() OVER (ORDER BY ticket, sample_id) AS "index" FROM (
             SELECT sample_id, {sql_digest(SEED, "'choose'", 'sample_id')} AS ticket FROM firsts)
           QUALIFY "index" <= {{num}})
"""
CONFIG_ROWS = f"""SELECT "index", domain, {r(f'units * {synthesis.MINIMUM!r}::DOUBLE')} AS weight
                  FROM rounded_units JOIN chosen USING (sample_id)"""


@query(
    "m6_choose_configs",
    with_ctes(
        CONFIG_ROWS,
        CORPUS,
        DISTRIBUTION,
        sampled_sql(CANDIDATES),
        units_sql("bounded", synthesis.MINIMUM),
        KEYS,
        CHOOSE.format(num=CHOSEN),
        recursive=True,
    ),
)
def choose_configs(spark, folder):
    dist = views.stored_distribution(spark, folder)
    kept = synthesis.dedup_mixtures(synthesis.quantize(bounded_candidates(dist)))
    return sample_rows(dist, synthesis.choose_configs(kept, CHOSEN), ("index",))


def synthesized_sql(num: int) -> tuple:
    return (
        CORPUS,
        DISTRIBUTION,
        sampled_sql(num * synthesis.SAMPLE_MULTIPLIER),
        units_sql("bounded", synthesis.MINIMUM),
        KEYS,
        CHOOSE.format(num=num),
    )


@query("m7_synthesize_mixtures", with_ctes(CONFIG_ROWS, *synthesized_sql(512), recursive=True))
def synthesize_mixtures(spark, folder):
    """The whole synthesis with the default sizes."""
    found = synthesis.synthesize_mixtures(views.distribution(spark, folder), 512)
    return found.withColumn("weight", rounded("weight"))


SYNTHESIZED = synthesized_sql(CHOSEN) + (
    f"""configs AS (SELECT "index", domain, units * {synthesis.MINIMUM!r}::DOUBLE AS weight
                   FROM rounded_units JOIN chosen USING (sample_id))""",
)


def synthesized(spark, folder):
    return synthesis.synthesize_mixtures(views.distribution(spark, folder), CHOSEN)


@query(
    "a7_zero_counts",
    with_ctes(
        "SELECT domain, count(*) FILTER (WHERE weight < 1e-7)::BIGINT AS n_zero FROM configs GROUP BY domain",
        *SYNTHESIZED,
        recursive=True,
    ),
)
def zero_counts(spark, folder):
    return stats.zero_counts(synthesized(spark, folder))


@query(
    "a8_configs_by_zero_count",
    with_ctes(
        """SELECT n_zero, count(*)::BIGINT AS n_configs FROM (
             SELECT "index", count(*) FILTER (WHERE weight < 1e-7)::BIGINT AS n_zero FROM configs GROUP BY 1)
           GROUP BY n_zero""",
        *SYNTHESIZED,
        recursive=True,
    ),
)
def configs_by_zero_count(spark, folder):
    return stats.configs_by_zero_count(synthesized(spark, folder))


# --- shapes and files ------------------------------------------------------------------------------------------

WIDE = ", ".join(f"""{r(f"max(CASE WHEN domain = '{b}' THEN weight END)")} AS "{b}" """ for b in BRANDS)


@query("a17_to_wide", with_ctes(f'SELECT "index", {WIDE} FROM mix GROUP BY "index"', MIXTURE))
def to_wide(spark, folder):
    wide = weights.to_wide(views.mixtures(spark, folder), BRANDS)
    return wide.select("index", *[rounded(F.col(f"`{b}`")).alias(b) for b in BRANDS])


@query("a17_to_long", with_ctes(f'SELECT "index", domain, {r("weight")} AS weight FROM mix', MIXTURE))
def to_long(spark, folder):
    """Widened with the domains found in the data, and back."""
    wide = weights.to_wide(views.mixtures(spark, folder))
    return weights.to_long(wide).withColumn("weight", rounded("weight"))


@query("s3_wide_csv", with_ctes(f'SELECT "index", {WIDE} FROM mix GROUP BY "index"', MIXTURE))
def wide_csv(spark, folder):
    """The wide table written as CSV and read back."""
    path = scratch(spark, "mixtures")
    tables.write_wide_csv(weights.to_wide(views.mixtures(spark, folder), BRANDS), path)
    found = tables.read_wide_csv(spark, path)
    return found.select("index", *[rounded(F.col(f"`{b}`")).alias(b) for b in BRANDS])


@query(
    "s1_read_mixture_configs",
    with_ctes(
        f"""SELECT "index", split, prefix || domain AS domain, CASE WHEN split = 'train' THEN {FORMATTED} ELSE '1.0' END AS value,
                   '512' AS batch
            FROM grid, (VALUES ('train', 'train_'), ('valid', 'valid_')) AS splits(split, prefix)""",
        MIXTURE,
        ON_GRID,
    ),
)
def read_mixture_configs(spark, folder):
    """One config file per mixture, written and read back. Numbers are compared in their YAML meaning."""
    path = scratch(spark, "configs")
    configs.write_mixture_configs(grid_mixtures(spark, folder), path, runs.PROXY_PARAMS)
    found = configs.read_mixture_configs(spark, path)
    plain = names.format_weight(F.col("value").cast("double"))
    return found.select(
        "index",
        "split",
        "domain",
        F.when(F.col("split") == "train", plain).otherwise(F.col("value")).alias("value"),
        F.col("params")["global_batch_size"].alias("batch"),
    )


TAIL = "".join(f"\n{name}: {value}" for name, value in runs.PROXY_PARAMS.items())


@query(
    "s2_write_mixture_configs",
    with_ctes(
        f"""SELECT "index", 'train:' || chr(10) || string_agg('  train_' || domain || ': ' || {FORMATTED}, chr(10) ORDER BY domain)
                   || chr(10) || 'valid:' || chr(10) || string_agg('  valid_' || domain || ': 1.0', chr(10) ORDER BY domain)
                   || '{TAIL}' AS document
            FROM grid GROUP BY "index" """,
        MIXTURE,
        ON_GRID,
    ),
)
def write_mixture_configs(spark, folder):
    """The text of each config file as it stands on disk."""
    path = scratch(spark, "configs")
    configs.write_mixture_configs(grid_mixtures(spark, folder), path, runs.PROXY_PARAMS)
    files = spark.read.option("pathGlobFilter", "*.yaml").text(path, wholetext=True)
    index = F.regexp_extract(F.col("_metadata.file_name"), r"^n(\d+)\.yaml$", 1).cast("long")
    return files.select(index.alias("index"), F.rtrim(F.col("value"), F.lit("\n")).alias("document"))


# --- plans -----------------------------------------------------------------------------------------------------


@query(
    "a16_training_plan",
    with_ctes(
        f"""SELECT "index", domain, {r('weight')} AS weight, {r('weight * 512000')} AS sequences,
                   {r('weight * 512000 * 2048')} AS tokens, {r('weight * 512000 * 2048 / n_tokens')} AS epochs,
                   weight > 0 AND weight * 512000 * 2048 / n_tokens > 2500 AS over_cap
            FROM configs JOIN dist USING (domain)""",
        *SYNTHESIZED,
        recursive=True,
    ),
)
def training_plan(spark, folder):
    """Needs of the synthesised configs; the corpus is small, so the cap is set high."""
    dist = views.stored_distribution(spark, folder)
    plan = runs.training_plan(synthesis.synthesize_mixtures(dist, CHOSEN), dist, cap=2500)
    return plan.select(
        "index", "domain", *[rounded(c).alias(c) for c in ("weight", "sequences", "tokens", "epochs")], "over_cap"
    )


PARAMETERS = """
users AS (SELECT user_id AS "index", max(k) AS most, min(k) AS least, count(*) AS n FROM (
            SELECT user_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events) GROUP BY 1),
sizes AS (SELECT "index", most % 3 <> 0 AS resized, 64 * (1 + most % 8) AS batch, 1 + least % 4 AS micro, 1000 + n AS steps
          FROM users),
basis AS (SELECT *, (CASE WHEN resized THEN batch ELSE 512 END) // 8 AS batch_size,
                 CASE WHEN resized THEN micro ELSE 4 END AS used_micro,
                 CASE WHEN resized THEN steps ELSE 25000 END AS used_steps
          FROM sizes)
"""


@query(
    "p13_resolve_params",
    with_ctes(
        """SELECT "index", batch_size::BIGINT AS batch_size,
                  (batch_size // used_micro)::BIGINT AS gradient_accumulation_steps,
                  (1000 * (batch_size // used_micro))::BIGINT AS warmup_iters,
                  (used_steps * (batch_size // used_micro))::BIGINT AS max_iters,
                  (10 * (batch_size // used_micro))::BIGINT AS log_iter_interval,
                  steps::BIGINT AS max_step, 21::BIGINT AS n_params
           FROM basis""",
        PARAMETERS,
    ),
)
def resolve_params(spark, folder):
    """Parameters of one run per user: sizes from the user's events, one unknown key, batch size not always set."""
    key = F.get_json_object("props", "$.k").cast("long")
    users = views.table(spark, folder, "events").groupBy(F.col("user_id").alias("index")).agg(
        F.max(key).alias("most"), F.min(key).alias("least"), F.count(F.lit(1)).alias("n")
    )
    given = F.create_map(
        F.lit("global_batch_size"),
        F.when(F.pmod("most", F.lit(3)) != 0, (64 * (1 + F.pmod("most", F.lit(8)))).cast("string")),
        F.lit("micro_batch_size"),
        (1 + F.pmod("least", F.lit(4))).cast("string"),
        F.lit("max_step"),
        (1000 + F.col("n")).cast("string"),
        F.lit("colour"),
        F.lit("blue"),
    )
    rows = users.select("index", F.map_filter(given, lambda k, v: v.isNotNull()).alias("params"))
    found = runs.resolve_params(rows)
    return found.select(
        "index",
        "batch_size",
        "gradient_accumulation_steps",
        "warmup_iters",
        "max_iters",
        "log_iter_interval",
        F.col("resolved")["max_step"].cast("long").alias("max_step"),
        F.size("resolved").cast("long").alias("n_params"),
    )
