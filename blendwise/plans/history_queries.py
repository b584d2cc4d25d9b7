"""Queries over run histories: choosing runs and values, loss averages, speed."""

from __future__ import annotations

from pyspark.sql import functions as F

from blendwise.functions import names
from blendwise.operators import history, monitor
from blendwise.operators.ordering import number_rows
from blendwise.plans import views
from blendwise.plans.views import EVENT_TYPES, HISTORY, LOSSES, MIXTURE, MONITOR, RANKED, r, rounded, with_ctes
from blendwise.session import scratch
from blendwise.sources import tables

STEP = 3
METRICS = ("click", "error", "view")
PREFIX = "proxy_n"

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


# --- scans and sinks -------------------------------------------------------------------------------------------

ALL_METRICS = ", ".join(EVENT_TYPES)


@query("s7_read_run_history", with_ctes(f"SELECT run, seq, step, {ALL_METRICS} FROM history", HISTORY))
def read_run_history(spark, folder):
    """History written as JSON lines, in which missing metrics are left out, and read with a schema."""
    path = scratch(spark, "history")
    rows = views.history(spark, folder)
    rows.write.json(path)
    return tables.read_run_history(spark, path, rows.schema.simpleString()[len("struct<"):-1].replace(":", " "), "json")


@query(
    "s7_read_merged_history",
    with_ctes(f"SELECT run, seq, step, {ALL_METRICS} FROM history", HISTORY),
)
def read_merged_history(spark, folder):
    """Each metric in files of its own with its own columns; the scan merges their schemas."""
    path = scratch(spark, "history")
    rows = views.history(spark, folder)
    rows.persist()
    for metric in EVENT_TYPES:
        kept = rows.where(F.col(metric).isNotNull()).select("run", "seq", "step", metric)
        kept.write.parquet(f"{path}/source={metric}")
    rows.unpersist()
    return tables.read_run_history(spark, path).select("run", "seq", "step", *EVENT_TYPES)


MERGED = ", ".join(
    f"arg_max({m}, seq) FILTER (WHERE {m} IS NOT NULL) AS {m}" for m in EVENT_TYPES
)


@query("s8_merge_step_metrics", with_ctes(f"SELECT run, step, {MERGED} FROM history GROUP BY run, step", HISTORY))
def merge_step_metrics(spark, folder):
    return history.merge_step_metrics(views.history(spark, folder), by=["run"])


@query(
    "s8_write_metrics",
    with_ctes(
        f"SELECT step, {MERGED.replace(', seq)', ', run * 4294967296 + seq)')} FROM history GROUP BY step",
        HISTORY,
    ),
)
def write_metrics(spark, folder):
    """Merged over all runs, written as CSV and read back."""
    path = scratch(spark, "metrics")
    rows = views.history(spark, folder).withColumn("place", F.col("run") * 4294967296 + F.col("seq")).drop("run", "seq")
    merged = history.merge_step_metrics(rows, order="place")
    tables.write_metrics(merged, path)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in merged.schema.fields)
    return spark.read.schema(fields).option("header", "true").csv(path)


# --- runs, steps, values ---------------------------------------------------------------------------------------

NAMES = f"""
names AS (SELECT DISTINCT user_id AS run,
                 CASE WHEN user_id % 10 = 0 THEN 'other_' || user_id
                      WHEN user_id % 10 = 1 THEN '{PREFIX}' || user_id || 'b'
                      ELSE '{PREFIX}' || user_id END AS name
          FROM events)
"""


def run_names(spark, folder):
    """Runs with three kinds of names: foreign, with a number, with something that is no number."""
    users = views.table(spark, folder, "events").select(F.col("user_id").alias("run")).distinct()
    number, rest = F.col("run").cast("string"), F.pmod("run", F.lit(10))
    name = (
        F.when(rest == 0, F.concat(F.lit("other_"), number))
        .when(rest == 1, F.concat(F.lit(PREFIX), number, F.lit("b")))
        .otherwise(F.concat(F.lit(PREFIX), number))
    )
    return users.withColumn("name", name)


@query(
    "p8_select_runs",
    with_ctes(
        f"""SELECT run, name, replace(name, '{PREFIX}', '')::BIGINT AS "index" FROM names
            WHERE starts_with(name, '{PREFIX}') AND try_cast(replace(name, '{PREFIX}', '') AS BIGINT) IS NOT NULL""",
        NAMES,
    ),
)
def select_runs(spark, folder):
    return history.select_runs(run_names(spark, folder), PREFIX)


@query(
    "p8_rejected_runs",
    with_ctes(
        f"""SELECT run, name FROM names
            WHERE starts_with(name, '{PREFIX}') AND try_cast(replace(name, '{PREFIX}', '') AS BIGINT) IS NULL""",
        NAMES,
    ),
)
def rejected_runs(spark, folder):
    return history.rejected_runs(run_names(spark, folder), PREFIX)


@query(
    "p9_select_step",
    with_ctes(f"SELECT run, seq, step, {', '.join(METRICS)} FROM history WHERE step = {STEP}", HISTORY),
)
def select_step(spark, folder):
    """Listed metrics at one step; one of the listed metrics does not exist."""
    return history.select_step(views.history(spark, folder), [*METRICS, "absent"], STEP)


FIRST = f"""
firsts AS (SELECT run, {', '.join(f'arg_min({m}, seq) FILTER (WHERE {m} IS NOT NULL) AS {m}' for m in METRICS)}
           FROM history WHERE step = {STEP} GROUP BY run),
complete AS (SELECT * FROM firsts WHERE {' AND '.join(f'{m} IS NOT NULL' for m in METRICS)})
"""


@query("w0_collect_losses", with_ctes("SELECT * FROM complete", HISTORY, FIRST))
def collect_losses(spark, folder):
    return history.collect_losses(views.history(spark, folder), METRICS, STEP)


@query(
    "w0_collect_losses_with_empty",
    with_ctes(
        f"SELECT run, {', '.join(METRICS)} FROM (SELECT DISTINCT run FROM history) LEFT JOIN complete USING (run)",
        HISTORY,
        FIRST,
    ),
)
def collect_losses_with_empty(spark, folder):
    return history.collect_losses(views.history(spark, folder), METRICS, STEP, enable_empty_row=True)


@query(
    "w0b_dedup_runs",
    """SELECT run AS name, event_id, event_type, value FROM (
         SELECT user_id AS run, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n
         FROM events) WHERE n = 1""",
)
def dedup_runs(spark, folder):
    events = views.table(spark, folder, "events")
    return history.dedup_runs(
        events.select(F.col("user_id").alias("name"), "event_id", "event_type", "value"), order="event_id"
    )


# --- mixtures and losses ---------------------------------------------------------------------------------------

USED = """
used AS (SELECT DISTINCT "index" FROM mix WHERE "index" % 9 <> 4),
scored AS (SELECT * FROM losses WHERE "index" % 11 <> 5)
"""


def mixture_and_losses(spark, folder):
    """Configs and runs of which some lack the other side."""
    mix = views.mixtures(spark, folder).where(F.pmod("index", F.lit(9)) != 4)
    return mix, views.losses(spark, folder).where(F.pmod("index", F.lit(11)) != 5)


@query(
    "j1_join_mixture_loss",
    with_ctes(
        f"""SELECT "index", domain, {r('weight')} AS weight, {r('price_loss')} AS price_loss, {r('discount_loss')} AS discount_loss
            FROM mix JOIN losses USING ("index")""",
        MIXTURE,
        LOSSES,
    ),
)
def join_mixture_loss(spark, folder):
    found = history.join_mixture_loss(views.mixtures(spark, folder), views.losses(spark, folder))
    return found.select(
        "index", "domain", *[rounded(c).alias(c) for c in ("weight", "price_loss", "discount_loss")]
    )


@query(
    "j2_mixture_loss_gaps",
    with_ctes(
        """SELECT "index", 'loss' AS missing FROM used WHERE "index" NOT IN (SELECT "index" FROM scored)
           UNION ALL
           SELECT "index", 'mixture' AS missing FROM scored WHERE "index" NOT IN (SELECT "index" FROM used)""",
        MIXTURE,
        LOSSES,
        USED,
    ),
)
def mixture_loss_gaps(spark, folder):
    return history.mixture_loss_gaps(*mixture_and_losses(spark, folder))


# --- losses ----------------------------------------------------------------------------------------------------

EVAL_ITERS = 5
BATCHES = (
    RANKED
    + """, batches AS (
  SELECT run, seq // 40 AS step, event_type AS domain, ln(1e0 + value) AS loss,
         row_number() OVER (PARTITION BY run, seq // 40, event_type ORDER BY seq) - 1 AS batch
  FROM ranked)
"""
)


def batches(spark, folder):
    """Validation batches: forty events per step, one loss per event, numbered per domain."""
    rows = views.ranked_events(spark, folder).select(
        "run",
        F.floor(F.col("seq") / 40).alias("step"),
        F.col("event_type").alias("domain"),
        "seq",
        F.log(1 + F.col("value")).alias("loss"),
    )
    return number_rows(rows, ["run", "step", "domain"], ["seq"], "batch")


@query(
    "a9_validation_loss",
    with_ctes(
        f"""SELECT run, step, domain, count(*)::BIGINT AS n_batches, {r('avg(loss)')} AS val_loss, {r('exp(avg(loss))')} AS val_ppl
            FROM batches WHERE batch < {EVAL_ITERS} GROUP BY run, step, domain""",
        BATCHES,
    ),
)
def validation_loss(spark, folder):
    found = history.validation_loss(batches(spark, folder), EVAL_ITERS)
    return found.withColumn("val_loss", rounded("val_loss")).withColumn("val_ppl", rounded("val_ppl"))


@query(
    "a10_perplexity",
    f"SELECT user_id AS run, count(*)::BIGINT AS n, {r('exp(avg(ln(1e0 + value)))')} AS ppl FROM events GROUP BY 1",
)
def perplexity(spark, folder):
    events = views.table(spark, folder, "events").groupBy(F.col("user_id").alias("run"))
    found = events.agg(F.count(F.lit(1)).alias("n"), F.avg(F.log(1 + F.col("value"))).alias("loss"))
    return found.select("run", "n", rounded(names.perplexity(F.col("loss"))).alias("ppl"))


TOKENS = """
tokens AS (SELECT l_suppkey AS run, CASE WHEN l_returnflag = 'R' THEN {ignore} ELSE l_linenumber END AS target,
                  ln(l_quantity) AS nll FROM lineitem)
"""


def masked(ignore: int, denominator: str):
    def run(spark, folder):
        items = views.table(spark, folder, "lineitem").select(
            F.col("l_suppkey").alias("run"),
            F.when(F.col("l_returnflag") == "R", ignore).otherwise(F.col("l_linenumber")).alias("target"),
            F.log("l_quantity").alias("nll"),
        )
        found = history.masked_mean_loss(items, ignore, denominator)
        return found.withColumn("mean_loss", rounded("mean_loss"))

    return run


def masked_sql(ignore: int, denominator: str) -> str:
    count = "count(*)" if denominator == "all" else f"count(*) FILTER (WHERE target <> {ignore})"
    return with_ctes(
        f"SELECT run, {r(f'sum(CASE WHEN target <> {ignore} THEN nll END) / {count}')} AS mean_loss FROM tokens GROUP BY run",
        TOKENS.format(ignore=ignore),
    )


for _name, _ignore, _denominator in (
    ("a11_masked_mean_unchunked", -1, "kept"),
    ("a11_masked_mean_chunked", -1, "all"),
    ("a11_masked_mean_training", -100, "kept"),
):
    QUERIES[_name] = masked(_ignore, _denominator)
    ORACLES[_name] = masked_sql(_ignore, _denominator)


# --- speed -----------------------------------------------------------------------------------------------------

LAST = "OVER (PARTITION BY run ORDER BY iter)"
RATES = ("batches_per_sec", "samples_per_sec", "tokens_per_sec")


@query(
    "w2_throughput",
    with_ctes(
        f"""SELECT run, iter, {r('2 / seconds * world_size')} AS batches_per_sec, {r('samples_moved / seconds * world_size')} AS samples_per_sec,
                   {r('samples_moved / seconds * (tokens_moved / 2e0) * world_size')} AS tokens_per_sec,
                   {r('2 / seconds')} AS device_batches_per_sec, {r('samples_moved / seconds')} AS device_samples_per_sec,
                   {r('samples_moved / seconds * (tokens_moved / 2e0)')} AS device_tokens_per_sec,
                   {r('tokens_moved / 2e0 * world_size * samples')} AS monitor_total_tokens
            FROM (SELECT *, elapsed - lag(elapsed, 2) {LAST} AS seconds, samples - lag(samples, 2) {LAST} AS samples_moved,
                         lengths - lag(lengths, 2) {LAST} AS tokens_moved FROM monitor)""",
        MONITOR,
    ),
)
def throughput(spark, folder):
    found = monitor.throughput(views.monitor_rows(spark, folder))
    columns = [*RATES, *[f"device_{c}" for c in RATES], "monitor_total_tokens"]
    return found.select("run", "iter", *[rounded(c).alias(c) for c in columns])


@query(
    "w3_rolling_train_loss",
    with_ctes(
        f"""SELECT run, iter, {r('train_loss')} AS train_loss, {r('exp(train_loss)')} AS train_ppl
            FROM (SELECT run, iter, CASE WHEN iter >= 2 THEN avg(loss) OVER (
                         PARTITION BY run ORDER BY iter ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END AS train_loss FROM monitor)""",
        MONITOR,
    ),
)
def rolling_train_loss(spark, folder):
    found = monitor.rolling_train_loss(views.monitor_rows(spark, folder), 10)
    return found.select(
        "run", "iter", rounded("train_loss").alias("train_loss"), rounded("train_ppl").alias("train_ppl")
    )


@query(
    "w4_compute_rate",
    with_ctes(
        f"""SELECT run, iter, {r('total / seconds')} AS flops_per_sec, {r('total / seconds / world_size')} AS device_flops_per_sec,
                   {r('total / seconds / world_size / peak_flops')} AS mfu
            FROM (SELECT *, elapsed - lag(elapsed, 2) {LAST} AS seconds,
                         sum(flops * world_size) OVER (PARTITION BY run ORDER BY iter ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS total
                  FROM monitor)""",
        MONITOR,
    ),
)
def compute_rate(spark, folder):
    found = monitor.compute_rate(views.monitor_rows(spark, folder))
    columns = ("flops_per_sec", "device_flops_per_sec", "mfu")
    return found.select("run", "iter", *[rounded(c).alias(c) for c in columns])


@query(
    "w5_time_totals",
    with_ctes(
        f"""SELECT run, iter, {r('elapsed / 3600')} AS time_train, {r('validated / 3600')} AS time_val,
                   {r('(elapsed + validated) / 3600')} AS time_total
            FROM (SELECT *, sum(coalesce(eval_seconds, 0e0)) OVER (PARTITION BY run ORDER BY iter ROWS UNBOUNDED PRECEDING) AS validated
                  FROM monitor)""",
        MONITOR,
    ),
)
def time_totals(spark, folder):
    found = monitor.time_totals(views.monitor_rows(spark, folder))
    columns = ("time_train", "time_val", "time_total")
    return found.select("run", "iter", *[rounded(c).alias(c) for c in columns])


@query(
    "w6_every_kth",
    with_ctes(f"SELECT run, iter, {r('loss')} AS loss FROM monitor WHERE iter % 10 = 0", MONITOR),
)
def every_kth(spark, folder):
    found = monitor.every_kth(views.monitor_rows(spark, folder), 10)
    return found.select("run", "iter", rounded("loss").alias("loss"))


# --- devices ---------------------------------------------------------------------------------------------------

DEVICES = (
    "NVIDIA H100 80GB HBM3",
    "NVIDIA H100 PCIe",
    "NVIDIA A100-SXM4-80GB",
    "NVIDIA A10G",
    "Tesla V100-SXM2-16GB",
    "Tesla V100-PCIE-32GB",
    "Tesla T4",
    "Quadro RTX 5000",
    "v4",
    "Unknown Device",
)
PRECISIONS = ("32-true", "16-true", "bf16-mixed", "8-true", "64-true")
PEAKS = ", ".join(
    [f"('{d}', '{p}', {peak!r}::DOUBLE)" for d, by in monitor.PEAK_FLOPS.items() for p, peak in by.items()]
    + [f"('{d}', NULL, {peak!r}::DOUBLE)" for d, peak in monitor.TPU_PEAK_FLOPS.items()]
)


@query(
    "j5_with_peak_flops",
    f"""WITH peaks AS (SELECT * FROM (VALUES {PEAKS}) AS t(device, precision, peak)),
        used AS (SELECT event_id, {list(DEVICES)!r}[user_id % {len(DEVICES)} + 1] AS device_name,
                        CASE event_type {' '.join(f"WHEN '{e}' THEN '{p}'" for e, p in zip(EVENT_TYPES, PRECISIONS))} END AS precision
                 FROM events),
        classed AS (SELECT *, lower(device_name) AS low,
                      CASE WHEN low IN ('v2', 'v3', 'v4') THEN low
                           WHEN low LIKE '%h100%' AND low LIKE '%hbm3%' THEN 'h100-sxm'
                           WHEN low LIKE '%h100%' AND (low LIKE '%pcie%' OR low LIKE '%hbm2e%') THEN 'h100-pcie'
                           WHEN low LIKE '%a100%' THEN 'a100' WHEN low LIKE '%a10g%' THEN 'a10g'
                           WHEN low LIKE '%v100-sxm%' THEN 'v100-sxm' WHEN low LIKE '%v100-pcie%' THEN 'v100-pcie'
                           WHEN low LIKE '%t4%' THEN 't4' WHEN low LIKE '%quadro rtx 5000%' THEN 'quadro rtx 5000' END AS device
                    FROM used)
        SELECT event_id, device_name, c.precision AS precision, c.device AS device, peak / 1e12 AS peak_tera
        FROM classed AS c LEFT JOIN peaks AS p
          ON c.device = p.device AND (p.precision = c.precision OR p.precision IS NULL)""",
)
def with_peak_flops(spark, folder):
    events = views.table(spark, folder, "events")
    devices = F.array(*[F.lit(d) for d in DEVICES])
    precision = F.create_map(*[F.lit(x) for pair in zip(EVENT_TYPES, PRECISIONS) for x in pair])[F.col("event_type")]
    used = events.select(
        "event_id",
        F.get(devices, F.pmod("user_id", F.lit(len(DEVICES))).cast("int")).alias("device_name"),
        precision.alias("precision"),
    )
    found = monitor.with_peak_flops(used)
    return found.select("event_id", "device_name", "precision", "device", (F.col("peak_flops") / 1e12).alias("peak_tera"))
