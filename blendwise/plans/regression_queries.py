"""Queries over losses predicted from mixtures: fits, correlations, simulation, recommendation."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from blendwise.functions.draws import POISSON_ONE
from blendwise.operators import history, regression, stats, synthesis, weights
from blendwise.plans import recommend, views
from blendwise.plans.views import (
    BRAND_PRIOR,
    BRANDS,
    LOSSES,
    MIXTURE,
    r,
    rounded,
    sql_digest,
    sql_dirichlet,
    sql_uniform,
    with_ctes,
)
from blendwise.session import durable

SEED = synthesis.SEED
TARGETS = ("discount_loss", "price_loss")
SAMPLES = regression.SIMULATIONS
TOP = regression.TOP_K
REPLICAS = 1000

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


def table(spark, folder):
    """One row per config: features in brand order and both losses."""
    wide = weights.to_wide(views.mixtures(spark, folder), BRANDS)
    joined = history.join_mixture_loss(wide, views.losses(spark, folder))
    return regression.assemble(joined, BRANDS).select("index", "features", *TARGETS)


POSITIONS = " + ".join(f'{i + 1} * coalesce("{b}", 0e0)' for i, b in enumerate(BRANDS))
CELLS = ", ".join(f"""max(CASE WHEN domain = '{b}' THEN weight END) AS "{b}" """ for b in BRANDS)


@query(
    "r1_assemble",
    with_ctes(
        f"""SELECT "index", 25::BIGINT AS n_features, {r(POSITIONS)} AS position_sum FROM wide""",
        MIXTURE,
        f"""wide AS (SELECT "index", {CELLS} FROM mix GROUP BY 1)""",
    ),
)
def assemble(spark, folder):
    """Features of every config, summed up by position so that their order counts."""
    wide = weights.to_wide(views.mixtures(spark, folder), BRANDS)
    found = regression.assemble(wide, BRANDS).withColumn("values", vector_to_array("features"))
    placed = F.transform("values", lambda v, i: v * (i + 1))
    return found.select(
        "index",
        F.size("values").cast("long").alias("n_features"),
        rounded(F.aggregate(placed, F.lit(0.0), lambda acc, v: acc + v)).alias("position_sum"),
    )


@query("r2_fit_boosted")
def fit_boosted(spark, folder):
    """Boosted trees per target, with early stopping, scored on runs they have not seen."""
    fit, stop, score = regression.split_sets(durable(table(spark, folder)), (0.6, 0.2, 0.2))
    models = regression.fit_boosted(fit, stop, TARGETS)
    scored = None
    for target, model in models.items():
        part = regression.predict(model, score).select(
            F.lit(target).alias("target"), "index", "prediction", F.col(target).alias("loss")
        )
        scored = part if scored is None else scored.unionByName(part)
    return scored


PLACES = ", ".join(f"({i}, '{name}')" for i, name in enumerate(BRANDS))
WIDTH = len(BRANDS)
# Least squares in SQL: a sweep over the correlations of all domains and targets, one domain a step. A domain that the
# earlier ones already explain is passed over, which leaves the predictions as they are.
LEAST_SQUARES = (
    MIXTURE,
    LOSSES,
    f"""configs AS (SELECT DISTINCT "index" FROM mix JOIN losses USING ("index")),
        dense AS (SELECT "index", i, coalesce(weight, 0e0) AS x
                  FROM (SELECT * FROM configs, (VALUES {PLACES}) AS d(i, domain)) LEFT JOIN mix USING ("index", domain)
                  {"".join(f'UNION ALL SELECT "index", {WIDTH + i}, {t} FROM configs JOIN losses USING ("index") ' for i, t in enumerate(TARGETS))}),
        centred AS (SELECT "index", i, x - avg(x) OVER (PARTITION BY i) AS x FROM dense),
        sizes AS (SELECT i, sqrt(sum(x * x)) AS size FROM centred GROUP BY i),
        means AS (SELECT i, avg(x) AS mean FROM dense GROUP BY i),
        scaled AS (SELECT "index", i, CASE WHEN size > 1e-9 THEN x / size ELSE 0e0 END AS x FROM centred JOIN sizes USING (i)),
        cells AS (SELECT a.i, b.i AS j, sum(a.x * b.x) AS v FROM scaled a JOIN scaled b USING ("index") GROUP BY 1, 2),
        sweep AS (SELECT 0 AS k, i, j, v FROM cells UNION ALL
                  SELECT k + 1, i, j, CASE WHEN rest < 1e-8 THEN v WHEN i = k THEN v / rest ELSE v - below * beside / rest END
                  FROM (SELECT *, max(v) FILTER (WHERE i = k AND j = k) OVER () AS rest,
                               max(v) FILTER (WHERE i = k) OVER (PARTITION BY j) AS beside,
                               max(v) FILTER (WHERE j = k) OVER (PARTITION BY i) AS below FROM sweep) WHERE k < {WIDTH}),
        swept AS (SELECT i, j, v FROM sweep WHERE k = {WIDTH}),
        used AS (SELECT i FROM swept WHERE i = j AND i < {WIDTH} AND v > 0.5),
        slopes AS (SELECT i, j, v FROM swept JOIN used USING (i) WHERE j >= {WIDTH}),
        fitted AS (SELECT "index", j, mean + size * offsets AS prediction
                   FROM (SELECT "index", j, sum(x * v) AS offsets FROM scaled JOIN slopes USING (i) GROUP BY 1, 2)
                   JOIN means ON means.i = j JOIN sizes ON sizes.i = j),
        targets AS (SELECT * FROM (VALUES {", ".join(f"({WIDTH + i}, '{t}')" for i, t in enumerate(TARGETS))}) AS t(j, target))
    """,
)


@query(
    "r3_fit_linear",
    with_ctes(
        f"""SELECT target, count(*)::BIGINT AS n, (SELECT count(*) FROM used)::BIGINT AS rank, {r('sqrt(avg((x - prediction) ^ 2))')} AS rmse,
                   {r('1 - sum((x - prediction) ^ 2) / max(size) ^ 2')} AS r2
            FROM fitted JOIN dense ON dense."index" = fitted."index" AND dense.i = j JOIN sizes ON sizes.i = j JOIN targets USING (j)
            GROUP BY target""",
        *LEAST_SQUARES,
        recursive=True,
    ),
)
def fit_linear(spark, folder):
    """Linear models on all domains and configs: how well each target is explained."""
    models = regression.fit_linear(table(spark, folder), TARGETS)
    found = [(t, m.n, m.rank, (m.squared_error / m.n) ** 0.5, m.r2) for t, m in models.items()]
    rows = spark.createDataFrame(found, "target string, n long, rank long, rmse double, r2 double")
    return rows.select("target", "n", "rank", rounded("rmse").alias("rmse"), rounded("r2").alias("r2"))


FEATURES = ", ".join(f"('{name}')" for name in (*BRANDS, "intercept"))


@query(
    "r3_fit_linear_domains",
    with_ctes(
        f"""SELECT target, feature, n, 0e0 AS residual
            FROM (VALUES {", ".join(f"('{t}')" for t in TARGETS)}) AS t(target), (VALUES {FEATURES}) AS f(feature),
                 (SELECT count(DISTINCT "index") AS n FROM mix JOIN losses USING ("index"))""",
        MIXTURE,
        LOSSES,
    ),
)
def fit_linear_domains(spark, folder):
    """Linear models on all domains and configs; least squares leaves no residual product for any feature."""
    rows = durable(table(spark, folder))
    models = regression.fit_linear(rows, TARGETS)
    parts = [
        regression.residual_products(regression.predict(models[t], rows), t, BRANDS).select(
            F.lit(t).alias("target"), "feature", "n", rounded("residual").alias("residual")
        )
        for t in TARGETS
    ]
    return parts[0].unionByName(parts[1])


@query(
    "r4_predict",
    with_ctes(
        f"""SELECT target, "index", {r('prediction')} AS prediction, {r('x')} AS loss
            FROM fitted JOIN targets USING (j) JOIN dense USING ("index") WHERE dense.i = j""",
        *LEAST_SQUARES,
        recursive=True,
    ),
)
def predict(spark, folder):
    """Linear models on all domains, applied to all configs."""
    rows = durable(table(spark, folder))
    models = regression.fit_linear(rows, TARGETS)
    parts = [
        regression.predict(models[t], rows).select(
            F.lit(t).alias("target"), "index", rounded("prediction").alias("prediction"), rounded(F.col(t)).alias("loss")
        )
        for t in TARGETS
    ]
    return parts[0].unionByName(parts[1])


@query(
    "a12_spearman",
    with_ctes(
        f"""SELECT l_returnflag AS target, count(*)::BIGINT AS n, {r('corr(rx, ry)')} AS rho, round(corr(rx, ry) * 100, 2) AS percent
            FROM ranked GROUP BY 1""",
        """ranked AS (SELECT l_returnflag,
             rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice)
               + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2e0 AS rx,
             rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity)
               + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2e0 AS ry
           FROM lineitem)""",
    ),
)
def spearman(spark, folder):
    """Rank correlation of price and quantity per return flag: three large groups with many ties."""
    items = views.table(spark, folder, "lineitem").withColumnRenamed("l_returnflag", "target")
    found = stats.spearman(items, "l_extendedprice", "l_quantity")
    return found.withColumn("rho", rounded("rho"))


TREND = """
trend AS (SELECT domain, regr_slope(discount_loss, weight) AS coefficient, regr_intercept(discount_loss, weight) AS intercept,
                 regr_r2(discount_loss, weight) AS r2
          FROM mix JOIN losses USING ("index") GROUP BY domain)
"""


def trend(spark, folder):
    joined = history.join_mixture_loss(views.mixtures(spark, folder), views.losses(spark, folder))
    return stats.trend_line(joined, "weight", "discount_loss", ["domain"])


@query(
    "a13_trend_line",
    with_ctes(
        f"SELECT domain, {r('coefficient')} AS slope, {r('intercept')} AS intercept, {r('r2')} AS r2 FROM trend",
        MIXTURE,
        LOSSES,
        TREND,
    ),
)
def trend_line(spark, folder):
    found = trend(spark, folder)
    return found.select("domain", *[rounded(c).alias(c) for c in ("slope", "intercept", "r2")])


# --- simulation ------------------------------------------------------------------------------------------------

# The predictor that SQL can repeat: each domain's own trend, summed up.
SIMULATED = (
    MIXTURE,
    BRAND_PRIOR,
    LOSSES,
    TREND,
    f"""samples AS (SELECT sample_id, 1e0 AS strength FROM (SELECT unnest(range({SAMPLES})) AS sample_id)),
        {sql_dirichlet('samples', 'prior', SEED)},
        predicted AS (SELECT sample_id, sum(weight * coefficient) AS prediction FROM simplex JOIN trend USING (domain) GROUP BY sample_id),
        best AS (SELECT * FROM predicted ORDER BY prediction, sample_id LIMIT {TOP}),
        best_rows AS (SELECT sample_id, domain, weight FROM simplex JOIN best USING (sample_id)),
        optimum AS (SELECT domain, avg(weight) AS weight, count(*) AS n FROM best_rows GROUP BY domain)
    """,
)


def simulated(spark, folder):
    prior = durable(views.brand_prior(spark, folder))
    samples = synthesis.dirichlet_sample(prior, SAMPLES, SEED)
    slopes = durable(trend(spark, folder).select("domain", F.col("slope").alias("coefficient")))
    return prior, regression.predict_linear(samples, slopes)


def best_rows(spark, folder):
    prior, found = simulated(spark, folder)
    return prior, synthesis.explode_samples(regression.top_k(found, TOP), prior)


@query("r4_predict_samples", with_ctes(f"SELECT sample_id, {r('prediction')} AS prediction FROM predicted", *SIMULATED, recursive=True))
def predict_samples(spark, folder):
    return simulated(spark, folder)[1].select("sample_id", rounded("prediction").alias("prediction"))


@query(
    "r5_loss_histogram",
    with_ctes(
        f"""SELECT bin::BIGINT AS bin, {r('lo + bin * (hi - lo) / 32')} AS lo, {r('lo + (bin + 1) * (hi - lo) / 32')} AS hi,
                   coalesce(n, 0)::BIGINT AS n
            FROM (SELECT lo, hi, unnest(range(32)) AS bin FROM ends) LEFT JOIN counted USING (bin)""",
        *SIMULATED,
        "ends AS (SELECT min(prediction) AS lo, max(prediction) AS hi FROM predicted)",
        """counted AS (SELECT least(floor((prediction - lo) / (hi - lo) * 32), 31)::BIGINT AS bin, count(*) AS n
                       FROM predicted, ends GROUP BY 1)""",
        recursive=True,
    ),
)
def loss_histogram(spark, folder):
    found = recommend.loss_histogram(simulated(spark, folder)[1])
    return found.select("bin", rounded("lo").alias("lo"), rounded("hi").alias("hi"), "n")


@query("t1_top_k", with_ctes(f"SELECT sample_id, {r('prediction')} AS prediction FROM best", *SIMULATED, recursive=True))
def top_k(spark, folder):
    found = regression.top_k(simulated(spark, folder)[1], TOP)
    return found.select("sample_id", rounded("prediction").alias("prediction"))


@query(
    "a14_optimal_mixture",
    with_ctes(f"SELECT domain, {r('weight')} AS weight, n::BIGINT AS n FROM optimum", *SIMULATED, recursive=True),
)
def optimal_mixture(spark, folder):
    found = regression.optimal_mixture(best_rows(spark, folder)[1])
    return found.withColumn("weight", rounded("weight"))


@query(
    "j6_compare_to_prior",
    with_ctes(
        f"""SELECT domain, {r('prior')} AS weight, 'Human' AS type FROM prior
            UNION ALL SELECT domain, {r('weight')} AS weight, 'Optimal' AS type FROM optimum""",
        *SIMULATED,
        recursive=True,
    ),
)
def compare_to_prior(spark, folder):
    prior, best = best_rows(spark, folder)
    found = regression.compare_to_prior(prior, regression.optimal_mixture(best))
    return found.withColumn("weight", rounded("weight"))


BOOT_KEY = sql_digest(SEED, "'boot'", "domain", "type", "replica", "sample_id")
BOOT_COPIES = " + ".join(f"(u > {limit!r}e0)::INT" for limit in POISSON_ONE)


@query(
    "a15_mixture_summary",
    with_ctes(
        f"""SELECT domain, type, n::BIGINT AS n, {r('mean')} AS mean, {r('lo')} AS lo, {r('hi')} AS hi
            FROM totals JOIN (SELECT domain, type, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi
                              FROM replica_means GROUP BY 1, 2) USING (domain, type)""",
        *SIMULATED,
        f"""both_types AS (SELECT -1 AS sample_id, domain, prior AS weight, 'Human' AS type FROM prior
                     UNION ALL SELECT sample_id, domain, weight, 'Optimal' FROM best_rows),
        totals AS (SELECT domain, type, count(*) AS n, avg(weight) AS mean FROM both_types GROUP BY 1, 2),
        draws AS (SELECT domain, type, replica, weight, {BOOT_COPIES} AS copies
                  FROM (SELECT *, {sql_uniform(BOOT_KEY)} AS u
                        FROM (SELECT *, unnest(range({REPLICAS})) AS replica FROM both_types))),
        replica_means AS (SELECT domain, type, replica, sum(copies * weight) / nullif(sum(copies), 0) AS m FROM draws GROUP BY 1, 2, 3)""",
        recursive=True,
    ),
)
def mixture_summary(spark, folder):
    prior, best = best_rows(spark, folder)
    rows = regression.compare_to_prior(prior, best).where("type = 'Human'").withColumn("sample_id", F.lit(-1).cast("long"))
    rows = rows.unionByName(best.withColumn("type", F.lit("Optimal")))
    found = stats.mixture_summary(durable(rows), REPLICAS, SEED)
    return found.select("domain", "type", "n", *[rounded(c).alias(c) for c in ("mean", "lo", "hi")])


@query("r5_simulate")
def simulate(spark, folder):
    """100,000 mixtures around the brand shares, predicted by boosted trees, as a histogram."""
    prior = durable(views.brand_prior(spark, folder))
    model, _ = recommend.fit_and_score(
        views.mixtures(spark, folder), views.losses(spark, folder), sorted(BRANDS), "discount_loss"
    )
    return recommend.loss_histogram(recommend.simulate(model, prior))


@query("r6_recommend_mixture")
def recommend_mixture(spark, folder):
    """The whole way from mixtures and losses to a recommended mixture."""
    prior = durable(views.brand_prior(spark, folder))
    return recommend.recommend_mixture(
        views.mixtures(spark, folder), views.losses(spark, folder), prior, "discount_loss"
    )
