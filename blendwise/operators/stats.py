"""Reports on weights and losses: extremes, quantiles, histograms, zero counts, correlations, intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blendwise.functions.draws import digest, poisson_one, uniform
from blendwise.operators.ordering import join_same, number_rows, ranks_of_counted
from blendwise.operators.weights import is_zero
from blendwise.session import durable

# Bins of the text report, of the weight plots and of the simulated losses.
TEXT_BINS, PLOT_BINS, LOSS_BINS = 10, 20, 32


def weight_stats(
    weights: DataFrame,
    by: Sequence[str] = ("domain",),
    value: str = "weight",
    key: Sequence[str] = ("index",),
    quantiles: Sequence[float] = (0.25, 0.5, 0.75),
) -> DataFrame:
    """Count, extremes, mean, deviation and exact quantiles per domain.

    Quantiles interpolate between the two neighbouring rows of the distributed order; no group is gathered.
    """
    by = list(by)
    totals = weights.groupBy(*by).agg(
        F.count(value).alias("n"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("stddev"),
    )
    if not quantiles:
        return totals
    present = weights.where(F.col(value).isNotNull()).select(*by, *key, value)
    placed = join_same(number_rows(present, by, [value, *key], "_place"), totals.select(*by, "n"), by)
    shares = []
    for q in quantiles:
        at = (F.col("n") - 1) * F.lit(float(q))
        part = at - F.floor(at)
        near = F.when(F.col("_place") == F.floor(at), F.col(value) * (1 - part))
        far = F.when((F.col("_place") == F.floor(at) + 1) & (part > 0), F.col(value) * part)
        shares.append((F.sum(near) + F.coalesce(F.sum(far), F.lit(0.0))).alias(f"q{round(q * 100):02d}"))
    return join_same(totals, placed.groupBy(*by).agg(*shares), by)


def histogram(df: DataFrame, value: str, by: Sequence[str] = ("domain",), bins: int = TEXT_BINS) -> DataFrame:
    """Equal-width bins between each group's own extremes, empty bins included.

    The last bin holds its upper edge. If all values are equal the range is half a unit to each side.
    """
    by = list(by)
    present = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    ends = present.groupBy(*by).agg(F.min(value).alias("_min"), F.max(value).alias("_max"))
    flat = F.col("_min") == F.col("_max")
    ends = ends.select(
        *by,
        (F.col("_min") - F.when(flat, 0.5).otherwise(0.0)).alias("_lo"),
        (F.col("_max") + F.when(flat, 0.5).otherwise(0.0)).alias("_hi"),
    )
    place = F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)
    ranged = join_same(present.select(*by, value), ends, by) if by else _with_one_row(present.select(value), ends)
    counted = ranged.select(*by, F.least(place, F.lit(bins - 1)).alias("bin"))
    counted = counted.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    frame = ends.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    width = (F.col("_hi") - F.col("_lo")) / bins
    return join_same(frame, counted, [*by, "bin"], "left").select(
        *by,
        "bin",
        (F.col("_lo") + F.col("bin") * width).alias("lo"),
        (F.col("_lo") + (F.col("bin") + 1) * width).alias("hi"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n"),
    )


def _with_one_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate, as one scalar subquery."""
    together = df.withColumn("_row", row.select(F.struct(*row.columns)).scalar())
    return together.select(*df.columns, "_row.*")


def zero_counts(weights: DataFrame) -> DataFrame:
    """Configs per domain in which its weight is zero."""
    return weights.groupBy("domain").agg(F.count_if(is_zero(F.col("weight"))).alias("n_zero"))


def configs_by_zero_count(weights: DataFrame, by: str = "index") -> DataFrame:
    """How many configs have 0, 1, 2, … zero domains."""
    per_config = weights.groupBy(by).agg(F.count_if(is_zero(F.col("weight"))).alias("n_zero"))
    return per_config.groupBy("n_zero").agg(F.count(F.lit(1)).alias("n_configs"))


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ("target",)) -> DataFrame:
    """Rank correlation per group, and in percent with two decimals; NULL if one side never varies.

    Rows are first counted per distinct pair of values, so everything ordered or joined is free of copies. Ranks are
    taken from their known mean, (n + 1) / 2, which keeps the sums exact enough for groups of any size.
    """
    by = list(by)
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, x, y)
    pairs = durable(pairs.agg(F.count(F.lit(1)).alias("_copies")))
    totals = pairs.groupBy(*by).agg(F.sum("_copies").alias("n"))
    ranked = join_same(pairs, totals, by)
    for value, out in ((x, "_rx"), (y, "_ry")):
        counts = pairs.groupBy(*by, value).agg(F.sum("_copies").alias("_copies"))
        ranked = join_same(ranked, ranks_of_counted(counts, by, value, out), [*by, value])
    middle = (F.col("n") + 1) / 2
    rx, ry = F.col("_rx") - middle, F.col("_ry") - middle
    sums = ranked.groupBy(*by).agg(
        F.max("n").alias("n"),
        F.sum(F.col("_copies") * rx * ry).alias("_xy"),
        F.sum(F.col("_copies") * rx * rx).alias("_xx"),
        F.sum(F.col("_copies") * ry * ry).alias("_yy"),
    )
    spread = F.sqrt("_xx") * F.sqrt("_yy")
    found = sums.select(*by, "n", F.when(spread > 0, F.col("_xy") / spread).alias("rho"))
    return found.withColumn("percent", F.round(F.col("rho") * 100, 2))


def trend_line(df: DataFrame, x: str, y: str, by: Sequence[str] = ("target",)) -> DataFrame:
    """Least-squares line of ``y`` on ``x`` per group."""
    return df.groupBy(*by).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
    )


def mixture_summary(
    weights: DataFrame,
    boot: int = 1000,
    seed: int = 42,
    by: Sequence[str] = ("domain", "type"),
    key: Sequence[str] = ("sample_id",),
    level: float = 0.95,
) -> DataFrame:
    """Mean weight per domain and type with a bootstrap interval of the mean.

    The Poisson form: in each replica each row counts 0, 1, 2, … times, drawn from its own ``key``, which is unique in
    its group. Rows stay where they are; only sums per group and replica move. A replica that drew no row is left out.
    """
    by = list(by)
    totals = weights.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("weight").alias("mean"))
    drawn = weights.select(*by, *key, "weight", F.explode(F.sequence(F.lit(0), F.lit(boot - 1))).alias("_replica"))
    hashed = digest(seed, "boot", *[F.col(c) for c in by], F.col("_replica"), *[F.col(c) for c in key])
    drawn = drawn.where(F.col("weight").isNotNull()).withColumn("_copies", poisson_one(uniform(hashed)))
    means = drawn.groupBy(*by, "_replica").agg(
        F.try_divide(F.sum(F.col("_copies") * F.col("weight")), F.sum("_copies")).alias("_mean")
    )
    # At most ``boot`` values per group.
    tail = (1 - level) / 2
    ends = means.groupBy(*by).agg(
        F.percentile("_mean", F.lit(tail)).alias("lo"), F.percentile("_mean", F.lit(1 - tail)).alias("hi")
    )
    return join_same(totals, ends, by, "left")
