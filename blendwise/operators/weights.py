"""Shares of domains: the natural distribution, normalising, smoothing, usage bounds, reshaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blendwise.functions.numbers import round_exact
from blendwise.operators.ordering import join_same

# Fixed values of the method.
TEMPERATURE = 0.5
MAXIMUM_USAGE = 15
WEIGHT_DIGITS = 5
ZERO_WEIGHT = 1e-7


def token_distribution(docs: DataFrame, domain: str = "domain", n_tokens: str = "n_tokens") -> DataFrame:
    """Documents, tokens and share of all tokens per domain.

    The share is taken over the aggregated table, which has one row per domain.
    """
    totals = docs.groupBy(domain).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(n_tokens).alias("n_tokens"))
    everything = F.sum("n_tokens").over(Window.partitionBy(F.lit(0)))
    return totals.withColumn("prior", F.col("n_tokens") / everything)


def normalize_weights(weights: DataFrame, by: Sequence[str] = ("index",), value: str = "weight") -> DataFrame:
    """Divide by the sum within each config, or by the sum of all rows if ``by`` is empty.

    Sums are combined before the shuffle, and a config without any weight yields NULL rather than an error.
    """
    totals = weights.groupBy(*by).agg(F.sum(value).alias("_sum"))
    if not by:
        return weights.withColumn(value, F.try_divide(F.col(value), totals.scalar()))
    joined = join_same(weights, totals, list(by))
    return joined.withColumn(value, F.try_divide(F.col(value), F.col("_sum"))).drop("_sum")


def temper(weights: DataFrame, t: float = TEMPERATURE, by: Sequence[str] = ("index",), value: str = "weight") -> DataFrame:
    """Raise shares to the power ``t`` and normalise again; nothing happens for ``t`` of 1 or more."""
    if t >= 1:
        return weights
    return normalize_weights(weights.withColumn(value, F.pow(F.col(value), F.lit(float(t)))), by, value)


def usage_bounds(prior: DataFrame, max_usage: float = MAXIMUM_USAGE, value: str = "prior") -> DataFrame:
    """Largest allowed weight per domain, from the prior before smoothing."""
    return prior.withColumn("bound", F.least(F.col(value) * float(max_usage), F.lit(1.0)))


def clean_weights(raw: DataFrame, value: str = "value") -> DataFrame:
    """Training weights of raw configs: whole numbers as they are, others rounded to five decimals."""
    number = F.col(value).try_cast("double")
    whole = F.col(value).rlike(r"^\s*[+-]?\d+\s*$")
    return (
        raw.where(F.startswith("domain", F.lit("train_")) & number.isNotNull())
        .withColumn("weight", F.when(whole, number).otherwise(round_exact(number, WEIGHT_DIGITS)))
        .drop(value)
    )


def rejected_weights(raw: DataFrame, value: str = "value") -> DataFrame:
    """Training entries whose value is no number: reported, not silently lost."""
    return raw.where(F.startswith("domain", F.lit("train_")) & F.col(value).try_cast("double").isNull())


def to_wide(
    weights: DataFrame, domains: Sequence[str] | None = None, by: Sequence[str] = ("index",), value: str = "weight"
) -> DataFrame:
    """One row per config, one column per domain. Without a list, Spark reads the domains from the data and
    refuses more than ``spark.sql.pivotMaxValues``; with one, a domain that it does not name is an error."""
    if domains:
        name = F.col("domain")
        message = F.concat(F.lit("domain is not listed: "), F.coalesce(name, F.lit("NULL")))
        listed = F.when(name.isin(*domains), name).otherwise(F.raise_error(message).cast("string"))
        weights = weights.withColumn("domain", listed)
    return weights.groupBy(*by).pivot("domain", list(domains) if domains else None).agg(F.first(value, True))


def to_long(wide: DataFrame, by: Sequence[str] = ("index",), value: str = "weight") -> DataFrame:
    """One row per config and domain; missing cells are left out."""
    columns = [F.col(f"`{c}`") for c in wide.columns if c not in by]
    return wide.unpivot([F.col(c) for c in by], columns, "domain", value).where(F.col(value).isNotNull())


def is_zero(weight: Column) -> Column:
    return weight < ZERO_WEIGHT
