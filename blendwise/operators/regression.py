"""Losses predicted from mixture weights, and the mixtures with the lowest prediction."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blendwise.functions.draws import digest, uniform
from blendwise.operators.synthesis import attach_domains

# Fixed values of the method.
SIMULATIONS = 100_000
TOP_K = 128
PATIENCE = 3
ROUNDS, RATE = 1000, 0.01
# Rounds of the first fit; each further one has four times as many, until patience ends or ``ROUNDS`` are reached.
FIRST_ROUNDS = 32
FIT_SEED = 42
# Directions in which standardised features vary by less than this share carry no coefficient.
FLAT = 1e-9


def assemble(df: DataFrame, domains: Sequence[str], out: str = "features") -> DataFrame:
    """Domain columns in fixed order as one vector; missing weights count as zero."""
    filled = df.fillna(0.0, subset=list(domains))
    return VectorAssembler(inputCols=list(domains), outputCol=out).transform(filled)


def assemble_samples(samples: DataFrame, out: str = "features") -> DataFrame:
    """The weight array of simulated mixtures as a vector; its order is that of sorted domain names."""
    return samples.withColumn(out, array_to_vector("weights"))


def fit_boosted(
    fit: DataFrame,
    stop: DataFrame,
    targets: Sequence[str],
    rounds: int = ROUNDS,
    rate: float = RATE,
    depth: int = 3,
    patience: int = PATIENCE,
    seed: int = FIT_SEED,
) -> dict[str, GBTRegressionModel]:
    """One boosted-tree model per target with early stopping on a set of its own.

    The error on ``stop`` is followed round by round: the first round after which ``patience`` rounds bring no gain
    ends the model, which keeps the trees up to the best round. The fit grows in steps, so that a model which stops
    early never costs all ``rounds``.
    """
    fit, stop = fit.cache(), stop.cache()
    models = {}
    for target in targets:
        trainer = GBTRegressor(featuresCol="features", labelCol=target, stepSize=rate, maxDepth=depth, seed=seed)
        size = min(FIRST_ROUNDS, rounds)
        while True:
            model = trainer.setMaxIter(size).fit(fit)
            errors = model.evaluateEachIteration(stop.select("features", target), "squared")
            best = stop_round(errors, patience)
            if size == rounds or len(errors) - 1 - best >= patience:
                break
            size = min(4 * size, rounds)
        models[target] = first_trees(model, best + 1)
    fit.unpersist()
    stop.unpersist()
    return models


def first_trees(model: GBTRegressionModel, n: int) -> GBTRegressionModel:
    """The same model with its first ``n`` trees."""
    java, jvm = model._java_obj, SparkSession.active()._jvm
    trees = java.trees()[:n]
    array = SparkSession.active().sparkContext._gateway.new_array
    kept = array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
    weights = array(jvm.double, len(trees))
    for i, (tree, weight) in enumerate(zip(trees, java.treeWeights())):
        kept[i], weights[i] = tree, weight
    cut = jvm.org.apache.spark.ml.regression.GBTRegressionModel(java.uid(), kept, weights, java.numFeatures())
    return GBTRegressionModel(cut)


def stop_round(errors: Sequence[float], patience: int = PATIENCE) -> int:
    """Index of the best round before the first ``patience`` rounds in a row without gain."""
    best = 0
    for number, error in enumerate(errors):
        if error < errors[best]:
            best = number
        elif number - best >= patience:
            break
    return best


@dataclass(frozen=True)
class LinearModel:
    """Least-squares fit of one target; ``rank`` counts the independent directions of the centred features."""

    coefficients: tuple[float, ...]
    intercept: float
    n: int
    rank: int
    squared_error: float
    squared_total: float
    features: str = "features"

    @property
    def r2(self) -> float | None:
        """Explained share of the squares; None if the target never varies."""
        return 1 - self.squared_error / self.squared_total if self.squared_total > 0 else None

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction``, as a column expression."""
        weights = F.array(*[F.lit(c) for c in self.coefficients])
        products = F.zip_with(vector_to_array(self.features), weights, lambda x, c: x * c)
        return df.withColumn("prediction", F.aggregate(products, F.lit(self.intercept), lambda acc, v: acc + v))


def product_sums(df: DataFrame, targets: Sequence[str], features: str = "features") -> DataFrame:
    """(place, total): sums of all products of (1, features…, targets…), place by place of the flattened matrix.

    One pass for all targets. Each task adds up one matrix, and only these matrices are shuffled. Rows in which
    the features or a target are NULL or NaN take no part.
    """
    values = F.concat(F.array(F.lit(1.0)), vector_to_array(features), F.array(*[F.col(t).cast("double") for t in targets]))

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in frames:
            z = np.array(frame["z"].tolist(), float)
            z = z[~np.isnan(z).any(axis=1)]
            total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield pd.DataFrame({"cells": [total.ravel()]})

    known = df.where(F.col(features).isNotNull()).select(values.alias("z"))
    cells = known.mapInPandas(add, "cells array<double>")
    return cells.select(F.posexplode("cells").alias("place", "part")).groupBy("place").agg(F.sum("part").alias("total"))


def fit_linear(fit: DataFrame, targets: Sequence[str], features: str = "features") -> dict[str, LinearModel]:
    """One linear model per target by the normal equations, all from one pass over the rows.

    Weights of a mixture add up to one, so their matrix never has full rank: the equations are solved on standardised
    features by the pseudo-inverse, which leaves the predictions unique. An empty table is an error.
    """
    # (1 + features + targets)² numbers, whatever the number of rows.
    cells = sorted(tuple(row) for row in product_sums(fit, targets, features).collect())
    if not cells or not cells[0][1]:
        raise ValueError("no rows to fit")
    width = round(len(cells) ** 0.5)
    sums = np.array([total for _, total in cells]).reshape(width, width)
    n, means = sums[0, 0], sums[0] / sums[0, 0]
    centred = sums - n * np.outer(means, means)
    size = np.sqrt(np.clip(np.diag(centred), 0, None))
    # What is left of a constant column is rounding.
    size = np.where(size > FLAT * np.sqrt(np.diag(sums)), size, np.inf)
    unit = centred / np.outer(size, size)
    d = width - 1 - len(targets)
    x = slice(1, d + 1)
    values, vectors = np.linalg.eigh(unit[x, x])
    kept = values > FLAT * max(1, d)
    models = {}
    for i, target in enumerate(targets, d + 1):
        turned = vectors[:, kept].T @ (centred[x, i] / size[x])
        slopes = vectors[:, kept] @ (turned / values[kept]) / size[x]
        total = max(float(centred[i, i]), 0.0)
        error = max(total - float(turned @ (turned / values[kept])), 0.0)
        models[target] = LinearModel(
            tuple(float(c) for c in slopes), float(means[i] - slopes @ means[x]), int(n), int(kept.sum()), error, total, features
        )
    return models


def predict(model, df: DataFrame) -> DataFrame:
    return model.transform(df)


def residual_products(scored: DataFrame, target: str, names: Sequence[str], intercept: str = "intercept") -> DataFrame:
    """(feature, n, residual) of a scored table: its normal equations, which are zero for the least-squares fit.

    ``residual`` is the sum over all rows of feature times error, as a share of the sum of feature times target in
    absolute values. The intercept counts as a feature that is always one.
    """
    values = F.concat(vector_to_array("features"), F.array(F.lit(1.0)))
    labels = F.array(*[F.lit(name) for name in [*names, intercept]])
    cells = scored.select(
        F.explode(F.zip_with(labels, values, lambda name, x: F.struct(name.alias("feature"), x.alias("x")))).alias("c"),
        F.col(target).alias("loss"),
        (F.col(target) - F.col("prediction")).alias("error"),
    )
    size = F.sum(F.abs(F.col("c.x") * F.col("loss")))
    return cells.groupBy(F.col("c.feature").alias("feature")).agg(
        F.count(F.lit(1)).alias("n"),
        F.when(size > 0, F.sum(F.col("c.x") * F.col("error")) / size).otherwise(0.0).alias("residual"),
    )


def predict_linear(samples: DataFrame, coefficients: DataFrame, intercept: float = 0.0) -> DataFrame:
    """Predictions from a table (domain, coefficient), without moving the samples."""
    product = F.zip_with("weights", "_domains", lambda w, d: w * d["coefficient"])
    total = F.aggregate(product, F.lit(float(intercept)), lambda acc, v: acc + v)
    return attach_domains(samples, coefficients, "coefficient").withColumn("prediction", total).drop("_domains")


def rmse(model, df: DataFrame, target: str) -> float:
    return RegressionEvaluator(labelCol=target, metricName="rmse").evaluate(model.transform(df))


def split_sets(df: DataFrame, parts: Sequence[float], seed: int = FIT_SEED, key: str = "index") -> list[DataFrame]:
    """Disjoint sets by a hash of the key: fitting, stopping and scoring never share rows."""
    u = uniform(digest(seed, "set", F.col(key)))
    total, low, found = sum(parts), 0.0, []
    for number, part in enumerate(parts):
        high = low + part / total
        upper = F.lit(True) if number == len(parts) - 1 else u < high
        found.append(df.where((u >= low) & upper))
        low = high
    return found


def top_k(df: DataFrame, k: int = TOP_K, score: str = "prediction", key: str = "sample_id") -> DataFrame:
    """The ``k`` rows with the lowest prediction; each task sends at most ``k``."""
    return df.orderBy(score, key).limit(k)


def optimal_mixture(samples: DataFrame) -> DataFrame:
    """Mean weight per domain over chosen samples in rows (sample_id, domain, weight)."""
    return samples.groupBy("domain").agg(F.avg("weight").alias("weight"), F.count(F.lit(1)).alias("n"))


def compare_to_prior(
    prior: DataFrame, mix: DataFrame, prior_label: str = "Human", mix_label: str = "Optimal"
) -> DataFrame:
    """Prior and mixture weights one below the other, told apart by ``type``."""
    first = prior.select("domain", F.col("prior").alias("weight"), F.lit(prior_label).alias("type"))
    return first.unionByName(mix.select("domain", "weight", F.lit(mix_label).alias("type")))
