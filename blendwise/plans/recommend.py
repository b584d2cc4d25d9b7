"""From mixtures and losses to a recommended mixture."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blendwise.operators import regression as reg
from blendwise.operators.history import join_mixture_loss
from blendwise.operators.stats import LOSS_BINS, histogram, spearman
from blendwise.operators.synthesis import SEED, dirichlet_sample, explode_samples
from blendwise.operators.weights import to_wide
from blendwise.session import durable


def simulate(model, prior: DataFrame, n: int = reg.SIMULATIONS, seed: int = SEED) -> DataFrame:
    """Mixtures drawn around the plain prior with their predicted loss."""
    samples = reg.assemble_samples(dirichlet_sample(prior, n, seed))
    return reg.predict(model, samples).drop("features")


def loss_histogram(simulated: DataFrame, bins: int = LOSS_BINS) -> DataFrame:
    """Histogram of predictions, which are stored because range and counts both need them."""
    return histogram(durable(simulated.select("prediction")), "prediction", (), bins)


def fit_and_score(mix: DataFrame, loss: DataFrame, domains: list[str], target: str, **options):
    """Fit, stop and score on three disjoint sets of runs: the model and its rank correlation."""
    table = reg.assemble(join_mixture_loss(to_wide(mix, domains), loss.select("index", target)), domains)
    table = durable(table.select("index", "features", target))
    fit, stop, score = reg.split_sets(table, (0.6, 0.2, 0.2))
    model = reg.fit_boosted(fit, stop, [target], **options)[target]
    scored = reg.predict(model, score).withColumn("target", F.lit(target))
    return model, spearman(scored, "prediction", target)


def recommend_mixture(
    mix: DataFrame,
    loss: DataFrame,
    prior: DataFrame,
    target: str,
    n: int = reg.SIMULATIONS,
    k: int = reg.TOP_K,
    seed: int = SEED,
    **options,
) -> DataFrame:
    """Prior and recommended weight per domain: fit, simulate, average the best, compare.

    The domains are those of the prior, in name order. Every row carries how far the model can be trusted: ``rho``, the
    rank correlation of its predictions on the ``n_scored`` runs kept for scoring (NULL where they never vary).
    """
    # The prior has one row per domain: its names are the feature columns.
    domains = sorted(row.domain for row in prior.select("domain").collect())
    model, score = fit_and_score(mix, loss, domains, target, **options)
    best = reg.top_k(simulate(model, prior, n, seed), k)
    optimum = reg.optimal_mixture(explode_samples(best, prior))
    trust = score.select("target", F.col("n").alias("n_scored"), "rho")  # one row
    return reg.compare_to_prior(prior, optimum).withColumn("target", F.lit(target)).join(F.broadcast(trust), "target", "left")
