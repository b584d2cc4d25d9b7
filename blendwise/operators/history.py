"""Metrics of many runs: choosing runs, steps and values, and loss averages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blendwise.operators.ordering import join_same

# Fixed values of the method.
SELECT_STEP = 1000
EVAL_ITERS = 50


def select_runs(runs: DataFrame, prefix: str, name: str = "name") -> DataFrame:
    """Runs ``<prefix><number>`` with the number as ``index``."""
    rest = F.replace(F.col(name), F.lit(prefix), F.lit("")).try_cast("long")
    return runs.where(F.startswith(F.col(name), F.lit(prefix)) & rest.isNotNull()).withColumn("index", rest)


def rejected_runs(runs: DataFrame, prefix: str, name: str = "name") -> DataFrame:
    """Runs with the prefix whose rest is no number."""
    rest = F.replace(F.col(name), F.lit(prefix), F.lit("")).try_cast("long")
    return runs.where(F.startswith(F.col(name), F.lit(prefix)) & rest.isNull())


def select_step(
    history: DataFrame, metrics: Sequence[str], step: int = SELECT_STEP, keep: Sequence[str] = ("run", "seq")
) -> DataFrame:
    """The listed metrics, as far as they exist, in the rows of one step."""
    found = [F.col(f"`{m}`") for m in metrics if m in history.columns]
    return history.where(F.col("step") == step).select(*keep, "step", *found)


def collect_losses(
    history: DataFrame,
    metrics: Sequence[str],
    step: int = SELECT_STEP,
    enable_empty_row: bool = False,
    run: str = "run",
    order: str = "seq",
) -> DataFrame:
    """First value of each metric among a run's rows at the step.

    Missing values are NULL or NaN. A run without all metrics is left out, or kept with NULLs on request.
    """
    rows = history.where(F.col("step") == step)
    first = []
    for metric in metrics:
        value = F.when(~F.isnan(F.col(f"`{metric}`").cast("double")), F.col(f"`{metric}`"))
        first.append(F.min_by(value, F.when(value.isNotNull(), F.col(order))).alias(metric))
    found = rows.groupBy(run).agg(*first)
    complete = F.lit(True)
    for metric in metrics:
        complete = complete & F.col(f"`{metric}`").isNotNull()
    found = found.where(complete)
    if not enable_empty_row:
        return found
    return join_same(history.select(run).distinct(), found, [run], "left")


def dedup_runs(runs: DataFrame, name: str = "name", order: str = "seq") -> DataFrame:
    """The first row of each run name, combined before the shuffle."""
    others = [F.col(f"`{c}`") for c in runs.columns if c != name]
    return runs.groupBy(name).agg(F.min_by(F.struct(*others), order).alias("_first")).select(name, "_first.*")


def merge_step_metrics(rows: DataFrame, key: str = "step", order: str = "seq", by: Sequence[str] = ()) -> DataFrame:
    """Partial rows of one step become one row; a later value replaces an earlier one.

    Rows without a step are dropped and columns sorted by name.
    """
    keys = [*by, key]
    metrics = [c for c in rows.columns if c not in (*keys, order)]
    latest = [
        F.max_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), F.col(order))).alias(c) for c in metrics
    ]
    merged = rows.where(F.col(key).isNotNull()).groupBy(*keys).agg(*latest)
    return merged.select(*[F.col(f"`{c}`") for c in sorted(merged.columns)])


def join_mixture_loss(mix: DataFrame, loss: DataFrame, key: str = "index") -> DataFrame:
    """Features and targets of the same run, matched by index."""
    return mix.join(loss, key)


def mixture_loss_gaps(mix: DataFrame, loss: DataFrame, key: str = "index") -> DataFrame:
    """Indexes present on one side only."""
    left, right = mix.select(key).distinct(), loss.select(key).distinct()
    no_loss = left.join(right, key, "left_anti").withColumn("missing", F.lit("loss"))
    no_mixture = right.join(left, key, "left_anti").withColumn("missing", F.lit("mixture"))
    return no_loss.unionByName(no_mixture)


def validation_loss(
    batches: DataFrame, eval_iters: int = EVAL_ITERS, by: Sequence[str] = ("run", "step", "domain")
) -> DataFrame:
    """Mean loss and perplexity over the first ``eval_iters`` batches."""
    used = batches.where(F.col("batch") < eval_iters)
    means = used.groupBy(*by).agg(F.count(F.lit(1)).alias("n_batches"), F.avg("loss").alias("val_loss"))
    return means.withColumn("val_ppl", F.exp("val_loss"))


def masked_mean_loss(
    tokens: DataFrame,
    ignore: int = -100,
    denominator: str = "kept",
    by: Sequence[str] = ("run",),
    target: str = "target",
    loss: str = "nll",
) -> DataFrame:
    """Mean token loss; targets equal to ``ignore`` add nothing.

    ``denominator``: ``kept`` divides by the other tokens, ``all`` by every token (the chunked rule).
    """
    if denominator not in ("kept", "all"):
        raise ValueError("denominator must be 'kept' or 'all'")
    kept = F.col(target) != ignore
    count = F.count_if(kept) if denominator == "kept" else F.count(F.lit(1))
    total = F.coalesce(F.sum(F.when(kept, F.col(loss))), F.lit(0.0))
    return tokens.groupBy(*by).agg(F.try_divide(total, count).alias("mean_loss"))
