"""Candidate mixtures around the natural distribution.

A candidate is one row with an array of weights in domain-name order. Drawing, bounding, cutting and rounding a
candidate therefore never shuffles; only de-duplication and the final choice do.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blendwise.functions.draws import digest, let, log_gamma_draw, uniform
from blendwise.operators.ordering import number_rows
from blendwise.operators.weights import MAXIMUM_USAGE, TEMPERATURE, normalize_weights, temper, usage_bounds
from blendwise.session import durable, written

# Fixed values of the method.
SEED = 42
MIN_STRENGTH = 0.1
MAX_STRENGTH = 5.0
STRENGTHS = 15
SAMPLE_MULTIPLIER = 100
MINIMUM = 2e-4
DUPLICATE_DISTANCE = 1e-5
CLOSE_BUCKET = 1024  # rows that one task compares with each other at most
# One candidate carries one weight per domain; a larger vector means the domain column is wrong.
MAX_DOMAINS = 100_000


def attach_domains(df: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """Add ``_domains``: a table with one row per domain as one array, sorted by domain.

    It is a scalar subquery, computed once and of checked length; drop the column before a shuffle.
    """
    packed = F.sort_array(F.collect_list(F.struct("domain", *columns)))
    checked = F.when(F.size(packed) <= MAX_DOMAINS, packed).otherwise(
        F.raise_error(F.lit(f"more than {MAX_DOMAINS} domains")).cast(_vector_type(table, columns))
    )
    return df.withColumn("_domains", table.groupBy().agg(checked.alias("vector")).scalar())


def _vector_type(table: DataFrame, columns: Sequence[str]) -> str:
    fields = ", ".join(f"{c}: {table.schema[c].dataType.simpleString()}" for c in ("domain", *columns))
    return f"array<struct<{fields}>>"


def strength_grid(lo: float = MIN_STRENGTH, hi: float = MAX_STRENGTH, n: int = STRENGTHS) -> list[float]:
    """Concentrations evenly spaced on a log scale, both ends included."""
    if lo == hi or n == 1:
        return [lo]
    low, high = math.log10(lo), math.log10(hi)
    return [10 ** (low + (high - low) * i / (n - 1)) for i in range(n)]


def pick_strength(samples: DataFrame, grid: list[float], seed: int = SEED) -> DataFrame:
    """Give each candidate one strength of the grid at random.

    Choosing first and drawing once has the same distribution as drawing at every strength and keeping one.
    """
    place = F.floor(uniform(digest(seed, "strength", F.col("sample_id"))) * len(grid)).cast("int")
    return samples.withColumn("strength", F.array(*[F.lit(float(s)) for s in grid])[place])


def dirichlet_sample(
    prior: DataFrame, n: int, seed: int = SEED, grid: list[float] | None = None, start: int = 0
) -> DataFrame:
    """``n`` Dirichlet draws with parameters prior × strength; strength 1 if no grid is given.

    Weights are rounded to 12 decimals, far below the grid, so that later cuts do not hang on the last bit.
    """
    spark = prior.sparkSession
    samples = spark.range(start, start + n).withColumnRenamed("id", "sample_id")
    samples = pick_strength(samples, grid, seed) if grid else samples.withColumn("strength", F.lit(1.0))
    samples = attach_domains(samples, prior, "prior")
    logs = F.transform(
        "_domains",
        lambda d: let(
            d["prior"] * F.col("strength"), lambda shape: log_gamma_draw(shape, seed, F.col("sample_id"), d["domain"])
        ),
    )
    parts = let(logs, lambda row: let(F.array_max(row), lambda top: F.transform(row, lambda v: F.exp(v - top))))
    weights = let(parts, lambda row: _normalized(row, 12))
    # A filter on the weights would otherwise be pushed below this projection and draw everything twice;
    # filters do not cross a generator.
    return samples.select("sample_id", "strength", F.explode(F.array(weights)).alias("weights"))


def _normalized(weights: Column, digits: int) -> Column:
    total = F.aggregate(weights, F.lit(0.0), lambda acc, w: acc + w)
    return let(total, lambda s: F.transform(weights, lambda w: F.round(w / s, digits)))


def reject_out_of_bounds(samples: DataFrame, bounds: DataFrame) -> DataFrame:
    """Keep candidates with every weight between 0 and its domain's bound."""
    inside = F.zip_with("weights", "_domains", lambda w, d: (w >= 0) & (w <= d["bound"]))
    return attach_domains(samples, bounds, "bound").where(F.forall(inside, lambda ok: ok)).drop("_domains")


def quantize(samples: DataFrame, minimum: float = MINIMUM) -> DataFrame:
    """Cut weights below ``minimum`` to zero, normalise, and round to multiples of ``minimum`` (half to even).

    ``units`` holds the multiples; the sum may leave 1 slightly.
    """
    cut = F.transform("weights", lambda w: F.when(w < minimum, F.lit(0.0)).otherwise(w))
    samples = samples.withColumn("weights", cut).withColumn("weights", _normalized(F.col("weights"), 12))
    units = F.transform("weights", lambda w: F.rint(w / minimum).cast("int"))
    samples = samples.withColumn("units", units)
    return samples.withColumn("weights", F.transform("units", lambda u: u * F.lit(float(minimum))))


def dedup_mixtures(samples: DataFrame) -> DataFrame:
    """Remove repeated candidates on the grid; the smallest ``sample_id`` stays.

    Two different grid rows are at least one grid step apart, far more than the near-duplicate distance, so
    dropping equal rows is the whole rule. Repeats are merged before the shuffle.
    """
    others = [c for c in samples.columns if c not in ("sample_id", "units")]
    first = F.min(F.struct("sample_id", *others)).alias("_first")
    return samples.groupBy("units").agg(first).select("_first.*", "units")


def _first_far(vectors: np.ndarray, start: int, vector: np.ndarray, threshold: float) -> int:
    """The first row from ``start`` on that is farther than the threshold, or the number of rows."""
    for begin in range(start, len(vectors), 64):
        far = np.abs(vectors[begin : begin + 64] - vector).sum(axis=1) > threshold
        if far.any():
            return begin + int(far.argmax())
    return len(vectors)


def _last_kept(vectors: np.ndarray, threshold: float) -> np.ndarray:
    """For each row, the last row of the bucket that is kept if this one is."""
    last = np.arange(len(vectors))
    for i in range(len(vectors) - 1, -1, -1):
        following = _first_far(vectors, i + 1, vectors[i], threshold)
        if following < len(vectors):
            last[i] = last[following]
    return last


def _vectors(frame: pd.DataFrame) -> np.ndarray:
    return np.stack([np.asarray(w) for w in frame["weights"]])


def dedup_close(samples: DataFrame, threshold: float = DUPLICATE_DISTANCE, bucket_size: int = CLOSE_BUCKET) -> DataFrame:
    """Near-duplicate removal for weights off the grid.

    Rows are ordered by the last domain first; a row goes if its L1 distance to the last kept row is at most
    ``threshold``. The rule is sequential, but a bucket of rows only needs to know the last row kept before it. So
    each bucket states the rows that can be its last kept one, and for each such row of the bucket before it which row
    it ends with: a map, and chaining the maps tells which rows really were the last. Maps are chained by doubling,
    in about log2(buckets) joins of the small table; then all buckets are marked at once. No task holds more than
    one bucket, however long a chain of near rows is.
    """
    equal = samples.groupBy("weights").agg(F.min("sample_id").alias("sample_id"))
    numbered = number_rows(equal.withColumn("_key", F.reverse("weights")), [], ["_key"], "_place")
    bucket = F.floor(F.col("_place") / bucket_size).alias("_bucket")
    rows = written(numbered.select(bucket, "_place", "sample_id", "weights"), "ordered")
    node = "_bucket long, _place long, weights array<double>"

    def ends(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_place", ignore_index=True)
        last = _last_kept(_vectors(frame), threshold)
        # The very first row is kept, so the first bucket has one end only.
        found = [last[0]] if frame["_bucket"][0] == 0 else np.unique(last)
        return frame.loc[found, ["_bucket", "_place", "weights"]]

    def moves(key, frame: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(frame):
            frame = frame.sort_values("_place", ignore_index=True)
            vectors = _vectors(frame)
            last = _last_kept(vectors, threshold)
            for place, weights in zip(entries["_place"], entries["weights"]):
                first = _first_far(vectors, 0, np.asarray(weights), threshold)
                passed = first == len(vectors)
                end = place if passed else frame["_place"][last[first]]
                out.append((key[0] - 1, place, key[0], end, weights if passed else None))
        return pd.DataFrame(out, columns=["b", "p", "nb", "np", "weights"])

    def entering(nodes: DataFrame) -> DataFrame:
        return nodes.select((F.col("_bucket") + 1).alias("_bucket"), "_place", "weights").groupBy("_bucket")

    by_bucket = rows.groupBy("_bucket")
    known = nodes = durable(by_bucket.applyInPandas(ends, node))
    steps = None
    while True:  # again only for rows to which a whole bucket is near
        cogrouped = by_bucket.cogroup(entering(nodes))
        found = durable(cogrouped.applyInPandas(moves, "b long, p long, nb long, np long, weights array<double>"))
        steps = found.drop("weights") if steps is None else steps.unionByName(found.drop("weights"))
        nodes = durable(found.where("weights IS NOT NULL").select(F.col("nb").alias("_bucket"), F.col("np").alias("_place"), "weights").distinct())
        if nodes.isEmpty():
            break
        known = known.unionByName(nodes)
    jumps = durable(steps.distinct())
    reached = known.where("_bucket = 0").select(F.col("_bucket").alias("b"), F.col("_place").alias("p"))
    while not jumps.isEmpty():
        farther = reached.join(jumps, ["b", "p"]).select(F.col("nb").alias("b"), F.col("np").alias("p"))
        reached = durable(reached.union(farther))
        onward = jumps.select(F.col("b").alias("nb"), F.col("p").alias("np"), F.col("nb").alias("eb"), F.col("np").alias("ep"))
        jumps = durable(jumps.join(onward, ["nb", "np"]).select("b", "p", F.col("eb").alias("nb"), F.col("ep").alias("np")))

    def mark(key, frame: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_place", ignore_index=True)
        kept = []
        if len(frame):
            vectors = _vectors(frame)
            i = _first_far(vectors, 0, np.asarray(entries["weights"][0]), threshold) if len(entries) else 0
            while i < len(vectors):
                kept.append(i)
                i = _first_far(vectors, i + 1, vectors[i], threshold)
        return frame.loc[kept, ["sample_id", "weights"]]

    real = known.distinct().join(reached.select(F.col("b").alias("_bucket"), F.col("p").alias("_place")), ["_bucket", "_place"])
    return by_bucket.cogroup(entering(real)).applyInPandas(mark, "sample_id long, weights array<double>")


def choose_configs(samples: DataFrame, num: int, seed: int = SEED) -> DataFrame:
    """Pick ``num`` candidates at random and number them from 1; too few candidates are an error."""
    ticket = digest(seed, "choose", F.col("sample_id"))
    # Stored and counted at once: a check inside a column could be pruned, and would see no row of an empty table.
    chosen = durable(samples.withColumn("_ticket", ticket).orderBy("_ticket", "sample_id").limit(num))
    found = chosen.count()
    if found < num:
        raise ValueError(f"{num} mixtures wanted, found {found}")
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_ticket", "sample_id")).cast("long")
    return chosen.withColumn("index", place).drop("_ticket")


def explode_samples(samples: DataFrame, domains: DataFrame, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Candidates as rows (keys…, domain, weight)."""
    pairs = F.zip_with(
        "_domains", "weights", lambda d, w: F.struct(d["domain"].alias("domain"), w.alias("weight"))
    )
    rows = attach_domains(samples, domains.select("domain")).select(*keys, F.explode(pairs).alias("_pair"))
    return rows.select(*keys, "_pair.domain", "_pair.weight")


def synthesize_mixtures(
    prior: DataFrame,
    num: int = 512,
    seed: int = SEED,
    temperature: float = TEMPERATURE,
    max_usage: float = MAXIMUM_USAGE,
    minimum: float = MINIMUM,
    multiplier: int = SAMPLE_MULTIPLIER,
    enable_bound: bool = True,
    grid: list[float] | None = None,
) -> DataFrame:
    """From the shares (domain, prior) to ``num`` configs as rows (index, domain, weight).

    Bounds come from the prior before smoothing; candidates are rejected before cutting and rounding.
    """
    # One row per domain, used three times below: stored, so that counting the corpus is not repeated.
    shares = durable(normalize_weights(prior.select("domain", F.col("prior").alias("weight")), ()))
    bounds = usage_bounds(shares, max_usage, "weight").select("domain", "bound")
    smooth = temper(shares, temperature, ()).select("domain", F.col("weight").alias("prior"))
    samples = dirichlet_sample(smooth, num * multiplier, seed, grid or strength_grid())
    if enable_bound:
        samples = reject_out_of_bounds(samples, bounds)
    samples = dedup_mixtures(quantize(samples, minimum))
    return explode_samples(choose_configs(samples, num, seed), shares, ("index",))
