"""The order of training: shuffled files and blocks, draws by weight, batch numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blendwise.functions.draws import digest, uniform
from blendwise.operators.ordering import BUCKET, id_bucket, join_same, number_rows
from blendwise.operators.synthesis import attach_domains
from blendwise.operators.weights import normalize_weights

# Fixed value of the method.
DATA_SEED = 3406


def shuffle_rows(df: DataFrame, keys: Sequence[str], seed: int, out: str, by: Sequence[str] = ("domain",)) -> DataFrame:
    """Number the rows of each domain in an order given by a hash of their keys.

    Hashes are uniform, so their first hex digits cut every domain, hot ones too, into even buckets.
    """
    mixed = df.withColumn("_ticket", digest(seed, *[F.col(k) for k in keys]))
    bucket = F.substring("_ticket", 1, 4)
    return number_rows(mixed, by, ["_ticket", *keys], out, bucket).drop("_ticket")


def shuffle_shards(files: DataFrame, seed: int = DATA_SEED, path: str = "path") -> DataFrame:
    """Position of each file in its domain's shuffled list."""
    return shuffle_rows(files, [path], seed, "pos")


def assign_workers(files: DataFrame, workers: int, pos: str = "pos") -> DataFrame:
    """Deal the shuffled files of each domain to the workers in turn; files left over are not used."""
    counts = files.groupBy("domain").agg(F.count(F.lit(1)).alias("_files"))
    usable = F.floor(F.col("_files") / workers) * workers
    dealt = join_same(files, counts, ["domain"]).where(F.col(pos) < usable).drop("_files")
    return dealt.withColumn("worker", F.pmod(F.col(pos), F.lit(workers))).withColumn(
        "worker_pos", F.floor(F.col(pos) / workers)
    )


def shuffle_blocks(
    blocks: DataFrame, seed: int = DATA_SEED, n_chunks: int = 1, chunk_pos: str = "chunk_pos", shuffle: bool = True
) -> DataFrame:
    """Order of blocks within a buffer of ``n_chunks`` chunks; without ``shuffle`` they stay in order.

    A window holds one buffer, whose size is fixed by ``n_chunks``.
    """
    buffered = blocks.withColumn("buffer", F.floor(F.col(chunk_pos) / n_chunks))
    order = [chunk_pos, "block_no"]
    if shuffle:
        ticket = digest(seed, F.col("domain"), F.col(chunk_pos), F.col("block_no"))
        buffered, order = buffered.withColumn("_ticket", ticket), ["_ticket", *order]
    place = F.row_number().over(Window.partitionBy("domain", "buffer").orderBy(*order)) - 1
    return buffered.withColumn("buffer_pos", place.cast("long")).drop("_ticket")


def drop_sparse_domains(weights: DataFrame, files: DataFrame, min_files: int, group: str | None = None) -> DataFrame:
    """Leave out domains with fewer than ``min_files`` files and normalise the rest.

    With ``group`` (validation), a whole group goes as soon as one member is short of files, and weights are
    normalised within each group.
    """
    counts = files.groupBy("domain").agg(F.count(F.lit(1)).alias("n_files"))
    known = join_same(weights, counts, ["domain"], "left")
    known = known.withColumn("n_files", F.coalesce("n_files", F.lit(0).cast("long")))
    enough = F.col("n_files") >= min_files
    if group is None:
        return normalize_weights(known.where(enough), ())
    good = known.groupBy(group).agg(F.bool_and(enough).alias("_good")).where("_good").select(group)
    return normalize_weights(known.join(good, group, "left_semi"), [group])


def draw_domains(
    positions: DataFrame, weights: DataFrame, seed: int = DATA_SEED, key: str = "pos", level: int = 1
) -> DataFrame:
    """Pick a domain for each position: a uniform number falls into one interval of the cumulated weights.

    ``level`` positions share one draw (a whole micro-batch from one domain). Intervals travel as one array, of
    one entry per domain, in place of a range join.
    """
    whole = Window.partitionBy(F.lit(0))
    upto = F.sum("weight").over(whole.orderBy("domain").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("weight").over(whole)
    positive = weights.where("weight > 0")
    cut = positive.select("domain", (upto / total).alias("hi"))
    u = uniform(digest(seed, "draw", F.floor(F.col(key) / level)))
    placed = attach_domains(positions.withColumn("u", u), cut, "hi")
    hit = F.filter("_domains", lambda d: F.col("u") < d["hi"])
    # Cumulated weights may end just below 1; the last domain takes what is left.
    chosen = F.coalesce(F.get(hit, 0), F.element_at("_domains", -1))["domain"]
    return placed.withColumn("domain", chosen).drop("_domains")


def count_draws(positions: DataFrame, pos: str = "pos") -> DataFrame:
    """Add ``nth``: how often the domain was drawn before this position."""
    return number_rows(positions, ["domain"], [pos], "nth", id_bucket(F.col(pos)))


def mixture_sample(
    blocks: DataFrame, weights: DataFrame, n: int, seed: int = DATA_SEED, start: int = 0, level: int = 1
) -> DataFrame:
    """Rows for positions ``start`` … ``start + n``: each position draws a domain by weight and takes that
    domain's next block.

    ``blocks`` are numbered by (domain, block_seq) from 0. A domain that runs out starts over; ``epoch`` counts
    the rounds. Resuming at ``start`` gives the rows an uninterrupted run would have.
    """
    spark = blocks.sparkSession
    drawn = draw_domains(spark.range(0, start + n).withColumnRenamed("id", "pos"), weights, seed, "pos", level)
    if start:
        # Earlier positions only count: whole buckets before the first wanted one become per-domain offsets.
        first = start // BUCKET * BUCKET
        before = drawn.where(F.col("pos") < first).groupBy("domain").agg(F.count(F.lit(1)).alias("_earlier"))
        recent = count_draws(drawn.where(F.col("pos") >= first))
        drawn = join_same(recent, before, ["domain"], "left").where(F.col("pos") >= start)
        drawn = drawn.withColumn("nth", F.col("nth") + F.coalesce("_earlier", F.lit(0))).drop("_earlier")
    else:
        drawn = count_draws(drawn)
    sizes = blocks.groupBy("domain").agg(F.count(F.lit(1)).alias("available"))
    drawn = join_same(drawn, sizes, ["domain"], "left")
    nothing = F.raise_error(F.concat(F.lit("no blocks for domain "), F.col("domain"))).cast("long")
    drawn = drawn.withColumn("available", F.coalesce("available", nothing))
    drawn = drawn.withColumn("epoch", F.floor(F.col("nth") / F.col("available")))
    drawn = drawn.withColumn("block_seq", F.pmod("nth", "available"))
    return join_same(drawn, blocks, ["domain", "block_seq"])


def number_batches(draws: DataFrame, micro: int, accumulation: int, pos: str = "pos") -> DataFrame:
    """Micro-batch, place in it, optimizer step, and whether gradients are still being accumulated."""
    batch = F.floor(F.col(pos) / micro)
    return draws.select(
        "*",
        batch.alias("iter"),
        F.pmod(F.col(pos), F.lit(micro)).alias("row_in_batch"),
        F.floor(batch / accumulation).alias("step"),
        (F.pmod(batch + 1, F.lit(accumulation)) != 0).alias("is_accumulating"),
    )


def realized_mixture(draws: DataFrame, weights: DataFrame) -> DataFrame:
    """Drawn share against wanted share per domain, and rounds begun."""
    counts = draws.groupBy("domain").agg(F.count(F.lit(1)).alias("drawn"), (F.max("epoch") + 1).alias("epochs"))
    whole = Window.partitionBy(F.lit(0))
    joined = join_same(weights.groupBy("domain").agg(F.sum("weight").alias("weight")), counts, ["domain"], "left")
    joined = joined.withColumn("drawn", F.coalesce("drawn", F.lit(0).cast("long")))
    return joined.select(
        "domain",
        "drawn",
        F.coalesce("epochs", F.lit(0).cast("long")).alias("epochs"),
        (F.col("weight") / F.sum("weight").over(whole)).alias("target"),
        (F.col("drawn") / F.sum("drawn").over(whole)).alias("share"),
    )
