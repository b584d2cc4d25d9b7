"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``virtual_nodes`` points of the ring; a row belongs to the first point at or after its hash. A
shard takes at most its quota; rows beyond it continue clockwise to the next shard with room. Quotas are the row
count divided by the number of shards, rounded down or up, so that counts are at most one apart, while all rows
that fit stay with the owner of their arc and keep their place when shards come or go.

Only counts per arc (shards × virtual_nodes numbers, whatever the input) reach the driver. Ranks within an arc come
from hash ranges of about ``grain`` rows, so no task holds an arc.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blendwise.operators.ordering import number_rows
from blendwise.session import durable

LAW = "rows"


def ring_points(spark: SparkSession, shards: int, virtual_nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted points of the ring and the shard of each."""
    shard, replica = F.floor(F.col("id") / virtual_nodes), F.col("id") % virtual_nodes
    nodes = spark.range(shards * virtual_nodes).select(
        # A point depends on its shard and replica alone, so other shards' points stay when one comes or goes.
        F.xxhash64(F.lit("ring"), shard, replica).alias("point"), shard.cast("int").alias("shard")
    )
    rows = sorted(nodes.collect())  # bounded by the two parameters
    return np.array([r.point for r in rows]), np.array([r.shard for r in rows])


def overflow_plan(counts: Sequence[int], owners: Sequence[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Segments (arc, first rank, end rank, shard, first slot) that fill every shard exactly to its quota."""
    total = int(sum(counts))
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    segments, waiting, placed = [], [], [0] * len(counts)

    def place(arc: int, shard: int, n: int) -> None:
        segments.append((arc, placed[arc], placed[arc] + n, shard, used[shard]))
        placed[arc] += n
        used[shard] += n
        room[shard] -= n

    for arc, n in enumerate(counts):
        home = min(int(n), room[owners[arc]])
        if home:
            place(arc, int(owners[arc]), home)
    for step in range(2 * len(counts)):  # clockwise, at most twice round
        arc = step % len(counts)
        while waiting and room[owners[arc]]:
            source, n = waiting.pop(0)
            taken = min(n, room[owners[arc]])
            place(source, int(owners[arc]), taken)
            if n > taken:
                waiting.insert(0, (source, n - taken))
        if step < len(counts) and counts[arc] > placed[arc]:
            waiting.append((arc, int(counts[arc]) - placed[arc]))
    return segments


def shard_documents(
    docs: DataFrame,
    shards: int = 8,
    virtual_nodes: int = 128,
    grain: int = 50_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, and the columns in ``carry``.

    ``size`` is the UTF-8 length plus one (NULL text: 1), ``slot`` is gapless from 0 in each shard. Law ``rows``:
    counts differ by one at most; ``grown_shard`` is NULL. A document's place depends on its id, text and the
    counts alone. Repeated rows share a hash and take neighbouring slots; rows without id are placed by their
    text. An empty table gives an empty result. Carried columns keep their names; those named like a result are
    refused.
    """
    names = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    if set(carry) & set(names):
        raise ValueError(f"carried columns would hide results: {sorted(set(carry) & set(names))}")
    spark = docs.sparkSession
    points, owners = ring_points(spark, shards, virtual_nodes)

    @F.pandas_udf("int")
    def arc_of(point: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(points, point.to_numpy()) % len(points)).astype(np.int32))

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *[F.col(c).alias(f"_carry_{i}") for i, c in enumerate(carry)],
    ).withColumn("_point", F.xxhash64("doc_id", "text_crc32", "size"))
    rows = rows.withColumn("_arc", arc_of("_point"))
    if not carry:
        rows = durable(rows)  # a few numbers per row: the texts are read once
    found = {r["_arc"]: r["count"] for r in rows.groupBy("_arc").count().collect()}  # one row per arc
    counts = [found.get(a, 0) for a in range(len(points))]
    bins = max(1, sum(counts) // grain)
    plan = spark.createDataFrame(
        overflow_plan(counts, owners, shards) or [(-1, 0, 0, 0, 0)], "arc int, lo long, hi long, shard int, base long"
    )
    ranked = number_rows(
        rows, ["_arc"], ["_point", "doc_id", "text_crc32", "size"], "_rank", F.floor(F.col("_point") / (2.0**64 / bins))
    )
    here = (F.col("_arc") == F.col("arc")) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi"))
    # At most arcs × shards rows, whatever the input.
    placed = ranked.join(F.broadcast(plan), here)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        (F.col("base") + F.col("_rank") - F.col("lo")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *[F.col(f"_carry_{i}").alias(c) for i, c in enumerate(carry)],
    )


def write_shards(assigned: DataFrame, path: str) -> None:
    """Write carried rows as Parquet, one folder per shard; rows of a file are in slot order."""
    assigned.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
