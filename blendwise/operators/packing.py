"""Documents laid end to end and cut into chunks of fixed length, and chunks into training blocks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from blendwise.operators.ordering import join_same
from blendwise.operators.tokens import token_slices
from blendwise.session import durable, written

# Fixed values of the method: a block is 2048 tokens plus the next one.
BLOCK_SIZE = 2049
TRAIN_CHUNK = 2049 * 256
VALID_CHUNK = 2049 * 64

FILE = ("domain", "shard")
TOKENS_HELD = 1 << 20  # that a task gathers before it hands chunks on
SMALL_INDEX = 1_000_000  # buckets up to which their starts are broadcast


def bucket_starts(sizes: DataFrame, group: Sequence[str]) -> DataFrame:
    """The upper level of the offset index: (group…, _bucket, _start) from one row per bucket and document."""
    totals = sizes.groupBy(*group, "_bucket").agg(F.sum("_n").alias("_total"))
    before = Window.partitionBy(*group or [F.lit(0)]).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_total").over(before), F.lit(0).cast("long"))  # one row per bucket
    return totals.select(*group, "_bucket", start.alias("_start"))


def _cutter(n_group: int, chunk_size: int, names: Sequence[str]):
    """Cut sorted rows (group…, _bucket, _start, tokens) at the chunk borders; the lower level is a running offset.

    What a bucket holds of a chunk becomes one row (group…, chunk_no, at, part, whole). Documents of a bucket lie end
    to end in a batch, so a batch is cut by slices, not document by document.
    """

    def run(batches):
        key, position, held, held_at = None, 0, [], 0
        rows, waiting = [], 0

        def close():
            """What is held belongs to the chunk that ends at or holds ``position``."""
            nonlocal held, waiting
            if held:
                part = pa.concat_arrays(held)
                number = (position - 1) // chunk_size
                rows.append((key[:n_group], number, held_at, part, len(part) == chunk_size))
                waiting += len(part)
                held = []

        def emitted():
            nonlocal rows, waiting
            ends = np.append(0, np.cumsum([len(r[3]) for r in rows])).astype(np.int32)
            columns = [pa.array([r[0][i] for r in rows], kinds[i]) for i in range(n_group)]
            columns += [pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())]
            columns += [pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays([r[3] for r in rows])), pa.array([r[4] for r in rows])]
            rows, waiting = [], 0
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in token_slices(batches, n_group + 2):
            kinds = [column.type for column in batch.columns[:n_group]]
            keys = list(zip(*[column.to_pylist() for column in batch.columns[: n_group + 2]]))
            lists = batch.column(n_group + 2)
            flat, ends = lists.values, lists.offsets.to_numpy()
            first = 0
            while first < len(keys):
                last = first + 1
                while last < len(keys) and keys[last] == keys[first]:
                    last += 1
                if keys[first] != key:
                    close()
                    key, position = keys[first], keys[first][-1]
                at, end = int(ends[first]), int(ends[last])
                while at < end:
                    if not held:
                        held_at = position % chunk_size
                    taken = min(end - at, chunk_size - position % chunk_size)
                    held.append(flat.slice(at, taken))
                    position, at = position + taken, at + taken
                    if position % chunk_size == 0:
                        close()
                first = last
            if waiting >= TOKENS_HELD:
                yield emitted()
        close()
        if rows:
            yield emitted()

    return run


def pack_chunks(
    docs: DataFrame,
    chunk_size: int = TRAIN_CHUNK,
    keep_tail: bool = False,
    pad=None,
    tokens: str = "tokens",
    group: Sequence[str] = FILE,
    order: Sequence[str] = ("doc_id",),
    bucket: Column | None = None,
) -> DataFrame:
    """Chunks (group…, chunk_no, tokens) of ``chunk_size`` tokens; a chunk never mixes two files.

    ``tokens`` is an array of any type, ids above all. ``bucket`` is as in ``running_total``; without it rows are
    range-partitioned first. Tokens are shuffled once, by file and bucket; the start of each bucket comes from one row
    per bucket, and chunks that lie inside a bucket leave its task whole. Only what stands at the borders of buckets is
    put together by a second, small shuffle. The unfinished last chunk is dropped, or kept and filled up with ``pad``.
    """
    group, order = list(group), list(order)
    length = F.coalesce(F.size(tokens), F.lit(0)).cast("long")
    rows = docs.select(*group, *order, tokens, length.alias("_n")).where("_n > 0")
    if bucket is None:
        rows = rows.repartitionByRange(*group, *order).withColumn("_bucket", F.spark_partition_id().cast("long"))
        rows = written(rows, "tokens")
    else:
        rows = written(rows, "tokens").withColumn("_bucket", bucket)
    starts = durable(bucket_starts(rows.select(*group, "_bucket", "_n"), group))
    small = starts.count() <= SMALL_INDEX
    placed = join_same(rows, F.broadcast(starts) if small else starts, [*group, "_bucket"])
    placed = placed.repartition(*group, "_bucket").sortWithinPartitions(*group, "_bucket", *order)
    names = [*group, "chunk_no", "at", "part", "whole"]
    kinds = [docs.schema[c].dataType for c in group] + [LongType(), LongType(), docs.schema[tokens].dataType, BooleanType()]
    schema = StructType([StructField(name, kind) for name, kind in zip(names, kinds)])
    cut = placed.select(*group, "_bucket", "_start", tokens).mapInArrow(_cutter(len(group), chunk_size, names), schema)
    whole = cut.where("whole").select(*group, "chunk_no", F.col("part").alias(tokens))
    borders = cut.where("NOT whole").groupBy(*group, "chunk_no").agg(F.sort_array(F.collect_list(F.struct("at", "part"))).alias("parts"))
    borders = borders.select(*group, "chunk_no", F.flatten(F.transform("parts", lambda p: p["part"])).alias(tokens))
    if not keep_tail:
        return whole.unionByName(borders.where(F.size(tokens) == chunk_size))
    filler = F.array_repeat(F.lit(pad), F.lit(chunk_size) - F.size(tokens)).cast(docs.schema[tokens].dataType)
    return whole.unionByName(borders.withColumn(tokens, F.concat(F.col(tokens), filler)))


def packing_report(lengths: DataFrame, chunk_size: int = TRAIN_CHUNK, group: Sequence[str] = FILE) -> DataFrame:
    """Chunks, kept and lost tokens per file, from token counts alone."""
    totals = lengths.groupBy(*group).agg(F.sum("n_tokens").alias("n_tokens"))
    chunks = F.floor(F.col("n_tokens") / chunk_size)
    return totals.withColumn("n_chunks", chunks).select(
        "*",
        (F.col("n_chunks") * chunk_size).alias("kept_tokens"),
        (F.col("n_tokens") - F.col("n_chunks") * chunk_size).alias("lost_tokens"),
    )


def slice_blocks(chunks: DataFrame, block_size: int = BLOCK_SIZE, tokens: str = "tokens") -> DataFrame:
    """Whole blocks of each chunk, numbered by ``block_no``; the rest of a chunk is dropped."""
    count = F.floor(F.size(tokens) / block_size).cast("int")
    numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1))
    blocks = chunks.withColumn("block_no", F.explode(numbers))
    return blocks.withColumn(tokens, F.slice(F.col(tokens), F.col("block_no") * block_size + 1, F.lit(block_size)))


def shift_targets(blocks: DataFrame, length: int, tokens: str = "tokens") -> DataFrame:
    """Inputs and next-token targets of each block."""
    return blocks.select(
        "*", F.slice(tokens, 1, length).alias("input_ids"), F.slice(tokens, 2, length).alias("targets")
    ).drop(tokens)
