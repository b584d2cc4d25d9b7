"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blendwise.session import discard, durable, scratch

ROWS = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row.

    The optimizer merges projections; an array that is used inside a lambda would otherwise be rebuilt for each
    element.
    """
    return F.transform(F.array(value), body).getItem(0)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The same rows as a Parquet table in the shared folder: cuts lineage, keeps column pruning."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Remove tables that ``stored`` wrote, once nothing reads them any more."""
    for df in tables:
        for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
            discard(df.sparkSession, folder)


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """Run a batch function in the tasks; ``make`` is called once per task, so that models load once.

    Batches are cut to ``ROWS`` rows, which bounds what a worker holds besides its model.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                yield work(batch.slice(at, ROWS))

    return df.mapInArrow(run, schema)


def in_sample(key: Column, share: Column | float) -> Column:
    """True for about ``share`` of the keys, chosen by their hash: repeatable, and decided row by row."""
    share = share if isinstance(share, Column) else F.lit(float(share))
    return F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 20)) < share * (1 << 20)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the smallest node of its component.

    Nodes hook onto the neighbour with the smallest random priority and edges are contracted to the hooks, which
    about halves the nodes in each round or two whatever the shape, chains and hubs included. Only key tables move; the
    edges of each round are checkpointed, and the rows of a hub meet in a joinable, splittable side, never in one
    group. Null ends and loops are ignored; an empty input gives an empty result.
    """

    def tidy(pairs: DataFrame) -> DataFrame:
        pairs = pairs.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        return durable(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    def order(column: Column) -> Column:
        return F.struct(F.xxhash64(column).alias("p"), column.alias("node"))

    current, hooks = tidy(edges.select("a", "b")), []
    while not current.isEmpty():
        both = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(order(F.col("b"))).alias("best"))
        hook = best.select(F.col("a").alias("node"), F.least(F.col("best"), order(F.col("a")))["node"].alias("parent"))
        hooks.append(hook)
        left = hook.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        right = hook.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        moved = current.join(left, "a").join(right, "b")
        current = tidy(moved.select(F.col("pa").alias("a"), F.col("pb").alias("b")))
    if not hooks:
        return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    label = hooks[0].select("node", F.col("parent").alias("top"))
    for hook in hooks[1:]:
        step = hook.select(F.col("node").alias("top"), F.col("parent").alias("next"))
        label = label.join(step, "top", "left").select("node", F.coalesce("next", "top").alias("top"))
    smallest = label.groupBy("top").agg(F.min("node").alias("root"))
    return label.join(smallest, "top").select("node", "root")
