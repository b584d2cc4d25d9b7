"""Text corpora: JSON lines in files ``<split>/<domain>-<shard>.jsonl``."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blendwise.functions.names import domain_of, shard_of
from blendwise.session import durable


def split_files(spark: SparkSession, root: str, split: str, fraction: float = 1.0) -> list[str]:
    """The first files of a split in path order: floor(count × fraction). Spark lists them to plan the scan anyway."""
    found = sorted(spark.read.text(f"{root}/{split}").inputFiles())
    return found[: math.floor(len(found) * fraction)]


def read_corpus(
    spark: SparkSession, root: str, split: str = "train", fraction: float = 1.0, numbered: bool = False
) -> DataFrame:
    """Rows (split, domain, shard, path, text); large files are read by several tasks.

    ``numbered`` adds (block_start, row_id), the order of documents within a file, for packing. How files are cut
    can change with the number of executors, so numbered rows are stored and every later step sees the same ids.
    """
    paths = split_files(spark, root, split, fraction)
    if not paths:
        raise FileNotFoundError(f"no files of split {split} in {root}")
    path = F.col("_metadata.file_path")
    places = (F.col("_metadata.file_block_start").alias("block_start"), F.monotonically_increasing_id().alias("row_id"))
    lines = spark.read.schema("text string").json(paths)
    rows = lines.select(
        F.lit(split).alias("split"),
        domain_of(path).alias("domain"),
        shard_of(path).alias("shard"),
        path.alias("path"),
        *(places if numbered else ()),
        "text",
    )
    return durable(rows) if numbered else rows


def block_bucket() -> Column:
    """Bucket for orders over a corpus: one read block, of at most ``spark.sql.files.maxPartitionBytes``."""
    return F.col("block_start")
