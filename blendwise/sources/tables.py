"""Wide CSV tables, run histories, packed chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_wide_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A mixture or loss table: ``index`` and one double per column.

    The header is read from one line, so the data are scanned once and never inferred.
    """
    if columns is None:
        columns = [c for c in spark.read.option("header", "true").csv(path).columns if c != "index"]
    schema = ", ".join(["`index` long", *[f"`{c}` double" for c in columns]])
    return spark.read.schema(schema).option("header", "true").option("enforceSchema", "false").csv(path)


def write_wide_csv(df: DataFrame, path: str) -> None:
    """Write with a header; files follow each other in index order."""
    others = [F.col(f"`{c}`") for c in df.columns if c != "index"]
    df.select("index", *others).orderBy("index").write.mode("overwrite").option("header", "true").csv(path)


def read_run_history(spark: SparkSession, path: str, schema: str | None = None, form: str = "parquet") -> DataFrame:
    """History rows of many runs; runs may log different metrics, so parquet schemas are merged."""
    reader = spark.read.schema(schema) if schema else spark.read
    if form == "json":
        return reader.json(path)
    return reader.option("mergeSchema", "true").parquet(path)


def write_metrics(df: DataFrame, path: str, key: str = "step") -> None:
    """Step-merged metrics as CSV in step order."""
    df.orderBy(key).write.mode("overwrite").option("header", "true").csv(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Packed chunks, one folder per split and domain.

    Rebalancing brings a domain's chunks together, so that not every task writes a file for every domain, and
    splits a hot domain over several writers.
    """
    chunks.hint("rebalance", "split", "domain").write.mode("overwrite").partitionBy("split", "domain").parquet(path)


def read_chunks(spark: SparkSession, path: str, domains: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """Chunks of the wanted domains; other folders are not read.

    A list prunes folders while planning, a table prunes them at run time if it is small enough to broadcast.
    """
    # Folder names stay as written: inferred types would turn 007 into 7.
    found = spark.read.parquet(path).schema
    names = {"split": "string", "domain": "string"}
    schema = ", ".join(f"`{f.name}` {names.get(f.name, f.dataType.simpleString())}" for f in found)
    chunks = spark.read.schema(schema).parquet(path)
    if domains is None:
        return chunks
    if isinstance(domains, DataFrame):
        return chunks.join(domains.select("domain"), "domain", "left_semi")
    return chunks.where(F.col("domain").isin(*domains))
