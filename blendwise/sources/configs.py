"""Mixture configs: one YAML document per config, named ``n<index>.yaml``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blendwise.functions.names import format_weight
from blendwise.sources.named_files import write_named_files

ENTRIES = "index long, split string, domain string, value string, params map<string,string>"


def read_mixture_configs(spark: SparkSession, folder: str, pattern: str = "*.yaml") -> DataFrame:
    """Rows (index, split, domain, value, params) of all configs of a folder; other files are skipped.

    The index is what is left of the file name after removing every ``n``; other names are an error. Values
    stay text: see ``clean_weights`` for turning them into weights.
    """
    files = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(folder, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1)
    number = F.replace(name, F.lit("n"), F.lit("")).try_cast("long")
    wrong = F.raise_error(F.concat(F.lit("config name is not n<index>: "), name)).cast("long")
    documents = files.select(F.coalesce(number, wrong).alias("index"), "value")
    return documents.mapInPandas(_parser(), ENTRIES)


def _parser():
    """The function for the tasks. Being nested it travels by value, so workers need not have this package."""

    def parse(frames):
        import yaml

        for frame in frames:
            rows = []
            for index, text in zip(frame["index"], frame["value"]):
                config = yaml.safe_load(text) or {}
                params = {str(k): str(v) for k, v in config.items() if k not in ("train", "valid")}
                for split in ("train", "valid"):
                    for domain, value in (config.get(split) or {}).items():
                        rows.append((index, split, str(domain), None if value is None else str(value), params))
            yield pd.DataFrame(rows, columns=["index", "split", "domain", "value", "params"])

    return parse


def render_configs(weights: DataFrame, params: dict | None = None, precision: int = 5) -> DataFrame:
    """One document per index from rows (index, domain, weight).

    The validation block lists every domain with weight 1.0. A document holds one line per domain.
    """
    line = F.concat(F.lit("  train_"), "domain", F.lit(": "), format_weight(F.col("weight"), precision))
    lines = F.sort_array(F.collect_list(F.struct("domain", line.alias("train"))))
    grouped = weights.groupBy("index").agg(lines.alias("_lines"))
    train = F.array_join(F.transform("_lines", lambda l: l["train"]), "\n")
    valid = F.array_join(F.transform("_lines", lambda l: F.concat(F.lit("  valid_"), l["domain"], F.lit(": 1.0"))), "\n")
    tail = "".join(f"\n{name}: {value}" for name, value in (params or {}).items())
    text = F.concat(F.lit("train:\n"), train, F.lit("\nvalid:\n"), valid, F.lit(tail))
    return grouped.select("index", text.alias("value"))


def write_mixture_configs(weights: DataFrame, folder: str, params: dict | None = None, precision: int = 5) -> None:
    """Write ``n<index>.yaml`` for every config; an existing file of that name with other content is an error."""
    # Many tiny files: the number of files counts, not their size, so all cores write.
    cores = weights.sparkSession.sparkContext.defaultParallelism
    spread = render_configs(weights, params, precision).repartition(cores, "index")
    named = F.concat(F.lit("n"), F.col("index").cast("string"), F.lit(".yaml"))
    write_named_files(spread.select(named.alias("name"), F.concat("value", F.lit("\n")).alias("value")), folder)
