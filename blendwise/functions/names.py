"""Names of files, domains and metrics, and the text form of weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from blendwise.functions.numbers import round_exact


def file_stem(path: Column) -> Column:
    """Base name up to its first dot."""
    return F.regexp_extract(path, r"([^/.]*)[^/]*$", 1)


def domain_of(path: Column) -> Column:
    """The part of a file name before ``-<shard number>``; without a number what stands before the first dash, and
    without a dash the whole stem, so that differently named files never fall into one group."""
    stem = file_stem(path)
    numbered = F.regexp_extract(stem, r"^(.+?)-(\d+)(?:_|$)", 1)
    return F.when(numbered != "", numbered).otherwise(F.regexp_extract(stem, r"^([^-]+|.*)", 1))


def shard_of(path: Column) -> Column:
    return F.regexp_extract(file_stem(path), r"^(.+?)-(\d+)(?:_|$)", 2).try_cast("int")


def dash_prefixes(name: Column) -> Column:
    """Every key ``k`` for which the name starts with ``k-``."""
    pieces = F.split(name, "-")
    ends = F.sequence(F.lit(1), F.size(pieces) - 1)
    keys = F.transform(ends, lambda end: F.array_join(F.slice(pieces, 1, end), "-"))
    return F.when(F.size(pieces) > 1, keys).otherwise(F.array().cast("array<string>"))


def short_domain(name: Column, corpus: str = "") -> Column:
    """Drop the split prefix, and the corpus prefix if one is given."""
    middle = f"(?:{corpus}_)?" if corpus else ""
    return F.regexp_replace(name, f"^(?:train_|valid_)?{middle}", "")


def metric_name(domain: Column, kind: str = "loss") -> Column:
    """Name under which the validation loss (or ``ppl``) of a domain is logged."""
    return F.concat(F.lit("metric/"), domain, F.lit(f"_val_{kind}"))


def format_weight(weight: Column, precision: int = 5) -> Column:
    """Fixed decimals without trailing zeros: 0, 1, 0.0002."""
    text = F.format_string(f"%.{precision}f", round_exact(weight, precision))
    if precision == 0:
        return text
    return F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))


def perplexity(loss: Column) -> Column:
    return F.exp(loss)
