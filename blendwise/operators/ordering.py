"""Row numbers and running totals per group that no single task has to hold.

A plain window puts a whole group into one task, so a group with a third of all rows would stall the job. Here
each group is cut into ordered buckets. Totals per bucket are small, their prefix sums give each bucket an
offset, and only rows of one bucket meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blendwise.session import durable

BUCKET = 65536


def id_bucket(column: Column) -> Column:
    """Bucket of a unique integer key: holds at most ``BUCKET`` rows and rises with the key."""
    return F.floor(column / BUCKET)


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on equally named columns in which NULL equals NULL, so no group is lost."""
    other = right.select([F.col(c).alias(f"_right_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(other[f"_right_{key}"])
    joined = left.join(other, condition, how)
    return joined.drop(*[f"_right_{key}" for key in keys]) if how in ("inner", "left") else joined


def running_total(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    value: Column | None = None,
    out: str = "before",
    bucket: Column | None = None,
) -> DataFrame:
    """Add the sum of ``value`` (default: one per row) over the earlier rows of the same group.

    ``group`` + ``order`` must be unique. ``bucket`` is a deterministic expression that never falls as ``order``
    rises and holds a bounded number of rows (see ``id_bucket``). Without it rows are range-partitioned on the
    keys, which splits hot groups by their real distribution, and stored durably: range bounds come from a
    sample, so the partition numbers must be fixed before they are used twice.
    """
    group, order = list(group), list(order)
    value = F.lit(1).cast("long") if value is None else value
    placed = df.withColumn("__value", value)
    if bucket is None:
        ranged = placed.repartitionByRange(*[F.col(c) for c in (*group, *order)])
        placed = durable(ranged.withColumn("__bucket", F.spark_partition_id().cast("long")))
    else:
        placed = placed.withColumn("__bucket", bucket)
    whole = Window.unboundedPreceding
    # One key that is never NULL: NULL groups match themselves, and the join below finds rows already partitioned.
    key = F.struct(*group, "__bucket").alias("__place")
    within = Window.partitionBy("__place").orderBy(*order).rowsBetween(whole, -1)
    across = Window.partitionBy(*group or [F.lit(0)]).orderBy("__bucket").rowsBetween(whole, -1)
    totals = placed.groupBy(*group, "__bucket").agg(F.sum("__value").alias("__total"))
    offsets = totals.select(key, F.coalesce(F.sum("__total").over(across), F.lit(0)).alias("__offset"))
    local = placed.select(*df.columns, "__value", key)
    local = local.withColumn("__local", F.coalesce(F.sum("__value").over(within), F.lit(0)))
    joined = local.join(offsets, "__place")
    return joined.select(*df.columns, (F.col("__local") + F.col("__offset")).alias(out))


def number_rows(
    df: DataFrame, group: Sequence[str], order: Sequence[str], out: str = "seq", bucket: Column | None = None
) -> DataFrame:
    """Dense row numbers from 0 within each group."""
    return running_total(df, group, order, None, out, bucket)


def average_ranks(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Rank of ``value`` in its group from 1; equal values share the mean of their ranks.

    Counts per distinct value are summed before anything is ordered, so copies of one value cost one row.
    """
    by = list(by)
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_copies"))
    return join_same(df, ranks_of_counted(counts, by, value, out), [*by, value])


def ranks_of_counted(counts: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """The shared rank of each distinct value of a group, from a table with its number of ``_copies``."""
    before = running_total(counts, by, [value], F.col("_copies"), "_before")
    return before.select(*by, value, (F.col("_before") + (F.col("_copies") + 1) / 2).alias(out))


def with_tail_copies(df: DataFrame, number: str, span: int, bucket_size: int = BUCKET) -> tuple[DataFrame, Column]:
    """Prepare windows that look back ``span`` rows over a dense row number.

    Rows get a bucket ``_bucket``; the last ``span`` rows of each bucket are copied into the next one, so windows
    partitioned by (group, ``_bucket``) see all they need. The second result is true for rows that are no copies.
    """
    size = max(bucket_size, span)
    home = F.floor(F.col(number) / size)
    near_end = F.pmod(F.col(number), F.lit(size)) >= size - span
    places = F.when(near_end, F.array(home, home + 1)).otherwise(F.array(home))
    return df.withColumn("_bucket", F.explode(places)), F.col("_bucket") == home
