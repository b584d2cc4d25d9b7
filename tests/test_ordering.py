"""Row numbers and running totals against brute force, with a group that holds most rows."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from blendwise.operators.ordering import average_ranks, id_bucket, number_rows, running_total, with_tail_copies


def brute(rows):
    seen, out = {}, {}
    for group, order, value in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1])):
        out[(group, order)] = seen.get(group, 0)
        seen[group] = seen.get(group, 0) + value
    return out


def skewed(n=3000):
    return [("hot" if i % 3 else f"g{i % 7}", (i * 7919) % n, i % 11) for i in range(n)]


@pytest.mark.parametrize("bucket", [None, "order"])
def test_running_total_with_hot_group(spark, bucket):
    rows = skewed()
    df = spark.createDataFrame(rows, "g string, o long, v long").repartition(4)
    cut = None if bucket is None else F.floor(F.col("o") / 100)
    found = running_total(df, ["g"], ["o"], F.col("v"), "before", cut)
    assert {(r.g, r.o): r.before for r in found.collect()} == brute(rows)


def test_hot_group_is_cut(spark):
    """The rows of one group are ranked by several tasks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(20000).select(F.lit("only").alias("g"), "id")
        ranged = df.repartitionByRange("g", "id").groupBy(F.spark_partition_id()).count()
        assert ranged.count() > 1
        assert number_rows(df, ["g"], ["id"]).where("seq != id").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_null_group_stays(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "g string, o long")
    found = {(r.g, r.o): r.seq for r in number_rows(df, ["g"], ["o"]).collect()}
    assert found == {(None, 1): 0, (None, 2): 1, ("a", 1): 0}


def test_number_rows_without_group(spark):
    df = spark.range(1000).select((F.col("id") * 3).alias("k"))
    assert number_rows(df, [], ["k"]).where("seq * 3 != k").count() == 0


def test_average_ranks_share_ties(spark):
    df = spark.createDataFrame([("t", v) for v in (5.0, 1.0, 5.0, 3.0)], "g string, v double")
    assert sorted((r.v, r.rank) for r in average_ranks(df, ["g"], "v", "rank").collect()) == [
        (1.0, 1.0), (3.0, 2.0), (5.0, 3.5), (5.0, 3.5)
    ]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 5), min_size=1, max_size=60), st.integers(1, 4))
def test_tail_copies_give_the_same_windows(spark, values, span):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "iter long, v long")
    copied, own = with_tail_copies(df, "iter", span, bucket_size=7)
    order = Window.partitionBy("_bucket").orderBy("iter")
    found = copied.withColumn("lagged", F.lag("v", span).over(order)).where(own).collect()
    assert len(found) == len(values)
    assert all(r.lagged == (values[r.iter - span] if r.iter >= span else None) for r in found)


def test_id_bucket_is_monotone(spark):
    buckets = [r.b for r in spark.range(0, 400000, 1000).select(id_bucket(F.col("id")).alias("b")).collect()]
    assert buckets == sorted(buckets) and len(set(buckets)) == 7
