"""Streams in several micro-batches give what a batch query gives."""

import datetime
import random

from pyspark.sql import functions as F

from blendwise.streaming import monitor


def events(spark, n=300):
    chance = random.Random(9)
    start = datetime.datetime(2024, 1, 1)
    rows = [(f"r{i % 3}", start + datetime.timedelta(minutes=37 * i), chance.random()) for i in range(n)]
    return spark.createDataFrame(rows, "run string, ts timestamp, loss double")


def by_window(df):
    return sorted((r.run, r.window_start, r.n_rows, round(r.mean_loss, 9), round(r.ppl, 9)) for r in df.collect())


def test_monitor_in_micro_batches(spark, tmp_path):
    rows = events(spark)
    rows.repartitionByRange(6, "ts").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for _ in range(2):  # the second start finds nothing new
        monitor.stream_monitor(source, out, state, delay="30 days").awaitTermination()
    assert by_window(monitor.read_monitor(spark, out)) == by_window(monitor.monitor_windows(rows))


def test_first_value_over_micro_batches(spark, tmp_path):
    rows = [("a", i, 5, float(i) if i >= 4 else None, float("nan") if i < 2 else -float(i)) for i in range(12)]
    rows += [("a", 20, 6, 1.0, 1.0), ("b", 0, 5, None, 3.0)]
    df = spark.createDataFrame(rows, "run string, seq long, step long, x double, y double")
    df.repartition(5, "seq").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    monitor.stream_losses(source, ["x", "y"], 5, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    found = monitor.read_losses(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, found.collect())) == [("a", "x", 4.0), ("a", "y", -2.0), ("b", "y", 3.0)]
    assert found.where(F.col("value").isNull()).count() == 0
