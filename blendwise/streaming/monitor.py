"""Live versions of the monitor and of the loss collection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def monitor_windows(rows: DataFrame, window: str = "1 day", run: str = "run") -> DataFrame:
    """Rows, mean loss, perplexity and rate per run and time window; the same for batch and stream input."""
    found = rows.groupBy(F.window("ts", window).alias("w"), run).agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("loss").alias("mean_loss")
    )
    seconds = F.unix_timestamp(F.col("w.end")) - F.unix_timestamp(F.col("w.start"))
    return found.select(
        run,
        F.col("w.start").alias("window_start"),
        "n_rows",
        "mean_loss",
        F.exp("mean_loss").alias("ppl"),
        (F.col("n_rows") / seconds).alias("rows_per_sec"),
    )


def stream_monitor(stream: DataFrame, out: str, checkpoint: str, window: str = "1 day", delay: str = "2 days", run: str = "run"):
    """Start the live monitor. Windows that changed are written per micro-batch; the watermark bounds the state.

    A repeated micro-batch overwrites its own folder, so a restart adds nothing twice.
    """
    changed = monitor_windows(stream.withWatermark("ts", delay), window, run)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return _start(changed.writeStream.outputMode("update"), write, checkpoint)


def read_monitor(spark: SparkSession, out: str, run: str = "run") -> DataFrame:
    """The latest state of every window."""
    rows = spark.read.parquet(out)
    others = [c for c in rows.columns if c not in (run, "window_start", "batch")]
    latest = rows.groupBy(run, "window_start").agg(F.max_by(F.struct(*others), "batch").alias("_last"))
    return latest.select(run, "window_start", "_last.*")


def stream_losses(stream: DataFrame, metrics: Sequence[str], step: int, out: str, checkpoint: str, run: str = "run", order: str = "seq"):
    """Start the live collection of each run's first values at a step.

    A micro-batch is reduced to its own first value per run and metric; ``read_losses`` takes the first over all.
    No state is kept between micro-batches, so nothing grows with the length of the stream.
    """
    def write(batch: DataFrame, number: int) -> None:
        values = [F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").cast("double").alias("value")) for m in metrics]
        cells = batch.select(run, order, F.explode(F.array(*values)).alias("cell")).select(run, order, "cell.*")
        present = cells.where(F.col("value").isNotNull() & ~F.isnan("value"))
        first = present.groupBy(run, "metric").agg(F.min_by("value", order).alias("value"), F.min(order).alias(order))
        first.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return _start(stream.where(F.col("step") == step).writeStream, write, checkpoint)


def read_losses(spark: SparkSession, out: str, run: str = "run", order: str = "seq") -> DataFrame:
    """First value per run and metric so far."""
    return spark.read.parquet(out).groupBy(run, "metric").agg(F.min_by("value", order).alias("value"))


def _start(writer, write, checkpoint: str):
    return writer.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
