"""The live monitor and the live loss collection, run to the end of the events they find."""

from __future__ import annotations

from pyspark.sql import functions as F

from blendwise.plans import views
from blendwise.plans.history_queries import METRICS, STEP
from blendwise.plans.views import HISTORY, r, rounded, with_ctes
from blendwise.session import scratch
from blendwise.streaming import monitor

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


WINDOWS = f"""SELECT user_id AS run, strftime(ts, '%Y-%m-%d') AS day, count(*)::BIGINT AS n_rows, {r('avg(ln(1e0 + value))')} AS mean_loss,
                     {r('exp(avg(ln(1e0 + value)))')} AS ppl, {r('count(*) / 86400')} AS rows_per_sec
              FROM events GROUP BY 1, 2"""


def event_stream(spark, folder):
    schema = views.table(spark, folder, "events").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/events.parque[t]")


def with_loss(events):
    at = F.col("ts").cast("timestamp").alias("ts")
    return events.select(F.col("user_id").alias("run"), at, F.log(1 + F.col("value")).alias("loss"))


def by_day(found):
    return found.select(
        "run",
        F.date_format("window_start", "yyyy-MM-dd").alias("day"),
        "n_rows",
        *[rounded(c).alias(c) for c in ("mean_loss", "ppl", "rows_per_sec")],
    )


@query("st1_stream_monitor", WINDOWS)
def stream_monitor(spark, folder):
    out, checkpoint = scratch(spark, "monitor"), scratch(spark, "monitor-state")
    monitor.stream_monitor(with_loss(event_stream(spark, folder)), out, checkpoint).awaitTermination()
    return by_day(monitor.read_monitor(spark, out))


@query("st1_batch_monitor", WINDOWS)
def batch_monitor(spark, folder):
    """The same windows without a stream."""
    return by_day(monitor.monitor_windows(with_loss(views.table(spark, folder, "events"))))


@query(
    "st2_stream_losses",
    with_ctes(
        " UNION ALL ".join(
            f"SELECT run, '{m}' AS metric, arg_min({m}, seq) AS value FROM history WHERE step = {STEP} AND {m} IS NOT NULL GROUP BY run"
            for m in METRICS
        ),
        HISTORY,
    ),
)
def stream_losses(spark, folder):
    """History rows arriving as files, some of them twice."""
    source, out, checkpoint = (scratch(spark, label) for label in ("arrivals", "losses", "losses-state"))
    rows = views.history(spark, folder)
    rows.write.parquet(source)
    rows.where(F.col("run") % 2 == 0).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(source)
    monitor.stream_losses(stream, METRICS, STEP, out, checkpoint).awaitTermination()
    return monitor.read_losses(spark, out)
