"""Speed and loss of running jobs, from one row per training iteration.

Rows are numbered from 0 per run without gaps (``iter``). Looking back a few rows never needs a whole run in one
task: runs are cut into buckets that carry copies of the rows before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blendwise.operators.ordering import id_bucket, number_rows, running_total, with_tail_copies

# Seconds per unit.
SECONDS = {"seconds": 1, "minutes": 60, "hours": 60 * 60, "days": 60 * 60 * 24}

# Peak operations per second by device and precision, from the makers' data sheets.
PEAK_FLOPS = {
    "h100-sxm": {
        "64-true": 67e12,
        "32-true": 67e12,
        "16-true": 989.5e12,
        "16-mixed": 989.5e12,
        "bf16-true": 989.5e12,
        "bf16-mixed": 989.5e12,
        "8-true": 1979e12,
        "8-mixed": 1979e12,
    },
    "h100-pcie": {
        "64-true": 51e12,
        "32-true": 51e12,
        "16-true": 756.5e12,
        "16-mixed": 756.5e12,
        "bf16-true": 756.5e12,
        "bf16-mixed": 756.5e12,
        "8-true": 1513e12,
        "8-mixed": 1513e12,
    },
    "a100": {
        "64-true": 19.5e12,
        "32-true": 19.5e12,
        "16-true": 312e12,
        "16-mixed": 312e12,
        "bf16-true": 312e12,
        "bf16-mixed": 312e12,
    },
    "a10g": {"32-true": 31.2e12, "16-true": 125e12, "16-mixed": 125e12, "bf16-true": 125e12, "bf16-mixed": 125e12},
    "v100-sxm": {"64-true": 7.8e12, "32-true": 15.7e12, "16-true": 125e12, "16-mixed": 125e12},
    "v100-pcie": {"64-true": 7e12, "32-true": 14e12, "16-true": 112e12, "16-mixed": 112e12},
    "v100s-pcie": {"64-true": 8.2e12, "32-true": 16.4e12, "16-true": 130e12, "16-mixed": 130e12},
    "t4": {"32-true": 8.1e12, "16-true": 65e12, "16-mixed": 65e12, "8-true": 130e12, "int4": 260e12},
    "quadro rtx 5000": {"32-true": 11.2e12, "16-true": 89.2e12, "16-mixed": 89.2e12},
}
# The same for every precision.
TPU_PEAK_FLOPS = {"v2": 45e12, "v3": 123e12, "v4": 275e12}

# Fixed values, in order: all of ``every`` and one of ``some`` in a lower-case device name give the class.
DEVICE_RULES = (
    (("h100", "hbm3"), (), "h100-sxm"),
    (("h100",), ("pcie", "hbm2e"), "h100-pcie"),
    (("a100",), (), "a100"),
    (("a10g",), (), "a10g"),
    (("v100-sxm",), (), "v100-sxm"),
    (("v100-pcie",), (), "v100-pcie"),
    (("t4",), (), "t4"),
    (("quadro rtx 5000",), (), "quadro rtx 5000"),
)


def device_class(name: Column) -> Column:
    low = F.lower(name)
    found = F.lit(None).cast("string")
    for every, some, label in reversed(DEVICE_RULES):
        hit = F.lit(True)
        for word in every:
            hit = hit & F.contains(low, F.lit(word))
        if some:
            hit = hit & F.greatest(*[F.contains(low, F.lit(word)) for word in some])
        found = F.when(hit, F.lit(label)).otherwise(found)
    return found


def peak_table(spark) -> DataFrame:
    rows = [(device, precision, peak) for device, by in PEAK_FLOPS.items() for precision, peak in by.items()]
    rows += [(device, None, peak) for device, peak in TPU_PEAK_FLOPS.items()]
    return spark.createDataFrame(rows, "device string, precision string, peak_flops double")


def with_peak_flops(df: DataFrame, device: str = "device_name", precision: str = "precision") -> DataFrame:
    """Add the device class and its peak; NULL where either is unknown. The table is a fixed small literal."""
    peaks = F.broadcast(
        peak_table(df.sparkSession).select(
            F.col("device").alias("_device"), F.col("precision").alias("_precision"), "peak_flops"
        )
    )
    is_tpu = F.lower(F.col(device)).isin(*TPU_PEAK_FLOPS)
    named = df.withColumn("device", F.when(is_tpu, F.lower(F.col(device))).otherwise(device_class(F.col(device))))
    wanted = F.when(~is_tpu, F.col(precision))
    match = (F.col("device") == F.col("_device")) & wanted.eqNullSafe(F.col("_precision"))
    return named.join(peaks, match, "left").drop("_device", "_precision")


def _looking_back(df: DataFrame, run: str, span: int):
    """Rows with their dense ``_place`` in the run, since ``iter`` may skip numbers or start anywhere."""
    placed = number_rows(df, [run], ["iter"], "_place", id_bucket(F.col("iter")))
    copied, own = with_tail_copies(placed, "_place", span)
    return copied, own, Window.partitionBy(run, "_bucket").orderBy("iter")


def throughput(df: DataFrame, window: int = 2, run: str = "run") -> DataFrame:
    """Batches, samples and tokens per second over the last ``window`` intervals, in total and per device.

    Needs ``iter, samples, lengths, elapsed, world_size``; NULL until the window is full.
    """
    copied, own, order = _looking_back(df, run, window)

    def moved(column: str) -> Column:
        return F.col(column) - F.lag(column, window).over(order)

    rows = copied.select(
        "*",
        moved("elapsed").alias("_seconds"),
        moved("samples").alias("_samples"),
        moved("lengths").alias("_tokens"),
    ).where(own)
    samples_per_sec = F.try_divide(F.col("_samples"), F.col("_seconds"))
    length = F.col("_tokens") / window
    rows = rows.select(
        "*",
        F.try_divide(F.lit(float(window)), F.col("_seconds")).alias("device_batches_per_sec"),
        samples_per_sec.alias("device_samples_per_sec"),
        (samples_per_sec * length).alias("device_tokens_per_sec"),
        (length * F.col("world_size") * F.col("samples")).alias("monitor_total_tokens"),
    )
    for name in ("batches_per_sec", "samples_per_sec", "tokens_per_sec"):
        rows = rows.withColumn(name, F.col(f"device_{name}") * F.col("world_size"))
    return rows.drop("_bucket", "_place", "_seconds", "_samples", "_tokens")


def rolling_train_loss(df: DataFrame, k: int, window: int = 2, run: str = "run") -> DataFrame:
    """Mean of the last ``k`` losses and its exponential; NULL in the first ``window`` rows of a run."""
    copied, own, order = _looking_back(df, run, max(k - 1, 1))
    mean = F.avg("loss").over(order.rowsBetween(-(k - 1), 0))
    rows = copied.withColumn("train_loss", F.when(F.col("_place") >= window, mean)).where(own).drop("_bucket", "_place")
    return rows.withColumn("train_ppl", F.exp("train_loss"))


def compute_rate(df: DataFrame, window: int = 2, run: str = "run") -> DataFrame:
    """Operations per second in the window without its first entry, per device, and share of ``peak_flops``."""
    copied, own, order = _looking_back(df, run, window)
    total = F.sum(F.col("flops") * F.col("world_size")).over(order.rowsBetween(-(window - 1), 0))
    seconds = F.col("elapsed") - F.lag("elapsed", window).over(order)
    rows = copied.withColumn("flops_per_sec", F.try_divide(total, seconds)).where(own).drop("_bucket", "_place")
    rows = rows.withColumn("device_flops_per_sec", F.col("flops_per_sec") / F.col("world_size"))
    return rows.withColumn("mfu", F.try_divide(F.col("device_flops_per_sec"), F.col("peak_flops")))


def time_totals(df: DataFrame, unit: str = "hours", run: str = "run") -> DataFrame:
    """Training time so far, validation time so far and their sum.

    Needs ``elapsed`` (since the start of training) and ``eval_seconds`` (validation before this row's log).
    """
    if unit not in SECONDS:
        raise ValueError(f"unit must be one of {sorted(SECONDS)}")
    own = F.coalesce("eval_seconds", F.lit(0.0))
    rows = running_total(df, [run], ["iter"], own, "_before", id_bucket(F.col("iter")))
    validated = F.col("_before") + own
    return rows.select(
        "*",
        (F.col("elapsed") / SECONDS[unit]).alias("time_train"),
        (validated / SECONDS[unit]).alias("time_val"),
        ((F.col("elapsed") + validated) / SECONDS[unit]).alias("time_total"),
    ).drop("_before")


def every_kth(df: DataFrame, k: int) -> DataFrame:
    """Every ``k``-th iteration, counted from 0."""
    return df.where(F.pmod(F.col("iter"), F.lit(k)) == 0)
