"""Run parameters of configs, and what a mixture asks of the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blendwise.operators.ordering import join_same

# Defaults of a training run, and the values written into synthesised configs.
RUN_DEFAULTS = {
    "model_name": "model_1B",
    "reset_embedding": False,
    "group_level_sampling": False,
    "only_save_model": False,
    "total_devices": 8,
    "num_of_devices": 8,
    "global_batch_size": 512,
    "learning_rate": 4e-4,
    "min_lr": 1e-5,
    "decay_lr": True,
    "micro_batch_size": 4,
    "max_step": 25000,
    "warmup_steps": 1000,
    "log_step_interval": 10,
    "eval_iters": 50,
    "save_step_interval": 1000,
    "eval_step_interval": 1000,
    "weight_decay": 0.1,
    "beta1": 0.9,
    "beta2": 0.95,
    "grad_clip": 1.0,
}
# A key without a default that a config may set.
OPTIONAL = ("data_seed",)
PROXY_PARAMS = {
    "seed": 42,
    "temperature": 0.5,
    "min_strength": 0.1,
    "max_strength": 5.0,
    "minimum": 0.0002,
    "sample_multiplier": 100,
    "maximum_usage": 15,
    "model_name": "proxy_1M",
    "total_devices": 1,
    "num_of_devices": 1,
    "global_batch_size": 512,
    "micro_batch_size": 16,
    "max_step": 1001,
    "save_step_interval": 2000,
    "eval_step_interval": 100,
    "learning_rate": 0.0004,
    "min_lr": 0.0004,
    "warmup_steps": 100,
}
# Fixed values of the proxy runs.
PROXY_STEPS, PROXY_BATCH, SEQUENCE = 1000, 512, 2048


def literal_map(values: dict) -> Column:
    """A map<string,string> column of plain values."""
    return F.create_map(*[F.lit(item) for name, value in values.items() for item in (name, str(value))])


def resolve_params(configs: DataFrame, defaults: dict = RUN_DEFAULTS, params: str = "params") -> DataFrame:
    """Defaults overridden by known keys, and the sizes that follow from them; no accumulation step is an error.

    Derived sizes use a config's own values only if it sets ``global_batch_size``; otherwise they stay those of
    the defaults.
    """
    known = F.array(*[F.lit(name) for name in (*defaults, *OPTIONAL)])
    given = F.coalesce(F.col(params), F.create_map().cast("map<string,string>"))
    overrides = F.map_filter(given, lambda key, value: F.array_contains(known, key))
    merged = F.map_concat(
        F.map_filter(literal_map(defaults), lambda key, value: ~F.array_contains(F.map_keys(overrides), key)),
        overrides,
    )
    resized = F.map_contains_key(given, "global_batch_size")
    rows = configs.withColumn("resolved", merged).withColumn("_basis", F.when(resized, merged).otherwise(literal_map(defaults)))

    def size(name: str) -> Column:
        return F.col("_basis")[name].cast("long")

    batch = F.floor(size("global_batch_size") / size("total_devices"))
    accumulation = F.floor(batch / size("micro_batch_size"))
    accumulation = F.when(accumulation > 0, accumulation).otherwise(
        F.raise_error(F.lit("a batch per device is smaller than a micro-batch")).cast("long")
    )
    return rows.select(
        *configs.columns,
        "resolved",
        batch.alias("batch_size"),
        accumulation.alias("gradient_accumulation_steps"),
        (size("warmup_steps") * accumulation).alias("warmup_iters"),
        (size("max_step") * accumulation).alias("max_iters"),
        (size("log_step_interval") * accumulation).alias("log_iter_interval"),
    )


def training_plan(
    mix: DataFrame,
    dist: DataFrame,
    steps: int = PROXY_STEPS,
    batch: int = PROXY_BATCH,
    sequence: int = SEQUENCE,
    cap: float = 15,
) -> DataFrame:
    """Sequences, tokens and epochs that each config takes from each domain, and whether that is over the cap."""
    joined = join_same(mix.select("index", "domain", "weight"), dist.select("domain", "n_tokens"), ["domain"], "left")
    sequences = F.col("weight") * steps * batch
    epochs = F.try_divide(sequences * sequence, F.col("n_tokens"))
    return joined.select(
        "index",
        "domain",
        "weight",
        sequences.alias("sequences"),
        (sequences * sequence).alias("tokens"),
        epochs.alias("epochs"),
        F.when(F.col("weight") > 0, F.coalesce(epochs > cap, F.lit(True))).otherwise(False).alias("over_cap"),
    )
