"""All queries and their SQL counterparts."""

from __future__ import annotations

import importlib

MODULES = (
    "corpus_queries",
    "mixture_queries",
    "sampling_queries",
    "history_queries",
    "regression_queries",
    "streaming_queries",
)


def collect() -> tuple[dict, dict]:
    queries, oracles = {}, {}
    for name in MODULES:
        module = importlib.import_module(f"blendwise.plans.{name}")
        queries.update(module.QUERIES)
        oracles.update(module.ORACLES)
    return queries, oracles
