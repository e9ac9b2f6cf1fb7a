"""All queries over the given tables, by name, with their DuckDB forms."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MODULES = ("align", "admit", "clean", "correct", "summarise", "validate", "reports", "sources", "streams")


def query(oracle: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) under its name; oracle: DuckDB SQL for the same rows."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


for _name in MODULES:
    importlib.import_module(f"parley.plans.q_{_name}")
