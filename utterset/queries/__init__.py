"""Named queries and, where SQL can say the same, their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from utterset.queries import corpus, listings, logs, packing, representation, statistics

MODULES = (corpus, packing, statistics, representation, logs, listings)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
