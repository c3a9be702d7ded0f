"""Checks as tables: every broken rule is a row (rule, key, detail)."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class ContractError(ValueError):
    """Raised when a violations table is not empty."""


def violation(df: DataFrame, rule: str, when: Column, key: Column, detail: Column) -> DataFrame:
    """Rows of ``df`` that break one rule."""
    return df.where(when).select(
        F.lit(rule).alias("rule"),
        key.cast("string").alias("key"),
        detail.cast("string").alias("detail"),
    )


def rules(df: DataFrame, key: Column, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Evaluate many row rules ``{rule: (broken, detail)}`` in a single pass.

    The rules stay inside one generator: as a filter they would be pushed down
    and repeat the expressions of the checked columns many times over.
    """
    found = F.array(
        *[
            F.when(
                bad,
                F.struct(
                    F.lit(rule).alias("rule"),
                    key.cast("string").alias("key"),
                    detail.cast("string").alias("detail"),
                ),
            )
            for rule, (bad, detail) in checks.items()
        ]
    )
    return df.select(F.explode(found).alias("v")).where(F.col("v").isNotNull()).select("v.*")


def union_all(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def duplicates(df: DataFrame, key: str, rule: str = "duplicate") -> DataFrame:
    """One row per key that occurs more than once."""
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return violation(counted, rule, F.col("n") > 1, F.col(key), F.col("n"))


def examples(violations: DataFrame, k: int = 5) -> DataFrame:
    """The first ``k`` keys of every rule."""
    order = Window.partitionBy("rule").orderBy("key", "detail")
    return violations.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def assert_empty(violations: DataFrame, k: int = 5) -> None:
    """Raise with up to ``k`` examples per rule."""
    rows = examples(violations, k).orderBy("rule", "rank").collect()
    if rows:
        raise ContractError("; ".join(f"{r.rule}: {r.key} ({r.detail})" for r in rows))
