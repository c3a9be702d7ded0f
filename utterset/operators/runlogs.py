"""Run logs in long form: merge, common steps, interval metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterset import violations as v
from utterset.plans.ordering import running_totals


def merge_rows(df: DataFrame, keys: Sequence[str] = ("run", "step", "key"), value: str = "value", seq: str = "seq") -> DataFrame:
    """Last written value of every (run, step, key)."""
    return df.groupBy(*keys).agg(F.max_by(value, seq).alias(value), F.max(seq).alias(seq))


def merge_rows_by_key(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(run, step, one column per metric): last value wins per column.

    ``df``: (run, step, seq, key, value).
    """
    last = [
        F.max_by(F.when(F.col("key") == m, F.col("value")), F.when(F.col("key") == m, F.col("seq"))).alias(m)
        for m in metrics
    ]
    return df.where(F.col("key").isin(*metrics)).groupBy("run", "step").agg(*last)


def complete_steps(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """(run, step) holding every required key."""
    return (
        df.where(F.col("key").isin(*required))
        .groupBy("run", "step")
        .agg(F.count_distinct("key").alias("k"))
        .where(F.col("k") == len(required))
        .drop("k")
    )


def common_steps(complete: DataFrame, runs: int) -> DataFrame:
    """Steps complete in all runs."""
    return (
        complete.groupBy("step").agg(F.count_distinct("run").alias("k")).where(F.col("k") == runs).select("step")
    )


def requested_violations(complete: DataFrame, requested: DataFrame, run_names: Sequence[str]) -> DataFrame:
    """Requested steps that a run lacks (rule, key = run, detail = step)."""
    wanted = requested.select("step", F.explode(F.array(*[F.lit(r) for r in run_names])).alias("run"))
    missing = wanted.join(complete, ["run", "step"], "left_anti")
    return v.violation(missing, "missing_step", F.lit(True), F.col("run"), F.col("step"))


def interval_of(step: Column, every: int) -> Column:
    """0-based reporting interval of a step."""
    return F.floor(step / F.lit(every)).cast("long")


def reduce_metrics(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """Mean (sum over count) and maximum of partial sums of all workers.

    ``df``: (group, total, count, peak).
    """
    return df.groupBy(*group).agg(
        (F.sum("total") / F.sum("count")).alias("mean"), F.sum("count").alias("count"), F.max("peak").alias("max")
    )


def interval_metrics(df: DataFrame, *, step: str, key: str, value: str, every: int) -> DataFrame:
    """Per interval and key: mean, max, count, and counts accumulated so far."""
    parts = df.groupBy(interval_of(F.col(step), every).alias("interval"), F.col(key).alias("key")).agg(
        F.sum(value).alias("total"), F.count(value).alias("count"), F.max(value).alias("peak")
    )
    means = reduce_metrics(parts, ["interval", "key"])
    return running_totals(means, ["key"], "interval", ["count"]).withColumnRenamed("cum_count", "count_so_far")
