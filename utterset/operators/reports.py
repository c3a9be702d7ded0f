"""Coverage, status folding, scorecards and fingerprints."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utterset.functions import vectors
from utterset.functions.hashing import fingerprint_words

# The states that count as errors, and the skipped state.
ERROR_STATUSES = ("failed", "timed_out")
SKIPPED = "skipped"


def metric_coverage(df: DataFrame, *, expected: int, group: Sequence[str] = ()) -> DataFrame:
    """Attempted, succeeded and failed items, mean, and the strict gate.

    ``df``: (item_id, metric, value, error); a null or non-finite value failed.
    """
    good = vectors.is_finite(F.col("value"))
    out = df.groupBy(*group, "metric").agg(
        F.count(F.lit(1)).alias("attempted"),
        F.count_if(good).alias("succeeded"),
        F.count_if(~good).alias("failed"),
        F.avg(F.when(good, F.col("value"))).alias("mean"),
    )
    return out.withColumn(
        "strict_complete",
        (F.col("attempted") == expected) & (F.col("succeeded") == expected) & (F.col("failed") == 0),
    )


def failure_examples(df: DataFrame, k: int = 20) -> DataFrame:
    """The first ``k`` failures of each metric by item."""
    order = Window.partitionBy("metric").orderBy("item_id")
    failed = df.where(~vectors.is_finite(F.col("value")))
    message = F.coalesce(F.col("error"), F.concat(F.lit("non-finite value "), F.col("value").cast("string")))
    return (
        failed.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("metric", "item_id", "rank", message.alias("error"))
    )


def derive_status(statuses: DataFrame, expected: DataFrame, key: str = "condition") -> DataFrame:
    """Fold task states per condition; an expected condition without rows is missing."""
    folded = statuses.groupBy(key).agg(
        F.bool_or(F.col("status").isin(*ERROR_STATUSES)).alias("any_error"),
        F.bool_and(F.col("status") == SKIPPED).alias("all_skipped"),
    )
    state = (
        F.when(F.col("any_error").isNull(), "missing")
        .when(F.col("any_error"), "completed_with_errors")
        .when(F.col("all_skipped"), SKIPPED)
        .otherwise("completed")
    )
    return expected.select(key).distinct().join(folded, key, "left").select(key, state.alias("status"))


def extract_metrics(df: DataFrame, summary: str, paths: dict[str, str], gate: str | None = None) -> DataFrame:
    """Numbers at JSON paths of a VARIANT column; null unless the gate is true."""
    open_ = F.lit(True)
    if gate:
        open_ = F.coalesce(F.try_variant_get(summary, gate, "boolean"), F.lit(False))
    return df.select(
        *[c for c in df.columns if c != summary],
        *[F.when(open_, F.try_variant_get(summary, p, "double")).alias(n) for n, p in paths.items()],
    )


def scorecard(models: DataFrame, *results: DataFrame, key: str = "model") -> DataFrame:
    """Every model with the results it has (chain of left joins)."""
    return reduce(lambda left, right: left.join(right, key, "left"), results, models)


def fingerprint(df: DataFrame, columns: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Digest of a set of rows that does not depend on their order.

    Row digests are added word by word, which combines partially on every task;
    with unique rows two tables agree exactly when their row sets agree.
    """
    row = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    words = fingerprint_words(row)
    sums = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.sum(w).cast("decimal(38,0)").alias(f"_w{i}") for i, w in enumerate(words)],
    )
    text = F.concat_ws(":", "n_rows", *[F.col(f"_w{i}").cast("string") for i in range(4)])
    return sums.select(*group, "n_rows", F.sha2(text, 256).alias("fingerprint"))


def exposure_hours(
    df: DataFrame, *, steps: Column, batch: Column, accumulation: Column, world: Column, seconds: Column
) -> DataFrame:
    """Add hours of audio seen after ``steps`` optimizer steps."""
    return df.withColumn("exposure_hours", steps * batch * accumulation * world * seconds / F.lit(3600.0))


def unique_hours(df: DataFrame, duration: str = "duration") -> DataFrame:
    """One row: hours of distinct audio in a corpus."""
    return df.agg((F.sum(duration) / F.lit(3600.0)).alias("unique_hours"))
