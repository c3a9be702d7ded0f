"""Queries over run logs, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterset.operators import reports, runlogs
from utterset.queries.common import rounded, sql_round, table
from utterset.session import scratch_path
from utterset.streaming import logs, progress

METRICS = ("click", "view", "signup", "purchase", "error")


def event_log(spark: SparkSession, sf_dir: str, step_width: int = 4, runs: int = 1) -> DataFrame:
    """Events as metric rows (run, step, seq, key, value, ts)."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("run"), F.pmod("user_id", F.lit(runs)).cast("string")).alias("run"),
        F.floor(F.col("event_id") / step_width).alias("step"), F.col("event_id").alias("seq"),
        F.col("event_type").alias("key"), "value", F.col("ts").cast("timestamp").alias("ts"),
    )


def log_merge_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlogs.merge_rows_by_key(event_log(spark, sf_dir), METRICS)


SQL_LOG_MERGE = (
    "SELECT 'run0' AS run, event_id // 4 AS step, "
    + ", ".join(f"arg_max(value, event_id) FILTER (event_type = '{m}') AS \"{m}\"" for m in METRICS)
    + " FROM events GROUP BY event_id // 4"
)


def common_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps complete in all five runs, and the requested steps each run lacks."""
    log = event_log(spark, sf_dir, step_width=200, runs=5)
    required = ["click", "view", "signup"]
    complete = runlogs.complete_steps(log, required)
    steps = runlogs.common_steps(complete, 5).select(F.lit("common").alias("kind"), F.lit("all").alias("run"), F.col("step"))
    requested = log.select("step").distinct()
    missing = runlogs.requested_violations(complete, requested, [f"run{i}" for i in range(5)]).select(
        F.lit("missing").alias("kind"), F.col("key").alias("run"), F.col("detail").cast("long").alias("step")
    )
    return steps.unionByName(missing)


SQL_COMMON = """
WITH l AS (SELECT 'run' || user_id % 5 AS run, event_id // 200 AS step, event_type AS key FROM events),
c AS (SELECT run, step FROM l WHERE key IN ('click', 'view', 'signup') GROUP BY run, step HAVING count(DISTINCT key) = 3)
SELECT 'common' AS kind, 'all' AS run, step FROM c GROUP BY step HAVING count(DISTINCT run) = 5
UNION ALL
SELECT 'missing', run, step FROM (SELECT DISTINCT step FROM l), (SELECT 'run' || i AS run FROM range(5) r(i)) EXCEPT SELECT 'missing', run, step FROM c
"""


def interval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runlogs.interval_metrics(event_log(spark, sf_dir), step="step", key="key", value="value", every=50)
    return rounded(out, "mean")


SQL_INTERVAL = f"""
WITH g AS (SELECT event_id // 4 // 50 AS interval, event_type AS key, avg(value) AS mean, count(*) AS count, max(value) AS max FROM events GROUP BY ALL)
SELECT interval, key, {sql_round('mean')} AS mean, count, max, sum(count) OVER (PARTITION BY key ORDER BY interval)::BIGINT AS count_so_far FROM g
"""


def exposure_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours seen up to each step of the log, and passes over the corpus."""
    steps = table(spark, sf_dir, "events").select(F.col("event_id").alias("step"))
    out = reports.exposure_hours(
        steps, steps=F.col("step"), batch=F.lit(42), accumulation=F.lit(4), world=F.lit(1), seconds=F.lit(3.0)
    )
    corpus = table(spark, sf_dir, "documents").select((F.col("n_chars") / 100.0).alias("duration"))
    unique = reports.unique_hours(corpus).first()["unique_hours"]
    return rounded(out.withColumn("passes", F.col("exposure_hours") / F.lit(unique)), "exposure_hours", "passes")


SQL_EXPOSURE = f"""
WITH u AS (SELECT sum(n_chars / 100.0::DOUBLE) / 3600 AS h FROM documents)
SELECT event_id AS step, {sql_round('event_id * 42 * 4 * 3.0::DOUBLE / 3600')} AS exposure_hours,
       {sql_round('event_id * 42 * 4 * 3.0::DOUBLE / 3600 / h')} AS passes FROM events, u
"""


def stream_log_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written as files, read as a stream in several micro-batches, merged."""
    root = scratch_path(spark, "stream")
    event_log(spark, sf_dir, step_width=16, runs=3).repartition(6, "seq").write.json(f"{root}/in")
    stream = logs.read_log_stream(spark, f"{root}/in", files_per_batch=2)
    query = logs.start_merge(stream, f"{root}/merged", f"{root}/checkpoint")
    query.awaitTermination()
    return logs.read_merged(spark, f"{root}/merged")


SQL_STREAM_MERGE = """
SELECT 'run' || user_id % 3 AS run, event_id // 16 AS step, event_type AS key, arg_max(value, event_id) AS value FROM events GROUP BY ALL
"""

def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream over one file per event type: what the stored progress says of its batches."""
    root = scratch_path(spark, "progress")
    log = event_log(spark, sf_dir, step_width=16, runs=3)
    log.withColumn("kind", F.col("key")).repartition("kind").write.partitionBy("kind").json(f"{root}/in")
    seen = progress.ProgressTable(spark, f"{root}/progress")
    spark.streams.addListener(seen)
    try:
        query = logs.start_merge(
            logs.read_log_stream(spark, f"{root}/in/*", files_per_batch=1), f"{root}/merged", f"{root}/checkpoint"
        )
        query.awaitTermination()
        seen.wait(query)
    finally:
        spark.streams.removeListener(seen)
    stored = progress.read_progress(spark, f"{root}/progress", expected_rows=log.count()).where("rows > 0")
    return stored.agg(
        F.count(F.lit(1)).alias("batches"), F.sum("rows").alias("n"), F.max("total").alias("total"),
        F.min("eta_seconds").alias("last_eta"), F.count_if(F.col("rate") > 0).alias("rated"),
    )


SQL_STREAM_PROGRESS = """
SELECT count(DISTINCT event_type) AS batches, count(*) AS n, count(*) AS total, 0::DOUBLE AS last_eta, count(DISTINCT event_type) AS rated FROM events
"""

QUERIES = {
    "log_merge_last_wins": log_merge_last_wins,
    "common_steps": common_steps,
    "interval_metrics": interval_metrics,
    "exposure_hours": exposure_hours,
    "stream_log_merge": stream_log_merge,
    "stream_progress": stream_progress,
}

ORACLES = {
    "log_merge_last_wins": SQL_LOG_MERGE,
    "common_steps": SQL_COMMON,
    "interval_metrics": SQL_INTERVAL,
    "exposure_hours": SQL_EXPOSURE,
    "stream_log_merge": SQL_STREAM_MERGE,
    "stream_progress": SQL_STREAM_PROGRESS,
}
