"""Packing that can stop anywhere: a ledger of begun and finished shards.

Shards are written in waves.  A wave is entered as begun, its rows go to the folder
of its own attempt, and only then is it entered as finished.  Readers take
finished attempts alone, so a run that stops leaves nothing half-read; a resumed
run redoes the shards of the open wave under a new attempt and no others.  A
wave that was finished twice counts once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from utterset.streaming.features import contract_of, start_or_resume

LEDGER = "event string, shard string, attempt string"


class ShardLedger:
    """Entries (event, shard, attempt) below ``path``/ledger, only ever added to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def enter(self, event: str, shards: DataFrame, attempt: str) -> None:
        """One file per call, which its rename makes visible at once."""
        rows = shards.select(F.lit(event).alias("event"), "shard", F.lit(attempt).alias("attempt"))
        rows.coalesce(1).write.parquet(f"{self.path}/ledger/entry={attempt}-{event}")

    def entries(self) -> DataFrame:
        try:
            return self.spark.read.schema(LEDGER).parquet(f"{self.path}/ledger").select("event", "shard", "attempt")
        except Exception as exc:
            if "PATH_NOT_FOUND" not in str(exc):
                raise
            return self.spark.createDataFrame([], LEDGER)

    def finished(self) -> DataFrame:
        """(shard, attempt): the attempt that counts of each finished shard."""
        done = self.entries().where("event = 'finished'")
        return done.groupBy("shard").agg(F.min("attempt").alias("attempt"))

    def read(self) -> DataFrame:
        """Rows of the finished shards."""
        stored = self.spark.read.parquet(f"{self.path}/data")
        return stored.join(self.finished(), ["shard", "attempt"], "left_semi").drop("attempt")


def pack_shards(
    rows: DataFrame,
    path: str,
    *,
    settings: dict[str, str],
    waves: int,
    order: str,
    before_commit: Callable[[int], None] | None = None,
) -> tuple[ShardLedger, list[int]]:
    """Write ``rows`` shard by shard, or go on where an earlier call stopped; (ledger, waves written now).

    ``rows`` has ``shard`` and the column ``order`` that sorts a shard.  A run with
    other settings or other rows raises.  ``before_commit`` is called with a wave's
    number when its rows are stored and not yet entered as finished.
    """
    spark = rows.sparkSession
    ledger = ShardLedger(spark, path)
    start_or_resume(spark, contract_of(rows.select("shard", order), settings), f"{path}/contract")
    names = rows.select("shard").distinct()
    # one row per shard reaches this window
    planned = names.withColumn("wave", F.ntile(waves).over(Window.orderBy("shard")) - 1)
    open_ = planned.join(ledger.finished(), "shard", "left_anti").persist()
    written = []
    try:
        for wave in [r[0] for r in open_.select("wave").distinct().orderBy("wave").collect()]:
            active = open_.where(F.col("wave") == wave).select("shard")
            attempt = f"{wave:06d}-{uuid.uuid4().hex[:12]}"
            ledger.enter("begun", active, attempt)
            own = rows.join(active, "shard", "left_semi").repartition("shard").sortWithinPartitions("shard", order)
            own.withColumn("attempt", F.lit(attempt)).write.mode("append").partitionBy("attempt", "shard").parquet(f"{path}/data")
            if before_commit:
                before_commit(wave)
            ledger.enter("finished", active, attempt)
            written.append(wave)
    finally:
        open_.unpersist()
    return ledger, written
