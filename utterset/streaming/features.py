"""Incremental feature tables and contract-checked ingestion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from utterset import violations as v
from utterset.operators.reports import fingerprint

KEYS = ["item", "content_hash", "extractor"]


def content_hash(*columns: Column | str) -> Column:
    """Digest of what the features depend on; labels stay out of it."""
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]), 256)


def missing_items(items: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Items whose (item, content, extractor) has no features yet."""
    return items if stored is None else items.join(stored.select(*KEYS), KEYS, "left_anti")


def update_features(
    spark: SparkSession, items: DataFrame, path: str, extract: Callable[[DataFrame], DataFrame]
) -> int:
    """Extract and append features of new or changed items; returns their number.

    ``items``: (item, content_hash, extractor, ...); ``extract`` adds
    ``features``.  Stored rows are never rewritten; equal items are extracted once.
    """
    try:
        stored = spark.read.parquet(path)
    except Exception as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        stored = None
    fresh = extract(missing_items(items, stored).dropDuplicates(KEYS)).select(*KEYS, "features")
    fresh.write.mode("append").parquet(path)
    after = spark.read.parquet(path).count()
    return after - (stored.count() if stored is not None else 0)


def with_features(items: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Items with stored features; labels always come from ``items``."""
    return items.join(spark.read.parquet(path), KEYS)


def stream_features(
    stream: DataFrame, path: str, checkpoint: str, extract: Callable[[DataFrame], DataFrame]
) -> StreamingQuery:
    """``update_features`` for a stream of items, a folder per micro-batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            stored = spark.read.parquet(path).where(F.col("batch_id") != batch_id)
        except Exception as exc:
            if "PATH_NOT_FOUND" not in str(exc):
                raise
            stored = None
        fresh = extract(missing_items(batch.dropDuplicates(KEYS), stored)).select(*KEYS, "features")
        fresh.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


# -- start or resume --------------------------------------------------------


def contract_of(manifest: DataFrame, settings: dict[str, str]) -> DataFrame:
    """One row: the settings and the fingerprint of the manifest."""
    text = "|".join(f"{k}={settings[k]}" for k in sorted(settings))
    marked = fingerprint(manifest, sorted(manifest.columns))
    return marked.select(F.sha2(F.concat_ws("|", F.lit(text), "fingerprint"), 256).alias("contract"))


def start_or_resume(spark: SparkSession, contract: DataFrame, path: str) -> bool:
    """True when a run with this contract exists; a different contract raises."""
    mine = contract.first()["contract"]
    try:
        known = [r["contract"] for r in spark.read.parquet(path).select("contract").distinct().collect()]
    except Exception as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        contract.write.parquet(path)
        return False
    if known != [mine]:
        raise v.ContractError("the stored run was started with a different contract")
    return True
