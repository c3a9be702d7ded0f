"""Sinks: manifests, build metadata, shards, predictions, statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterset import violations as v
from utterset.functions.hashing import order_key
from utterset.operators.reports import fingerprint
from utterset.schemas import INDEX_SCHEMA
from utterset.sinks.published import publish


def write_manifest(df: DataFrame, path: str) -> str:
    """JSON lines as a new version of ``path``, published whole or not at all; returns its folder.

    Readers take ``published.current_folder``; a failed write leaves the old manifest current.
    """
    def lines(rows: DataFrame, folder: str) -> None:
        rows.write.option("ignoreNullFields", "false").json(folder)

    return f"{path}/{publish(df, path, lines)}"


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One manifest per split value in ``split=<value>`` folders, one pass."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").partitionBy(split).json(path)


def build_meta(df: DataFrame, *, val_pct: float, seed: int, dataset: str = "dataset", split: str = "split") -> DataFrame:
    """(dataset, raw_count, train_rows, val_rows, val_pct, seed) per source."""
    return df.groupBy(dataset).agg(
        F.count(F.lit(1)).alias("raw_count"),
        F.count_if(F.col(split) == "train").alias("train_rows"),
        F.count_if(F.col(split) == "val").alias("val_rows"),
    ).withColumn("val_pct", F.lit(val_pct)).withColumn("seed", F.lit(seed))


def write_shards(df: DataFrame, path: str, *, key: str, seed: int) -> None:
    """Rows of a shard together in ``shard=<name>`` folders, in seeded order; payload is exchanged once."""
    ordered = df.withColumn("_h", order_key(seed, "permute", key)).repartition("shard").sortWithinPartitions("shard", "_h", key)
    ordered.drop("_h").write.mode("overwrite").partitionBy("shard").parquet(path)


def index_of(df: DataFrame) -> DataFrame:
    """The shard index: the same rows without their payload."""
    member = F.concat(F.lit("samples/"), F.sha2("sample_id", 256))
    ready = df.withColumn("flac_member", F.concat(member, F.lit(".flac"))).withColumn(
        "json_member", F.concat(member, F.lit(".json"))
    )
    return ready.select(
        *[
            (F.col(f.name) if f.name in ready.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in INDEX_SCHEMA.fields
        ]
    )


def write_predictions(df: DataFrame, path: str, identity: Sequence[str]) -> DataFrame:
    """Store predictions and return their row count and split fingerprint."""
    df.write.mode("overwrite").parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    return fingerprint(stored, identity)


def write_metadata_tsv(df: DataFrame, path: str, name: str = "file_name") -> None:
    """Header TSV with unique file names."""
    v.assert_empty(v.duplicates(df, name, "duplicate_file_name"))
    df.write.mode("overwrite").option("header", True).option("sep", "\t").option("quote", "").option(
        "emptyValue", "").csv(path)


def write_statistics(df: DataFrame, path: str, *, seed: int, replicates: int, confidence: float) -> None:
    """Long statistics rows with the settings that made them."""
    from utterset.operators.bootstrap import SCHEMA_VERSION

    df.withColumn("schema_version", F.lit(SCHEMA_VERSION)).withColumn("bootstrap_seed", F.lit(seed)).withColumn(
        "replicates", F.lit(replicates)
    ).withColumn("confidence", F.lit(confidence)).write.mode("overwrite").parquet(path)


def write_descriptor(descriptor: DataFrame, path: str) -> None:
    """The one-row descriptor as a JSON file."""
    descriptor.coalesce(1).write.mode("overwrite").json(path)


def pack_metadata(df: DataFrame, packed: Sequence[str]) -> DataFrame:
    """(sample_id, original, packed): source fields are never overwritten."""
    original = [c for c in df.columns if c not in packed]
    return df.select(
        "sample_id" if "sample_id" in df.columns else F.lit(None).alias("sample_id"),
        F.to_variant_object(F.struct(*original)).alias("original"),
        F.struct(*packed).alias("packed"),
    )
