"""Shared pieces of the named queries and their reference SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from utterset.functions import vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """Rows of a small fixture table over all slots, for costly work per row.

    The tables here are single files; tables of many files need no such exchange.
    """
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


def speaker_of(embedding: str = "embedding") -> Column:
    """Fixture speaker of a vector: argmax of its first ten coordinates."""
    return vectors.argmax(F.slice(embedding, 1, 10))


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", "embedding", speaker_of().alias("speaker")
    )


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round the given columns as the last step (adding 0.0 drops negative zero)."""
    return df.select(
        *[(F.round(c, digits) + F.lit(0.0)).alias(c) if c in columns else F.col(c) for c in df.columns]
    )


def sql_hash(seed: int, salt: str, *keys: str) -> str:
    parts = ", ".join(f"({k})::VARCHAR" for k in keys)
    return f"md5(concat_ws(':', '{seed}', '{salt}', {parts}))"


def sql_index(key: str, n: str) -> str:
    return f"((('0x' || substr({key}, 1, 8))::UBIGINT)::BIGINT % ({n}))"


SQL_UTTERANCES = """
utterances AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS embedding,
         (list_position(embedding[1:10], list_max(embedding[1:10])) - 1)::BIGINT AS speaker
  FROM embeddings)
"""


def sql_round(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0.0)"
