"""Corpus joins: metadata, existence, unions and counts."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attach_metadata(
    files: DataFrame, meta: DataFrame, key: str, columns: Sequence[str], priority: Sequence[Column | str]
) -> DataFrame:
    """Every file with its metadata; the first metadata row per key wins.

    The winner is a minimum over (priority, columns), so partial aggregation
    shrinks repeated keys before the shuffle.
    """
    order = F.struct(*[F.col(p) if isinstance(p, str) else p for p in priority])
    winner = meta.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.min_by(F.struct(*columns), order).alias("_m")
    )
    return files.join(winner, key, "left").select(
        *files.columns, *[F.col("_m")[c].alias(c) for c in columns]
    )


def keep_existing(df: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """Rows whose file is in the inventory."""
    return df.join(files.select(key), key, "left_semi")


def existing_with_extension(
    df: DataFrame, files: DataFrame, *, stem: str, extensions: Sequence[str] = ("", ".wav", ".mp3", ".flac")
) -> DataFrame:
    """Rows with the first candidate ``stem + extension`` that exists, as ``path``."""
    options = F.explode(
        F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(e).alias("ext")) for i, e in enumerate(extensions)])
    )
    wanted = df.select(stem).distinct().select(stem, options.alias("o"))
    candidates = wanted.select(stem, F.col("o.rank").alias("rank"), F.concat(F.col(stem), "o.ext").alias("path"))
    found = (
        candidates.join(files.select("path").distinct(), "path")
        .groupBy(stem)
        .agg(F.min_by("path", "rank").alias("path"))
    )
    return df.join(found, stem)


def union_sources(parts: Iterable[DataFrame]) -> DataFrame:
    """All records of all sources."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def corpus_counts(df: DataFrame, *, dataset: str = "dataset", speaker: str = "speaker_id") -> DataFrame:
    """Rows and distinct speakers of each source."""
    return df.groupBy(dataset).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(speaker).alias("speakers")
    )


def label_histogram(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"))


def lookup(df: DataFrame, dim: DataFrame, key: str | Sequence[str], how: str = "left") -> DataFrame:
    """Join a small dimension; it is broadcast only if its real size allows."""
    from utterset.session import sized

    return df.join(sized(dim), key, how)
