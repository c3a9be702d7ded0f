"""Delimited, Parquet and file-listing sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from utterset.functions import paths
from utterset.functions.text import has_text
from utterset.operators.clean import ALIASES, first_column, resolve_aliases
from utterset.operators.joins import union_sources

# The labels a file name may carry, in natural order.
EMOTIONS = ("ANGRY", "DISGUST", "FEAR", "HAPPY", "NEUTRAL", "SAD", "SURPRISE")


def read_positional_tsv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Headerless tab-separated lines; short lines are dropped, extra fields ignored."""
    fields = F.split("value", "\t")
    return (
        spark.read.text(path)
        .where(F.size(fields) >= len(columns))
        .select(*[fields[i].alias(c) for i, c in enumerate(columns)])
    )


def prefixed_path(root: str, utt: str = "utt_id", ext: str = ".flac") -> Column:
    """``root/<first two characters>/<utt><ext>``."""
    return F.concat(F.lit(root.rstrip("/") + "/"), F.substring(utt, 1, 2), F.lit("/"), F.col(utt), F.lit(ext))


def _delimited(spark: SparkSession, path: str, sep: str, quoted_newlines: bool) -> DataFrame:
    # files with line breaks inside quotes cannot be split between tasks
    return (
        spark.read.option("header", True).option("sep", sep).option("multiLine", quoted_newlines)
        .option("escape", '"').option("nullValue", "\0").option("emptyValue", "").csv(path)
    )


def read_header_tsv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Header TSV projected to the wanted columns that exist."""
    df = spark.read.option("header", True).option("sep", "\t").option("quote", "").csv(path)
    return df.select(*[c for c in columns if c in df.columns])


def read_tsv_union(spark: SparkSession, files: Sequence[str], columns: Sequence[str], key: str = "path") -> DataFrame:
    """Union of header TSVs, with ``priority`` = place in ``files``.

    Files without the key column are left out; other missing columns are null.
    """
    parts = []
    for rank, file in enumerate(files):
        one = read_header_tsv(spark, file, columns)
        if key in one.columns:
            parts.append(one.withColumn("priority", F.lit(rank)))
    if not parts:
        raise ValueError(f"no file has a {key!r} column")
    return union_sources(parts)


def read_labeled_csv(
    spark: SparkSession, path: str, required: Sequence[str], *, quoted_newlines: bool = False
) -> DataFrame:
    """Header CSV that must have the required columns."""
    df = _delimited(spark, path, ",", quoted_newlines)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks {missing}; columns: {df.columns}")
    return df


def read_parquet_audio(
    spark: SparkSession, root: str, globs: Sequence[str] = ("*.parquet",), *, dataset: str, language: str
) -> DataFrame:
    """Parquet rows with inline audio as manifest records plus ``audio_bytes``.

    Every file is read once even if several patterns match it.  The bytes stay
    in the table; nothing is unpacked to disk.
    """
    # one listing and one read: a file that several patterns match is one file
    either = globs[0] if len(globs) == 1 else "{" + ",".join(globs) + "}"
    seen = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", either).option("mergeSchema", True).parquet(root)
    )
    return parquet_records(seen, dataset=dataset, language=language)


def parquet_records(df: DataFrame, *, dataset: str, language: str) -> DataFrame:
    """Alias resolution and identity of inline-audio rows."""
    if first_column(df, ALIASES["audio"]) is None:
        raise ValueError(f"no audio column; columns: {df.columns}")
    named = resolve_aliases(df, ALIASES)
    inline, data = F.col("audio.path"), F.col("audio.bytes")
    fallback = F.concat(F.lit(dataset + ":"), F.sha2(F.coalesce(data, F.lit(b"")), 256))
    row_id = paths.derive_id(F.col("id"), inline, fallback)
    return named.where(data.isNotNull() | (F.coalesce(inline, F.lit("")) != "")).select(
        F.when(data.isNotNull(), F.concat(row_id, paths.extension(inline))).otherwise(inline).alias("audio_filepath"),
        F.col("text").cast("string").alias("text"),
        F.lit(None).cast("double").alias("duration"),
        F.lit(None).cast("int").alias("sample_rate"),
        F.lit(dataset).alias("dataset"),
        row_id.alias("id"),
        F.col("speaker_id").cast("string").alias("speaker_id"),
        F.lit(language).alias("language"),
        data.alias("audio_bytes"),
    )


def list_files(spark: SparkSession, root: str, extensions: Sequence[str] = ()) -> DataFrame:
    """Path, length and time of every file below ``root``; contents stay unread."""
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        .select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length", "modificationTime")
    )
    if extensions:
        found = found.where(F.lower(paths.suffix(F.col("path"))).isin(*[e.lower() for e in extensions]))
    return found


def parse_labeled_names(df: DataFrame, path: str = "path") -> DataFrame:
    """Gender, speaker and emotion tokens of names like ``F_02_NAME_S_1_SAD_1.wav``."""
    tokens = F.split(F.upper(paths.stem(F.col(path))), "_")
    emotion = F.get(F.filter(tokens, lambda t: t.isin(*EMOTIONS)), F.lit(0))
    first = F.get(tokens, F.lit(0))
    return (
        df.withColumn("_tokens", tokens)
        .withColumn("emotion", emotion)
        .where(F.col("emotion").isNotNull() & (F.size("_tokens") >= 2))
        .withColumn("gender", F.when(first.isin("M", "F"), first))
        .withColumn("speaker", F.concat_ws("_", F.get("_tokens", F.lit(0)), F.get("_tokens", F.lit(1))))
        .drop("_tokens")
    )


def read_labeled_clips(spark: SparkSession, metadata: str, clips: DataFrame, *, root: str, label: str) -> DataFrame:
    """Clips with speaker and label from a metadata TSV, existing files only."""
    df = spark.read.option("header", True).option("sep", "\t").option("quote", "").csv(metadata)
    missing = [c for c in ("path", "client_id", label) if c not in df.columns]
    if missing:
        raise ValueError(f"{metadata} lacks {missing}")
    text = F.coalesce(F.col("sentence"), F.lit("")) if "sentence" in df.columns else F.lit("")
    rows = df.select(
        F.concat(F.lit(root.rstrip("/") + "/"), "path").alias("path"),
        paths.stem(F.col("path")).alias("id"),
        F.trim("client_id").alias("speaker"),
        F.trim(label).alias(label),
        text.alias("text"),
    )
    usable = rows.where(has_text(F.col("speaker")) & has_text(F.col(label)))
    return usable.join(clips.select("path"), "path", "left_semi")
