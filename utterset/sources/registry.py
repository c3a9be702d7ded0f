"""Corpus layouts under one surface: ``SOURCES[name](spark, root)``.

Every adapter returns the manifest core.  A new corpus is one more function.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterset.functions import paths
from utterset.operators import joins
from utterset.schemas import as_manifest
from utterset.sources import tabular

Adapter = Callable[[SparkSession, str], DataFrame]

AUDIO_EXTENSIONS = paths.KNOWN_EXTENSIONS


def prefixed_tsv(spark: SparkSession, root: str, *, dataset: str, language: str) -> DataFrame:
    """``utt_spk_text.tsv`` + ``data/<2 chars>/<utt>.flac``."""
    rows = tabular.read_positional_tsv(spark, f"{root}/utt_spk_text.tsv", ["utt_id", "spk_id", "text"])
    placed = rows.withColumn("path", tabular.prefixed_path(f"{root}/data"))
    present = joins.keep_existing(placed, tabular.list_files(spark, f"{root}/data", [".flac"]))
    return as_manifest(
        present, audio_filepath="path", dataset=F.lit(dataset), id="utt_id", speaker_id="spk_id",
        language=F.lit(language),
    )


def clip_folder(
    spark: SparkSession, root: str, *, dataset: str, language: str,
    metadata: Sequence[str] = ("validated.tsv", "invalidated.tsv", "other.tsv"),
) -> DataFrame:
    """``clips/`` is authoritative; metadata tables attach text and speaker."""
    files = tabular.list_files(spark, f"{root}/clips").withColumn("name", paths.base_name(F.col("path")))
    meta = tabular.read_tsv_union(
        spark, [f"{root}/{m}" for m in metadata], ["path", "sentence", "client_id"]
    ).withColumnRenamed("path", "name")
    for column in ("sentence", "client_id"):
        if column not in meta.columns:
            meta = meta.withColumn(column, F.lit(None).cast("string"))
    joined = joins.attach_metadata(
        files, meta, "name", ["sentence", "client_id"], ["priority", "sentence", "client_id"]
    )
    return as_manifest(
        joined, audio_filepath="path", text="sentence", dataset=F.lit(dataset),
        id=paths.stem(F.col("name")), speaker_id="client_id", language=F.lit(language),
    )


def table_with_files(
    spark: SparkSession, root: str, *, dataset: str, language: str, table: str, folder: str,
    id_names: Sequence[str], text_names: Sequence[str], extensions: Sequence[str] = ("", ".wav", ".mp3", ".flac"),
) -> DataFrame:
    """A CSV of IDs and texts beside a folder of clips with unknown suffixes."""
    from utterset.operators.clean import resolve_aliases

    rows = tabular.read_labeled_csv(spark, f"{root}/{table}", [])
    named = resolve_aliases(rows, {"id": id_names, "sentence": text_names}, ["id", "sentence"])
    stems = named.withColumn("stem_path", F.concat(F.lit(f"{root}/{folder}/"), F.col("id").cast("string")))
    files = tabular.list_files(spark, f"{root}/{folder}")
    found = joins.existing_with_extension(stems, files, stem="stem_path", extensions=extensions)
    return as_manifest(
        found, audio_filepath="path", text="sentence", dataset=F.lit(dataset), id="id", language=F.lit(language)
    )


def extracted_with_cache(spark: SparkSession, root: str, *, dataset: str, language: str) -> DataFrame:
    """``extracted/`` clips left-joined to cached metadata by ID."""
    schema = "id string, text string, duration double, sample_rate int, speaker_id string"
    meta = spark.read.schema(schema).json(f"{root}/metadata.jsonl")
    files = tabular.list_files(spark, f"{root}/extracted", AUDIO_EXTENSIONS).withColumn(
        "id", paths.stem(F.col("path"))
    )
    latest = joins.attach_metadata(
        files, meta, "id", ["text", "duration", "sample_rate", "speaker_id"], ["text", "speaker_id"]
    )
    return as_manifest(latest, audio_filepath="path", dataset=F.lit(dataset), language=F.lit(language))


def inline_parquet(spark: SparkSession, root: str, *, dataset: str, language: str) -> DataFrame:
    return tabular.read_parquet_audio(spark, root, dataset=dataset, language=language).drop("audio_bytes")


def ready_manifest(spark: SparkSession, root: str, *, dataset: str, language: str) -> DataFrame:
    """A JSONL manifest, published or plain, under a new source name."""
    from utterset.sinks.published import resolve
    from utterset.sources.manifest import read_manifest

    return as_manifest(read_manifest(spark, resolve(spark, f"{root}/manifest.jsonl")), dataset=F.lit(dataset))


LAYOUTS: dict[str, Callable[..., DataFrame]] = {
    "prefixed_tsv": prefixed_tsv,
    "clip_folder": clip_folder,
    "table_with_files": table_with_files,
    "extracted_with_cache": extracted_with_cache,
    "inline_parquet": inline_parquet,
    "ready_manifest": ready_manifest,
}

SOURCES: dict[str, Adapter] = {}


def register(name: str, layout: str, *, language: str, **options) -> None:
    """Name a corpus: its layout, language and layout options."""
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout {layout!r}; known: {sorted(LAYOUTS)}")
    build = LAYOUTS[layout]
    SOURCES[name] = lambda spark, root: build(spark, root, dataset=name, language=language, **options)


def source(name: str) -> Adapter:
    if name not in SOURCES:
        raise ValueError(f"unknown source {name!r}; known: {sorted(SOURCES)}")
    return SOURCES[name]


# The corpora known by name.
register("openslr53", "prefixed_tsv", language="bn")
register("common_voice_bn", "clip_folder", language="bn")
register("regspeech12", "table_with_files", language="bn", table="train.csv", folder="train",
         id_names=("id", "file_name", "filename", "audio", "path"),
         text_names=("sentence", "text", "transcript", "transcription"))
register("bengaliai_speech", "table_with_files", language="bn", table="train.csv", folder="train_mp3s",
         id_names=("id",), text_names=("sentence",), extensions=(".mp3",))
register("indicvoices", "extracted_with_cache", language="bn")
for _name in ("subak_ko", "shrutilipi", "kathbath"):
    register(_name, "inline_parquet", language="bn")
