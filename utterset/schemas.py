"""Column contracts shared by sources, sinks and operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The manifest core, in its documented order.
MANIFEST_COLUMNS = (
    "audio_filepath",
    "text",
    "duration",
    "sample_rate",
    "dataset",
    "id",
    "speaker_id",
    "language",
)

MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("audio_filepath", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("sample_rate", T.IntegerType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("speaker_id", T.StringType()),
        T.StructField("language", T.StringType()),
    ]
)

INDEX_SCHEMA = T.StructType(
    [
        T.StructField("sample_id", T.StringType()),
        T.StructField("shard", T.StringType()),
        T.StructField("flac_member", T.StringType()),
        T.StructField("json_member", T.StringType()),
        T.StructField("duration_seconds", T.DoubleType()),
        T.StructField("source_dataset", T.StringType()),
        T.StructField("frame_count", T.LongType()),
        T.StructField("encoded_byte_size", T.LongType()),
        T.StructField("amplitude_restore_gain", T.DoubleType()),
        T.StructField("canonical_peak", T.DoubleType()),
        T.StructField("storage_peak", T.DoubleType()),
    ]
)


def as_manifest(df: DataFrame, **given: Column | str | None) -> DataFrame:
    """Project to the manifest core; missing columns become nulls.

    ``given`` maps a core column to an expression (or a column name).
    """
    out = []
    for field in MANIFEST_SCHEMA.fields:
        if field.name in given:
            value = given[field.name]
            expr = F.lit(None) if value is None else F.col(value) if isinstance(value, str) else value
        elif field.name in df.columns:
            expr = F.col(field.name)
        else:
            expr = F.lit(None)
        out.append(expr.cast(field.dataType).alias(field.name))
    return df.select(*out)
