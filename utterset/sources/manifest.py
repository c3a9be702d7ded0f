"""JSONL manifests: tolerant reading and the strict inventory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from utterset import violations as v
from utterset.functions import paths
from utterset.operators.clean import with_sample_id
from utterset.schemas import MANIFEST_SCHEMA
from utterset.session import sized

_TYPES = {"string": "string", "double": "double", "int": "int"}


def _lines(spark: SparkSession, sources: str | Sequence[str]) -> DataFrame:
    files = [sources] if isinstance(sources, str) else list(sources)
    return (
        spark.read.text(files)
        .select("value", F.col("_metadata.file_path").alias("manifest"))
        .where(F.trim("value") != "")
    )


def numbered_lines(spark: SparkSession, sources: str | Sequence[str]) -> DataFrame:
    """(value, manifest, line): every line with its number in its file, from 1, blank lines included.

    Large files are read in blocks by several tasks.  A block's lines follow each
    other in one task, so a line's place in the task less the block's first place is
    its place in the block; running totals of the blocks' line counts, one row per
    block, do the rest.  The text is read twice and never shuffled or sorted.
    """
    files = [sources] if isinstance(sources, str) else list(sources)
    read = spark.read.text(files).select(
        "value", F.col("_metadata.file_path").alias("manifest"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
    )
    blocks = read.groupBy("manifest", "block").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    before = Window.partitionBy("manifest").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(
        "manifest", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift")
    )
    return read.join(sized(starts), ["manifest", "block"]).select(
        "value", "manifest", (F.col("place") + F.col("shift")).alias("line")
    )


def read_manifest(spark: SparkSession, sources: str | Sequence[str]) -> DataFrame:
    """The manifest core, the whole row as VARIANT ``extra``, and its root.

    ``root`` is the folder of the file a row came from; relative paths are
    resolved against it (and its parent) by ``clean.resolve_paths``.
    """
    parsed = _lines(spark, sources).withColumn("extra", F.parse_json("value"))
    core = [
        F.try_variant_get("extra", f"$.{f.name}", _TYPES[f.dataType.simpleString()]).alias(f.name)
        for f in MANIFEST_SCHEMA.fields
    ]
    root = F.regexp_replace(F.regexp_replace("manifest", "^file:/+", "/"), "/[^/]*$", "")
    return parsed.select(*core, "extra", root.alias("root"))


def read_inventory(spark: SparkSession, source: str) -> tuple[DataFrame, DataFrame]:
    """(rows, violations) of one manifest under the strict rules.

    Broken JSON, non-objects, missing paths and non-standard numbers are named by
    file and line number (``path:line``) and carry the whole line; repeated identities
    by the identity.  Blank lines are counted and skipped.  A row without an ID is named by its whole content, unknown keys
    included, with the keys of every level in order.
    """
    lines = numbered_lines(spark, source).where(F.trim("value") != "").withColumn("extra", F.try_parse_json("value"))
    kind = F.schema_of_variant("extra")
    is_object = F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    # NaN and Infinity are no JSON numbers; only the lenient reader takes them
    lenient = F.from_json("value", "map<string,string>", {"allowNonNumericNumbers": "true"})
    odd_number = F.col("extra").isNull() & lenient.isNotNull()
    path = F.try_variant_get("extra", "$.audio_filepath", "string")
    key = F.concat_ws(":", "manifest", "line")
    checked = v.rules(
        lines.withColumn("_path", path),
        key,
        {
            "non_finite_number": (odd_number, F.col("value")),
            "invalid_json": (F.col("extra").isNull() & ~odd_number, F.col("value")),
            "not_an_object": (F.col("extra").isNotNull() & ~is_object, F.col("value")),
            "missing_path": (is_object & (F.coalesce("_path", F.lit("")) == ""), F.col("value")),
        },
    )
    good = lines.where(is_object & ~odd_number & (F.coalesce(path, F.lit("")) != ""))
    core = [
        F.try_variant_get("extra", f"$.{f.name}", _TYPES[f.dataType.simpleString()]).alias(f.name)
        for f in MANIFEST_SCHEMA.fields
    ]
    # variants keep the keys of an object sorted
    rows = with_sample_id(good.select(*core, F.to_json("extra").alias("_row")), whole="_row").drop("_row")
    repeated = v.duplicates(rows, "sample_id", "duplicate_sample")
    return rows, checked.unionByName(repeated)


def unsafe_paths(df: DataFrame, path: str = "audio_filepath") -> DataFrame:
    """Relative paths that leave their root or are empty."""
    return v.violation(
        df, "unsafe_path", ~paths.is_safe(F.col(path)), F.col(path), F.col(path)
    )
