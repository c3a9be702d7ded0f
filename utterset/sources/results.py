"""Evaluator summaries, run logs, descriptors and trial tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterset.operators.bootstrap import task_kind

# Where a summary may keep its records, in order of precedence.
RECORD_KEYS = {
    "reconstruction": ("per_item", "per_item_artifact", "items_artifact", "artifact"),
    "asr": ("predictions", "predictions_descriptor", "predictions_artifact", "artifact"),
    "classification": ("predictions", "predictions_descriptor", "predictions_artifact", "artifact"),
    "verification": ("trials", "trials_artifact", "predictions_artifact", "artifact"),
}
NESTED_KEYS = ("predictions", "oof_predictions", "test_predictions")
ARTIFACT_KEYS = ("records", "per_item", "predictions", "trials")


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """One summary file as one VARIANT row."""
    return spark.read.option("wholetext", True).text(path).select(F.parse_json("value").alias("v"))


def _is_list(v, path: str):
    return F.coalesce(
        F.schema_of_variant(F.try_variant_get(v, path, "variant")).startswith("ARRAY"), F.lit(False)
    )


def record_location(spark: SparkSession, path: str, task: str) -> tuple[str, str]:
    """('inline', JSON path) or ('file', artifact path) of the task's records."""
    kind = task_kind(task)
    summary = read_summary(spark, path)
    boxes = (["$.dev"] if kind == "asr" else []) + ["$"]
    probes = []
    for box in boxes:
        for key in RECORD_KEYS[kind]:
            here = f"{box}.{key}"
            probes += [
                (F.when(_is_list("v", here), F.lit(here)), "inline"),
                (F.when(_is_list("v", f"{here}.records"), F.lit(f"{here}.records")), "inline"),
                (F.try_variant_get("v", f"{here}.path", "string"), "file"),
                (F.when(F.schema_of_variant(F.try_variant_get("v", here, "variant")) == "STRING",
                        F.try_variant_get("v", here, "string")), "file"),
            ]
    found = summary.select(
        F.coalesce(*[F.when(e.isNotNull(), F.struct(F.lit(kind_).alias("kind"), e.alias("at"))) for e, kind_ in probes]).alias("f")
    ).first()["f"]
    if found is not None:
        return found["kind"], found["at"]
    if kind == "classification":
        models = F.map_keys(F.try_variant_get("v", "$.results", "map<string,variant>"))
        names = summary.select(models.alias("m")).first()["m"] or []
        if len(names) == 1:
            for key in NESTED_KEYS:
                here = f"$.results['{names[0]}'].{key}"
                if summary.select(_is_list("v", here).alias("x")).first()["x"]:
                    return "inline", here
    raise ValueError(f"no {task} records in {path}")


def read_records(spark: SparkSession, path: str, task: str) -> DataFrame:
    """One VARIANT row per record, inline or from the artifact it points to."""
    kind, at = record_location(spark, path, task)
    if kind == "inline":
        box = read_summary(spark, path).select(F.try_variant_get("v", at, "variant").alias("v"))
        return _explode(spark, box)
    artifact = at if at.startswith("/") else f"{path.rsplit('/', 1)[0]}/{at}"
    if artifact.endswith(".parquet"):
        return spark.read.parquet(artifact).select(F.to_variant_object(F.struct("*")).alias("r"))
    if artifact.endswith(".jsonl"):
        lines = spark.read.text(artifact).where(F.trim("value") != "")
        return lines.select(F.parse_json("value").alias("r"))
    whole = read_summary(spark, artifact)
    lists = [F.when(_is_list("v", f"$.{k}"), F.try_variant_get("v", f"$.{k}", "variant")) for k in ARTIFACT_KEYS]
    root = F.when(F.schema_of_variant("v").startswith("ARRAY"), F.col("v"))
    return _explode(spark, whole.select(F.coalesce(root, *lists).alias("v")))


def _explode(spark: SparkSession, box: DataFrame) -> DataFrame:
    items = F.try_variant_get("v", "$", "array<variant>")
    return box.select(F.explode(items).alias("r"))


def _pick(*keys: str):
    return F.coalesce(*[F.try_variant_get("r", f"$.{k}", "string") for k in keys])


def load_entry(
    spark: SparkSession, path: str, *, task: str, system: str, order: int, seed: str
) -> DataFrame:
    """The records of one summary as a long table ready for the bootstrap."""
    kind = task_kind(task)
    records = read_records(spark, path, task)
    base = [F.lit(system).alias("system"), F.lit(order).alias("ord"), F.lit(str(seed)).alias("seed")]
    if kind == "reconstruction":
        metrics = F.try_variant_get("r", "$.metrics", "map<string,double>")
        return records.select(*base, _pick("item_id").alias("unit_id"), F.explode(metrics).alias("metric", "value"))
    if kind == "asr":
        return records.select(
            *base, _pick("item_id").alias("unit_id"), _pick("reference").alias("reference"),
            _pick("hypothesis").alias("hypothesis"),
        )
    if kind == "classification":
        return records.select(
            *base, _pick("item_id").alias("unit_id"), _pick("speaker_id").alias("speaker_id"),
            _pick("fold").alias("fold"), _pick("gold", "gold_label").alias("gold"),
            _pick("prediction", "predicted_label").alias("prediction"),
        )
    label = F.coalesce(
        F.try_variant_get("r", "$.label", "int"), F.try_variant_get("r", "$.target", "int"),
        F.try_variant_get("r", "$.label", "boolean").cast("int"), F.try_variant_get("r", "$.target", "boolean").cast("int"),
    )
    return records.select(
        *base, _pick("trial_id").alias("trial_id"), _pick("enroll_speaker_id").alias("spk_a"),
        _pick("test_speaker_id").alias("spk_b"), label.alias("label"),
        F.try_variant_get("r", "$.score", "double").alias("score"),
    )


def classification_score(spark: SparkSession, path: str) -> str:
    """``balanced_accuracy`` when the single model (or the summary) reports it."""
    models = F.map_values(F.try_variant_get("v", "$.results", "map<string,variant>"))
    here = F.try_variant_get("v", "$.balanced_accuracy", "variant").isNotNull()
    inner = F.try_variant_get(F.get(models, F.lit(0)), "$.balanced_accuracy", "variant").isNotNull()
    row = read_summary(spark, path).select(
        F.when(F.coalesce(F.size(models), F.lit(0)) == 1, inner).otherwise(here).alias("balanced")
    ).first()
    return "balanced_accuracy" if row["balanced"] else "accuracy"


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """Parquet trial table: one row per trial, so lengths cannot disagree."""
    need = ("trial_id", "label", "spk_a", "spk_b", "score")
    df = spark.read.parquet(path)
    missing = [c for c in need if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    return df.select(
        "trial_id", F.col("label").cast("int").alias("label"), "spk_a", "spk_b",
        F.col("score").cast("double").alias("score"),
    )


def read_metric_log(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Long metric rows (run, step, seq, key, value) of JSONL logs.

    ``seq`` grows with the line's place in its file.
    """
    files = [paths] if isinstance(paths, str) else list(paths)
    lines = spark.read.text(files).where(F.trim("value") != "").select(
        F.col("_metadata.file_path").alias("file"),
        # splits of a file are numbered in byte order, lines inside a split too
        F.struct(
            F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")
        ).alias("seq"),
        "value",
    )
    return log_rows(lines)


def log_rows(lines: DataFrame, *, file: str = "file") -> DataFrame:
    """Parse log lines (file, seq, value) into (run, step, seq, key, value)."""
    pairs = F.from_json("value", "map<string,string>")
    # the run folder: .../<run>/logs/train.jsonl or .../<run>/train.jsonl
    run = F.regexp_extract(file, r"([^/]+)/(?:logs/)?[^/]+$", 1)
    parsed = lines.select(run.alias("run"), "seq", pairs.alias("kv"))
    step = F.element_at("kv", "step").cast("long")
    return (
        parsed.select("run", step.alias("step"), "seq", F.explode("kv").alias("key", "value"))
        .where(F.col("key") != "step")
    )


def log_violations(lines: DataFrame) -> DataFrame:
    """Lines that are no JSON object or lack ``step``."""
    from utterset import violations as v

    pairs = F.from_json("value", "map<string,string>")
    step = F.try_element_at(pairs, F.lit("step"))
    return v.rules(
        lines,
        F.col("file"),
        {
            "invalid_json": (F.try_parse_json("value").isNull(), F.substring("value", 1, 80)),
            "missing_step": (F.try_parse_json("value").isNotNull() & step.isNull(), F.substring("value", 1, 80)),
        },
    )


_STATS = (
    "sample_count: bigint, frame_count: bigint, max_abs_error: double, sum_squared_error: double, sum_squared_signal: double"
)
_SCALING = "scaled_sample_count: bigint, max_restore_gain: double, max_canonical_peak: double"
DESCRIPTOR_SCHEMA = (
    "kind string, format_version int, sample_rate int, "
    "counts struct<samples: bigint, shards: bigint, total_duration_seconds: double, total_audio_payload_bytes: bigint>, "
    "shards array<struct<path: string, count: bigint, payload_bytes: bigint, duration_seconds: double, "
    f"stats: struct<{_STATS}, {_SCALING}>>>, "
    f"quantization struct<{_STATS}, rms_error: double, signal_rms: double, snr_db: double>, amplitude_scaling struct<{_SCALING}>"
)


def read_descriptor(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DESCRIPTOR_SCHEMA).option("multiLine", True).json(path)
