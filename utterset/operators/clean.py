"""Column clean-up: aliases, nulls, duration filter, path resolution, identity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterset.functions import paths, text as tx, vectors
from utterset.functions.hashing import member_key, sample_id

# Accepted column names in order of preference.
ALIASES = {
    "audio": ("audio", "speech", "audio_filepath"),
    "text": ("text", "sentence", "transcript", "transcription"),
    "id": ("id", "file", "path", "utt_id"),
    "speaker_id": ("speaker_id", "speaker", "client_id"),
}
PREDICTION_ALIASES = {"gold": ("gold", "gold_label"), "prediction": ("prediction", "predicted_label")}

# Fixed values of the reversible amplitude scaling.
STORAGE_PEAK = 0.999
GAIN_CUSHION = 1.0e-6


def first_column(df: DataFrame, names: Sequence[str]) -> str | None:
    """The first of ``names`` the frame has."""
    return next((n for n in names if n in df.columns), None)


def resolve_aliases(df: DataFrame, spec: dict[str, Sequence[str]], required: Sequence[str] = ()) -> DataFrame:
    """Rename the first matching alias of every target; absent targets are null."""
    chosen = {target: first_column(df, names) for target, names in spec.items()}
    missing = [t for t in required if chosen.get(t) is None]
    if missing:
        raise ValueError(f"no column for {missing}; columns: {df.columns}")
    used = {c for c in chosen.values() if c}
    rest = [c for c in df.columns if c not in used and c not in chosen]
    return df.select(
        *[(F.col(c) if c else F.lit(None).cast("string")).alias(t) for t, c in chosen.items()], *rest
    )


def first_non_blank(*columns: str) -> Column:
    """Row-wise: the first value that is not null or blank."""
    return F.coalesce(*[F.when(tx.has_text(F.col(c).cast("string")), F.col(c).cast("string")) for c in columns])


def normalize_nulls(df: DataFrame, numbers: Sequence[str] = (), texts: Sequence[str] = ()) -> DataFrame:
    """NaN becomes null; a text keeps the difference between '' and null."""
    out = df
    for c in numbers:
        out = out.withColumn(c, F.when(~F.isnan(c), F.col(c)))
    for c in texts:
        out = out.withColumn(c, F.when(F.lower(F.col(c)) != "nan", F.col(c)))
    return out


def with_sample_id(df: DataFrame, *, dataset: str = "dataset", row_id: str = "id", whole: str | None = None) -> DataFrame:
    """Add ``sample_id``, ``source_dataset`` and ``member_key``.

    A row without ID is named by a digest of column ``whole``, or else of all its
    columns in sorted order.
    """
    canonical = F.col(whole) if whole else F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    name = F.coalesce(F.nullif(F.col(dataset).cast("string"), F.lit("")), F.lit("unknown"))
    out = df.withColumn("sample_id", sample_id(F.col(dataset), F.col(row_id), canonical))
    return out.withColumn("source_dataset", name).withColumn("member_key", member_key(F.col("sample_id")))


def filter_by_duration(
    df: DataFrame, max_seconds: float, *, actual: Column, declared: str = "duration", text: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(kept rows, one-row report): drop rows longer than ``max_seconds``.

    ``actual`` is the measured duration and replaces the declared one; a missing
    or non-positive declared value is counted as unknown.
    """
    usable = tx.has_text(F.col(text)) if text else F.lit(True)
    fits = actual <= max_seconds
    unknown = F.col(declared).isNull() | (F.col(declared) <= 0)
    kept = df.where(usable & fits).withColumn(declared, actual)
    report = df.agg(
        F.count_if(usable & fits).alias("kept"),
        F.count_if(usable & ~fits).alias("dropped"),
        F.count_if(usable & unknown).alias("unknown"),
        F.count_if(~usable).alias("missing_text"),
    )
    return kept, report


def duration_profile(df: DataFrame, duration: str = "duration", group: Sequence[str] = ()) -> DataFrame:
    """Nearest-rank percentiles, maximum and shares below the usual cuts.

    Distinct durations are counted first; the rank of a percentile is then found
    in two-level running counts, without a global sort of the rows.
    """
    from utterset.plans.ordering import beside, buckets_for, running_totals
    from utterset.session import sized

    group = list(group)
    quantiles = (5, 25, 50, 75, 95, 99)
    values = df.where(F.col(duration).isNotNull()).groupBy(*group, F.col(duration).alias("v")).agg(
        F.count(F.lit(1)).alias("c")
    )
    values = sized(values)
    sizes = values.groupBy(*group).agg(
        F.sum("c").alias("n"),
        F.max("v").alias("max"),
        *[F.sum(F.when(F.col("v") <= cut, F.col("c")).otherwise(0)).alias(f"le_{name}")
          for name, cut in (("2_5", 2.5), ("5", 5.0), ("10", 10.0), ("15", 15.0))],
    )
    # the number of distinct values bounds the largest group
    ranked = running_totals(values, group, "v", ["c"], buckets=buckets_for(values.count()))
    joined = ranked.join(sizes, group) if group else beside(ranked, sizes)

    def at(q: int) -> Column:
        rank = F.bround(F.lit(q / 100.0) * (F.col("n") - 1))
        here = (F.col("cum_c") - F.col("c") <= rank) & (rank < F.col("cum_c"))
        return F.max(F.when(here, F.col("v"))).alias(f"p{q}")

    keep = ["n", "max", "le_2_5", "le_5", "le_10", "le_15"]
    return joined.groupBy(*group, *keep).agg(*[at(q) for q in quantiles])


def resolve_paths(df: DataFrame, files: DataFrame, *, root: str, path: str = "audio_filepath") -> DataFrame:
    """Add ``resolved``: absolute paths stay; relative ones are looked up in the
    inventory below ``root`` and then below its parent.  Null when absent.

    ``files`` is an inventory with a ``path`` column.
    """
    parent = root.rstrip("/").rsplit("/", 1)[0]
    known = files.select(F.col("path").alias("_known")).distinct()
    direct = F.concat(F.lit(root.rstrip("/") + "/"), F.col(path))
    upper = F.concat(F.lit(parent + "/"), F.col(path))
    first = known.select(F.col("_known").alias("_direct"))
    second = known.select(F.col("_known").alias("_upper"))
    marked = df.join(first, direct == F.col("_direct"), "left").join(second, upper == F.col("_upper"), "left")
    return marked.withColumn(
        "resolved",
        F.when(paths.is_absolute(F.col(path)), F.col(path)).otherwise(F.coalesce("_direct", "_upper")),
    ).drop("_direct", "_upper")


def restore_gain(peak: Column) -> Column:
    """Gain that brings the stored peak below full scale, rounded up by one step; 1 when it already is."""
    return F.when(peak <= STORAGE_PEAK, F.lit(1.0)).otherwise(
        vectors.next_up(peak / F.lit(STORAGE_PEAK) * F.lit(1.0 + GAIN_CUSHION))
    )


def validate_amplitude(df: DataFrame, key: str = "sample_id") -> DataFrame:
    """Broken amplitude rules: all or none, finite, gain >= 1, consistent peaks."""
    from utterset import violations as v

    gain, canonical, storage = (F.col(c) for c in ("amplitude_restore_gain", "canonical_peak", "storage_peak"))
    present = sum((c.isNotNull().cast("int") for c in (gain, canonical, storage)), F.lit(0))
    whole = present == 3
    finite = vectors.is_finite(gain) & vectors.is_finite(canonical) & vectors.is_finite(storage)
    usable = whole & finite
    return v.rules(
        df,
        F.col(key),
        {
            "all_or_none": ((present > 0) & (present < 3), present),
            "finite": (whole & ~finite, gain),
            "gain_at_least_one": (usable & (gain < 1.0), gain),
            "non_negative_peak": (usable & ((canonical < 0) | (storage < 0)), canonical),
            "storage_headroom": (usable & (storage > STORAGE_PEAK), storage),
            "consistent_peaks": (
                usable & ~vectors.is_close(canonical, storage * gain, 1.0e-6, 1.0e-12), canonical
            ),
        },
    )
