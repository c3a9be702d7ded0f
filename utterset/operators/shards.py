"""Size-bounded shards, descriptors, verification and epoch planning."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utterset import violations as v
from utterset.functions import paths, vectors
from utterset.functions.hashing import order_key
from utterset.plans.ordering import beside
from utterset.session import Scratch, sized

# Fixed values of the shard format.
BLOCK = 512
FINAL_RECORD = 10240
CELL_STARTS = 8  # starts that a row is compared with, about
MAX_SHARD = 2 * 1024**3
SNR_FLOOR = 1.0e-30
KIND = "speech-audio-shards"
FORMAT_VERSION = 1


def padded_bytes(payload: Column) -> Column:
    """One header block plus the payload rounded up to whole blocks."""
    return (F.lit(BLOCK) + F.ceil(payload / F.lit(BLOCK)) * BLOCK).cast("long")


def assign_shards(
    df: DataFrame, *, key: str, size: str, target: int, seed: int, digits: int
) -> DataFrame:
    """Add ``shard``: next-fit packing of rows in seeded order.

    The seeded order is cut into ``16**digits`` hash ranges (buckets).  The number
    is a parameter, so a bucket holds the same keys whatever the table's size;
    total size / (target * 16**digits) should be some tens of shards.  Inside a
    bucket (key, size) pairs stream once in order through a task that remembers
    only the open shard and emits where each shard starts.  A shard is an interval
    of the order, so rows find theirs by comparing with the few starts of a cell of
    their bucket: payload columns are not shuffled.  Each bucket may leave one part-filled last
    shard.  A row that no shard can hold raises.
    """
    v.assert_empty(oversized(df, key, size))
    hashed = df.withColumn("_h", order_key(seed, "shard", key)).withColumn(
        "_bucket", F.substring("_h", 1, digits) if digits else F.lit("")
    )
    narrow = hashed.select(
        F.col("_bucket").alias("bucket"), "_h", F.col(key).alias("key"), F.col(size).cast("long").alias("size")
    )

    def starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, used, room = None, 0, target - FINAL_RECORD
        for pdf in batches:
            if not len(pdf):
                continue
            names, opened = pdf["bucket"].to_numpy(), []
            edges = np.concatenate([[0], np.flatnonzero(names[1:] != names[:-1]) + 1, [len(pdf)]])
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                total = np.cumsum(pdf["size"].to_numpy()[lo:hi], dtype=np.int64)
                taken, free = -used, 0  # what lay before the open shard, the first row not in it yet
                if names[lo] != current:
                    current, taken, free = names[lo], 0, 1
                    opened.append(lo)
                while True:  # one step per shard: the first row beyond its room opens the next
                    full = max(free, int(np.searchsorted(total, taken + room, side="right")))
                    if full >= hi - lo:
                        break
                    opened.append(lo + full)
                    taken, free = int(total[full - 1]) if full else 0, full + 1
                used = int(total[-1]) - taken
            yield pdf.iloc[opened][["bucket", "_h", "key"]]

    key_type = df.schema[key].dataType.simpleString()
    begun = (
        narrow.repartition("bucket")
        .sortWithinPartitions("bucket", "_h", "key")
        .mapInPandas(starts, f"bucket string, _h string, key {key_type}")
    )
    # a bucket's starts are dealt to cells, longer hash prefixes with a few starts each, so that a row
    # compares with few starts however many its bucket has
    begun = sized(begun)
    largest = begun.groupBy("bucket").count().agg(F.max("count")).first()[0] or 0
    deeper = 0
    while 16**deeper * CELL_STARTS < largest:
        deeper += 1
    numbers = F.explode(F.sequence(F.lit(0), F.lit(16**deeper - 1))).alias("d")
    cells = begun.select("bucket").distinct().select("bucket", numbers).select(
        "bucket", F.concat("bucket", F.lower(F.lpad(F.hex("d"), deeper, "0"))).alias("_cell")
    )
    held = begun.groupBy("bucket", F.substring("_h", 1, digits + deeper).alias("_cell")).agg(
        F.collect_list(F.struct("_h", "key")).alias("_starts")
    )
    before = Window.partitionBy("bucket").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    table = cells.join(held, ["bucket", "_cell"], "left").select(
        "bucket", "_cell", F.coalesce("_starts", F.array().cast(held.schema["_starts"].dataType)).alias("_starts")
    )
    table = table.select("_cell", "_starts", F.coalesce(F.sum(F.size("_starts")).over(before), F.lit(0)).alias("_before"))
    hashed = hashed.withColumn("_cell", F.substring("_h", 1, digits + deeper) if digits + deeper else F.lit(""))
    here = F.struct(F.col("_h"), F.col(key).alias("key"))
    number = F.col("_before") + F.size(F.filter("_starts", lambda s: s <= here)) - 1
    name = F.concat(
        F.lit("shard-"), F.when(F.col("_bucket") != "", F.concat("_bucket", F.lit("-"))).otherwise(""),
        F.lpad(number.cast("string"), 6, "0"),
    )
    return hashed.join(sized(table), "_cell").withColumn("shard", name).select(*df.columns, "shard")


def oversized(df: DataFrame, key: str, size: str) -> DataFrame:
    """Rows that no shard can hold."""
    return v.violation(df, "above_shard_cap", F.col(size) + FINAL_RECORD > MAX_SHARD, F.col(key), F.col(size))


# -- mergeable statistics ---------------------------------------------------


def quant_stats(df: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Quantization error of samples: counts, maximum, RMS and SNR.

    ``df``: (frame_count, max_abs_error, sum_squared_error, sum_squared_signal).
    """
    sums = df.groupBy(*(group or [])).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.coalesce(F.sum("frame_count"), F.lit(0)).alias("frame_count"),
        F.coalesce(F.max("max_abs_error"), F.lit(0.0)).alias("max_abs_error"),
        F.coalesce(F.sum("sum_squared_error"), F.lit(0.0)).alias("sum_squared_error"),
        F.coalesce(F.sum("sum_squared_signal"), F.lit(0.0)).alias("sum_squared_signal"),
    )
    return finalize_quant(sums)


def finalize_quant(sums: DataFrame) -> DataFrame:
    frames = F.col("frame_count")
    rms = lambda c: F.when(frames > 0, F.sqrt(F.col(c) / frames)).otherwise(0.0)
    error, signal = F.col("sum_squared_error"), F.col("sum_squared_signal")
    return (
        sums.withColumn("rms_error", rms("sum_squared_error"))
        .withColumn("signal_rms", rms("sum_squared_signal"))
        .withColumn(
            "snr_db", F.when(error > 0, 10.0 * F.log10(F.greatest(signal, F.lit(SNR_FLOOR)) / error))
        )
    )


def scaling_stats(df: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Reversible amplitude scaling: scaled samples, largest gain and peak."""
    return df.groupBy(*(group or [])).agg(
        F.count_if(F.col("amplitude_restore_gain") > 1.0).alias("scaled_sample_count"),
        F.greatest(F.lit(1.0), F.coalesce(F.max("amplitude_restore_gain"), F.lit(1.0))).alias("max_restore_gain"),
        F.coalesce(F.max("canonical_peak"), F.lit(0.0)).alias("max_canonical_peak"),
    )


QUANT_SUMS = ("frame_count", "max_abs_error", "sum_squared_error", "sum_squared_signal")


def partial_statistics(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, stats): what must be kept of samples to merge their statistics later.

    ``stats`` holds counts, sums and maxima only, so partials of parts merge in any
    order and grouping to the partial of the whole (``merge_statistics``).
    """
    return df.groupBy(*group).agg(
        F.struct(
            F.count(F.lit(1)).alias("sample_count"),
            F.coalesce(F.sum("frame_count"), F.lit(0)).cast("long").alias("frame_count"),
            F.coalesce(F.max("max_abs_error"), F.lit(0.0)).alias("max_abs_error"),
            F.coalesce(F.sum("sum_squared_error"), F.lit(0.0)).alias("sum_squared_error"),
            F.coalesce(F.sum("sum_squared_signal"), F.lit(0.0)).alias("sum_squared_signal"),
            F.count_if(F.col("amplitude_restore_gain") > 1.0).alias("scaled_sample_count"),
            F.greatest(F.lit(1.0), F.coalesce(F.max("amplitude_restore_gain"), F.lit(1.0))).alias("max_restore_gain"),
            F.coalesce(F.max("canonical_peak"), F.lit(0.0)).alias("max_canonical_peak"),
        ).alias("stats")
    )


MERGES = {
    "sample_count": F.sum, "frame_count": F.sum, "max_abs_error": F.max, "sum_squared_error": F.sum,
    "sum_squared_signal": F.sum, "scaled_sample_count": F.sum, "max_restore_gain": F.max, "max_canonical_peak": F.max,
}


def merge_statistics(partials: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """The partial of all ``stats`` of a group; merging again merged partials gives the same."""
    return partials.groupBy(*group).agg(F.struct(*[how(f"stats.{name}").alias(name) for name, how in MERGES.items()]).alias("stats"))


def finish_statistics(partials: DataFrame) -> DataFrame:
    """``stats`` as (quantization, amplitude_scaling) with the root mean squares and the ratio in dB."""
    flat = partials.select("*", "stats.*")
    done = finalize_quant(flat)
    names = [c for c in partials.columns if c != "stats"]
    return done.select(
        *names,
        F.struct(
            "sample_count", "frame_count", "max_abs_error", "sum_squared_error", "sum_squared_signal", "rms_error", "signal_rms", "snr_db"
        ).alias("quantization"),
        F.struct("scaled_sample_count", "max_restore_gain", "max_canonical_peak").alias("amplitude_scaling"),
    )


# -- descriptor -------------------------------------------------------------


def shard_table(index: DataFrame, *, size: str = "encoded_byte_size") -> DataFrame:
    """One row per shard: count, bytes and duration, and its partial statistics where the index has them."""
    found = index.groupBy("shard").agg(
        F.count(F.lit(1)).alias("count"),
        F.sum(size).alias("payload_bytes"),
        F.sum("duration_seconds").alias("duration_seconds"),
    )
    if not set(QUANT_SUMS) <= set(index.columns):
        return found
    return found.join(partial_statistics(index, ["shard"]), "shard")


def build_descriptor(shards: DataFrame, *, sample_rate: int) -> DataFrame:
    """One row: contract, totals and the array of shards (shards, not rows).

    With partial statistics every shard keeps its own, and the totals have them merged.
    """
    has_stats = "stats" in shards.columns
    entry = F.struct(
        F.concat(F.lit("shards/"), F.col("shard"), F.lit(".tar")).alias("path"),
        F.col("count"), F.col("payload_bytes"), F.col("duration_seconds"), *([F.col("stats")] if has_stats else []),
    )
    made = shards.agg(
        F.sum("count").alias("samples"),
        F.count(F.lit(1)).alias("n_shards"),
        F.sum("payload_bytes").alias("payload"),
        F.sum("duration_seconds").alias("duration"),
        F.sort_array(F.collect_list(entry)).alias("shards"),
    ).select(
        F.lit(KIND).alias("kind"),
        F.lit(FORMAT_VERSION).alias("format_version"),
        F.lit(sample_rate).alias("sample_rate"),
        F.struct(
            F.col("samples"), F.col("n_shards").alias("shards"),
            F.col("duration").alias("total_duration_seconds"), F.col("payload").alias("total_audio_payload_bytes"),
        ).alias("counts"),
        "shards",
    )
    return beside(made, finish_statistics(merge_statistics(shards))) if has_stats else made


def descriptor_rows(descriptor: DataFrame) -> DataFrame:
    """(path, count, payload_bytes, duration_seconds) of every listed shard."""
    return descriptor.select(F.explode("shards").alias("s")).select("s.*")


def descriptor_violations(descriptor: DataFrame, *, sample_rate: int, files: DataFrame | None = None) -> DataFrame:
    """Broken descriptor rules: kind, version, rate, counts, paths, totals."""
    name = F.lit("descriptor")
    top = v.rules(
        descriptor,
        name,
        {
            "kind": (~F.col("kind").eqNullSafe(KIND), F.col("kind")),
            "format_version": (~F.col("format_version").eqNullSafe(FORMAT_VERSION), F.col("format_version")),
            "sample_rate": (~F.col("sample_rate").eqNullSafe(sample_rate), F.col("sample_rate")),
            "no_shards": (F.coalesce(F.size("shards"), F.lit(0)) <= 0, F.lit("0")),
            "positive_samples": (~F.coalesce(F.col("counts.samples") > 0, F.lit(False)), F.col("counts.samples")),
        },
    )
    rows = descriptor_rows(descriptor)
    each = v.rules(
        rows,
        F.col("path"),
        {
            "unsafe_path": (~paths.is_safe(F.col("path")), F.col("path")),
            "not_an_archive": (paths.suffix(F.col("path")) != ".tar", F.col("path")),
            "positive_count": (~F.coalesce(F.col("count") > 0, F.lit(False)), F.col("count")),
        },
    )
    twice = v.duplicates(rows, "path", "duplicate_path")
    total = rows.agg(F.sum("count").alias("listed"))
    sums = beside(descriptor.select(F.col("counts.samples").alias("samples")), total)
    wrong = v.violation(
        sums, "total_samples", F.col("listed") != F.col("samples"), name, F.concat_ws("/", "listed", "samples")
    )
    parts = [top, each, twice, wrong]
    if files is not None:
        absent = rows.join(files.select("path"), "path", "left_anti")
        parts.append(v.violation(absent, "missing_file", F.lit(True), F.col("path"), F.col("path")))
    return v.union_all(parts)


# -- reconciliation ---------------------------------------------------------


def verify_dataset(index: DataFrame, shards: DataFrame, data: DataFrame) -> DataFrame:
    """Index against descriptor rows and stored members, every mismatch a row.

    ``data``: stored (sample_id, shard, duration_seconds, encoded_byte_size).
    """
    listed = shards.select(
        "shard", F.col("count").alias("d_count"), F.col("payload_bytes").alias("d_bytes"),
        F.col("duration_seconds").alias("d_seconds"),
    )
    found = shard_table(index)
    both = found.join(listed, "shard", "full_outer")
    per_shard = v.rules(
        both,
        F.col("shard"),
        {
            "unknown_shard": (F.col("d_count").isNull(), F.col("count")),
            "empty_shard": (F.col("count").isNull(), F.col("d_count")),
            "shard_count": (F.col("count") != F.col("d_count"), F.concat_ws("/", "count", "d_count")),
            "shard_bytes": (F.col("payload_bytes") != F.col("d_bytes"), F.concat_ws("/", "payload_bytes", "d_bytes")),
            # sums of many durations differ in the last digits with their order
            "shard_duration": (
                ~vectors.is_close(F.col("duration_seconds"), F.col("d_seconds"), 1e-9, 1e-12),
                F.concat_ws("/", "duration_seconds", "d_seconds"),
            ),
        },
    )
    left = index.select(
        "sample_id", F.col("shard").alias("i_shard"), F.col("encoded_byte_size").alias("i_bytes"),
        F.col("duration_seconds").alias("i_seconds"),
    )
    right = data.select(
        "sample_id", F.col("shard").alias("m_shard"), F.col("encoded_byte_size").alias("m_bytes"),
        F.col("duration_seconds").alias("m_seconds"),
    )
    members = v.rules(
        left.join(right, "sample_id", "full_outer"),
        F.col("sample_id"),
        {
            "missing_member": (F.col("m_shard").isNull(), F.col("i_shard")),
            "unindexed_member": (F.col("i_shard").isNull(), F.col("m_shard")),
            "member_shard": (F.col("i_shard") != F.col("m_shard"), F.concat_ws("/", "i_shard", "m_shard")),
            "member_bytes": (F.col("i_bytes") != F.col("m_bytes"), F.concat_ws("/", "i_bytes", "m_bytes")),
            "member_duration": (F.abs(F.col("i_seconds") - F.col("m_seconds")) > 1e-12, F.col("i_seconds")),
        },
    )
    return v.union_all([per_shard, members, v.duplicates(index, "sample_id", "duplicate_sample")])


def _differences(a: Column, b: Column) -> list[Column]:
    """Columns (mismatch, frames, max_abs_error, squared, source_peak, packed_peak) of packed ``a`` and source ``b``."""
    return [
        F.coalesce(F.size(a) != F.size(b), F.lit(True)).alias("mismatch"),
        F.size(b).alias("frames"),
        vectors.max_abs_difference(a, b).alias("max_abs_error"),
        vectors.total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))).alias("squared"),
        F.array_max(F.transform(b, lambda x: F.abs(x))).alias("source_peak"),
        F.array_max(F.transform(a, lambda x: F.abs(x))).alias("packed_peak"),
    ]


def _parity_report(compared: DataFrame, key: str, tolerance: float) -> tuple[DataFrame, DataFrame]:
    over = F.col("mismatch") | (F.col("max_abs_error") > tolerance)
    failures = compared.where(over).select(
        key, F.when(F.col("mismatch"), "frame_count").otherwise("max_abs_error").alias("reason"),
        F.when(~F.col("mismatch"), F.col("max_abs_error")).alias("max_abs_error"), "source_peak", "packed_peak",
    )
    totals = compared.where(~F.col("mismatch")).agg(
        F.count(F.lit(1)).alias("records"),
        F.sum("frames").alias("frames"),
        F.max("max_abs_error").alias("max_abs_error"),
        F.sqrt(F.sum("squared") / F.sum("frames")).alias("rms_error"),
        F.count_if(F.col("max_abs_error") > tolerance).alias("failures"),
    )
    return failures, totals


def _compared(packed: DataFrame, source: DataFrame, key: str, samples: str) -> DataFrame:
    a = packed.select(key, vectors.as_double(F.col(samples)).alias("_a"))
    b = source.select(key, vectors.as_double(F.col(samples)).alias("_b"))
    return a.join(b, key, "full_outer").select(key, *_differences(F.col("_a"), F.col("_b")))


def audit_parity(packed: DataFrame, source: DataFrame, *, key: str, samples: str, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """(failures, one-row totals) of packed against source samples: every row's samples meet in a join."""
    return _parity_report(_compared(packed, source, key, samples), key, tolerance)


def differing_keys(left: DataFrame, right: DataFrame, key: str, levels: Sequence[int], scratch: Scratch) -> DataFrame:
    """Keys whose digests differ, are repeated or stand on one side only.

    Both tables have (key, one, two), two digests of a row.  Rows lie in ranges of
    their key's hash.  A range is compared by its count, the xor and the sum of its
    digests, which no order of rows changes; the next level looks only into ranges
    that differ, and at last their rows are compared by key.
    """
    sides = [
        scratch.keep(df.select(key, "one", "two", order_key(0, "audit", key).alias("h")), "digests") for df in (left, right)
    ]
    open_ = None
    for digits in levels:
        if open_ is not None:
            depth = open_.first()
            if depth is None:
                break
            width = len(depth["range"])
            sides_now = [s.join(open_, F.substring("h", 1, width) == F.col("range"), "left_semi") for s in sides]
        else:
            sides_now = sides
        sums = [
            s.groupBy(F.substring("h", 1, digits).alias("range")).agg(
                F.struct(
                    F.count(F.lit(1)), F.bit_xor("one"), F.sum(F.col("two").cast("decimal(38,0)"))
                ).alias("digest")
            )
            for s in sides_now
        ]
        both = sums[0].withColumnRenamed("digest", "d1").join(sums[1].withColumnRenamed("digest", "d2"), "range", "full_outer")
        open_ = scratch.keep(both.where(~F.col("d1").eqNullSafe(F.col("d2"))).select("range"), "ranges")
    width = levels[-1]
    rows = [
        s.join(open_, F.substring("h", 1, width) == F.col("range"), "left_semi").groupBy(key).agg(
            F.sort_array(F.collect_list(F.struct("one", "two"))).alias("d")
        )
        for s in sides
    ]
    both = rows[0].withColumnRenamed("d", "d1").join(rows[1].withColumnRenamed("d", "d2"), key, "full_outer")
    return scratch.keep(both.where(~F.col("d1").eqNullSafe(F.col("d2"))).select(key), "differing")


def audit_all(
    packed: DataFrame,
    source: DataFrame,
    *,
    key: str,
    samples: str,
    stored: Callable[[Column], Column],
    tolerance: float,
    levels: Sequence[int] = (2, 4),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(failures, one-row totals, shipped keys) of every row of packed against source samples.

    ``stored`` maps source samples (array<double>) to what packing stores of them.
    Each side digests its own rows where they lie; rows whose digests agree are
    stored as they should be, so their error is measured on the source alone, and only
    rows that differ send their samples into a join.  ``levels`` are the digits of
    the ranges of ``differing_keys``.
    """
    scratch = Scratch(packed.sparkSession, "audit")
    own = vectors.as_double(F.col(samples))

    def digests(df: DataFrame, values: Column) -> DataFrame:
        made = df.select(key, values.alias("_v"))
        return made.select(key, F.xxhash64(key, "_v").alias("one"), F.xxhash64("_v", F.lit("audit"), key).alias("two"))

    shipped = differing_keys(digests(packed, own), digests(source, stored(own)), key, levels, scratch)
    apart = _compared(packed.join(shipped, key, "left_semi"), source.join(shipped, key, "left_semi"), key, samples)
    kept = source.join(shipped, key, "left_anti").select(key, own.alias("_b")).withColumn("_a", stored(F.col("_b")))
    alike = kept.select(key, *_differences(F.col("_a"), F.col("_b")))
    compared = scratch.keep(apart.unionByName(alike), "compared")
    return (*_parity_report(compared, key, tolerance), shipped)


# -- epoch planning ---------------------------------------------------------


def assign_consumers(shards: DataFrame, *, epochs: int, consumers: int, batch: int, seed: int) -> DataFrame:
    """(epoch, consumer, shard, count, place): whole shards to the least loaded.

    Works on shard metadata (a row per shard); epochs run in parallel.
    """
    spread = shards.select("shard", F.col("count").cast("long").alias("count"), F.explode(
        F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    keyed = spread.withColumn("_h", order_key(seed, "epoch", "epoch", "shard"))

    def balance(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_h", "shard"])
        loads = [(0, i) for i in range(consumers)]
        chosen = []
        for count in pdf["count"]:
            load, consumer = heapq.heappop(loads)
            chosen.append(consumer)
            heapq.heappush(loads, (load + int(count), consumer))
        return pdf.assign(consumer=chosen, place=range(len(pdf)))[
            ["epoch", "consumer", "shard", "count", "place"]
        ]

    return keyed.groupBy("epoch").applyInPandas(
        balance, "epoch int, consumer int, shard string, count long, place int"
    )


def consumer_summary(assigned: DataFrame, *, consumers: int, batch: int) -> DataFrame:
    """Per epoch and consumer: shards, samples, and the common quota."""
    loads = assigned.groupBy("epoch", "consumer").agg(
        F.count(F.lit(1)).alias("shard_count"), F.sum("count").alias("assigned_samples")
    )
    quota = loads.groupBy("epoch").agg(
        F.when(F.count(F.lit(1)) < consumers, F.lit(0))
        .otherwise(F.floor(F.min("assigned_samples") / batch) * batch)
        .cast("long")
        .alias("selected_samples")
    )
    return loads.join(quota, "epoch")


def select_for_consumers(rows: DataFrame, assigned: DataFrame, summary: DataFrame, *, key: str, epoch: int, seed: int) -> DataFrame:
    """Exactly the quota of rows for every consumer of one epoch."""
    from utterset.operators.sampling import split_by_cut

    plan = sized(
        assigned.where(F.col("epoch") == epoch).join(summary, ["epoch", "consumer"]).select(
            "shard", "consumer", "selected_samples"
        )
    )
    quota = plan.agg(F.min("selected_samples").alias("q")).first()["q"]
    dealt = rows.join(plan.drop("selected_samples"), "shard").withColumn(
        "_h", order_key(seed, f"deal{epoch}", key)
    )
    marked = split_by_cut(dealt, ["consumer"], "_h", key, F.lit(int(quota)), name="_in")
    return marked.where("_in").drop("_in", "_h")
