"""Queries over shards, descriptors, consumers and stored samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from utterset.functions import vectors
from utterset.operators import clean, sampling, shards
from utterset.plans.ordering import beside
from utterset.queries.common import SQL_UTTERANCES, dealt, rounded, sql_hash, sql_round, table, utterances
from utterset.session import cut_lineage, scratch_path
from utterset.sinks import writers
from utterset.sources import results
from utterset.streaming import ledger

TARGET = 131072


def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "text")
    sized = docs.withColumn(
        "size", shards.padded_bytes(F.col("n_chars")) + shards.padded_bytes(F.lit(200))
    )
    return shards.assign_shards(sized, key="doc_id", size="size", target=TARGET, seed=47, digits=1)


def sample_index(packed: DataFrame) -> DataFrame:
    return packed.select(
        F.concat_ws(":", "source", "doc_id").alias("sample_id"), "shard",
        F.col("source").alias("source_dataset"), (F.col("n_chars") / 100.0).alias("duration_seconds"),
        F.col("n_chars").alias("frame_count"), F.col("n_chars").alias("encoded_byte_size"),
    )


def shard_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(spark, sf_dir).select("doc_id", "size", "shard")


SQL_PACKED = f"""
sized AS (SELECT doc_id, source, n_chars,
            (512 + ceil(n_chars / 512.0) * 512 + 512 + 512)::BIGINT AS size, {sql_hash(47, 'shard', 'doc_id')} AS h FROM documents),
ranked AS (SELECT *, substr(h, 1, 1) AS bucket, row_number() OVER (PARTITION BY substr(h, 1, 1) ORDER BY h, doc_id) AS rn FROM sized),
packed AS (
  SELECT bucket, rn, doc_id, source, n_chars, size, 0 AS number, size AS used FROM ranked WHERE rn = 1
  UNION ALL
  SELECT r.bucket, r.rn, r.doc_id, r.source, r.n_chars, r.size,
         CASE WHEN p.used + r.size + 10240 > {TARGET} THEN p.number + 1 ELSE p.number END,
         CASE WHEN p.used + r.size + 10240 > {TARGET} THEN r.size ELSE p.used + r.size END
  FROM packed p JOIN ranked r ON r.bucket = p.bucket AND r.rn = p.rn + 1),
named AS (SELECT *, 'shard-' || bucket || '-' || lpad(number::VARCHAR, 6, '0') AS shard FROM packed)
"""


def shard_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index against descriptor and members with planted faults, per rule."""
    index = cut_lineage(sample_index(packed_documents(spark, sf_dir)), "index")
    listed = shards.shard_table(index).withColumn(
        "count", F.when(F.col("shard").endswith("000001"), F.col("count") + 1).otherwise(F.col("count"))
    )
    members = index.where(F.pmod("frame_count", F.lit(13)) != 3).withColumn(
        "encoded_byte_size",
        F.when(F.pmod("frame_count", F.lit(17)) == 5, F.col("encoded_byte_size") - 1).otherwise(F.col("encoded_byte_size")),
    ).select("sample_id", "shard", "duration_seconds", "encoded_byte_size")
    found = shards.verify_dataset(index, listed, members)
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("keys"))


SQL_SHARD_VERIFY = f"""
WITH RECURSIVE {SQL_PACKED}
SELECT rule, n, keys FROM (
  SELECT 'shard_count' AS rule, count(DISTINCT shard) AS n, count(DISTINCT shard) AS keys FROM named WHERE shard LIKE '%000001'
  UNION ALL SELECT 'missing_member', count(*), count(*) FROM named WHERE n_chars % 13 = 3
  UNION ALL SELECT 'member_bytes', count(*), count(*) FROM named WHERE n_chars % 13 <> 3 AND n_chars % 17 = 5) WHERE n > 0
"""


def descriptor_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards written and read back; totals of the descriptor, its merged statistics and its checks."""
    root = scratch_path(spark, "packed")
    packed = packed_documents(spark, sf_dir)
    writers.write_shards(packed, f"{root}/shards", key="doc_id", seed=47)
    stored = spark.read.parquet(f"{root}/shards")
    index = writers.index_of(sample_index(stored))
    measured = index.select(
        "shard", "encoded_byte_size", "duration_seconds", "frame_count",
        (F.pmod("frame_count", F.lit(7)) / 1000.0).alias("max_abs_error"), (F.col("frame_count") / 1024.0).alias("sum_squared_error"),
        (F.col("frame_count") * 2.0).alias("sum_squared_signal"), (F.col("frame_count") / 4000.0).alias("canonical_peak"),
    ).withColumn("amplitude_restore_gain", clean.restore_gain(F.col("canonical_peak")))
    writers.write_descriptor(
        shards.build_descriptor(shards.shard_table(measured), sample_rate=16000), f"{root}/descriptor.json"
    )
    descriptor = results.read_descriptor(spark, f"{root}/descriptor.json")
    clean_run = shards.descriptor_violations(descriptor, sample_rate=16000)
    broken = descriptor.withColumn("kind", F.lit("other")).withColumn(
        "shards",
        F.transform("shards", lambda s, i: s.withField("path", F.when(i == 0, F.concat(F.lit("../"), s["path"])).otherwise(s["path"]))),
    )
    planted = shards.descriptor_violations(broken, sample_rate=8000)
    rows = shards.descriptor_rows(descriptor)
    totals = rows.agg(
        F.sum("count").alias("samples"), F.count(F.lit(1)).alias("n_shards"), F.sum("payload_bytes").alias("payload_bytes"),
        F.sum("duration_seconds").alias("seconds"),
    )
    # the shards' stored partials merged again give what the descriptor says
    again = shards.finish_statistics(shards.merge_statistics(rows))
    same = beside(
        descriptor.select(F.struct("quantization.frame_count", "quantization.max_abs_error", "amplitude_scaling").alias("said")),
        again.select(F.struct("quantization.frame_count", "quantization.max_abs_error", "amplitude_scaling").alias("merged")),
    ).select((F.to_json("said") == F.to_json("merged")).alias("merges"))
    said = descriptor.select(
        "quantization.max_abs_error", "quantization.rms_error", "quantization.snr_db", "amplitude_scaling.scaled_sample_count",
        "amplitude_scaling.max_restore_gain", "amplitude_scaling.max_canonical_peak",
    )
    one = beside(
        beside(beside(beside(totals, said), same), clean_run.agg(F.count(F.lit(1)).alias("violations"))),
        planted.agg(F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("planted")),
    )
    return rounded(rounded(one, "seconds", digits=2), "max_abs_error", "rms_error", "snr_db", "max_restore_gain", "max_canonical_peak")


SQL_DESCRIPTOR = f"""
WITH RECURSIVE {SQL_PACKED},
m AS (SELECT *, n_chars / 4000.0::DOUBLE AS peak FROM named)
SELECT count(*) AS samples, count(DISTINCT shard) AS n_shards, sum(n_chars)::BIGINT AS payload_bytes,
       {sql_round('sum(n_chars / 100.0::DOUBLE)', 2)} AS seconds, {sql_round('max(n_chars % 7) / 1000.0::DOUBLE')} AS max_abs_error,
       {sql_round('sqrt(1 / 1024.0::DOUBLE)')} AS rms_error, {sql_round('10 * log10(2048.0::DOUBLE)')} AS snr_db,
       count(*) FILTER (peak > 0.999) AS scaled_sample_count,
       {sql_round('greatest(1, max(peak) / 0.999::DOUBLE * 1.000001::DOUBLE)')} AS max_restore_gain,
       {sql_round('max(peak)')} AS max_canonical_peak, true AS merges,
       0::BIGINT AS violations, 'kind,sample_rate,unsafe_path' AS planted FROM m
"""


# -- runs that stop ---------------------------------------------------------

WAVES, STOPPED = 5, 2


class Stopped(Exception):
    """The planted end of a run."""


def resumed_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed by a run that stops in its third wave and by one that goes on."""
    path = scratch_path(spark, "resumed")
    rows = cut_lineage(packed_documents(spark, sf_dir).select("doc_id", "n_chars", "text", "shard"), "to-pack")

    def stop(wave: int) -> None:
        if wave == STOPPED:
            raise Stopped

    settings = {"target": str(TARGET), "seed": "47"}
    try:
        ledger.pack_shards(rows, path, settings=settings, waves=WAVES, order="doc_id", before_commit=stop)
    except Stopped:
        pass
    book, _ = ledger.pack_shards(rows, path, settings=settings, waves=WAVES, order="doc_id")
    begun = book.entries().where("event = 'begun'").groupBy("shard").agg(F.count(F.lit(1)).alias("attempts"))
    packed = book.read().groupBy("shard").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.count_distinct("doc_id").alias("docs")
    )
    return packed.join(begun, "shard")


SQL_RESUMED = f"""
WITH RECURSIVE {SQL_PACKED},
s AS (SELECT shard, count(*) AS n, sum(n_chars)::BIGINT AS chars, count(DISTINCT doc_id) AS docs FROM named GROUP BY shard)
SELECT *, CASE WHEN ntile({WAVES}) OVER (ORDER BY shard) - 1 = {STOPPED} THEN 2 ELSE 1 END::BIGINT AS attempts FROM s
"""


# -- epoch planning ---------------------------------------------------------

CONSUMERS, BATCH, EPOCHS = 3, 8, 4


def _source_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("shard")).agg(F.count(F.lit(1)).alias("count"))


def consumer_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = shards.assign_consumers(
        _source_shards(spark, sf_dir), epochs=EPOCHS, consumers=CONSUMERS, batch=BATCH, seed=53
    )
    return shards.consumer_summary(assigned, consumers=CONSUMERS, batch=BATCH)


SQL_BALANCE = f"""
shards_ AS (SELECT source AS shard, count(*) AS c FROM documents GROUP BY source),
ordered AS (SELECT epoch, shard, c, row_number() OVER (PARTITION BY epoch ORDER BY {sql_hash(53, 'epoch', 'epoch', 'shard')}, shard) AS rn
            FROM shards_, range({EPOCHS}) e(epoch)),
deal AS (
  SELECT epoch, 0::BIGINT AS rn, NULL::VARCHAR AS shard, 0::BIGINT AS c, -1::BIGINT AS consumer, [{', '.join(['0'] * CONSUMERS)}]::BIGINT[] AS loads FROM range({EPOCHS}) e(epoch)
  UNION ALL
  SELECT o.epoch, o.rn, o.shard, o.c, list_position(d.loads, list_min(d.loads)) - 1,
         list_transform(range({CONSUMERS}), lambda i: d.loads[i + 1] + CASE WHEN i = list_position(d.loads, list_min(d.loads)) - 1 THEN o.c ELSE 0 END)
  FROM deal d JOIN ordered o ON o.epoch = d.epoch AND o.rn = d.rn + 1),
loads_ AS (SELECT epoch::INTEGER AS epoch, consumer::INTEGER AS consumer, count(*) AS shard_count, sum(c)::BIGINT AS assigned_samples
           FROM deal WHERE rn > 0 GROUP BY epoch, consumer),
plan_ AS (SELECT *, (min(assigned_samples) OVER (PARTITION BY epoch) // {BATCH} * {BATCH})::BIGINT AS selected_samples FROM loads_)
"""


def epoch_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows every consumer takes from its shards in epoch 1."""
    assigned = cut_lineage(
        shards.assign_consumers(_source_shards(spark, sf_dir), epochs=EPOCHS, consumers=CONSUMERS, batch=BATCH, seed=53), "plan"
    )
    summary = shards.consumer_summary(assigned, consumers=CONSUMERS, batch=BATCH)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("shard"))
    return shards.select_for_consumers(docs, assigned, summary, key="doc_id", epoch=1, seed=59)


SQL_EPOCH = f"""
WITH RECURSIVE {SQL_BALANCE},
dealt AS (SELECT d.doc_id, d.source AS shard, a.consumer::INTEGER AS consumer, p.selected_samples,
            row_number() OVER (PARTITION BY a.consumer ORDER BY {sql_hash(59, 'deal1', 'doc_id')}, doc_id) AS rn
          FROM documents d JOIN deal a ON a.shard = d.source AND a.epoch = 1
               JOIN plan_ p ON p.epoch = 1 AND p.consumer = a.consumer)
SELECT doc_id, shard, consumer FROM dealt WHERE rn <= selected_samples
"""


# -- stored samples ---------------------------------------------------------


def amplitude_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaling metadata of every line with planted faults, per rule."""
    peak = F.col("l_extendedprice") / 50000.0
    gain = clean.restore_gain(F.col("canonical_peak"))
    line = F.col("l_linenumber")
    rows = (
        table(spark, sf_dir, "lineitem")
        .select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("sample_id"), "l_linenumber", peak.alias("canonical_peak"))
        .withColumn("gain", gain)
        .withColumn("storage_peak", F.col("canonical_peak") / F.col("gain") * F.when(line == 7, 1.01).otherwise(1.0))
        .withColumn("amplitude_restore_gain", F.when(line == 6, F.lit(None)).when(line == 5, F.col("gain") * 0.5).otherwise(F.col("gain")))
    )
    found = clean.validate_amplitude(dealt(rows))
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


SQL_AMPLITUDE = """
WITH r AS (SELECT l_linenumber AS line, l_extendedprice / 50000.0::DOUBLE AS peak FROM lineitem),
g AS (SELECT *, CASE WHEN peak <= 0.999::DOUBLE THEN 1.0::DOUBLE
                     ELSE nextafter(peak / 0.999::DOUBLE * 1.000001::DOUBLE, 'infinity'::DOUBLE) END AS gain0 FROM r),
s AS (SELECT line, peak, peak / gain0 * CASE WHEN line = 7 THEN 1.01::DOUBLE ELSE 1.0::DOUBLE END AS storage,
             CASE WHEN line = 6 THEN NULL WHEN line = 5 THEN gain0 * 0.5::DOUBLE ELSE gain0 END AS gain FROM g),
f AS (SELECT gain IS NULL AS a, gain < 1 AS b, gain IS NOT NULL AND storage > 0.999::DOUBLE AS c,
             abs(peak - storage * gain) > greatest(1e-6 * greatest(abs(peak), abs(storage * gain)), 1e-12) AS d FROM s)
SELECT * FROM (
  SELECT 'all_or_none' AS rule, count(*) FILTER (a) AS n FROM f
  UNION ALL SELECT 'gain_at_least_one', count(*) FILTER (b) FROM f
  UNION ALL SELECT 'storage_headroom', count(*) FILTER (c) FROM f
  UNION ALL SELECT 'consistent_peaks', count(*) FILTER (d) FROM f) WHERE n > 0
"""


def stored_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantization and scaling statistics of all lines by return flag."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", F.col("l_quantity").cast("long").alias("frame_count"), (F.col("l_tax") / 1000).alias("max_abs_error"),
        (F.col("l_discount") * F.col("l_discount")).alias("sum_squared_error"), F.col("l_extendedprice").alias("sum_squared_signal"),
        clean.restore_gain(F.col("l_extendedprice") / 50000.0).alias("amplitude_restore_gain"),
        (F.col("l_extendedprice") / 50000.0).alias("canonical_peak"),
    )
    quant = shards.quant_stats(rows, ["l_returnflag"]).drop("sum_squared_error", "sum_squared_signal")
    out = quant.join(shards.scaling_stats(rows, ["l_returnflag"]), "l_returnflag")
    return rounded(out, "max_abs_error", "rms_error", "signal_rms", "snr_db", "max_restore_gain", "max_canonical_peak")


SQL_STORED = f"""
WITH r AS (SELECT l_returnflag, l_quantity, l_tax / 1000 AS e, l_discount * l_discount AS err, l_extendedprice AS sig, l_extendedprice / 50000.0::DOUBLE AS peak FROM lineitem)
SELECT l_returnflag, count(*) AS sample_count, sum(l_quantity)::BIGINT AS frame_count, {sql_round('max(e)')} AS max_abs_error,
       {sql_round('sqrt(sum(err) / sum(l_quantity))')} AS rms_error, {sql_round('sqrt(sum(sig) / sum(l_quantity))')} AS signal_rms,
       {sql_round('10 * log10(sum(sig) / sum(err))')} AS snr_db, count(*) FILTER (peak > 0.999) AS scaled_sample_count,
       {sql_round('greatest(1, max(peak) / 0.999::DOUBLE * 1.000001::DOUBLE)')} AS max_restore_gain, {sql_round('max(peak)')} AS max_canonical_peak
FROM r GROUP BY l_returnflag
"""


def restore_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gain of every distinct stored peak, to the last bit."""
    peak = (F.col("l_extendedprice") / 50000.0).alias("peak")
    return table(spark, sf_dir, "lineitem").select(peak).distinct().withColumn("gain", clean.restore_gain(F.col("peak")))


SQL_GAINS = """
SELECT peak, CASE WHEN peak <= 0.999::DOUBLE THEN 1.0::DOUBLE
                  ELSE nextafter(peak / 0.999::DOUBLE * 1.000001::DOUBLE, 'infinity'::DOUBLE) END AS gain
FROM (SELECT DISTINCT l_extendedprice / 50000.0::DOUBLE AS peak FROM lineitem)
"""


def _stored(samples: Column) -> Column:
    return F.transform(samples, lambda x: F.round(x, 3))


def parity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector against its copy kept to three digits; some copies are short, off, gone or of nothing."""
    source = table(spark, sf_dir, "embeddings").select("vec_id", vectors.as_double(F.col("embedding")).alias("samples"))
    no, kept = F.col("vec_id"), _stored(F.col("samples"))
    damaged = (
        F.when(no % 50 == 7, F.slice(kept, 1, 63))
        .when(no % 97 == 5, F.transform(kept, lambda x, i: F.when(i == 3, x + 0.01).otherwise(x)))
        .otherwise(kept)
    )
    packed = source.where(no % 101 != 3).select("vec_id", damaged.alias("samples"))
    extra = source.where(no % 83 == 1).select((-1 - no).alias("vec_id"), kept.alias("samples"))
    failures, totals, shipped = shards.audit_all(
        packed.unionByName(extra), source, key="vec_id", samples="samples", stored=_stored, tolerance=0.005
    )
    reasons = failures.agg(
        F.count_if(F.col("reason") == "frame_count").alias("mismatched"),
        F.count_if(F.col("reason") == "max_abs_error").alias("over"),
    )
    counted = shipped.agg(F.count(F.lit(1)).alias("shipped"))
    return rounded(beside(beside(totals, reasons), counted), "max_abs_error", "rms_error", digits=9)


SQL_PARITY = f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x, vec_id % 101 = 3 AS gone, vec_id % 50 = 7 AS short,
                  vec_id % 97 = 5 AND vec_id % 50 <> 7 AS off, vec_id % 83 = 1 AS extra FROM embeddings),
d AS (SELECT *, list_transform(x, lambda e, i : abs(round(e, 3) + CASE WHEN off AND i = 4 THEN 0.01::DOUBLE ELSE 0 END - e)) AS e FROM v),
g AS (SELECT list_max(e) AS m, len(x) AS n, list_sum(list_transform(e, lambda y : y * y)) AS sq FROM d WHERE NOT gone AND NOT short),
c AS (SELECT count(*) FILTER (gone OR short OR off) + count(*) FILTER (extra) AS shipped,
             count(*) FILTER (gone OR short) + count(*) FILTER (extra) AS mismatched FROM v)
SELECT count(*) AS records, sum(n)::BIGINT AS frames, {sql_round('max(m)', 9)} AS max_abs_error, {sql_round('sqrt(sum(sq) / sum(n))', 9)} AS rms_error,
       count(*) FILTER (m > 0.005) AS failures, any_value(mismatched) AS mismatched, count(*) FILTER (m > 0.005) AS over, any_value(shipped) AS shipped
FROM g, c
"""


def sampled_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quick audit: sixty rows of four drawn shards, their samples compared one by one."""
    rows = utterances(spark, sf_dir).select(
        "vec_id", F.col("speaker").cast("string").alias("shard"), "label", vectors.as_double(F.col("embedding")).alias("samples")
    )
    audited = cut_lineage(sampling.sample_rows_in_shards(rows, "vec_id", shards=4, rows=60, seed=61), "audit")
    short = F.when(F.col("label") == 3, F.slice("samples", 1, 63)).otherwise(F.col("samples"))
    packed = audited.select("vec_id", _stored(short).alias("samples"))
    failures, totals = shards.audit_parity(packed, audited, key="vec_id", samples="samples", tolerance=0.00049)
    reasons = failures.agg(
        F.count_if(F.col("reason") == "frame_count").alias("mismatched"),
        F.count_if(F.col("reason") == "max_abs_error").alias("over"),
    )
    return rounded(beside(totals, reasons), "max_abs_error", "rms_error", digits=9)


SQL_SAMPLED_AUDIT = f"""
WITH {SQL_UTTERANCES},
chosen AS (SELECT speaker FROM (SELECT DISTINCT speaker FROM utterances) ORDER BY {sql_hash(61, 'shards', 'speaker')}, speaker::VARCHAR LIMIT 4),
audited AS (SELECT vec_id, label, embedding AS x FROM utterances WHERE speaker IN (SELECT speaker FROM chosen)
            ORDER BY {sql_hash(61, 'rows', 'vec_id')}, vec_id LIMIT 60),
d AS (SELECT label, list_max(list_transform(x, lambda e: abs(round(e, 3) - e))) AS m, len(x) AS n,
             list_sum(list_transform(x, lambda e: (round(e, 3) - e) * (round(e, 3) - e))) AS sq FROM audited)
SELECT count(*) FILTER (label <> 3) AS records, sum(n) FILTER (label <> 3)::BIGINT AS frames, {sql_round('max(m) FILTER (label <> 3)', 9)} AS max_abs_error,
       {sql_round('sqrt(sum(sq) FILTER (label <> 3) / sum(n) FILTER (label <> 3))', 9)} AS rms_error,
       count(*) FILTER (label <> 3 AND m > 0.00049) AS failures, count(*) FILTER (label = 3) AS mismatched,
       count(*) FILTER (label <> 3 AND m > 0.00049) AS over FROM d
"""

QUERIES = {
    "shard_assignment": shard_assignment,
    "shard_verify": shard_verify,
    "descriptor_checks": descriptor_checks,
    "consumer_balance": consumer_balance,
    "epoch_selection": epoch_selection,
    "amplitude_contract": amplitude_contract,
    "stored_statistics": stored_statistics,
    "restore_gains": restore_gains,
    "parity_audit": parity_audit,
    "sampled_audit": sampled_audit,
    "resumed_packing": resumed_packing,
}

ORACLES = {
    "shard_assignment": f"WITH RECURSIVE {SQL_PACKED} SELECT doc_id, size, shard FROM named",
    "shard_verify": SQL_SHARD_VERIFY,
    "descriptor_checks": SQL_DESCRIPTOR,
    "consumer_balance": f"WITH RECURSIVE {SQL_BALANCE} SELECT epoch, consumer, shard_count, assigned_samples, selected_samples FROM plan_",
    "epoch_selection": SQL_EPOCH,
    "amplitude_contract": SQL_AMPLITUDE,
    "stored_statistics": SQL_STORED,
    "restore_gains": SQL_GAINS,
    "parity_audit": SQL_PARITY,
    "sampled_audit": SQL_SAMPLED_AUDIT,
    "resumed_packing": SQL_RESUMED,
}
