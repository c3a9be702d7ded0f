"""Queries over file layouts, logs read as files, crops, stored statistics and streams with time."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterset.functions import vectors
from utterset.operators import asr, bootstrap, clean, embeddings, runlogs, sampling, signals, verify
from utterset.plans.resample import sql_draws
from utterset.queries.common import rounded, sql_hash, sql_round, table
from utterset.queries.logs import event_log
from utterset.queries.representation import _sql_uniform
from utterset.queries.statistics import REPLICATES, SQL_CAPPED, _sql_summary, sql_eer, transcript_entries, trial_entries
from utterset.session import cut_lineage, scratch_path
from utterset.sinks import writers
from utterset.sources import results, tabular
from utterset.streaming import logs

# -- layouts ----------------------------------------------------------------


def labeled_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of a metadata table with blanks in speaker and label, for the files that exist."""
    root = scratch_path(spark, "clips")
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    name = F.concat(F.lit("c"), F.col("doc_id").cast("string"), F.lit(".mp3"))
    rows = docs.select(
        name.alias("path"), F.when(F.col("quality") == 1, F.lit("  ")).otherwise(F.concat(F.lit(" "), "source")).alias("client_id"),
        F.when(F.col("toxic") == 1, F.lit("")).otherwise(F.concat("lang", F.lit(" "))).alias("age"),
        F.concat(F.lit("said "), F.col("n_chars").cast("string")).alias("sentence"),
    )
    writers.write_metadata_tsv(rows, f"{root}/meta.tsv", "path")
    clips = docs.where(F.col("n_chars") % 3 != 1).select(F.concat(F.lit("/data/clips/"), name).alias("path"))
    return tabular.read_labeled_clips(spark, f"{root}/meta.tsv", clips, root="/data/clips/", label="age")


SQL_LABELED = """
SELECT '/data/clips/c' || d.doc_id || '.mp3' AS path, 'c' || d.doc_id AS id, source AS speaker, lang AS age, 'said ' || n_chars AS text
FROM documents d LEFT JOIN labels l USING (doc_id)
WHERE n_chars % 3 <> 1 AND quality IS DISTINCT FROM 1 AND toxic IS DISTINCT FROM 1 AND trim(source) <> '' AND trim(lang) <> ''
"""


def overlapping_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline audio in files that two of three patterns match, each file read once."""
    root = scratch_path(spark, "globs")
    docs = table(spark, sf_dir, "documents").select(
        F.struct(F.col("text").cast("binary").alias("bytes"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("path")).alias("audio"),
        F.col("text").alias("transcript"), F.col("source").alias("client_id"),
    )
    docs.write.parquet(f"{root}/a")
    docs.write.parquet(f"{root}/b")
    read = tabular.read_parquet_audio(
        spark, root, ["*.parquet", "part-*", "*.none"], dataset="g", language="xx"
    )
    return read.groupBy(F.col("speaker_id").alias("source")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.sum(F.length("audio_bytes")).alias("audio_len"),
        F.count("text").alias("texts"),
    )


SQL_GLOBS = """
SELECT source, 2 * count(*) AS n, count(DISTINCT doc_id) AS ids, 2 * sum(strlen(text))::BIGINT AS audio_len, 2 * count(text) AS texts
FROM documents GROUP BY source
"""


def resolved_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative, absolute and missing paths against an inventory below a root and its parent."""
    no = F.col("doc_id")
    name = F.concat(F.lit("d"), no.cast("string"), F.lit(".flac"))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(no % 5 == 0, F.concat(F.lit("/else/"), name)).otherwise(name).alias("audio_filepath")
    )
    stored = F.when(no % 4 == 1, F.concat(F.lit("/corpus/set/"), name)).when(no % 4 == 2, F.concat(F.lit("/corpus/"), name))
    files = table(spark, sf_dir, "documents").select(stored.alias("path")).where("path is not null")
    return clean.resolve_paths(docs, files, root="/corpus/set/").select("doc_id", "resolved")


SQL_RESOLVED = """
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '/else/d' || doc_id || '.flac' WHEN doc_id % 4 = 1 THEN '/corpus/set/d' || doc_id || '.flac'
                    WHEN doc_id % 4 = 2 THEN '/corpus/d' || doc_id || '.flac' END AS resolved FROM documents
"""


# -- logs as files ----------------------------------------------------------


def metric_log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log file per run, read line by line, the last value of each (run, step, key)."""
    path = scratch_path(spark, "logs")
    log = event_log(spark, sf_dir, step_width=16, runs=3)
    line = F.to_json(F.create_map(F.lit("step"), F.col("step").cast("double"), F.col("key"), F.col("value")))
    plain = F.regexp_replace(line, r'"step":(\d+)\.0', r'"step":$1')
    log.select("run", "seq", plain.alias("value")).repartition("run").sortWithinPartitions("run", "seq").select(
        "value", "run").write.partitionBy("run").text(path)
    read = results.read_metric_log(spark, path).withColumn("run", F.regexp_replace("run", "^run=", ""))
    merged = runlogs.merge_rows(read.withColumn("value", F.col("value").cast("double")))
    return merged.select("run", "step", "key", "value")


SQL_METRIC_LOG = """
SELECT 'run' || user_id % 3 AS run, event_id // 16 AS step, event_type AS key, arg_max(value, event_id) AS value FROM events GROUP BY ALL
"""


def _streamed(spark: SparkSession, sf_dir: str, name: str):
    root = scratch_path(spark, name)
    event_log(spark, sf_dir, step_width=4, runs=2).repartition(5, "seq").write.json(f"{root}/in")
    return root, logs.read_log_stream(spark, f"{root}/in", files_per_batch=2)


def _last_state(df: DataFrame, root: str, mode: str) -> None:
    """Write each batch of results below ``root``/out, all of them in update mode."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch_id={0 if mode == 'complete' else batch_id}")

    query = (
        df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def window_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric means per six-hour window of a stream."""
    root, stream = _streamed(spark, sf_dir, "windows")
    _last_state(logs.window_means(stream, window="6 hours"), root, "complete")
    out = spark.read.parquet(f"{root}/out").select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "key", "mean", "count")
    return rounded(out, "mean")


SQL_WINDOWS = f"""
SELECT strftime(time_bucket(INTERVAL 6 hours, ts::TIMESTAMP, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS window_start, event_type AS key,
       {sql_round('avg(value)')} AS mean, count(*) AS count FROM events GROUP BY ALL
"""


def interval_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval means of a stream as it stands when the files are read."""
    root, stream = _streamed(spark, sf_dir, "intervals")
    _last_state(logs.interval_stream(stream, 50), root, "complete")
    return rounded(spark.read.parquet(f"{root}/out").select("interval", "run", "key", "mean", "max", "count"), "mean")


SQL_INTERVALS = f"""
SELECT event_id // 4 // 50 AS interval, 'run' || user_id % 2 AS run, event_type AS key, {sql_round('avg(value)')} AS mean,
       max(value) AS max, count(value) AS count FROM events GROUP BY ALL
"""


def counter_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters that a stream keeps across its batches: the last total of each."""
    root, stream = _streamed(spark, sf_dir, "counters")
    _last_state(logs.cumulative_counters(stream), root, "update")
    out = spark.read.parquet(f"{root}/out")
    return out.groupBy("run", "key").agg(F.max("total").alias("total"), F.sum("added").alias("added"))


SQL_COUNTERS = """
SELECT 'run' || user_id % 2 AS run, event_type AS key, count(*) AS total, count(*) AS added FROM events GROUP BY ALL
"""


# -- crops, orders, bins ----------------------------------------------------


def cropped_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty samples from the start and from a drawn place; some signals are shorter."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", vectors.as_double(F.col("embedding")).alias("x"))
    cut = rows.withColumn("x", F.when(F.col("vec_id") % 6 == 0, F.slice("x", 1, 25)).otherwise(F.col("x")))
    begun = cut.withColumn("head", vectors.start_crop(F.col("x"), 40))
    drawn = signals.random_crop(begun, key="vec_id", samples="x", n=40, seed=29)
    out = drawn.select(
        "vec_id", F.size("head").alias("head_size"), F.size("x").alias("size"), vectors.total(F.col("head")).alias("head_total"),
        vectors.total(F.col("x")).alias("total"),
    )
    return rounded(out, "head_total", "total")


SQL_CROPS = f"""
WITH c AS (SELECT vec_id, CASE WHEN vec_id % 6 = 0 THEN (embedding::DOUBLE[])[1:25] ELSE embedding::DOUBLE[] END AS x, {sql_hash(29, 'crop', 'vec_id')} AS h FROM embeddings),
s AS (SELECT *, floor({_sql_uniform('h', 1)} * (greatest(len(x) - 40, 0) + 1))::BIGINT AS start FROM c)
SELECT vec_id, 40 AS head_size, 40 AS size, {sql_round('list_sum(x[1:40])')} AS head_total, {sql_round('list_sum(x[start + 1:start + 40])')} AS total FROM s
"""


def seeded_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its place in the seeded order, in that order."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sampling.permute(sampling.with_permutation(docs, "doc_id", 31), "doc_id", 31)


SQL_ORDER = f"""
SELECT doc_id, row_number() OVER (ORDER BY {sql_hash(31, 'permute', 'doc_id')}, doc_id) - 1 AS pos FROM documents
"""


def normalized_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectral frames brought to zero mean and unit deviation per item and bin."""
    long = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(vectors.as_double(F.col("embedding"))).alias("k", "value"))
    binned = long.select("vec_id", F.floor(F.col("k") / 8).cast("int").alias("frame"), (F.col("k") % 8).alias("bin"), "value")
    return rounded(embeddings.normalize_item(binned, item="vec_id", bin_col="bin", value="value"), "value")


SQL_BINS = f"""
WITH x AS (SELECT vec_id, unnest(range(64)) AS k, unnest(embedding::DOUBLE[]) AS v FROM embeddings),
s AS (SELECT vec_id, k % 8 AS b, avg(v) AS m, stddev_samp(v) AS s FROM x GROUP BY ALL)
SELECT x.vec_id, (k // 8)::INTEGER AS frame, (k % 8)::INTEGER AS bin, {sql_round('(v - m) / (s + 1e-5)')} AS value
FROM x JOIN s ON s.vec_id = x.vec_id AND s.b = k % 8
"""


def pair_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built-in and user metrics of sample pairs, failures kept as rows."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", vectors.as_double(F.col("embedding")).alias("x"))
    pairs = rows.withColumn("y", F.transform("x", lambda v, i: v * 0.5 + (i % 3) * 0.01))

    def worst(x: np.ndarray, y: np.ndarray) -> float:
        if x[0] < 0:
            raise ValueError("starts below zero")
        return float(np.abs(x - y).max())

    out = signals.evaluate_pairs(pairs, item="vec_id", reference="x", estimate="y", metrics={"worst": worst})
    return rounded(out.where(F.col("metric").isin("wav_l1", "worst")).withColumnRenamed("item_id", "vec_id"), "value")


SQL_PAIRS_METRICS = f"""
WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS x, list_transform(embedding::DOUBLE[], lambda v, i : v * 0.5::DOUBLE + ((i - 1) % 3) * 0.01::DOUBLE) AS y FROM embeddings),
d AS (SELECT vec_id, x, list_transform(x, lambda v, i : abs(v - y[i])) AS d FROM p)
SELECT vec_id, 'wav_l1' AS metric, {sql_round('list_sum(d) / len(d)')} AS value, NULL::VARCHAR AS error FROM d
UNION ALL SELECT vec_id, 'worst', CASE WHEN x[1] >= 0 THEN {sql_round('list_max(d)')} END, CASE WHEN x[1] < 0 THEN 'ValueError: starts below zero' END FROM d
"""


def transcript_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first transcripts of a report, by key (a top-k report)."""
    rows = transcript_entries(spark, sf_dir).where("system = 'base' and seed = '0'").select("unit_id", "reference", "hypothesis")
    return asr.examples(rows, "unit_id", 7)


SQL_EXAMPLES = r"""
WITH w AS (SELECT conv_id || ':' || turn AS unit_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM conversations)
SELECT unit_id, array_to_string(w, ' ') AS reference,
       array_to_string(list_filter(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i % 4 <> 0 THEN w[i] END), lambda x: x IS NOT NULL), ' ') AS hypothesis
FROM w ORDER BY unit_id LIMIT 7
"""


# -- stored statistics ------------------------------------------------------


def turn_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and words of every turn under two systems."""
    turns = table(spark, sf_dir, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("unit_id"), F.length("text").cast("double").alias("chars"), F.col("turn").cast("double").alias("turn")
    )
    systems = F.explode(F.array(*[F.struct(F.lit(s).alias("system"), F.lit(o).alias("ord"), F.lit(g).alias("gain")) for s, o, g in (("base", 0, 1.0), ("tuned", 1, 1.25))]))
    wide = turns.select("unit_id", "chars", "turn", systems.alias("s")).select("unit_id", "chars", "turn", "s.*")
    metrics = F.explode(
        F.array(
            F.struct(F.lit("chars").alias("metric"), (F.col("chars") * F.col("gain")).alias("value")),
            F.struct(F.lit("turn").alias("metric"), (F.col("turn") + F.col("gain")).alias("value")),
        )
    )
    return wide.select("system", "ord", F.lit("none").alias("seed"), "unit_id", metrics.alias("m")).select("system", "ord", "seed", "unit_id", "m.*")


def stored_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analysis of a named task, written with its settings and read back."""
    path = scratch_path(spark, "statistics")
    found = bootstrap.analyze({"reconstruction:turns": turn_entries(spark, sf_dir)}, replicates=REPLICATES, seed=37)
    writers.write_statistics(found, path, seed=37, replicates=REPLICATES, confidence=0.95)
    stored = spark.read.parquet(path)
    out = stored.select(
        "task", "metric", "kind", "system", "minus", "estimate", "ci_low", "ci_high", "replicates", "bootstrap_seed", "schema_version"
    )
    return rounded(out, "estimate", "ci_low", "ci_high")


SQL_STORED_ANALYSIS = f"""
WITH units AS (
  SELECT conv_id || ':' || turn AS unit_id, length(text)::DOUBLE AS chars, turn::DOUBLE AS turn,
         row_number() OVER (ORDER BY {sql_hash(37, 'unit', "conv_id || ':' || turn")}, conv_id || ':' || turn) - 1 AS pos FROM conversations),
{sql_draws('units', REPLICATES, 37)},
sums AS (SELECT replicate, avg(chars) AS chars, avg(turn) AS turn FROM draws JOIN units USING (pos) GROUP BY replicate
         UNION ALL SELECT -1, avg(chars), avg(turn) FROM units),
cells AS (SELECT * FROM (VALUES ('base', 0, 1.0::DOUBLE), ('tuned', 1, 1.25::DOUBLE)) s(system, ord, gain)),
both_ AS (SELECT 'chars' AS metric, system, ord, replicate, chars * gain AS value FROM sums, cells
          UNION ALL SELECT 'turn', system, ord, replicate, turn + gain FROM sums, cells),
points AS (SELECT metric, system, ord, value FROM both_ WHERE replicate = -1),
boot AS (SELECT metric, system, ord, replicate, value FROM both_ WHERE replicate >= 0),
summary AS (WITH {_sql_summary('points', 'boot').strip()})
SELECT 'reconstruction:turns' AS task, metric, kind, system, minus, estimate, ci_low, ci_high, {REPLICATES} AS replicates, 37 AS bootstrap_seed,
       'paired-bootstrap-v1' AS schema_version FROM summary
"""


def trial_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials of both systems stored as Parquet, read as trial tables, scored."""
    root = scratch_path(spark, "trials")
    entries = cut_lineage(trial_entries(spark, sf_dir), "entries")
    out = None
    for system in ("plain", "root"):
        entries.where(F.col("system") == system).drop("system", "ord", "seed").write.parquet(f"{root}/{system}")
        read = results.read_trials(spark, f"{root}/{system}")
        one = verify.verification_metrics(read).withColumn("system", F.lit(system)).withColumn("n", F.lit(read.count()).cast("long"))
        out = one if out is None else out.unionByName(one)
    return rounded(out, "eer", "min_dcf")


SQL_TRIAL_TABLE = f"""
WITH {SQL_CAPPED},
models AS (SELECT 'plain' AS system, vec_id, embedding AS x FROM utterances
           UNION ALL SELECT 'root', vec_id, list_transform(embedding, lambda e: sign(e) * sqrt(abs(e))) FROM utterances),
unit_ AS (SELECT system, vec_id, list_transform(x, lambda e: e / (sqrt(list_dot_product(x, x)) + 1e-8)) AS u FROM models),
scored AS (SELECT a.system, label, round(list_dot_product(a.u, b.u), 12) AS score
           FROM trials JOIN unit_ a ON a.vec_id = "left" JOIN unit_ b ON b.vec_id = "right" AND a.system = b.system),
{sql_eer('scored', 'system')},
counted AS (SELECT system, count(*) AS n FROM scored GROUP BY system)
SELECT system, n, {sql_round('eer')} AS eer, {sql_round('min_dcf')} AS min_dcf FROM metrics JOIN counted USING (system)
"""

QUERIES = {
    f.__name__: f
    for f in (
        labeled_clips, overlapping_globs, resolved_paths, metric_log_files, window_stream, interval_stream, counter_stream,
        cropped_signals, seeded_order, normalized_bins, pair_metrics, transcript_examples, stored_analysis, trial_table,
    )
}

ORACLES = {
    "labeled_clips": SQL_LABELED,
    "overlapping_globs": SQL_GLOBS,
    "resolved_paths": SQL_RESOLVED,
    "metric_log_files": SQL_METRIC_LOG,
    "window_stream": SQL_WINDOWS,
    "interval_stream": SQL_INTERVALS,
    "counter_stream": SQL_COUNTERS,
    "cropped_signals": SQL_CROPS,
    "seeded_order": SQL_ORDER,
    "normalized_bins": SQL_BINS,
    "pair_metrics": SQL_PAIRS_METRICS,
    "transcript_examples": SQL_EXAMPLES,
    "stored_analysis": SQL_STORED_ANALYSIS,
    "trial_table": SQL_TRIAL_TABLE,
}
