"""Queries over manifests: union, identity, joins, splits, profiles, round trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterset.functions import paths
from utterset.functions import text as tx
from utterset.functions.hashing import positional_item_id
from utterset.operators import asr, classify, clean, joins, reports, sampling
from utterset.queries.common import (
    SQL_UTTERANCES,
    rounded,
    sql_hash,
    sql_round,
    table,
    utterances,
)
from utterset.schemas import as_manifest
from utterset.session import scratch_path
from utterset.sinks import writers
from utterset.sources import manifest as manifests
from utterset.sources import registry, results, tabular


def document_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return as_manifest(
        docs,
        audio_filepath=F.concat(F.lit("audio/"), F.col("doc_id").cast("string"), F.lit(".flac")),
        duration=F.col("n_chars") / 100.0,
        dataset="source",
        id="doc_id",
        language="lang",
    )


# -- union and identity -----------------------------------------------------


def manifest_union_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        F.col("source").alias("dataset"), F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("speaker_id")
    )
    pages = table(spark, sf_dir, "pages").select(
        F.lit("pages").alias("dataset"), F.col("page_id").cast("string").alias("id"),
        F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("speaker_id"),
    )
    turns = clean.resolve_aliases(
        table(spark, sf_dir, "conversations").withColumnRenamed("role", "speaker"), {"speaker_id": ("speaker_id", "speaker")}
    ).select(F.lit("conversations").alias("dataset"), F.concat_ws(":", "conv_id", "turn").alias("id"), "speaker_id")
    return joins.corpus_counts(joins.union_sources([docs, pages, turns]))


def sample_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in English keep their ID; other rows are named by content."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("source").alias("dataset"),
        F.when(F.col("lang") == "en", F.col("doc_id").cast("string")).alias("id"),
        "doc_id", "text",
    )
    pages = table(spark, sf_dir, "pages").select(
        F.lit(None).cast("string").alias("dataset"), F.col("page_id").cast("string").alias("id"),
        F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"),
    )
    return clean.with_sample_id(docs.unionByName(pages)).select("sample_id", "source_dataset", "member_key")


SQL_IDENTITY = """
WITH r AS (SELECT source AS dataset, CASE WHEN lang = 'en' THEN doc_id::VARCHAR END AS id, doc_id, text FROM documents
           UNION ALL SELECT NULL, page_id::VARCHAR, NULL, NULL FROM pages),
n AS (SELECT coalesce(dataset, 'unknown') AS source_dataset, id,
             sha256(to_json({'dataset': dataset, 'doc_id': doc_id, 'id': id, 'text': text})::VARCHAR) AS digest FROM r),
s AS (SELECT source_dataset, source_dataset || ':' || coalesce(id, 'sha256:' || digest) AS sample_id FROM n)
SELECT sample_id, source_dataset, sha256(sample_id) AS member_key FROM s
"""


def id_and_path_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    audio = F.concat(path, F.when(F.pmod("page_id", F.lit(3)) == 0, ".WAV").when(F.pmod("page_id", F.lit(3)) == 1, ".mp4").otherwise(""))
    given = F.when(F.pmod("page_id", F.lit(4)) == 0, F.concat(F.lit("utt"), F.col("page_id").cast("string"), F.lit(".x.flac")))
    return pages.select(
        "page_id",
        paths.derive_id(given, audio, F.col("url")).alias("derived_id"),
        paths.extension(audio).alias("ext"),
        paths.is_safe(audio).alias("safe"),
        paths.is_safe(F.concat(F.lit("a/../"), audio)).alias("escaping"),
        positional_item_id(F.col("page_id"), audio).alias("item_id"),
    )


SQL_PATHS = r"""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') ||
             CASE page_id % 3 WHEN 0 THEN '.WAV' WHEN 1 THEN '.mp4' ELSE '' END AS audio FROM pages),
b AS (SELECT *, regexp_extract(audio, '([^/]*)/*$', 1) AS base FROM p),
s AS (SELECT *, regexp_extract(base, '^.+(\.[^.]+)$', 1) AS suf FROM b)
SELECT page_id,
       CASE WHEN page_id % 4 = 0 THEN 'utt' || page_id || '.x' ELSE substr(base, 1, length(base) - length(suf)) END AS derived_id,
       CASE WHEN lower(suf) IN ('.flac', '.wav', '.mp3', '.ogg', '.opus') THEN lower(suf) ELSE '.flac' END AS ext,
       true AS safe, false AS escaping,
       'item_' || lpad(page_id::VARCHAR, 6, '0') || '_' || substr(sha256(audio), 1, 12) AS item_id
FROM s
"""


# -- joins ------------------------------------------------------------------


def metadata_left_join_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second, preferred metadata table covers every third label row."""
    labels = table(spark, sf_dir, "labels")
    preferred = labels.where(F.pmod("doc_id", F.lit(3)) == 0).select(
        "doc_id", (1 - F.col("quality")).alias("quality"), "toxic", F.lit(0).alias("priority")
    )
    meta = preferred.unionByName(labels.select("doc_id", "quality", "toxic", F.lit(1).alias("priority")))
    files = table(spark, sf_dir, "documents").select("doc_id", "source")
    return joins.attach_metadata(files, meta, "doc_id", ["quality", "toxic"], ["priority", "quality", "toxic"])


SQL_METADATA = """
WITH m AS (SELECT doc_id, 1 - quality AS quality, toxic, 0 AS priority FROM labels WHERE doc_id % 3 = 0
           UNION ALL SELECT doc_id, quality, toxic, 1 FROM labels),
w AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY priority, quality, toxic) = 1)
SELECT doc_id, source, quality, toxic FROM documents LEFT JOIN w USING (doc_id)
"""


def existing_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a clip in an inventory derived from the labels."""
    stem = F.concat(F.lit("clips/"), F.col("doc_id").cast("string"))
    ext = F.when(F.col("quality") == 1, F.lit(".mp3")).otherwise(F.lit(".wav"))
    one = table(spark, sf_dir, "labels").select(F.concat(stem, ext).alias("path"))
    both = table(spark, sf_dir, "labels").where(F.col("toxic") == 1).select(F.concat(stem, F.lit(".wav")).alias("path"))
    docs = table(spark, sf_dir, "documents").select("doc_id", stem.alias("stem"))
    return joins.existing_with_extension(docs, one.unionByName(both), stem="stem").select("doc_id", "path")


SQL_EXISTING = """
WITH inv AS (SELECT 'clips/' || doc_id || CASE WHEN quality = 1 THEN '.mp3' ELSE '.wav' END AS path FROM labels
             UNION SELECT 'clips/' || doc_id || '.wav' FROM labels WHERE toxic = 1),
c AS (SELECT doc_id, 'clips/' || doc_id || ext AS path, r FROM documents, (VALUES ('', 0), ('.wav', 1), ('.mp3', 2), ('.flac', 3)) e(ext, r))
SELECT doc_id, arg_min(path, r) AS path FROM c JOIN inv USING (path) GROUP BY doc_id
"""


def known_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dev rows restricted to training labels, with their class index."""
    rows = sampling.holdout_per_group(
        utterances(spark, sf_dir).select("vec_id", "speaker", "label"), "vec_id", "speaker", 2, 23
    )
    train = rows.where((F.col("role") == "train") & (F.col("label") != 7))
    kept, _ = classify.restrict_labels(rows.where(F.col("role") == "test"), train, "label")
    return joins.lookup(kept.select("vec_id", "speaker", "label"), classify.label_map(train, "label"), "label")


SQL_KNOWN = f"""
WITH {SQL_UTTERANCES},
r AS (SELECT vec_id, speaker, label, row_number() OVER (PARTITION BY speaker ORDER BY {sql_hash(23, 'holdout', 'vec_id')}, vec_id) AS rn,
             count(*) OVER (PARTITION BY speaker) AS n FROM utterances),
s AS (SELECT *, rn <= least(2, n - 1) AS test FROM r),
known AS (SELECT label, (row_number() OVER (ORDER BY label) - 1)::INTEGER AS class_index
          FROM (SELECT DISTINCT label FROM s WHERE NOT test AND label <> 7))
SELECT vec_id, speaker, label, class_index FROM s JOIN known USING (label) WHERE test
"""


# -- splits and samples -----------------------------------------------------


def split_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("dataset"))
    return sampling.split_by_source(docs, "doc_id", val_pct=0.05, seed=42)


def sql_split(columns: str) -> str:
    return f"""
split_rows AS (
  SELECT {columns}, CASE WHEN rn <= CASE WHEN n > 1 THEN greatest(1, round_even(n * 0.05::DOUBLE, 0)) ELSE 0 END
                 THEN 'val' ELSE 'train' END AS split
  FROM (SELECT *, source AS dataset, count(*) OVER (PARTITION BY source) AS n,
               row_number() OVER (PARTITION BY source ORDER BY {sql_hash(42, 'split', 'doc_id')}, doc_id) AS rn FROM documents))
"""


def holdout_per_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = utterances(spark, sf_dir).select("vec_id", "speaker")
    return sampling.holdout_per_group(rows, "vec_id", "speaker", 5, 29)


SQL_HOLDOUT = f"""
WITH {SQL_UTTERANCES}
SELECT vec_id, speaker::BIGINT AS speaker, CASE WHEN rn <= least(5, n - 1) THEN 'test' ELSE 'train' END AS role
FROM (SELECT *, count(*) OVER (PARTITION BY speaker) AS n,
             row_number() OVER (PARTITION BY speaker ORDER BY {sql_hash(29, 'holdout', 'vec_id')}, vec_id) AS rn FROM utterances)
"""


def group_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, speakers and split fingerprint of every user-disjoint fold."""
    rows = sampling.group_kfold(table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", 5, 31)
    sizes = rows.groupBy("fold").agg(F.count_distinct("user_id").alias("speakers"))
    return reports.fingerprint(rows, ["event_id", "user_id", "fold"], ["fold"]).join(sizes, "fold")


def sql_fingerprint(relation: str, columns: list[str], group: str) -> str:
    row = " || chr(31) || ".join(f"{c}::VARCHAR" for c in columns)
    sums = ", ".join(
        f"sum(('0x' || substr(d, {1 + 8 * i}, 8))::UBIGINT)::HUGEINT AS w{i}" for i in range(4)
    )
    return f"""
SELECT {group}, n_rows, sha256(concat_ws(':', n_rows, w0, w1, w2, w3)) AS fingerprint FROM (
  SELECT {group}, count(*) AS n_rows, {sums} FROM (SELECT {group}, sha256({row}) AS d FROM {relation}) GROUP BY {group})
"""


SQL_KFOLD = f"""
WITH folds AS (SELECT user_id, (ntile(5) OVER (ORDER BY {sql_hash(31, 'fold', 'user_id')}, user_id) - 1)::INTEGER AS fold
               FROM (SELECT DISTINCT user_id FROM events)),
r AS (SELECT event_id, user_id, fold FROM events JOIN folds USING (user_id)),
f AS ({sql_fingerprint('r', ['event_id', 'user_id', 'fold'], 'fold')})
SELECT fold, n_rows, fingerprint, speakers FROM f JOIN (SELECT fold, count(DISTINCT user_id) AS speakers FROM r GROUP BY fold) USING (fold)
"""


def sample_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    return sampling.sample_groups(
        events, "event_id", "user_id", min_rows=2, max_rows=6, total=300, seed=37
    )


SQL_SAMPLE_GROUPS = f"""
WITH r AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id) AS n,
             row_number() OVER (PARTITION BY user_id ORDER BY {sql_hash(37, 'row', 'event_id')}, event_id) AS rn FROM events),
k AS (SELECT *, {sql_hash(37, 'group', 'user_id')} AS gh FROM r WHERE n >= 2 AND rn <= 6),
o AS (SELECT event_id, user_id, row_number() OVER (ORDER BY gh, user_id, rn) AS order_no FROM k)
SELECT event_id, user_id, order_no FROM o WHERE order_no <= 300
"""


def sample_exact_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return sampling.sample_exact(docs, "doc_id", 7, by=["source"], seed=41)


def capped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    per_lang = sampling.cap_rows(docs, "doc_id", 40, by="lang", seed=43).withColumn("cap", F.lit("lang"))
    whole = sampling.cap_rows(docs, "doc_id", 100, seed=43).withColumn("cap", F.lit("all"))
    return per_lang.unionByName(whole)


SQL_CAPPED_ROWS = f"""
WITH h AS (SELECT doc_id, source, lang, {sql_hash(43, 'cap', 'doc_id')} AS h FROM documents)
SELECT doc_id, source, lang, 'lang' AS cap FROM h QUALIFY row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) <= 40
UNION ALL
SELECT doc_id, source, lang, 'all' FROM (SELECT * FROM h ORDER BY h, doc_id LIMIT 100)
"""


def blind_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items found in three conditions, presented under blinded codes."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    a = docs.select("doc_id", F.lit("raw").alias("condition"), F.sha2("text", 256).alias("digest"))
    b = docs.join(labels.select("doc_id"), "doc_id", "left_semi").select(
        "doc_id", F.lit("small").alias("condition"), F.sha2("text", 256).alias("digest")
    )
    c = docs.join(labels.where(F.col("quality") == 1).select("doc_id"), "doc_id", "left_semi").select(
        "doc_id", F.lit("large").alias("condition"), F.sha2("text", 256).alias("digest")
    )
    every = a.unionByName(b).unionByName(c)
    shared = sampling.common_items(every, "doc_id", "condition", "digest").where("same_original")
    return sampling.blind_design(
        shared, every.select("condition").distinct(), item="doc_id", condition="condition", num_items=20, seed=20
    )


SQL_BLIND = f"""
WITH shared AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id IN (SELECT doc_id FROM documents)),
picked AS (SELECT doc_id, row_number() OVER (ORDER BY h, doc_id) AS item_no FROM
           (SELECT doc_id, {sql_hash(20, 'item', 'doc_id')} AS h FROM shared ORDER BY h, doc_id LIMIT 20)),
opts AS (SELECT item_no, doc_id, code, row_number() OVER (PARTITION BY doc_id ORDER BY {sql_hash(20, 'option', 'doc_id', 'code')}, code) AS k
         FROM picked, (VALUES ('C01'), ('C02'), ('C03')) c(code))
SELECT 'item_' || lpad(item_no::VARCHAR, 3, '0') AS item_name, doc_id,
       max(code) FILTER (k = 1) AS option_1, max(code) FILTER (k = 2) AS option_2, max(code) FILTER (k = 3) AS option_3
FROM opts GROUP BY item_no, doc_id
"""


# -- durations and text -----------------------------------------------------


def duration_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select((F.col("n_chars") / 100.0).alias("duration"))
    return clean.duration_profile(docs)


SQL_PROFILE = """
WITH s AS (SELECT n_chars / 100.0::DOUBLE AS v, row_number() OVER (ORDER BY n_chars) - 1 AS i, count(*) OVER () AS n FROM documents)
SELECT max(n) AS n, max(v) AS max,
       count(*) FILTER (v <= 2.5) AS le_2_5, count(*) FILTER (v <= 5) AS le_5, count(*) FILTER (v <= 10) AS le_10, count(*) FILTER (v <= 15) AS le_15,
""" + ",\n".join(
    f"max(v) FILTER (i = round_even({q / 100.0}::DOUBLE * (n - 1), 0)) AS p{q}" for q in (5, 25, 50, 75, 95, 99)
) + " FROM s"


def duration_filter_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared durations are missing or zero for some rows, texts for others."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select(
        "doc_id",
        F.when(F.col("toxic") == 0, F.lit("  \n")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("quality") == 1, 0.0).when(F.col("quality") == 0, 3.0).alias("duration"),
        (F.col("n_chars") / 100.0).alias("actual"),
    )
    _, report = clean.filter_by_duration(docs, 15.0, actual=F.col("actual"), text="text")
    return report


SQL_DURATION_FILTER = """
WITH r AS (SELECT CASE WHEN toxic = 0 THEN false ELSE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' END AS usable,
                  n_chars / 100.0::DOUBLE <= 15 AS fits, (quality = 1 OR quality IS NULL) AS unknown
           FROM documents LEFT JOIN labels USING (doc_id))
SELECT count(*) FILTER (usable AND fits) AS kept, count(*) FILTER (usable AND NOT fits) AS dropped,
       count(*) FILTER (usable AND unknown) AS unknown, count(*) FILTER (NOT usable) AS missing_text FROM r
"""


def charset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asr.build_charset(table(spark, sf_dir, "documents"))


SQL_CHARSET = """
SELECT '<blank>' AS symbol, 0 AS code
UNION ALL
SELECT symbol, row_number() OVER (ORDER BY symbol)::INTEGER FROM (
  SELECT DISTINCT unnest(string_split(lower(text), '')) AS symbol FROM documents) WHERE symbol <> '' AND symbol <> chr(10)
"""


def target_feasibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded texts against the frames of their utterance, per language."""
    docs = table(spark, sf_dir, "documents").select(
        "lang", "text", F.floor(F.col("n_chars") * 1.05).cast("long").alias("frames")
    )
    # the alphabet of the English texts alone: what it lacks is dropped
    encoded = asr.encode_text(docs, asr.build_charset(docs.where(F.col("lang") == "en")))
    return rounded(asr.ctc_feasibility(encoded, "codes", "frames", 1, ["lang"]), "percent_infeasible")


SQL_FEASIBILITY = f"""
WITH c AS (SELECT lang, floor(n_chars * 1.05)::BIGINT AS frames,
                  list_filter(string_split(lower(text), ''), lambda x: list_contains(k, x)) AS s
           FROM documents, (SELECT list(DISTINCT s) AS k FROM (
             SELECT unnest(string_split(lower(text), '')) AS s FROM documents WHERE lang = 'en') WHERE s <> '' AND s <> chr(10))),
m AS (SELECT lang, frames, len(s) + len(list_filter(range(2, len(s) + 1), lambda i: s[i] = s[i - 1])) AS need FROM c)
SELECT lang, count(*) AS targets, count(*) FILTER (need > frames) AS infeasible,
       {sql_round('100.0 * count(*) FILTER (need > frames) / count(*)')} AS percent_infeasible FROM m GROUP BY lang
"""


def token_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-path decoding of event types, 50 frames to an utterance."""
    frames = table(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / 50).alias("utt"), F.pmod("event_id", F.lit(50)).alias("frame"),
        F.col("event_type").alias("token"),
    )
    kept = asr.collapse_tokens(frames, utt="utt", frame="frame", token="token", blank="view")
    # an utterance has at most 50 frames
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("frame", "token"))), lambda x: x["token"])
    return kept.groupBy("utt").agg(ordered.alias("tokens")).select(
        "utt", F.array_join("tokens", " ").alias("hypothesis"), asr.min_frames(F.col("tokens")).alias("needed_frames")
    )


SQL_COLLAPSE = """
WITH f AS (SELECT event_id // 50 AS utt, event_id % 50 AS frame, event_type AS token,
             lag(event_type) OVER (PARTITION BY event_id // 50 ORDER BY event_id) AS prev FROM events),
k AS (SELECT utt, list(token ORDER BY frame) AS t FROM f WHERE token <> 'view' AND token IS DISTINCT FROM prev GROUP BY utt)
SELECT utt, array_to_string(t, ' ') AS hypothesis,
       (len(t) + len(list_filter(range(2, len(t) + 1), lambda i: t[i] = t[i - 1])))::BIGINT AS needed_frames FROM k
"""


def null_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NaN, 'nan', '' and null kept apart."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select(
        "doc_id",
        F.when(F.col("quality") == 1, F.lit(float("nan"))).when(F.col("quality") == 0, F.col("n_chars") / 100.0).alias("duration"),
        F.when(F.col("quality") == 1, F.lit("")).when(F.col("toxic") == 1, F.lit("NaN")).when(F.col("toxic") == 0, F.col("lang")).alias("text"),
    )
    out = clean.normalize_nulls(docs, ["duration"], ["text"])
    state = F.when(F.col("text").isNull(), "null").when(F.col("text") == "", "empty").otherwise("text")
    return rounded(
        out.groupBy(state.alias("text_state")).agg(
            F.count(F.lit(1)).alias("n_rows"), F.count("duration").alias("durations"),
            F.coalesce(F.sum("duration"), F.lit(0.0)).alias("seconds"),
        ),
        "seconds",
    )


SQL_NULLS = f"""
WITH r AS (SELECT CASE WHEN quality = 0 THEN n_chars / 100.0::DOUBLE END AS duration,
                  CASE WHEN quality = 1 THEN '' WHEN toxic = 1 THEN NULL WHEN toxic = 0 THEN lang END AS text
           FROM documents LEFT JOIN labels USING (doc_id))
SELECT CASE WHEN text IS NULL THEN 'null' WHEN text = '' THEN 'empty' ELSE 'text' END AS text_state,
       count(*) AS n_rows, count(duration) AS durations, {sql_round('coalesce(sum(duration), 0)')} AS seconds FROM r GROUP BY 1
"""


# -- provenance -------------------------------------------------------------


def build_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("dataset"))
    return writers.build_meta(sampling.split_by_source(docs, "doc_id"), val_pct=0.05, seed=42)


SQL_BUILD_META = f"""
WITH {sql_split('doc_id, dataset')}
SELECT dataset, count(*) AS raw_count, count(*) FILTER (split = 'train') AS train_rows, count(*) FILTER (split = 'val') AS val_rows,
       0.05::DOUBLE AS val_pct, 42 AS seed FROM split_rows GROUP BY dataset
"""


def inventory_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, written out with broken lines, read strictly."""
    good = document_manifest(spark, sf_dir)
    line = F.to_json(F.struct(*good.columns))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"), "quality", "toxic")
    marked = good.join(labels, "id", "left")
    broken = (
        F.when((F.col("quality") == 0) & (F.col("toxic") == 1), F.concat(F.lit('{"id": '), "id", F.lit(', "audio_filepath": ')))
        .when(F.col("toxic") == 1, F.concat(F.lit('["'), "id", F.lit('"]')))
        .when(F.col("quality") == 0, F.concat(F.lit('{"audio_filepath": "", "id": "'), "id", F.lit('"}')))
        .when(F.col("quality") == 1, F.concat(F.lit('{"audio_filepath": "x.flac", "duration": NaN, "id": "'), "id", F.lit('"}')))
    )
    twice = F.when(F.col("quality").isNull() & (F.col("language") == "en"), F.lit(2)).otherwise(F.lit(1))
    # broken lines stand twice too: equal ones are told apart by their numbers
    twice = F.when(broken.isNotNull(), F.lit(2)).otherwise(twice)
    lines = marked.select("dataset", F.col("id").cast("long").alias("no"), F.explode(F.array_repeat(F.coalesce(broken, line), twice)).alias("value"))
    path = scratch_path(spark, "inventory")
    lines.repartition("dataset").sortWithinPartitions("dataset", "no").select("value", "dataset").write.partitionBy("dataset").text(path)
    rows, found = manifests.read_inventory(spark, path)
    unsafe = manifests.unsafe_paths(
        rows.where(F.col("language") == "de").select(
            F.concat(F.lit("../"), "audio_filepath").alias("audio_filepath")
        )
    )
    number = F.regexp_extract("key", r"\.txt:(\d+)$", 1).try_cast("bigint")
    return found.unionByName(unsafe).groupBy("rule").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("keys"), F.coalesce(F.sum(number), F.lit(0)).alias("line_sum")
    ).unionByName(
        rows.agg(
            F.lit("rows").alias("rule"), F.count(F.lit(1)).alias("n"), F.count_distinct("sample_id").alias("keys"),
            F.lit(0).cast("long").alias("line_sum"),
        )
    )


SQL_INVENTORY = """
WITH r AS (SELECT d.*, quality, toxic, CASE WHEN quality IS NOT NULL OR lang = 'en' THEN 2 ELSE 1 END AS copies
           FROM documents d LEFT JOIN labels USING (doc_id)),
l AS (SELECT r.*, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS line FROM r, LATERAL (SELECT unnest(range(copies))) x(copy)),
f AS (SELECT *, CASE WHEN quality = 0 AND toxic = 1 THEN 'invalid_json' WHEN toxic = 1 THEN 'not_an_object'
                     WHEN quality = 0 THEN 'missing_path' WHEN quality = 1 THEN 'non_finite_number' END AS rule FROM l)
SELECT rule, count(*) AS n, count(DISTINCT source || ':' || line) AS keys, sum(line)::BIGINT AS line_sum FROM f WHERE rule IS NOT NULL GROUP BY rule
UNION ALL SELECT 'duplicate_sample', count(*), count(*), 0 FROM r WHERE quality IS NULL AND lang = 'en'
UNION ALL SELECT 'unsafe_path', count(*), count(*), 0 FROM r WHERE quality IS NULL AND lang = 'de'
UNION ALL SELECT 'rows', sum(copies)::BIGINT, count(*), 0 FROM r WHERE quality IS NULL
"""


def label_in_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names built from events, parsed back, split by held-out speakers."""
    kinds = F.create_map(
        F.lit("click"), F.lit("happy"), F.lit("view"), F.lit("NEUTRAL"), F.lit("signup"), F.lit("SAD"),
        F.lit("purchase"), F.lit("unknown"), F.lit("error"), F.lit("ANGRY"),
    )
    gender = F.when(F.pmod("user_id", F.lit(3)) == 0, "F").when(F.pmod("user_id", F.lit(3)) == 1, "M").otherwise("x")
    names = table(spark, sf_dir, "events").select(
        F.concat(
            F.lit("clips/"), gender, F.lit("_"), F.lpad(F.pmod("user_id", F.lit(20)).cast("string"), 2, "0"), F.lit("_NAME_S_1_"),
            F.element_at(kinds, F.col("event_type")), F.lit("_"), F.col("event_id").cast("string"), F.lit(".wav"),
        ).alias("path")
    )
    parsed = sampling.split_by_list(tabular.parse_labeled_names(names), "speaker", ["F_09", "F_10", "M_09", "M_10"])
    return parsed.groupBy("role", "speaker", "gender", "emotion").agg(F.count(F.lit(1)).alias("n_rows"))


SQL_FILENAMES = """
WITH r AS (SELECT CASE user_id % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'M' ELSE 'X' END AS g, lpad((user_id % 20)::VARCHAR, 2, '0') AS num,
             CASE event_type WHEN 'click' THEN 'HAPPY' WHEN 'view' THEN 'NEUTRAL' WHEN 'signup' THEN 'SAD' WHEN 'error' THEN 'ANGRY' END AS emotion FROM events)
SELECT CASE WHEN g || '_' || num IN ('F_09', 'F_10', 'M_09', 'M_10') THEN 'test' ELSE 'train' END AS role, g || '_' || num AS speaker,
       CASE WHEN g IN ('F', 'M') THEN g END AS gender, emotion, count(*) AS n_rows FROM r WHERE emotion IS NOT NULL GROUP BY ALL
"""


def source_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written in every layout, read back through its adapter, united."""
    root = scratch_path(spark, "roundtrip")
    docs = table(spark, sf_dir, "documents").select(
        F.format_string("%06d", "doc_id").alias("name"), "lang", "source", "doc_id",
        F.regexp_replace("text", r"[\t\r\n]", " ").alias("line"), "text",
    )
    # JSONL
    writers.write_manifest(document_manifest(spark, sf_dir), f"{root}/a/manifest.jsonl")
    # positional TSV
    docs.select(F.concat_ws("\t", "name", "lang", "line").alias("value")).write.text(f"{root}/b/utt_spk_text.tsv")
    # header TSVs: labelled rows are validated, all rows are in other.tsv
    labels = table(spark, sf_dir, "labels").select("doc_id")
    tsv = docs.select(F.concat("name", F.lit(".mp3")).alias("path"), F.col("line").alias("sentence"), F.col("lang").alias("client_id"), "doc_id")
    writers.write_metadata_tsv(
        tsv.join(labels, "doc_id", "left_semi").withColumn("sentence", F.lit("validated")).drop("doc_id"), f"{root}/c/validated.tsv", "path"
    )
    writers.write_metadata_tsv(tsv.drop("doc_id"), f"{root}/c/other.tsv", "path")
    # CSV and Parquet with inline bytes
    docs.select(F.col("name").alias("id"), F.col("text").alias("sentence")).write.option("header", True).option(
        "quoteAll", True).option("escape", '"').csv(f"{root}/d/train.csv")
    docs.select(
        F.struct(F.col("text").cast("binary").alias("bytes"), F.concat("name", F.lit(".WAV")).alias("path")).alias("speech"),
        F.col("text").alias("transcript"), F.col("lang").alias("client_id"),
    ).write.parquet(f"{root}/e")
    # a file inventory: one folder per source
    docs.select("source", F.col("name").alias("value")).write.partitionBy("source").text(f"{root}/f")

    jsonl = registry.ready_manifest(spark, f"{root}/a", dataset="jsonl", language="xx")
    flat = tabular.read_positional_tsv(spark, f"{root}/b/utt_spk_text.tsv", ["utt_id", "spk_id", "text"]).withColumn(
        "path", tabular.prefixed_path("data"))
    flat = as_manifest(flat, audio_filepath="path", dataset=F.lit("positional"), id="utt_id", speaker_id="spk_id", language=F.lit("xx"))
    meta = tabular.read_tsv_union(spark, [f"{root}/c/validated.tsv", f"{root}/c/other.tsv"], ["path", "sentence", "client_id"])
    clips = joins.attach_metadata(
        docs.select(F.concat("name", F.lit(".mp3")).alias("path")), meta, "path", ["sentence", "client_id"], ["priority", "sentence"]
    )
    header = as_manifest(clips, audio_filepath="path", text="sentence", dataset=F.lit("header"),
                         id=paths.stem(F.col("path")), speaker_id="client_id", language=F.lit("xx"))
    csv = tabular.read_labeled_csv(spark, f"{root}/d/train.csv", ["id", "sentence"], quoted_newlines=True)
    table_rows = as_manifest(csv, audio_filepath=F.concat("id", F.lit(".mp3")), text="sentence", dataset=F.lit("csv"), language=F.lit("xx"))
    inline = registry.inline_parquet(spark, f"{root}/e", dataset="parquet", language="xx")
    files = tabular.list_files(spark, f"{root}/f", [".txt"]).select(
        F.regexp_extract("path", "source=([^/]+)/", 1).alias("speaker_id")).distinct()
    listed = as_manifest(files, dataset=F.lit("files"), id="speaker_id")
    union = joins.union_sources([jsonl, flat, header, table_rows, inline, listed])
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", "id", F.coalesce("text", F.lit("")), "audio_filepath")), 1, 8), 16, 10)
    return union.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("ids"),
        F.count_distinct("speaker_id").alias("speakers"),
        F.sum(digest.cast("long")).alias("digest"),
    )


SQL_ROUNDTRIP = r"""
WITH d AS (SELECT lpad(doc_id::VARCHAR, 6, '0') AS name, doc_id, lang, source, text,
             regexp_replace(text, '[\t\r\n]', ' ', 'g') AS line, doc_id IN (SELECT doc_id FROM labels) AS labelled FROM documents),
u AS (
  SELECT 'jsonl' AS dataset, doc_id::VARCHAR AS id, text, 'audio/' || doc_id || '.flac' AS path, NULL AS speaker FROM d
  UNION ALL SELECT 'positional', name, line, 'data/' || substr(name, 1, 2) || '/' || name || '.flac', lang FROM d
  UNION ALL SELECT 'header', name, CASE WHEN labelled THEN 'validated' ELSE line END, name || '.mp3', lang FROM d
  UNION ALL SELECT 'csv', name, text, name || '.mp3', NULL FROM d
  UNION ALL SELECT 'parquet', name, text, name || '.wav', lang FROM d
  UNION ALL SELECT DISTINCT 'files', source, NULL, NULL, source FROM d)
SELECT dataset, count(*) AS n_rows, count(DISTINCT id) AS ids, count(DISTINCT speaker) AS speakers,
       sum(('0x' || substr(md5(concat_ws('|', id, coalesce(text, ''), path)), 1, 8))::UBIGINT)::BIGINT AS digest
FROM u GROUP BY dataset
"""


def result_loader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions stored as summaries, loaded back by key precedence and alias."""
    root = scratch_path(spark, "results")
    rows = utterances(spark, sf_dir).select(
        F.col("vec_id").cast("string").alias("item_id"), F.col("speaker").cast("string").alias("speaker_id"),
        F.lit(0).alias("fold"), F.col("label").cast("string").alias("gold_label"),
        F.pmod("label", F.lit(3)).cast("string").alias("predicted_label"),
    )
    # a pointer summary and its Parquet artifact
    writers.write_predictions(rows, f"{root}/pred.parquet", ["item_id", "gold_label"])
    spark.range(1).select(
        F.lit('{"predictions_artifact": {"path": "pred.parquet"}, "balanced_accuracy": 0.5}').alias("value")
    ).coalesce(1).write.text(f"{root}/pointer.json")
    # a JSON-lines artifact named by a bare string
    rows.select(F.to_json(F.struct("item_id", "speaker_id", "fold", F.col("gold_label").alias("gold"),
                                   F.col("predicted_label").alias("prediction"))).alias("value")).write.text(f"{root}/pred.jsonl")
    spark.range(1).select(F.lit('{"artifact": "pred.jsonl"}').alias("value")).coalesce(1).write.text(f"{root}/bare.json")
    loaded = [
        results.load_entry(spark, f"{root}/{file}", task="classification:label", system=name, order=i, seed="0")
        for i, (file, name) in enumerate((("pointer.json", "pointer"), ("bare.json", "bare")))
    ]
    metric = results.classification_score(spark, f"{root}/pointer.json")
    both = loaded[0].unionByName(loaded[1])
    return both.groupBy("system", "gold", "prediction").agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "metric", F.lit(metric))


SQL_RESULTS = """
SELECT system, label::VARCHAR AS gold, (label % 3)::VARCHAR AS prediction, count(*) AS n_rows, 'balanced_accuracy' AS metric
FROM embeddings, (VALUES ('pointer'), ('bare')) s(system) GROUP BY ALL
"""


def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as models: status folding, gated metrics, chained left joins."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    joined = docs.select("doc_id", "source", "lang", "n_chars").join(labels, "doc_id", "left")
    models = docs.select(F.col("source").alias("model")).distinct()
    state = F.when(F.col("toxic") == 1, "failed").when(F.col("quality") == 1, "completed").otherwise("skipped")
    statuses = joined.where(F.col("quality").isNotNull()).select(F.col("source").alias("model"), state.alias("status"))
    status = reports.derive_status(statuses, models, "model")
    quality = joined.groupBy(F.col("source").alias("model")).agg(F.avg("quality").alias("mean_quality"))
    summaries = joined.groupBy(F.col("source").alias("model")).agg(
        F.avg("n_chars").alias("m"), (F.count("quality") > 20).alias("strict")
    ).select("model", F.parse_json(F.to_json(F.struct(F.struct("strict", F.struct(F.round("m", 3).alias("stft")).alias("aggregate")).alias("recon")))).alias("summary"))
    recon = reports.extract_metrics(summaries, "summary", {"stft": "$.recon.aggregate.stft"}, "$.recon.strict")
    english = joined.where(F.col("lang") == "en").groupBy(F.col("source").alias("model")).agg(F.count(F.lit(1)).alias("english_rows"))
    return rounded(reports.scorecard(models, status, quality, recon, english, key="model"), "mean_quality", "stft", digits=3)


SQL_SCORECARD = """
WITH j AS (SELECT d.doc_id, source AS model, lang, n_chars, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id)),
s AS (SELECT model, CASE WHEN bool_or(toxic = 1) IS NULL THEN 'missing' WHEN bool_or(toxic = 1) THEN 'completed_with_errors'
               WHEN bool_and(quality = 0 AND toxic = 0) THEN 'skipped' ELSE 'completed' END AS status FROM j GROUP BY model)
SELECT model, status, (round(avg(quality), 3) + 0.0) AS mean_quality,
       CASE WHEN count(quality) > 20 THEN round(avg(n_chars), 3) + 0.0 END AS stft,
       nullif(count(*) FILTER (lang = 'en'), 0) AS english_rows
FROM j JOIN s USING (model) GROUP BY model, status
"""

QUERIES = {
    "manifest_union_counts": manifest_union_counts,
    "sample_identity": sample_identity,
    "id_and_path_derivation": id_and_path_derivation,
    "metadata_left_join_first_wins": metadata_left_join_first_wins,
    "existing_only": existing_only,
    "known_labels": known_labels,
    "split_by_source": split_by_source,
    "holdout_per_speaker": holdout_per_speaker,
    "group_kfold": group_kfold,
    "sample_groups": sample_groups,
    "sample_exact_quota": sample_exact_quota,
    "capped_rows": capped_rows,
    "blind_design": blind_design,
    "duration_profile": duration_profile,
    "duration_filter_report": duration_filter_report,
    "charset": charset,
    "target_feasibility": target_feasibility,
    "token_collapse": token_collapse,
    "null_normalisation": null_normalisation,
    "build_metadata": build_metadata,
    "inventory_violations": inventory_violations,
    "label_in_filename": label_in_filename,
    "source_roundtrip": source_roundtrip,
    "result_loader": result_loader,
    "scorecard": scorecard,
}

ORACLES = {
    "manifest_union_counts": r"""
        WITH u AS (SELECT source AS dataset, lang AS s FROM documents
                   UNION ALL SELECT 'pages', regexp_extract(url, '^[a-z]+://([^/]+)', 1) FROM pages
                   UNION ALL SELECT 'conversations', role FROM conversations)
        SELECT dataset, count(*) AS n_rows, count(DISTINCT s) AS speakers FROM u GROUP BY dataset""",
    "sample_identity": SQL_IDENTITY,
    "id_and_path_derivation": SQL_PATHS,
    "metadata_left_join_first_wins": SQL_METADATA,
    "existing_only": SQL_EXISTING,
    "known_labels": SQL_KNOWN,
    "split_by_source": f"WITH {sql_split('doc_id, dataset')} SELECT * FROM split_rows",
    "holdout_per_speaker": SQL_HOLDOUT,
    "group_kfold": SQL_KFOLD,
    "sample_groups": SQL_SAMPLE_GROUPS,
    "sample_exact_quota": f"""SELECT doc_id, source FROM documents
        QUALIFY row_number() OVER (PARTITION BY source ORDER BY {sql_hash(41, 'quota', 'doc_id')}, doc_id) <= 7""",
    "capped_rows": SQL_CAPPED_ROWS,
    "blind_design": SQL_BLIND,
    "duration_profile": SQL_PROFILE,
    "duration_filter_report": SQL_DURATION_FILTER,
    "charset": SQL_CHARSET,
    "target_feasibility": SQL_FEASIBILITY,
    "token_collapse": SQL_COLLAPSE,
    "null_normalisation": SQL_NULLS,
    "build_metadata": SQL_BUILD_META,
    "inventory_violations": SQL_INVENTORY,
    "label_in_filename": SQL_FILENAMES,
    "source_roundtrip": SQL_ROUNDTRIP,
    "result_loader": SQL_RESULTS,
    "scorecard": SQL_SCORECARD,
}
