"""The operators' named queries over whole tables, and SQL for DuckDB where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterset.llm import (
    chat, convtrie, jaccard, language, licences, mixing, passages, pieces, quality, rtree, sharding, topk, urls,
)
from utterset.queries.common import table

#: Fixed rules of the URL query.
URL_RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: Fixed phrases of the licence query.
PHRASES = (
    licences.Template("mit", "under the mit license"),
    licences.Template("apache-2", "apache license version 2"),
    licences.Template("cc-by-nc", "cc by nc"),
)
MODEL = "piece_bpe_32k.model"


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.split_and_identify(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.find_repeats(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.ledger(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality.fails_base(quality.STANDARD).alias("base_failed"),
        quality.accepts(quality.STANDARD).alias("kept"),
        "n_lines", "n_capitals", "failed",
    )


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), shards=16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = [urls.Rule.parse(verdict, text) for verdict, text in URL_RULES]
    rules = spark.createDataFrame(parsed, "host string, path string, verdict string")
    return urls.judge_urls(table(spark, sf_dir, "pages"), rules)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.token_digests(table(spark, sf_dir, "documents"), pieces.read_model(model_path()))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op11_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"), PHRASES)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convtrie.shared_prefix_trie(table(spark, sf_dir, "conversations"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rtree.hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_language, op3_ngram_jaccard, op4_repeated_passages, op5_quality_rules, op6_shards,
        op7_chat_format, op8_url_filter, op9_sentencepiece, op10_top_k, op11_licences, op12_conversation_trie, op13_hard_negatives,
    )
}

OP3_SQL = """
WITH RECURSIVE words AS (
  SELECT text, min(doc_id) AS node, count(*) AS copies,
         regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents WHERE text IS NOT NULL GROUP BY text),
shingles AS (
  SELECT DISTINCT node, s FROM (
    SELECT node, unnest(CASE
      WHEN len(w) = 0 THEN []
      WHEN len(w) < 5 THEN [w]
      ELSE list_transform(range(1, len(w) - 3), lambda i : w[i:i + 4]) END) AS s
    FROM words)),
sizes AS (SELECT node, count(*) AS n FROM shingles GROUP BY node),
common AS (
  SELECT a.node AS x, b.node AS y, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.node <> b.node GROUP BY ALL),
links AS (
  SELECT x, y, p.copies FROM common
  JOIN sizes s ON s.node = x JOIN sizes t ON t.node = y JOIN words p ON p.node = y
  WHERE c >= 0.8 * (s.n + t.n - c) - 1e-9),
reach AS (
  SELECT node AS x, node AS y FROM words
  UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y),
groups AS (SELECT x AS node, min(y) AS class_id FROM reach GROUP BY x),
counts AS (SELECT x AS node, sum(copies)::BIGINT AS n_links, count(*) AS n_linked_texts FROM links GROUP BY x)
SELECT d.doc_id, coalesce(g.class_id, d.doc_id) AS class_id, coalesce(w.copies, 1) AS copies,
       coalesce(c.n_links, 0) AS n_links, coalesce(c.n_linked_texts, 0) AS n_linked_texts,
       d.doc_id = coalesce(g.class_id, d.doc_id) AS stays
FROM documents d LEFT JOIN words w ON d.text = w.text
LEFT JOIN groups g ON g.node = w.node LEFT JOIN counts c ON c.node = w.node
"""

OP5_SQL = """
WITH read AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l : regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM read WHERE len(w) > 7),
keyed AS (SELECT doc_id, i, w[i:i + 7] AS k FROM windows),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS n FROM keyed) WHERE n > 1),
repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
         len(regexp_extract_all(t, '\\p{Lu}'))::BIGINT AS n_capitals
  FROM read LEFT JOIN repeated r USING (doc_id)),
judged AS (
  SELECT *, (n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT
    + 4 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::BIGINT + 8 * (2 * n_symbols > n_words)::BIGINT
    + 16 * (2 * n_dup_lines > n_lines)::BIGINT + 32 * (2 * n_capitals > word_chars)::BIGINT AS failed
  FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed,
       failed = 0 AS kept, n_lines, n_capitals, failed
FROM judged
"""

OP8_SQL = """
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, regexp_extract(r, '^[^/?#]*') AS h, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
hosts AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts),
rules(rh, rp, rv) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                             ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (
  SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv
  FROM hosts JOIN rules ON (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM hosts LEFT JOIN fits USING (page_id)
"""

OP10_SQL = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x : floor(256 * x)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP11_SQL = """
WITH templates(template, label, phrase, body) AS (VALUES {templates}),
read AS (
  SELECT 'd' AS kind, row_number() OVER () AS id, doc_id, coalesce(text, '') AS body FROM documents
  UNION ALL SELECT 't', template, NULL, body FROM templates),
tokens AS (
  SELECT kind, id, doc_id, regexp_extract_all(translate(body, '{upper}', '{lower}'), '{word}') AS w FROM read),
grams AS (SELECT kind, id, len(w) AS n, unnest(range(len(w) - 2)) AS spot, w FROM tokens WHERE len(w) > 2),
keyed AS (SELECT kind, id, n, spot, w[spot + 1:spot + 3] AS gram FROM grams),
hits AS (
  SELECT d.id, t.id AS template, d.spot AS place, t.spot, d.spot - t.spot AS diagonal
  FROM keyed d JOIN keyed t ON d.gram = t.gram AND d.kind = 'd' AND t.kind = 't'),
lengths AS (SELECT template, label, phrase, len(w) AS n FROM templates JOIN tokens ON kind = 't' AND id = template),
votes AS (SELECT id, template, diagonal, count(*) AS votes FROM hits GROUP BY ALL),
stated AS (
  SELECT id, label, diagonal AS place, 1.0::DOUBLE AS score
  FROM votes JOIN lengths USING (template) WHERE phrase AND votes = n - 2),
leads AS (
  SELECT a.id, a.template, a.diagonal, label, n FROM votes a JOIN lengths USING (template)
  WHERE NOT phrase AND NOT EXISTS (
    FROM votes b WHERE b.id = a.id AND b.template = a.template AND abs(b.diagonal - a.diagonal) <= n // 4
      AND (b.votes > a.votes OR (b.votes = a.votes AND b.diagonal < a.diagonal)))),
merged AS (
  SELECT l.id, l.template, l.label, l.n, l.diagonal, h.spot, h.place
  FROM leads l JOIN hits h ON h.id = l.id AND h.template = l.template AND abs(h.diagonal - l.diagonal) <= n // 4),
covered AS (
  SELECT id, template, diagonal, least(count(DISTINCT spot + k), count(DISTINCT place + k)) AS shared
  FROM merged, range(3) AS r(k) GROUP BY ALL),
spans AS (
  SELECT id, template, label, lo, hi, shared, shared / greatest(n, hi - lo + 1) AS score
  FROM (SELECT id, template, label, n, diagonal, min(place) AS lo, max(place) + 2 AS hi FROM merged GROUP BY ALL)
  JOIN covered USING (id, template, diagonal)),
good AS (FROM spans WHERE score >= 0.8),
alike AS (
  SELECT id, label, score FROM good a WHERE NOT EXISTS (
    FROM good b WHERE a.id = b.id AND b.lo <= a.hi AND b.hi >= a.lo
      AND (b.score, b.shared, -b.template, -b.lo) > (a.score, a.shared, -a.template, -a.lo))),
judged AS (
  SELECT id, count(place) AS n_base, min(place) AS first_word, max(place) AS last_word,
         coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (place IS NOT NULL), '') AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
  FROM (SELECT * FROM stated UNION ALL SELECT id, label, NULL, score FROM alike) GROUP BY id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0)::DOUBLE AS score
FROM tokens LEFT JOIN judged USING (id) WHERE kind = 'd'
""".format(
    templates=", ".join(
        f"({i}, '{t.label}', {i < len(PHRASES)}, '{t.text}')" for i, t in enumerate([*PHRASES, *licences.NOTICES])
    ),
    upper=licences.UPPER, lower=licences.LOWER, word=licences.WORD,
)

OP12_SQL = """
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL),
heads AS (
  SELECT c, c - c % 100 AS base, xor(4294967295, list_reduce(
    [4294967295::BIGINT] || list_transform(string_split(c::VARCHAR, ''), lambda x : ascii(x)::BIGINT),
    lambda a, b : list_reduce([xor(a, b)] || range(8), lambda x, y : xor(x >> 1, 3988292384 * (x & 1))))) % 6 AS h
  FROM (SELECT DISTINCT c FROM turns)),
rebuilt AS (
  SELECT heads.c, 0 AS part, i, r, t FROM heads JOIN turns ON turns.c = base WHERE i < h
  UNION ALL SELECT c, 1, i, r, t FROM heads JOIN turns USING (c) WHERE i >= h),
seqs AS (
  SELECT c, coalesce(list({'r': r, 't': t} ORDER BY part, i) FILTER (r IS NOT NULL), []) AS s
  FROM heads LEFT JOIN rebuilt USING (c) GROUP BY c),
firsts AS (SELECT c, d, s[1:d] AS p, len(s) = d AS ends FROM seqs, unnest(range(len(s) + 1)) AS x(d)),
named AS (SELECT c, d, min(c) OVER (PARTITION BY d, p) AS node, ends, p FROM firsts),
nodes AS (
  SELECT node, d, count(*) AS n, CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * length(any_value(p)[d].t) END AS saved,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM named GROUP BY node, d),
kin AS (
  SELECT nodes.*, up.node AS parent FROM nodes
  LEFT JOIN named up ON up.c = nodes.node AND up.d = nodes.d - 1),
born AS (SELECT parent AS node, d - 1 AS d, count(*) AS n_children FROM kin WHERE d > 0 GROUP BY ALL),
own AS (SELECT kin.*, coalesce(n_children, 0) AS n_children FROM kin LEFT JOIN born USING (node, d)),
totals AS (
  SELECT up.node, up.d, sum((own.n_children = 0)::BIGINT) AS n_leaves, sum(own.saved) AS saved_tokens
  FROM own JOIN named up ON up.c = own.node AND up.d <= own.d GROUP BY ALL)
SELECT node AS conv_id, d AS depth, parent AS parent_conv_id, n AS n_convs, n_children,
       n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM own JOIN totals USING (node, d)
"""

OP13_SQL = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding::DOUBLE[], lambda x : floor(256 * x)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
near AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
far AS (
  SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank
  FROM near JOIN scored USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM far WHERE rank <= 10
"""

ORACLES = {
    "op3_ngram_jaccard": OP3_SQL,
    "op5_quality_rules": OP5_SQL,
    "op8_url_filter": OP8_SQL,
    "op10_top_k": OP10_SQL,
    "op11_licences": OP11_SQL,
    "op12_conversation_trie": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
}
