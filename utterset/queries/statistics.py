"""Queries over predictions, trials and per-item metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from utterset.functions import text as tx
from utterset.functions import vectors
from utterset.functions.hashing import draw_index, order_key
from utterset.operators import asr, bootstrap, classify, embeddings, reports, sampling, verify
from utterset.plans.resample import sql_draws
from utterset.queries.common import (
    SQL_UTTERANCES,
    dealt,
    rounded,
    sql_hash,
    sql_index,
    sql_round,
    table,
    utterances,
)
from utterset.session import cut_lineage

REPLICATES = 10_000
SUMMARY_VALUES = ("estimate", "seed_sample_sd", "ci_low", "ci_high")


# -- transcripts ------------------------------------------------------------


def transcript_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two systems and two seeds: every k-th word of each turn is lost."""
    turns = dealt(table(spark, sf_dir, "conversations")).select(
        F.concat_ws(":", "conv_id", "turn").alias("unit_id"), tx.words(F.col("text")).alias("w")
    )
    variants = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(s).alias("system"), F.lit(o).alias("ord"), F.lit(str(seed)).alias("seed"),
                    F.lit(k).alias("k"), F.lit(seed).alias("shift"),
                )
                for s, o, k in (("base", 0, 4), ("tuned", 1, 7))
                for seed in (0, 1)
            ]
        )
    )
    spread = turns.select("unit_id", "w", variants.alias("v")).select("unit_id", "w", "v.*")
    kept = F.filter("w", lambda word, i: F.pmod(i + 1 + F.col("shift"), F.col("k")) != 0)
    return spread.select(
        "system", "ord", "seed", "unit_id",
        F.array_join("w", " ").alias("reference"),
        F.array_join(kept, " ").alias("hypothesis"),
    )


SQL_TRANSCRIPTS = """
variants AS (
  SELECT * FROM (VALUES ('base', 0, 4), ('tuned', 1, 7)) s(system, ord, k),
                (VALUES (0), (1)) x(shift)),
turns AS (
  SELECT conv_id || ':' || turn AS unit_id,
         list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w
  FROM conversations),
spread AS (
  SELECT system, ord, shift::VARCHAR AS seed, unit_id, w,
         list_filter(list_transform(range(1, len(w) + 1),
             lambda i: CASE WHEN (i + shift) % k <> 0 THEN w[i] END), lambda x: x IS NOT NULL) AS kept
  FROM turns, variants),
counts AS (
  SELECT system, ord, seed, unit_id,
         (len(w) - len(kept))::BIGINT AS word_errors, len(w)::BIGINT AS word_units,
         (length(array_to_string(w, ' ')) - length(array_to_string(kept, ' ')))::BIGINT AS char_errors,
         length(array_to_string(w, ' '))::BIGINT AS char_units
  FROM spread)
"""


def asr_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asr.asr_counts(transcript_entries(spark, sf_dir)).select(
        "system", "seed", "unit_id", "word_errors", "word_units", "char_errors", "char_units"
    )


def asr_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = asr.asr_counts(transcript_entries(spark, sf_dir))
    return rounded(asr.asr_rates(counts, ["system", "seed"]), "wer", "cer")


def asr_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = bootstrap.bootstrap_rate(
        transcript_entries(spark, sf_dir), replicates=REPLICATES, seed=11
    )
    return rounded(result, *SUMMARY_VALUES)


def _sql_summary(points: str, boot: str) -> str:
    """System and difference rows from CTEs of points and seed-averaged replicates."""
    return f"""
means AS (SELECT metric, system, ord, avg(value) AS m, count(*) AS n, stddev_samp(value) AS sd
          FROM {points} GROUP BY ALL),
per_system AS (SELECT metric, system, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi
          FROM {boot} GROUP BY ALL),
diffs AS (SELECT a.metric, b.system AS system, a.system AS minus, b.value - a.value AS value
          FROM {boot} a JOIN {boot} b ON a.metric = b.metric AND a.replicate = b.replicate AND a.ord < b.ord),
per_pair AS (SELECT metric, system, minus, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi
          FROM diffs GROUP BY ALL)
SELECT metric, 'system' AS kind, system, NULL::VARCHAR AS minus, {sql_round('m')} AS estimate,
       CASE WHEN n > 1 THEN {sql_round('sd')} END AS seed_sample_sd,
       {sql_round('lo')} AS ci_low, {sql_round('hi')} AS ci_high
FROM means JOIN per_system USING (metric, system)
UNION ALL
SELECT p.metric, 'difference', p.system, p.minus, {sql_round('b.m - a.m')}, NULL::DOUBLE,
       {sql_round('lo')}, {sql_round('hi')}
FROM per_pair p JOIN means a ON a.metric = p.metric AND a.system = p.minus
                JOIN means b ON b.metric = p.metric AND b.system = p.system
"""


SQL_ASR_BOOTSTRAP = f"""
WITH {SQL_TRANSCRIPTS},
units AS (SELECT unit_id, row_number() OVER (ORDER BY {sql_hash(11, 'unit', 'unit_id')}, unit_id) - 1 AS pos
          FROM (SELECT DISTINCT unit_id FROM turns)),
{sql_draws('units', REPLICATES, 11)},
long AS (SELECT system, ord, seed, unit_id, 'wer' AS metric, word_errors AS e, word_units AS u FROM counts
         UNION ALL SELECT system, ord, seed, unit_id, 'cer', char_errors, char_units FROM counts),
points AS (SELECT metric, system, ord, seed, sum(e) / sum(u) AS value FROM long GROUP BY ALL),
boot AS (SELECT metric, system, ord, replicate, avg(value) AS value FROM (
           SELECT metric, system, ord, seed, replicate, sum(e) / sum(u) AS value
           FROM draws JOIN units USING (pos) JOIN long USING (unit_id) GROUP BY ALL) GROUP BY ALL),
{_sql_summary('points', 'boot')}
"""


# -- per-item metrics -------------------------------------------------------


def metric_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a unit; two systems, three seeds."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    variants = F.explode(
        F.array(
            *[
                F.struct(F.lit(s).alias("system"), F.lit(o).alias("ord"), F.lit(str(seed)).alias("seed"),
                         F.lit(float(seed)).alias("shift"), F.lit(gain).alias("gain"))
                for s, o, gain in (("base", 0, 0.0), ("tuned", 1, 1.0))
                for seed in (0, 1, 2)
            ]
        )
    )
    bonus = F.when(F.col("event_type") == "error", 0.5).otherwise(0.0)
    return events.select("event_id", "event_type", "value", variants.alias("v")).select(
        "v.system", "v.ord", "v.seed",
        F.col("event_id").alias("unit_id"),
        F.lit("value").alias("metric"),
        (F.col("value") + F.col("v.shift") + F.col("v.gain") * (1.0 + bonus)).alias("value"),
    )


def metric_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = bootstrap.bootstrap_mean(metric_entries(spark, sf_dir), replicates=REPLICATES, seed=7)
    return rounded(result, *SUMMARY_VALUES)


SQL_METRIC_BOOTSTRAP = f"""
WITH units AS (
  SELECT event_id, value, CASE WHEN event_type = 'error' THEN 1.5 ELSE 1.0 END AS bonus,
         row_number() OVER (ORDER BY {sql_hash(7, 'unit', 'event_id')}, event_id) - 1 AS pos FROM events),
{sql_draws('units', REPLICATES, 7)},
sums AS (SELECT replicate, count(*) AS c, sum(value) AS v, sum(bonus) AS b FROM draws JOIN units USING (pos) GROUP BY ALL),
cells AS (SELECT * FROM (VALUES ('base', 0, 0.0), ('tuned', 1, 1.0)) s(system, ord, gain), (VALUES (0), (1), (2)) x(seed)),
points AS (SELECT 'value' AS metric, system, ord, seed, avg(value + seed + gain * bonus) AS value FROM units, cells GROUP BY ALL),
boot AS (SELECT 'value' AS metric, system, ord, replicate, avg((v + seed * c + gain * b) / c) AS value FROM sums, cells GROUP BY ALL),
{_sql_summary('points', 'boot')}
"""


# -- classification ---------------------------------------------------------

SYSTEM_NOISE = (("base", 0, 3), ("tuned", 1, 2))


def label_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of vectors, predictions wrong for a hashed part of the rows."""
    utts = utterances(spark, sf_dir).select("vec_id", "speaker", F.col("label").alias("gold"))
    folded = sampling.group_kfold(utts, "speaker", 5, 3)
    parts = []
    for system, order, noise in SYSTEM_NOISE:
        for seed in ("0", "1"):
            wrong = draw_index(order_key(5, "pred", F.lit(system), F.lit(seed), "vec_id"), 10) < noise
            parts.append(
                F.struct(
                    F.lit(system).alias("system"), F.lit(order).alias("ord"), F.lit(seed).alias("seed"),
                    F.when(wrong, F.pmod(F.col("gold") + 1, F.lit(10))).otherwise(F.col("gold")).alias("prediction"),
                )
            )
    return folded.select(
        F.col("vec_id").alias("unit_id"), F.col("speaker").alias("speaker_id"), "fold", "gold",
        F.explode(F.array(*parts)).alias("p"),
    ).select("unit_id", "speaker_id", "fold", "gold", "p.*")


def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = label_entries(spark, sf_dir)
    keys = ["system", "seed"]
    cells = classify.confusion(entries, [*keys, "fold"])
    folds = classify.fold_summary(classify.fold_scores(cells, keys), keys)
    return rounded(
        folds, "accuracy", "balanced_accuracy", "macro_f1", "accuracy_std", "balanced_accuracy_std", "macro_f1_std"
    )


def sql_folds(groups: str, group: str, k: int, seed: int) -> str:
    return f"""
folds AS (SELECT {group}, (ntile({k}) OVER (ORDER BY {sql_hash(seed, 'fold', group)}, {group}) - 1)::INTEGER AS fold
          FROM (SELECT DISTINCT {group} FROM {groups}))
"""


SQL_CLASSIFICATION = f"""
WITH {SQL_UTTERANCES}, {sql_folds('utterances', 'speaker', 5, 3)},
cells AS (SELECT * FROM (VALUES ('base', 0, 3), ('tuned', 1, 2)) s(system, ord, noise), (VALUES ('0'), ('1')) x(seed)),
rows_ AS (SELECT system, ord, seed, speaker, fold, label AS gold,
         CASE WHEN {sql_index(sql_hash(5, 'pred', 'system', 'seed', 'vec_id'), '10')} < noise
              THEN (label + 1) % 10 ELSE label END AS prediction
       FROM utterances JOIN folds USING (speaker), cells),
long AS (SELECT system, seed, fold, gold AS label, 1 AS g, 0 AS p, (gold = prediction)::INT AS tp FROM rows_
         UNION ALL SELECT system, seed, fold, prediction, 0, 1, 0 FROM rows_),
per_label AS (SELECT system, seed, fold, label, sum(g) AS g, sum(p) AS p, sum(tp) AS tp FROM long GROUP BY ALL),
per_fold AS (SELECT system, seed, fold, sum(tp) / sum(g) AS accuracy,
       avg(CASE WHEN g > 0 THEN tp / g END) AS balanced_accuracy, avg(2.0 * tp / (g + p)) AS macro_f1
     FROM per_label GROUP BY ALL)
SELECT system, seed, count(*) AS n_splits, {sql_round('avg(accuracy)')} AS accuracy,
       {sql_round('avg(balanced_accuracy)')} AS balanced_accuracy, {sql_round('avg(macro_f1)')} AS macro_f1,
       {sql_round('stddev_pop(accuracy)')} AS accuracy_std,
       {sql_round('stddev_pop(balanced_accuracy)')} AS balanced_accuracy_std,
       {sql_round('stddev_pop(macro_f1)')} AS macro_f1_std
FROM per_fold GROUP BY system, seed
"""


def event_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("gold"))
    folded = sampling.group_kfold(events, "user_id", 5, 3)
    parts = []
    for system, order, noise in SYSTEM_NOISE:
        wrong = draw_index(order_key(5, "pred", F.lit(system), "event_id"), 10) < noise
        parts.append(
            F.struct(
                F.lit(system).alias("system"), F.lit(order).alias("ord"), F.lit("0").alias("seed"),
                F.when(wrong, F.lit("click")).otherwise(F.col("gold")).alias("prediction"),
            )
        )
    return folded.select(
        F.col("event_id").alias("unit_id"), F.col("user_id").alias("speaker_id"), "fold", "gold",
        F.explode(F.array(*parts)).alias("p"),
    ).select("unit_id", "speaker_id", "fold", "gold", "p.*")


def classification_cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = bootstrap.bootstrap_cluster(
        event_entries(spark, sf_dir), replicates=REPLICATES, seed=13
    )
    return rounded(result, *SUMMARY_VALUES)


SQL_CLUSTER = f"""
WITH {sql_folds('events', 'user_id', 5, 3)},
cells AS (SELECT * FROM (VALUES ('base', 0, 3), ('tuned', 1, 2)) s(system, ord, noise)),
rows_ AS (SELECT system, ord, user_id, fold, event_type AS gold,
         CASE WHEN {sql_index(sql_hash(5, 'pred', 'system', 'event_id'), '10')} < noise
              THEN 'click' ELSE event_type END AS prediction
       FROM events JOIN folds USING (user_id), cells),
units AS (SELECT user_id, row_number() OVER (ORDER BY {sql_hash(13, 'unit', 'user_id')}, user_id) - 1 AS pos
          FROM (SELECT DISTINCT user_id FROM events)),
per_unit AS (SELECT pos, system, ord, fold, gold, prediction, count(*) AS w FROM rows_ JOIN units USING (user_id) GROUP BY ALL),
{sql_draws('units', 3 * REPLICATES, 13)},
valid AS (SELECT replicate FROM draws JOIN units USING (pos) JOIN folds USING (user_id) GROUP BY replicate
          HAVING count(DISTINCT fold) = (SELECT count(DISTINCT fold) FROM folds) ORDER BY replicate LIMIT {REPLICATES}),
drawn AS (SELECT replicate, system, ord, fold, gold, prediction, sum(w) AS w
          FROM draws JOIN valid USING (replicate) JOIN per_unit USING (pos) GROUP BY ALL
          UNION ALL
          SELECT -1, system, ord, fold, gold, prediction, sum(w) FROM per_unit GROUP BY ALL),
long AS (SELECT replicate, system, ord, fold, gold AS label, w AS g, 0 AS p, CASE WHEN gold = prediction THEN w ELSE 0 END AS tp FROM drawn
         UNION ALL SELECT replicate, system, ord, fold, prediction, 0, w, 0 FROM drawn),
per_label AS (SELECT replicate, system, ord, fold, label, sum(g) AS g, sum(p) AS p, sum(tp) AS tp FROM long GROUP BY ALL),
per_fold AS (SELECT replicate, system, ord, fold, sum(tp) / sum(g) AS accuracy, avg(2.0 * tp / (g + p)) AS macro_f1
             FROM per_label GROUP BY ALL),
scored AS (SELECT replicate, system, ord, avg(accuracy) AS accuracy, avg(macro_f1) AS macro_f1 FROM per_fold GROUP BY ALL),
both_ AS (SELECT 'accuracy' AS metric, system, ord, replicate, accuracy AS value FROM scored
          UNION ALL SELECT 'macro_f1', system, ord, replicate, macro_f1 FROM scored),
points AS (SELECT metric, system, ord, value FROM both_ WHERE replicate = -1),
boot AS (SELECT metric, system, ord, replicate, value FROM both_ WHERE replicate >= 0),
{_sql_summary('points', 'boot')}
"""


# -- verification -----------------------------------------------------------

MAX_TRIALS = 5000


def trials_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = verify.all_pairs_summary(utterances(spark, sf_dir), speaker="speaker", vector="embedding")
    return rounded(result, "mean_target", "mean_nontarget")


SQL_PAIRS = f"""
{SQL_UTTERANCES},
unit_ AS (SELECT vec_id, speaker, list_transform(embedding, lambda x: x / (sqrt(list_dot_product(embedding, embedding)) + 1e-8)) AS u
          FROM utterances),
pairs AS (SELECT (a.speaker = b.speaker)::INT AS label, list_dot_product(a.u, b.u) AS score
          FROM unit_ a JOIN unit_ b ON a.vec_id < b.vec_id)
"""

SQL_ALL_PAIRS = f"""
WITH {SQL_PAIRS}
SELECT count(*) AS n_pairs, count(*) FILTER (label = 1) AS n_target, count(*) FILTER (label = 0) AS n_nontarget,
       {sql_round('avg(score) FILTER (label = 1)')} AS mean_target,
       {sql_round('avg(score) FILTER (label = 0)')} AS mean_nontarget
FROM pairs
"""


def verification_eer_mindcf(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = verify.all_pairs_metrics(
        utterances(spark, sf_dir), key="vec_id", speaker="speaker", vector="embedding"
    )
    return rounded(result, "eer", "min_dcf")


def sql_eer(trials: str, group: str = "", weight: str = "1.0") -> str:
    """CTE ``metrics`` (group, eer, min_dcf) over a CTE of trials."""
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    by = f"GROUP BY {group}" if group else ""
    join = f"JOIN tot USING ({group})" if group else ", tot"
    return f"""
per_score AS (SELECT {g}score, sum(CASE WHEN label = 1 THEN {weight} ELSE 0 END) AS t,
              sum(CASE WHEN label = 0 THEN {weight} ELSE 0 END) AS n FROM {trials} GROUP BY {g}score),
tot AS (SELECT {g}sum(t) AS tt, sum(n) AS tn FROM per_score {by}),
cum AS (SELECT {g}score, sum(t) OVER ({part}ORDER BY score DESC) AS ct, sum(n) OVER ({part}ORDER BY score DESC) AS cn FROM per_score),
pts AS (SELECT {g}score, 1.0 - ct / tt AS fnr, cn / tn AS fpr FROM cum {join}),
best AS (SELECT {g}min(abs(fnr - fpr)) AS gap,
         arg_min((fnr + fpr) / 2, row(abs(fnr - fpr), -score)) AS eer,
         min((0.01 * fnr + 0.99 * fpr) / 0.01) AS cost FROM pts {by}),
metrics AS (SELECT {g}CASE WHEN gap >= 1 THEN 0.5 ELSE eer END AS eer, least(1.0, cost) AS min_dcf FROM best)
"""


SQL_EER = f"""
WITH {SQL_PAIRS}, scored AS (SELECT label, round(score, 12) AS score FROM pairs), {sql_eer('scored')}
SELECT {sql_round('eer')} AS eer, {sql_round('min_dcf')} AS min_dcf FROM metrics
"""


def capped_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.sample_trials(
        utterances(spark, sf_dir), key="vec_id", speaker="speaker", max_trials=MAX_TRIALS, seed=17
    )


def _sql_ranks(name: str, space: str, k: str, seed: int, salt: str, walks: int = 6) -> str:
    """CTE ``<name>_rank`` (rank): images of 0 .. k - 1 under the seeded permutation of [0, space)."""
    ctes = [
        f"""{name}_p0 AS (SELECT s, r, w, x // w AS a, x % w AS b, false AS done FROM (
  SELECT s, r, (s + r - 1) // r AS w, unnest(range(k)) AS x FROM (SELECT {space} AS s, floor(sqrt({space}::DOUBLE))::BIGINT + 1 AS r, {k} AS k FROM quota)))"""
    ]
    for i in range(4 * walks):
        turn = i % 4
        side, other, length = ("a", "b", "r") if turn % 2 == 0 else ("b", "a", "w")
        word = sql_index(sql_hash(seed, salt, str(turn), other), "1073741824")
        a, b = (f"({side} + {word}) % {length}", "b") if side == "a" else ("a", f"({side} + {word}) % {length}")
        done = f"{a} * w + {b} < s" if turn == 3 else "false"
        ctes.append(
            f"""{name}_p{i + 1} AS (SELECT s, r, w, CASE WHEN done THEN a ELSE {a} END AS a, CASE WHEN done THEN b ELSE {b} END AS b,
  done OR ({done}) AS done FROM {name}_p{i})"""
        )
    return ",\n".join(ctes) + f",\n{name}_rank AS (SELECT a * w + b AS rank FROM {name}_p{4 * walks} WHERE done)"


SQL_CAPPED = f"""
{SQL_UTTERANCES},
placed AS (SELECT vec_id, speaker, embedding, row_number() OVER (PARTITION BY speaker ORDER BY {sql_hash(17, 'trial', 'vec_id')}, vec_id) - 1 AS q FROM utterances),
sizes AS (SELECT speaker, count(*) AS n FROM placed GROUP BY speaker),
spk AS (SELECT speaker, n,
          coalesce(sum(n) OVER w, 0)::BIGINT AS start,
          coalesce(sum(n * (n - 1) // 2) OVER w, 0)::BIGINT AS t_low, h FROM
          (SELECT *, {sql_hash(17, 'speaker', 'speaker')} AS h FROM sizes)
          WINDOW w AS (ORDER BY h, speaker ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
spk2 AS (SELECT *, coalesce(sum(n * start) OVER (ORDER BY h, speaker ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS n_low FROM spk),
ordered AS (SELECT vec_id, speaker, start, q + start AS pos, t_low + q * (q - 1) // 2 AS t_row, q AS t_len,
                   n_low + q * start AS n_row, start AS n_len FROM placed JOIN spk2 USING (speaker)),
space AS (SELECT sum(t_len)::BIGINT AS nt, sum(n_len)::BIGINT AS nn FROM ordered),
quota AS (SELECT nt, nn, least(nt, {MAX_TRIALS // 2}) AS kt, least(nn, {MAX_TRIALS} - least(nt, {MAX_TRIALS // 2})) AS kn FROM space),
{_sql_ranks('t', 'nt', 'kt', 17, 'target')},
{_sql_ranks('n', 'nn', 'kn', 17, 'nontarget')},
trials AS (
  SELECT a.vec_id AS "left", b.vec_id AS "right", a.speaker AS spk_a, b.speaker AS spk_b, 1 AS label
  FROM t_rank JOIN ordered a ON rank >= a.t_row AND rank < a.t_row + a.t_len
              JOIN ordered b ON b.pos = a.start + rank - a.t_row
  UNION ALL
  SELECT a.vec_id, b.vec_id, a.speaker, b.speaker, 0
  FROM n_rank JOIN ordered a ON rank >= a.n_row AND rank < a.n_row + a.n_len
              JOIN ordered b ON b.pos = rank - a.n_row)
"""


def rooted(vector: str) -> Column:
    """The second model of a vector: signed square roots of all its components."""
    return F.transform(vector, lambda x: F.signum(x) * F.sqrt(F.abs(x)))


def trial_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn trials scored by whole vectors and by their signed roots."""
    utts = utterances(spark, sf_dir)
    trials = verify.sample_trials(utts, key="vec_id", speaker="speaker", max_trials=MAX_TRIALS, seed=17)
    roots = utts.select("vec_id", rooted("embedding").alias("embedding"))
    plain = verify.score_trials(trials, utts.select("vec_id", "embedding"), key="vec_id", vector="embedding")
    root = verify.score_trials(trials, roots, key="vec_id", vector="embedding")
    named = [
        d.select(
            F.lit(s).alias("system"), F.lit(o).alias("ord"), F.lit("none").alias("seed"),
            F.concat_ws("-", "left", "right").alias("trial_id"), "spk_a", "spk_b", "label",
            F.round("score", 12).alias("score"),
        )
        for s, o, d in (("plain", 0, plain), ("root", 1, root))
    ]
    return named[0].unionByName(named[1])


def _verification(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    entries = cut_lineage(trial_entries(spark, sf_dir), "trials")
    result = bootstrap.bootstrap_verification(entries, replicates=REPLICATES, seed=19, unit=unit)
    return rounded(result, *SUMMARY_VALUES)


def verification_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verification(spark, sf_dir, "speaker")


def verification_trial_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verification(spark, sf_dir, "trial")


SQL_MODELS = """
models AS (SELECT 'plain' AS system, 0 AS ord, vec_id, speaker, embedding AS x FROM utterances
           UNION ALL SELECT 'root', 1, vec_id, speaker, list_transform(embedding, lambda e: sign(e) * sqrt(abs(e))) FROM utterances)
"""


def _sql_verification(units: str, weighted: str) -> str:
    """``units`` has (unit, pos); ``weighted`` makes (replicate, system, ord, label, score, w) of scored and mult."""
    return f"""
WITH {SQL_CAPPED}, {SQL_MODELS},
unit_ AS (SELECT system, ord, vec_id, list_transform(x, lambda e: e / (sqrt(list_dot_product(x, x)) + 1e-8)) AS u FROM models),
scored AS (SELECT a.system, a.ord, "left" || '-' || "right" AS trial_id, spk_a, spk_b, label, round(list_dot_product(a.u, b.u), 12) AS score
           FROM trials JOIN unit_ a ON a.vec_id = "left" JOIN unit_ b ON b.vec_id = "right" AND a.system = b.system),
{units},
{sql_draws('units', REPLICATES + 100, 19)},
mult AS (SELECT replicate, unit, count(*) AS m FROM draws JOIN units USING (pos) GROUP BY ALL),
weighted AS ({weighted}),
valid AS (SELECT replicate FROM weighted GROUP BY replicate HAVING count(DISTINCT label) = 2 ORDER BY replicate LIMIT {REPLICATES}),
everything AS (SELECT replicate, system, ord, label, score, w FROM weighted JOIN valid USING (replicate)
               UNION ALL SELECT -1, system, ord, label, score, 1 FROM scored),
{sql_eer('everything', 'replicate, system, ord', 'w')},
both_ AS (SELECT 'eer' AS metric, system, ord, replicate, eer AS value FROM metrics
          UNION ALL SELECT 'min_dcf', system, ord, replicate, min_dcf FROM metrics),
points AS (SELECT metric, system, ord, value FROM both_ WHERE replicate = -1),
boot AS (SELECT metric, system, ord, replicate, value FROM both_ WHERE replicate >= 0),
{_sql_summary('points', 'boot')}
"""


SQL_VERIFICATION_BOOTSTRAP = _sql_verification(
    f"""units AS (SELECT spk AS unit, row_number() OVER (ORDER BY {sql_hash(19, 'unit', 'spk')}, spk) - 1 AS pos
          FROM (SELECT spk_a AS spk FROM trials UNION SELECT spk_b FROM trials))""",
    """SELECT a.replicate, system, ord, label, score, CASE WHEN label = 1 THEN a.m ELSE a.m * b.m END AS w
       FROM scored JOIN mult a ON a.unit = spk_a JOIN mult b ON b.unit = spk_b AND a.replicate = b.replicate""",
)

SQL_VERIFICATION_TRIALS = _sql_verification(
    f"""units AS (SELECT trial_id AS unit, row_number() OVER (ORDER BY {sql_hash(19, 'unit', 'trial_id')}, trial_id) - 1 AS pos
          FROM (SELECT DISTINCT trial_id FROM scored))""",
    "SELECT replicate, system, ord, label, score, m AS w FROM scored JOIN mult ON unit = trial_id",
)


def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models under two poolings, ranked by EER over all pairs."""
    utts = utterances(spark, sf_dir)
    models = {
        "plain": F.col("embedding"),
        "root": rooted("embedding"),
    }
    rows = None
    for pool in ("mean", "meanstd"):
        for model, vector in models.items():
            pooled = utts.select(
                "vec_id", "speaker", embeddings.pool_array(embeddings.frames_of(vector, 8), pool).alias("v")
            )
            one = verify.all_pairs_metrics(pooled, key="vec_id", speaker="speaker", vector="v").select(
                F.lit(pool).alias("pool"), F.lit(model).alias("model"), "eer", "min_dcf"
            )
            rows = one if rows is None else rows.unionByName(one)
    return rounded(verify.leaderboard(rows), "eer", "min_dcf")


SQL_LEADERBOARD = f"""
WITH {SQL_UTTERANCES}, {SQL_MODELS},
vec AS (SELECT system AS model, vec_id, speaker, x FROM models),
dims AS (SELECT model, vec_id, speaker, d, list_avg(list_transform(range(len(x) // 8), lambda t: x[t * 8 + d + 1])) AS m,
                list_stddev_pop(list_transform(range(len(x) // 8), lambda t: x[t * 8 + d + 1])) AS s
         FROM vec, range(8) r(d)),
pooled AS (SELECT 'mean' AS pool, model, vec_id, speaker, list(m ORDER BY d) AS v FROM dims GROUP BY ALL
           UNION ALL
           SELECT 'meanstd', model, vec_id, speaker, list_concat(list(m ORDER BY d), list(s ORDER BY d)) FROM dims GROUP BY ALL),
unit_ AS (SELECT pool, model, vec_id, speaker, list_transform(v, lambda e: e / (sqrt(list_dot_product(v, v)) + 1e-8)) AS u FROM pooled),
pairs AS (SELECT a.pool, a.model, (a.speaker = b.speaker)::INT AS label, round(list_dot_product(a.u, b.u), 12) AS score
          FROM unit_ a JOIN unit_ b ON a.pool = b.pool AND a.model = b.model AND a.vec_id < b.vec_id),
{sql_eer('pairs', 'pool, model')}
SELECT pool, model, {sql_round('eer')} AS eer, {sql_round('min_dcf')} AS min_dcf,
       rank() OVER (PARTITION BY pool ORDER BY eer)::INTEGER AS place FROM metrics
"""


# -- alignment and coverage -------------------------------------------------


def alignment_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Systems with planted gaps, doubles and changed references."""
    turns = table(spark, sf_dir, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("unit_id"), "conv_id", F.col("text").alias("reference")
    )
    lost = F.pmod("conv_id", F.lit(9)) == 4
    changed = F.pmod("conv_id", F.lit(11)) == 5
    base = turns.select(F.lit("base").alias("system"), F.lit("0").alias("seed"), "unit_id", "reference")
    tuned = turns.where(~lost).select(
        F.lit("tuned").alias("system"), F.lit("0").alias("seed"), "unit_id",
        F.when(changed, F.concat("reference", F.lit("!"))).otherwise(F.col("reference")).alias("reference"),
    )
    entries = base.unionByName(tuned)
    found = bootstrap.check_alignment(entries).unionByName(
        bootstrap.check_invariants(entries, ["reference"]).withColumn("detail", F.lit("reference"))
    )
    sides = bootstrap.set_difference(base, tuned, "unit_id").select(
        F.concat(F.lit("difference_"), "side").alias("rule"), F.col("unit_id").alias("key"), F.lit("base").alias("detail")
    )
    return found.unionByName(sides)


SQL_ALIGNMENT = """
WITH turns AS (SELECT conv_id || ':' || turn AS unit_id, conv_id FROM conversations)
SELECT 'missing_unit' AS rule, unit_id AS key, 'tuned/0' AS detail FROM turns WHERE conv_id % 9 = 4
UNION ALL SELECT 'invariant', unit_id, 'reference' FROM turns WHERE conv_id % 11 = 5 AND conv_id % 9 <> 4
UNION ALL SELECT 'difference_missing', unit_id, 'base' FROM turns WHERE conv_id % 9 = 4
"""


def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of a metric that fails on error events, with strict gate."""
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("item_id"),
        F.explode(
            F.array(
                F.struct(F.lit("gain").alias("metric"), F.col("value").alias("value"), F.lit(None).cast("string").alias("error")),
                F.struct(
                    F.lit("snr").alias("metric"),
                    F.when(F.col("event_type") != "error", F.col("value") * 2).alias("value"),
                    F.when(F.col("event_type") == "error", F.concat(F.lit("silent item "), "event_id")).alias("error"),
                ),
            )
        ).alias("m"),
    ).select("item_id", "m.*")
    report = reports.metric_coverage(events, expected=table(spark, sf_dir, "events").count())
    failures = reports.failure_examples(events, 20)
    listed = failures.groupBy("metric").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "error"))), lambda e: e["error"]), ";").alias("failure_examples")
    )
    joined = report.join(listed, "metric", "left").withColumn(
        "failure_examples", F.coalesce("failure_examples", F.lit(""))
    )
    return rounded(joined, "mean")


SQL_COVERAGE = f"""
WITH bad AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS rank FROM events WHERE event_type = 'error'),
listed AS (SELECT coalesce(string_agg('silent item ' || event_id, ';' ORDER BY rank), '') AS s FROM bad WHERE rank <= 20)
SELECT 'gain' AS metric, count(*) AS attempted, count(*) AS succeeded, 0::BIGINT AS failed, {sql_round('avg(value)')} AS mean,
       true AS strict_complete, '' AS failure_examples FROM events
UNION ALL
SELECT 'snr', count(*), count(*) FILTER (event_type <> 'error'), count(*) FILTER (event_type = 'error'),
       {sql_round("avg(value * 2) FILTER (event_type <> 'error')")}, count(*) FILTER (event_type = 'error') = 0, max(s) FROM events, listed
"""


def seed_order_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds (integers, then names) numbered in natural order with counts."""
    from pyspark.sql import Window

    seeds = table(spark, sf_dir, "events").select(
        F.when(F.pmod("user_id", F.lit(7)) == 0, F.col("event_type"))
        .otherwise(F.pmod("user_id", F.lit(25)).cast("string")).alias("seed")
    ).groupBy("seed").agg(F.count(F.lit(1)).alias("n"))
    # one row per seed name reaches this window
    return seeds.withColumn(
        "place", F.row_number().over(Window.orderBy(*bootstrap.seed_order(F.col("seed"))))
    )


SQL_SEED_ORDER = """
WITH s AS (SELECT CASE WHEN user_id % 7 = 0 THEN event_type ELSE (user_id % 25)::VARCHAR END AS seed, count(*) AS n FROM events GROUP BY 1)
SELECT seed, n, row_number() OVER (ORDER BY try_cast(seed AS BIGINT) IS NULL, try_cast(seed AS BIGINT), seed)::INTEGER AS place FROM s
"""

QUERIES = {
    "asr_counts": asr_counts,
    "asr_rates": asr_rates,
    "asr_bootstrap_ci": asr_bootstrap_ci,
    "metric_bootstrap_ci": metric_bootstrap_ci,
    "classification_metrics": classification_metrics,
    "classification_cluster_bootstrap": classification_cluster_bootstrap,
    "trials_all_pairs": trials_all_pairs,
    "verification_eer_mindcf": verification_eer_mindcf,
    "capped_trials": capped_trials,
    "verification_bootstrap": verification_bootstrap,
    "verification_trial_bootstrap": verification_trial_bootstrap,
    "leaderboard": leaderboard,
    "alignment_violations": alignment_violations,
    "coverage_report": coverage_report,
    "seed_order_examples": seed_order_examples,
}

ORACLES = {
    "asr_counts": f"WITH {SQL_TRANSCRIPTS} SELECT system, seed, unit_id, word_errors, word_units, char_errors, char_units FROM counts",
    "asr_rates": f"""WITH {SQL_TRANSCRIPTS} SELECT system, seed, count(*) AS utterances,
        {sql_round('sum(word_errors) / sum(word_units)')} AS wer, {sql_round('sum(char_errors) / sum(char_units)')} AS cer
        FROM counts GROUP BY system, seed""",
    "asr_bootstrap_ci": SQL_ASR_BOOTSTRAP,
    "metric_bootstrap_ci": SQL_METRIC_BOOTSTRAP,
    "classification_metrics": SQL_CLASSIFICATION,
    "classification_cluster_bootstrap": SQL_CLUSTER,
    "trials_all_pairs": SQL_ALL_PAIRS,
    "verification_eer_mindcf": SQL_EER,
    "capped_trials": f'WITH {SQL_CAPPED} SELECT "left", "right", spk_a, spk_b, label FROM trials',
    "verification_bootstrap": SQL_VERIFICATION_BOOTSTRAP,
    "verification_trial_bootstrap": SQL_VERIFICATION_TRIALS,
    "leaderboard": SQL_LEADERBOARD,
    "alignment_violations": SQL_ALIGNMENT,
    "coverage_report": SQL_COVERAGE,
    "seed_order_examples": SQL_SEED_ORDER,
}
