"""Speaker-verification trials, equal error rate and detection cost.

Three ways to a result, all exact:

* ``verification_metrics`` works on a table of scored trials;
* ``all_pairs_summary`` and ``all_pairs_metrics`` cover every utterance pair
  without writing any pair to a table;
* ``sample_trials`` draws a stratified trial list by rank, so the pairs that are
  not drawn are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from utterset.functions import vectors
from utterset.functions.hashing import order_key, permuted_rank
from utterset.operators.sampling import with_shared_group_order
from utterset.plans.ordering import beside, buckets_for, interval_lookup, running_totals
from utterset.session import Scratch, sized, slots

P_TARGET = 0.01


# --------------------------------------------------------------------------
# metrics of a scored trial table


def _operating_points(points: DataFrame, group: list[str], p_target: float) -> DataFrame:
    """Best |FNR-FPR| point and least cost from cumulative target/non-target weight.

    ``points`` has one row per threshold: score, cum_t, cum_n, tot_t, tot_n.
    """
    norm = min(p_target, 1.0 - p_target)
    fnr = 1.0 - F.col("cum_t") / F.col("tot_t")
    fpr = F.col("cum_n") / F.col("tot_n")
    rated = points.withColumn("fnr", fnr).withColumn("fpr", fpr)
    # the first minimum is the one with the highest threshold
    best = F.min_by(
        F.struct(F.abs(F.col("fnr") - F.col("fpr")).alias("gap"), F.col("fnr"), F.col("fpr")),
        F.struct(F.abs(F.col("fnr") - F.col("fpr")), -F.col("score")),
    )
    cost = (F.lit(p_target) * F.col("fnr") + F.lit(1.0 - p_target) * F.col("fpr")) / norm
    return (
        rated.groupBy(*group)
        .agg(best.alias("best"), F.min(cost).alias("cost"))
        .select(
            *group,
            F.when(F.col("best.gap") >= 1.0, F.lit(0.5))
            .otherwise((F.col("best.fnr") + F.col("best.fpr")) / 2)
            .alias("eer"),
            F.least(F.lit(p_target / norm), F.col("cost")).alias("min_dcf"),
        )
    )


def verification_metrics(
    trials: DataFrame,
    *,
    group: Sequence[str] = (),
    weight: str | None = None,
    p_target: float = P_TARGET,
    buckets: int | None = None,
) -> DataFrame:
    """EER and normalised minimum detection cost per ``group``.

    Needs ``score`` and ``label`` (1 target, 0 non-target).  Equal scores form
    one threshold.  Groups without both kinds of trial give no row.
    """
    group = list(group)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    per_score = trials.groupBy(*group, F.col("score").cast("double").alias("score")).agg(
        F.sum(F.when(F.col("label") == 1, w).otherwise(0.0)).alias("t"),
        F.sum(F.when(F.col("label") == 0, w).otherwise(0.0)).alias("n"),
    )
    per_score = sized(per_score)
    totals = sized(
        per_score.groupBy(*group).agg(
            F.sum("t").alias("tot_t"), F.sum("n").alias("tot_n"), F.count(F.lit(1)).alias("rows")
        )
    )
    largest = totals.agg(F.max("rows")).first()[0] or 0
    cumulative = running_totals(
        per_score, group, "score", ["t", "n"], descending=True, buckets=buckets or buckets_for(largest)
    )
    totals = totals.where((F.col("tot_t") > 0) & (F.col("tot_n") > 0)).drop("rows")
    points = cumulative.join(totals, group) if group else beside(cumulative, totals).where("tot_t IS NOT NULL")
    return _operating_points(points, group, p_target)


def trial_violations(trials: DataFrame) -> DataFrame:
    """Broken trial rules: label, finite score, speaker relation, duplicate ID."""
    from utterset import violations as v

    key = F.col("trial_id")
    label, score = F.col("label"), F.col("score")
    rows = v.rules(
        trials,
        key,
        {
            "binary_label": (label.isNull() | ~label.isin(0, 1), label),
            "finite_score": (~vectors.is_finite(score), score),
            "target_within_speaker": (
                (label == 1) & (F.col("spk_a") != F.col("spk_b")),
                F.concat_ws("/", "spk_a", "spk_b"),
            ),
            "nontarget_across_speakers": (
                (label == 0) & (F.col("spk_a") == F.col("spk_b")),
                F.concat_ws("/", "spk_a", "spk_b"),
            ),
        },
    )
    return rows.unionByName(v.duplicates(trials, "trial_id", "duplicate_trial"))


# --------------------------------------------------------------------------
# every pair, without listing pairs


def all_pairs_summary(emb: DataFrame, *, speaker: str, vector: str) -> DataFrame:
    """Counts and mean cosine of all target and non-target pairs, in linear time.

    The sum of x_i.x_j over pairs i<j is (|sum x|^2 - sum |x|^2) / 2, overall and
    per speaker, so no pair is formed.
    """
    unit = emb.select(
        F.col(speaker).alias("spk"), vectors.unit(vectors.as_double(F.col(vector))).alias("u")
    )
    per_dim = unit.select("spk", F.posexplode("u").alias("dim", "x")).groupBy("spk", "dim").agg(
        F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("s2"), F.count(F.lit(1)).alias("n")
    )
    per_speaker = per_dim.groupBy("spk").agg(
        ((F.sum(F.col("s") * F.col("s")) - F.sum("s2")) / 2).alias("target_sum"),
        F.max("n").alias("n"),
    )
    overall = (
        per_dim.groupBy("dim")
        .agg(F.sum("s").alias("s"), F.sum("s2").alias("s2"))
        .agg(((F.sum(F.col("s") * F.col("s")) - F.sum("s2")) / 2).alias("pair_sum"))
    )
    counts = per_speaker.agg(
        F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("n_target"),
        (F.sum("n") * (F.sum("n") - 1) / 2).cast("long").alias("n_pairs"),
        F.sum("target_sum").alias("target_sum"),
    )
    return beside(counts, overall).select(
        "n_pairs",
        "n_target",
        (F.col("n_pairs") - F.col("n_target")).alias("n_nontarget"),
        (F.col("target_sum") / F.col("n_target")).alias("mean_target"),
        ((F.col("pair_sum") - F.col("target_sum")) / (F.col("n_pairs") - F.col("n_target"))).alias(
            "mean_nontarget"
        ),
    )


# a score kept to 12 decimals is an integer key; the smallest is above 2**36
KEY_SCALE, KEY_ZERO, KEY_BITS = 1e12, float(1 << 40), 41
NOT_A_SCORE = -KEY_SCALE - 1.0  # below every score
FEW_PAIRS = 1 << 20  # so few are counted score by score at once
CELLS = 1 << 17  # scores that a task holds at once


def _vector_blocks(emb: DataFrame, speaker: str, vector: str, n: int, block_rows: int) -> DataFrame:
    """(id, codes, vectors): at most ``block_rows`` rows each, vectors as the bytes of a matrix."""
    placed = emb.select(
        F.col(speaker).cast("string").alias("code"),
        vectors.unit(vectors.as_double(F.col(vector))).alias("u"),
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, codes = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            u = batch.column("u")
            lengths = u.value_lengths().to_numpy(zero_copy_only=False)
            if u.null_count or (lengths != lengths[0]).any():
                raise ValueError("vectors must be present and of one length")
            rows = u.flatten().to_numpy(zero_copy_only=False).reshape(len(u), -1)
            held = rows if held is None else np.concatenate([held, rows])
            codes += batch.column("code").to_pylist()
            while len(held) >= block_rows:
                yield packed(held[:block_rows], codes[:block_rows])
                held, codes = held[block_rows:], codes[block_rows:]
        if codes:
            yield packed(held, codes)

    def packed(rows: np.ndarray, codes: list[str]) -> pa.RecordBatch:
        columns = [pa.array([codes], pa.list_(pa.string())), pa.array([rows.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["codes", "vectors"])

    spread = placed.repartition(-(-n // block_rows))
    blocks = spread.mapInArrow(pack, "codes array<string>, vectors binary")
    return blocks.withColumn("id", F.monotonically_increasing_id())


def _block_pairs(blocks: DataFrame) -> DataFrame:
    """Every block beside itself and every other, each pair once; nothing is shuffled for it."""
    a, b = (blocks.select(*[F.col(c).alias(f"{c}_{x}") for c in blocks.columns]) for x in "ab")
    # a hash says which of the two comes first, so that every block leads about half its pairs
    half = F.pmod(F.xxhash64(F.least("id_a", "id_b"), F.greatest("id_a", "id_b")), F.lit(2)) == 0
    same = F.col("id_a") == F.col("id_b")
    pairs = a.join(b, same | ((F.col("id_a") < F.col("id_b")) == half))
    return pairs.withColumn("same", same).drop("id_a", "id_b").coalesce(8 * blocks.sparkSession.sparkContext.defaultParallelism)


def _pair_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Score keys (as doubles) and whether the speakers agree, for some pairs at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            names = [batch.column(f"codes_{x}")[i].as_py() for x in "ab"]
            left, right = (
                np.frombuffer(batch.column(f"vectors_{x}")[i].as_buffer(), dtype=float).reshape(len(c), -1)
                for x, c in zip("ab", names, strict=True)
            )
            code = pd.factorize(np.array(names[0] + names[1], dtype=object))[0]
            code_a, code_b = code[: len(left)], code[len(left) :]
            finite = np.isfinite(left).all() and np.isfinite(right).all()
            same, step = batch.column("same")[i].as_py(), max(1, CELLS // len(right))
            for lo in range(0, len(left), step):
                keys = left[lo : lo + step] @ right.T
                keys *= KEY_SCALE
                np.rint(keys, out=keys)
                if not finite:
                    keys[np.isnan(keys)] = NOT_A_SCORE
                keys += KEY_ZERO
                target = code_a[lo : lo + step, None] == code_b[None, :]
                if same:
                    later = np.arange(len(right))[None, :] > np.arange(lo, lo + len(keys))[:, None]
                    yield keys[later], target[later]
                else:
                    yield keys.ravel(), target.ravel()


def _all_bins(shift: int):
    """(bin, t, n) of all pairs, bins of 2**shift keys."""
    bins = 1 << (KEY_BITS - shift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, hits = np.zeros(bins, dtype=np.int64), np.zeros(bins, dtype=np.int64)
        for keys, target in _pair_keys(batches):
            keys *= 2.0**-shift
            code = keys.astype(np.int64)
            whole += np.bincount(code, minlength=bins)
            hits += np.bincount(code[target], minlength=bins)
        code = np.flatnonzero(whole)
        yield _counts(code, hits[code], whole[code] - hits[code])

    return run


def _inner_bins(top: int, at: int, chosen: np.ndarray, shift: int):
    """The same for pairs inside the ``chosen`` bins (ascending) of 2**at keys alone.

    A few spans of keys are compared one by one; many are looked up among bins of 2**top keys first.
    """
    spans = np.split(chosen, np.flatnonzero(np.diff(chosen) > 1) + 1)
    spans = [(float(x[0] << at), float((x[-1] + 1) << at)) for x in spans] if len(spans) <= 4 else []
    wanted = np.zeros(1 << (KEY_BITS - top), dtype=bool)
    wanted[chosen >> (top - at)] = True

    def places(keys: np.ndarray) -> np.ndarray:
        if spans:
            return np.flatnonzero(reduce(np.logical_or, [(keys >= low) & (keys < high) for low, high in spans]))
        found = np.flatnonzero(wanted[(keys * 2.0**-top).astype(np.int64)])
        return found[np.isin(keys[found].astype(np.int64) >> at, chosen)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, sizes, waiting = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            codes, inverse = np.unique(np.concatenate(kept), return_inverse=True)
            return codes, np.bincount(inverse, weights=np.concatenate(sizes)).astype(np.int64)

        for keys, target in _pair_keys(batches):
            found = places(keys)
            # a bin's targets and non-targets are neighbours
            codes, size = np.unique((keys[found].astype(np.int64) >> shift) * 2 + target[found], return_counts=True)
            kept.append(codes)
            sizes.append(size)
            waiting += len(codes)
            if waiting > FEW_PAIRS:
                codes, size = merged()
                kept, sizes, waiting = [codes], [size], 0
        if kept:
            codes, size = merged()
            yield _counts(codes >> 1, np.where(codes & 1, size, 0), np.where(codes & 1, 0, size))

    return run


def _counts(code: np.ndarray, t: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (code, t, n)], names=["bin", "t", "n"])


def all_pairs_metrics(
    emb: DataFrame,
    *,
    key: str,
    speaker: str,
    vector: str,
    p_target: float = P_TARGET,
    block_rows: int = 4096,
    bins: int = 65536,
) -> DataFrame:
    """Exact EER and minimum cost over all pairs: one row.

    Rows are stored once as blocks.  Every block meets every other in a product
    without a shuffle, is scored against it by a matrix product, and a task leaves
    only counts per score bin (about ``bins`` of them).  The bins fix the error rates
    at every bin edge; bins that can hold the EER crossing or a lower cost are cut
    into finer ones and counted again, until a bin is one score of 12 decimals.
    """
    n_rows = emb.count()
    if n_rows < 2:
        raise ValueError("verification needs at least two utterances")
    scratch = Scratch(emb.sparkSession, "pairs")
    parallel = emb.sparkSession.sparkContext.defaultParallelism
    # a small table in smaller blocks, so that every slot has some
    rows = max(1, min(block_rows, max(64, -(-n_rows // (2 * parallel)))))
    blocks = scratch.keep(_vector_blocks(emb, speaker, vector, n_rows, rows), "blocks")
    pairs = _block_pairs(blocks)

    def histogram(run) -> list[np.ndarray]:
        counted = pairs.mapInArrow(run, "bin long, t long, n long").groupBy("bin")
        found = counted.agg(F.sum("t").alias("t"), F.sum("n").alias("n")).toPandas().sort_values("bin", ascending=False)
        return [found[c].to_numpy(np.int64) for c in ("bin", "t", "n")]

    top = shift = KEY_BITS - min(KEY_BITS, max(1, int(bins).bit_length() - 1))
    code, t, n = histogram(_all_bins(shift))
    all_t, all_n = int(t.sum()), int(n.sum())
    if not all_t or not all_n:
        raise ValueError("verification needs target and non-target pairs")
    before_t, before_n, least = np.cumsum(t) - t, np.cumsum(n) - n, p_target
    while True:
        fnr_start, fpr_start = 1.0 - before_t / all_t, before_n / all_n
        fnr_end, fpr_end = 1.0 - (before_t + t) / all_t, (before_n + n) / all_n
        least = min(least, float((p_target * fnr_end + (1.0 - p_target) * fpr_end).min()))
        crossing = (fnr_start - fpr_start >= 0) & (fnr_end - fpr_end <= 0)
        if not shift:
            break
        # no threshold inside a bin has fewer misses than its end, or fewer false alarms than its start
        keep = crossing | (p_target * fnr_end + (1.0 - p_target) * fpr_start < least)
        chosen, kept_t, kept_n = code[keep], before_t[keep], before_n[keep]
        finer = max(1, (bins // len(chosen)).bit_length() - 1)
        at, shift = shift, 0 if int((t + n)[keep].sum()) <= FEW_PAIRS else max(0, shift - finer)
        code, t, n = histogram(_inner_bins(top, at, np.sort(chosen), shift))
        # running totals start anew in every chosen bin, at what stood before it
        owner = np.searchsorted(-chosen, -(code >> (at - shift)))
        first = np.searchsorted(owner, owner)
        sum_t, sum_n = np.cumsum(t) - t, np.cumsum(n) - n
        before_t, before_n = kept_t[owner] + sum_t - sum_t[first], kept_n[owner] + sum_n - sum_n[first]
    # thresholds next to the crossing, the highest first; before the first score there is none
    fnr = np.stack([fnr_start, fnr_end], axis=1)[crossing].ravel()
    fpr = np.stack([fpr_start, fpr_end], axis=1)[crossing].ravel()
    real = np.stack([before_t + before_n > 0, np.ones(len(t), dtype=bool)], axis=1)[crossing].ravel()
    gap = np.where(real, np.abs(fnr - fpr), np.inf)
    best = int(np.argmin(gap))
    eer = 0.5 if gap[best] >= 1.0 else float(fnr[best] + fpr[best]) / 2
    scratch.drop(blocks)
    norm = min(p_target, 1.0 - p_target)
    return emb.sparkSession.createDataFrame(
        [(eer, min(p_target / norm, least / norm))], "eer double, min_dcf double"
    )


# --------------------------------------------------------------------------
# drawn trials


def class_quotas(n_target: int, n_nontarget: int, max_trials: int) -> tuple[int, int]:
    """Half targets, the rest non-targets; a short class gives its share away."""
    target = min(n_target, max(max_trials // 2, max_trials - n_nontarget))
    return target, min(n_nontarget, max_trials - target)


def _draw_ranks(spark, space: int, k: int, seed: int, salt: str) -> DataFrame:
    """``k`` distinct ranks of ``[0, space)``, uniform without replacement.

    The images of 0 .. k - 1 under a seeded permutation of all ranks: distinct as they
    are, made one by one in any task, by one rule whatever the share of the ranks.
    """
    if not 0 <= k <= space:
        raise ValueError(f"{k} distinct ranks cannot be drawn of {space}")
    numbered = spark.range(0, k, 1, slots(spark, k))
    return numbered.select(permuted_rank(F.col("id"), max(1, space), seed, salt).alias("rank"))


def sample_trials(
    emb: DataFrame, *, key: str, speaker: str, max_trials: int, seed: int
) -> DataFrame:
    """Stratified trials (left, right, spk_a, spk_b, label) without listing pairs.

    Utterances are ordered by speaker; every target and non-target pair has a
    rank in that order, ranks are drawn and turned back into pairs.
    """
    spark = emb.sparkSession
    rows = sized(
        with_shared_group_order(
            emb.select(F.col(key).alias("utt"), F.col(speaker).alias("spk")), "utt", "spk", seed, "trial"
        )
    )
    sizes = rows.groupBy("spk").agg(F.count(F.lit(1)).alias("n"))
    hashed = sizes.withColumn("_h", order_key(seed, "speaker", "spk")).withColumn(
        "_b", F.substring("_h", 1, 3)
    )
    parts = {"n": F.col("n"), "nn": F.col("n") * F.col("n")}
    sums = hashed.groupBy("_b").agg(*[F.sum(e).alias(f"s_{c}") for c, e in parts.items()])
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "_b", *[F.coalesce(F.sum(f"s_{c}").over(before), F.lit(0)).alias(f"o_{c}") for c in parts]
    )
    inside = Window.partitionBy("_b").orderBy("_h", "spk").rowsBetween(Window.unboundedPreceding, -1)
    table = hashed.join(offsets, "_b")
    for c, e in parts.items():
        table = table.withColumn(
            f"p_{c}", F.col(f"o_{c}") + F.coalesce(F.sum(e).over(inside), F.lit(0))
        )
    # start: rows before the speaker; t_low / n_low: ranks before the speaker
    speakers = sized(
        table.select(
            "spk",
            "n",
            F.col("p_n").alias("start"),
            F.expr("(p_nn - p_n) div 2").alias("t_low"),
            F.expr("(p_nn - p_n) div 2 + n * (n - 1) div 2").alias("t_high"),
            F.expr("(p_n * p_n - p_nn) div 2").alias("n_low"),
            F.expr("(p_n * p_n - p_nn) div 2 + n * p_n").alias("n_high"),
        )
    )
    totals = speakers.agg(
        F.max("t_high").alias("t"), F.max("n_high").alias("n"), F.count(F.lit(1)).alias("s")
    ).first()
    n_target, n_nontarget, n_speakers = int(totals["t"]), int(totals["n"]), int(totals["s"])
    if not n_target or not n_nontarget:
        raise ValueError("verification needs target and non-target pairs")
    want_t, want_n = class_quotas(n_target, n_nontarget, max_trials)

    target_ranks = _draw_ranks(spark, n_target, want_t, seed, "target")
    found_t = interval_lookup(
        target_ranks, "rank", speakers, "t_low", "t_high", width=max(1, n_target // n_speakers)
    )
    local = F.col("rank") - F.col("t_low")
    guess = F.floor((1 + F.sqrt(1.0 + 8.0 * local.cast("double"))) / 2).cast("long")
    low_of = lambda q: F.shiftright(q * (q - 1), 1)
    q = (
        F.when(low_of(guess) > local, guess - 1)
        .when(low_of(guess + 1) <= local, guess + 1)
        .otherwise(guess)
    )
    target = found_t.withColumn("q", q).select(
        F.col("spk").alias("spk_a"),
        F.col("spk").alias("spk_b"),
        F.col("q").alias("qa"),
        (local - low_of(F.col("q"))).alias("qb"),
        F.lit(1).alias("label"),
    )

    nontarget_ranks = _draw_ranks(spark, n_nontarget, want_n, seed, "nontarget")
    found_n = interval_lookup(
        nontarget_ranks, "rank", speakers, "n_low", "n_high", width=max(1, n_nontarget // n_speakers)
    )
    far = F.col("rank") - F.col("n_low")
    partners = found_n.select(
        F.col("spk").alias("spk_a"),
        F.expr("(rank - n_low) div start").alias("qa"),  # doubles are inexact from 2^53 on
        F.pmod(far, F.col("start")).alias("partner"),
    )
    n_rows = rows.count()
    spans = speakers.select(
        F.col("spk").alias("spk_b"),
        F.col("start").alias("low"),
        (F.col("start") + F.col("n")).alias("high"),
    )
    nontarget = interval_lookup(
        partners, "partner", spans, "low", "high", width=max(1, n_rows // n_speakers)
    ).select("spk_a", "spk_b", "qa", (F.col("partner") - F.col("low")).alias("qb"), F.lit(0).alias("label"))

    names_a = rows.select(F.col("utt").alias("left"), F.col("spk").alias("spk_a"), F.col("q").alias("qa"))
    names_b = rows.select(F.col("utt").alias("right"), F.col("spk").alias("spk_b"), F.col("q").alias("qb"))
    return (
        target.unionByName(nontarget)
        .join(names_a, ["spk_a", "qa"])
        .join(names_b, ["spk_b", "qb"])
        .select("left", "right", "spk_a", "spk_b", "label")
    )


def score_trials(trials: DataFrame, emb: DataFrame, *, key: str, vector: str) -> DataFrame:
    """Add the cosine ``score`` of each listed trial."""
    unit = emb.select(F.col(key).alias("_k"), vectors.unit(vectors.as_double(F.col(vector))).alias("_u"))
    left = unit.select(F.col("_k").alias("left"), F.col("_u").alias("_ul"))
    right = unit.select(F.col("_k").alias("right"), F.col("_u").alias("_ur"))
    return (
        trials.join(left, "left")
        .join(right, "right")
        .withColumn("score", vectors.dot(F.col("_ul"), F.col("_ur")))
        .drop("_ul", "_ur")
    )


def leaderboard(results: DataFrame, *, pool: str = "pool", metric: str = "eer") -> DataFrame:
    """Rank models inside each pool, best (lowest) first."""
    order = Window.partitionBy(pool).orderBy(metric)
    return results.withColumn("place", F.rank().over(order))
