"""Paired and clustered bootstrap as partial sums of blocks.

A replicate draws n of n units with replacement.  ``plans.resample`` makes the
draws inside the task that holds a block of units, so a replicate costs one partial
sum per block and no draw is ever a row.  The same draws serve every system, seed
and metric.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterset import violations as v
from utterset.functions import vectors
from utterset.functions.hashing import order_key
from utterset.operators import asr, classify, trialboot, verify
from utterset.plans.ordering import with_position
from utterset.plans.resample import per_replicate
from utterset.session import sized

TASKS = ("reconstruction", "asr", "classification", "verification")
SCHEMA_VERSION = "paired-bootstrap-v1"


# --------------------------------------------------------------------------
# alignment of systems and seeds


def check_alignment(entries: DataFrame, unit: str = "unit_id") -> DataFrame:
    """Every (system, seed) must hold the same units, each once."""
    cells = entries.select("system", "seed").distinct()
    n_cells = cells.count()
    counted = entries.groupBy("system", "seed", unit).agg(F.count(F.lit(1)).alias("n"))
    name = F.concat_ws("/", "system", "seed")
    duplicate = v.violation(counted, "duplicate_unit", F.col("n") > 1, F.col(unit), name)
    present = counted.groupBy(unit).agg(
        F.count(F.lit(1)).alias("cells"), F.collect_set(F.struct("system", "seed")).alias("seen")
    )
    gaps = sized(present.where(F.col("cells") < n_cells))
    # only units with a gap meet the list of cells, which is a handful of rows
    every = [(r["system"], r["seed"]) for r in cells.collect()]
    wanted = F.array(*[F.struct(F.lit(s).alias("system"), F.lit(k).alias("seed")) for s, k in every])
    missing = gaps.select(unit, F.explode(F.array_except(wanted, F.col("seen"))).alias("c"))
    absent = missing.select(
        F.lit("missing_unit").alias("rule"),
        F.col(unit).cast("string").alias("key"),
        F.concat_ws("/", "c.system", "c.seed").alias("detail"),
    )
    systems = cells.groupBy("system").agg(F.sort_array(F.collect_set("seed")).alias("seeds"))
    whole = systems.agg(
        F.count(F.lit(1)).alias("systems"), F.count_distinct("seeds").alias("seed_sets")
    )
    few = v.violation(
        whole, "two_systems", F.col("systems") < 2, F.lit("systems"), F.col("systems")
    )
    uneven = v.violation(
        whole, "equal_seed_sets", F.col("seed_sets") > 1, F.lit("seeds"), F.col("seed_sets")
    )
    return v.union_all([duplicate, absent, few, uneven])


def check_invariants(entries: DataFrame, columns: Sequence[str], unit: str = "unit_id") -> DataFrame:
    """The given columns must agree for a unit across systems and seeds."""
    state = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    grouped = entries.groupBy(unit).agg(F.min(state).alias("lo"), F.max(state).alias("hi"))
    return v.violation(
        grouped, "invariant", F.col("lo") != F.col("hi"), F.col(unit), F.concat_ws(" | ", "lo", "hi")
    )


def check_finite(entries: DataFrame, value: str = "value", unit: str = "unit_id") -> DataFrame:
    """Metric values must be present and finite."""
    return v.violation(
        entries, "finite_value", ~vectors.is_finite(F.col(value)), F.col(unit), F.col(value)
    )


def refuse_unpaired(
    entries: DataFrame, unit: str, *, also: str | None = None, fixed: Sequence[str] = (), value: str | None = None
) -> None:
    """Raise unless systems and seeds are comparable unit by unit.

    ``also`` is a column that makes a cell together with system and seed (the
    metric): every unit has every cell once.  ``fixed`` columns must agree across
    systems, ``value`` must be finite.  One grouping finds out whether anything is
    wrong; only then are the faults listed.
    """
    keys = ["system", "seed", *([also] if also else [])]
    cells = [tuple(r) for r in entries.select(*keys).distinct().collect()]
    runs = {(s, k) for s, k, *_ in cells}
    seeds = {s: {k for t, k in runs if t == s} for s, _ in runs}
    state = F.hash(*fixed) if fixed else F.lit(0)
    wrong = ~vectors.is_finite(F.col(value)) if value else F.lit(False)
    here = [reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(x) for k, x in zip(keys, cell)]) for cell in cells]
    once = reduce(lambda a, b: a & b, [F.col(f"n{i}") == 1 for i in range(len(cells))], F.lit(True))
    whole = once & (F.col("lo") == F.col("hi")) & ~F.col("wrong")
    grouped = entries.groupBy(unit).agg(
        *[F.count_if(c).alias(f"n{i}") for i, c in enumerate(here)], F.min(state).alias("lo"),
        F.max(state).alias("hi"), F.max(F.coalesce(wrong, F.lit(True))).alias("wrong"),
    )
    faulty = len(seeds) < 2 or len({frozenset(k) for k in seeds.values()}) > 1
    if not faulty and grouped.where(~whole | F.col(unit).isNull()).isEmpty():
        return
    name = unit
    if also:
        name = "_unit"
        entries = entries.withColumn(name, F.to_json(F.struct(also, unit)))
    found = [check_alignment(entries, name)]
    if also:
        metrics = entries.select(also).distinct().count()
        lacking = entries.groupBy(unit).agg(F.count_distinct(also).alias("n"))
        found.append(v.violation(lacking, "missing_metric", F.col("n") < metrics, F.col(unit), F.col("n")))
    if fixed:
        found.append(check_invariants(entries, fixed, name))
    if value:
        found.append(check_finite(entries, value, name))
    v.assert_empty(v.union_all(found))


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys found on one side only."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(
        b.join(a, key, "left_anti").withColumn("side", F.lit("extra"))
    )


def seed_order(seed: Column) -> list[Column]:
    """Integers by value, then other names."""
    number = seed.try_cast("bigint")
    return [number.isNull(), number, seed]


# --------------------------------------------------------------------------
# draws


def positioned(units: DataFrame, unit: str, seed: int) -> tuple[DataFrame, int]:
    """(units numbered 0..n-1 in seeded order, n); ``units`` has one row per unit."""
    hashed = sized(units.withColumn("_h", order_key(seed, "unit", unit)))
    return with_position(hashed, "_h", [unit]).drop("_h"), hashed.count()


# --------------------------------------------------------------------------
# intervals and summaries


def percentile_ci(values: DataFrame, group: Sequence[str], value: str = "value", confidence: float = 0.95) -> DataFrame:
    """Linear-interpolation percentile interval of the replicates of a group."""
    tail = (1.0 - confidence) / 2.0
    return (
        values.groupBy(*group)
        .agg(F.percentile(value, F.array(F.lit(tail), F.lit(1.0 - tail))).alias("q"))
        .select(*group, F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))
    )


def paired_differences(boot: DataFrame, keys: Sequence[str] = ("metric",)) -> DataFrame:
    """Later minus earlier listed system, replicate by replicate."""
    on = [*keys, "replicate"]
    a = boot.select(*on, F.col("system").alias("system_a"), F.col("ord").alias("ord_a"), F.col("value").alias("va"))
    b = boot.select(*on, F.col("system").alias("system_b"), F.col("ord").alias("ord_b"), F.col("value").alias("vb"))
    return (
        a.join(b, on)
        .where(F.col("ord_a") < F.col("ord_b"))
        .select(*on, "system_a", "system_b", (F.col("vb") - F.col("va")).alias("value"))
    )


def bootstrap_summary(
    points: DataFrame, boot: DataFrame, *, keys: Sequence[str] = ("metric",), confidence: float = 0.95
) -> DataFrame:
    """Rows for every system and every system pair.

    ``points``: (keys, system, ord, seed, value); ``boot``: (keys, system, ord,
    replicate, value), already averaged over seeds.
    """
    keys = list(keys)
    boot = sized(boot)
    per_system = sized(classify.seed_summary(points, [*keys, "system", "ord"]))
    ci = percentile_ci(boot, [*keys, "system"], confidence=confidence)
    systems = per_system.join(ci, [*keys, "system"]).select(
        *keys,
        F.lit("system").alias("kind"),
        "system",
        F.lit(None).cast("string").alias("minus"),
        F.col("seed_mean").alias("estimate"),
        "seed_sample_sd",
        "ci_low",
        "ci_high",
    )
    means = per_system.select(*keys, "system", "seed_mean")
    diff_ci = percentile_ci(paired_differences(boot, keys), [*keys, "system_a", "system_b"], confidence=confidence)
    pairs = (
        diff_ci.join(means.select(*keys, F.col("system").alias("system_a"), F.col("seed_mean").alias("ma")), [*keys, "system_a"])
        .join(means.select(*keys, F.col("system").alias("system_b"), F.col("seed_mean").alias("mb")), [*keys, "system_b"])
        .select(
            *keys,
            F.lit("difference").alias("kind"),
            F.col("system_b").alias("system"),
            F.col("system_a").alias("minus"),
            (F.col("mb") - F.col("ma")).alias("estimate"),
            F.lit(None).cast("double").alias("seed_sample_sd"),
            "ci_low",
            "ci_high",
        )
    )
    return systems.unionByName(pairs)


# --------------------------------------------------------------------------
# additive statistics: mean and ratio of sums


def _cells(entries: DataFrame, extra: Sequence[str] = ()) -> list[tuple]:
    """The compared (system, ord, seed, ...) columns: a handful of rows."""
    columns = ["system", "ord", "seed", *extra]
    return [tuple(r) for r in entries.select(*columns).distinct().orderBy("ord", "seed", *extra).collect()]


def _additive(
    entries: DataFrame, unit: str, sums: dict[str, str], cells: list[tuple], replicates: int, seed: int,
    finish: Callable[[Column, Column], Column],
) -> tuple[DataFrame, DataFrame]:
    """Points and replicates of ``finish(sum numerator, sum denominator)``.

    ``sums`` names the numerator (n) and denominator (d) columns; without a
    denominator rows are counted.  Units become one wide row (a column per
    system, seed and metric), so a block's sums are one matrix product.
    """
    wide_cols = []
    for i, (system, _, run, metric) in enumerate(cells):
        here = (F.col("system") == system) & (F.col("seed") == run) & (F.col("metric") == metric)
        wide_cols += [F.sum(F.when(here, F.col(c)).cast("double")).alias(f"{p}{i}") for p, c in sums.items()]
    wide = entries.groupBy(unit).agg(*wide_cols)
    units, n = positioned(wide, unit, seed)
    units = units.drop(unit)
    columns = [f"{p}{i}" for i in range(len(cells)) for p in sums]
    total = [F.sum(c).alias(c) for c in columns]
    point_row = units.agg(*total).withColumn("replicate", F.lit(-1))

    def sums_of(drawn: np.ndarray, held: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        made = drawn.astype(float) @ np.stack([held[c] for c in columns], axis=1)
        return dict(zip(columns, made.T, strict=True))

    schema = ", ".join(f"{c} double" for c in columns)
    boot_rows = per_replicate(units, columns, sums_of, schema, n, replicates, seed).groupBy("replicate").agg(*total)
    divisor = (lambda i: F.col(f"d{i}")) if "d" in sums else (lambda i: F.lit(float(n)))
    long = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(metric).alias("metric"),
                    F.lit(system).alias("system"),
                    F.lit(order).alias("ord"),
                    F.lit(run).alias("seed"),
                    finish(F.col(f"n{i}"), divisor(i)).alias("value"),
                )
                for i, (system, order, run, metric) in enumerate(cells)
            ]
        )
    )
    points = point_row.select("replicate", long.alias("x")).select("x.*")
    boot = (
        boot_rows.select("replicate", long.alias("x"))
        .select("replicate", "x.*")
        .groupBy("metric", "system", "ord", "replicate")
        .agg(F.avg("value").alias("value"))
    )
    return points, boot


def bootstrap_mean(
    entries: DataFrame, *, replicates: int, seed: int, confidence: float = 0.95, unit: str = "unit_id"
) -> DataFrame:
    """Mean metric per system: utterance resamples, averaged over seeds.

    ``entries``: (system, ord, seed, unit_id, metric, value).  Unequal units,
    values that are not finite and a single system raise.
    """
    refuse_unpaired(entries, unit, also="metric", value="value")
    cells = _cells(entries, ["metric"])
    points, boot = _additive(entries, unit, {"n": "value"}, cells, replicates, seed, lambda a, b: a / b)
    return bootstrap_summary(points, boot, confidence=confidence)


def bootstrap_rate(
    entries: DataFrame, *, replicates: int, seed: int, confidence: float = 0.95, unit: str = "unit_id"
) -> DataFrame:
    """Error rate per system: ratio of sums in every replicate.

    ``entries``: (system, ord, seed, unit_id, reference, hypothesis).  Unequal
    units, a changed reference and a single system raise.
    """
    refuse_unpaired(entries, unit, fixed=["reference"])
    cells = [(*c, m) for c in _cells(entries) for m in ("wer", "cer")]
    counts = asr.asr_counts(entries)
    long = counts.select(
        "system", "ord", "seed", unit,
        F.explode(
            F.array(
                F.struct(F.lit("wer").alias("metric"), F.col("word_errors").alias("e"), F.col("word_units").alias("u")),
                F.struct(F.lit("cer").alias("metric"), F.col("char_errors").alias("e"), F.col("char_units").alias("u")),
            )
        ).alias("c"),
    ).select("system", "ord", "seed", unit, "c.*")
    points, boot = _additive(long, unit, {"n": "e", "d": "u"}, cells, replicates, seed, asr.rate)
    return bootstrap_summary(points, boot, confidence=confidence)


# --------------------------------------------------------------------------
# clustered bootstrap


def first_valid(
    replicates: int, valid: Callable[[int, int], Sequence[int]], most: int = 100
) -> list[int]:
    """Numbers of the first ``replicates`` valid attempts.

    ``valid(start, count)`` gives those of attempts start to start + count - 1.  The
    next round tries as many as the share so far asks for; attempts end at
    ``most`` times the replicates (100 at least), where it raises.
    """
    limit = max(100, most * replicates)
    good: list[int] = []
    tried, wanted = 0, replicates
    while True:
        wanted = min(wanted, limit - tried)
        good += sorted(valid(tried, wanted))
        tried += wanted
        if len(good) >= replicates:
            return good[:replicates]
        if tried >= limit:
            raise ValueError("could not draw enough valid resamples")
        short = replicates - len(good)
        wanted = max(8, -(-short * tried * 5 // (4 * max(1, len(good)))))


def covering_attempts(clusters: DataFrame, n: int, replicates: int, seed: int) -> list[int]:
    """The first attempts that leave no fold empty, from (pos, fold) alone.

    A cluster's folds are a row of bits; a block emits the bits of what it drew and
    the blocks' bits are joined by OR, so no score is touched.
    """
    folds = [r[0] for r in clusters.select("fold").distinct().orderBy("fold").collect()]
    place = F.create_map(*[F.lit(x) for i, f in enumerate(folds) for x in (f, i)])
    units = clusters.select("pos", place[F.col("fold")].alias("f")).groupBy("pos").agg(F.collect_set("f").alias("folds"))
    n_words = -(-len(folds) // 32)

    def bits_of(drawn: np.ndarray, held: dict) -> dict[str, np.ndarray]:
        lists = held["folds"]
        member = np.zeros((len(lists), 32 * n_words))
        member[np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()] = 1
        seen = (drawn > 0) @ member > 0
        weights = 1 << np.arange(32, dtype=np.int64)
        return {f"w{i}": seen[:, 32 * i : 32 * i + 32] @ weights for i in range(n_words)}

    every = F.lit(True)
    for i in range(n_words):
        every = every & (F.col(f"w{i}") == (1 << min(32, len(folds) - 32 * i)) - 1)

    def valid(start: int, count: int) -> list[int]:
        schema = ", ".join(f"w{i} long" for i in range(n_words))
        drawn = per_replicate(units, ["folds"], bits_of, schema, n, count, seed, start)
        seen = drawn.groupBy("replicate").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(n_words)])
        return [r[0] for r in seen.where(every).select("replicate").collect()]

    return first_valid(replicates, valid)


LABELS_AT_ONCE = 512


def _label_sums(drawn: np.ndarray, held: dict) -> dict[str, np.ndarray]:
    """(replicate, label, g, p, tp): sums over a block of the clusters' counts per label of a (system, seed, fold)."""
    lists = held["labels"]
    rows = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    flat = lists.flatten()
    keys, place = np.unique(flat.field("label").to_numpy(), return_inverse=True)
    parts = []
    for lo in range(0, len(keys), LABELS_AT_ONCE):
        here = (place >= lo) & (place < lo + LABELS_AT_ONCE)
        width = min(LABELS_AT_ONCE, len(keys) - lo)
        sums = []
        for name in ("g", "p", "tp"):
            dense = np.zeros((len(lists), width))
            dense[rows[here], place[here] - lo] = flat.field(name).to_numpy()[here]
            sums.append(drawn @ dense)
        at, label = np.nonzero(sums[0] + sums[1])
        parts.append((at, keys[lo + label], *[x[at, label] for x in sums]))
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0)] * 5
    return dict(zip(("replicate", "label", "g", "p", "tp"), columns, strict=True))


def bootstrap_cluster(
    entries: DataFrame, *, replicates: int, seed: int, score: str = "accuracy", confidence: float = 0.95
) -> DataFrame:
    """Classification scores with speakers as the resampled clusters.

    ``entries``: (system, ord, seed, unit_id, speaker_id, fold, gold,
    prediction).  An attempt that empties a fold is drawn again.  Unequal units, a
    changed speaker, fold or gold label and a single system raise.
    """
    spark = entries.sparkSession
    if score not in ("accuracy", "balanced_accuracy"):
        raise ValueError(f"score is accuracy or balanced_accuracy, not {score}")
    refuse_unpaired(entries, "unit_id", fixed=["speaker_id", "fold", "gold"])
    keys = ["system", "ord", "seed"]
    cells = entries.groupBy("speaker_id", *keys, "fold", "gold", "prediction").agg(
        F.count(F.lit(1)).cast("double").alias("w")
    )
    cells = sized(cells)
    speakers, n = positioned(cells.select("speaker_id").distinct(), "speaker_id", seed)
    speakers = sized(speakers)
    good = covering_attempts(cells.join(speakers, "speaker_id").select("pos", "fold").distinct(), n, replicates, seed)

    place = ["label_no", *keys, "fold", "label"]
    per_label = classify.label_counts(cells, ["speaker_id", *keys, "fold"])
    per_label = sized(per_label.withColumn("label_no", F.xxhash64(*keys, "fold", "label")))
    named = sized(per_label.select(*place).distinct())
    if named.select("label_no").distinct().count() < named.count():
        raise ValueError("two labels have one hash")
    of_cluster = F.collect_list(F.struct(F.col("label_no").alias("label"), "g", "p", "tp")).alias("labels")
    units = per_label.join(speakers, "speaker_id").groupBy("pos").agg(of_cluster)
    drawn = per_replicate(
        units, ["labels"], _label_sums, "label long, g double, p double, tp double", n, good[-1] + 1, seed
    )
    if good[-1] + 1 > replicates:
        kept = spark.createDataFrame([(i,) for i in good], "replicate int")
        drawn = drawn.join(kept, "replicate")
    summed = drawn.groupBy("replicate", F.col("label").alias("label_no")).agg(
        *[F.sum(c).alias(c) for c in ("g", "p", "tp")]
    )
    resampled = summed.join(named, "label_no")
    boot_scores = classify.average_folds(
        classify.label_scores(resampled, ["replicate", *keys, "fold"]), ["replicate", *keys]
    )
    point_cells = cells.groupBy(*keys, "fold", "gold", "prediction").agg(F.sum("w").alias("w"))
    point_scores = classify.average_folds(classify.fold_scores(point_cells, keys), keys)
    points = _long_metrics(point_scores, keys, [score, "macro_f1"])
    boot = (
        _long_metrics(boot_scores, ["replicate", *keys], [score, "macro_f1"])
        .groupBy("metric", "system", "ord", "replicate")
        .agg(F.avg("value").alias("value"))
    )
    return bootstrap_summary(points, boot, confidence=confidence)


def _long_metrics(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return df.select(
        *keys,
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
        ).alias("x"),
    ).select(*keys, "x.*")


def bootstrap_verification(
    entries: DataFrame,
    *,
    replicates: int,
    seed: int,
    unit: str = "speaker",
    p_target: float = verify.P_TARGET,
    confidence: float = 0.95,
) -> DataFrame:
    """EER and minimum cost, resampling speakers or trials.

    ``entries``: (system, ord, seed, trial_id, spk_a, spk_b, label, score).
    Draws without both kinds of trial are drawn again.  Unequal trials, changed
    speakers or labels, scores that are not finite and a single system raise.
    """
    refuse_unpaired(entries, "trial_id", fixed=["spk_a", "spk_b", "label"], value="score")
    keys = ["system", "ord", "seed"]
    runs = [tuple(r) for r in entries.select(*keys).distinct().orderBy("ord", "seed").collect()]
    # one trial list serves every system and seed
    wide = entries.groupBy("trial_id", "spk_a", "spk_b", "label").agg(
        F.array(*[F.max(F.when((F.col("system") == s) & (F.col("seed") == k), F.col("score").cast("double"))) for s, _, k in runs]).alias("scores")
    )
    wide = sized(wide)
    if unit == "speaker":
        names = wide.select(F.explode(F.array("spk_a", "spk_b")).alias("spk"))
        units, n = positioned(names.distinct(), "spk", seed)
        units = sized(units)
        trials = wide.join(units.select(F.col("spk").alias("spk_a"), F.col("pos").alias("a")), "spk_a").join(
            units.select(F.col("spk").alias("spk_b"), F.col("pos").alias("b")), "spk_b"
        )
    elif unit == "trial":
        units, n = positioned(wide, "trial_id", seed)
        trials = units.withColumn("a", F.col("pos")).withColumn("b", F.lit(None).cast("long"))
    else:
        raise ValueError("bootstrap unit must be speaker or trial")
    metrics = ["eer", "min_dcf"]
    drawn = trialboot.replicate_metrics(
        trials.select("trial_id", "a", "b", "label", "scores"), len(runs), n, replicates, seed, first_valid, p_target
    )
    run = F.array(*[F.struct(F.lit(s).alias("system"), F.lit(o).alias("ord"), F.lit(k).alias("seed")) for s, o, k in runs])
    boot = (
        _long_metrics(drawn.withColumn("run", run[F.col("cell")]).select("replicate", "run.*", *metrics), ["replicate", *keys], metrics)
        .groupBy("metric", "system", "ord", "replicate")
        .agg(F.avg("value").alias("value"))
    )
    points = _long_metrics(
        verify.verification_metrics(entries, group=keys, p_target=p_target), keys, metrics
    )
    return bootstrap_summary(points, boot, confidence=confidence)


# --------------------------------------------------------------------------
# dispatch by task kind


def task_kind(task: str) -> str:
    """``classification:emotion`` is a named instance of ``classification``."""
    kind = task.split(":", 1)[0]
    if kind not in TASKS:
        raise ValueError(f"unknown task: {task}; known: {', '.join(TASKS)}")
    return kind


KINDS: dict[str, Callable[..., DataFrame]] = {
    "reconstruction": bootstrap_mean,
    "asr": bootstrap_rate,
    "classification": bootstrap_cluster,
    "verification": bootstrap_verification,
}


def analyze(
    entries: dict[str, DataFrame], *, replicates: int, seed: int, confidence: float = 0.95, **options
) -> DataFrame:
    """Statistics of all tasks, ``{task: entries}``, as one table."""
    if replicates < 1:
        raise ValueError(f"at least one replicate is needed, not {replicates}")
    results = []
    for task in sorted(entries):
        run = KINDS[task_kind(task)]
        result = run(entries[task], replicates=replicates, seed=seed, confidence=confidence, **options.get(task, {}))
        results.append(result.withColumn("task", F.lit(task)))
    return reduce(lambda a, b: a.unionByName(b), results)
