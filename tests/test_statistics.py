"""Literal cases of the evaluation statistics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from utterset import violations as v
from utterset.functions.hashing import permuted_rank
from utterset.operators import asr, bootstrap, classify, embeddings, reports, trialboot, verify
from utterset.plans import resample


def rows(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def mean_entries(spark):
    data = []
    for order, system in enumerate(("a", "b")):
        for seed in (0, 1, 2):
            for unit, value in (("u1", 1.0), ("u2", 2.0), ("u3", 4.0)):
                data.append((system, order, str(seed), unit, "m", value + seed + order))
    return spark.createDataFrame(data, "system string, ord int, seed string, unit_id string, metric string, value double")


def test_constant_offset_collapses_the_paired_interval(spark):
    out = rows(bootstrap.bootstrap_mean(mean_entries(spark), replicates=50, seed=1), "kind", "system")
    a, diff = out[("system", "a")], out[("difference", "b")]
    assert a["estimate"] == pytest.approx(10 / 3)
    assert a["seed_sample_sd"] == pytest.approx(1.0)
    assert (diff["estimate"], diff["ci_low"], diff["ci_high"]) == pytest.approx((1.0, 1.0, 1.0))
    assert a["ci_low"] < a["estimate"] < a["ci_high"]


def test_corpus_rate_and_single_seed(spark):
    data = [(s, o, "none", u, ref, hyp) for o, s in enumerate(("a", "b")) for u, ref, hyp in (("1", "a b", "a b"), ("2", "c", "x"))]
    entries = spark.createDataFrame(data, "system string, ord int, seed string, unit_id string, reference string, hypothesis string")
    out = rows(bootstrap.bootstrap_rate(entries, replicates=20, seed=1), "metric", "kind", "system")
    assert out[("wer", "system", "a")]["estimate"] == pytest.approx(1 / 3)
    assert out[("wer", "system", "a")]["seed_sample_sd"] is None


def test_additive_counts(spark):
    pairs = [("a b", "a x"), ("c d e", "c e"), ("hello", "hallo extra"), ("", ""), ("", "x y"), ("aß 中", "中")]
    df = spark.createDataFrame(pairs, "reference string, hypothesis string")
    got = [(r["word_errors"], r["word_units"], r["char_errors"], r["char_units"]) for r in asr.asr_counts(df).collect()]
    want = {(1, 2, 1, 3), (1, 3, 2, 5), (2, 1, 7, 5), (0, 0, 0, 0), (2, 0, 3, 0), (1, 2, 3, 4)}
    assert set(got) == want
    missing = asr.asr_counts(spark.createDataFrame([(None, "x")], "reference string, hypothesis string")).first()
    assert missing["word_errors"] is None and missing["char_units"] is None
    rates = asr.asr_rates(asr.asr_counts(df.limit(3))).first()
    assert rates["wer"] == pytest.approx(4 / 6)
    empty = asr.asr_rates(asr.asr_counts(spark.createDataFrame([("", "x")], "reference string, hypothesis string"))).first()
    assert (empty["wer"], empty["cer"]) == (1.0, 1.0)


def test_word_errors_match_a_plain_edit_distance(spark):
    import random

    rng = random.Random(3)
    pairs = []
    for _ in range(40):
        pairs.append(tuple(" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(9))) for _ in range(2)))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    got = asr.asr_counts(spark.createDataFrame(pairs, "reference string, hypothesis string")).collect()
    for r in got:
        assert r["word_errors"] == distance(r["reference"].split(), r["hypothesis"].split())
        assert r["char_errors"] == distance(r["reference"], r["hypothesis"])


def class_entries(spark, data):
    return spark.createDataFrame(
        data, "system string, ord int, seed string, unit_id string, speaker_id string, fold int, gold string, prediction string"
    )


def test_folds_are_averaged_without_weights(spark):
    df = spark.createDataFrame(
        [(0, "x", "x"), (1, "x", "y"), (1, "x", "y"), (1, "x", "y")], "fold int, gold string, prediction string"
    )
    assert classify.classification_metrics(df).first()["accuracy"] == pytest.approx(0.5)


def test_balanced_accuracy_and_macro_f1(spark):
    df = spark.createDataFrame([(0, g, "x") for g in "xxxy"], "fold int, gold string, prediction string")
    out = classify.classification_metrics(df).first()
    assert out["balanced_accuracy"] == pytest.approx(0.5)
    assert out["macro_f1"] == pytest.approx(3 / 7)


def test_zero_weight_rows_do_not_count(spark):
    df = spark.createDataFrame([(0, "x", "x", 2.0), (0, "y", "x", 0.0)], "fold int, gold string, prediction string, w double")
    out = classify.classification_metrics(df, weight="w").first()
    assert (out["accuracy"], out["macro_f1"]) == (1.0, 1.0)


def test_probe_f1_counts_absent_classes_as_zero(spark):
    df = spark.createDataFrame([("x", "x"), ("x", "x")], "gold string, prediction string")
    classes = spark.createDataFrame([("x",), ("y",)], "label string")
    assert classify.probe_macro_f1(df, classes).first()["macro_f1"] == pytest.approx(0.5)


def test_perfect_predictor_has_a_point_interval(spark):
    data = []
    for order, system in enumerate(("a", "b")):
        for speaker in range(6):
            for item in range(2):
                gold = "xy"[item]
                data.append((system, order, "0", f"{speaker}-{item}", f"s{speaker}", speaker % 2, gold, gold))
    out = rows(bootstrap.bootstrap_cluster(class_entries(spark, data), replicates=30, seed=2), "metric", "kind", "system")
    f1 = out[("macro_f1", "system", "a")]
    assert (f1["ci_low"], f1["ci_high"]) == pytest.approx((1.0, 1.0))


def test_draws_that_empty_a_fold_are_replaced(spark):
    # two speakers, one per fold: half of all draws miss a fold
    data = [(s, o, "0", f"u{k}", f"s{k}", k, "x", "x") for o, s in enumerate(("a", "b")) for k in (0, 1)]
    entries = class_entries(spark, data)
    speakers, n = bootstrap.positioned(entries.select("speaker_id").distinct(), "speaker_id", 5)
    units = speakers.join(entries.select("speaker_id", "fold").distinct(), "speaker_id").select("pos", "fold")
    good = bootstrap.covering_attempts(units, n, 25, 5)
    assert len(good) == len(set(good)) == 25 and good[-1] > 24
    count = lambda m, held: {"k": (m > 0).sum(axis=1)}
    drawn = resample.per_replicate(units, ["fold"], count, "k long", n, good[-1] + 1, 5).collect()
    assert good == sorted(r["replicate"] for r in drawn if r["k"] == 2)[:25]
    out = rows(bootstrap.bootstrap_cluster(entries, replicates=25, seed=5), "metric", "kind", "system")
    assert out[("accuracy", "system", "a")]["ci_low"] == 1.0


def test_impossible_resamples_raise():
    tried = []
    with pytest.raises(ValueError):
        bootstrap.first_valid(7, lambda start, count: tried.append((start, count)) or [])
    assert tried[0] == (0, 7) and sum(count for _, count in tried) == 700
    assert bootstrap.first_valid(3, lambda start, count: [i for i in range(start, start + count) if i % 5 == 4]) == [4, 9, 14]


def test_tree_draws_are_multinomial_and_whole(spark):
    n, replicates = 3 * resample.BLOCK - 100, 400
    units = spark.range(n).select(F.col("id").alias("pos"))
    half = lambda m, held: {"all": m.sum(axis=1), "low": m[:, held["pos"] < 6000].sum(axis=1), "two": (m == 2).sum(axis=1)}
    out = resample.per_replicate(units, ["pos"], half, "all long, low long, two long", n, replicates, 3)
    got = out.groupBy("replicate").agg(*[F.sum(c).alias(c) for c in ("all", "low", "two")]).toPandas()
    assert len(got) == replicates and (got["all"] == n).all()
    p = 6000 / n
    assert got["low"].mean() == pytest.approx(n * p, abs=4 * (n * p * (1 - p) / replicates) ** 0.5)
    assert got["low"].var() == pytest.approx(n * p * (1 - p), rel=0.3)
    assert got["two"].mean() / n == pytest.approx(math.exp(-1) / 2, rel=0.02)
    again = resample.per_replicate(units.repartition(5), ["pos"], half, "all long, low long, two long", n, 30, 3, start=10)
    again = again.groupBy("replicate").agg(F.sum("low").alias("low"))
    known = dict(zip(got["replicate"], got["low"], strict=True))
    assert all(known[r["replicate"]] == r["low"] for r in again.collect())


def test_binomial_quantiles_are_exact():
    for m, p in ((1, 0.5), (7, 0.3), (40, 0.9), (3000, 0.01)):
        law = np.cumsum([math.exp(math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1) + k * math.log(p) + (m - k) * math.log(1 - p)) for k in range(m + 1)])
        u = np.linspace(0.0005, 0.9995, 501)
        want = np.minimum(np.searchsorted(law, u, side="right"), m)
        assert (resample.binomial_quantile(np.full(len(u), m), p, u) == want).all()
    assert (resample.binomial_quantile(np.array([0, 0]), 0.5, np.array([0.1, 0.9])) == 0).all()


def trials(spark, data, schema="score double, label int, w double"):
    return spark.createDataFrame(data, schema)


def test_weighted_error_rates(spark):
    df = trials(spark, [(0.9, 1, 2.0), (0.8, 1, 1.0), (0.2, 0, 3.0), (0.1, 0, 1.0)])
    out = verify.verification_metrics(df, weight="w").first()
    assert (out["eer"], out["min_dcf"]) == (0.0, 0.0)


def test_inverted_scores(spark):
    df = trials(spark, [(0.1, 1, 1.0), (0.2, 1, 1.0), (0.8, 0, 1.0), (0.9, 0, 1.0)])
    out = verify.verification_metrics(df).first()
    assert out["eer"] >= 0.5 and out["min_dcf"] == 1.0


def brute_eer(scores, labels, weights, p=0.01):
    order = sorted(set(scores), reverse=True)
    tt = sum(w for w, l in zip(weights, labels) if l)
    tn = sum(w for w, l in zip(weights, labels) if not l)
    best, cost = (2.0, None), 1.0
    for s in order:
        fnr = 1 - sum(w for x, w, l in zip(scores, weights, labels) if l and x >= s) / tt
        fpr = sum(w for x, w, l in zip(scores, weights, labels) if not l and x >= s) / tn
        if abs(fnr - fpr) < best[0]:
            best = (abs(fnr - fpr), (fnr + fpr) / 2)
        cost = min(cost, (p * fnr + (1 - p) * fpr) / p)
    return (0.5 if best[0] >= 1 else best[1]), cost


def test_ties_and_weights_match_brute_force(spark):
    import random

    rng = random.Random(9)
    data = [(round(rng.random(), 1), rng.randrange(2), float(rng.randrange(1, 4)), rng.randrange(3)) for _ in range(150)]
    df = trials(spark, data, "score double, label int, w double, g int")
    for r in verify.verification_metrics(df, group=["g"], weight="w", buckets=4).collect():
        mine = [d for d in data if d[3] == r["g"]]
        eer, cost = brute_eer([d[0] for d in mine], [d[1] for d in mine], [d[2] for d in mine])
        assert r["eer"] == pytest.approx(eer) and r["min_dcf"] == pytest.approx(cost)


def test_all_pairs_blocks_match_listed_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    data = [(i, i % 7, [float(x) for x in rng.standard_normal(5) + (i % 7)]) for i in range(90)]
    emb = spark.createDataFrame(data, "k int, spk int, x array<double>")
    unit = [np.array(d[2]) / (np.linalg.norm(d[2]) + 1e-8) for d in data]
    scores, labels = [], []
    for i in range(90):
        for j in range(i):
            scores.append(round(float(unit[i] @ unit[j]), 12))
            labels.append(int(data[i][1] == data[j][1]))
    eer, cost = brute_eer(scores, labels, [1.0] * len(scores))
    for block_rows, bins in ((16, 64), (1000, 65536)):
        out = verify.all_pairs_metrics(emb, key="k", speaker="spk", vector="x", block_rows=block_rows, bins=bins).first()
        assert out["eer"] == pytest.approx(eer) and out["min_dcf"] == pytest.approx(cost)
    summary = verify.all_pairs_summary(emb, speaker="spk", vector="x").first()
    assert summary["n_pairs"] == len(scores) and summary["n_target"] == sum(labels)
    assert summary["mean_target"] == pytest.approx(np.mean([s for s, l in zip(scores, labels) if l]))


def test_all_pairs_shuffle_no_row_more_than_once(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    data = [(i, i % 5, [float(x) for x in rng.standard_normal(4) + (i % 5)]) for i in range(1200)]
    blocks = verify._vector_blocks(spark.createDataFrame(data, "k int, spk int, x array<double>"), "spk", "x", 1200, 100).cache()
    assert blocks.agg(F.sum(F.size("codes"))).first()[0] == 1200 and blocks.agg(F.max(F.size("codes"))).first()[0] <= 100
    pairs = verify._block_pairs(blocks)
    n = blocks.count()
    assert pairs.count() == n * (n + 1) // 2 and pairs.where("same").count() == n
    assert "Exchange hash" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_all_pairs_meet_ties_and_missing_speakers(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    # few distinct vectors: many equal scores; keys repeat; rows without a speaker are one speaker
    data = [(i % 9, None if i % 4 == 0 else i % 4, [float(x) for x in rng.integers(1, 4, 3)]) for i in range(120)]
    emb = spark.createDataFrame(data, "k int, spk int, x array<double>")
    unit = [np.array(d[2]) / (np.linalg.norm(d[2]) + 1e-8) for d in data]
    pairs = [(round(float(unit[i] @ unit[j]), 12), int(data[i][1] == data[j][1])) for i in range(120) for j in range(i)]
    eer, cost = brute_eer([p[0] for p in pairs], [p[1] for p in pairs], [1.0] * len(pairs))
    for rows, bins in ((7, 8), (50, 1 << 16)):
        out = verify.all_pairs_metrics(emb, key="k", speaker="spk", vector="x", block_rows=rows, bins=bins).first()
        assert out["eer"] == pytest.approx(eer) and out["min_dcf"] == pytest.approx(cost)


def test_drawn_trials_are_distinct_pairs_of_the_right_kind(spark):
    data = [(i, "hot" if i % 3 == 0 else f"s{i % 17}") for i in range(200)]
    emb = spark.createDataFrame(data, "k int, spk string")
    drawn = verify.sample_trials(emb, key="k", speaker="spk", max_trials=400, seed=3).collect()
    speaker = dict(data)
    pairs = {frozenset((r["left"], r["right"])) for r in drawn}
    assert len(drawn) == len(pairs) == 400 and all(len(p) == 2 for p in pairs)
    assert sum(r["label"] for r in drawn) == 200
    for r in drawn:
        assert (speaker[r["left"]], speaker[r["right"]]) == (r["spk_a"], r["spk_b"])
        assert r["label"] == int(r["spk_a"] == r["spk_b"])
    everything = verify.sample_trials(emb, key="k", speaker="spk", max_trials=10**6, seed=3)
    assert everything.count() == 200 * 199 // 2


@pytest.mark.parametrize("space", [1, 2, 7, 64, 101, 1000])
def test_permuted_ranks_are_a_permutation(spark, space):
    got = [r[0] for r in spark.range(space).select(permuted_rank(F.col("id"), space, 5, "p")).collect()]
    assert sorted(got) == list(range(space))
    if space > 100:
        other = [r[0] for r in spark.range(space).select(permuted_rank(F.col("id"), space, 6, "p")).collect()]
        assert sum(a == b for a, b in zip(got, other)) < space / 10 and abs(np.corrcoef(got, range(space))[0, 1]) < 0.25
    with pytest.raises(ValueError, match="distinct ranks"):
        verify._draw_ranks(spark, space, space + 1, 5, "p")


def test_class_quotas():
    assert verify.class_quotas(1000, 1000, 100) == (50, 50)
    assert verify.class_quotas(10, 1000, 100) == (10, 90)
    assert verify.class_quotas(1000, 10, 100) == (90, 10)
    assert verify.class_quotas(5, 5, 100) == (5, 5)


def test_verification_bootstrap_by_speaker_and_trial(spark):
    data = []
    for order, system in enumerate(("a", "b")):
        n = 0
        for i in range(6):
            for j in range(i, 6):
                for copy in range(2):
                    label = int(i == j)
                    data.append((system, order, "none", f"t{n}", f"s{i}", f"s{j}", label, label + 0.01 * copy))
                    n += 1
    entries = spark.createDataFrame(
        data, "system string, ord int, seed string, trial_id string, spk_a string, spk_b string, label int, score double"
    )
    for unit in ("speaker", "trial"):
        out = rows(bootstrap.bootstrap_verification(entries, replicates=20, seed=1, unit=unit), "metric", "kind", "system")
        assert out[("eer", "system", "a")]["ci_high"] == 0.0
        assert out[("min_dcf", "difference", "b")]["ci_high"] == 0.0
    assert verify.trial_violations(entries.where("system = 'a'")).count() == 0
    broken = entries.where("system = 'a'").withColumn("label", F.lit(1))
    assert {r["rule"] for r in verify.trial_violations(broken).collect()} == {"target_within_speaker"}


@pytest.mark.parametrize("unit", ["speaker", "trial"])
def test_ranges_give_what_all_weights_give(spark, monkeypatch, unit):
    """Replicates finished from score ranges equal those of all trials with their weights; ties and one-sided ranges included."""
    rng = np.random.default_rng(4)
    data, n = [], 0
    for i in range(30):
        for j in range(i, 30):
            for _ in range(3 if i == j else 1):
                tied = round(float(rng.normal() + (i == j)), 1)
                for order, system in enumerate(("a", "b")):
                    score = tied if order == 0 else float(rng.normal() + 2 * (i == j))
                    data.append((system, order, "none", f"t{n}", f"s{i}", f"s{j}", int(i == j), score))
                n += 1
    schema = "system string, ord int, seed string, trial_id string, spk_a string, spk_b string, label int, score double"
    entries = spark.createDataFrame(data, schema)
    for name, value in (("SPEAKERS", 8), ("ITEM", 50), ("PER_RANGE", 9), ("CELLS", 2000)):
        monkeypatch.setattr(trialboot, name, value)
    out = rows(bootstrap.bootstrap_verification(entries, replicates=40, seed=6, unit=unit), "metric", "kind", "system")
    wide = {(t, k): x for s, _, _, t, a, b, lab, x in data for k in [s]}
    trials = sorted({(t, a, b, lab) for _, _, _, t, a, b, lab, _ in data})
    names = sorted({x for t in trials for x in ((t[1], t[2]) if unit == "speaker" else (t[0],))})
    units, size = bootstrap.positioned(spark.createDataFrame([(x,) for x in names], "u string"), "u", 6)
    give = lambda m, held: {"replicate": np.repeat(np.arange(len(m)), m.shape[1]), "p": np.tile(held["pos"], len(m)), "m": m.reshape(-1)}
    mult = {(r["replicate"], r["p"]): r["m"] for r in resample.per_replicate(units, ["pos"], give, "p long, m long", size, 40, 6).collect()}
    place = {r["u"]: r["pos"] for r in units.collect()}
    for system in "ab":
        eers, costs = [], []
        for r in range(40):
            w = [mult[r, place[t]] if unit == "trial" else mult[r, place[a]] * (1 if lab else mult[r, place[b]]) for t, a, b, lab in trials]
            score = np.array([wide[t, system] for t, *_ in trials])
            label, w = np.array([t[3] for t in trials]), np.array(w, dtype=float)
            gaps, fit = [(1.0, 0, 1.0, 0.0)], 1.0
            for k, x in enumerate(sorted(set(score), reverse=True), 1):
                fnr = 1 - w[(label == 1) & (score >= x)].sum() / w[label == 1].sum()
                fpr = w[(label == 0) & (score >= x)].sum() / w[label == 0].sum()
                gaps.append((abs(fnr - fpr), k, fnr, fpr))
                fit = min(fit, (0.01 * fnr + 0.99 * fpr) / 0.01)
            eers.append(sum(min(gaps)[2:]) / 2)
            costs.append(fit)
        for metric, values in (("eer", eers), ("min_dcf", costs)):
            got = out[(metric, "system", system)]
            assert (got["ci_low"], got["ci_high"]) == pytest.approx(tuple(np.percentile(values, [2.5, 97.5])), abs=1e-9)


def test_alignment_rules(spark):
    data = [("a", "0", "u1", "s1"), ("a", "0", "u2", "s1"), ("b", "0", "u1", "s2"), ("b", "0", "u2", "s1"), ("b", "0", "u2", "s1")]
    entries = spark.createDataFrame(data, "system string, seed string, unit_id string, speaker_id string")
    found = {(r["rule"], r["key"]) for r in bootstrap.check_alignment(entries).collect()}
    assert found == {("duplicate_unit", "u2")}
    changed = bootstrap.check_invariants(entries, ["speaker_id"]).collect()
    assert [r["key"] for r in changed] == ["u1"]
    gap = bootstrap.check_alignment(entries.where("not (system = 'b' and unit_id = 'u1')").dropDuplicates()).collect()
    assert {(r["rule"], r["key"], r["detail"]) for r in gap} == {("missing_unit", "u1", "b/0")}
    uneven = spark.createDataFrame([("a", "0", "u"), ("a", "1", "u"), ("b", "0", "u")], "system string, seed string, unit_id string")
    assert "equal_seed_sets" in {r["rule"] for r in bootstrap.check_alignment(uneven).collect()}
    alone = uneven.where("system = 'a'")
    assert "two_systems" in {r["rule"] for r in bootstrap.check_alignment(alone).collect()}
    with pytest.raises(v.ContractError):
        v.assert_empty(bootstrap.check_invariants(entries, ["speaker_id"]))


def test_bootstraps_refuse_unpaired_entries(spark):
    schema = "system string, ord int, seed string, unit_id string, metric string, value double"
    good = [(s, o, "0", u, "m", 1.0 + o) for o, s in enumerate("ab") for u in ("u1", "u2")]
    faults = {
        "missing_unit": good[:-1], "duplicate_unit": [*good, good[0]], "two_systems": good[:2],
        "finite_value": [*good[:-1], ("b", 1, "0", "u2", "m", float("nan"))],
        "missing_metric": [*good, *[(s, o, "0", "u1", "other", 1.0) for o, s in enumerate("ab")]],
    }
    for rule, data in faults.items():
        with pytest.raises(v.ContractError, match=rule):
            bootstrap.bootstrap_mean(spark.createDataFrame(data, schema), replicates=2, seed=1)
    said = [(s, o, "0", "u1", "x y" if s == "a" else "x z", "x y") for o, s in enumerate("ab")]
    with pytest.raises(v.ContractError, match="invariant"):
        bootstrap.bootstrap_rate(
            spark.createDataFrame(said, "system string, ord int, seed string, unit_id string, reference string, hypothesis string"),
            replicates=2, seed=1,
        )


def test_finite_check(spark):
    df = spark.createDataFrame([("u", 1.0), ("v", float("nan")), ("w", float("inf")), ("x", None)], "unit_id string, value double")
    assert {r["key"] for r in bootstrap.check_finite(df).collect()} == {"v", "w", "x"}


def test_task_dispatch(spark):
    assert bootstrap.task_kind("classification:emotion") == "classification"
    with pytest.raises(ValueError):
        bootstrap.task_kind("ranking")
    out = bootstrap.analyze({"reconstruction:all": mean_entries(spark)}, replicates=5, seed=1)
    assert {r["task"] for r in out.collect()} == {"reconstruction:all"}


def test_isotropic_and_collapsed_populations(spark):
    axes = spark.createDataFrame([([1.0, 0.0],), ([-1.0, 0.0],), ([0.0, 1.0],), ([0.0, -1.0],)], "x array<double>")
    out = embeddings.covariance_stats(axes, "x").first()
    assert out["effective_rank"] == pytest.approx(2.0)
    assert out["cov_offdiag_rms"] == pytest.approx(0.0) and out["collapsed_dim_frac"] == 0.0
    assert embeddings.covariance_spectrum(axes, "x").first()["isotropy_ratio"] == pytest.approx(1.0)
    flat = spark.createDataFrame([([0.0, 1.0],), ([0.0, -1.0],), ([0.0, 0.5],)], "x array<double>")
    assert embeddings.covariance_stats(flat, "x").first()["collapsed_dim_frac"] == 0.5
    assert embeddings.covariance_spectrum(flat, "x").first()["isotropy_ratio"] == 0.0
    assert embeddings.embedding_stats(flat, "x").first()["embed_effective_rank"] == pytest.approx(1.0)


def test_status_folding(spark):
    data = [("s", "skipped"), ("s", "skipped"), ("d", "completed"), ("d", "skipped"), ("f", "completed"), ("f", "failed"), ("t", "timed_out")]
    expected = spark.createDataFrame([(c,) for c in "sdftm"], "condition string")
    got = {r["condition"]: r["status"] for r in reports.derive_status(spark.createDataFrame(data, "condition string, status string"), expected).collect()}
    assert got == {"s": "skipped", "d": "completed", "f": "completed_with_errors", "t": "completed_with_errors", "m": "missing"}


def test_fingerprint_ignores_order_but_not_content(spark):
    a = spark.range(100).select("id", (F.col("id") % 3).alias("g"))
    same = a.orderBy(F.col("id").desc()).repartition(7)
    other = a.withColumn("g", F.when(F.col("id") == 5, 0).otherwise(F.col("g")))
    prints = [reports.fingerprint(x, ["id", "g"]).first()["fingerprint"] for x in (a, same, other)]
    assert prints[0] == prints[1] != prints[2]


def test_seed_summary_uses_the_sample_deviation(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "system string, value double")
    out = {r["system"]: r for r in classify.seed_summary(df, ["system"]).collect()}
    assert out["a"]["seed_sample_sd"] == pytest.approx(math.sqrt(2)) and out["b"]["seed_sample_sd"] is None


def listed_draws(one, two, counts, block, size):
    """The rule of the draws, one at a time."""
    a, b = (resample.key_word(one, two, block, use) for use in (resample.DRAW_ONE, resample.DRAW_TWO))
    out = np.zeros((len(counts), size), dtype=np.int64)
    for r, m in enumerate(counts):
        words = resample.mix32(resample.mix32(np.arange(m, dtype=np.uint32) * np.uint32(resample.STEP) + a[r]) ^ b[r])
        for w in words:
            out[r, (int(w) * size) >> 32] += 1
    return out


@pytest.mark.parametrize("size", [1, 2, 37, 4096])
def test_draws_in_groups_are_the_draws_one_by_one(size, monkeypatch):
    rng = np.random.default_rng(size)
    one, two = (rng.integers(0, 1 << 30, 9).astype(np.uint32) for _ in "ab")
    counts = np.array([0, 1, 5, 300, 2, 0, 77, 500, 3], dtype=np.int32)
    monkeypatch.setattr(resample, "WORDS", 1100)  # two replicates at a time
    got = resample.multiplicities(one, two, counts, 3, size)
    assert got.dtype == np.int64 and (got == listed_draws(one, two, counts, 3, size)).all()


def test_laws_kept_and_laws_in_rows_agree(monkeypatch):
    rng = np.random.default_rng(8)
    for n, p in ((3, 0.5), (900, 1 / 3), (8192, 0.5)):
        m, u = rng.binomial(n, 0.9, 60), rng.random(60)
        m[0] = 0
        kept = resample.binomial_quantile(m, p, u)
        with monkeypatch.context() as patch:
            patch.setattr(resample, "KNOWN_SIZE", -1)
            assert (resample.binomial_quantile(m, p, u) == kept).all()


def test_a_task_takes_several_blocks_and_trees_are_dealt_evenly(spark):
    n = 100 * resample.BLOCK
    units = spark.range(n).select(F.col("id").alias("pos"))
    give = lambda m, held: {"all": m.sum(axis=1)}
    made = resample.per_replicate(units, ["pos"], give, "all long", n, 2, 3)
    parts = made.rdd.getNumPartitions()
    assert parts <= 8 * spark.sparkContext.defaultParallelism < 100
    assert made.agg(F.sum("all")).first()[0] == 2 * n
