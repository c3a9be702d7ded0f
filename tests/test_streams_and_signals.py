"""Streams equal their batch form; numeric operators equal NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from utterset import violations as v
from utterset.operators import embeddings, probes, runlogs, signals
from utterset.streaming import features, logs


def log_table(spark):
    return spark.range(600).select(
        F.concat(F.lit("r"), (F.col("id") % 2).cast("string")).alias("run"), F.floor(F.col("id") / 6).alias("step"),
        F.col("id").alias("seq"), F.concat(F.lit("k"), (F.col("id") % 3).cast("string")).alias("key"),
        (F.col("id") * 37 % 101).cast("double").alias("value"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 30).alias("ts"),
    )


@pytest.fixture
def written(spark, tmp_path):
    for part in range(3):
        log_table(spark).where(F.col("seq") % 3 == part).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    return tmp_path


def pairs(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_stream_merge_equals_batch_and_survives_a_repeat(spark, written):
    for _ in range(2):
        query = logs.start_merge(logs.read_log_stream(spark, f"{written}/in", files_per_batch=1), f"{written}/out", f"{written}/cp")
        query.awaitTermination()
    batch = runlogs.merge_rows(log_table(spark)).select("run", "step", "key", "value")
    assert pairs(logs.read_merged(spark, f"{written}/out"), "run", "step", "key", "value") == pairs(batch, "run", "step", "key", "value")
    logs.compact(spark, f"{written}/out", f"{written}/small")
    assert logs.read_merged(spark, f"{written}/small").count() == batch.count()


def run_to_memory(df, name, mode, tmp):
    query = (
        df.writeStream.outputMode(mode).format("memory").queryName(name)
        .option("checkpointLocation", f"{tmp}/cp-{name}").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return df.sparkSession.table(name)


def test_interval_stream_equals_batch(spark, written):
    stream = logs.read_log_stream(spark, f"{written}/in", files_per_batch=1)
    out = run_to_memory(logs.interval_stream(stream, 10), "intervals", "complete", written)
    batch = logs.interval_stream(log_table(spark), 10)
    assert pairs(out, "interval", "run", "key", "mean", "count") == pairs(batch, "interval", "run", "key", "mean", "count")


def test_counters_survive_batches(spark, written):
    stream = logs.read_log_stream(spark, f"{written}/in", files_per_batch=1)
    out = run_to_memory(logs.cumulative_counters(stream), "counters", "update", written)
    final = out.groupBy("run", "key").agg(F.max("total").alias("n"), F.sum("added").alias("s"))
    want = log_table(spark).groupBy("run", "key").agg(F.count("*").alias("n"))
    assert pairs(final, "run", "key", "n") == pairs(want, "run", "key", "n")
    assert final.where("n <> s").count() == 0


def test_event_time_windows(spark, written):
    stream = logs.read_log_stream(spark, f"{written}/in", files_per_batch=3)
    out = run_to_memory(logs.window_means(stream, window="10 minutes", lateness="1 minute"), "windows", "append", written)
    batch = logs.window_means(log_table(spark), window="10 minutes")
    done, every = pairs(out, "window_start", "key", "mean", "count"), pairs(batch, "window_start", "key", "mean", "count")
    assert done and set(done) <= set(every)


def test_feature_reuse_and_current_labels(spark, tmp_path):
    calls = []

    def extract(df):
        calls.append(df.count())
        return df.withColumn("features", F.array(F.length("audio").cast("double")))

    def items(rows):
        return spark.createDataFrame(rows, "item string, audio string, speaker string").withColumn(
            "content_hash", features.content_hash("audio")).withColumn("extractor", F.lit("len"))

    path = f"{tmp_path}/features"
    assert features.update_features(spark, items([("a", "xx", "s1"), ("b", "y", "s1")]), path, extract) == 2
    relabelled = items([("a", "xx", "s9"), ("b", "changed", "s1")])
    assert features.update_features(spark, relabelled, path, extract) == 1
    assert features.update_features(spark, relabelled, path, extract) == 0
    assert calls == [2, 1, 0]
    got = {r["item"]: (r["speaker"], r["features"][0]) for r in features.with_features(relabelled, spark, path).collect()}
    assert got == {"a": ("s9", 2.0), "b": ("s1", 7.0)}


def test_contract_is_checked_on_resume(spark, tmp_path):
    rows = spark.range(5)
    path = f"{tmp_path}/contract"
    mine = features.contract_of(rows, {"rate": "16000"})
    assert features.start_or_resume(spark, mine, path) is False
    assert features.start_or_resume(spark, features.contract_of(rows.orderBy(F.desc("id")), {"rate": "16000"}), path) is True
    with pytest.raises(v.ContractError):
        features.start_or_resume(spark, features.contract_of(rows, {"rate": "8000"}), path)


def test_stream_features(spark, tmp_path):
    spark.createDataFrame([("a", "x"), ("b", "yy")], "item string, audio string").write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema("item string, audio string").json(f"{tmp_path}/in").withColumn(
        "content_hash", features.content_hash("audio")).withColumn("extractor", F.lit("len"))
    features.stream_features(
        stream, f"{tmp_path}/out", f"{tmp_path}/cp", lambda df: df.withColumn("features", F.array(F.length("audio").cast("double")))
    ).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


# -- signals ----------------------------------------------------------------


def waves(spark, n=6, length=3000, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, length))
    y = 0.8 * x + 0.1 * rng.standard_normal((n, length))
    rows = [(i, [float(a) for a in x[i]], [float(a) for a in y[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "k int, x array<double>, y array<double>"), x, y


def test_si_sdr_equals_the_definition(spark):
    df, x, y = waves(spark)
    for r in signals.si_sdr(df, reference="x", estimate="y").collect():
        a, b = x[r["k"]] - x[r["k"]].mean(), y[r["k"]] - y[r["k"]].mean()
        p = a * (b @ a) / (a @ a)
        assert r["si_sdr_db"] == pytest.approx(10 * np.log10((p @ p) / ((b - p) @ (b - p))))
        assert r["wav_l1"] == pytest.approx(np.abs(x[r["k"]] - y[r["k"]]).mean())


def test_spectral_distance(spark):
    df, x, y = waves(spark, n=2)
    out = signals.mrstft(df, reference="x", estimate="x").first()
    assert out["stft_loss"] == 0.0
    r = signals.mrstft(df.where("k = 0"), reference="x", estimate="y").first()
    # one resolution written out frame by frame
    n_fft, total = 256, []
    for n_fft in signals.FFT_SIZES:
        win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
        mags = []
        for s in (x[0], y[0]):
            p = np.pad(s, n_fft // 2, mode="reflect")
            mags.append(np.array([np.abs(np.fft.rfft(p[i : i + n_fft] * win)) for i in range(0, len(p) - n_fft + 1, n_fft // 4)]))
        total.append(np.linalg.norm(mags[1] - mags[0]) / (np.linalg.norm(mags[0]) + 1e-3))
    assert r["stft_sc"] == pytest.approx(np.mean(total))
    short = spark.createDataFrame([([1.0, -1.0], [1.0, 0.0])], "x array<double>, y array<double>")
    assert signals.mrstft(short, reference="x", estimate="y").first()["stft_mag"] > 0


def test_pair_metrics_keep_failures(spark):
    df, _, _ = waves(spark, n=3)
    silent = df.withColumn("x", F.when(F.col("k") == 1, F.transform("x", lambda a: a * 0)).otherwise(F.col("x")))
    rows = signals.evaluate_pairs(silent, item="k", reference="x", estimate="y", metrics={"boom": lambda a, b: 1 / int(a @ a > 0)})
    from utterset.operators import reports

    report = {r["metric"]: r for r in reports.metric_coverage(rows, expected=3).collect()}
    assert (report["si_sdr_db"]["failed"], report["boom"]["failed"]) == (1, 1)
    assert report["wav_l1"]["strict_complete"] and not report["boom"]["strict_complete"]
    shown = {(r["metric"], r["rank"]): r["error"] for r in reports.failure_examples(rows).collect()}
    assert "ZeroDivisionError" in shown[("boom", 1)] and "no energy" in shown[("si_sdr_db", 1)]


def test_augmented_views_are_repeatable(spark):
    df, _, _ = waves(spark, n=3, length=400)
    cfg = {k: signals.Effect(1.0, e.low, e.high) for k, e in signals.EFFECTS.items()}

    def run(parts):
        out = signals.augment_views(df.repartition(parts), cfg, key="k", samples="x", sample_rate=16000, global_views=2, local_views=1, seed=5)
        return {(r["k"], r["view"]): r for r in out.collect()}

    one, two = run(1), run(3)
    assert len(one) == 9 and all(np.allclose(one[k]["x"], two[k]["x"]) for k in one)
    assert all(cfg["gain"].low <= r["gain"] <= cfg["gain"].high and r["clip"] < 0.99 for r in one.values())
    off = {k: signals.Effect(0.0, e.low, e.high) for k, e in signals.EFFECTS.items()}
    none = signals.augment_views(df, off, key="k", samples="x", sample_rate=16000, global_views=1, local_views=0, seed=5)
    assert np.allclose(none.where("k = 0").first()["x"], df.where("k = 0").first()["x"])


def test_span_masks_cover_the_ratio(spark):
    df = spark.range(50).withColumn("frames", F.when(F.col("id") == 0, 0).otherwise(40))
    out = signals.span_masks(df, key="id", frames="frames", ratio=0.5, min_span=3, max_span=6, seed=1).cache()
    for r in out.collect():
        assert len(r["mask"]) == r["frames"] and (r["frames"] == 0 or 20 <= sum(r["mask"]) <= 26)
    share = signals.mask_coverage(out).first()
    assert 0.5 <= share["masked_share"] < 0.65 and share["spans"] > 50
    wav = spark.createDataFrame([([1.0, 1.0, 1.0, 1.0, 1.0], [1, 0])], "x array<double>, m array<tinyint>")
    assert wav.select(signals.mask_samples(F.col("x"), F.col("m"), 2)).first()[0] == [0.0, 0.0, 1.0, 1.0, 1.0]


def test_windows_and_frames(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [5.0])], "k int, x array<double>")
    chunks = signals.chunk(df, item="k", samples="x", n=2)
    whole = {r["k"]: r["x"] for r in signals.reassemble(chunks, item="k", samples="x").collect()}
    assert whole == {1: [1.0, 2.0, 3.0, 0.0], 2: [5.0, 0.0]}
    crop = signals.random_crop(spark.range(200).select("id", F.array(*[F.lit(float(i)) for i in range(5)]).alias("x")), key="id", samples="x", n=3, seed=1)
    assert {r["x"][0] for r in crop.collect()} == {0.0, 1.0, 2.0}
    flat = signals.flatten_frames(spark.createDataFrame([(1, [[1.0], [2.0], [3.0]])], "k int, f array<array<double>>"), item="k", frames="f", max_frames=2)
    assert signals.unflatten_frames(flat, item="k").first()["frames"] == [[1.0], [2.0]]
    assert signals.frame_violations(flat, item="k", max_frames=2).count() == 0
    broken = flat.where("pos = 1").unionByName(flat.where("pos = 1"))
    assert {r["rule"] for r in signals.frame_violations(broken, item="k", max_frames=1).collect()} == {"gap", "double", "too_long"}


# -- embeddings -------------------------------------------------------------


def cloud(spark, n=400, d=6, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)) @ rng.standard_normal((d, d))
    return spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "k int, x array<double>").repartition(5), x


def test_covariance_equals_numpy(spark):
    df, x = cloud(spark)
    c = np.cov(x.T)
    eig = np.linalg.eigvalsh(c)
    stats, spectrum = embeddings.covariance_stats(df, "x").first(), embeddings.covariance_spectrum(df, "x").first()
    assert stats["effective_rank"] == pytest.approx(eig.sum() ** 2 / (eig**2).sum()) == pytest.approx(spectrum["effective_rank"])
    assert spectrum["top_eigenvalue_fraction"] == pytest.approx(eig[-1] / eig.sum())
    assert stats["dim_std_p05"] == pytest.approx(np.quantile(np.sqrt(np.diag(c)), 0.05))


def test_gaussian_shape_equals_sorting(spark):
    from statistics import NormalDist

    df, x = cloud(spark)
    out = {r["slice"]: r["shape"] for r in embeddings.gaussian_shape(df, "x", slices=3, seed=9).collect()}
    w = np.zeros((6, 3))
    for r in embeddings.projections(spark, 6, 3, 9).collect():
        w[r["dim"], r["slice"]] = r["a"]
    assert np.allclose((w**2).sum(axis=0), 1.0)
    z = (x - x.mean(0)) / (x.std(0) + 1e-6)
    target = np.array([NormalDist().inv_cdf(i / 401) for i in range(1, 401)])
    for s in range(3):
        assert out[s] == pytest.approx(((np.sort(z @ w[:, s]) - target) ** 2).mean())


def test_pooling_with_valid_frames(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 6.0], [100.0, 100.0]], 2)], "f array<array<double>>, n int")
    assert df.select(embeddings.pool_array(F.col("f"), "meanstd", F.col("n"))).first()[0] == [2.0, 4.0, 1.0, 2.0]
    with pytest.raises(ValueError):
        embeddings.pool_array(F.col("f"), "max")
    long = spark.createDataFrame([("a", 0, 1.0), ("a", 0, 3.0)], "utt string, dim int, value double")
    assert tuple(embeddings.pool_long(long, utt="utt", dim="dim", value="value", mode="meanstd").first()) == ("a", 0, 2.0, 1.0)
    norm = embeddings.normalize_item(long, item="utt", bin_col="dim", value="value")
    assert sorted(r["value"] for r in norm.collect()) == pytest.approx([-0.70710, 0.70710], abs=1e-4)


def test_pca_signs_and_shares(spark):
    df, x = cloud(spark)
    out = embeddings.pca_2d(df, "x", ["k"]).orderBy("k").toPandas()
    vals, vecs = np.linalg.eigh(np.cov(x.T))
    top = vecs[:, ::-1][:, :2]
    top = top * np.sign(top[np.abs(top).argmax(axis=0), [0, 1]])
    assert np.allclose(out[["pc1", "pc2"]].to_numpy(), x @ top, atol=1e-6)
    assert out["explained1"][0] == pytest.approx(vals[-1] / vals.sum())


def test_probes_separate_what_is_separable(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "abc"[i % 3], [float(a) for a in rng.standard_normal(4) + 4 * (i % 3)], i // 3 % 4) for i in range(240)]
    df = spark.createDataFrame(rows, "k int, label string, x array<double>, fold int")
    for balanced in (False, True):
        out = probes.linear_probe(df, vector="x", label="label", balanced=balanced, max_iter=50)
        assert out.count() == 240 and out.where("label = prediction").count() > 225
    mlp = probes.mlp_probe(df.where("fold < 3"), df.where("fold = 3"), vector="x", label="label", hidden=8, max_iter=50)
    assert mlp.where("label = prediction").count() > 52


def test_equal_items_are_stored_once(spark, tmp_path):
    from pyspark.sql import functions as F

    from utterset.streaming import features

    schema = ", ".join(f"{key} string" for key in features.KEYS)
    items = spark.createDataFrame([("x",) * len(features.KEYS)] * 2, schema)
    path = f"{tmp_path}/store"
    extract = lambda rows: rows.withColumn("features", F.array(F.lit(1.0)))
    assert features.update_features(spark, items, path, extract) == 1
    assert features.update_features(spark, items, path, extract) == 0
    assert spark.read.parquet(path).count() == 1


def test_every_broken_rule_is_named(spark):
    import pytest

    from utterset import violations as v

    rows = spark.createDataFrame([(f"rule{i}", f"k{i}", "d") for i in range(150)], "rule string, key string, detail string")
    with pytest.raises(v.ContractError) as error:
        v.assert_empty(rows)
    assert all(f"rule{i}: k{i}" in str(error.value) for i in range(150))
