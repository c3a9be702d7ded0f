"""Sources, sinks, cleaning, joins, splits and their planted errors."""

import math
import random

import pytest
from pyspark.sql import functions as F

from utterset import violations as v
from utterset.functions import paths, vectors
from utterset.functions.hashing import order_key
from utterset.operators import asr, clean, joins, sampling, shards
from utterset.plans.ordering import hash_cut, running_totals, with_position
from utterset.queries.corpus import document_manifest
from utterset.sinks import writers
from utterset.sources import manifest as manifests
from utterset.sources import registry, results, tabular


@pytest.fixture
def files(tmp_path):
    def put(name, text):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
        return str(path)

    put.root = str(tmp_path)
    return put


# -- sources ----------------------------------------------------------------


def test_manifest_keeps_unknown_keys_and_roots(spark, files):
    a = files("one/manifests/a.jsonl", '{"audio_filepath": "audio/x.flac", "text": "ক", "note": {"k": 1}}\n\n')
    b = files("two/b.jsonl", '{"audio_filepath": "/abs/y.flac", "duration": 1.5}\n')
    rows = {r["audio_filepath"]: r for r in manifests.read_manifest(spark, [a, b]).withColumn(
        "k", F.try_variant_get("extra", "$.note.k", "int")).collect()}
    assert rows["audio/x.flac"]["k"] == 1 and rows["audio/x.flac"]["text"] == "ক"
    assert rows["audio/x.flac"]["root"].endswith("/one/manifests") and rows["/abs/y.flac"]["duration"] == 1.5
    inventory = spark.createDataFrame([(f"{files.root}/one/audio/x.flac",)], "path string")
    one = manifests.read_manifest(spark, a)
    resolved = clean.resolve_paths(one, inventory, root=f"{files.root}/one/manifests").first()
    assert resolved["resolved"] == f"{files.root}/one/audio/x.flac"
    gone = spark.createDataFrame([("audio/none.flac",)], "audio_filepath string")
    assert clean.resolve_paths(gone, inventory, root=f"{files.root}/one").first()["resolved"] is None


def test_strict_inventory_names_every_fault(spark, files):
    path = files(
        "m.jsonl",
        '{"audio_filepath": "a", "dataset": "d", "id": "1"}\n{"audio_filepath": "b", "dataset": "d", "id": "1"}\n'
        '{"audio_filepath": "c", "dataset": "d"}\n{broken\n[1]\n{"id": "2"}\n{"audio_filepath": "e", "duration": NaN}\n'
        '{"audio_filepath": "f", "text": "says NaN", "dataset": null, "id": "7"}\n',
    )
    rows, found = manifests.read_inventory(spark, path)
    counts = {r["rule"]: r["count"] for r in found.groupBy("rule").count().collect()}
    assert counts == {"invalid_json": 1, "not_an_object": 1, "missing_path": 1, "non_finite_number": 1, "duplicate_sample": 1}
    ids = [r["sample_id"] for r in rows.collect()]
    assert "d:1" in ids and "unknown:7" in ids and any(i.startswith("d:sha256:") for i in ids)
    with pytest.raises(v.ContractError):
        v.assert_empty(found)


def test_layouts_through_the_registry(spark, files):
    files("slr/utt_spk_text.tsv", "ab1\ts1\thello\nab2\ts2\tno clip\nshort\tline\nab3\ts3\tx\textra\n")
    files("slr/data/ab/ab1.flac", "x")
    files("slr/data/ab/ab3.flac", "x")
    slr = registry.source("openslr53")(spark, f"{files.root}/slr")
    got = {r["id"]: r for r in slr.collect()}
    assert set(got) == {"ab1", "ab3"} and got["ab3"]["text"] == "x" and got["ab1"]["language"] == "bn"

    files("cv/clips/a.mp3", "x")
    files("cv/clips/b.mp3", "x")
    files("cv/validated.tsv", "client_id\tpath\tsentence\tage\ns1\ta.mp3\tfirst\tteens\n")
    files("cv/invalidated.tsv", "client_id\tpath\tsentence\ns2\ta.mp3\tsecond\n")
    files("cv/other.tsv", "client_id\tpath\ns3\tzzz.mp3\n")
    cv = {r["id"]: r for r in registry.source("common_voice_bn")(spark, f"{files.root}/cv").collect()}
    assert (cv["a"]["text"], cv["a"]["speaker_id"]) == ("first", "s1") and cv["b"]["text"] is None

    files("reg/train.csv", "file_name,transcript\nu1,one\nu2.wav,two\nu3,three\n")
    files("reg/train/u1.mp3", "x")
    files("reg/train/u1.flac", "x")
    files("reg/train/u2.wav", "x")
    reg = {r["id"]: r["audio_filepath"] for r in registry.source("regspeech12")(spark, f"{files.root}/reg").collect()}
    assert {k: p.rsplit("/", 1)[1] for k, p in reg.items()} == {"u1": "u1.mp3", "u2.wav": "u2.wav"}

    files("iv/extracted/k1.wav", "x")
    files("iv/extracted/notes.txt", "x")
    files("iv/metadata.jsonl", '{"id": "k1", "text": "t", "duration": 2.0, "speaker_id": "s"}\n')
    iv = registry.source("indicvoices")(spark, f"{files.root}/iv").collect()
    assert [(r["id"], r["duration"]) for r in iv] == [("k1", 2.0)]
    with pytest.raises(ValueError, match="known"):
        registry.source("nothing")
    with pytest.raises(ValueError):
        tabular.read_labeled_csv(spark, f"{files.root}/reg/train.csv", ["id"])


def test_inline_parquet_reads_overlapping_globs_once(spark, files):
    df = spark.createDataFrame(
        [(bytearray(b"1"), "x/a.WAV", "s1"), (bytearray(b"2"), None, "s2"), (None, None, "s3"), (None, "c.ogg", "s4")],
        "bytes binary, path string, client_id string",
    ).select(F.struct("bytes", "path").alias("audio"), "client_id", F.lit("t").alias("transcription"))
    df.write.parquet(f"{files.root}/p/deep")
    got = tabular.read_parquet_audio(spark, f"{files.root}/p", ["*.parquet", "part-*"], dataset="d", language="bn").collect()
    by = {r["speaker_id"]: r for r in got}
    assert set(by) == {"s1", "s2", "s4"} and by["s1"]["audio_filepath"] == "a.wav"
    assert by["s2"]["audio_filepath"].endswith(".flac") and by["s4"]["audio_filepath"] == "c.ogg"


def test_labeled_clips_need_speaker_label_and_file(spark, files):
    files("cv/clips/a.mp3", "x")
    tsv = files("cv/validated.tsv", "path\tclient_id\tage\tsentence\na.mp3\ts1\t teens \tq\"x\na.mp3\t \tteens\t\nb.mp3\ts2\tteens\t\n")
    clips = tabular.list_files(spark, f"{files.root}/cv/clips")
    rows = tabular.read_labeled_clips(spark, tsv, clips, root=f"{files.root}/cv/clips", label="age").collect()
    assert [(r["id"], r["speaker"], r["age"]) for r in rows] == [("a", "s1", "teens")]


def test_result_loader_precedence(spark, files):
    inline = files("a.json", '{"dev": {"predictions": [{"item_id": 1, "reference": "a", "hypothesis": "b"}]}, "predictions": [{"item_id": 2}]}')
    rows = results.load_entry(spark, inline, task="asr", system="s", order=0, seed="none").collect()
    assert [(r["unit_id"], r["reference"], r["hypothesis"]) for r in rows] == [("1", "a", "b")]
    nested = files("b.json", '{"results": {"our model": {"balanced_accuracy": 1, "oof_predictions": [{"item_id": "x", "speaker_id": "s", "fold": 0, "gold_label": "g", "predicted_label": "p"}]}}}')
    row = results.load_entry(spark, nested, task="classification:e", system="s", order=0, seed="0").first()
    assert (row["gold"], row["prediction"]) == ("g", "p")
    assert results.classification_score(spark, nested) == "balanced_accuracy"
    items = files("c.json", '{"per_item": {"records": [{"item_id": "x", "metrics": {"l1": 0.5, "sdr": 2}}]}}')
    got = {(r["metric"], r["value"]) for r in results.load_entry(spark, items, task="reconstruction", system="s", order=0, seed="0").collect()}
    assert got == {("l1", 0.5), ("sdr", 2.0)}
    files("t.json", '{"trials": [{"trial_id": "t", "target": true, "score": 0.25, "enroll_speaker_id": "a", "test_speaker_id": "a"}]}')
    pointer = files("d.json", '{"trials_artifact": "t.json"}')
    trial = results.load_entry(spark, pointer, task="verification", system="s", order=0, seed="none").first()
    assert (trial["label"], trial["score"], trial["spk_b"]) == (1, 0.25, "a")
    with pytest.raises(ValueError):
        results.read_records(spark, files("e.json", "{}"), "asr")


def test_metric_log_reader(spark, files):
    log = files("runA/logs/train.jsonl", '{"step": 1, "loss": 2.0, "lr": 0.1}\n{"step": 1, "loss": 1.5}\n{"step": 2, "loss": 1.0}\n')
    from utterset.operators import runlogs

    merged = {(r["run"], r["step"], r["key"]): float(r["value"]) for r in runlogs.merge_rows(results.read_metric_log(spark, log)).collect()}
    assert merged == {("runA", 1, "loss"): 1.5, ("runA", 1, "lr"): 0.1, ("runA", 2, "loss"): 1.0}
    lines = spark.createDataFrame([("f", "{bad"), ("f", '{"loss": 1}'), ("f", '{"step": 1}')], "file string, value string")
    assert {r["rule"] for r in results.log_violations(lines).collect()} == {"invalid_json", "missing_step"}


# -- sinks ------------------------------------------------------------------


def test_sinks_write_and_check(spark, files):
    df = spark.createDataFrame([("a.wav", "x"), ("b.wav", "y")], "file_name string, label string")
    writers.write_metadata_tsv(df, f"{files.root}/meta")
    assert spark.read.option("header", True).option("sep", "\t").csv(f"{files.root}/meta").count() == 2
    with pytest.raises(v.ContractError):
        writers.write_metadata_tsv(df.unionByName(df), f"{files.root}/meta2")
    split = sampling.split_by_source(spark.range(40).select(F.col("id"), F.lit("s").alias("dataset")), "id")
    writers.write_splits(split, f"{files.root}/splits")
    assert spark.read.json(f"{files.root}/splits").where("split = 'val'").count() == 2
    packed = writers.pack_metadata(df.withColumn("frames", F.lit(3)), ["frames"])
    assert packed.select(F.try_variant_get("original", "$.label", "string"), "packed.frames").first()[1] == 3
    stats = spark.createDataFrame([("m", 1.0)], "metric string, estimate double")
    writers.write_statistics(stats, f"{files.root}/stats", seed=1, replicates=5, confidence=0.9)
    assert spark.read.parquet(f"{files.root}/stats").first()["replicates"] == 5


# -- functions --------------------------------------------------------------


def test_path_functions(spark):
    cases = {
        "a/b.tar.gz": ("b.tar", ".flac", True), "x.MP3": ("x", ".mp3", True), ".hidden": (".hidden", ".flac", True),
        "/abs/x.wav": ("x", ".wav", False), "a/../b": ("b", ".flac", False), "": ("", ".flac", False), ".": (".", ".flac", False),
        "a..b/c.": ("c.", ".flac", True),
    }
    df = spark.createDataFrame([(c,) for c in cases], "p string")
    for r in df.select("p", paths.stem(F.col("p")).alias("s"), paths.extension(F.col("p")).alias("e"), paths.is_safe(F.col("p")).alias("ok")).collect():
        assert (r["s"], r["e"], r["ok"]) == cases[r["p"]], r["p"]


def test_prefix_lengths(spark):
    df = spark.createDataFrame([(100, 0.25), (100, 0.00001), (100, 9.0), (100, None), (100, float("nan")), (100, -1.0)], "n int, d double")
    assert [r[0] for r in df.select(vectors.valid_prefix(F.col("n"), F.col("d"), 10)).collect()] == [2, 1, 90, 100, 100, 100]
    frames = df.select(vectors.valid_frames(F.lit(10), F.col("d"), 16, F.lit(4.0))).collect()
    assert [r[0] for r in frames][:4] == [1, 1, 10, 10]


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [[1.0, 2.0], [3.0, 6.0]])], "x array<double>, ch array<array<double>>")
    r = df.select(
        vectors.unit(F.col("x")).alias("u"), vectors.to_mono(F.col("ch")).alias("m"), vectors.start_crop(F.col("x"), 3).alias("p"),
        vectors.crop_from(F.col("x"), F.lit(1), 2).alias("c"), vectors.argmax(F.col("x")).alias("a"),
    ).first()
    assert r["u"] == pytest.approx([0.6, 0.8]) and r["m"] == [2.0, 4.0] and r["p"] == [3.0, 4.0, 0.0] and r["c"] == [4.0, 0.0] and r["a"] == 1


# -- splits and ranks -------------------------------------------------------


def skewed(spark, n=3000):
    """A third of all rows belongs to one source."""
    return spark.range(n).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 37).cast("string"))).alias("dataset"))


def test_split_sizes_and_single_rows(spark):
    df = skewed(spark).unionByName(spark.createDataFrame([(10**6, "lonely"), (10**6 + 1, "pair"), (10**6 + 2, "pair")], "id long, dataset string"))
    out = sampling.split_by_source(df, "id", val_pct=0.05, seed=1)
    for r in out.groupBy("dataset").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "val").alias("k")).collect():
        assert r["k"] == (max(1, round(r["n"] * 0.05)) if r["n"] > 1 else 0), r


def test_cut_matches_a_plain_ranking(spark):
    df = skewed(spark).withColumn("h", order_key(3, "t", "id"))
    from pyspark.sql import Window

    plain = df.withColumn("rn", F.row_number().over(Window.partitionBy("dataset").orderBy("h", "id"))).where("rn = 10")
    cuts = {r["dataset"]: r["cut_tie"] for r in hash_cut(df, ["dataset"], "h", "id", F.lit(10), digits=2).collect()}
    assert cuts == {r["dataset"]: r["id"] for r in plain.collect()}


def test_positions_and_running_totals_match_plain_windows(spark):
    from pyspark.sql import Window

    df = skewed(spark).withColumn("h", order_key(3, "t", "id"))
    placed = with_position(df, "h", ["id"], group=["dataset"], digits=1)
    want = placed.withColumn("rn", F.row_number().over(Window.partitionBy("dataset").orderBy("h", "id")) - 1)
    assert want.where("rn <> pos").count() == 0
    totals = running_totals(df.withColumn("x", F.col("id") % 5), ["dataset"], "id", ["x"], descending=True, buckets=7)
    plain = totals.withColumn("w", F.sum("x").over(Window.partitionBy("dataset").orderBy(F.col("id").desc())))
    assert plain.where("w <> cum_x").count() == 0 and plain.count() == 3000


@pytest.mark.parametrize("partitions", [1, 4, 32])
def test_results_do_not_depend_on_partitioning(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        df = skewed(spark).repartition(partitions)
        val = sampling.split_by_source(df, "id").where("split = 'val'").agg(F.sum("id")).first()[0]
        exact = sampling.sample_exact(df, "id", 50, seed=2).agg(F.sum("id")).first()[0]
        fold = sampling.group_kfold(df, "dataset", 4, 7).agg(F.sum(F.col("fold") * F.col("id"))).first()[0]
        shard = shards.assign_shards(df.withColumn("size", F.col("id") % 900 + 1), key="id", size="size", target=20000, seed=3, digits=1)
        packed = shard.agg(F.sum(F.crc32(F.concat("shard", F.col("id").cast("string"))))).first()[0]
        drawn = sampling.sample_groups(df, "id", "dataset", min_rows=2, max_rows=5, total=60, seed=1)
        groups = drawn.agg(F.sum("id"), F.count("*")).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = (val, exact, fold, packed, tuple(groups))
    assert groups[1] == 60
    assert RESULTS.setdefault("all", got) == got


RESULTS: dict = {}


def test_folds_keep_groups_together(spark):
    out = sampling.group_kfold(skewed(spark), "dataset", 5, 1)
    assert out.groupBy("dataset").agg(F.count_distinct("fold").alias("k")).where("k <> 1").count() == 0
    sizes = [r["k"] for r in out.groupBy("fold").agg(F.count_distinct("dataset").alias("k")).collect()]
    assert max(sizes) - min(sizes) <= 1
    with pytest.raises(ValueError):
        sampling.group_folds(skewed(spark).where("dataset = 'hot'"), "dataset", 5, 1)


def test_first_wins_and_existing_extension_order(spark):
    df = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 5, "only")], "k string, p int, t string")
    assert {r["k"]: r["t"] for r in sampling.first_wins(df, "k", ["p"]).collect()} == {"a": "early", "b": "only"}
    rows = spark.createDataFrame([("u1",), ("u2",)], "stem string")
    have = spark.createDataFrame([("u1.flac",), ("u1.mp3",), ("u3.wav",)], "path string")
    assert [r["path"] for r in joins.existing_with_extension(rows, have, stem="stem").collect()] == ["u1.mp3"]


def test_roles_check(spark):
    df = spark.createDataFrame([("F_09",), ("F_01",)], "speaker string")
    sampling.require_both_roles(sampling.split_by_list(df, "speaker", ["F_09"]))
    with pytest.raises(ValueError):
        sampling.require_both_roles(sampling.split_by_list(df, "speaker", ["M_09"]))


# -- shards -----------------------------------------------------------------


def test_next_fit_respects_the_target(spark):
    df = spark.range(2000).select("id", (F.col("id") * 7919 % 900 + 100).alias("size")).unionByName(
        spark.createDataFrame([(99999, 50000)], "id long, size long"))
    out = shards.assign_shards(df, key="id", size="size", target=30000, seed=1, digits=1)
    table = out.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    assert table.where((F.col("bytes") + shards.FINAL_RECORD > 30000) & (F.col("n") > 1)).count() == 0
    assert out.count() == 2001
    # closed shards are well filled: at most one open shard per bucket stays small
    assert table.where(F.col("bytes") < 15000).count() <= 16 + 1
    # a larger table keeps its keys' buckets
    tenfold = df.unionByName(spark.range(100000, 120000).select("id", F.lit(500).cast("long").alias("size")))
    bucket = F.substring("shard", 1, 8).alias("bucket")
    more = shards.assign_shards(tenfold, key="id", size="size", target=30000, seed=1, digits=1).select("id", bucket)
    assert out.select("id", bucket).join(more, ["id", "bucket"]).count() == 2001
    with pytest.raises(ValueError, match="above_shard_cap"):
        shards.assign_shards(df.withColumn("size", F.col("size") * 100000), key="id", size="size", target=30000, seed=1, digits=1)


def test_packing_in_small_batches_equals_row_by_row(spark):
    rng = random.Random(2)
    data = [(i, rng.choice([10, 300, 900, 4000, 25000, 29990])) for i in range(700)]
    df = spark.createDataFrame(data, "id long, size long")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
        out = shards.assign_shards(df, key="id", size="size", target=30000, seed=4, digits=1)
        got = out.withColumn("h", order_key(4, "shard", "id")).orderBy("h", "id").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    bucket, number, used = None, 0, 0
    for r in got:
        if r["h"][0] != bucket:
            bucket, number, used = r["h"][0], 0, 0
        elif used + r["size"] + shards.FINAL_RECORD > 30000:
            number, used = number + 1, 0
        used += r["size"]
        assert r["shard"] == f"shard-{bucket}-{number:06d}"


def test_codes_come_from_the_alphabet_alone(spark):
    known = asr.build_charset(spark.createDataFrame([("Bañ",), ("𝒳a",)], "text string"))
    df = spark.createDataFrame([("aB!ñ𝒳",), ("",), (None,), ("zz\n",)], "text string")
    code = {r["symbol"]: r["code"] for r in known.collect()}
    got = [r["codes"] for r in asr.encode_text(df, known).collect()]
    assert got == [[code["a"], code["b"], code["ñ"], code["𝒳"]], [], None, []]
    assert asr.encode_text(df, known.limit(0)).first()["codes"] in ([], None)


def test_descriptor_rules(spark):
    index = spark.createDataFrame([("a", "s1", 1.0, 10), ("b", "s1", 2.0, 20), ("c", "s2", 3.0, 30)],
                                  "sample_id string, shard string, duration_seconds double, encoded_byte_size long")
    good = shards.build_descriptor(shards.shard_table(index), sample_rate=16000)
    files_ = spark.createDataFrame([("shards/s1.tar",), ("shards/s2.tar",)], "path string")
    assert shards.descriptor_violations(good, sample_rate=16000, files=files_).count() == 0
    bad = good.withColumn("format_version", F.lit(9)).withColumn(
        "shards", F.concat(F.col("shards"), F.slice("shards", 1, 1)))
    rules_ = {r["rule"] for r in shards.descriptor_violations(bad, sample_rate=8000, files=files_.limit(1)).collect()}
    assert rules_ == {"format_version", "sample_rate", "duplicate_path", "total_samples", "missing_file"}


def test_reconciliation_finds_each_fault(spark):
    schema = "sample_id string, shard string, duration_seconds double, encoded_byte_size long"
    index = spark.createDataFrame([("a", "s1", 1.0, 10), ("b", "s1", 2.0, 20), ("c", "s2", 3.0, 30), ("c", "s2", 3.0, 30)], schema)
    listed = shards.shard_table(index).where("shard = 's1'").withColumn("payload_bytes", F.lit(31).cast("long"))
    members = spark.createDataFrame([("a", "s2", 1.0, 10), ("c", "s2", 3.5, 30), ("x", "s1", 1.0, 1)], schema)
    found = {r["rule"] for r in shards.verify_dataset(index, listed, members).collect()}
    assert found == {"unknown_shard", "shard_bytes", "missing_member", "unindexed_member", "member_shard", "member_duration", "duplicate_sample"}


def test_quantization_and_scaling_defaults(spark):
    empty = spark.createDataFrame([], "frame_count long, max_abs_error double, sum_squared_error double, sum_squared_signal double")
    q = shards.quant_stats(empty).first()
    assert (q["frame_count"], q["rms_error"], q["snr_db"]) == (0, 0.0, None)
    one = spark.createDataFrame([(10, 0.1, 0.1, 10.0)], empty.schema)
    assert shards.quant_stats(one).first()["snr_db"] == pytest.approx(20.0)
    s = shards.scaling_stats(spark.createDataFrame([], "amplitude_restore_gain double, canonical_peak double")).first()
    assert (s["scaled_sample_count"], s["max_restore_gain"], s["max_canonical_peak"]) == (0, 1.0, 0.0)


def test_amplitude_rules(spark):
    gain = clean.restore_gain(F.lit(2.0))
    assert spark.range(1).select(gain).first()[0] == pytest.approx(2.0 / 0.999 * (1 + 1e-6), rel=1e-15)
    rows = [("ok", 1.0, 0.5, 0.5), ("legacy", None, None, None), ("part", 1.0, None, 0.5), ("nan", math.nan, 0.5, 0.5),
            ("low", 0.5, 0.25, 0.5), ("neg", 1.0, -0.5, -0.5), ("off", 2.0, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "sample_id string, amplitude_restore_gain double, canonical_peak double, storage_peak double")
    got = {(r["key"], r["rule"]) for r in clean.validate_amplitude(df).collect()}
    assert got == {("part", "all_or_none"), ("nan", "finite"), ("low", "gain_at_least_one"), ("neg", "non_negative_peak"), ("off", "consistent_peaks")}


def test_parity_audit_reports_mismatch_and_error(spark):
    a = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0]), ("c", [0.5])], "k string, x array<double>")
    b = spark.createDataFrame([("a", [1.0, 2.1]), ("b", [1.0, 0.0]), ("c", [0.5])], "k string, x array<double>")
    failures, totals = shards.audit_parity(a, b, key="k", samples="x", tolerance=0.01)
    assert {(r["k"], r["reason"]) for r in failures.collect()} == {("a", "max_abs_error"), ("b", "frame_count")}
    t = totals.first()
    assert (t["records"], t["failures"], t["frames"]) == (2, 1, 3)


def test_document_manifest_has_the_core(spark, sf_small):
    assert document_manifest(spark, sf_small).columns == [
        "audio_filepath", "text", "duration", "sample_rate", "dataset", "id", "speaker_id", "language"]


def test_rows_of_a_bucket_with_many_shards_find_their_own(spark, monkeypatch):
    data = [(i % 700 if i % 3 else None, 600 + 37 * (i % 11)) for i in range(900)]  # keys repeat, some are missing
    df = spark.createDataFrame(data, "k int, size long")
    count = lambda out: sorted(map(repr, out.collect()))
    limit = shards.FINAL_RECORD + 3000
    pack = lambda digits: shards.assign_shards(df, key="k", size="size", target=limit, seed=4, digits=digits)
    for digits in (0, 1):
        monkeypatch.setattr(shards, "CELL_STARTS", 10**6)  # one cell to a bucket: every start is compared
        whole = count(pack(digits))
        monkeypatch.setattr(shards, "CELL_STARTS", 2)
        out = pack(digits).localCheckpoint()
        assert count(out) == whole and len({r["shard"] for r in out.collect()}) > 100
        # what a row is compared with does not grow with the bucket
        plan = pack(digits)._jdf.queryExecution().analyzed().toString()
        assert "_before" in plan and "_cell" in plan
