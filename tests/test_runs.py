"""Runs that stop, tables that are published, progress that lasts, audits of every row, numbered lines."""

import math

import pytest
from pyspark.sql import functions as F

from utterset import violations as v
from utterset.functions import vectors
from utterset.operators import clean, shards
from utterset.session import Scratch
from utterset.sinks import published, writers
from utterset.sources import manifest, registry
from utterset.streaming import ledger, progress


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# -- published tables


def test_a_failed_write_leaves_the_old_manifest(spark, tmp_path):
    path = f"{tmp_path}/manifest.jsonl"
    with pytest.raises(FileNotFoundError):
        published.current_folder(spark, path)
    assert published.resolve(spark, path) == path
    one = spark.range(3).select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("audio_filepath"))
    writers.write_manifest(one, path)
    before = published.read_pointer(spark, path)
    broken = one.select(F.raise_error(F.lit("lost")).cast("string").alias("audio_filepath"))
    with pytest.raises(Exception, match="lost"):
        writers.write_manifest(broken, path)
    assert published.read_pointer(spark, path) == before
    read = registry.ready_manifest(spark, str(tmp_path), dataset="d", language="xx")
    assert rows_of(read, "audio_filepath") == [("a0",), ("a1",), ("a2",)]
    writers.write_manifest(one.limit(1), path)
    assert rows_of(read, "audio_filepath") == [("a0",), ("a1",), ("a2",)]  # a reader that has begun keeps its version
    assert registry.ready_manifest(spark, str(tmp_path), dataset="d", language="xx").count() == 1
    dropped = published.drop_versions(spark, path)
    assert before in dropped and len(published.versions(spark, path)) == 1
    assert registry.ready_manifest(spark, str(tmp_path), dataset="d", language="xx").count() == 1


# -- resumed packing


def packed_rows(spark):
    return spark.range(200).select("id", F.concat(F.lit("s"), F.lpad((F.col("id") % 11).cast("string"), 2, "0")).alias("shard"))


def test_a_stopped_run_redoes_only_its_open_wave(spark, tmp_path):
    rows, settings = packed_rows(spark), {"target": "9"}

    def stop(wave):
        if wave == 1:
            raise RuntimeError("killed")

    with pytest.raises(RuntimeError, match="killed"):
        ledger.pack_shards(rows, f"{tmp_path}/run", settings=settings, waves=4, order="id", before_commit=stop)
    half = ledger.ShardLedger(spark, f"{tmp_path}/run")
    assert rows_of(half.read().select("shard").distinct(), "shard") == [("s00",), ("s01",), ("s02",)]
    book, written = ledger.pack_shards(rows, f"{tmp_path}/run", settings=settings, waves=4, order="id")
    assert written == [1, 2, 3]
    whole, _ = ledger.pack_shards(rows, f"{tmp_path}/whole", settings=settings, waves=4, order="id")
    assert rows_of(book.read(), "id", "shard") == rows_of(whole.read(), "id", "shard") == rows_of(rows, "id", "shard")
    begun = {r["shard"]: r["n"] for r in book.entries().where("event = 'begun'").groupBy("shard").agg(F.count("*").alias("n")).collect()}
    assert {s for s, n in begun.items() if n == 2} == {"s03", "s04", "s05"} and set(begun.values()) == {1, 2}
    assert ledger.pack_shards(rows, f"{tmp_path}/run", settings=settings, waves=4, order="id")[1] == []
    with pytest.raises(v.ContractError):
        ledger.pack_shards(rows, f"{tmp_path}/run", settings={"target": "8"}, waves=4, order="id")
    with pytest.raises(v.ContractError):
        ledger.pack_shards(rows.where("id > 0"), f"{tmp_path}/run", settings=settings, waves=4, order="id")


def test_a_shard_that_was_finished_twice_counts_once(spark, tmp_path):
    rows = packed_rows(spark)
    book, _ = ledger.pack_shards(rows, f"{tmp_path}/run", settings={}, waves=2, order="id")
    first = book.finished().orderBy("shard").first()
    again = rows.where(F.col("shard") == first["shard"]).withColumn("attempt", F.lit("zz"))
    again.write.mode("append").partitionBy("attempt", "shard").parquet(f"{tmp_path}/run/data")
    book.enter("finished", again.select("shard").distinct(), "zz")
    assert rows_of(book.read(), "id") == rows_of(rows, "id")


# -- progress


def test_progress_counts_more_batches_than_a_query_remembers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(112):
        (tmp_path / "in" / f"{i:03d}.json").write_text('{"x": 1}\n' * (i % 3 + 1))
    seen = progress.ProgressTable(spark, f"{tmp_path}/progress")
    spark.streams.addListener(seen)
    try:
        stream = spark.readStream.schema("x long").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
        query = stream.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
        seen.wait(query)
    finally:
        spark.streams.removeListener(seen)
    assert len(query.recentProgress) <= 100
    expected = sum(i % 3 + 1 for i in range(112))
    told = progress.read_progress(spark, f"{tmp_path}/progress", expected_rows=2 * expected).where("rows > 0").orderBy("batch").collect()
    assert len(told) == 112 and told[-1]["total"] == expected
    assert all(a["total"] + b["rows"] == b["total"] for a, b in zip(told, told[1:]))
    last = told[-1]
    assert last["eta_seconds"] == pytest.approx(expected / last["rate"]) and last["rate"] == pytest.approx(expected / last["elapsed"])


# -- line numbers


def test_lines_of_a_file_read_in_blocks_keep_their_numbers(spark, tmp_path):
    lines = [("" if i % 7 == 0 else f"line {i} " + "x" * (i % 40)) for i in range(3000)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "in" / "two.txt").write_text("\n".join(lines[:52]))  # no newline at the end
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        numbered = manifest.numbered_lines(spark, f"{tmp_path}/in")
        assert numbered.rdd.getNumPartitions() > 8
        got = {(r["manifest"].rsplit("/", 1)[1], r["line"]): r["value"] for r in numbered.collect()}
        want = {("one.txt", i): x for i, x in enumerate(lines, 1)} | {("two.txt", i): x for i, x in enumerate(lines[:52], 1)}
        assert got == want
        (tmp_path / "bad.jsonl").write_text("{broken\n\n" + '{"audio_filepath": "a", "id": "1"}\n' * 900 + "{broken\n")
        _, found = manifest.read_inventory(spark, f"{tmp_path}/bad.jsonl")
        broken = rows_of(found.where("rule = 'invalid_json'"), "key")
        assert [int(k.rsplit(":", 1)[1]) for (k,) in broken] == [1, 903]
    finally:
        for k, x in old.items():
            spark.conf.set(k, x)


# -- rounding up


def test_next_up_is_the_next_double(spark):
    values = [0.0, -0.0, 1.0, -1.0, 0.1, 5e-324, -5e-324, 2.2250738585072014e-308, 2.2250738585072009e-308, 1e308, -1e308, 1.7976931348623157e308,
              -1.7976931348623157e308, 0.999, 3.0, math.nextafter(1.0, 0), math.nextafter(2.0, 3), -2.0**-1022, -2.0**-1021, 2.0**1023, -(2.0**1023)]
    values += [s * 2.0**e * m for s in (1, -1) for e in range(-1070, 1020, 37) for m in (1.0, 1.25, 1.9999999999999998)]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    for r in df.select("x", vectors.next_up(F.col("x")).alias("y")).collect():
        assert r["y"] == math.nextafter(r["x"], math.inf), r["x"]
    odd = spark.createDataFrame([(math.inf,), (-math.inf,), (None,)], "x double").select(vectors.next_up(F.col("x")).alias("y"))
    assert [r["y"] for r in odd.collect()] == [math.inf, -math.inf, None]


def test_gains_are_rounded_up(spark):
    peaks = [0.5, 0.999, math.nextafter(0.999, 1), 1.0, 1.3, 2.0, 17.25]
    got = spark.createDataFrame([(p,) for p in peaks], "p double").select(clean.restore_gain(F.col("p")).alias("g")).collect()
    want = [1.0 if p <= 0.999 else math.nextafter((p / 0.999) * (1.0 + 1.0e-6), math.inf) for p in peaks]
    assert [r["g"] for r in got] == want


# -- mergeable statistics


def test_partials_merge_in_any_grouping(spark):
    df = spark.range(1000).select(
        (F.col("id") % 13).alias("shard"), (F.col("id") % 50).alias("frame_count"), (F.col("id") % 17 / 100).alias("max_abs_error"),
        (F.col("id") / 8).alias("sum_squared_error"), (F.col("id") * 2.0).alias("sum_squared_signal"),
        (F.col("id") % 30 / 10).alias("canonical_peak"),
    ).withColumn("amplitude_restore_gain", clean.restore_gain(F.col("canonical_peak")))
    partials = shards.partial_statistics(df, ["shard"])
    halves = shards.merge_statistics(partials.withColumn("half", F.col("shard") % 2), ["half"])
    whole = shards.finish_statistics(shards.merge_statistics(halves)).first()
    assert whole == shards.finish_statistics(shards.merge_statistics(partials)).first()
    direct, scaling = shards.quant_stats(df).first(), shards.scaling_stats(df).first()
    assert all(whole["quantization"][c] == pytest.approx(direct[c], rel=1e-12) for c in direct.asDict())
    assert whole["amplitude_scaling"].asDict() == scaling.asDict()


# -- audit of every row


def test_the_whole_audit_equals_comparing_every_row(spark):
    rng = lambda i: [round(((i * 37 + j * 11) % 101) / 97, 6) for j in range(5)]
    source = [(i, rng(i)) for i in range(400)]
    stored = lambda x: F.transform(x, lambda e: F.round(e, 3))
    packed = [(i, [round(e, 3) for e in x]) for i, x in source if i not in (7, 8)]
    packed[20] = (20 + 2, packed[20][1][:4])
    packed[90] = (packed[90][0], [e + (0.5 if j == 2 else 0) for j, e in enumerate(packed[90][1])])
    packed.append((1000, [1.0]))
    a, b = (spark.createDataFrame(x, "k long, x array<double>").repartition(5) for x in (packed, source))
    failures, totals, shipped = shards.audit_all(a, b, key="k", samples="x", stored=stored, tolerance=0.01, levels=(1, 2))
    plain, sums = shards.audit_parity(a, b, key="k", samples="x", tolerance=0.01)
    assert rows_of(failures.select("k", "reason"), "k", "reason") == rows_of(plain.select("k", "reason"), "k", "reason")
    assert {r["k"] for r in shipped.collect()} == {7, 8, 22, packed[90][0], 1000}
    got, want = totals.first().asDict(), sums.first().asDict()
    assert got == pytest.approx(want)


def test_ranges_that_agree_ship_nothing(spark):
    df = spark.range(500).select("id", F.xxhash64("id").alias("one"), F.xxhash64(F.lit("b"), "id").alias("two"))
    scratch = Scratch(spark, "test")
    assert shards.differing_keys(df, df.repartition(7), "id", (1, 3), scratch).count() == 0
    doubled = df.unionByName(df.where("id = 3"))
    assert rows_of(shards.differing_keys(df, doubled, "id", (1, 3), scratch), "id") == [(3,)]
