"""Dealt operators against brute force on small fixtures with nulls, empties, ties, repeats and odd columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from utterset.llm import chat, jaccard, language, mixing, passages, pieces, quality, sharding, sieve, topk, urls
from utterset.llm.links import connected
from utterset.llm.queries import model_path
from utterset.llm.wordhash import mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, node int, size string, row string"


def words(rng, n):
    return " ".join(rng.choice(["ba", "lo", "mi"]) + str(rng.randrange(400)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text, lang, source) with odd cases; further columns clash with internal names."""
    rng = random.Random(5)
    passage, base = words(rng, 60), words(rng, 120)
    near = base.split()
    near[50] = "changed"
    texts = [words(rng, rng.randrange(5, 90)) for _ in range(40)]
    texts += [base, " ".join(near), base + "\nmore", passage + " " + words(rng, 30), words(rng, 20) + "\n" + passage]
    texts += [None, "", "  \n\t", "one", "one two three", "one", "la " * 400, "x" * 5000, "*** ### $$$ " * 20, words(rng, 6000)]
    texts += [texts[0]] * 6
    out = [(i, t, ["en", "fr", None][i % 3], ["a", "b", "ä", None][i % 4]) for i, t in enumerate(texts)]
    return out + [(None, "null id " + passage, "en", "a"), (3, texts[3], None, "a"), out[7], out[7]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "s", "r") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_set(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())


def test_quality(docs, rows, none):
    def brute(text):
        w = WORD.findall(text or "")
        window = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        times = Counter(window)
        inside = {p for i, k in enumerate(window) if times[k] > 1 for p in range(i, i + 8)}
        lines = [line for line in (text or "").split("\n") if WORD.search(line)]
        symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
        return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(inside)

    got = quality.ledger(docs).collect()
    found = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got]
    assert sorted(found, key=str) == sorted(((r[0], *brute(r[1])) for r in rows), key=str)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.failed == 0 for r in got)
    table = quality.ablation(quality.ledger(docs), (quality.STANDARD,)).collect()
    for r in table:
        bit = quality.mask_of((r.rule,))
        assert r.n_failed == sum(bool(x.failed & bit) for x in got)
        assert r.n_kept_without == sum(not x.failed & ~bit for x in got)
    assert quality.ledger(none).count() == 0


def test_jaccard(docs, rows, none):
    texts = Counter(r[1] for r in rows if r[1] is not None)
    sets = {t: shingle_set(t) for t in texts}
    linked = {
        t: [u for u in texts if u != t and sets[t] and len(sets[t] & sets[u]) >= 0.8 * len(sets[t] | sets[u]) - 1e-9] for t in texts
    }
    group = {t: {t} for t in texts}
    for t in texts:
        for u in linked[t]:
            joined = group[t] | group[u]
            for v in joined:
                group[v] = joined
    ids = {t: [r[0] for r in rows if r[1] == t and r[0] is not None] for t in texts}
    got = jaccard.near_duplicates(docs).collect()
    want = []
    for doc_id, text, *_ in rows:
        if text is None:
            want.append((doc_id, doc_id, 1, 0, 0))
        else:
            least = min((i for u in group[text] for i in ids[u]), default=None)
            want.append((doc_id, least, texts[text], sum(texts[u] for u in linked[text]), len(linked[text])))
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)
    groups = len({frozenset(g) for g in group.values()}) + sum(r[1] is None for r in rows)
    assert sum(r.stays for r in got) == groups
    one = jaccard.one_of_each(docs)
    assert one.columns == docs.columns and one.count() == groups
    assert jaccard.near_duplicates(none).count() == 0


def test_jaccard_blocks_agree(docs):
    """Hot nodes and groups cut into many blocks give the same rows."""
    small = jaccard.Forest(node_rows=2, block_shingles=100)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(jaccard.near_duplicates(docs, forest=small)) == key(jaccard.near_duplicates(docs))


@pytest.mark.parametrize("per_task", [7, 500_000])
def test_connected(spark, per_task):
    """A path, a star, an own link, null ends and random links, contracted in many tasks and in one."""
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(20)] + [(30, 31), (31, 30), (30, 31), (40, 40), (None, 3), (50, None), (7, 7)]
    edges += [(100, i) for i in range(101, 130)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(35)]
    names = sorted({e for pair in edges if None not in pair for e in pair})
    root = {n: n for n in names}
    for _ in names:
        for a, b in edges:
            if a is not None and b is not None:
                root[a] = root[b] = min(root[a], root[b])
    table = spark.createDataFrame(edges, "node long, other long").repartition(6)
    found = connected(table, per_task).collect()
    assert {r.node: r.root for r in found} == root and len(found) == len(root)
    as_bytes = table.select(*[F.unhex(F.lpad(F.hex(c), 4, "0")).alias(c) for c in ("node", "other")])
    got = {int.from_bytes(r.node): int.from_bytes(r.root) for r in connected(as_bytes, per_task).collect()}
    assert got == root
    assert connected(table.limit(0), per_task).count() == 0


def test_compact_windows():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n, run = int(rng.integers(1, 120)), int(rng.integers(1, 20))
        hashed, cuts = mix(rng.integers(0, 40, n).astype(np.uint64)), np.array([0, n // 3, n // 3, n])
        at, lo, hi = passages.compact_windows(hashed, cuts, run)
        got = {(i, c) for c, a, b in zip(at, lo, hi, strict=True) for i in range(a, c + 1) if c <= i + run - 1 <= b}
        want = set()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            want |= {(i, i + int(np.argmin(hashed[i : i + run] >> np.uint64(32)))) for i in range(a, b - run + 1)}
        assert got == want


def test_diagonal_similarity():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, m, run, k = (int(rng.integers(a, b)) for a, b in ((6, 60), (6, 60), (2, 6), (2, 40)))
        a, b = rng.integers(0, k, n).astype(np.uint64), rng.integers(0, k, m).astype(np.uint64)
        pair = passages._Pair(a, b, run)
        for shift in range(run - m, n - run + 1):
            lo, hi = max(0, shift), min(n - run, shift + m - run)
            for i, value in zip(range(lo, hi + 1), pair.diagonal(shift, lo, hi) if lo <= hi else (), strict=True):
                x, y = set(a[i : i + run].tolist()), set(b[i - shift : i - shift + run].tolist())
                assert abs(len(x & y) / len(x | y) - value) < 1e-12


def test_passages(docs, rows, none):
    """Every run of 51 words that a smaller document holds is covered, and what is found is near equal."""
    ids = [r for r in rows if r[0] is not None and r[1] is not None]
    plain = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    own = {i: WORD.findall(t) for i, t, *_ in ids}
    got = passages.find_repeats(plain).collect()
    held = {}
    for r in got:
        a = own[r.doc_id][r.first_word : r.first_word + 51]
        b = own[r.of_doc_id][r.of_first_word : r.of_first_word + 51]
        x, y = shingle_set(" ".join(a)), shingle_set(" ".join(b))
        assert len(x & y) >= 0.8 * len(x | y) - 1e-9 and r.similarity >= 0.8
        held.setdefault(r.doc_id, set()).update(range(r.first_word, r.first_word + r.n_words))
    first = {}
    for i in sorted(own):
        runs = {tuple(own[i][k : k + 51]): k for k in range(len(own[i]) - 50)}
        for key, k in runs.items():
            if key in first:
                assert set(range(k, k + 51)) <= held[i]
        for key in runs:
            first.setdefault(key, i)
    cut = passages.without_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    assert passages.find_repeats(none).count() == 0 and passages.without_repeats(none).count() == 0


def test_only_windows_behind_a_smaller_document_are_kept(spark):
    """Values go with their least document, over any number of batches and in one exchange."""
    rng = np.random.default_rng(4)
    data = sorted({(int(v), int(d), int(w)) for v, d, w in rng.integers(0, (60, 8, 3), (300, 3))})
    columns = [pa.array([r[i] for r in data], pa.int64()) for i in range(3)]
    whole = pa.RecordBatch.from_arrays(columns, names=["value", "doc", "window"])
    least = {v: min(d for w, d, _ in data if w == v) for v, _, _ in data}
    want = [(*r, least[r[0]]) for r in data if r[1] != least[r[0]]]
    for size in (1, 2, 7, 300):
        batches = (whole.slice(i, size) for i in range(0, len(data), size))
        got = [tuple(r.values()) for b in passages._behind_the_least(batches) for r in b.to_pylist()]
        assert got == want
    rows = [(i, words(random.Random(i % 3), 70) + f" end{i}") for i in range(9)]
    texts = spark.createDataFrame(rows, "doc long, text string")
    kept = passages.shared_windows(texts, passages.Windows())
    assert {r["doc"] % 3 == r["anchor"] and r["doc"] > 2 for r in kept.collect()} == {True}
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1


def test_pieces_are_verified_like_whole_texts(spark):
    """A text goes to its partner as the piece between its first and last run; what is found stays the same."""
    rng, params = random.Random(12), passages.Windows()
    shared = words(rng, 80)
    mine = " ".join([words(rng, 3000), shared, words(rng, 2000)])
    theirs = " ".join([words(rng, 500), shared.replace(" ", " odd ", 1), words(rng, 400)])
    window = windows_of(mine, params)
    other = {int(v) for b in passages._windows(params)([named_batch(1, theirs)]) for v in b.column("value").to_pylist()}
    value = [int(v) for b in passages._windows(params)([named_batch(0, mine)]) for v in b.column("value").to_pylist()]
    window = window[[v in other for v in value]]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([7]), pa.array([3]), pa.array([window.tolist()], pa.list_(pa.int64())), pa.array([mine])],
        names=["doc", "anchor", "windows", "text"],
    )
    (piece,) = passages._pieces(params)([batch])
    assert 0 < len(piece.column("piece")[0].as_py()) < len(mine) / 10
    whole = passages.verify(*passages._flat_shingles(pa.array([mine, theirs]), params.width), window, params)
    (got,) = passages._verify_pairs(params)([piece.append_column("other_text", pa.array([theirs]))])
    found = [(r["first_word"], r["first_word"] + r["n_words"] - 4, r["anchor_word"], r["similarity"]) for r in got.to_pylist()]
    assert found == whole and whole


def named_batch(doc, text):
    return pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([text])], names=["doc", "text"])


def windows_of(text, params):
    """Packed windows of one text, all functions."""
    batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([text])], names=["doc", "text"])
    return np.concatenate([b.column("window").to_numpy() for b in passages._windows(params)([batch])])


def test_passage_in_a_self_repeating_anchor():
    """Any of very many equal places of the anchor may be the one that the passage was taken from."""
    rng, params = random.Random(8), passages.Windows()
    lines = [words(rng, 10) for _ in range(12)]
    anchor = " ".join(rng.choice(lines) for _ in range(800)).split()
    for at in (1503, 3998, 6001):
        for piece in (anchor[at : at + 60], [*anchor[at : at + 30], "changed", *anchor[at + 31 : at + 60]]):
            mine, theirs = passages._flat_shingles(pa.array([" ".join(piece), " ".join(anchor)]), params.width)
            exact = "changed" not in piece
            found = passages.verify(mine, theirs, windows_of(" ".join(piece), params), params)
            if exact:
                assert [f[:2] for f in found] == [(0, 56)]
            for start, stop, other, similarity in found:
                x, y = set(mine[start : start + params.run].tolist()), set(theirs[other : other + params.run].tolist())
                assert len(x & y) >= 0.8 * len(x | y) - 1e-9 and similarity >= 0.8 and stop - start >= params.run


def test_passages_of_one_value():
    """A text of one word over and over has as many alignments as pairs of places."""
    params = passages.Windows()
    mine, theirs = passages._flat_shingles(pa.array(["la " * 6000, "la " * 5000]), params.width)
    found = passages.verify(mine, theirs, windows_of("la " * 6000, params), params)
    assert [f[:2] for f in found] == [(0, 5996)]


def planted(spark, changed):
    """Rows of 30 passages of 60 words: (3k, less similar), (3k + 1, near by ``changed`` words), (3k + 2, as it is)."""
    rng, made = random.Random(9), []
    for k in range(30):
        own = words(rng, 60).split()
        for j, places in enumerate(((10, 25, 40), changed, ())):
            made.append((3 * k + j, " ".join(f"new{j}x{i}" if i in places else w for i, w in enumerate(own))))
    return spark.createDataFrame(made, "doc_id long, text string")


def test_passage_behind_a_less_similar_document(spark):
    """A smaller document that shares the minima but is no near copy does not hide the real partner."""
    got = {(r.doc_id, r.of_doc_id) for r in passages.find_repeats(planted(spark, ())).where("n_words = 60").collect()}
    assert {(3 * k + 2, 3 * k + 1) for k in range(30)} <= got


def test_near_passages(spark):
    """A changed word well inside a passage leaves each of its 51-word runs near equal."""
    held = {}
    for r in passages.find_repeats(planted(spark, (30,))).collect():
        held.setdefault(r.doc_id, set()).update(range(r.first_word, r.first_word + r.n_words))
    assert all(held.get(3 * k + 2) == set(range(60)) for k in range(30))


def test_passage_recall():
    assert passages.Windows().recall_at(0.8) >= 0.9998


def test_mixing(docs, rows, none):
    got = mixing.mix(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    size = Counter()
    for _, text, _, source in rows:
        size[source] += len(WORD.findall(text or ""))
    order = sorted(s for s in size if s is not None) + [None]
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, open_ = {}, set(size)
    while True:
        left = sum(size.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s]}
        if not over:
            break
        target |= {s: 3.0 * size[s] for s in over}
        open_ -= over
    target |= share
    by_source = {r.source: (r.source_size, r.target) for r in got}
    assert {s: v[0] for s, v in by_source.items()} == dict(size)
    for s, (_, t) in by_source.items():
        assert abs(t - target[s]) <= 1e-6 * target[s]
        taken = sum(r.taken for r in got if r.source == s)
        assert abs(taken - t) <= max(r.size for r in got if r.source == s)
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in got)
    assert mixing.mixed_rows(docs).count() == sum(r.copies for r in got)
    assert mixing.mix(none).count() == 0


def test_sharding(spark, docs, rows, none):
    got = sharding.shard(docs, shards=4).collect()
    assert len(got) == len(rows)
    for k in {r.shard for r in got}:
        own = sorted(r.slot for r in got if r.shard == k)
        assert own == list(range(len(own)))
    import zlib

    assert {(r.doc_id, r.text_crc32) for r in got} == {(r[0], zlib.crc32((r[1] or "").encode())) for r in rows}
    assert sharding.shard(none).count() == 0
    # a third of all rows is one text: split by ids, sizes near equal
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    sizes = [r.s for r in sharding.shard(hot, shards=8).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 8 and max(sizes) <= 1.05 * sum(sizes) / 8



def test_repeated_rows_are_sharded_evenly(spark):
    data = [(None, "the same text again") if i % 3 == 0 else (i, f"text {i % 700}") for i in range(3000)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(6)
    placed = sharding.shard(df, shards=16).persist()
    sizes = [r["s"] for r in placed.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 16 and max(sizes) <= 1.05 * sum(sizes) / 16 and sum(sizes) == sum(len(t) + 1 for _, t in data)
    slots = placed.groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("k"), F.max("slot").alias("m")).collect()
    assert all(r["n"] == r["k"] == r["m"] + 1 for r in slots)
    # the many small groups of equal texts stay together, but for those on a boundary
    split = placed.where("doc_id is not null").groupBy("text_crc32").agg(F.count_distinct("shard").alias("k"))
    assert split.where("k > 1").count() <= 15
    again = sharding.shard(df.repartition(3), shards=16)
    known = placed.where("doc_id is not null").select("doc_id", "shard").exceptAll(again.where("doc_id is not null").select("doc_id", "shard"))
    assert known.count() == 0
    placed.unpersist()


def test_one_odd_row_moves_no_other_keeper(spark):
    rng = random.Random(21)
    shared = [words(rng, 70) for _ in range(6)]
    data = [(100 - i, words(rng, 20) + " " + shared[i % 6] + " " + words(rng, 15)) for i in range(24)]
    plain = {tuple(r) for r in passages.find_repeats(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert plain
    odd = [*data, data[3], (None, words(rng, 90)), (50, words(rng, 80))]
    got = {tuple(r) for r in passages.find_repeats(spark.createDataFrame(odd, "doc_id long, text string")).collect()}
    assert got == plain
    null_last = passages.find_repeats(spark.createDataFrame([*data, (None, data[0][1])], "doc_id long, text string")).collect()
    assert {tuple(r) for r in null_last if r["doc_id"] is not None} == plain
    assert [r["of_doc_id"] for r in null_last if r["doc_id"] is None]


def test_sieve_never_says_no_to_what_it_holds(spark):
    values = spark.range(5000).select(F.xxhash64("id").alias("v"))
    made = sieve.make_sieve(values, "v", bits=16)
    held = np.array([r["v"] for r in values.collect()], dtype=np.int64).view(np.uint64)
    assert sieve.lets_through(made, held).all()
    large = sieve.make_sieve(values, "v", sieve.LARGE)
    assert sieve.lets_through(large, held).all() and len(large) * 64 == 1 << sieve.LARGE
    assert sum(bin(w).count("1") for w in large[large != 0].tolist()) <= 10_000
    assert not sieve.lets_through(large, mix(np.arange(1000, dtype=np.uint64))).all()
    other = np.array([r[0] for r in spark.range(10**6, 10**6 + 5000).select(F.xxhash64("id")).collect()], dtype=np.int64).view(np.uint64)
    assert 0 < sieve.lets_through(made, other).mean() < 0.1
    assert not sieve.lets_through(sieve.make_sieve(values.limit(0), "v", bits=16), held).any()

def test_urls(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("a.com", "", "block"), ("com", "/x/y", "allow")]
    made = ["http://Example.ORG/es/1", "https://www.example.org/en/12?q", "http://b.org", "http://x.a.com#f", "http://a.com/x/yz", "no", None, "://", "a://b://c", "http://notexample.org/es/"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(made)] + [(None, made[0], 2), (0, made[0], 3)], "page_id long, url string, host int")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = urls.judge_urls(pages, table).collect()
    assert sorted(map(str, got)) == sorted(map(str, urls.judge_urls(pages, table, most_rules=0).collect()))
    for r in got:
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        assert (r.rule, r.verdict) == (max(fits)[1:] if fits else (None, "allow"))
    assert {r.page_id: (r.host, r.path) for r in got}[8] == ("b:", "//c")
    assert urls.judge_urls(pages.limit(0), table).count() == 0


def test_pieces(docs, rows, none):
    import sentencepiece

    model = pieces.read_model(model_path())
    own, library = pieces.Pieces(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = random.Random(3)
    for k in range(4000):
        text = "".join(rng.choice(" ▁  aeithe\n\t.,<s>0xé日😀\x00THaa'-=  ") for _ in range(rng.choice([0, 1, 3, 10, 60])))
        text = rng.choice(["", " " * (k % 40), "aa" * (k % 30)]) + text
        ids = own.encode(text)
        assert ids == library.encode(text) and own.decode(ids) == library.decode(ids)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(i, ids := library.encode(t or ""), digest(",".join(map(str, ids))), digest(library.decode(ids))) for i, t, *_ in rows]
    got = pieces.token_digests(docs, model).collect()
    assert sorted([tuple(r) for r in got], key=str) == sorted([(a, len(b), c, d) for a, b, c, d in want], key=str)
    assert pieces.tokenize(docs, model).count() == len(rows) and pieces.token_digests(none, model).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(2)
    data = [(i, (rng.normal(size=20) * (0.1 + i % 7)).tolist(), 1.0) for i in range(300)]
    data += [(300 + i, [0.5] * 20, 1.0) for i in range(100)] + [(None, [1.0] * 20, 1.0), (401, None, 1.0), (402, [None] * 20, 1.0), (403, [float("nan")] * 20, 1.0), (404, [1.0], 1.0), (5, data[5][1], 2.0)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>, score double")
    got = topk.top_k(table, F.col("vec_id") % 50 == 0, k=5).collect()
    x = {i: np.floor(256 * np.array(v)) for i, v, _ in data[:400]}
    for q in (i for i in x if i % 50 == 0):
        want = sorted((-int(x[q] @ x[i]), i) for i in x if i != q)[:5]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want
    assert topk.top_k(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_language(spark, docs, rows, none):
    rng = random.Random(1)
    kinds = {"en": "the of and thing", "de": "der die und straße", "fr": "le la et élève"}
    made = [(i, " ".join(rng.choice(kinds[k].split()) for _ in range(30)), k) for i in range(120) for k in [rng.choice(list(kinds))]]
    made += [(900, None, "en"), (901, "123 !!", "en"), (902, "", None), (None, "der die straßen", None)]
    table = spark.createDataFrame(made, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.split_and_identify(table).collect()}
    for i, text, lang in made:
        assert got[i].held_out == is_held_out(i)
        assert got[i].lang_pred == ("und" if i in (900, 901, 902) else lang or "de") and 0 <= got[i].score <= 1
    assert language.split_and_identify(docs).count() == len(rows) and language.split_and_identify(none).count() == 0


def plain_languages(made, settings):
    """Language and score of each text, word by word in plain Python; every learned word and n-gram counts."""
    letters = language.LETTERS
    words, grams, totals = {}, {}, Counter()
    for i, text, lang in made:
        if lang is None or text is None or is_held_out(i):
            continue
        for word in letters.findall(text.lower()):
            words.setdefault(word, Counter())[lang] += 1
            totals[lang, 0] += 1
            padded = f"<{word}>"
            for n in range(1, settings.longest + 1):
                for k in range(len(padded) - n + 1):
                    grams.setdefault(padded[k : k + n], Counter())[lang] += 1
                    totals[lang, n] += 1
    langs = sorted({lang for lang, _ in totals})
    size, alpha = len(words) + len(grams), settings.smoothing

    def share(by_lang, n, lang):
        return np.log((by_lang[lang] + alpha) / (totals[lang, n] + alpha * size))

    def score(word, lang):
        if word in words:
            return share(words[word], 0, lang)
        padded, total = f"<{word}>", 0.0
        for end in range(2, len(padded) + 1):
            for n in range(min(settings.longest, end), 0, -1):
                gram = padded[end - n : end]
                if gram in grams:
                    total += share(grams[gram], n, lang) + (settings.longest - n) * np.log(settings.penalty)
                    break
        return total / len(word)

    out = []
    for _, text, _ in made:
        found = letters.findall((text or "").lower())
        if not found:
            out.append(("und", 0.0))
            continue
        sums = np.array([sum(score(word, lang) for word in found) for lang in langs])
        out.append((langs[int(np.argmax(sums))], 1 / np.exp(sums - sums.max()).sum()))
    return out


def is_held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


@pytest.mark.parametrize("head", [0, 7, 100_000])
def test_language_keeps_every_word(spark, head):
    rng = random.Random(3)
    stems = {"en": "aeiou", "de": "äöüei", "fr": "éèaou"}

    def word(k):
        return "".join(rng.choice("bdklmn") + rng.choice(stems[k]) for _ in range(rng.randint(1, 3)))

    made = []
    for i in range(80):
        k = rng.choice(list(stems))
        made.append((i, " ".join(word(k) + rng.choice(["", "", "-x", ",", " 7"]) for _ in range(rng.randint(1, 12))), k))
    made += [(80, None, "en"), (81, "12", "de"), (82, "lonely", None), (83, "straße", "de"), (83, "straße", "de"), (None, "bada", "en")]
    table = spark.createDataFrame(made, "doc_id long, text string, lang string").repartition(5)
    settings = language.Settings(head=head)
    got = Counter((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in language.split_and_identify(table, settings=settings).collect())
    want = plain_languages(made, settings)
    assert got == Counter((i, is_held_out(i), k, round(float(s), 9)) for (i, _, _), (k, s) in zip(made, want, strict=True))


def test_words_beyond_the_head_are_known_exactly(spark):
    """With a sieve that lets everything through, the table alone decides what is known."""
    made = [(i, " ".join(f"wort{chr(97 + (i * j) % 26)}{chr(97 + j)}" for j in range(9)), "ab"[i % 2]) for i in range(60)]
    table = spark.createDataFrame(made, "doc_id long, text string, lang string")
    settings = language.Settings(head=5)
    learned = language.train(table.where(~language.is_held_out("doc_id")), settings)
    got = {}
    for full in (False, True):
        with pytest.MonkeyPatch.context() as patch:
            if full:
                patch.setattr(language, "make_sieve", lambda *_: np.full(1 << 18, (1 << 64) - 1, dtype=np.uint64))
            got[full] = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in language.identify(table, learned).collect()}
    assert got[False] == got[True]
    want = plain_languages(made, settings)
    assert got[True] == {i: (k, round(float(s), 9)) for (i, _, _), (k, s) in zip(made, want, strict=True)}
    assert learned.rare.count() + 5 == len({w for i, t, _ in made if not is_held_out(i) for w in t.split()})


def test_sieve_hash_is_the_one_of_expressions(spark):
    words = ["", "a", "straße", "日本語", "x" * 100]
    got = [r.h for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w").alias("h")).collect()]
    assert [h % (1 << 64) for h in got] == [xxhash.xxh64_intdigest(w.encode(), language.HASH_SEED) for w in words]


def test_chat(spark):
    costs = chat.Costs()

    def brute(given):
        best = {chat.START: 0}
        for g in given:
            ahead = {}
            for state, cost in best.items():
                for c in chat.choices(state, g, costs):
                    ahead[c.state] = min(ahead.get(c.state, 10**9), cost + c.cost)
            best = ahead
        return min(cost + chat.end_cost(state, costs) for state, cost in best.items())

    rng = random.Random(4)
    names = ["system", "User ", "assistant", None, "tool"]
    code = {"system": 1, "User ": 2, "assistant": 3}
    talks = {c: [rng.choice(names) for _ in range(rng.randrange(1, 30))] for c in range(60)}
    data = [(c, t, r, rng.choice([None, "", "hi", "x" * 999]), "k") for c, roles in talks.items() for t, r in enumerate(roles)]
    data += [(None, None, None, None, None), (None, 1, "user", "q", "k")]
    table = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, chunk string")
    whole, parts = chat.format_chats(table).collect(), chat.format_chats(table, chunk=4).collect()
    for c, roles in talks.items():
        own = [r for r in whole if r.conv_id == c]
        assert len(own) == 1 and own[0].cost == brute([code.get(r, 0) for r in roles])
        shown = re.findall(r"<\|(system|user|assistant)\|>", own[0].rendered)
        rest = shown[1:] if shown[0] == "system" else shown
        assert rest == ["user", "assistant"] * (len(rest) // 2) and len(shown) == own[0].n_turns_out
        cut = sorted((r for r in parts if r.conv_id == c), key=lambda r: r.part)
        # of repairs of equal cost another one may be taken, but a legal one of the same cost
        shown = re.findall(r"<\|(system|user|assistant)\|>", "".join(r.rendered for r in cut))
        rest = shown[1:] if shown[0] == "system" else shown
        assert rest == ["user", "assistant"] * (len(rest) // 2) and {r.cost for r in cut} == {own[0].cost}
    assert chat.format_chats(table.limit(0)).count() == 0


def test_pipeline(spark, docs, rows, none, tmp_path):
    import corpus_pipeline

    for name, source in (("full", docs), ("none", none)):
        folder = f"{tmp_path}/{name}"
        source.write.parquet(f"{folder}/documents.parquet")
        current = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            current = stage(spark, current, folder)
            assert current.columns == source.columns
        assert corpus_pipeline.run(spark, folder).count() == current.count()
