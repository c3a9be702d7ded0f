"""Licence scans, the conversation trie and hard negatives against brute force on odd fixtures."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from utterset.llm import convtrie, licences, rtree
from utterset.llm.queries import PHRASES
from utterset.session import Scratch

WORD = re.compile(licences.WORD)


def low(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_phrases(text):
    w = low(text)
    return [(t.label, i) for t in PHRASES for i in range(len(w)) if w[i : i + len(low(t.text))] == low(t.text)]


MIT = next(t.text for t in licences.NOTICES if len(t.text) > 200 and t.label == "mit")
GPL3 = next(t.text for t in licences.NOTICES if t.label == "gpl-3" and len(t.text) > 200)
LICENCE_TEXTS = [
    None, "", "  \n", "under", "UNDER the MIT-license, under the mit license!", "cc by nc cc by nc by nc",
    "word " * 50 + MIT + " tail " * 9, MIT.replace("free of charge", "free of any charge at all"),
    MIT.replace("without limitation ", ""), " ".join(MIT.split()[:20]), GPL3, GPL3.replace("version 3", "version 2"),
    GPL3 + "\n" + "x y z " * 5 + MIT + "\n" + GPL3, "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-SA 4.0, not CC BY",
    "the the the software and associated the software " * 60, ("Apache License, Version 2.0 " * 3000), "é É under the mit license é",
    "Under the MIT Licenſe", MIT.upper(),
]


@pytest.fixture(scope="module")
def licensed(spark):
    rows = [(i, t, 1, "p") for i, t in enumerate(LICENCE_TEXTS)]
    rows += [(None, MIT, 2, "p"), (6, LICENCE_TEXTS[6], 1, "p"), (6, LICENCE_TEXTS[6], 1, "p")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, place int, label string").repartition(4)


def test_licences(licensed):
    rows, docs = licensed
    got = licences.scan(docs, PHRASES).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for doc_id, text, *_ in rows:
        r, places = by_id[doc_id], brute_phrases(text)
        starts = [p for _, p in places]
        assert (r["n_words"], r["n_base"]) == (len(low(text)), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(starts), max(starts)) if starts else (None, None))
        assert r["base_labels"] == ",".join(sorted({label for label, _ in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    labels = {i: by_id[i]["labels"] for i in range(len(LICENCE_TEXTS))}
    assert [labels[i] for i in (0, 1, 2, 3, 15)] == [""] * 5
    assert [labels[i] for i in (4, 6, 7, 8, 19)] == ["mit"] * 5 and labels[9] == ""
    assert (labels[10], labels[11], labels[12]) == ("gpl-3", "gpl-2", "gpl-3,mit")
    assert (labels[13], labels[14], labels[16]) == ("cc-by-nc", "cc-by-sa", "apache-2")
    assert by_id[6]["score"] == by_id[10]["score"] == 1 and 0.8 <= by_id[7]["score"] < 1
    assert [r["labels"] for r in got if r["doc_id"] == 6] == ["mit"] * 3 and by_id[None]["labels"] == "mit"


def test_licence_spans_lie_where_planted(spark, licensed):
    _, docs = licensed
    templates = licences.template_table(spark, PHRASES, licences.NOTICES)
    longest = max(len(low(t.text)) for t in licences.NOTICES)
    found = Scratch(spark, "test").keep(licences.hits(docs, templates), "hits")
    spans = licences.notice_spans(licences.diagonals(found), templates, longest).collect()
    keys = {r["doc_id"]: (r["t1"], r["t2"]) for r in found.where("place = -1").collect()}
    n, g = len(low(MIT)), len(low(GPL3))
    here = sorted((s["first"], s["last"], s["label"]) for s in spans if (s["t1"], s["t2"]) == keys[12])
    assert here == [(0, g - 1, "gpl-3"), (g + 15, g + 14 + n, "mit"), (g + 15 + n, 2 * g + 14 + n, "gpl-3")]
    assert [(s["first"], s["last"]) for s in spans if (s["t1"], s["t2"]) == keys[6]] == [(50, 49 + n)]


def test_licences_without_a_broadcast(licensed, monkeypatch):
    _, docs = licensed
    want = sorted(map(str, licences.scan(docs, PHRASES).collect()))
    monkeypatch.setattr(licences, "BROADCAST_POSITIONS", 0)
    assert sorted(map(str, licences.scan(docs, PHRASES).collect())) == want


def test_licences_of_nothing(spark, licensed):
    _, docs = licensed
    assert licences.scan(docs.limit(0), PHRASES).count() == 0
    assert {r["labels"] for r in licences.scan(docs, [], []).collect()} == {""}
    with pytest.raises(ValueError, match="fewer than 3 words"):
        licences.scan(docs, [licences.Template("short", "two words")])


def brute_trie(rows, every=100, heads=6):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    nodes, ends = defaultdict(list), defaultdict(list)
    for c, own in sorted(turns.items()):
        h = zlib.crc32(str(c).encode()) % heads
        seq = tuple(turns.get(c - int(np.fmod(c, every)), [])[:h] + own[h:]) if every else tuple(own)
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append(c)
        ends[seq].append(c)
    children = defaultdict(list)
    for p in nodes:
        if p:
            children[p[:-1]].append(p)

    def total(p):
        own = (len(nodes[p]) - 1) * len(p[-1][1]) if p else 0
        below = [total(q) for q in children[p]]
        return (sum(b[0] for b in below) or 1, own + sum(b[1] for b in below))

    return sorted(
        (
            min(m), len(p), -1 if not p else min(nodes[p[:-1]]), len(m), len(children[p]), *total(p),
            hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest(),
        )
        for p, m in nodes.items()
    )


TRIE = "conv_id long, turn long, role string, text string, depth int, node string"


def trie_rows(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if r[n] is None else r[n] for n in names) for r in df.collect())


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["hé", "ya", "no"])) for c in range(0, 260, 3) for t in range(rng.randrange(1, 7))]
    rows += [(1000 + c, t, "user", f"copy {t}") for c in range(40) for t in range(5)]  # near and exact copies
    rows += [(7, t, "user", "x" * (t % 3)) for t in range(333)]  # long
    rows += [(300, t, "a", "b") for t in [None, None, 5, 5, 5, 2]] + [(300, None, None, None), (301, 1, None, None), (301, 1, None, "")]
    rows += [(None, 0, "a", "no conversation"), (-105, 0, "a", "b"), (-100, 3, "a", "c"), (555, 0, "only", "one")]
    return rows


@pytest.mark.parametrize("per_range", [100_000, 25])
def test_trie(spark, talks, monkeypatch, per_range):
    monkeypatch.setattr(convtrie, "ROWS_PER_RANGE", per_range)
    df = spark.createDataFrame([(*r, 1, "n") for r in talks], TRIE).repartition(5)
    assert trie_rows(convtrie.shared_prefix_trie(df)) == brute_trie(talks)
    assert trie_rows(convtrie.conversation_trie(df)) == brute_trie(talks, every=0, heads=1)


def test_trie_of_little(spark):
    none = spark.createDataFrame([], TRIE)
    assert convtrie.shared_prefix_trie(none).count() == 0
    assert convtrie.shared_prefix_trie(spark.createDataFrame([(None, 0, "a", "b", 1, "n")], TRIE)).count() == 0
    turnless = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6)
    rows = [(turnless, 0, "a", "b"), (turnless, 0, "a", "b")][:1]
    got = trie_rows(convtrie.shared_prefix_trie(spark.createDataFrame([(*r, 1, "n") for r in rows], TRIE)))
    assert got == brute_trie(rows) and got[0][1:6] == (0, -1, 1, 0, 1)


def brute_negatives(rows, positives=5, negatives=10):
    one = {}
    for vec_id, v, label in rows:
        if vec_id is None or label is None or not v or any(c is None or not np.isfinite(c) for c in v):
            continue
        x = [int(np.floor(256 * c)) for c in v]
        one[vec_id] = min(one.get(vec_id, (str(label), x)), (str(label), x))
    score = lambda a, b: sum(p * q for p, q in zip(one[a][1], one[b][1], strict=True))
    out = []
    for a in one:
        if a % 10:
            continue
        other = [b for b in one if b != a and len(one[b][1]) == len(one[a][1])]
        near = sorted((-score(a, b), b) for b in other if one[b][0] == one[a][0])[:positives]
        for minus, p in near:
            far = sorted((-score(a, b), b) for b in other if one[b][0] != one[a][0])
            fits = [(-s, b) for s, b in far if 30 * -minus <= 100 * -s <= 90 * -minus][:negatives]
            out += [(a, p, i, b, -minus, s) for i, (s, b) in enumerate(fits, 1)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int, page int, n string"


@pytest.mark.parametrize("page", [8192, 70])
def test_hard_negatives(spark, monkeypatch, page):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=12).round(2).astype(float).tolist(), int(i % 4)) for i in range(400)]
    rows += [(500 + i, rows[0][1], i % 2) for i in range(150)]  # one vector many times
    rows += [(700 + i, rng.normal(size=3).tolist(), i % 2) for i in range(40)]  # fewer components
    rows += [(800, None, 1), (810, rows[1][1], None), (None, rows[1][1], 1), (820, [], 1), (830, [None] * 12, 1)]
    rows += [(840, [float("nan")] * 12, 1), (850, [float("inf")] + [0.0] * 11, 1), (860, [0.0] * 12, 2), rows[5], (20, rows[6][1], 3)]
    monkeypatch.setattr(rtree.pack, "__defaults__", (page,))
    monkeypatch.setattr(rtree, "LEAF", 8 if page == 70 else 64)
    monkeypatch.setattr(rtree, "PART", 16 if page == 70 else 2048)
    monkeypatch.setattr(rtree, "BOXES", 3 if page == 70 else 1024)
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], VECTORS).repartition(3)
    got = rtree.hard_negatives(df, F.col("vec_id") % 10 == 0).collect()
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r[n] for n in names) for r in got) == brute_negatives(rows)


def test_hard_negatives_of_nothing(spark):
    assert rtree.hard_negatives(spark.createDataFrame([], VECTORS), F.col("vec_id") % 10 == 0).count() == 0
    alone = spark.createDataFrame([(0, [1.0, 2.0], 1, 1, "n")], VECTORS)
    assert rtree.hard_negatives(alone, F.col("vec_id") % 10 == 0).count() == 0


def test_boxes_hold_their_products():
    rng = np.random.default_rng(1)
    x, q = (rng.integers(-99, 99, size=(n, 7)).astype(float) for n in (50, 9))
    least, greatest = rtree._intervals(q, x.min(axis=0)[None], x.max(axis=0)[None])
    products = q @ x.T
    assert (least[:, 0] <= products.min(axis=1)).all() and (products.max(axis=1) <= greatest[:, 0]).all()
