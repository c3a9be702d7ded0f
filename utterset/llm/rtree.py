"""Hard negatives by an R-tree packed with sort-tile-recursive.

1. Rows of one label are cut into slabs of equal count along their widest
   coordinate, slabs along the next, and so on (STR), until a tile is a page.  Tiles
   that cannot be cut, as one vector a thousand times, are split by a hash of the id.
2. A page's minimum bounding box gives, coordinate by coordinate, an interval that
   holds the inner product of a query with any of its rows.  Whole numbers make the
   intervals exact.
3. A query carries score windows.  Boxes outside all its windows, or strictly below
   the k-th best that each window has, are pruned; strictly, because ties go to the
   smaller id.
4. Pages are the upper level of the tree.  Each query first visits the page of
   greatest bound, which gives its windows a floor, then every page that is left.
   In a page, leaves of ``LEAF`` rows are packed the same way and taken from a
   queue, greatest bound first, while floors rise.
5. Positives are the best rows of the anchor's label; each positive then makes one
   window for the negatives.  Both searches share the tree.

Queries and pages meet in cells of at most about ``PART`` queries and ``PAGE`` rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utterset.llm.streams import by_group
from utterset.llm.topk import EXACT, _matrix, _scores
from utterset.session import Scratch

PAGE = 8192
LEAF = 64
PART = 2048
BOXES = 1024  # boxes that meet a part of the queries in one cell
SLABS = 64  # most slabs of one cut
CUTS = 4  # so a label's tree has up to SLABS ** CUTS tiles
TAKEN = 8  # leaves taken from the queue at once
PAGE_KEY = ["label", "tile", "sub"]
PART_KEY = ["dims", "own_label", "part"]
NEVER = float("inf")


def integer_rows(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256
) -> DataFrame:
    """(vec_id, label, dims, x): floor(scale * component) of rows that have an id, a label and finite components.

    Repeated rows of one id are one row, the first by label and components.
    """
    raw = rows.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"),
        F.col(vector).cast("array<double>").alias("v"),
    ).where("vec_id is not null and label is not null and size(v) > 0")
    fit = raw.where(~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    ints = fit.select("vec_id", "label", F.transform("v", lambda c: F.floor(F.lit(float(scale)) * c).cast("double")).alias("x"))
    one = ints.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r"))
    return one.select("vec_id", "r.label", F.size("r.x").alias("dims"), "r.x")


def _spreads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, list] = {}
    for batch in batches:
        dims = batch.column("dims").to_numpy()
        for d in np.unique(dims).tolist():
            x = _matrix(batch.column("x").filter(pa.array(dims == d)))
            n, one, two = sums.get(d, (0, 0, 0))
            sums[d] = [n + len(x), one + x.sum(axis=0), two + np.square(x).sum(axis=0)]
    for d, (n, one, two) in sums.items():
        columns = [np.full(d, d), np.arange(d), np.full(d, float(n)), one, two]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["dims", "axis", "n", "one", "two"])


def widest_axes(rows: DataFrame, axes: int = CUTS) -> DataFrame:
    """(dims, axes): the coordinates of greatest variance, for each number of components."""
    parts = rows.select("dims", "x").mapInArrow(_spreads, "dims long, axis long, n double, one double, two double")
    total = parts.groupBy("dims", "axis").agg(F.sum("n").alias("n"), F.sum("one").alias("one"), F.sum("two").alias("two"))
    spread = F.col("two") / F.col("n") - F.pow(F.col("one") / F.col("n"), 2)
    order = Window.partitionBy("dims").orderBy(F.desc("spread"), "axis")
    ranked = total.withColumn("spread", spread).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= axes)
    listed = ranked.groupBy("dims").agg(F.sort_array(F.collect_list(F.struct("rank", "axis"))).alias("r"))
    return listed.select(F.col("dims").cast("int").alias("dims"), F.col("r.axis").cast("array<int>").alias("axes"))


def pack(rows: DataFrame, scratch: Scratch, page: int = PAGE) -> tuple[DataFrame, DataFrame]:
    """Rows with their page (label, tile, sub), and the pages' boxes (dims, page, n, lo, hi)."""
    rows = scratch.keep(rows.join(widest_axes(rows), "dims").withColumn("tile", F.lit(0).cast("long")), "rows")
    steps = [i / SLABS for i in range(1, SLABS)]
    for cut in range(CUTS):
        at = F.get("x", F.coalesce(F.get("axes", F.lit(cut)), F.lit(-1)))
        tiles = scratch.keep(
            rows.groupBy("dims", "label", "tile").agg(
                F.count(F.lit(1)).alias("n"), F.percentile_approx(at, steps, 1000).alias("bounds")
            ),
            "tiles",
        )
        if (tiles.agg(F.max("n")).first()[0] or 0) <= page:
            break
        pages = F.ceil(F.col("n") / page)
        slabs = F.least(F.lit(SLABS), F.ceil(F.pow(pages, 1 / max(1, 2 - cut)))).cast("int")
        cuts = tiles.select(
            "dims", "label", "tile",
            F.when(
                (slabs > 1) & F.col("bounds").isNotNull(),
                F.transform(
                    F.sequence(F.lit(1), F.greatest(slabs - 1, F.lit(1))),
                    lambda i: F.get("bounds", F.floor(i * SLABS / slabs).cast("int") - 1),
                ),
            ).alias("cuts"),
        )
        slab = F.coalesce(F.size(F.filter("cuts", lambda b: b < at)), F.lit(0))
        slab = F.greatest(slab, F.lit(0))  # no cuts at all
        cells = rows.join(cuts, ["dims", "label", "tile"]).withColumn("tile", F.col("tile") * SLABS + slab)
        tiled = scratch.keep(cells.select(rows.columns), "tiled")
        scratch.drop(rows)
        rows = tiled
    sizes = rows.groupBy("dims", "label", "tile").agg(F.ceil(F.count(F.lit(1)) / page).cast("int").alias("subs"))
    split = rows.join(sizes, ["dims", "label", "tile"]).select(
        "vec_id", "dims", "label", "tile", F.pmod(F.xxhash64("vec_id"), F.col("subs")).cast("int").alias("sub"), "x"
    )
    paged = scratch.keep(split, "paged")
    scratch.drop(rows)
    boxes = by_group(
        paged, ["dims", *PAGE_KEY], _boxes,
        "dims int, label string, tile long, sub int, lo array<double>, hi array<double>",
    )
    return paged, scratch.keep(boxes, "boxes")


def _lists(x: np.ndarray) -> pa.Array:
    size = x.shape[1] if x.ndim == 2 else 0
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * size, pa.array(x.reshape(-1)))


def _boxes(table: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
    found: list[pa.RecordBatch] = []
    x = table.column("x").combine_chunks()
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        rows = _matrix(x.slice(a, b - a))
        keys = [table.column(c).slice(a, 1).combine_chunks() for c in ("dims", *PAGE_KEY)]
        keys = [k.combine_chunks() if isinstance(k, pa.ChunkedArray) else k for k in keys]
        sides = [_lists(rows.min(axis=0)[None]), _lists(rows.max(axis=0)[None])]
        found.append(pa.RecordBatch.from_arrays([*keys, *sides], names=["dims", *PAGE_KEY, "lo", "hi"]))
    return pa.Table.from_batches(found).combine_chunks().to_batches()[0]


def _intervals(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each query with any vector of each box."""
    if np.abs(q).sum(axis=1).max() * max(np.abs(lo).max(), np.abs(hi).max()) >= EXACT:
        shape = (len(q), len(lo))
        return np.full(shape, -np.inf), np.full(shape, np.inf)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    return up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T


def _windows(table: pa.Table, at: np.ndarray) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Slots and (query, slot) matrices of lows, highs and floors; missing slots admit nothing."""
    picked = table.select(["slots", "lows", "highs", "floors"]).take(pa.array(at))
    slots = picked.column("slots").to_pylist()
    width = max([1, *map(len, slots)])
    sides = []
    for name in ("lows", "highs", "floors"):
        side = np.full((len(at), width), NEVER)
        for i, values in enumerate(picked.column(name).to_pylist()):
            side[i, : len(values)] = values
        sides.append(side)
    return slots, *sides


def _wanted(least, greatest, lows, highs, floors) -> np.ndarray:
    """(query, box): whether some window meets the box's interval above its floor."""
    wanted = np.zeros(least.shape, dtype=bool)
    for s in range(lows.shape[1]):
        low = np.maximum(lows[:, s], floors[:, s])
        wanted |= (greatest >= low[:, None]) & (least <= highs[:, s][:, None])
    return wanted


def _route(seeds: bool):
    """Pages that a part of the queries has to visit; or the page of greatest bound of each query."""

    def work(table: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
        is_query = table.column("query").to_numpy()
        ids = table.column("vec_id").to_numpy()
        found: list[tuple[int, int, float]] = []  # row of the query or -1, row of the box, bound
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            asks, has = a + np.flatnonzero(is_query[a:b]), a + np.flatnonzero(~is_query[a:b])
            if not len(asks) or not len(has):
                continue
            q = _matrix(table.column("x").take(pa.array(asks)))
            lo, hi = (_matrix(table.column(c).take(pa.array(has))) for c in ("lo", "hi"))
            least, greatest = _intervals(q, lo, hi)
            _, lows, highs, floors = _windows(table, asks)
            open_ = _wanted(least, greatest, lows, highs, floors)
            if seeds:
                bound = np.where(open_, greatest, -np.inf)
                best = bound.argmax(axis=1)
                rows = np.flatnonzero(open_[np.arange(len(asks)), best])
                found += [(int(asks[i]), int(has[best[i]]), float(bound[i, best[i]])) for i in rows]
            else:
                found += [(int(asks[0]), int(has[j]), 0.0) for j in np.flatnonzero(open_.any(axis=0))]
        q_rows, boxes, bounds = (list(c) for c in zip(*found, strict=True)) if found else ([], [], [])
        part = table.select(["dims", "own_label", "part"]).take(pa.array(q_rows, pa.int64()))
        page = table.select(PAGE_KEY).take(pa.array(boxes, pa.int64()))
        columns = [*part.columns, *page.columns, pa.array(ids[q_rows], pa.int64()), pa.array(bounds, pa.float64())]
        names = [*PART_KEY, *PAGE_KEY, "vec_id", "bound"]
        table = pa.Table.from_arrays(columns, names=names).combine_chunks()
        return (table.to_batches() or [pa.RecordBatch.from_pylist([], schema=table.schema)])[0]

    return work


def _leaves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of a page's rows in leaves of ``LEAF`` rows, and the leaves' first places."""
    n = len(x)
    if n > LEAF:
        wide = np.argsort(-x.var(axis=0), kind="stable")[:2]
        slabs = max(1, int(np.ceil(np.sqrt(n / LEAF))))
        slab = np.empty(n, dtype=np.int64)
        slab[np.argsort(x[:, wide[0]], kind="stable")] = np.arange(n) * slabs // n
        order = np.lexsort((x[:, wide[-1]], slab))
    else:
        order = np.arange(n)
    return order, np.arange(0, n, LEAF)


def _visit(k: int):
    """Best-first search of each query of a cell in its page; (query_id, slot, vec_id, score)."""

    def best(q, own, x, ids, starts, least, greatest, lows, highs, floors) -> list[list[tuple[int, int]]]:
        ends = np.append(starts[1:], len(x))
        kept: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, dtype=np.int64)) for _ in lows]
        queue = np.argsort(-greatest, kind="stable")
        for i in range(0, len(queue), TAKEN):
            taken = queue[i : i + TAKEN]
            low = np.maximum(lows, floors)
            if not (greatest[taken[0]] >= low).any():
                break  # all that follow are lower
            some = ((greatest[taken][:, None] >= low) & (least[taken][:, None] <= highs)).any(axis=1)
            taken = taken[some]
            if not len(taken):
                continue
            rows = np.concatenate([np.arange(starts[t], ends[t]) for t in taken])
            rows = rows[ids[rows] != own]
            scores = _scores(q[None], x[rows])[0]
            for s in range(len(lows)):
                fits = np.flatnonzero((scores >= low[s]) & (scores <= highs[s]))
                if not len(fits):
                    continue
                score = np.concatenate([kept[s][0], scores[fits]])
                who = np.concatenate([kept[s][1], ids[rows[fits]]])
                first = np.lexsort((who, -score))[:k]
                kept[s] = (score[first], who[first])
                if len(first) == k:
                    floors[s] = max(floors[s], score[first][-1])
        return [list(zip(score.tolist(), who.tolist(), strict=True)) for score, who in kept]

    def work(table: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
        is_query = table.column("query").to_numpy()
        all_ids = table.column("vec_id").to_numpy()
        found: list[tuple[int, int, int, int]] = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            asks, has = a + np.flatnonzero(is_query[a:b]), a + np.flatnonzero(~is_query[a:b])
            if not len(asks) or not len(has):
                continue
            q, x = (_matrix(table.column("x").take(pa.array(at))) for at in (asks, has))
            slots, lows, highs, floors = _windows(table, asks)
            order, starts = _leaves(x)
            x, ids = x[order], all_ids[has[order]]
            least, greatest = _intervals(q, np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts))
            for i in np.flatnonzero(_wanted(least, greatest, lows, highs, floors).any(axis=1)).tolist():
                n = len(slots[i])
                own = int(all_ids[asks[i]])
                kept = best(q[i], own, x, ids, starts, least[i], greatest[i], lows[i, :n], highs[i, :n], floors[i, :n].copy())
                found += [(own, slot, who, int(score)) for slot, rows in zip(slots[i], kept, strict=True) for score, who in rows]
        columns = list(zip(*found, strict=True)) if found else [()] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], names=["query_id", "slot", "vec_id", "score"]
        )

    return work


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(
    paged: DataFrame, boxes: DataFrame, queries: DataFrame, k: int, same_label: bool, scratch: Scratch
) -> DataFrame:
    """(query_id, slot, rank, vec_id, score): the k best rows in each window of each query.

    ``queries`` has (vec_id, dims, own_label, part, x, slots, lows, highs): windows
    are closed, and a slot is the caller's name for a window.  Candidates are rows
    of the query's label, or of all others; never the query itself.
    """
    allowed = F.col("label") == F.col("own_label") if same_label else F.col("label") != F.col("own_label")
    counted = boxes.groupBy("dims").agg(F.ceil(F.count(F.lit(1)) / BOXES).cast("int").alias("blocks"))
    blocks = boxes.join(counted, "dims").withColumn("block", F.pmod(F.xxhash64(*PAGE_KEY), F.col("blocks")).cast("int"))
    parts = queries.select(PART_KEY).distinct()
    # parts of the queries against blocks of boxes; never rows against rows
    pairs = parts.join(counted, "dims").select(*PART_KEY, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    ask = ["vec_id", "x", "slots", "lows", "highs", "floors"]
    empty = {"slots": "array<long>", "lows": "array<double>", "highs": "array<double>", "floors": "array<double>"}
    none = [F.lit(None).cast(kind).alias(name) for name, kind in empty.items()]

    def routed(asking: DataFrame, seeds: bool) -> DataFrame:
        key = [*PART_KEY, "block"]
        page = [F.lit(None).cast(t).alias(c) for c, t in zip((*PAGE_KEY, "lo", "hi"), ("string", "long", "int", "array<double>", "array<double>"))]
        left = asking.join(pairs, PART_KEY).select(*key, F.lit(True).alias("query"), *ask, *page)
        right = pairs.join(blocks, ["dims", "block"]).where(allowed).select(
            *key, F.lit(False).alias("query"), F.lit(None).cast("long").alias("vec_id"),
            F.lit(None).cast("array<double>").alias("x"), *none, *PAGE_KEY, "lo", "hi",
        )
        return by_group(
            left.unionByName(right), key, _route(seeds),
            "dims int, own_label string, part int, label string, tile long, sub int, vec_id long, bound double",
        )

    def visited(asking: DataFrame, visits: DataFrame) -> DataFrame:
        """``asking`` has the page that each query visits; ``visits`` the pages of each part."""
        key = [*PART_KEY, *PAGE_KEY]
        left = asking.select(*key, F.lit(True).alias("query"), *ask)
        right = paged.join(visits, ["dims", *PAGE_KEY]).select(*key, F.lit(False).alias("query"), "vec_id", "x", *none)
        return by_group(
            left.unionByName(right), key, _visit(k), "query_id long, slot long, vec_id long, score long"
        )

    open_ = queries.withColumn("floors", F.transform("slots", lambda s: F.lit(float("-inf"))))
    first = routed(open_, True).groupBy("vec_id").agg(F.max(F.struct("bound", *PAGE_KEY)).alias("p"))
    first = scratch.keep(first.select("vec_id", *[F.col(f"p.{c}").alias(c) for c in PAGE_KEY]), "first-pages")
    seeding = open_.join(first, "vec_id")
    seeded = _ranked(visited(seeding, seeding.select(*PART_KEY, *PAGE_KEY).distinct()), k)
    kth = seeded.where(F.col("rank") == k).groupBy(F.col("query_id").alias("vec_id")).agg(
        F.map_from_entries(F.collect_list(F.struct("slot", F.col("score").cast("double")))).alias("kth")
    )
    kth = scratch.keep(kth, "floors")
    lowest = F.lit(float("-inf"))
    floored = queries.join(kth, "vec_id", "left").withColumn(
        "floors",
        F.when(F.col("kth").isNull(), F.transform("slots", lambda s: lowest)).otherwise(
            F.transform("slots", lambda s: F.coalesce(F.try_element_at("kth", s), lowest))
        ),
    ).drop("kth")
    floored = scratch.keep(floored, "floored")
    visits = scratch.keep(routed(floored, False).select(*PART_KEY, *PAGE_KEY), "visits")
    asking = floored.join(visits, PART_KEY)
    return _ranked(visited(asking, visits), k).select("query_id", "slot", "rank", "vec_id", "score")


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    least: int = 30,
    most: int = 90,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Scores are inner products of floor(scale * component).  An anchor's positives
    are its best other rows of the same label; a positive's negatives are the best
    rows of other labels that score from ``least`` to ``most`` percent of it (none
    for a positive below zero).  Ties go to the smaller id.  ``is_anchor`` is a
    condition on the column ``vec_id``.

    Rows with a null id, label or vector, an empty vector, or a null or non-finite
    component take no part; repeated rows of one id are one row (see
    ``integer_rows``); vectors meet only vectors of as many components.
    """
    scratch = Scratch(rows.sparkSession, "rtree")
    paged, boxes = pack(integer_rows(rows, vec_id, vector, label, scale), scratch)
    anchors = paged.where(is_anchor).select("vec_id", "dims", F.col("label").alias("own_label"), "x")
    counted = anchors.groupBy("dims", "own_label").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    anchors = anchors.join(counted, ["dims", "own_label"]).withColumn(
        "part", F.pmod(F.xxhash64(F.lit("part"), "vec_id"), F.col("parts")).cast("int")
    )
    anchors = scratch.keep(anchors.drop("parts"), "anchors")
    anywhere = [F.array(F.lit(v)).alias(n) for n, v in (("lows", float("-inf")), ("highs", float("inf")))]
    asking = anchors.select("*", F.array(F.lit(0).cast("long")).alias("slots"), *anywhere)
    near = scratch.keep(search(paged, boxes, asking, positives, True, scratch), "positives")
    tens = near.where("score >= 0").select(
        "query_id", F.col("vec_id").alias("slot"),
        # whole numbers from least to most percent of the score
        F.ceil(F.col("score") * least / F.lit(100).cast("decimal(3,0)")).cast("double").alias("low"),
        F.floor(F.col("score") * most / F.lit(100).cast("decimal(3,0)")).cast("double").alias("high"),
    )
    sides = tens.groupBy(F.col("query_id").alias("vec_id")).agg(
        F.sort_array(F.collect_list(F.struct("slot", "low", "high"))).alias("w")
    )
    windows = anchors.join(sides, "vec_id").select(
        *anchors.columns, F.col("w.slot").alias("slots"), F.col("w.low").alias("lows"), F.col("w.high").alias("highs")
    )
    windows = scratch.keep(windows, "windows")
    far = search(paged, boxes, windows, negatives, False, scratch)
    named = near.select("query_id", F.col("vec_id").alias("slot"), F.col("score").alias("positive_score"))
    return far.join(named, ["query_id", "slot"]).select(
        F.col("query_id").alias("anchor_id"), F.col("slot").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )
