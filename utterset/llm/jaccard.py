"""N-gram Jaccard self-join through a MinHash LSH forest with exact verification.

The similarity of two texts is the Jaccard coefficient of their sets of word
shingles (``width`` words; a text of fewer words is one shingle).

1. Equal texts form one class, told by their digest; everything after that is
   done once per class.
2. Each class gets ``trees`` x ``depth`` minima of its hashed shingle set.  A
   tree of the forest is a trie over the sequences of ``depth`` minima; it is
   held as sorted prefix keys.  Classes that share a whole sequence are matched
   first; the matched prefix is then shortened level by level for as long as the
   recall of the forest, for pairs exactly at the threshold, is below
   ``recall``.  At a long prefix a class whose minima nearly all equal those of
   the node's least class is linked with it and leaves the tree to it: work that
   is linear in the node's size.
3. At the shortest prefix all pairs of a node are compared by their minima; those
   that reach ``threshold - margin`` are linked.  A node of more than
   ``node_rows`` classes is cut into blocks and its pairs of blocks go to
   different tasks, so no class is left out and no pair table is made.
4. Connected classes are candidates of each other.  Each such group is verified
   exactly, block against block, on whole shingle sets: a task gives the number
   of links of each class and just enough links to span them.
5. The verified links give the final groups.

All rows of the input come back with ``class_id`` (least document id of the
group), ``copies`` (rows with the very same text, itself included) and
``n_links`` (rows of other texts at or above the threshold).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utterset.llm.links import connected
from utterset.llm.streams import by_group
from utterset.llm.wordhash import mix, row_shingles, words_of
from utterset.session import cut_lineage


@dataclass(frozen=True)
class Forest:
    """Parameters of the join.

    ``margin`` is over four standard errors of the estimate; ``alike`` is the
    share of equal minima at which a class leaves a tree to another one.
    """

    width: int = 5
    threshold: float = 0.8
    trees: int = 16
    depth: int = 5
    recall: float = 0.9995
    margin: float = 0.2
    alike: float = 0.9
    node_rows: int = 1024
    block_shingles: int = 65_536

    def recall_at(self, prefix: int) -> float:
        """Chance that a pair at the threshold shares a prefix in some tree."""
        return 1 - (1 - self.threshold**prefix) ** self.trees

    def levels(self) -> list[int]:
        """Prefix lengths from the whole sequence down to the one that reaches the recall."""
        out = [self.depth]
        while self.recall_at(out[-1]) < self.recall and out[-1] > 1:
            out.append(out[-1] - 1)
        return out


def text_key(text: Column | str) -> Column:
    """16-byte digest that stands for a text; null stays null."""
    return F.unhex(F.md5(text))


def _signatures(forest: Forest):
    size = forest.trees * forest.depth
    factors = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            minima = np.zeros((rows, size), dtype=np.uint64)
            count = np.zeros(rows, dtype=np.int64)
            for words in words_of(batch.column("text")):
                hashes, cuts = row_shingles(words, forest.width)
                per_row = np.diff(cuts)
                count[words.first : words.first + len(per_row)] = per_row
                full = np.flatnonzero(per_row)
                for lo in range(0, len(full), 64):  # a few rows at a time stay in the cache
                    part = full[lo : lo + 64]
                    begin = cuts[part[0]]
                    own = hashes[begin : cuts[part[-1] + 1]]
                    for j in range(size):
                        turned = own * factors[j]
                        turned ^= turned >> np.uint64(31)
                        minima[words.first + part, j] = np.minimum.reduceat(turned, cuts[part] - begin)
            short = (mix(minima) >> np.uint64(48)).astype("<u2")
            out = pa.RecordBatch.from_arrays(
                [batch.column("node").cast(pa.binary()), pa.array(count), pa.array([r.tobytes() for r in short], pa.binary())],
                names=["node", "n_shingles", "minima"],
            )
            yield out.filter(pa.array(count > 0))

    return run


def signatures(docs: DataFrame, forest: Forest) -> DataFrame:
    """(node, n_shingles, minima) of each row of (node, text) that has a word; minima keep 16 bits each."""
    return docs.mapInArrow(_signatures(forest), "node binary, n_shingles long, minima binary")


def _spanning(close: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (from, to) of true cells of a symmetric matrix that connect what it connects."""
    out = []
    fresh = np.ones(len(close), dtype=bool)
    for start in range(len(close)):
        if not fresh[start]:
            continue
        fresh[start] = False
        queue = [start]
        while queue:
            node = queue.pop()
            found = np.flatnonzero(close[node] & fresh)
            fresh[found] = False
            out += [(node, other) for other in found.tolist()]
            queue += found.tolist()
    return out


def _own_cells(block: np.ndarray, one: int, two: int) -> np.ndarray:
    """Cells of the pair matrix that a task answers for: across its two blocks, or inside its one."""
    if one == two:
        return np.ones((len(block), len(block)), dtype=bool)
    return block[:, None] != block[None, :]


def _in_blocks(rows: DataFrame, n_blocks: Column) -> DataFrame:
    """Copy each row to every pair of blocks (one, two) of its group that holds its own block."""
    placed = rows.withColumn("n_blocks", n_blocks.cast("int")).withColumn(
        "block", F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("n_blocks")).cast("int")
    )
    met = placed.withColumn("met", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    return met.select(
        *rows.columns, "block", F.least("block", "met").alias("one"), F.greatest("block", "met").alias("two")
    )


def _match_nodes(forest: Forest):
    size = forest.trees * forest.depth
    least = (forest.threshold - forest.margin) * size

    def work(table: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
        nodes = table.column("node").to_pylist()
        minima = np.frombuffer(b"".join(table.column("minima").to_pylist()), dtype="<u2").reshape(-1, size)
        block, one, two = (table.column(c).to_numpy() for c in ("block", "one", "two"))
        left, right = [], []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a < 2:
                continue
            if b - a == 2:
                pairs = [(0, 1)] if (minima[a] == minima[a + 1]).sum() >= least and (one[a] == two[a] or block[a] != block[a + 1]) else []
            else:
                own = np.ascontiguousarray(minima[a:b].T)
                equal = np.zeros((b - a, b - a), dtype=np.uint16)
                for column in own:
                    equal += column[:, None] == column[None, :]
                pairs = _spanning((equal >= least) & _own_cells(block[a:b], one[a], two[a]))
            left += [nodes[a + i] for i, _ in pairs]
            right += [nodes[a + j] for _, j in pairs]
        return pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["node", "other"])

    return work


def _alike(forest: Forest):
    size = forest.trees * forest.depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine, head = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u2").reshape(-1, size)
                for c in ("minima", "head_minima")
            )
            same = (mine == head).mean(axis=1) >= forest.alike
            yield batch.select(["node", "other"]).filter(pa.array(same))

    return run


def candidate_links(sigs: DataFrame, forest: Forest) -> DataFrame:
    """Links (node, other), some repeated, of classes that may reach the threshold, from the long to the short prefixes."""
    *longer, shortest = forest.levels()
    step = 2 * forest.depth
    keys = {level: f"key{level}" for level in (*longer, shortest)}
    places = [
        F.struct(
            F.lit(tree).alias("tree"),
            *[F.xxhash64(F.substring("minima", tree * step + 1, 2 * level)).alias(key) for level, key in keys.items()],
        )
        for tree in range(forest.trees)
    ]
    standing = sigs.select("node", F.explode(F.array(*places)).alias("place")).select("node", "place.*")
    # what is alone at the shortest prefix is alone at every longer one
    meeting = ["tree", keys[shortest]]
    full = cut_lineage(standing.groupBy(meeting).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "nodes")
    standing = cut_lineage(standing.join(full, meeting), "places")
    minima = sigs.select("node", "minima")
    found = []
    for level in longer:
        at = ["tree", keys[level]]
        heads = standing.groupBy(at).agg(F.count("*").alias("n"), F.min("node").alias("other")).where("n > 1").drop("n")
        heads = cut_lineage(heads, "heads")
        led = standing.join(heads, at).where("node <> other").select("tree", "node", "other")
        led = cut_lineage(led, "led")
        pairs = led.select("node", "other").distinct().join(minima, "node").join(
            minima.select(F.col("node").alias("other"), F.col("minima").alias("head_minima")), "other"
        )
        links = cut_lineage(pairs.mapInArrow(_alike(forest), "node binary, other binary"), "alike")
        found.append(links)
        left = led.join(links, ["node", "other"]).select("tree", "node")
        standing = cut_lineage(standing.join(left, ["tree", "node"], "left_anti"), "places")
    sizes = cut_lineage(standing.groupBy(meeting).agg(F.count("*").alias("n")).where("n > 1"), "nodes")
    rows = standing.join(sizes, meeting).select("tree", F.col(keys[shortest]).alias("key"), "n", "node")
    cells = _in_blocks(rows.join(minima, "node"), F.ceil(F.col("n") / forest.node_rows)).drop("n")
    links = by_group(cells, ["tree", "key", "one", "two"], _match_nodes(forest), "node binary, other binary")
    for more in found:
        links = links.unionByName(more)
    return links


def _shingle_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: list[bytes] = []
            for words in words_of(batch.column("text")):
                hashes, cuts = row_shingles(words, width)
                sets += [np.unique(hashes[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            names = [name for name in batch.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(sets, pa.binary())], names=[*names, "shingles"]
            )

    return run


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, from the product of the incidence matrix with itself, in slices."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    owner, flat = owner[order], flat[order]
    first = np.ones(len(flat), dtype=bool)
    first[1:] = flat[1:] != flat[:-1]
    column = np.cumsum(first) - 1
    shared = np.bincount(column) > 1
    kept = shared[column]
    owner, column = owner[kept], (np.cumsum(shared) - 1)[column[kept]]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    last = int(shared.sum())
    width = max(1, 4_000_000 // len(sets))
    for lo in range(0, last, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        holds = np.zeros((len(sets), min(width, last - lo)), dtype=np.float32)
        holds[owner[a:b], column[a:b] - lo] = 1
        out += holds @ holds.T
    return out.astype(np.int64)


def _verify_cells(threshold: float):
    def work(table: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
        nodes = table.column("node").to_pylist()
        raw = table.column("shingles").to_pylist()
        block, one, two, copies = (table.column(c).to_numpy() for c in ("block", "one", "two", "copies"))
        out: list[list] = [[], [], [], []]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a < 2:
                continue
            sets = [np.frombuffer(r, dtype=np.uint64) for r in raw[a:b]]
            sizes = np.array([len(s) for s in sets])
            common = _common(sets)
            close = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9
            np.fill_diagonal(close, False)
            close &= _own_cells(block[a:b], one[a], two[a])
            texts = close.sum(axis=1)
            rows = close @ copies[a:b]
            partner = {j: i for i, j in _spanning(close)}
            for i in np.flatnonzero(texts).tolist():
                out[0].append(nodes[a + i])
                out[1].append(nodes[a + partner.get(i, i)])
                out[2].append(int(rows[i]))
                out[3].append(int(texts[i]))
        kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=["node", "other", "n_links", "n_linked_texts"]
        )

    return work


def verified(classes: DataFrame, texts: DataFrame, candidates: DataFrame, forest: Forest) -> DataFrame:
    """Exact links inside each connected group of candidates.

    Rows (node, other, n_links, n_linked_texts): what one task found for a class;
    ``other`` is a verified partner, or the class itself where its partner's row names it.
    """
    members = connected(candidates).join(classes.select("node", "copies", "n_shingles", "row"), "node")
    members = cut_lineage(members, "members")
    totals = members.groupBy("root").agg(F.sum("n_shingles").alias("total"))
    members = members.join(totals, "root").select(
        "node", "row", "root", "copies", F.ceil(F.col("total") / forest.block_shingles).cast("int").alias("blocks")
    )
    # equal rows of a class (same id and text) count once
    one_text = texts.join(members.hint("merge"), ["node", "row"]).dropDuplicates(["node", "row"])
    sets = one_text.select("node", "root", "copies", "blocks", "text").mapInArrow(
        _shingle_sets(forest.width), "node binary, root binary, copies long, blocks int, shingles binary"
    )
    cells = _in_blocks(sets, F.col("blocks")).drop("blocks")
    schema = "node binary, other binary, n_links long, n_linked_texts long"
    return cut_lineage(by_group(cells, ["root", "one", "two"], _verify_cells(forest.threshold), schema), "verified")


def _keyed(docs: DataFrame, doc_id: str, text: str, *more: Column) -> DataFrame:
    own = docs.select(*more, F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.withColumn("node", text_key("text"))


def text_classes(docs: DataFrame, doc_id: str, text: str, forest: Forest) -> DataFrame:
    """(node, copies, least, n_links, n_linked_texts, class_id, leads), one row per distinct text.

    ``least`` is the class's least document id; ``leads`` marks one class of each group.
    """
    rows = _keyed(docs, doc_id, text).where("node is not null")
    row = F.xxhash64("doc_id").alias("row")
    sigs = cut_lineage(signatures(rows.select("node", "text"), forest), "signatures")
    sigs = sigs.groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), F.first("minima").alias("minima"))
    sigs = cut_lineage(sigs, "classes")
    classes = rows.select("node", "doc_id", row).groupBy("node").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("least"), F.min("row").alias("row")
    )
    classes = cut_lineage(classes.join(sigs.select("node", "n_shingles"), "node", "left"), "counted")
    exact = verified(classes, rows.select("node", row, "text"), candidate_links(sigs, forest), forest)
    sums = exact.groupBy("node").agg(
        F.sum("n_links").alias("n_links"), F.sum("n_linked_texts").alias("n_linked_texts")
    )
    roots = connected(exact.select("node", "other"))
    full = classes.join(sums, "node", "left").join(roots, "node", "left").select(
        "node", "copies", "least", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("n_linked_texts", F.lit(0)).alias("n_linked_texts"), F.coalesce("root", "node").alias("root"),
    )
    full = cut_lineage(full, "linked")
    # what stays of a group: its least document id (nulls last), then its least class
    order = F.struct(F.col("least").isNull().alias("no_id"), "least", "node")
    heads = full.groupBy("root").agg(F.min("least").alias("class_id"), F.min(order).alias("head"))
    full = full.join(heads, "root").withColumn("leads", F.col("node") == F.col("head.node"))
    return cut_lineage(full.drop("root", "head"), "groups")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", forest: Forest = Forest()) -> DataFrame:
    """Rows (doc_id, class_id, copies, n_links, n_linked_texts, stays), one per row of ``docs``.

    * ``class_id``: least ``doc_id`` of the group of rows connected by equality
      or links (null if all of them are null).
    * ``copies``: rows of the very same text; ``n_links``: rows of other texts
      with similarity at or above the threshold; ``n_linked_texts``: distinct
      such texts.
    * ``stays``: true for exactly one row of each group.
    * A null text equals no other text: its row is a group of its own.  Texts
      without a word (empty or white space) are linked only with equal texts.
    * Other columns are ignored; an empty table gives an empty table.
    """
    classes = text_classes(docs, doc_id, text, forest)
    keyed = _keyed(docs, doc_id, text).drop("text")
    joined = keyed.where("node is not null").join(classes, "node")
    leads = F.col("leads") & F.col("doc_id").eqNullSafe(F.col("least"))
    first = F.row_number().over(Window.partitionBy("node", "doc_id").orderBy("doc_id")) == 1
    counts = ["copies", "n_links", "n_linked_texts"]
    out = joined.select("doc_id", "class_id", *counts, (leads & first).alias("stays"))
    alone = keyed.where("node is null").select(
        "doc_id", F.col("doc_id").alias("class_id"),
        *[F.lit(n).cast("long").alias(c) for n, c in zip((1, 0, 0), counts, strict=True)], F.lit(True).alias("stays"),
    )
    return out.unionByName(alone)


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", forest: Forest = Forest()) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    classes = text_classes(docs, doc_id, text, forest).where("leads").select(F.col("node").alias("lead"), "least")
    keyed = _keyed(docs, doc_id, text, F.struct("*").alias("row")).drop("text")
    same = (F.col("node") == F.col("lead")) & F.col("doc_id").eqNullSafe(F.col("least"))
    led = keyed.join(classes, same)
    turn = F.row_number().over(Window.partitionBy("node", "doc_id").orderBy("doc_id"))
    one = led.withColumn("turn", turn).where("turn = 1").select("row")
    return one.unionByName(keyed.where("node is null").select("row")).select("row.*")
