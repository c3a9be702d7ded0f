"""Connected groups of a link table, by contraction inside tasks and alternating stars.

Every round first contracts the links that lie in one task: each node is linked with
the least node that its task knows it to be connected with, so links that say nothing
new go without a shuffle.  Links are then replaced by links to smaller neighbours
(large star, then small star); after a number of rounds that grows with the logarithm
of the longest path, each member is linked with its group's smallest member only.
The number of tasks follows the counted links, ``LINKS`` to a task, and a table of no
more than that is contracted to the end by the first step.  Lineage is cut after each
round by a table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterset.session import cut_lineage

LINKS = 500_000  # links that a task contracts at once


def least_labels(left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """Least member of the group of each of ``size`` nodes, by hooking and pointer jumping."""
    label = np.arange(size)
    while True:
        before = label.copy()
        low = np.minimum(label[left], label[right])
        for side in (left, right):
            np.minimum.at(label, label[side], low)
            np.minimum.at(label, side, low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        if np.array_equal(before, label):
            return label


def _contract(links: int):
    def flush(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        ends = pa.concat_arrays([c for name in ("node", "other") for c in table.column(name).chunks])
        coded = ends.dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        names = coded.dictionary.take(pa.array(order))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        left, right = place[coded.indices.to_numpy()].reshape(2, -1)
        label = least_labels(left, right, len(names))
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays(
            [names.take(pa.array(moved)), names.take(pa.array(label[moved]))], names=["node", "other"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if held and sum(b.num_rows for b in held) + batch.num_rows > links:
                yield flush(held)
                held = []
            held.append(batch)
        if held:
            yield flush(held)

    return run


def _with_least(near: DataFrame) -> DataFrame:
    """Add to each (node, other) the least of the node and its others.

    Least neighbours are grouped with a map-side combine, written, and joined back:
    a node with very many links is then a skewed join that can be split.
    """
    least = near.groupBy("node").agg(F.min("other").alias("least"))
    least = cut_lineage(least.select("node", F.least("least", "node").alias("least")), "least")
    return near.join(least, "node")


def _large_star(links: DataFrame) -> DataFrame:
    flipped = links.select(F.col("other").alias("node"), F.col("node").alias("other"))
    near = _with_least(links.unionByName(flipped))
    return (
        near.where("other > node")
        .select(F.col("other").alias("node"), F.col("least").alias("other"))
        .where("node <> other")
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("node", "other").alias("node"), F.least("node", "other").alias("other"))
    near = _with_least(down)
    own = near.select("node", F.col("least").alias("other"))
    rest = near.select(F.col("other").alias("node"), F.col("least").alias("other"))
    return own.unionByName(rest).where("node <> other").distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("node", "other").cast("decimal(38,0)"))).first())


def connected(links: DataFrame, per_task: int = LINKS) -> DataFrame:
    """Rows (node, root) for every node of ``links`` (node, other); root is the group's least node.

    Links from a node to itself give a row of its own, repeated links count once;
    null ends are ignored; an empty table gives an empty table.
    """
    links = links.select("node", "other").where("node is not null and other is not null")
    written = cut_lineage(links, "links")
    current = written.where("node <> other")
    state = None
    while True:
        count = current.count()
        tasks = max(1, -(-count // per_task))
        stars = current.coalesce(tasks).mapInArrow(_contract(per_task), current.schema)
        if count <= per_task:
            current = cut_lineage(stars, "stars")
            break
        current = cut_lineage(_small_star(_large_star(cut_lineage(stars, "stars"))), "links")
        before, state = state, _state(current)
        if before == state:
            break
    roots = current.select(F.col("other").alias("node"), F.col("other").alias("root"))
    own = written.where("node = other").select("node", F.col("node").alias("root"))
    # a node with a smaller root keeps that one
    found = current.select("node", F.col("other").alias("root")).unionByName(roots).unionByName(own)
    return found.groupBy("node").agg(F.min("root").alias("root"))
