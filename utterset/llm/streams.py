"""Sorted partitions as streams of whole groups, for tasks that meet very many small groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def _cuts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """First row of each group of a sorted table."""
    changed = np.zeros(table.num_rows - 1, dtype=bool)
    for name in keys:
        column = table.column(name).combine_chunks()
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        other = pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)), False)
        changed |= other.to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(changed) + 1])


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups and the first row of each group; memory is a batch and one group."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        table = pa.Table.from_batches(kept)
        cuts = _cuts(table, keys)
        last = int(cuts[-1])
        if last:
            yield table.slice(0, last).combine_chunks(), np.append(cuts[:-1], last)
            kept = table.slice(last).combine_chunks().to_batches()
    if kept:
        table = pa.Table.from_batches(kept).combine_chunks()
        yield table, np.append(_cuts(table, keys), table.num_rows)


def by_group(
    rows: DataFrame,
    keys: list[str],
    work: Callable[[pa.Table, np.ndarray], pa.RecordBatch],
    schema: str,
    order: list[str] | None = None,
) -> DataFrame:
    """``work(table, cuts)`` on whole groups of non-null ``keys``; group i is rows cuts[i] to cuts[i + 1].

    ``order`` begins with the keys and sorts the rows; without it rows of a group come in any order.

    One exchange and one sort; unlike a call per group, the cost of a call is
    shared by all small groups of a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in whole_groups(batches, keys):
            yield work(table, cuts)

    return rows.repartition(*keys).sortWithinPartitions(*(order or keys)).mapInArrow(run, schema)
