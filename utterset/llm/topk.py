"""Exact top-k inner products: norm order, rotated partial sums, residual bounds.

1. The 64 x 64 (dimension squared) second-moment matrix of all vectors, summed
   from one small matrix per task, gives an SVD rotation that puts most of the
   length into the first coordinates.
2. Vectors are laid in bands of descending length, and bands are cut into blocks of
   at most ``BLOCK`` rows on average, so no band of equal lengths is one task's.
3. Every query first meets the longest vectors: its k-th best score there is a
   floor for its result.
4. A query visits only bands whose greatest length times its own reaches the floor
   (Cauchy-Schwarz).  Inside a block, partial sums over the first rotated
   coordinates plus the product of the residual lengths bound each score; only
   pairs whose bound reaches the floor are scored, exactly, on the integers.
5. Results of the blocks are merged by rank with a partial limit per task.

Queries and vectors meet in blocks: a stated query set against all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utterset.llm.streams import by_group
from utterset.session import cut_lineage

BLOCK = 2048
QUERIES = 512
BANDS = 64
HEAD = 16  # rotated coordinates of the partial sum
EXACT = float(1 << 53)


def integer_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, x, length): floor(scale * component) of vectors whose components are all finite."""
    raw = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))

    def unfit(c: Column) -> Column:
        return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))

    fit = raw.where(F.col("v").isNotNull() & ~F.exists("v", unfit))
    ints = fit.select("vec_id", F.transform("v", lambda c: F.floor(F.lit(float(scale)) * c).cast("double")).alias("x"))
    square = F.aggregate("x", F.lit(0.0), lambda acc, c: acc + c * c)
    return ints.select("vec_id", "x", F.sqrt(square).alias("length"), F.size("x").alias("dims"))


def _matrix(column: pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy().reshape(len(lists), -1)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        dims = batch.column("dims").to_numpy()
        for d in np.unique(dims).tolist():
            x = _matrix(batch.column("x").filter(pa.array(dims == d)))
            sums[d] = sums.get(d, 0) + x.T @ x
    for d, total in sums.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([d], pa.int32()), pa.array([total.reshape(-1)], pa.list_(pa.float64()))], names=["dims", "moments"]
        )


def rotations(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Orthogonal matrix per dimension; one matrix per task and dimension reaches the driver."""
    found: dict[int, np.ndarray] = {}
    for row in vectors.select("dims", "x").mapInArrow(_moments, "dims int, moments array<double>").toLocalIterator():
        d = row["dims"]
        found[d] = found.get(d, 0) + np.array(row["moments"]).reshape(d, d)
    return {d: np.linalg.svd(m)[0] for d, m in found.items() if d}


def _best(queries: np.ndarray, ids: np.ndarray, scores: np.ndarray, own: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, vec_id, score) of the k best of each row, ties to the smaller id; ``own`` are excluded cells."""
    out = []
    for i in range(len(queries)):
        row = np.where(own[i], -np.inf, scores[i])
        if len(row) > k:
            floor = np.partition(row, len(row) - k)[len(row) - k]
            at = np.flatnonzero(row >= floor)
        else:
            at = np.arange(len(row))
        at = at[row[at] > -np.inf]
        for j in at[np.lexsort((ids[at], -row[at]))][:k].tolist():
            out.append((int(queries[i]), int(ids[j]), int(row[j])))
    return out


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products: doubles hold them, or Python integers do."""
    if len(q) and len(x) and np.abs(q).sum(axis=1).max() * np.abs(x).max(initial=0) < EXACT:
        return q @ x.T
    whole = np.array([[int(v) for v in row] for row in x], dtype=object)
    return np.array([[sum(int(a) * b for a, b in zip(row, other, strict=True)) for other in whole] for row in q], dtype=object)


def _meet(rotation: dict[int, np.ndarray], k: int):
    """Score the queries of a cell against its block of vectors; rows with a floor are queries."""

    def work(table: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
        is_query = table.column("query").to_numpy()
        ids, floors, dims = (table.column(c).to_numpy() for c in ("vec_id", "floor", "dims"))
        found: list[tuple[int, int, int]] = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            asks = a + np.flatnonzero(is_query[a:b])
            has = a + np.flatnonzero(~is_query[a:b])
            if not len(asks) or not len(has):
                continue
            x = _matrix(table.column("x").slice(a, b - a))
            q, v = x[asks - a], x[has - a]
            # longest first, so that what remains open is a leading part
            order = np.argsort(-np.linalg.norm(v, axis=1), kind="stable")
            v, has = v[order], has[order]
            turn = rotation.get(int(dims[a]))
            floor = floors[asks]
            if turn is not None and len(turn) > HEAD and np.isfinite(floor).any():
                rq, rv = q @ turn, v @ turn
                rest = np.linalg.norm(rq[:, HEAD:], axis=1)[:, None] * np.linalg.norm(rv[:, HEAD:], axis=1)[None, :]
                bound = rq[:, :HEAD] @ rv[:, :HEAD].T + rest
                slack = 1e-6 * (1 + np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :])
                open_ = bound + slack >= floor[:, None]
            else:
                open_ = np.ones((len(q), len(v)), dtype=bool)
            some = open_.any(axis=0)
            if not some.any():
                continue
            v, has, open_ = v[some], has[some], open_[:, some]
            shut = ~open_ | (ids[asks][:, None] == ids[has][None, :])
            found += _best(ids[asks], ids[has], _scores(q, v), shut, k)
        columns = list(zip(*found, strict=True)) if found else [()] * 3
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"]
        )

    return work


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    scale: int = 256,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k greatest inner products of each query with other rows.

    ``is_query`` is a condition on the column ``vec_id``.  Vectors that are null
    or have a null or non-finite component take no part, nor do rows without an
    id.  A row with the query's id is the query itself; repeated rows of one id
    are one vector, the first in order of components.  A query meets only vectors
    of its own number of components.  Other columns are ignored.
    """
    fit = integer_vectors(vectors, vec_id, vector, scale).where("vec_id is not null and dims > 0")
    one = fit.groupBy("vec_id").agg(F.min(F.struct("x", "length", "dims")).alias("v")).select("vec_id", "v.*")
    rows = cut_lineage(one, "vectors")
    rotation = rotations(rows)
    cuts = rows.agg(F.percentile_approx("length", [i / BANDS for i in range(1, BANDS)], 1000)).first()[0] or []
    band = F.lit(0)
    for cut in sorted(set(cuts)):
        band = band + (F.col("length") < cut).cast("int")
    banded = rows.withColumn("band", band)
    sizes = banded.groupBy("dims", "band").agg(F.count("*").alias("n"), F.max("length").alias("greatest"))
    sizes = cut_lineage(sizes.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")), "bands")
    placed = banded.join(sizes.select("dims", "band", "blocks"), ["dims", "band"]).withColumn(
        "block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    )
    queries = rows.where(is_query).withColumn("part_key", F.xxhash64(F.lit("query"), "vec_id"))
    parts = max(1, -(-queries.count() // QUERIES))
    queries = queries.withColumn("part", F.pmod("part_key", F.lit(parts)).cast("int")).drop("part_key")
    # bands in order of length; block numbers run on through them
    bands = sizes.groupBy("dims").agg(
        F.sort_array(F.collect_list(F.struct("band", "greatest", "blocks", "n"))).alias("bands")
    )
    reach = queries.join(bands, "dims")
    shape = ["dims", "band", "block", "part"]
    columns = [*shape, "query", "vec_id", "floor", "x"]

    def cells(asking: DataFrame, wanted: Column) -> DataFrame:
        visits = asking.withColumn("b", F.explode(F.filter("bands", lambda b: wanted(b)))).select(
            "dims", F.col("b.band").alias("band"), F.explode(F.sequence(F.lit(0), F.col("b.blocks") - 1)).alias("block"),
            "part", F.lit(True).alias("query"), "vec_id", "floor", "x",
        )
        visited = visits.select(shape).distinct()
        met = placed.select("dims", "band", "block", "vec_id", "x").join(visited, ["dims", "band", "block"])
        stored = met.select(*shape, F.lit(False).alias("query"), "vec_id", F.lit(None).cast("double").alias("floor"), "x")
        return by_group(
            visits.select(columns).unionByName(stored.select(columns)), shape, _meet(rotation, k),
            "query_id long, vec_id long, score long",
        )

    # the floor comes from the first band: the longest vectors
    seeded = cells(reach.withColumn("floor", F.lit(float("-inf"))), lambda b: b["band"] == F.col("bands")[0]["band"])
    seeded = cut_lineage(_ranked(seeded, k), "seeded")
    floors = seeded.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("floor"))
    second = reach.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    slack = 1 + 1e-9
    rest = cells(
        second,
        lambda b: (b["band"] != F.col("bands")[0]["band"]) & (b["greatest"] * F.col("length") * slack >= F.col("floor")),
    )
    every = seeded.select("query_id", "vec_id", "score").unionByName(rest)
    return _ranked(every, k).select("query_id", "rank", "vec_id", "score")
