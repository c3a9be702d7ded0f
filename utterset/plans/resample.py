"""Draws with replacement that never meet their units in a join.

A replicate draws ``n`` of ``n`` units.  How many of its draws fall into each block
of ``BLOCK`` units comes from a multinomial tree: a node's draws are split between
its halves by a binomial quantile of a hash of (replicate, node).  A task then
holds the units of one block and one number per replicate, makes the draws
inside the block itself, and emits sums.  So n x R draws are made but no row of
them, and a draw depends on (seed, replicate, block, number) alone.

Hashes are 32-bit mixes, so any engine with 64-bit integers gives the same draws.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterset.functions.hashing import key_words, order_key
from utterset.session import slots

BLOCK = 4096
CHUNK = 250  # replicates that a task works on at once
WORDS = 1 << 16  # hashes held at once
TREE_CHUNK = 100
KNOWN_SIZE = 40_000  # a kept law takes at most 14 kB
LAW_CELLS = 1 << 16  # probabilities held at once
TASK_BLOCKS = 64
# fixed values of the 32-bit mix
STEP, FIRST, SECOND = 0x9E3779B9, 0x85EBCA6B, 0xC2B2AE35
SPLIT_HIGH, SPLIT_LOW, DRAW_ONE, DRAW_TWO = 1, 2, 3, 4  # what a word is for


def mix32(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(FIRST)
    x ^= x >> np.uint32(13)
    x *= np.uint32(SECOND)
    x ^= x >> np.uint32(16)
    return x


def _mix_in_place(x: np.ndarray, spare: np.ndarray, high_only: bool = False) -> None:
    """``mix32`` without new arrays; its last step leaves the 16 high bits as they are."""
    for shift, factor in ((16, FIRST), (13, SECOND), *([] if high_only else [(16, None)])):
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        if factor:
            np.multiply(x, np.uint32(factor), out=x)


def key_word(one: np.ndarray, two: np.ndarray, number: int, use: int) -> np.ndarray:
    """A word for each replicate's key (one, two), for a node or block number and a use."""
    at = np.uint32((number * 8 + use) * STEP & 0xFFFFFFFF)
    return mix32(mix32(one + at) ^ two)


def uniform(one: np.ndarray, two: np.ndarray, node: int) -> np.ndarray:
    """52-bit uniform of each replicate at a node of the tree, strictly inside (0, 1)."""
    high = key_word(one, two, node, SPLIT_HIGH).astype(np.float64)
    low = (key_word(one, two, node, SPLIT_LOW) >> np.uint32(12)).astype(np.float64)
    return (high * 2.0**20 + low + 0.5) / 2.0**52


def binomial_quantile(m: np.ndarray, p: float, u: np.ndarray) -> np.ndarray:
    """The least k with P(Binomial(m, p) <= k) > u, for each pair of m and u.

    Probabilities are ratios outwards from the mode, as far as 8 deviations and 40.
    """
    out = np.zeros(len(m), dtype=np.int64)
    if len(m) and m.max() <= KNOWN_SIZE:
        # the lowest levels of a tree ask for the same few laws in every node
        for i, size in enumerate(m.tolist()):
            if size:
                low, reached = _known_law(size, p)
                out[i] = min(low + int(reached.searchsorted(u[i], side="right")), size)
        return out
    odds = p / (1 - p)
    sizes, owner = np.unique(m, return_inverse=True)
    order = np.argsort(owner, kind="stable")
    mode, reach = ((sizes + 1) * p).astype(np.int64), (8 * np.sqrt(sizes * p * (1 - p))).astype(np.int64) + 40
    low, high = np.maximum(0, mode - reach), np.minimum(sizes, mode + reach)
    start = 0
    while start < len(sizes):
        # laws of some sizes at a time, as rows around their modes; sizes ascend, and so do the widths
        some = max(1, LAW_CELLS // (2 * int(reach[start]) + 1))
        part = slice(start, start + some)
        size, far = sizes[part, None].astype(float), np.arange(reach[part].max())
        up, down = mode[part, None] + far, mode[part, None] - far
        above = np.cumprod(np.where(up < high[part, None], (size - up) / (up + 1) * odds, 0.0), axis=1)
        below = np.cumprod(np.where(down > low[part, None], down / (size - down + 1) / odds, 0.0), axis=1)
        reached = np.cumsum(np.concatenate([below[:, ::-1], np.ones((len(size), 1)), above], axis=1), axis=1)
        reached /= reached[:, -1:]
        here = order[slice(*np.searchsorted(owner[order], [start, start + len(size)]))]
        passed = (reached[owner[here] - start] <= u[here, None]).sum(axis=1)
        out[here] = np.minimum(np.maximum(0, passed - len(far) + mode[owner[here]]), m[here])
        start += some
    return out


@lru_cache(maxsize=12_000)
def _known_law(size: int, p: float) -> tuple[int, np.ndarray]:
    """(least k, P(Binomial(size, p) <= k) from it on)."""
    odds = p / (1 - p)
    mode, reach = int((size + 1) * p), int(8 * np.sqrt(size * p * (1 - p))) + 40
    low, high = max(0, mode - reach), min(size, mode + reach)
    up, down = np.arange(mode, high, dtype=float), np.arange(mode, low, -1, dtype=float)
    above = np.cumprod((size - up) / (up + 1) * odds)
    below = np.cumprod(down / (size - down + 1) / odds)
    reached = np.cumsum(np.concatenate([below[::-1], [1.0], above]))
    return low, reached / reached[-1]


def blocks_of(n: int) -> int:
    return max(1, -(-n // BLOCK))


def _tree(n: int):
    """Draws of each block, for a batch of replicates; depth first, so memory is the depth times the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = int(batch.column("first")[0].as_py())
            one, two = (np.array(batch.column(c)[0].as_py(), dtype=np.uint32) for c in ("one", "two"))
            stack = [(0, blocks_of(n), 1, np.full(len(one), n, dtype=np.int64))]
            blocks, counts = [], []
            while stack:
                low, high, node, m = stack.pop()
                if high - low > 1:
                    middle = low + (high - low) // 2
                    left, whole = (min(x * BLOCK, n) - low * BLOCK for x in (middle, high))
                    taken = binomial_quantile(m, left / whole, uniform(one, two, node))
                    stack.append((middle, high, 2 * node + 1, m - taken))
                    stack.append((low, middle, 2 * node, taken))
                    continue
                blocks.append(low)
                counts.append(m.astype(np.int32))
                if len(blocks) == 1000 or not stack:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(blocks, pa.int64()), pa.array([first] * len(blocks), pa.int32()),
                            pa.array(counts, pa.list_(pa.int32())),
                        ],
                        names=["block", "first", "counts"],
                    )
                    blocks, counts = [], []

    def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from run(iter([batch.slice(i, 1)]))

    return one_by_one


def replicate_keys(spark: SparkSession, replicates: int, seed: int, start: int = 0) -> DataFrame:
    """(first, one, two): the keys of ``TREE_CHUNK`` replicates a row."""
    numbered = spark.range(start, start + replicates, 1, slots(spark, replicates, 5000)).select(F.col("id").alias("replicate"))
    high, _ = key_words(order_key(seed, "replicate", "replicate"))
    words = numbered.select("replicate", high.alias("h")).select(
        F.floor((F.col("replicate") - start) / TREE_CHUNK).alias("part"),
        F.struct("replicate", F.shiftright("h", 30).alias("one"), F.col("h").bitwiseAND(F.lit((1 << 30) - 1)).alias("two")).alias("k"),
    )
    rows = words.groupBy("part").agg(F.sort_array(F.collect_list("k")).alias("k"))
    return rows.select(F.col("k.replicate")[0].cast("int").alias("first"), F.col("k.one").alias("one"), F.col("k.two").alias("two"))


def block_draws(spark: SparkSession, n: int, replicates: int, seed: int, start: int = 0) -> DataFrame:
    """(block, first, one, two, counts): one row for each block, with the draws of all replicates in order.

    Arrays are replicates long; ``first`` is the first replicate's number.
    """
    keys = replicate_keys(spark, replicates, seed, start)
    spread = keys.repartition(slots(spark, replicates, TREE_CHUNK))  # evenly, not by a hash
    counts = spread.mapInArrow(_tree(n), "block long, first int, counts array<int>")
    whole = counts.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("first", "counts"))).alias("c"))
    listed = keys.agg(F.sort_array(F.collect_list(F.struct("first", "one", "two"))).alias("k"))
    keyed = whole.withColumn("k", listed.select("k").scalar())
    return keyed.select(
        "block", F.lit(start).alias("first"), F.flatten("k.one").alias("one"), F.flatten("k.two").alias("two"),
        F.flatten("c.counts").alias("counts"),
    )


def multiplicities(
    one: np.ndarray, two: np.ndarray, counts: np.ndarray, block: int, size: int
) -> np.ndarray:
    """(replicate, unit) matrix of how often each unit of a block is drawn."""
    a, b = key_word(one, two, block, DRAW_ONE), key_word(one, two, block, DRAW_TWO)
    most = int(counts.max()) if len(counts) else 0
    # some replicates at a time, in the same few arrays, so that they stay in the processor's cache
    group = max(1, min(len(counts), WORDS // max(1, most)))
    steps = np.arange(most, dtype=np.uint32) * np.uint32(STEP)
    held, spare = np.empty((group, most), dtype=np.uint32), np.empty((group, most), dtype=np.uint32)
    exact = 1 < size <= 1 << 16 and size & (size - 1) == 0  # a power of two: high bits are the place
    out = np.empty((len(counts), size), dtype=np.int64)
    for lo in range(0, len(counts), group):
        here = counts[lo : lo + group].tolist()
        words, other = held[: len(here)], spare[: len(here)]
        np.add(steps[None, :], a[lo : lo + group, None], out=words)
        _mix_in_place(words, other)
        np.bitwise_xor(words, b[lo : lo + group, None], out=words)
        _mix_in_place(words, other, exact)
        if exact:
            np.right_shift(words, np.uint32(33 - size.bit_length()), out=words)
        else:
            words[...] = (words.astype(np.uint64) * np.uint64(size)) >> np.uint64(32)
        words += (np.arange(len(here), dtype=np.uint32) * np.uint32(size))[:, None]
        for row, m in zip(words, here, strict=True):
            row[m:] = len(here) * size  # beyond the replicate's draws: a place that is dropped
        drawn = np.bincount(words.ravel(), minlength=len(here) * size + 1)[:-1]
        out[lo : lo + group] = drawn.reshape(len(here), size)
    return out


def block_rows(units: DataFrame, columns: Sequence[str], pos: str = "pos") -> DataFrame:
    """(block, units): the units of each block in order of position, at most ``BLOCK``."""
    block = F.floor(F.col(pos) / F.lit(BLOCK)).alias("block")
    return units.groupBy(block).agg(F.sort_array(F.collect_list(F.struct(pos, *[c for c in columns if c != pos]))).alias("units"))


def per_replicate(
    units: DataFrame,
    columns: Sequence[str],
    work: Callable[[np.ndarray, dict], dict[str, np.ndarray]],
    schema: str,
    n: int,
    replicates: int,
    seed: int,
    start: int = 0,
) -> DataFrame:
    """Rows (replicate, columns of ``schema``) of every block, to be summed over the blocks.

    ``work`` gets the multiplicities of some replicates and the block's columns
    in the same order (lists as Arrow arrays); it returns arrays as long as there are replicates, or, with
    ``replicate`` among them as places in the batch, any number of rows.
    """
    drawn = block_draws(units.sparkSession, n, replicates, seed, start)
    # a row is a block with all its draws: few bytes and much work, so rows are dealt out evenly, several
    # to a task, whose sums per replicate then leave it once for all its blocks
    blocks, parallel = blocks_of(n), units.sparkSession.sparkContext.defaultParallelism
    cells = block_rows(units, columns).join(drawn, "block").repartition(min(blocks, max(8 * parallel, -(-blocks // TASK_BLOCKS))))
    names = [field.split()[0] for field in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held = batch.column("units")[i].values
                values = {c: held.field(c) for c in columns}
                values = {c: v if pa.types.is_list(v.type) else v.to_numpy(zero_copy_only=False) for c, v in values.items()}
                one, two, counts = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("one", "two", "counts"))
                one, two = one.astype(np.uint32), two.astype(np.uint32)
                block, first = batch.column("block")[i].as_py(), batch.column("first")[i].as_py()
                for lo in range(0, len(counts), CHUNK):
                    part = slice(lo, lo + CHUNK)
                    drawn = multiplicities(one[part], two[part], counts[part], block, len(held))
                    made = work(drawn, values)
                    places = made.pop("replicate", np.arange(len(drawn)))
                    columns_out = [pa.array((first + lo + places).astype(np.int32))] + [pa.array(made[c]) for c in names]
                    yield pa.RecordBatch.from_arrays(columns_out, names=["replicate", *names])

    return cells.mapInArrow(run, f"replicate int, {schema}")


# --------------------------------------------------------------------------
# the same draws as SQL


def _sql_mix(source: str, x: str = "x") -> str:
    """A subquery whose column ``x`` is mixed."""
    for step in (
        f"xor({x}, {x} >> 16)", f"({x} * {FIRST}) & 4294967295", f"xor({x}, {x} >> 13)",
        f"({x} * {SECOND}) & 4294967295", f"xor({x}, {x} >> 16)",
    ):
        source = f"(SELECT * REPLACE ({step} AS {x}) FROM {source})"
    return source


def _sql_word(source: str, number: str, use: int) -> str:
    """A subquery with a column ``x``: the key word for ``number`` (a column) and ``use``."""
    at = f"((({number}) * 8 + {use}) * {STEP}) & 4294967295"
    inner = _sql_mix(f"(SELECT *, ((one + ({at})::UBIGINT) & 4294967295)::UBIGINT AS x FROM {source})")
    return _sql_mix(f"(SELECT * REPLACE (xor(x, two) AS x) FROM {inner})")


def sql_draws(units: str, replicates: int, seed: int, levels: int = 5, name: str = "draws") -> str:
    """CTEs that end in ``draws`` (replicate, pos), for up to 2 ** levels blocks."""
    digest = f"md5(concat_ws(':', '{seed}', 'replicate', replicate::VARCHAR))"
    ctes = [
        f"""n_units AS (SELECT count(*) AS n FROM {units}),
keys AS (SELECT replicate, (h >> 30)::UBIGINT AS one, (h & 1073741823)::UBIGINT AS two
         FROM (SELECT replicate, ('0x' || substr({digest}, 1, 15))::UBIGINT AS h FROM range({replicates}) t(replicate))),
tree0 AS (SELECT replicate, one, two, 0 AS lo, (n + {BLOCK - 1}) // {BLOCK} AS hi, 1 AS node, n AS m, n FROM keys, n_units)"""
    ]
    for level in range(levels):
        here = f"(SELECT *, lo + (hi - lo) // 2 AS mid FROM tree{level} WHERE hi - lo > 1)"
        high = _sql_word(here, "node", SPLIT_HIGH)
        low = _sql_word(f"(SELECT * EXCLUDE x, x AS high FROM {high})", "node", SPLIT_LOW)
        ctes.append(
            f"""split{level} AS MATERIALIZED (
  SELECT * EXCLUDE (x, high), (high::DOUBLE * 1048576.0 + (x >> 12)::DOUBLE + 0.5) / 4503599627370496.0 AS u,
         (least(mid * {BLOCK}, n) - lo * {BLOCK})::DOUBLE / (least(hi * {BLOCK}, n) - lo * {BLOCK}) AS p FROM {low}),
law{level} AS (
  SELECT m, p, k, sum(exp(lgamma(m + 1) - lgamma(k + 1) - lgamma(m - k + 1) + k * ln(p) + (m - k) * ln(1 - p)))
         OVER (PARTITION BY m, p ORDER BY k) AS reached
  FROM (SELECT DISTINCT m, p FROM split{level} WHERE m > 0), LATERAL (SELECT unnest(range(m + 1)) AS k)),
taken{level} AS (
  SELECT s.*, least(coalesce(l.k + 1, 0), s.m) AS t FROM split{level} s
  ASOF LEFT JOIN law{level} l ON s.m = l.m AND s.p = l.p AND s.u >= l.reached),
tree{level + 1} AS (
  SELECT replicate, one, two, lo, hi, node, m, n FROM tree{level} WHERE hi - lo = 1
  UNION ALL SELECT replicate, one, two, lo, mid, 2 * node, t, n FROM taken{level}
  UNION ALL SELECT replicate, one, two, mid, hi, 2 * node + 1, m - t, n FROM taken{level})"""
        )
    last = f"(SELECT replicate, one, two, lo, m, least({BLOCK}, n - lo * {BLOCK}) AS size FROM tree{levels})"
    a = _sql_word(last, "lo", DRAW_ONE)
    b = _sql_word(f"(SELECT * EXCLUDE x, x AS a FROM {a})", "lo", DRAW_TWO)
    each = f"(SELECT replicate, lo, size, a, x AS b, unnest(range(m)) AS j FROM {b})"
    first = _sql_mix(f"(SELECT *, (((j * {STEP}) & 4294967295)::UBIGINT + a & 4294967295)::UBIGINT AS x FROM {each})")
    final = _sql_mix(f"(SELECT * REPLACE (xor(x, b) AS x) FROM {first})")
    ctes.append(f"{name} AS (SELECT replicate, (lo * {BLOCK} + ((x * size) >> 32))::BIGINT AS pos FROM {final})")
    return ",\n".join(ctes)
