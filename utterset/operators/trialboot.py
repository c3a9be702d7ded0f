"""Equal error rate and minimum cost of every replicate of resampled verification trials.

Trials lie in items: the trials of two blocks of speakers, or of one block of
trials, a few thousand at most.  Score ranges are cut once for each system.

1. A task that holds an item makes its weights for a batch of replicates from the
   resampling tree and adds them up per score range; the sums of all items are added.
2. Running totals at the cuts give both error rates there, so each replicate
   knows the one range that holds its crossing, and every range whose least
   possible cost is below the best cost at a cut.
3. A second pass lists weights by score in those ranges alone and finishes them exactly.

No row per replicate and trial exists outside the ranges of step 3.  Range bounds
come from approximate quantiles: they decide how much is left for step 3, never a
result.  A bound is a range of its own, so equal scores never fill another's range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from utterset.plans.resample import BLOCK, block_draws, multiplicities
from utterset.session import cut_lineage, sized

SPEAKERS = 1024  # speakers of a side of an item, a divisor of BLOCK
ITEM = 4096  # trials of an item
PER_RANGE = 32  # trials that a score range should have
RANGES = 1024  # most cuts of the scores
CELLS = 1 << 17  # replicates of a batch times score ranges


def score_cuts(trials: DataFrame, cells: int) -> list[np.ndarray]:
    """Ascending cuts of each system's scores."""
    rows = trials.count()
    cuts = int(min(RANGES, max(1, rows // PER_RANGE)))
    steps = [(i + 1) / (cuts + 1) for i in range(cuts)]
    found = trials.agg(
        *[F.percentile_approx(F.col("scores")[i], steps, 10 * RANGES).alias(f"c{i}") for i in range(cells)]
    ).first()
    return [np.unique(np.array(found[i] or [], dtype=float)) for i in range(cells)]


def range_of(scores: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Number of the range of each score, highest scores first; odd ranges are single scores."""
    at = np.searchsorted(cuts, scores, side="left")
    single = (at < len(cuts)) & (cuts[np.minimum(at, len(cuts) - 1)] == scores) if len(cuts) else np.zeros(len(scores), bool)
    return 2 * len(cuts) - (2 * at + single)


def items(trials: DataFrame) -> DataFrame:
    """(block_a, block_b, trials): at most about ``ITEM`` trials whose units lie in two blocks (-1 without a ``b``)."""
    keys = ["block_a", "block_b"]
    keyed = trials.withColumn("block_a", F.floor(F.col("a") / SPEAKERS)).withColumn(
        "block_b", F.coalesce(F.floor(F.col("b") / SPEAKERS), F.lit(-1))
    )
    sizes = keyed.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / ITEM).cast("int").alias("subs"))
    split = keyed.join(sizes, keys).withColumn("sub", F.pmod(F.xxhash64("trial_id"), F.col("subs")))
    return split.groupBy(*keys, "sub").agg(F.collect_list(F.struct("a", "b", "label", "scores")).alias("trials"))


def _weights(batch: pa.RecordBatch, i: int, n: int, batch_size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first replicate, weights, labels, scores) of an item for batches of replicates."""
    held = batch.column("trials")[i].values
    a, label = held.field("a").to_numpy(), held.field("label").to_numpy()
    scores = held.field("scores").flatten().to_numpy().reshape(len(held), -1)
    words = ("one", "two", "counts_a", "counts_b")
    one, two, counts_a, counts_b = (batch.column(c)[i] for c in words)
    one, two = (x.values.to_numpy(zero_copy_only=False).astype(np.uint32) for x in (one, two))
    sides = [(a, counts_a.values.to_numpy())]
    paired = counts_b.is_valid
    if paired:
        sides.append((held.field("b").to_numpy(), counts_b.values.to_numpy()))
    first = batch.column("first")[i].as_py()
    for lo in range(0, len(one), batch_size):
        part = slice(lo, lo + batch_size)
        drawn = []
        for unit, counts in sides:
            block = int(unit[0]) // BLOCK
            times = multiplicities(one[part], two[part], counts[part], block, min(BLOCK, n - block * BLOCK))
            drawn.append(times[:, unit - block * BLOCK])
        weights = drawn[0]
        if paired:
            # both sides of a target are one speaker, drawn once
            weights = np.where(label == 1, weights, weights * drawn[1])
        yield first + lo, weights, label, scores


def _range_sums(cuts: list[np.ndarray], n: int, batch_size: int):
    """(first, cell, size, t, n): sums per score range of each replicate of a batch, for the items of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                for first, weights, label, scores in _weights(batch, i, n, batch_size):
                    for cell, own in enumerate(cuts):
                        width = 2 * len(own) + 1
                        code = range_of(scores[:, cell], own) + width * (label == 1)
                        order = np.argsort(code, kind="stable")
                        found, starts = np.unique(code[order], return_index=True)
                        if (first, cell) not in total:
                            total[first, cell] = np.zeros((len(weights), 2 * width))
                        total[first, cell][:, found] += np.add.reduceat(weights[:, order], starts, axis=1)
        for (first, cell), sums in total.items():
            half = sums.shape[1] // 2
            sides = [pa.array([side.reshape(-1)], pa.list_(pa.float64())) for side in (sums[:, half:], sums[:, :half])]
            heads = [pa.array([x], pa.int32()) for x in (first, cell, len(sums))]
            yield pa.RecordBatch.from_arrays([*heads, *sides], names=["first", "cell", "size", "t", "n"])

    return run


def _open_ranges(p_target: float):
    """From the sums of all items: totals, the crossing's sides, the best cost at a cut, and the ranges left to look into."""
    norm = min(p_target, 1 - p_target)

    def settle(first: int, cell: int, t: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        rows = []
        zero = np.zeros((len(t), 1))
        ct, cn = (np.concatenate([zero, np.cumsum(x, axis=1)], axis=1) for x in (t, n))
        for r in range(len(t)):
            tt, tn = ct[r, -1], cn[r, -1]
            if tt <= 0 or tn <= 0:
                rows.append((first + r, cell, tt, tn, 0.0, 0.0, 0.0, 0.0, 0.0, []))
                continue
            fnr, fpr = 1.0 - ct[r] / tt, cn[r] / tn
            cross = int(np.argmax(fnr - fpr < 0))
            cost = (p_target * fnr + (1.0 - p_target) * fpr) / norm
            best = min(p_target / norm, cost[1:].min())
            least = (p_target * fnr[1:] + (1.0 - p_target) * fpr[:-1]) / norm
            inner = np.arange(len(least)) % 2 == 0
            look = inner & (t[r] > 0) & (n[r] > 0) & (least < best)
            if inner[cross - 1]:
                look[cross - 1] = True
            left = [(int(j), ct[r, j], cn[r, j]) for j in np.flatnonzero(look)]
            rows.append((first + r, cell, tt, tn, ct[r, cross - 1], cn[r, cross - 1], ct[r, cross], cn[r, cross], best, left))
        columns = list(zip(*rows, strict=True))
        names = ["replicate", "cell", "tt", "tn", "t_before", "n_before", "t_after", "n_after", "cost"]
        kinds = [pa.int32(), pa.int32(), *[pa.float64()] * 7]
        arrays = [pa.array(c, k) for c, k in zip(columns[:-1], kinds, strict=True)]
        entry = pa.struct([("number", pa.int32()), ("t_at", pa.float64()), ("n_at", pa.float64())])
        ranges = [[{"number": j, "t_at": a, "n_at": b} for j, a, b in left] for left in columns[-1]]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(ranges, pa.list_(entry))], names=[*names, "ranges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sums = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                first, cell, size = (batch.column(c)[i].as_py() for c in ("first", "cell", "size"))
                own = [batch.column(c)[i].values.to_numpy().reshape(size, -1) for c in ("t", "n")]
                if (first, cell) == key:
                    sums = [a + b for a, b in zip(sums, own, strict=True)]
                    continue
                if key is not None:
                    yield settle(*key, *sums)
                key, sums = (first, cell), own
        if key is not None:
            yield settle(*key, *sums)

    return run


def _open_rows(cuts: list[np.ndarray], n: int, batch_size: int):
    """(replicate, cell, number, score, t, n): weights by score inside the ranges that ``looked`` lists per replicate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                looked = batch.column("looked")[i].values
                wanted: dict[int, dict[int, list[int]]] = {}
                for r, cell, number in zip(*(looked.field(c).to_numpy().tolist() for c in ("replicate", "cell", "number")), strict=True):
                    wanted.setdefault(cell, {}).setdefault(number, []).append(r)
                wanted_rows = {c: {j: np.array(rs) for j, rs in own.items()} for c, own in wanted.items()}
                for first, weights, label, scores in _weights(batch, i, n, batch_size):
                    parts = []
                    for cell, own in wanted_rows.items():
                        number_of = range_of(scores[:, cell], cuts[cell])
                        order = np.argsort(number_of, kind="stable")
                        ranked = number_of[order]
                        for number, rs in own.items():
                            here = rs[(rs >= first) & (rs < first + len(weights))] - first
                            members = order[np.searchsorted(ranked, number) : np.searchsorted(ranked, number, "right")]
                            if not len(here) or not len(members):
                                continue
                            own_weights = weights[np.ix_(here, members)]
                            at, which = np.nonzero(own_weights)
                            w, trial = own_weights[at, which].astype(float), members[which]
                            same = np.full(len(at), cell), np.full(len(at), number)
                            hit = label[trial] == 1
                            parts.append((first + here[at], *same, scores[trial, cell], w * hit, w * ~hit))
                    if parts:
                        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
                        kinds = [np.int32] * 3 + [np.float64] * 3
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c.astype(k)) for c, k in zip(columns, kinds, strict=True)],
                            names=["replicate", "cell", "number", "score", "t", "n"],
                        )

    return run


def replicate_metrics(
    trials: DataFrame,
    cells: int,
    n: int,
    replicates: int,
    seed: int,
    first_valid: Callable[..., Sequence[int]],
    p_target: float,
) -> DataFrame:
    """(replicate, cell, eer, min_dcf) of the first valid replicates.

    ``trials`` has (trial_id, a, b, label, scores): positions of the two resampled
    speakers, or of the trial itself with a null ``b``, and one score per cell.  A
    replicate without targets or without non-targets is not valid.
    """
    cuts = score_cuts(trials, cells)
    batch_size = max(1, min(250, CELLS // max(2 * len(c) + 1 for c in cuts)))
    held = cut_lineage(items(trials), "trial-items")
    spark = trials.sparkSession

    def work(start: int, count: int) -> DataFrame:
        drawn = block_draws(spark, n, count, seed, start)
        ratio = BLOCK // SPEAKERS
        side_a = drawn.select(F.col("block").alias("draw_a"), "first", "one", "two", F.col("counts").alias("counts_a"))
        side_b = drawn.select(F.col("block").alias("draw_b"), F.col("counts").alias("counts_b"))
        rows = held.withColumn("draw_a", F.floor(F.col("block_a") / ratio)).withColumn("draw_b", F.floor(F.col("block_b") / ratio))
        return rows.join(side_a, "draw_a").join(side_b, "draw_b", "left")

    done: list[DataFrame] = []

    def valid(start: int, count: int) -> list[int]:
        sums = work(start, count).mapInArrow(
            _range_sums(cuts, n, batch_size), "first int, cell int, size int, t array<double>, n array<double>"
        )
        whole = sums.repartition("first", "cell").sortWithinPartitions("first", "cell")
        settled = cut_lineage(
            whole.mapInArrow(
                _open_ranges(p_target),
                "replicate int, cell int, tt double, tn double, t_before double, n_before double, t_after double, "
                "n_after double, cost double, ranges array<struct<number int, t_at double, n_at double>>",
            ),
            "replicate-ranges",
        )
        done.append(settled)
        # one trial list and one set of draws: what is valid for a cell is so for all
        usable = settled.where("cell = 0 and tt > 0 and tn > 0")
        return [r[0] for r in usable.select("replicate").collect()]

    good = first_valid(replicates, valid)
    settled = done[0]
    for more in done[1:]:
        settled = settled.unionByName(more)
    if good[-1] + 1 > replicates:
        settled = settled.join(spark.createDataFrame([(i,) for i in good], "replicate int"), "replicate")
    settled = sized(settled)
    ranges = settled.select("replicate", "cell", "tt", "tn", F.explode("ranges").alias("r")).select("replicate", "cell", "tt", "tn", "r.*")
    looked = ranges.agg(F.collect_list(F.struct("replicate", "cell", "number")).alias("looked"))
    # about five numbers per replicate and system reach every task
    rows = work(0, good[-1] + 1).withColumn("looked", looked.select("looked").scalar())
    listed = rows.mapInArrow(
        _open_rows(cuts, n, batch_size), "replicate int, cell int, number int, score double, t double, n double"
    )
    key = ["replicate", "cell", "number"]
    by_score = listed.groupBy(*key, "score").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    down = Window.partitionBy(*key).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    inner = by_score.select(*key, F.sum("t").over(down).alias("t"), F.sum("n").over(down).alias("n"))
    inner = inner.join(ranges, key).select(
        "replicate", "cell", "tt", "tn", (F.col("t") + F.col("t_at")).alias("t"), (F.col("n") + F.col("n_at")).alias("n")
    )
    sides = settled.select(
        "replicate", "cell", "tt", "tn",
        F.explode(
            F.array(
                F.struct(F.col("t_before").alias("t"), F.col("n_before").alias("n")),
                F.struct(F.col("t_after").alias("t"), F.col("n_after").alias("n")),
            )
        ).alias("s"),
    ).select("replicate", "cell", "tt", "tn", "s.*")
    norm = min(p_target, 1.0 - p_target)
    fnr, fpr = 1.0 - F.col("t") / F.col("tt"), F.col("n") / F.col("tn")
    rated = inner.unionByName(sides).select(
        "replicate", "cell", fnr.alias("fnr"), fpr.alias("fpr"), F.abs(fnr - fpr).alias("gap")
    )
    # the first minimum has the highest threshold: most misses, fewest false alarms
    best = F.min_by(F.struct("gap", "fnr", "fpr"), F.struct("gap", -F.col("fnr"), F.col("fpr")))
    cost = (F.lit(p_target) * F.col("fnr") + F.lit(1.0 - p_target) * F.col("fpr")) / norm
    found = rated.groupBy("replicate", "cell").agg(best.alias("best"), F.min(cost).alias("inner_cost"))
    return found.join(settled.select("replicate", "cell", "cost"), ["replicate", "cell"]).select(
        "replicate", "cell",
        F.when(F.col("best.gap") >= 1.0, F.lit(0.5)).otherwise((F.col("best.fnr") + F.col("best.fpr")) / 2).alias("eer"),
        F.least(F.lit(p_target / norm), "inner_cost", "cost").alias("min_dcf"),
    )
