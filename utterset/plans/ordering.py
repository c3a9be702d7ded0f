"""Ranks, running totals and cuts that never put a whole group into one task.

Every helper works in two levels: counts or sums per (group, bucket) are tiny
after partial aggregation and give the offset of each bucket; the exact order is
then needed only inside a bucket.  A group holding a third of all rows is spread
over all its buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utterset.session import sized


def _bucket(hash_col: str, digits: int) -> Column:
    return F.substring(F.col(hash_col), 1, digits)


ROWS_PER_BUCKET = 250_000


def buckets_for(largest: int) -> int:
    """Buckets that keep a group of ``largest`` rows within a task's share."""
    return max(1, -(-largest // ROWS_PER_BUCKET))


def with_position(
    df: DataFrame,
    hash_col: str,
    ties: Sequence[str],
    *,
    group: Sequence[str] = (),
    name: str = "pos",
    digits: int = 3,
) -> DataFrame:
    """Add the 0-based rank in (hash, ties) order, per ``group`` or global."""
    group = list(group)
    marked = df.withColumn("_b", _bucket(hash_col, digits))
    counts = marked.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_c"))
    # at most 16**digits rows per group reach this window
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *group, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off")
    )
    inside = Window.partitionBy(*group, "_b").orderBy(hash_col, *ties)
    return (
        marked.join(offsets, [*group, "_b"])
        .withColumn(name, (F.col("_off") + F.row_number().over(inside) - 1).cast("long"))
        .drop("_b", "_off")
    )


def beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns of a one-row table added to another (a scalar subquery, no join)."""
    row = right.select(F.struct("*").alias("_row")).scalar()
    return left.withColumn("_row", row).select(
        *left.columns, *[F.col("_row")[c].alias(c) for c in right.columns]
    )


def hash_cut(
    df: DataFrame,
    group: Sequence[str],
    hash_col: str,
    tie: str,
    quota: Column,
    *,
    digits: int = 3,
) -> DataFrame:
    """Per group: ``n``, ``k`` = quota(n), and the k-th smallest (hash, tie).

    ``quota`` is an expression over the group size ``n``.  Two narrow scans and
    one small aggregation; only the rows of each boundary bucket are ranked.
    """
    group = list(group)
    narrow = df.select(*group, hash_col, tie).withColumn("_b", _bucket(hash_col, digits))
    counts = narrow.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*group).orderBy("_b").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    table = (
        counts.withColumn("_cum", F.sum("_c").over(upto))
        .withColumn("n", F.sum("_c").over(whole))
        .withColumn("k", F.least(F.greatest(quota, F.lit(0)), F.col("n")).cast("long"))
    )
    table = sized(table)
    sizes = table.groupBy(*group).agg(F.max("n").alias("n"), F.max("k").alias("k"))
    boundary = table.where(
        (F.col("_cum") - F.col("_c") < F.col("k")) & (F.col("k") <= F.col("_cum"))
    ).select(*group, "_b", (F.col("k") - F.col("_cum") + F.col("_c")).alias("_need"))
    inside = Window.partitionBy(*group).orderBy(hash_col, tie)
    cuts = (
        narrow.join(boundary, [*group, "_b"])
        .withColumn("_rn", F.row_number().over(inside))
        .where(F.col("_rn") == F.col("_need"))
        .select(*group, F.col(hash_col).alias("cut_hash"), F.col(tie).alias("cut_tie"))
    )
    return sizes.join(cuts, group, "left") if group else beside(sizes, cuts)


def below_cut(hash_col: str, tie: str) -> Column:
    """Whether a row is among the k smallest of its group (after joining a cut)."""
    inside = (F.col(hash_col) < F.col("cut_hash")) | (
        (F.col(hash_col) == F.col("cut_hash")) & (F.col(tie) <= F.col("cut_tie"))
    )
    return F.coalesce(inside, F.lit(False))


def split_by_cut(
    df: DataFrame,
    group: Sequence[str],
    hash_col: str,
    tie: str,
    quota: Column,
    *,
    name: str,
    digits: int = 3,
) -> DataFrame:
    """Flag the ``quota(n)`` first rows of every group in hash order."""
    cuts = hash_cut(df, group, hash_col, tie, quota, digits=digits)
    if group:
        joined = df.join(sized(cuts), list(group), "left")
    else:
        # one cut for the whole table: two literals
        cut = cuts.first()
        joined = df.withColumn("cut_hash", F.lit(cut["cut_hash"] if cut else None).cast("string")).withColumn(
            "cut_tie", F.lit(cut["cut_tie"] if cut else None).cast(df.schema[tie].dataType)
        )
    return joined.withColumn(name, below_cut(hash_col, tie)).drop("cut_hash", "cut_tie", "n", "k")


def range_bucket(df: DataFrame, order_col: str, buckets: int = 32, name: str = "_b") -> DataFrame:
    """Add a bucket number that grows with ``order_col``, about equally filled.

    The bounds (fewer than ``buckets`` numbers) come from one approximate-quantile
    aggregate; they decide only how work is spread, never the result.
    """
    steps = [i / buckets for i in range(1, buckets)]
    found = df.agg(F.percentile_approx(order_col, steps, max(2000, 4 * buckets)).alias("bounds")).first()
    bounds = sorted(set(found["bounds"] or []))
    # the number of bounds below the value
    below = F.filter(F.lit(bounds), lambda b: b < F.col(order_col)) if bounds else F.array()
    return df.withColumn(name, F.size(below))


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    order_col: str,
    values: Sequence[str],
    *,
    descending: bool = False,
    buckets: int = 32,
) -> DataFrame:
    """Add ``cum_<v>`` for each value, in ``order_col`` order inside each group.

    ``order_col`` must be unique inside a group: aggregate ties first.  Use
    ``buckets_for`` when the largest group is known; one bucket is a plain window.
    """
    group = list(group)
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    if buckets == 1:
        plain = Window.partitionBy(*group).orderBy(direction(order_col)).rowsBetween(
            Window.unboundedPreceding, 0
        )
        return df.select("*", *[F.sum(v).over(plain).alias(f"cum_{v}") for v in values])
    marked = range_bucket(df, order_col, buckets)
    sums = marked.groupBy(*group, "_b").agg(*[F.sum(v).alias(f"_s_{v}") for v in values])
    before = Window.partitionBy(*group).orderBy(direction("_b")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sums.select(
        *group,
        "_b",
        *[F.coalesce(F.sum(f"_s_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values],
    )
    inside = Window.partitionBy(*group, "_b").orderBy(direction(order_col)).rowsBetween(
        Window.unboundedPreceding, 0
    )
    out = marked.join(offsets, [*group, "_b"])
    for v in values:
        out = out.withColumn(f"cum_{v}", F.sum(v).over(inside) + F.col(f"_o_{v}"))
    return out.drop("_b", *[f"_o_{v}" for v in values])


def interval_lookup(
    points: DataFrame,
    point: str,
    intervals: DataFrame,
    low: str,
    high: str,
    *,
    width: int,
) -> DataFrame:
    """Join each point to the interval ``[low, high)`` holding it.

    An equi-join on cells of ``width``: an interval is repeated once per cell it
    touches, so choose ``width`` near the total length over the interval count.
    """
    cells = intervals.where(F.col(high) > F.col(low)).withColumn(
        "_cell",
        F.explode(
            F.sequence(
                F.floor(F.col(low) / F.lit(width)), F.floor((F.col(high) - 1) / F.lit(width))
            )
        ),
    )
    keyed = points.withColumn("_cell", F.floor(F.col(point) / F.lit(width)))
    return (
        keyed.join(cells, "_cell")
        .where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high)))
        .drop("_cell")
    )
