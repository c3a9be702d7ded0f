"""Deterministic shuffles, splits, hold-outs, folds and quotas in hash order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utterset.functions.hashing import order_key
from utterset.plans.ordering import split_by_cut, with_position
from utterset.session import sized


def permute(df: DataFrame, key: str, seed: int, salt: str = "permute") -> DataFrame:
    """Rows in a seeded order (range-partitioned sort)."""
    return df.withColumn("_h", order_key(seed, salt, key)).orderBy("_h", key).drop("_h")


def with_permutation(df: DataFrame, key: str, seed: int, salt: str = "permute") -> DataFrame:
    """Add ``pos``, the row's place in the seeded order."""
    ordered = with_position(df.withColumn("_h", order_key(seed, salt, key)), "_h", [key])
    return ordered.drop("_h")


def split_by_source(
    df: DataFrame, key: str, *, dataset: str = "dataset", val_pct: float = 0.05, seed: int = 42
) -> DataFrame:
    """Add ``split``: every source with two or more rows is in train and val.

    Per source n_val = max(1, round-half-even(n * val_pct)); single rows train.
    """
    quota = F.when(
        F.col("n") > 1, F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(val_pct)))
    ).otherwise(F.lit(0))
    hashed = df.withColumn("_h", order_key(seed, "split", key))
    marked = split_by_cut(hashed, [dataset], "_h", key, quota, name="_val")
    return marked.withColumn(
        "split", F.when(F.col("_val"), F.lit("val")).otherwise(F.lit("train"))
    ).drop("_h", "_val")


def holdout_per_group(
    df: DataFrame, key: str, group: str, k: int, seed: int, *, salt: str = "holdout"
) -> DataFrame:
    """Add ``role``: min(k, n-1) test rows per group, at least one train row."""
    quota = F.least(F.lit(k), F.col("n") - 1)
    hashed = df.withColumn("_h", order_key(seed, salt, key))
    marked = split_by_cut(hashed, [group], "_h", key, quota, name="_test", digits=2)
    return marked.withColumn(
        "role", F.when(F.col("_test"), F.lit("test")).otherwise(F.lit("train"))
    ).drop("_h", "_test")


def fold_of(position: Column, n: Column, k: Column | int) -> Column:
    """0-based part of ``position`` when n items are cut into k near-equal runs."""
    parts = F.lit(k) if isinstance(k, int) else k
    small = F.floor(n / parts)
    larger = n - small * parts
    edge = larger * (small + 1)
    return (
        F.when(position < edge, F.floor(position / (small + 1)))
        .otherwise(larger + F.floor((position - edge) / F.greatest(small, F.lit(1))))
        .cast("int")
    )


def group_folds(df: DataFrame, group: str, k: int, seed: int) -> DataFrame:
    """(group, fold): groups in seeded order cut into min(k, groups) runs."""
    groups = sized(df.select(group).distinct().withColumn("_h", order_key(seed, "fold", group)))
    n = groups.count()
    placed = with_position(groups, "_h", [group])
    splits = min(k, n)
    if splits < 2:
        raise ValueError("group folds need at least two groups")
    return placed.select(group, fold_of(F.col("pos"), F.lit(n), splits).alias("fold"))


def group_kfold(df: DataFrame, group: str, k: int, seed: int) -> DataFrame:
    """Add a group-disjoint ``fold``."""
    return df.join(group_folds(df, group, k, seed), group)


def sample_groups(
    df: DataFrame,
    key: str,
    group: str,
    *,
    min_rows: int,
    max_rows: int,
    total: int,
    seed: int,
) -> DataFrame:
    """Groups with ``min_rows`` or more, at most ``max_rows`` each, ``total`` overall.

    Groups come in seeded order; the overall total cuts the last one.
    """
    within = Window.partitionBy(group).orderBy("_h", key)
    # a literal bound lets the planner cut each group before the shuffle
    capped = (
        df.withColumn("_h", order_key(seed, "row", key))
        .withColumn("_rn", F.row_number().over(within))
        .where(F.col("_rn") <= max_rows)
        .drop("_h")
    )
    sizes = (
        df.groupBy(group)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") >= min_rows)
        .withColumn("_take", F.least("_n", F.lit(max_rows)))
        .withColumn("_gh", order_key(seed, "group", group))
        .withColumn("_b", F.substring("_gh", 1, 3))
    )
    sums = sizes.groupBy("_b").agg(F.sum("_take").alias("_s"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_b").orderBy("_gh", group).rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = (
        sizes.join(offsets, "_b")
        .withColumn("_start", F.col("_off") + F.coalesce(F.sum("_take").over(inside), F.lit(0)))
        .where(F.col("_start") < total)
        .select(group, "_start")
    )
    return (
        capped.join(sized(starts), group)
        .withColumn("order_no", (F.col("_start") + F.col("_rn")).cast("long"))
        .where(F.col("order_no") <= total)
        .drop("_rn", "_start")
    )


def sample_exact(
    df: DataFrame, key: str, k: int | Column, *, by: Sequence[str] = (), seed: int, salt: str = "quota"
) -> DataFrame:
    """Exactly min(k, n) rows per ``by`` (or overall), uniformly without replacement."""
    quota = F.lit(k) if isinstance(k, int) else k
    hashed = df.withColumn("_h", order_key(seed, salt, key))
    marked = split_by_cut(hashed, list(by), "_h", key, quota, name="_in")
    return marked.where("_in").drop("_h", "_in")


def cap_rows(df: DataFrame, key: str, n: int, *, by: str | None = None, seed: int = 0) -> DataFrame:
    """Row cap per source, or over the whole table."""
    return sample_exact(df, key, n, by=[by] if by else [], seed=seed, salt="cap")


def first_wins(df: DataFrame, key: str | Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the first in ``order``."""
    keys = [key] if isinstance(key, str) else list(key)
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rn") <= 1).drop("_rn")


def split_by_list(df: DataFrame, group: str, held_out: Sequence[str]) -> DataFrame:
    """Add ``role``: test for the listed groups, train for the others."""
    return df.withColumn(
        "role", F.when(F.col(group).isin(*held_out), F.lit("test")).otherwise(F.lit("train"))
    )


def require_both_roles(df: DataFrame) -> None:
    """Raise unless the frame has train and test rows."""
    roles = {r["role"] for r in df.select("role").distinct().collect()}
    if roles != {"train", "test"}:
        raise ValueError("the split must hold both train and test rows")


def sample_rows_in_shards(
    df: DataFrame, key: str, *, shard: str = "shard", shards: int, rows: int, seed: int
) -> DataFrame:
    """``rows`` rows from ``shards`` randomly chosen shards.

    On a table partitioned by shard the join prunes all other partitions.
    """
    chosen = (
        df.select(shard)
        .distinct()
        .withColumn("_h", order_key(seed, "shards", shard))
        .orderBy("_h", shard)
        .limit(shards)
        .select(shard)
    )
    names = [r[0] for r in chosen.collect()]
    return sample_exact(df.where(F.col(shard).isin(*names)), key, rows, seed=seed, salt="rows")


def blind_codes(conditions: DataFrame, condition: str, seed: int) -> DataFrame:
    """(condition, code): conditions in seeded order named C01, C02, ..."""
    order = Window.orderBy(order_key(seed, "code", condition), condition)
    number = F.row_number().over(order).cast("string")
    return conditions.select(condition).distinct().withColumn(
        "code", F.concat(F.lit("C"), F.lpad(number, 2, "0"))
    )


def blind_design(
    items: DataFrame, conditions: DataFrame, *, item: str, condition: str, num_items: int, seed: int
) -> DataFrame:
    """Public design: chosen items, each with its own order of condition codes.

    ``conditions`` is the fixed list of compared systems; the codes are one
    array that every item row carries, so no join multiplies the items.
    """
    codes = sorted(r["code"] for r in blind_codes(conditions, condition, seed).collect())
    picked = (
        items.select(item)
        .withColumn("_h", order_key(seed, "item", item))
        .orderBy("_h", item)
        .limit(num_items)
    )
    order = Window.orderBy("_h", item)
    numbered = picked.withColumn("item_no", F.row_number().over(order))
    options = F.array_sort(
        F.array(
            *[
                F.struct(order_key(seed, "option", F.col(item), F.lit(c)).alias("h"), F.lit(c).alias("code"))
                for c in codes
            ]
        )
    )
    out = numbered.withColumn("_o", options).withColumn(
        "item_name", F.concat(F.lit("item_"), F.lpad(F.col("item_no").cast("string"), 3, "0"))
    )
    return out.select(
        "item_name",
        item,
        *[F.col("_o")[i]["code"].alias(f"option_{i + 1}") for i in range(len(codes))],
    )


def common_items(df: DataFrame, item: str, condition: str, digest: str) -> DataFrame:
    """Items present in every condition, with ``same_original`` for equal digests."""
    k = df.select(condition).distinct().count()
    return (
        df.groupBy(item)
        .agg(
            F.count_distinct(condition).alias("n_conditions"),
            (F.min(digest) == F.max(digest)).alias("same_original"),
        )
        .where(F.col("n_conditions") == k)
        .drop("n_conditions")
    )


def with_shared_group_order(df: DataFrame, key: str, group: str, seed: int, salt: str) -> DataFrame:
    """Add ``q``: the row's place inside its group in seeded order."""
    hashed = df.withColumn("_h", order_key(seed, salt, key))
    return with_position(hashed, "_h", [key], group=[group], name="q", digits=2).drop("_h")
