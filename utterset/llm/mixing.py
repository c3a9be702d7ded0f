"""Mixing sources to target weights by pivotal dependent rounding.

A source's target divided by its size is the number of copies that each of its
documents should have.  The whole part is given to all of them; the fractions are
rounded together: two documents meet, mass (words times fraction) moves from one
to the other in a random direction until one fraction is 0 or 1, and the other
document goes on.  Every step keeps the source's expected words exactly and each
document's chance unchanged; only the last document of a source is rounded.

Documents of like size (a power of two) meet in small hashed nodes of a tree
(``NODE`` on average), inside one array expression; what is left of a node goes to
its parent.  A level holds a ``NODE``-th of the level below, and a source with a
third of all rows just has more nodes.  One node of each size class waits for the
source's last meeting, from the largest to the smallest, so that the document
that is left over in the end is a small one.  All draws are hashes of seed, level
and ids, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utterset.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
NODE = 32
MOST_COPIES = 3


def n_words(text: Column | str) -> Column:
    """Number of words; zero for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, most: float = MOST_COPIES, period: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources in code-point order, null last, weigh 1, 2, .. ``period``, repeating,
    and share the sum of all sizes.  A target stops at ``most`` times its source's
    size; the excess goes to the others by weight until none is above.  With
    sources in the order of cap per weight, the capped ones are a prefix, so one
    running sum over the table of sources finds the common factor.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weighed = sizes.select(
        "source",
        "source_size",
        (F.pmod(F.row_number().over(by_name) - 1, F.lit(period)) + 1).cast("double").alias("weight"),
        (F.col("source_size") * float(most)).alias("cap"),
    )
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    tried = weighed.withColumn(
        "factor",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / F.sum("weight").over(onward),
    )
    fits = F.when(F.col("factor") * F.col("weight") <= F.col("cap"), F.col("factor"))
    # the first that fits has the greatest fitting factor; none fits only if all are at their caps
    found = F.coalesce(F.max(fits).over(everything), F.lit(float("inf")))
    return tried.select(
        "source",
        "source_size",
        F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least("cap", found * F.col("weight"))).alias("target"),
    )


def _uniform(*keys: Column) -> Column:
    """Double in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") / F.lit(float(1 << 53))


def _meet(level: int, seed: int):
    """Fold step: the document carried on and the next one exchange mass until one is settled."""

    def step(acc: Column, b: Column) -> Column:
        a = acc["carry"]
        ratio = b["mass"] / a["mass"]
        up = F.least(1 - a["p"], b["p"] * ratio)
        down = F.least(a["p"], (1 - b["p"]) * ratio)
        draw = _uniform(F.lit(seed), F.lit(level), a["doc_id"], a["size"], b["doc_id"], b["size"])
        rising = draw * (up + down) < down

        def settle(x: Column) -> Column:
            first_done = F.when(x["rising"], 1 - a["p"] <= b["p"] * ratio).otherwise(a["p"] <= (1 - b["p"]) * ratio)
            new_a = F.when(x["rising"], F.least(F.lit(1.0), a["p"] + b["p"] * ratio)).otherwise(
                F.greatest(F.lit(0.0), a["p"] - (1 - b["p"]) * ratio)
            )
            new_b = F.when(x["rising"], F.greatest(F.lit(0.0), b["p"] - (1 - a["p"]) / ratio)).otherwise(
                F.least(F.lit(1.0), b["p"] + a["p"] / ratio)
            )
            took = F.when(first_done == x["rising"], F.lit(1)).otherwise(F.lit(0))

            def moved(who: Column, p: Column) -> Column:
                return who.withField("p", p)

            def settled(who: Column) -> Column:
                return F.struct(who["doc_id"].alias("doc_id"), who["size"].alias("size"), took.alias("took"))

            return F.struct(
                F.when(first_done, moved(b, new_b)).otherwise(moved(a, new_a)).alias("carry"),
                F.array_append(acc["done"], F.when(first_done, settled(a)).otherwise(settled(b))).alias("done"),
            )

        return F.transform(F.array(F.struct(rising.alias("rising"))), settle)[0]

    return step


def _empty_done() -> Column:
    return F.array().cast("array<struct<doc_id:bigint,size:bigint,took:int>>")


def _fold(rows: DataFrame, keys: list[str], level: int, seed: int) -> DataFrame:
    """Let the units of each group meet, largest first: (keys, out.carry, out.done)."""
    grouped = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("unit")).alias("units"))
    start = F.struct(F.col("units")[0].alias("carry"), _empty_done().alias("done"))
    met = F.aggregate(F.slice("units", 2, F.size("units")), start, _meet(level, seed))
    return cut_lineage(grouped.select(*keys, met.alias("out")), "rounded")


def _done(folded: DataFrame) -> DataFrame:
    return folded.select("source_no", F.explode("out.done").alias("d")).select("source_no", "d.*")


def rounded(units: DataFrame, seed: int) -> DataFrame:
    """(source_no, doc_id, size, took) for units (source_no, doc_id, size, mass, p), 0 < p < 1, mass > 0.

    The number of levels grows with the logarithm of the largest class.
    """
    tie = F.xxhash64(F.lit(seed), "doc_id", "size")
    unit = F.struct((-F.col("mass")).alias("order"), tie.alias("tie"), "doc_id", "size", "mass", "p").alias("unit")
    classed = units.select("source_no", F.floor(F.log2("mass")).alias("likeness"), unit)
    counts = classed.groupBy("source_no", "likeness").agg(F.ceil(F.count("*") / NODE).cast("long").alias("nodes"))
    placed = cut_lineage(
        classed.join(counts, ["source_no", "likeness"]).withColumn("node", F.pmod("unit.tie", F.col("nodes"))), "placed"
    )
    waiting = placed.where("node = 0").select("source_no", "unit")
    level_rows, level, parts = placed.where("node > 0"), 0, []
    while level_rows.take(1):
        folded = _fold(level_rows, ["source_no", "likeness", "node", "nodes"], level, seed)
        parts.append(_done(folded))
        over = folded.select("source_no", "likeness", "node", "nodes", F.col("out.carry").alias("unit"))
        up = F.ceil(F.col("nodes") / NODE).cast("long")
        level_rows = over.where("nodes > 1").withColumn("node", F.floor(F.col("node") / NODE)).withColumn("nodes", up)
        waiting = waiting.unionByName(over.where("nodes = 1").select("source_no", "unit"))
        level += 1
    last = _fold(waiting, ["source_no"], level, seed)
    took = F.when(F.col("out.carry.p") >= 0.5, 1).otherwise(0).alias("took")
    out = _done(last).unionByName(last.select("source_no", "out.carry.doc_id", "out.carry.size", took))
    for part in parts:
        out = out.unionByName(part)
    return out


def mix_units(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17
) -> DataFrame:
    """(doc_id, source, size, n_rows, source_size, target, copies), one row per distinct id, source and size.

    Rows that agree in id, source and size (repeated rows) are one unit of
    ``n_rows`` rows that get the same number of copies.  Null ids and null
    sources are values of their own; texts without words, null included, have no
    mass: they get the whole part of their source's copies.  Other columns are ignored.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        n_words(F.col(text).cast("string")).alias("size"),
    )
    units = cut_lineage(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n_rows")), "units")
    sums = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("source_size"))
    number = F.xxhash64(F.col("source").isNull(), "source").alias("source_no")
    numbered = cut_lineage(targets(sums).select(number, F.col("source").alias("s"), "source_size", "target"), "targets")
    share = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(
        F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST_COPIES)))
    )
    placed = units.join(numbered, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    placed = placed.withColumn("whole", F.floor(share)).withColumn("p", share - F.floor(share))
    open_ = placed.where("p > 0 and size > 0").withColumn("mass", (F.col("size") * F.col("n_rows")).cast("double"))
    took = rounded(open_.select("source_no", "doc_id", "size", "mass", "p"), seed).select(
        F.col("source_no").alias("k1"), F.col("doc_id").alias("k2"), F.col("size").alias("k3"), "took"
    )
    same = (
        (F.col("source_no") == F.col("k1")) & F.col("doc_id").eqNullSafe(F.col("k2")) & (F.col("size") == F.col("k3"))
    )
    return placed.join(took, same, "left").select(
        "doc_id", "source", "size", "n_rows", "source_size", "target",
        (F.col("whole") + F.coalesce("took", F.lit(0))).cast("int").alias("copies"),
    )


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), one row per row of ``docs``."""
    units = mix_units(docs, doc_id, text, source, seed)
    each = units.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
    return each.select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def mixed_rows(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17
) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it has copies, with all its columns."""
    units = mix_units(docs, doc_id, text, source, seed).where("copies > 0").select(
        F.col("doc_id").alias("k1"), F.col("source").alias("k2"), F.col("size").alias("k3"), "copies"
    )
    rows = docs.select(
        F.struct("*").alias("row"),
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        n_words(F.col(text).cast("string")).alias("size"),
    )
    same = (
        F.col("doc_id").eqNullSafe(F.col("k1")) & F.col("source").eqNullSafe(F.col("k2")) & (F.col("size") == F.col("k3"))
    )
    return rows.join(units, same).select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("again")).select("row.*")
