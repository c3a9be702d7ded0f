"""Sharding by histogram sort: near-equal bytes, equal texts together.

Rows are ordered by a 63-bit hash of the text and, inside one text, by a hash of
the id; rows equal in both are numbered, and the number goes into the hash.  For each of the wanted boundaries a probe interval of hash values is
kept; every round counts, over all partitions, the exact bytes that fall between
evenly spaced probes of the open intervals and keeps the one part that holds the
boundary.  A boundary is settled as soon as some probe is within the tolerance,
so a group of equal texts is not split unless it is larger than that; where it
must be, the interval goes on inside the group, over the ids' hashes.  The rows
are exchanged once, when the boundaries are known.

The driver sees counts only: at most ``PROBES`` numbers per boundary and round.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utterset.session import cut_lineage

KEY_BITS = 63
PROBE_BITS = 8
PROBES = 1 << PROBE_BITS
RUN_ROWS = 50_000


@dataclass
class _Open:
    """An unsettled boundary: bytes wanted before it, the interval that holds it, bytes before the interval."""

    wanted: float
    group: int | None  # hash of the text, once the interval is inside one group
    low: int
    bits: int  # the interval has 2**bits values
    before: int


def _hash63(*values: Column | str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*values), 1)


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, group_key, row_key); null texts have one byte of size, like empty ones."""
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.octet_length(value) + 1).cast("long").alias("size"),
        F.crc32(value.cast("binary")).alias("text_crc32"),
        _hash63(value).alias("group_key"),
        _hash63(F.lit("row"), F.col(doc_id).cast("long")).alias("row_key"),
    )


def _spread_repeats(rows: DataFrame) -> DataFrame:
    """Rows equal in both keys get a row key each, from their number among their like.

    Numbers are places in a written part plus the counts of the parts before, so no
    task numbers more than its part of a hot row; equal rows are interchangeable.
    """
    keys = ["group_key", "row_key"]
    marked = rows.withColumn("place", F.monotonically_increasing_id())
    fixed = cut_lineage(marked.withColumn("part", F.shiftright("place", 33)), "keys")
    again = fixed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(keys)
    if again.isEmpty():
        return fixed.drop("place", "part")
    again = cut_lineage(again, "repeats")
    hot = fixed.join(again, keys, "left_semi")
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = hot.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select(*keys, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy(*keys, "part").orderBy("place")
    numbered = hot.withColumn("within", F.row_number().over(inside) - 1).join(starts, [*keys, "part"])
    number = F.col("start") + F.col("within")
    apart = numbered.withColumn(
        "row_key", F.when(number == 0, F.col("row_key")).otherwise(_hash63(F.lit("again"), "row_key", number))
    )
    return fixed.join(again, keys, "left_anti").select(rows.columns).unionByName(apart.select(rows.columns))


def _counted(rows: DataFrame, opened: list[_Open]) -> dict[tuple[int | None, int], dict[int, int]]:
    """Exact bytes of each part of each distinct open interval."""
    intervals = list(dict.fromkeys((o.group, o.low, o.bits) for o in opened))
    where, part = F.lit(None).cast("int"), F.lit(None).cast("long")
    for number, (group, low, bits) in reversed(list(enumerate(intervals))):
        key = F.col("group_key") if group is None else F.col("row_key")
        inside = (key >= low) & (key <= low + (1 << bits) - 1)
        if group is not None:
            inside = inside & (F.col("group_key") == group)
        where = F.when(inside, F.lit(number)).otherwise(where)
        shift = max(0, bits - PROBE_BITS)
        part = F.when(inside, F.shiftright(key - F.lit(low), shift)).otherwise(part)
    found = rows.select(where.alias("interval"), part.alias("part"), "size").where("interval is not null")
    counts: dict = {(group, low): {} for group, low, _ in intervals}
    for row in found.groupBy("interval", "part").agg(F.sum("size").alias("bytes")).collect():
        group, low, _ = intervals[row["interval"]]
        counts[group, low][row["part"]] = row["bytes"]
    return counts


def splitters(rows: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """``shards - 1`` ascending boundaries (group_key, row_key); a row at or above one is behind it.

    ``tolerance`` is the permitted distance from the wanted bytes, as a part of
    one shard's bytes.  Nested hot groups are the only case that goes on to ids.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    allowed = tolerance * total / shards
    done: dict[float, tuple[int, int]] = {}
    opened = [_Open(total * k / shards, None, 0, KEY_BITS, 0) for k in range(1, shards)]
    while opened:
        counts = _counted(rows, opened)
        left = []
        for o in opened:
            shift = max(0, o.bits - PROBE_BITS)
            run, holding, held_from = o.before, None, o.before
            best, best_at = abs(o.before - o.wanted), o.low
            for part, size in sorted(counts[o.group, o.low].items()):
                if run <= o.wanted and (run + size > o.wanted or holding is None):
                    holding, held_from = part, run
                run += size
                if abs(run - o.wanted) < best:
                    best, best_at = abs(run - o.wanted), o.low + (part + 1 << shift)
            if best <= allowed or holding is None or (shift == 0 and o.group is not None):
                # nearest probe; one row's hash cannot be split any further
                done[o.wanted] = (best_at, 0) if o.group is None else (o.group, best_at)
            elif shift == 0:
                left.append(_Open(o.wanted, o.low + holding, 0, KEY_BITS, held_from))
            else:
                left.append(_Open(o.wanted, o.group, o.low + (holding << shift), shift, held_from))
        opened = left
    return [done[w] for w in sorted(done)]


def shard(
    docs: DataFrame, shards: int = 16, tolerance: float = 0.01, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row of ``docs``.

    ``shard`` follows the boundaries, ``slot`` counts the shard's rows from 0
    without gaps: rows are numbered inside short key ranges, which are laid end
    to end by their counts.  Null and empty texts are one group; equal rows, null ids
    included, are numbered and may lie in any shards; an empty table gives an empty table.
    """
    rows = cut_lineage(_spread_repeats(keyed(docs, doc_id, text)), "spread-keys")
    cuts = splitters(rows, shards, tolerance)
    number = F.lit(0)
    for group, row in cuts:
        behind = (F.col("group_key") > group) | ((F.col("group_key") == group) & (F.col("row_key") >= row))
        number = number + behind.cast("int")
    placed = rows.withColumn("shard", number)
    total = rows.count()
    # ranges of text hashes hold about RUN_ROWS rows; a range with more, of one hot text, is dealt by id hash
    bits = max(1, min(40, (max(1, total // RUN_ROWS) * 4).bit_length()))
    placed = placed.withColumn("run", F.shiftright("group_key", KEY_BITS - bits))
    runs = placed.groupBy("shard", "run").agg(F.count("*").alias("n"))
    runs = cut_lineage(runs.withColumn("pieces", F.ceil(F.col("n") / RUN_ROWS).cast("long")), "runs")
    dealt = placed.join(runs.select("shard", "run", "pieces"), ["shard", "run"]).withColumn(
        "piece", F.pmod("row_key", F.col("pieces"))
    )
    counts = dealt.groupBy("shard", "run", "piece").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("shard").orderBy("run", "piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "shard", "run", "piece", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start")
    )
    starts = cut_lineage(starts, "starts")
    inside = Window.partitionBy("shard", "run", "piece").orderBy("group_key", "row_key", "doc_id", "size", "text_crc32")
    numbered = dealt.withColumn("within", F.row_number().over(inside) - 1)
    return numbered.join(starts, ["shard", "run", "piece"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("within")).cast("long").alias("slot")
    )


def write_shards(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", **how) -> None:
    """Write all columns of ``docs``, one folder ``shard=k`` per shard, rows with their slot.

    Rows are matched with their place by id, size and checksum; of equal rows each takes one place.
    """
    placed = shard(docs, doc_id=doc_id, text=text, **how)
    match = ["doc_id", "size", "text_crc32"]
    turn = F.row_number().over(Window.partitionBy(*match).orderBy("slot"))
    places = placed.withColumn("turn", turn).select(*[F.col(c).alias(f"place_{c}") for c in placed.columns], F.col("turn").alias("place_turn"))
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.struct("*").alias("row"),
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.octet_length(value) + 1).cast("long").alias("size"),
        F.crc32(value.cast("binary")).alias("text_crc32"),
    ).withColumn("turn", F.row_number().over(Window.partitionBy(*match).orderBy(F.lit(0))))
    same = F.lit(True)
    for c in (*match, "turn"):
        same = same & F.col(c).eqNullSafe(F.col(f"place_{c}"))
    out = rows.join(places, same).select("row", F.col("place_slot").alias("slot"), F.col("place_shard").alias("shard"))
    out.write.partitionBy("shard").parquet(path)
