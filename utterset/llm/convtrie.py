"""Prefix trie of conversations by the van Emde Boas recursion.

Every conversation is a sequence of turns; a node of the trie is a distinct
prefix.  A sequence is never held whole by a task: it is one narrow row per turn.

1. Equal sequences are one sequence with a number of copies.
2. Going down, every block of 2^j turns is cut at half its depth.  The first half
   is named by the xor of its turns' hashes (a hash covers the position too, so
   the xor tells the order), joined to the name of the forest the block grows in.
   That name is the forest of the second half.  Upper tries and lower forests
   are cut again in the same pass, so log2(longest) passes reach blocks of one turn,
   which are the nodes: the forest is the parent.
3. Going up, pass j grafts: each lower forest's totals are summed at the cut
   prefix that bears it and given to that prefix's ancestors inside the upper half.
   After pass j a node holds the totals of its subtree within its block of 2^j.

A conversation with a third of all rows, a first turn that all share and a large
group of copies are all spread: aggregates combine in the map tasks, and the joins
have one row per key on one side.  Names have 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utterset.session import Scratch

ROWS_PER_RANGE = 100_000
NOTHING = hashlib.sha256(b"").hexdigest()


def ordered_turns(
    conversations: DataFrame,
    scratch: Scratch,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """(conv, at, a, b, chars): turns numbered from 0 per conversation, named by two hashes of role and text.

    The order is turn (null first), then role, then text; null role or text is
    empty.  Rows without a conversation id take no part.  Each repeated row is a
    turn.  A conversation may span tasks: rows are cut into ranges of the order,
    and counts of (conversation, range) give each range its first number.
    """
    named = conversations.select(
        F.col(conv_id).cast("long").alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    ).where("conv is not null")
    ranges = max(8, -(-named.count() // ROWS_PER_RANGE))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    # equal rows are counted first: no range can part them
    once = named.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    laid = once.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    fixed = scratch.keep(
        laid.select(
            "conv", "n", F.monotonically_increasing_id().alias("place"), F.xxhash64("role", "text").alias("a"),
            F.xxhash64("text", F.lit("turn"), "role").alias("b"), F.length("text").cast("long").alias("chars"),
        ),
        "turns",
    )
    # the upper bits of the place are the range's number
    marked = fixed.withColumn("part", F.shiftright("place", 33))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = marked.groupBy("conv", "part").agg(F.sum("n").alias("n")).select(
        "conv", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    inside = Window.partitionBy("conv", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    first = marked.join(starts, ["conv", "part"]).withColumn(
        "first", F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    )
    return first.select(
        "conv", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("at"), "a", "b", "chars"
    )


def share_heads(turns: DataFrame, lengths: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """Turns of rebuilt conversations: the first h turns of a shared one, then the own turns after the first h.

    The shared conversation of c is c - c % every (remainders have the sign of c),
    h is crc32(c) % heads; a shared conversation that is absent gives no turns.
    ``pos`` is the number of a turn in the rebuilt conversation.
    """
    plan = lengths.select(
        "conv",
        F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(heads)).alias("h"),
        (F.col("conv") - F.col("conv") % F.lit(every)).alias("base"),
    )
    known = lengths.select(F.col("conv").alias("base"), F.col("length").alias("base_length"))
    plan = plan.join(known, "base", "left").withColumn("shared", F.least("h", F.coalesce("base_length", F.lit(0))))
    own = turns.join(plan.select("conv", "h", "shared"), "conv").where("at >= h")
    own = own.select("conv", (F.col("at") - F.col("h") + F.col("shared")).alias("pos"), "a", "b", "chars")
    first = turns.where(F.col("at") < heads).withColumnRenamed("conv", "base")
    lent = plan.where("shared > 0").select("conv", "base", "h").join(first, "base").where("at < h")
    return own.unionByName(lent.select("conv", F.col("at").alias("pos"), "a", "b", "chars"))


def _xor(column: str, name: str) -> Column:
    return F.bit_xor(column).alias(name)


def _cut_down(rows: DataFrame, levels: int, scratch: Scratch) -> DataFrame:
    """Adds the name (f1, f2) of the prefix before each turn: blocks are halved ``levels`` times."""
    rows = rows.select("*", F.lit(0).cast("long").alias("f1"), F.lit(0).cast("long").alias("f2"))
    for level in range(levels, 0, -1):
        half = 1 << (level - 1)
        marked = rows.withColumn("block", F.shiftright("pos", level))
        is_lower = F.col("pos").bitwiseAND(F.lit(half).cast("long")) != 0
        upper, lower = marked.where(~is_lower), marked.where(is_lower)
        cuts = upper.groupBy("conv", "block").agg(_xor("h1", "x1"), _xor("h2", "x2"))
        grown = lower.join(cuts, ["conv", "block"])
        grown = grown.withColumn("f1", F.col("f1").bitwiseXOR(F.col("x1"))).withColumn(
            "f2", F.col("f2").bitwiseXOR(F.col("x2"))
        )
        columns = rows.columns
        halved = scratch.keep(upper.select(columns).unionByName(grown.select(columns)), "halves")
        scratch.drop(rows)
        rows = halved
    return rows


def _graft_up(nodes: DataFrame, path: DataFrame, levels: int, scratch: Scratch) -> DataFrame:
    """Turns own ``leaves`` and ``saved`` into sums over subtrees; ``path`` has each turn's node."""
    for level in range(1, levels + 1):
        half, block = 1 << (level - 1), 1 << level
        forests = nodes.where((F.col("depth") - 1).bitwiseAND(F.lit(block - 1).cast("long")) == half)
        cuts = forests.groupBy(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("cut")).agg(
            F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")
        )
        cuts = cuts.withColumn("stretch", F.shiftright(F.col("cut") - 1, level - 1))
        above = path.withColumn("stretch", F.shiftright("pos", level - 1)).join(cuts, ["conv", "stretch"])
        more = above.groupBy(F.col("node").alias("conv_id"), (F.col("pos") + 1).alias("depth")).agg(
            F.sum("more_leaves").alias("more_leaves"), F.sum("more_saved").alias("more_saved")
        )
        grown = nodes.join(more, ["conv_id", "depth"], "left")
        for name in ("leaves", "saved"):
            grown = grown.withColumn(name, F.col(name) + F.coalesce(f"more_{name}", F.lit(0)))
        grafted = scratch.keep(grown.select(nodes.columns), "grafts")
        scratch.drop(nodes)
        nodes = grafted
    return nodes


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each group's ids, fed batch by batch: a group is never held."""
    group, digest = None, hashlib.sha256()
    for batch in batches:
        done: list[tuple[int, int, str]] = []
        for conv_id, depth, member in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (conv_id, depth) != group:
                if group is not None:
                    done.append((*group, digest.hexdigest()))
                group, digest = (conv_id, depth), hashlib.sha256(str(member).encode())
            else:
                digest.update(b",%d" % member)
        yield _digest_rows(done)
    if group is not None:
        yield _digest_rows([(*group, digest.hexdigest())])


def _digest_rows(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
    types = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["conv_id", "depth", "ends_sha256"]
    )


def ends_digest(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) from (conv_id, depth, member): members ascending, joined by commas.

    A SHA-256 can only be made in order, so the members of one node pass through
    one task; they do so as a sorted stream of ids in constant memory.
    """
    keys = ["conv_id", "depth"]
    laid = ends.select(*keys, "member").repartition(*keys).sortWithinPartitions(*keys, "member")
    return laid.mapInArrow(_digests, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(sequences: DataFrame, everyone: DataFrame, scratch: Scratch) -> DataFrame:
    """The trie's nodes with members, children, leaves, saved tokens and a digest of the ends.

    ``sequences`` has (conv, pos, a, b, chars), positions from 0 without gaps;
    ``everyone`` has (conv), one row per conversation, turnless ones included.  A
    node is told by its least member ``conv_id`` and its ``depth``.  Without
    conversations there is no node, not even a root.
    """
    rows = scratch.keep(
        sequences.select(
            "conv", "pos", F.xxhash64("pos", "a").alias("h1"), F.xxhash64("b", F.lit("at"), "pos").alias("h2"), "chars"
        ),
        "sequences",
    )
    whole = rows.groupBy("conv").agg(_xor("h1", "x1"), _xor("h2", "x2"), F.count(F.lit(1)).alias("length"))
    whole = scratch.keep(whole, "whole")
    distinct = whole.groupBy("x1", "x2", "length").agg(F.min("conv").alias("first"), F.count(F.lit(1)).alias("copies"))
    distinct = scratch.keep(distinct, "distinct")
    once = rows.join(distinct.select(F.col("first").alias("conv"), "copies"), "conv")
    longest = whole.agg(F.max("length")).first()[0] or 0
    levels = max(0, (longest - 1).bit_length())
    least, members = everyone.agg(F.min("conv"), F.count(F.lit(1))).first()

    named = _cut_down(once, levels, scratch)
    prefix = named.select(
        "*", F.col("f1").bitwiseXOR(F.col("h1")).alias("n1"), F.col("f2").bitwiseXOR(F.col("h2")).alias("n2")
    )
    made = scratch.keep(
        prefix.groupBy("n1", "n2", "pos").agg(
            F.min("conv").alias("conv_id"), F.sum("copies").alias("n_convs"), F.max("chars").alias("chars"),
            F.min("f1").alias("f1"), F.min("f2").alias("f2"),
        ),
        "nodes",
    )
    path = prefix.select("conv", "pos", "n1", "n2").join(
        made.select("n1", "n2", "pos", F.col("conv_id").alias("node")), ["n1", "n2", "pos"]
    )
    path = scratch.keep(path.select("conv", "pos", "node"), "path")
    parents = made.select(
        F.col("n1").alias("f1"), F.col("n2").alias("f2"), (F.col("pos") + 1).alias("pos"), F.col("conv_id").alias("parent")
    )
    kin = made.join(parents, ["f1", "f2", "pos"], "left").select(
        "conv_id", (F.col("pos") + 1).alias("depth"),
        F.when(F.col("pos") == 0, F.lit(least)).otherwise(F.col("parent")).alias("parent"), "n_convs",
        ((F.col("n_convs") - 1) * F.col("chars")).alias("own_saved"),
    )
    born = kin.groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    nodes = kin.join(born, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "parent", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.when(F.col("n_children").isNull(), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("leaves"),
        F.col("own_saved").alias("saved"),
    )
    nodes = _graft_up(scratch.keep(nodes, "kin"), path, levels, scratch)

    top = nodes.where("depth = 1").agg(
        F.count(F.lit(1)).alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
    )
    root = top.select(
        F.lit(least).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"),
        F.lit(None).cast("long").alias("parent"), F.lit(members).cast("long").alias("n_convs"), "n_children",
        F.coalesce("leaves", F.lit(1)).alias("leaves"), F.coalesce("saved", F.lit(0)).alias("saved"),
    ).where(F.lit(members) > 0)

    named = whole.join(distinct.select("x1", "x2", "length", "first"), ["x1", "x2", "length"])
    last = named.select(F.col("conv").alias("member"), F.col("first").alias("conv"), (F.col("length") - 1).alias("pos"))
    ends = last.join(path, ["conv", "pos"]).select(F.col("node").alias("conv_id"), (F.col("pos") + 1).alias("depth"), "member")
    turnless = everyone.join(whole, "conv", "left_anti").select(
        F.lit(least).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.col("conv").alias("member")
    )
    digests = ends_digest(ends.unionByName(turnless))
    return (
        nodes.unionByName(root)
        .join(digests, ["conv_id", "depth"], "left")
        .select(
            "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
            F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
        )
    )


def shared_prefix_trie(conversations: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """The trie of all conversations, rebuilt on shared heads (see ``share_heads``)."""
    scratch = Scratch(conversations.sparkSession, "trie")
    turns = scratch.keep(ordered_turns(conversations, scratch), "numbered")
    lengths = scratch.keep(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("length")), "lengths")
    return prefix_trie(share_heads(turns, lengths, every, heads), lengths.select("conv"), scratch)


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all conversations as they stand."""
    scratch = Scratch(conversations.sparkSession, "trie")
    turns = scratch.keep(ordered_turns(conversations, scratch), "numbered")
    return prefix_trie(turns.withColumnRenamed("at", "pos"), turns.select("conv").distinct(), scratch)
