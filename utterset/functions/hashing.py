"""Seeded hash order: the reproducible replacement for a random stream.

A row's place in a shuffle, or a draw's outcome, is a function of
``(seed, salt, key)`` only.  It does not depend on partitioning, task retries or
cluster size, and any SQL engine with ``md5`` gives the same answer.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_SPACE = 2.0**32


def order_key(seed: int, salt: str, *keys: Column | str) -> Column:
    """32 hexadecimal digits that order rows like a seeded shuffle."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), *[p.cast("string") for p in parts]))


def draw_index(key: Column, n: Column | int) -> Column:
    """Uniform integer in ``[0, n)`` from the first 32 bits of an order key."""
    size = F.lit(n) if isinstance(n, int) else n
    return F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), size.cast("long"))


def _sixty_bits(key: Column, start: int) -> Column:
    return F.conv(F.substring(key, start, 15), 16, 10).cast("long")


def key_words(key: Column) -> tuple[Column, Column]:
    """The two 60-bit words of an order key."""
    return _sixty_bits(key, 1), _sixty_bits(key, 16)


ROUNDS, WALKS = 4, 24


def permuted_rank(x: Column, space: int, seed: int, salt: str) -> Column:
    """Image of ``x`` under a seeded permutation of ``[0, space)``.

    A Feistel network over pairs (a, b) of a rectangle that holds the ranks: each
    round adds to one side a hash of the other, modulo its length.  An image outside
    the ranks is permuted again; the rectangle has less than one more row than
    needed, so that happens to one in about sqrt(space).
    """
    rows = int(space**0.5) + 1
    width = -(-space // rows)

    def step(acc: Column, i: Column) -> Column:
        turn = F.pmod(i, F.lit(ROUNDS))
        even = F.pmod(turn, F.lit(2)) == 0
        other = F.when(even, acc["b"]).otherwise(acc["a"])
        word = draw_index(order_key(seed, salt, turn, other), 1 << 30)
        a = F.when(even, F.pmod(acc["a"] + word, F.lit(rows))).otherwise(acc["a"])
        b = F.when(even, acc["b"]).otherwise(F.pmod(acc["b"] + word, F.lit(width)))
        moved = F.struct(a.alias("a"), b.alias("b"), ((turn == ROUNDS - 1) & (a * width + b < space)).alias("done"))
        return F.when(acc["done"], acc).otherwise(moved)

    start = F.struct(
        F.floor(x / F.lit(width)).cast("long").alias("a"), F.pmod(x, F.lit(width)).cast("long").alias("b"), F.lit(False).alias("done")
    )
    last = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS * WALKS - 1)), start, step)
    out = F.transform(F.array(last), lambda y: F.when(y["done"], y["a"] * width + y["b"]).otherwise(F.raise_error(F.lit("no image")).cast("long")))
    return out[0]


def draw_uniform(key: Column, offset: int = 1) -> Column:
    """Uniform double strictly inside (0, 1) from eight digits of an order key."""
    digits = F.conv(F.substring(key, offset, 8), 16, 10).cast("double")
    return (digits + F.lit(0.5)) / F.lit(WORD_SPACE)


def draw_normal(key: Column) -> Column:
    """Standard normal draw (Box-Muller on two uniforms of one order key)."""
    radius = F.sqrt(F.lit(-2.0) * F.log(draw_uniform(key, 1)))
    return radius * F.cos(F.lit(6.283185307179586) * draw_uniform(key, 9))


def member_key(sample_id: Column) -> Column:
    """Path-safe member name of a sample."""
    return F.sha2(sample_id, 256)


def sample_id(dataset: Column, row_id: Column, anonymous: Column) -> Column:
    """``dataset:id``, or ``dataset:sha256:<digest of the row>`` without an ID."""
    name = F.coalesce(F.nullif(dataset.cast("string"), F.lit("")), F.lit("unknown"))
    given = F.nullif(row_id.cast("string"), F.lit(""))
    return F.when(given.isNotNull(), F.concat_ws(":", name, given)).otherwise(
        F.concat_ws(":", name, F.lit("sha256"), F.sha2(anonymous, 256))
    )


def positional_item_id(index: Column, path: Column) -> Column:
    """``item_<six digits>_<12 hex digits of the path digest>``."""
    # lpad would cut indices beyond six digits
    number = index.cast("string")
    padded = F.when(F.length(number) >= 6, number).otherwise(F.lpad(number, 6, "0"))
    return F.concat(F.lit("item_"), padded, F.lit("_"), F.substring(F.sha2(path, 256), 1, 12))


def fingerprint_words(row: Column) -> list[Column]:
    """Four 32-bit words of a row digest as decimals, ready to be summed."""
    digest = F.sha2(row, 256)
    return [
        F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)") for i in range(4)
    ]
