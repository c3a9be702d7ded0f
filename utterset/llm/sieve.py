"""A fixed-size sieve of hash values, to leave rows out before an exact join.

The sieve is a bit set of ``2 ** BITS`` bits with two bits per value.  It never
says no to a value that was put in; a row that it lets through by chance is left out
by the join behind it.  Its size does not depend on the data: with very many values
it only lets more through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterset.llm.streams import by_group

BITS = 24  # 2 MiB on the driver and in every worker
LARGE = 27  # 16 MiB
PART = 13  # a larger sieve comes to the driver in blocks of 2 ** PART words
SECOND = 31  # the second bit comes from this place of the value


def _blocks(table: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
    """One row (part, block) for the words of each part of (part, word, bits)."""
    part, word, bits = (table.column(c).to_numpy() for c in ("part", "word", "bits"))
    blocks = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        block = np.zeros(1 << PART, dtype=np.int64)
        block[word[a:b] & ((1 << PART) - 1)] = bits[a:b]
        blocks.append(block.tobytes())
    return pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]]), pa.array(blocks, pa.binary())], names=["part", "block"])


def make_sieve(values: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """Words of the bit set of a column of 64-bit hashes."""
    mask = (1 << bits) - 1
    value = F.col(column)
    places = F.array(value.bitwiseAND(F.lit(mask)), F.shiftrightunsigned(value, SECOND).bitwiseAND(F.lit(mask)))
    bit = values.select(F.explode(places).alias("p")).select(
        F.shiftright("p", 6).alias("word"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit")
    )
    rows = bit.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    words = np.zeros(1 << (bits - 6), dtype=np.uint64)
    if bits > BITS:
        parts = by_group(rows.withColumn("part", F.shiftright("word", PART)), ["part"], _blocks, "part long, block binary")
        for row in parts.toLocalIterator():
            words[row["part"] << PART : (row["part"] + 1) << PART] = np.frombuffer(row["block"], dtype=np.uint64)
        return words
    # at most 2 ** (bits - 6) rows reach the driver
    rows = rows.toPandas()
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return words


def lets_through(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each 64-bit value may have been put in."""
    mask = np.uint64(len(words) * 64 - 1)
    passed = np.ones(len(values), dtype=bool)
    for place in (values & mask, (values >> np.uint64(SECOND)) & mask):
        passed &= (words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) != 0
    return passed
