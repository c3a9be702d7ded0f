"""Words and word shingles of an Arrow batch as flat NumPy arrays.

A word is a maximal run of bytes other than space and ``\\t``..``\\r``; a word's
64-bit hash is a polynomial over its bytes, taken from one cumulated sum over
the buffer, so no Python string is made.  Texts are worked on in pieces of about
a megabyte; a longer text is a piece of its own.  Equal words have equal hashes
in every text, task and run.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15
WORD_64 = (1 << 64) - 1


class Words(NamedTuple):
    """Words of some rows: row ``first + i`` owns words ``cuts[i]`` to ``cuts[i + 1]``.

    ``starts`` and ``ends`` are byte offsets inside the row's text.
    """

    first: int
    cuts: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def mix(values: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits (one to one)."""
    out = values ^ (values >> np.uint64(32))
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xCA5A826395121157)
    out ^= out >> np.uint64(32)
    return out


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, PIECE_BYTES + 1)
        made = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        if n > PIECE_BYTES + 1:  # one very long text: do not keep its table
            return made[0], made[1]
        _POWERS[:] = made
    return _POWERS[0][:n], _POWERS[1][:n]


def _piece(data: np.ndarray, cuts: np.ndarray, first: int) -> Words:
    n = len(data)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return Words(first, np.zeros(len(cuts), dtype=np.int64), np.zeros(0, dtype=np.uint64), none, none)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    opens = np.zeros(n + 1, dtype=bool)  # a row begins here
    opens[cuts] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | opens[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | opens[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    power, inverse = _powers(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts])
    word_cuts = np.searchsorted(starts, cuts)
    own = np.repeat(cuts[:-1], np.diff(word_cuts))
    return Words(first, word_cuts, hashes, starts - own, ends - own)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows are empty."""
    column = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets


def words_of(column: pa.Array, piece_bytes: int = PIECE_BYTES) -> Iterator[Words]:
    """Words of all rows, in pieces of whole rows."""
    if not len(column):
        return
    data, offsets = text_buffers(column)
    row = 0
    while row < len(offsets) - 1:
        stop = int(np.searchsorted(offsets, offsets[row] + piece_bytes, side="right")) - 1
        stop = min(max(stop, row + 1), len(offsets) - 1)
        cuts = offsets[row : stop + 1] - offsets[row]
        yield _piece(data[offsets[row] : offsets[stop]], cuts, row)
        row = stop


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words of a flat array (runs may cross rows)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    factor = 1
    for i in range(width):
        out += hashes[i : i + n] * np.uint64(factor)
        factor = factor * 0xBF58476D1CE4E5B9 & WORD_64
    return mix(out)


def row_shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of each row in order, and the rows' cuts.

    A row of fewer than ``width`` words, but at least one, has a single shingle
    of all its words; a row without words has none.
    """
    counts = np.diff(words.cuts)
    flat = shingles(words.hashes, width)
    per_row = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    cuts = np.concatenate([[0], np.cumsum(per_row)])
    out = np.zeros(cuts[-1], dtype=np.uint64)
    if len(flat):
        row_end = np.repeat(words.cuts[1:], counts)
        whole = np.arange(len(words.hashes)) + width <= row_end
        target = np.repeat(counts >= width, per_row)
        out[target] = flat[whole[: len(flat)]]
    for row in np.flatnonzero((counts > 0) & (counts < width)):
        own = words.hashes[words.cuts[row] : words.cuts[row + 1]]
        out[cuts[row]] = shingles(own, len(own))[0] ^ np.uint64(len(own))
    return out, cuts
