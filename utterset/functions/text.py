"""Text helpers: usable text, words, edit distance."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

def has_text(text: Column) -> Column:
    """A string with something other than white space in it."""
    return F.coalesce(F.trim(F.regexp_replace(text, r"\s+", " ")) != "", F.lit(False))


def words(text: Column) -> Column:
    """White-space separated words; an empty text has none."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def characters(text: Column) -> Column:
    """Characters of the stripped text; an empty text has none."""
    return F.filter(F.split(strip(text), ""), lambda c: c != "")


def strip(text: Column) -> Column:
    """Remove leading and trailing white space."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Edit distance of two sequences, a whole column of the table per step.

    Bit-parallel (Myers 1999, Hyyro 2003): column differences are the bits of
    two integers, so long texts cost length^2 / word size.
    """
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    places: dict = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    match = {x: sum(1 << i for i in at) for x, at in places.items()}
    ones = (1 << len(a)) - 1
    top = 1 << (len(a) - 1)
    rises, falls, score = ones, 0, len(a)
    for x in b:
        same = match.get(x, 0)
        vertical = same | falls
        diagonal = (((same & rises) + rises) ^ rises) | same
        up = (falls | ~(diagonal | rises)) & ones
        down = rises & diagonal
        score += 1 if up & top else -1 if down & top else 0
        up, down = ((up << 1) | 1) & ones, (down << 1) & ones
        rises = (down | ~(vertical | up)) & ones
        falls = up & vertical
    return score


COUNT_FIELDS = ("word_errors", "word_units", "char_errors", "char_units")
_COUNTS = T.StructType([T.StructField(name, T.LongType()) for name in COUNT_FIELDS])


@F.pandas_udf(_COUNTS)
def edit_counts(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    """Word and character errors and reference units of text pairs, whole texts.

    The native ``levenshtein`` fills the full table per pair; on turns of some
    hundred characters this is already faster, and far more so on long texts.
    A missing text gives no counts.
    """
    rows = []
    for ref, hyp in zip(reference, hypothesis):
        if ref is None or hyp is None:
            rows.append((None,) * 4)
            continue
        words_, text = ref.split(), ref.strip()
        rows.append(
            (edit_distance(words_, hyp.split()), len(words_), edit_distance(text, hyp.strip()), len(text))
        )
    return pd.DataFrame(rows, columns=list(COUNT_FIELDS), dtype="Int64")


def adjacent_repeats(tokens: Column) -> Column:
    """Number of positions equal to the one before."""
    pairs = F.zip_with(
        tokens, F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: a == b
    )
    return F.size(F.filter(pairs, lambda same: F.coalesce(same, F.lit(False)))).cast("long")
