"""Transcript scoring: additive error counts, corpus rates, charsets, decoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utterset.functions import text as tx

# Fixed value: reserved first symbol of every charset.
BLANK = "<blank>"


def asr_counts(df: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """Add word/character errors and reference units of each utterance."""
    counted = df.withColumn("_e", tx.edit_counts(F.col(reference), F.col(hypothesis)))
    return counted.select("*", *[F.col("_e")[c].alias(c) for c in tx.COUNT_FIELDS]).drop("_e")


def rate(errors: Column, units: Column) -> Column:
    """Errors per reference unit; without any unit 1.0 if there were errors."""
    return F.when(units == 0, (errors > 0).cast("double")).otherwise(errors / units)


def asr_rates(counts: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Corpus word and character error rates (ratio of sums)."""
    sums = counts.groupBy(*group).agg(
        F.count(F.lit(1)).alias("utterances"),
        *[F.sum(c).alias(c) for c in ("word_errors", "word_units", "char_errors", "char_units")],
    )
    return sums.select(
        *group,
        "utterances",
        rate(F.col("word_errors"), F.col("word_units")).alias("wer"),
        rate(F.col("char_errors"), F.col("char_units")).alias("cer"),
    )


def build_charset(df: DataFrame, text: str = "text") -> DataFrame:
    """(symbol, code): code 0 is the blank, then sorted lower-case characters."""
    characters = (
        df.select(F.explode(F.array_distinct(F.split(F.lower(text), ""))).alias("symbol"))
        .where((F.col("symbol") != "") & (F.col("symbol") != "\n"))
        .distinct()
    )
    # an alphabet: bounded by the number of Unicode characters, not by the rows
    numbered = characters.withColumn(
        "code", F.row_number().over(Window.orderBy("symbol")).cast("int")
    )
    blank = df.sparkSession.range(1).select(F.lit(BLANK).alias("symbol"), F.lit(0).alias("code"))
    return blank.unionByName(numbered)


def code_table(charset: DataFrame) -> DataFrame:
    """One row, one array: the code of each character at the place of its code point, null where there is none.

    At most the number of Unicode characters, whatever the rows.
    """
    known = charset.where(F.col("code") > 0).select(F.ascii("symbol").cast("long").alias("point"), "code")
    top = known.agg(F.max("point")).first()[0]
    every = charset.sparkSession.range(0, (top if top is not None else -1) + 1).withColumnRenamed("id", "point")
    placed = every.join(known, "point", "left").agg(F.sort_array(F.collect_list(F.struct("point", "code"))).alias("c"))
    return placed.select(F.col("c.code").alias("codes"))


def encode_text(df: DataFrame, charset: DataFrame, text: str = "text", name: str = "codes") -> DataFrame:
    """Adds the codes of the known characters of the lower-cased text; others are dropped.

    A character finds its code at its code point, without a search.
    """
    codes = code_table(charset).select("codes").scalar()
    found = lambda table: F.filter(
        F.transform(F.split(F.lower(text), ""), lambda c: F.get(table, F.ascii(c))), lambda i: i > 0
    )
    return df.withColumn("_codes", codes).withColumn(name, found(F.col("_codes"))).drop("_codes")


def min_frames(codes: Column) -> Column:
    """Frames an alignment with blanks needs: length plus adjacent repeats."""
    return F.size(codes).cast("long") + tx.adjacent_repeats(codes)


def ctc_feasibility(
    df: DataFrame, codes: str, frames: str, upsample: int = 1, group: Sequence[str] = ()
) -> DataFrame:
    """How many targets need more frames than their utterance has."""
    short = min_frames(F.col(codes)) > F.col(frames) * F.lit(upsample)
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("targets"),
        F.count_if(short).alias("infeasible"),
        (F.lit(100.0) * F.count_if(short) / F.greatest(F.lit(1), F.count(F.lit(1)))).alias(
            "percent_infeasible"
        ),
    )


def collapse_array(tokens: Column, blank: Column | str | int) -> Column:
    """Best-path decoding of one frame-token array: drop repeats, then blanks."""
    blank_col = blank if isinstance(blank, Column) else F.lit(blank)
    previous = F.concat(
        F.array(F.lit(None).cast("string")),
        F.slice(tokens.cast("array<string>"), 1, F.greatest(F.size(tokens) - 1, F.lit(0))),
    )
    kept = F.filter(
        F.zip_with(
            tokens.cast("array<string>"),
            previous,
            lambda now, before: F.when(~now.eqNullSafe(before) & (now != blank_col.cast("string")), now),
        ),
        lambda x: x.isNotNull(),
    )
    return F.when(F.size(tokens) == 0, F.array().cast("array<string>")).otherwise(kept)


def collapse_tokens(
    df: DataFrame, *, utt: str, frame: str, token: str, blank: str, valid: str | None = None
) -> DataFrame:
    """Long-form best-path decoding: the kept (utt, frame, token) rows.

    The previous frame is found by an equi-join on (utt, frame), so a long
    utterance spreads over tasks like any other rows.
    """
    rows = df.select(utt, frame, token, *([valid] if valid else []))
    if valid:
        rows = rows.where(F.col(frame) < F.col(valid)).drop(valid)
    before = rows.select(F.col(utt), (F.col(frame) + 1).alias(frame), F.col(token).alias("_prev"))
    return (
        rows.join(before, [utt, frame], "left")
        .where((F.col(token) != blank) & ~F.col(token).eqNullSafe(F.col("_prev")))
        .drop("_prev")
    )


def decoded_text(df: DataFrame, *, utt: str, tokens: str, blank: str, separator: str = "") -> DataFrame:
    """(utt, hypothesis) from one token array per utterance."""
    return df.select(utt, F.array_join(collapse_array(F.col(tokens), blank), separator).alias("hypothesis"))


def examples(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """First ``n`` reference/hypothesis rows by key, for a report."""
    return df.orderBy(key).limit(n)
