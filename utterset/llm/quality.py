"""Quality rules as a bitmask ledger.

Each rule is evaluated once per text.  The ledger keeps the measurements and one
``long`` with a bit per failed rule; policies are masks over these bits, so a
new policy version, or the effect of leaving a rule out, never reads a text
again.  Everything is built from column expressions.

A word is ``[^\\x20\\x09-\\x0D]+``; a line is a ``\\n``-split part.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 8


class Rule(NamedTuple):
    """``fails`` is a condition over the measurements; bit ``1 << position`` marks it."""

    name: str
    fails: str


RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("short_or_long_words", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    Rule("symbols", "2 * n_symbols > n_words"),
    Rule("duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule("capitals", "2 * n_capitals > word_chars"),
)


class Policy(NamedTuple):
    """Rejects a row that fails more than ``tolerated`` of the named rules, or any of ``base``."""

    name: str
    version: int
    rules: tuple[str, ...]
    base: tuple[str, ...] = ("few_words", "repeated_windows")
    tolerated: int = 0


POLICIES = (
    Policy("base", 1, ()),
    Policy("standard", 1, ("short_or_long_words", "symbols", "duplicate_lines", "capitals")),
    Policy("lenient", 1, ("short_or_long_words", "symbols", "duplicate_lines", "capitals"), tolerated=1),
)
STANDARD = POLICIES[1]


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _covered(keys: Column) -> Column:
    """Words inside windows whose key occurs twice or more, from the windows' keys in order."""
    placed = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("key"), i.alias("at"))))

    def total(rows: Column) -> Column:
        def twice(x: Column, j: Column) -> Column:
            before, after = (F.get(rows, j + d)["key"] for d in (-1, 1))
            return F.coalesce(x["key"] == before, F.lit(False)) | F.coalesce(x["key"] == after, F.lit(False))

        at = F.sort_array(F.transform(F.filter(rows, twice), lambda x: x["at"]))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("total"))
        return F.aggregate(
            at,
            start,
            lambda acc, x: F.struct(
                x.alias("last"), (acc["total"] + F.least(F.lit(WINDOW), x - acc["last"])).alias("total")
            ),
            lambda acc: acc["total"],
        )

    return _let(placed, total)


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Measurements of each row; a null text has no words and no lines with words."""
    read = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    parts = read.select(
        "doc_id",
        F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)).alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD)).alias("lines"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
    )
    last = F.size("words") - F.lit(WINDOW - 1)
    keys = F.when(
        last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))
    ).otherwise(F.array().cast("array<bigint>"))
    counted = parts.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_capitals",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        keys.alias("keys"),
    )
    repeats = F.when(F.size("keys") > F.size(F.array_distinct("keys")), _covered(F.col("keys"))).otherwise(F.lit(0))
    return counted.select(*[c for c in counted.columns if c != "keys"], repeats.cast("long").alias("n_repeat_words"))


def mask_of(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    """Bits of the named rules."""
    places = {rule.name: 1 << i for i, rule in enumerate(rules)}
    return sum(places[name] for name in dict.fromkeys(names))


def ledger(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """(doc_id, measurements, failed), one row per row of ``docs``; ``failed`` has bit i set if rule i fails.

    Null and empty texts have zero measurements and fail what zeros fail; repeated
    rows and null ids each keep their row; other columns are ignored.
    """
    bits = [F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, rule in enumerate(rules)]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    measured = measure(docs, doc_id, text)
    # a generated row: a filter on it is not pushed into the measurements, which would be made again for each rule
    once = measured.select(F.explode(F.array(F.struct("*"))).alias("m")).select("m.*")
    return once.withColumn("failed", failed)


def fails_base(policy: Policy, rules: tuple[Rule, ...] = RULES, failed: Column | str = "failed") -> Column:
    bits = F.col(failed) if isinstance(failed, str) else failed
    return bits.bitwiseAND(F.lit(mask_of(policy.base, rules)).cast("long")) != 0


def accepts(
    policy: Policy, rules: tuple[Rule, ...] = RULES, failed: Column | str = "failed", without: int = 0
) -> Column:
    """Whether a policy keeps a row, by its failure bits; ``without`` are bits to leave out."""
    bits = F.col(failed) if isinstance(failed, str) else failed
    bits = bits.bitwiseAND(F.lit(~without).cast("long"))
    rest = F.bit_count(bits.bitwiseAND(F.lit(mask_of(policy.rules, rules)).cast("long")))
    return ~fails_base(policy, rules, bits) & (rest <= policy.tolerated)


def ablation(
    kept_ledger: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """(policy, version, rule, n_rows, n_failed, n_kept, n_kept_without) from the ledger's bits alone.

    Rows are first counted by bit pattern, so what follows has at most
    2^len(rules) rows whatever the size of the ledger.
    """
    patterns = kept_ledger.groupBy("failed").agg(F.count("*").alias("n"))
    parts = []
    for policy in policies:
        for i, rule in enumerate(rules):
            if rule.name not in (*policy.base, *policy.rules):
                continue
            count = lambda keep: F.coalesce(F.sum(F.when(keep, F.col("n"))), F.lit(0)).cast("long")
            parts.append(
                F.struct(
                    F.lit(policy.name).alias("policy"),
                    F.lit(policy.version).alias("version"),
                    F.lit(rule.name).alias("rule"),
                    count(F.lit(True)).alias("n_rows"),
                    count(F.col("failed").bitwiseAND(F.lit(1 << i).cast("long")) != 0).alias("n_failed"),
                    count(accepts(policy, rules)).alias("n_kept"),
                    count(accepts(policy, rules, without=1 << i)).alias("n_kept_without"),
                )
            )
    return patterns.agg(F.array(*parts).alias("rows")).select(F.inline("rows"))


def keep_good(docs: DataFrame, policy: Policy = STANDARD, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with all their columns and no shuffle."""
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    judged = ledger(rows, "row", "text").where(accepts(policy))
    return judged.select("doc_id.*")
