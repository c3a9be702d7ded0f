"""URL filter: a trie over reversed host labels and path segments.

A rule is a host with a path prefix and a verdict.  It fits its host and all
subdomains if the URL's path starts with the rule's path; the longest fitting
rule (of equal length the one with the longer host) decides, whatever its
verdict.  The trie has a level per host label from the right, and below each host
a level per whole path segment; the part of a rule's path behind its last slash
is kept at the node as a prefix of the next segment.

The trie is broadcast when the rules are counted to be within ``MOST_RULES`` and
``MOST_CHARACTERS``; longer lists are joined with the URLs on host suffix and
whole path prefix instead.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_RULES = 500_000
MOST_CHARACTERS = 32_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(UPPER, LOWER)


class Rule(NamedTuple):
    """``host`` without scheme, ``path`` with its leading slash, ``verdict`` allow or block."""

    host: str
    path: str
    verdict: str

    @classmethod
    def parse(cls, verdict: str, text: str) -> Rule:
        """From text such as ``example.org/es/``."""
        host, slash, rest = text.partition("/")
        return cls(host.translate(_FOLD), slash + rest, verdict)


def host_of(url: Column | str) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    found = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column | str) -> Column:
    """Behind the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Trie:
    """Nodes are dictionaries; ``None`` leads from a host node to its paths."""

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for rule in sorted(rules):  # allow before block: of equal rules the blocking one stays
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.setdefault(label, {})
            *segments, rest = rule.path.split("/")
            node = node.setdefault(None, {})
            for segment in segments:
                node = node.setdefault("/" + segment, {})
            node.setdefault("", {})[rest] = (len(rule.host) + len(rule.path), len(rule.host), rule.host + rule.path, rule.verdict)

    def _along(self, node: dict, path: str, best: tuple | None) -> tuple | None:
        segments = path.split("/")
        for i in range(len(segments)):
            ends = node.get("")
            if ends:
                rest = segments[i]
                for n in range(len(rest) + 1):  # prefixes of the next segment
                    rule = ends.get(rest[:n])
                    if rule:
                        best = max(best or rule, rule)
            node = node.get("/" + segments[i])
            if node is None:
                break
        return best

    def judge(self, host: str, path: str) -> tuple[str | None, str | None]:
        """(rule, verdict) of the longest fitting rule, or nothing."""
        best, node = None, self.root
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            paths = node.get(None)
            if paths:
                best = self._along(paths, path, best)
        return (best[2], best[3]) if best else (None, None)


def _judged(trie):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = trie.value.judge
        for batch in batches:
            pairs = zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)
            found = [judge(host, path) for host, path in pairs]
            columns = [pa.array([f[i] for f in found], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "rule", "verdict"])

    return run


def _joined(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """The same verdicts by a join on host suffix and whole leading path segments."""
    named = rules.select(
        F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")
    )
    named = named.withColumn("stem", F.regexp_extract("rule_path", r"(?s)\A(.*/)?", 1))
    urls = rows.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    # every prefix of the path that ends with a slash, and the empty one
    parts = F.split("path", "/")
    stems = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.when(i == 1, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, i - 1), "/"), F.lit("/"))),
    )
    keys = urls.withColumn("rule_host", F.explode(suffixes)).withColumn("stem", F.explode(stems))
    length = F.length("rule_host") + F.length("rule_path")
    fits = keys.join(named, ["rule_host", "stem"]).where(F.expr("startswith(path, rule_path)"))
    best = fits.groupBy("host", "path").agg(
        F.max(F.struct(length, F.length("rule_host"), F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict")).alias("b")
    )
    chosen = best.select(F.col("host").alias("h"), F.col("path").alias("p"), "b.rule", F.col("b.rule_verdict").alias("verdict"))
    same = (F.col("host") == F.col("h")) & (F.col("path") == F.col("p"))
    return rows.join(chosen, same, "left").drop("h", "p")


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    default: str = "allow",
    most_rules: int = MOST_RULES,
) -> DataFrame:
    """(page_id, host, path, rule, verdict), one row per row of ``pages``; ``rules`` has host, path, verdict.

    A null URL, or one without ``://``, has empty host and path.  Where no rule
    fits, ``rule`` is null and the verdict is ``default``.  Rules with a null part
    are ignored; of rules with equal host and path ``block`` decides; repeated
    rows and null ids keep their rows; other columns are ignored.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rules = rules.select("host", "path", "verdict").dropna().distinct()
    n, size = rules.agg(F.count("*"), F.sum(F.length("host") + F.length("path"))).first()
    if n <= most_rules and (size or 0) <= MOST_CHARACTERS:
        trie = Trie(Rule(r["host"].translate(_FOLD), r["path"], r["verdict"]) for r in rules.toLocalIterator())
        kind = dict(rows.dtypes)["page_id"]
        schema = f"page_id {kind}, host string, path string, rule string, verdict string"
        judged = rows.mapInArrow(_judged(pages.sparkSession.sparkContext.broadcast(trie)), schema)
    else:
        judged = _joined(rows, rules)
    return judged.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
