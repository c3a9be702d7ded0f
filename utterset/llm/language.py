"""Language identification: known words first, character n-grams for the rest.

Training counts, per language, every word and every padded character n-gram of
every word of the labelled texts (all of them; counts are combined per task
before the shuffle).  Every learned word stays in the model: the ``head`` words
with the greatest share in any language are sent to every task, all others are a
table.  Of the n-grams, which only unseen words need, the ``grams`` ones of
greatest share are kept.  What is sent does not follow the number of words.

A text is scored word by word.  A known word adds its smoothed log share in each
language.  An unseen word backs off: at each place the longest known n-gram counts,
and a place without any falls back to ever shorter ones; an n-gram adds its log
share, less ``penalty`` per step back.  The language with the greatest sum is the
answer (the first by name among equals), its score the softmax of the sums.

A word outside the head may be in the table.  A sieve of fixed size tells most that
are not, which back off at once; the others are joined with the table, and only
those without a partner back off.  Results do not depend on ``head``.

A word is a run of letters in lower case.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterset.llm.sieve import lets_through, make_sieve
from utterset.session import cut_lineage

LETTERS = regex.compile(r"\p{L}+")
FLUSH = 200_000  # distinct tokens a task counts before it passes them on, or keeps scores of
PART = 50_000  # tokens scored at once
SHARE_STEPS = 64  # steps in which shares are counted, per halving
HASH_SEED = 42  # of ``xxhash64`` in expressions


@dataclass(frozen=True)
class Settings:
    head: int = 100_000
    grams: int = 60_000
    longest: int = 4
    penalty: float = 0.9
    smoothing: float = 0.5


def _padded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words with their ends marked, one after another, and the word of each."""
    codes = np.frombuffer("".join([f"<{word}>" for word in words]).encode("utf-32-le"), dtype=np.uint32)
    return codes, np.repeat(np.arange(len(words)), [len(word) + 2 for word in words])


def gram_counts(words: dict[str, int], longest: int) -> tuple[list[str], list[int], list[int]]:
    """Distinct n-grams of counted words with marked ends, 1 to ``longest`` characters: text, length, count."""
    codes, owner = _padded(list(words))
    weight = np.array(list(words.values()), dtype=np.int64)
    char, letters = pd.factorize(codes)
    letters = [chr(c) for c in letters]
    start, gram, names = np.arange(len(codes)), np.zeros(len(codes), dtype=np.int64), [""]
    found, sizes, counts = [], [], []
    for n in range(1, longest + 1):
        inside = start + n <= len(codes)
        inside[inside] = owner[start[inside] + n - 1] == owner[start[inside]]
        start = start[inside]
        gram, made = pd.factorize(gram[inside] * len(letters) + char[start + n - 1])
        names = [names[key // len(letters)] + letters[key % len(letters)] for key in made.tolist()]
        total = np.zeros(len(names), dtype=np.int64)
        np.add.at(total, gram, weight[owner[start]])
        found += names
        sizes += [n] * len(names)
        counts += total.tolist()
    return found, sizes, counts


def _counts(settings: Settings):
    def flush(lang: str, tokens: Counter) -> pa.RecordBatch:
        words: defaultdict[str, int] = defaultdict(int)
        for token, n in tokens.items():
            for word in LETTERS.findall(token):
                words[word] += n
        grams, sizes, counts = gram_counts(words, settings.longest)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * (len(words) + len(grams)), pa.string()),
                pa.array([*words, *grams], pa.string()),
                pa.array([0] * len(words) + sizes, pa.int32()),
                pa.array([*words.values(), *counts], pa.int64()),
            ],
            names=["lang", "entry", "n", "count"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_lang: defaultdict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                by_lang[lang].update(text.as_py().lower().split())
                if sum(map(len, by_lang.values())) >= FLUSH:
                    yield from (flush(*counted) for counted in by_lang.items())
                    by_lang.clear()
        yield from (flush(*counted) for counted in by_lang.items())

    return run


def entry_counts(labelled: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(lang, entry, n, count) over (lang, text): words have n = 0, n-grams their length."""
    rows = labelled.select("lang", "text").where("lang is not null and text is not null")
    made = rows.mapInArrow(_counts(settings), "lang string, entry string, n int, count long")
    return made.groupBy("lang", "entry", "n").agg(F.sum("count").alias("count"))


class Model:
    """Log shares of the head's words and of the n-grams by language, as rows of one matrix.

    ``size`` is the number of all entries, the words of the table included.
    """

    def __init__(self, langs: list[str], totals: dict, entries: list[tuple[str, int, dict]], size: int, settings: Settings):
        self.langs, self.settings = langs, settings
        self.words: dict[str, int] = {}
        self.grams: dict[str, int] = {}
        place = {lang: i for i, lang in enumerate(langs)}
        count = np.zeros((len(entries), len(langs)))
        total = np.ones((len(entries), len(langs)))
        for i, (entry, n, by_lang) in enumerate(entries):
            (self.words if n == 0 else self.grams)[entry] = i
            for lang, value in by_lang.items():
                count[i, place[lang]] = value
            total[i] = [totals.get((lang, n), 0) for lang in langs]
        alpha = settings.smoothing
        self.logs = np.log((count + alpha) / (total + alpha * max(1, size)))
        words = np.array([totals.get((lang, 0), 0) for lang in langs], dtype=np.float64)
        self.absent = np.log(alpha / (words + alpha * max(1, size)))  # a known word in a language that lacks it
        self._plant()

    def _plant(self) -> None:
        """Trie of the n-grams as sorted arrays: (node, letter) -> node, node -> row of ``logs``."""
        self.alphabet = np.array(sorted({ord(c) for gram in self.grams for c in gram}) or [0], dtype=np.uint32)
        letter = {chr(c): i for i, c in enumerate(self.alphabet.tolist())}
        edges: dict[int, int] = {}
        rows = {}
        for gram, row in self.grams.items():
            node = 0
            for c in gram:
                node = edges.setdefault(node * len(letter) + letter[c], len(edges) + 1)
            rows[node] = row
        self.edges = np.array(sorted(edges) or [-1], dtype=np.int64)
        self.nodes = np.array([edges.get(e, 0) for e in self.edges.tolist()])
        self.rows = np.array([rows.get(node, -1) for node in range(len(edges) + 1)])

    def backed_off(self, words: list[str]) -> np.ndarray:
        """Log scores of unseen words: at each place the longest known n-gram that ends there."""
        codes, owner = _padded(words)
        letter = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        known = self.alphabet[letter] == codes
        row, size = np.full(len(codes), -1), np.zeros(len(codes), dtype=np.int64)
        start, node = np.arange(len(codes)), np.zeros(len(codes), dtype=np.int64)
        for n in range(1, self.settings.longest + 1):
            inside = start + n <= len(codes)
            start, node = start[inside], node[inside]
            end = start + n - 1
            edge = node * len(self.alphabet) + letter[end]
            at = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
            live = (self.edges[at] == edge) & known[end] & (owner[end] == owner[start])
            start, node, end = start[live], self.nodes[at[live]], end[live]
            is_gram = self.rows[node] >= 0
            row[end[is_gram]] = self.rows[node[is_gram]]  # longer ones come later and replace shorter ones
            size[end[is_gram]] = n
        used = (row >= 0) & (np.diff(owner, prepend=-1) == 0)  # not the mark that begins a word
        row, size, owner = row[used], size[used], owner[used]
        steps = np.bincount(owner, self.settings.longest - size, len(words))
        score = np.stack([np.bincount(owner, one[row], len(words)) for one in self.logs.T], axis=1)
        score += (steps * np.log(self.settings.penalty))[:, None]
        return score / np.array([[max(1, len(word))] for word in words])  # one word's weight, not one per place

    def token_scores(self, tokens: list[str], sieve: np.ndarray) -> tuple[np.ndarray, dict[int, list[str]]]:
        """Log scores of the words of each token, then their number; and the words to look up in the table."""
        owner, at, unseen, unseen_owner = [], [], [], []
        for i, token in enumerate(tokens):
            for word in [token] if token.isalpha() else LETTERS.findall(token):
                row = self.words.get(word)
                if row is None:
                    unseen.append(word)
                    unseen_owner.append(i)
                else:
                    at.append(row)
                    owner.append(i)
        rare: dict[int, list[str]] = {}
        if unseen:
            hashes = [xxhash.xxh64_intdigest(word.encode(), HASH_SEED) for word in unseen]
            listed = lets_through(sieve, np.array(hashes, dtype=np.uint64)).tolist()
            for i, word, may_be in zip(unseen_owner, unseen, listed, strict=True):
                if may_be:
                    rare.setdefault(i, []).append(word)
            unseen = [word for word, may_be in zip(unseen, listed, strict=True) if not may_be]
            unseen_owner = [i for i, may_be in zip(unseen_owner, listed, strict=True) if not may_be]
        score = np.zeros((len(tokens), len(self.langs) + 1))
        if at:
            np.add.at(score[:, :-1], owner, self.logs[at])
        if unseen:
            np.add.at(score[:, :-1], unseen_owner, self.backed_off(unseen))
        score[:, -1] = np.bincount(np.array(owner + unseen_owner, dtype=np.int64), minlength=len(tokens))
        return score, rare

    def add_looked_up(self, totals: np.ndarray, column: pa.ListArray) -> None:
        """Add to each text's totals its words (word, n, langs, counts) that were looked up.

        ``word`` is null where the table holds it, with its counts in some languages.
        """
        owner = np.repeat(np.arange(len(totals)), np.diff(column.offsets.to_numpy()))
        words = column.flatten()
        n = words.field("n").to_numpy().astype(np.float64)
        text = words.field("word")
        known = text.is_null().to_numpy(zero_copy_only=False)
        totals[:, -1] += np.bincount(owner, n, len(totals))
        totals[:, :-1] += np.bincount(owner[known], n[known], len(totals))[:, None] * self.absent
        each = np.array(words.field("langs").value_lengths().fill_null(0), dtype=np.int64)
        langs, counts = (words.field(c).flatten().to_numpy() for c in ("langs", "counts"))
        more = np.log((counts + self.settings.smoothing) / self.settings.smoothing)
        np.add.at(totals, (np.repeat(owner, each), langs), np.repeat(n, each) * more)
        if not known.all():
            code, distinct = pd.factorize(np.array(text.to_pylist(), dtype=object)[~known])
            np.add.at(totals[:, :-1], owner[~known], self.backed_off(distinct.tolist())[code] * n[~known][:, None])

    def answers(self, totals: np.ndarray) -> tuple[list[str], list[float]]:
        """Language and score of each row of totals."""
        if not self.langs:
            return ["und"] * len(totals), [0.0] * len(totals)
        scores, words = totals[:, :-1], totals[:, -1]
        best = np.argmax(scores, axis=1)
        share = 1 / np.exp(scores - scores.max(axis=1, keepdims=True)).sum(axis=1)
        langs = [self.langs[at] if n else "und" for at, n in zip(best.tolist(), words.tolist(), strict=True)]
        return langs, np.where(words > 0, share, 0.0).tolist()


class TokenScores:
    """Scores of the tokens met so far, one row each, and their words to look up."""

    def __init__(self, model: Model, sieve: np.ndarray):
        self.model, self.sieve = model, sieve
        self.place: dict[str, int] = {}
        self.rare: dict[int, list[str]] = {}
        self.rows = np.zeros((1024, len(model.langs) + 1))

    def totals(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, list[list[dict]]]]:
        """Totals and words to look up of blocks of whole texts; a text's sum does not depend on its neighbours."""
        tokens, ends = [], [0]
        for text in texts:
            tokens += text.lower().split() if text else []
            ends.append(len(tokens))
            if len(tokens) >= PART:
                yield self._sums(tokens, ends)
                tokens, ends = [], [0]
        yield self._sums(tokens, ends)

    def _sums(self, tokens: list[str], ends: list[int]) -> tuple[np.ndarray, list[list[dict]]]:
        new = [t for t in dict.fromkeys(tokens) if t not in self.place]
        if new:
            filled = len(self.place)
            self.place.update(zip(new, range(filled, filled + len(new)), strict=True))
            while len(self.place) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[filled : len(self.place)], rare = self.model.token_scores(new, self.sieve)
            self.rare.update((filled + i, words) for i, words in rare.items())
        at = np.fromiter(map(self.place.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        sums = [np.bincount(owner, one[at], len(ends) - 1) for one in self.rows.T]
        looked_up: list[list[dict]] = [[] for _ in ends[1:]]
        if self.rare:
            is_rare = np.zeros(len(self.place), dtype=bool)
            is_rare[list(self.rare)] = True
            found = is_rare[at]
            key, n = np.unique(owner[found] * len(self.place) + at[found], return_counts=True)
            for text, place, times in zip(*(k.tolist() for k in divmod(key, len(self.place))), n.tolist(), strict=True):
                looked_up[text] += [{"word": word, "n": times} for word in self.rare[place]]
        if len(self.place) >= FLUSH:
            self.place.clear()
            self.rare.clear()
        return np.stack(sums, axis=1), looked_up


@dataclass(frozen=True)
class Learned:
    """The part of a model that is sent, and the table (word, langs, counts) of the words outside its head."""

    model: Model
    rare: DataFrame


def _greatest(entries: DataFrame, most: int) -> list:
    """The ``most`` entries of greatest share, ties by the entry itself.

    Counts of shares leave out first what cannot be among them, so few rows are ordered.
    """
    step = F.floor(-F.log2("share") * SHARE_STEPS)
    last, filled = None, 0
    for row in entries.groupBy(step.alias("step")).count().orderBy("step").collect():
        last, filled = row["step"], filled + row["count"]
        if filled >= most:
            break
    if last is None:
        return []
    return entries.where(step <= last).orderBy(F.desc("share"), "n", "entry").limit(most).collect()


def train(labelled: DataFrame, settings: Settings = Settings()) -> Learned:
    """Model of (lang, text); rows with a null are left out, no rows give a model that answers ``und``.

    An entry's rank is its greatest share in any language, ties by the entry itself.
    """
    counts = cut_lineage(entry_counts(labelled, settings), "counts")
    totals = {(r["lang"], r["n"]): r["t"] for r in counts.groupBy("lang", "n").agg(F.sum("count").alias("t")).collect()}
    langs = sorted({lang for lang, _ in totals})
    shares = counts.groupBy("lang", "n").agg(F.sum("count").alias("total"))
    entries = (
        counts.join(shares, ["lang", "n"])
        .groupBy("n", "entry")
        .agg(
            F.max(F.col("count") / F.col("total")).alias("share"),
            F.map_from_entries(F.collect_list(F.struct("lang", "count"))).alias("by_lang"),
        )
    )
    entries = cut_lineage(entries, "entries")
    words = entries.where("n = 0")
    head = _greatest(words, settings.head)
    grams = _greatest(entries.where("n > 0"), settings.grams)
    if len(head) < settings.head:
        beyond = F.lit(False)
    elif head:
        share, entry = F.lit(head[-1]["share"]), F.lit(head[-1]["entry"])
        beyond = (F.col("share") < share) | ((F.col("share") == share) & (F.col("entry") > entry))
    else:
        beyond = F.lit(True)
    names = F.array(*[F.lit(lang) for lang in langs]) if langs else F.array().cast("array<string>")
    by_place = F.array_sort(
        F.transform(
            F.map_entries("by_lang"),
            lambda e: F.struct((F.array_position(names, e["key"]) - 1).cast("int").alias("lang"), e["value"].alias("count")),
        )
    )
    rare = words.where(beyond).select("entry", by_place.alias("by_place")).select(
        F.col("entry").alias("word"), F.col("by_place.lang").alias("langs"), F.col("by_place.count").alias("counts")
    )
    kept = [(r["entry"], r["n"], r["by_lang"]) for r in head + grams]
    model = Model(langs, totals, kept, words.count() + len(grams), settings)
    return Learned(model, cut_lineage(rare, "rare"))


def _scored(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = TokenScores(*sent.value)
        kind = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))
        for batch in batches:
            made = list(scores.totals(text.as_py() for text in batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([row.tobytes() for totals, _ in made for row in totals], pa.binary()),
                    pa.array([words for _, looked_up in made for words in looked_up], kind),
                ],
                names=["doc_id", "totals", "words"],
            )

    return run


def _answered(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value[0]
        for batch in batches:
            raw = b"".join(batch.column("totals").to_pylist())
            totals = np.frombuffer(raw, dtype=np.float64).reshape(batch.num_rows, -1).copy()
            if batch.num_rows and model.langs:
                model.add_looked_up(totals, batch.column("words"))
            langs, scores = model.answers(totals)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return run


def identify(docs: DataFrame, learned: Learned, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each row, by its text alone.

    Null texts and texts without a letter are ``und`` with score 0; repeated rows
    and null ids keep their rows; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sieve = make_sieve(learned.rare.select(F.xxhash64("word").alias("hash")), "hash")
    sent = docs.sparkSession.sparkContext.broadcast((learned.model, sieve))
    scored = rows.mapInArrow(_scored(sent), "doc_id long, totals binary, words array<struct<word:string,n:long>>")
    # numbered as written: the table fixes which row has which number
    scored = cut_lineage(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    asked = scored.select("row", F.explode("words").alias("w")).select("row", "w.word", "w.n")
    told = asked.join(learned.rare, "word", "left")
    word = F.struct(F.when(F.col("langs").isNull(), F.col("word")).alias("word"), "n", "langs", "counts")
    told = told.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("totals"), word.alias("w"))
    parts = scored.select("row", "doc_id", "totals", F.lit(None).cast(told.schema["w"].dataType).alias("w")).unionByName(told)
    # a row's list is no longer than its text has words; in order, so that sums of doubles agree between runs
    whole = parts.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.first("totals", ignorenulls=True).alias("totals"),
        F.sort_array(F.collect_list("w")).alias("words"),
    )
    return whole.drop("row").mapInArrow(_answered(sent), "doc_id long, lang_pred string, score double")


def is_held_out(doc_id: Column | str) -> Column:
    """Whether crc32 of the id as text, modulo 4, is 2; a null id is not."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def split_and_identify(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", settings: Settings = Settings()
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): trained on the labelled rows that are not held out."""
    labelled = docs.where(~is_held_out(doc_id)).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    found = identify(docs, train(labelled, settings), doc_id, text)
    return found.select("doc_id", is_held_out("doc_id").alias("held_out"), "lang_pred", "score")
