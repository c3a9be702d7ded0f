"""SentencePiece (BPE with byte fallback) by a prefix table instead of a merge loop.

For each prefix of a text the last token of the prefix's encoding is unique.  An
automaton over the vocabulary gives the tokens that end at a position; a token t
is the last one if the prefix before t ends with a token u such that u and t stay
apart when encoded together (pair compatibility).  Ids are then recovered from
the end backwards, in time linear in the text.

Whether two tokens stay apart is decided by encoding their joined string with the
merge rule itself (best score first, then leftmost) and is remembered per pair.

Where no vocabulary entry has a word mark behind another character, a text falls
into independent units (a run of word marks and what follows it); tables of units
are remembered, since words repeat.  Both memories are bounded and are emptied
when full, which changes no result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
MEMORY = 600_000  # remembered units, and remembered pairs


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Pieces:
    """Encoder and decoder of one model file.

    Served are BPE models with identity normalisation, a dummy prefix, escaped
    and kept white space, byte fallback and no user-defined pieces; others are
    refused, since their results would differ.
    """

    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece

        model_type, prefix, squeeze, escape, normal = 1, True, True, True, "nmt_nfkc"
        for number, value in _fields(model):
            if number == 2:
                model_type = dict(_fields(value)).get(3, 1)
            if number == 3:
                spec = dict(_fields(value))
                normal, prefix = spec.get(1, b"").decode(), bool(spec.get(3, 1))
                squeeze, escape = bool(spec.get(4, 1)), bool(spec.get(5, 1))
        read = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(read.get_piece_size())
        if (model_type, normal, prefix, squeeze, escape) != (2, "identity", True, False, True):
            raise ValueError("not a BPE model with identity normalisation, dummy prefix and kept white space")
        plain = [i for i in ids if not (read.is_control(i) or read.is_unknown(i) or read.is_byte(i))]
        self.id_of = {read.id_to_piece(i): i for i in plain}
        self.score = {read.id_to_piece(i): read.get_score(i) for i in plain}
        self.byte_id = {int(read.id_to_piece(i)[3:5], 16): i for i in ids if read.is_byte(i)}
        if len(self.byte_id) != 256:
            raise ValueError("the model has no byte fallback")
        self.piece = [read.id_to_piece(i) for i in ids]
        self.byte_of = {i: bytes([b]) for b, i in self.byte_id.items()}
        self.silent = {i for i in ids if read.is_control(i)}
        self.unknown = {i for i in ids if read.is_unknown(i)}
        # pieces that decode by themselves, whatever stands beside them
        self.shown = [chr(self.byte_of[i][0]) if i in self.byte_of else p for i, p in enumerate(self.piece)]
        self.odd = self.silent | self.unknown | {i for b, i in self.byte_id.items() if b > 127}
        self.splits = not any(MARK in p.lstrip(MARK) for p in self.id_of)
        self.automaton = ahocorasick.Automaton()
        for p in self.id_of:
            # a piece that its own string does not encode to is never the last token
            if len(p) > 1 and self._merge(p) == [p]:
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.apart: dict[tuple[str, str], bool] = {}
        self.units: dict[str, list[int]] = {}

    def _merge(self, text: str) -> list[str]:
        """The merge rule on a short string."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _stay_apart(self, left: str, right: str) -> bool:
        key = (left, right)
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) >= MEMORY:
                self.apart.clear()
            known = self.apart[key] = self._merge(left + right) == [left, right]
        return known

    def _table(self, text: str) -> list[int]:
        """Ids of a text through its prefix table."""
        last: list[str] = list(text)  # a character alone, unless a longer token fits
        apart, settled = self.apart, -1
        for end, token in self.automaton.iter(text):
            if end == settled:  # at most one token fits
                continue
            before = end - len(token)
            if before >= 0:
                fits = apart.get((last[before], token))
                if not (self._stay_apart(last[before], token) if fits is None else fits):
                    continue
            last[end] = token
            settled = end
        out: list[int] = []
        end = len(text)
        while end > 0:
            token = last[end - 1]
            if token in self.id_of:
                out.append(self.id_of[token])
            else:
                out += [self.byte_id[b] for b in reversed(token.encode("utf-8"))]
            end -= len(token)
        out.reverse()
        return out

    def _unit(self, unit: str, key: str) -> list[int]:
        ids = self._table(unit)
        if len(unit) <= 64:
            if len(self.units) >= MEMORY:
                self.units.clear()
            self.units[key] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a text, without begin or end; an empty text has none."""
        if not text:
            return []
        if not self.splits:
            return self._table(MARK + text.replace(" ", MARK))
        # the usual text: single spaces; a word stands for its unit, a line end opens one without a mark
        words = text.replace("\n", " \n").split(" ")
        known = self.units
        if MARK not in text and "" not in words:
            found = list(map(known.get, words))
            if None in found:
                found = [
                    ids if ids is not None else known.get(w) or self._unit(w if w[0] == "\n" else MARK + w, w)
                    for w, ids in zip(words, found, strict=True)
                ]
            return list(chain.from_iterable(found))
        out: list[int] = []
        for unit in _UNITS(MARK + text.replace(" ", MARK)):
            out += self._table(unit)
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids: byte pieces are gathered to UTF-8, the dummy prefix is dropped."""
        if self.odd.isdisjoint(ids):
            out = "".join(map(self.shown.__getitem__, ids))
            return (out[1:] if out[:1] == MARK else out).replace(MARK, " ")
        byte_of, piece = self.byte_of, self.piece
        parts: list[str] = []
        run = b""
        first = True  # the dummy prefix goes with the first piece that has text
        for i in ids:
            if i in byte_of:
                run += byte_of[i]
                first = False
                continue
            if run:
                parts.append(_utf8(run))
                run = b""
            if i in self.silent:
                continue
            if i in self.unknown:
                parts.append(" ⁇ ")
            else:
                shown = piece[i]
                parts.append((shown[1:] if first and shown[:1] == MARK else shown).replace(MARK, " "))
            first = False
        parts.append(_utf8(run))
        return "".join(parts)


# a run of word marks with what follows, split again before and after line ends, which no piece holds
_UNITS = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+").findall


def _utf8(run: bytes) -> str:
    """Bytes as text; each byte outside a valid sequence becomes one replacement mark."""
    out = []
    while run:
        try:
            out.append(run.decode("utf-8"))
            break
        except UnicodeDecodeError as error:
            out.append(run[: error.start].decode("utf-8") + "�")
            run = run[error.start + 1 :]
    return "".join(out)


@cache
def _loaded(model: bytes) -> Pieces:
    return Pieces(model)


def read_model(path: str) -> bytes:
    """The model file on the driver; tasks get its bytes, so executors need no file."""
    with open(path, "rb") as file:
        return file.read()


def _tokens(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _loaded(model)
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):  # ids of a few texts are held at a time
                batch = whole.slice(lo, 256)
                ids = [pieces.encode(text or "") for text in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key"),
                        pa.array(ids, pa.list_(pa.int32())),
                        pa.array([pieces.decode(i) for i in ids], pa.string()),
                    ],
                    names=["key", "ids", "decoded"],
                )

    return run


def tokenize(docs: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of each row.

    Null and empty texts have no ids and decode to an empty text; repeated rows
    and null ids keep their rows; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    out = rows.mapInArrow(_tokens(model), "key long, ids array<int>, decoded string")
    return out.withColumnRenamed("key", "doc_id")


def _digests(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _loaded(model)
        shown = [str(i) for i in range(len(pieces.piece))]
        sha = hashlib.sha256
        for batch in batches:
            counts, coded, decoded = [], [], []
            for text in batch.column("text"):
                ids = pieces.encode(text.as_py() or "")
                counts.append(len(ids))
                coded.append(sha(",".join(map(shown.__getitem__, ids)).encode()).hexdigest())
                decoded.append(sha(pieces.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(counts, pa.int64()), pa.array(coded), pa.array(decoded)],
                names=["key", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def token_digests(docs: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): as ``tokenize``, digested where the ids are made.

    ``ids_sha256`` is of the decimal ids joined by commas, ``decoded_sha256`` of
    the decoded text; both are of the empty string for null and empty texts.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    schema = "key long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(_digests(model), schema).withColumnRenamed("key", "doc_id")
