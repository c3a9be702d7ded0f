"""Chat formatting with least-cost repair of roles.

A legal conversation is an optional system turn, then user and assistant turns in
alternation from user to assistant.  A dynamic program over this automaton
chooses, for each turn, its role (kept or relabelled) and how it joins what came
before: as a new turn, merged into the turn before, or behind an inserted empty
turn.  The repair with the least cost is rendered.

A turn is a small matrix over the automaton's states in (min, +) algebra, and
matrices can be multiplied in any grouping.  A conversation is therefore cut into
``CHUNK`` turns: chunks are multiplied where they lie, their matrices, a few
numbers each, are scanned per conversation, and each chunk then finds its own
choices between its known end states.  Text is only read to render.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterset.llm.streams import by_group
from utterset.session import cut_lineage

CHUNK = 256
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FAR = 1 << 40


class Costs(NamedTuple):
    merge: int = 2
    relabel: int = 3
    insert: int = 5


class Format(NamedTuple):
    """How a turn is shown; ``between`` joins the texts of merged turns."""

    opening: str = "<|{role}|>\n"
    closing: str = "<|end|>\n"
    between: str = "\n"


class Choice(NamedTuple):
    cost: int
    state: int
    role: int
    action: str
    inserted: int  # role of an empty turn before this one, or 0


def choices(state: int, given: int, costs: Costs) -> list[Choice]:
    """What may be done with a turn of role ``given`` (0: unknown) in a state, cheapest action first."""
    out = []
    for role in (SYSTEM, USER, ASSISTANT):
        label = 0 if role == given else costs.relabel
        named = "keep" if role == given else "relabel"
        if role in LEGAL[state]:
            out.append(Choice(label, role, role, named, 0))
        if role == state:
            out.append(Choice(label + costs.merge, role, role, "merge" if role == given else "relabel+merge", 0))
        for between in LEGAL[state]:
            if role in LEGAL[between]:
                out.append(Choice(label + costs.insert, role, role, "insert" if role == given else "relabel+insert", between))
    return sorted(out, key=lambda c: (c.cost, c.action, c.role))


def end_cost(state: int, costs: Costs) -> int:
    """A conversation ends with an assistant turn; behind a user turn an empty one is inserted."""
    return {ASSISTANT: 0, USER: costs.insert, SYSTEM: 2 * costs.insert, START: 0}[state]


def turn_matrix(given: int, costs: Costs) -> np.ndarray:
    out = np.full((4, 4), FAR, dtype=np.int64)
    for state in range(4):
        for c in choices(state, given, costs):
            out[state, c.state] = min(out[state, c.state], c.cost)
    return out


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), FAR)


_UNIT = np.where(np.eye(4, dtype=bool), 0, FAR).astype(np.int64)


def best_path(given: list[int], start: int, end: int, costs: Costs) -> list[Choice]:
    """The least-cost choices from one state to another; of equal ones the first by (cost, action, role)."""
    ahead = [np.where(np.arange(4) == end, 0, FAR).astype(np.int64)]
    matrices = {g: turn_matrix(g, costs) for g in set(given)}
    for g in reversed(given):
        ahead.append(np.minimum((matrices[g] + ahead[-1][None, :]).min(axis=1), FAR))
    ahead.reverse()
    state, out = start, []
    options = {(s, g): choices(s, g, costs) for s in range(4) for g in matrices}
    for i, g in enumerate(given):
        pick = min(options[state, g], key=lambda c: c.cost + int(ahead[i + 1][c.state]))
        out.append(pick)
        state = pick.state
    return out


def _role_code():
    role = F.lower(F.trim(F.col("role")))
    code = F.lit(0)
    for number in (SYSTEM, USER, ASSISTANT):
        code = F.when(role == ROLES[number], number).otherwise(code)
    return code.cast("int")


def _chunk_matrices(costs: Costs):
    matrices = [turn_matrix(g, costs) for g in range(4)]

    def work(table: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
        given = table.column("given").to_numpy()
        products = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            product = _UNIT
            for g in given[a:b].tolist():
                product = _times(product, matrices[g])
            products.append(product.reshape(-1))
        first = pa.array(cuts[:-1])
        return pa.RecordBatch.from_arrays(
            [
                table.column("conv").combine_chunks().take(first),
                table.column("chunk").combine_chunks().take(first),
                pa.array(products, pa.list_(pa.int64())),
            ],
            names=["conv", "chunk", "matrix"],
        )

    return work


def _chunk_ends(costs: Costs):
    def work(table: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
        raw = table.column("matrix").to_pylist()
        begin, end, total = [], [], []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            steps = [np.array(m).reshape(4, 4) for m in raw[a:b]]
            ahead = [np.array([end_cost(s, costs) for s in range(4)])]
            for m in reversed(steps):
                ahead.append((m + ahead[-1][None, :]).min(axis=1))
            ahead.reverse()
            state, whole = START, int(ahead[0][START])
            for m, rest in zip(steps, ahead[1:], strict=True):
                begin.append(state)
                state = int(np.argmin(m[state] + rest))
                end.append(state)
                total.append(whole)
        return pa.RecordBatch.from_arrays(
            [
                table.column("conv").combine_chunks(), table.column("chunk").combine_chunks(),
                pa.array(begin, pa.int32()), pa.array(end, pa.int32()), pa.array(total, pa.int64()),
                pa.array([x for a, b in zip(cuts[:-1], cuts[1:], strict=True) for x in [False] * (b - a - 1) + [True]]),
            ],
            names=["conv", "chunk", "begin", "end", "cost", "last"],
        )

    return work


def render(given: list[int], texts: list[str | None], begin: int, end: int, last: bool, costs: Costs, form: Format):
    """(rendered, turns out, actions) of one chunk; the turn before is closed by what opens the next one."""
    parts, actions, turns, open_ = [], [], 0, begin != START
    for choice, text in zip(best_path(given, begin, end, costs), texts, strict=True):
        actions.append(choice.action)
        if choice.action.endswith("merge"):
            parts += [form.between, text or ""]
            continue
        if open_:
            parts.append(form.closing)
        if choice.inserted:
            parts += [form.opening.format(role=ROLES[choice.inserted]), form.closing]
            turns += 1
        parts += [form.opening.format(role=ROLES[choice.role]), text or ""]
        turns, open_ = turns + 1, True
    if last:
        if open_:
            parts.append(form.closing)
        for role in {USER: (ASSISTANT,), SYSTEM: (USER, ASSISTANT)}.get(end, ()):
            parts += [form.opening.format(role=ROLES[role]), form.closing]
            turns += 1
    return "".join(parts), turns, actions


def _rendered(costs: Costs, form: Format):
    def work(table: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
        given, texts = table.column("given").to_pylist(), table.column("text").to_pylist()
        begin, end, last = (table.column(c).to_pylist() for c in ("begin", "end", "last"))
        made = [
            render(given[a:b], texts[a:b], begin[a], end[a], last[a], costs, form)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)
        ]
        first = pa.array(cuts[:-1])
        return pa.RecordBatch.from_arrays(
            [
                *[table.column(c).combine_chunks().take(first) for c in ("conv", "chunk", "cost")],
                pa.array(np.diff(cuts), pa.int64()),
                pa.array([m[1] for m in made], pa.int64()),
                pa.array([m[2] for m in made], pa.list_(pa.string())),
                pa.array([m[0] for m in made], pa.string()),
            ],
            names=["conv", "chunk", "cost", "n_turns", "n_turns_out", "actions", "rendered"],
        )

    return work


def format_chats(
    turns: DataFrame, costs: Costs = Costs(), form: Format = Format(), chunk: int = CHUNK
) -> DataFrame:
    """(conv_id, part, cost, n_turns, n_turns_out, actions, rendered) from (conv_id, turn, role, text).

    A conversation is its parts in order; one of up to ``chunk`` consecutive turn
    numbers has one part.  ``cost`` is the whole conversation's; of several repairs
    of that cost, which one is taken depends on the parts.  Turns go by
    number, then role, then text; a null number comes last, and those of one
    conversation share a part.  Roles are read without case and outer white space; a null or other
    role is unknown and always relabelled.  Null texts are empty; repeated rows
    are repeated turns; a null ``conv_id`` is a conversation of its own.  Other columns
    are ignored; an empty table gives an empty table.
    """
    number = F.col("turn").cast("long")
    rows = turns.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv"),
        F.coalesce(F.floor(number / F.lit(chunk)), F.lit(2**62)).cast("long").alias("chunk"),
        F.coalesce(number, F.lit(2**62)).alias("turn"),
        _role_code().alias("given"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.col("text").cast("string").alias("text"),
    )
    # the order inside a part decides its matrix, so both passes sort alike
    order = ["conv", "chunk", "turn", "given"]
    keys = ["conv", "chunk"]
    parts = by_group(
        rows.select(order), keys, _chunk_matrices(costs), "conv string, chunk long, matrix array<bigint>", order
    )
    # 16 numbers per part are scanned for each conversation
    schema = "conv string, chunk long, begin int, end int, cost long, last boolean"
    ends = by_group(cut_lineage(parts, "chunks"), ["conv"], _chunk_ends(costs), schema, keys)
    ends = cut_lineage(ends, "ends")
    full = rows.join(ends, ["conv", "chunk"])
    schema = "conv string, chunk long, cost long, n_turns long, n_turns_out long, actions array<string>, rendered string"
    out = by_group(full, keys, _rendered(costs, form), schema, [*order, "role", "text"])
    kind = dict(turns.dtypes)["conv_id"]
    return out.select(
        F.when(F.col("conv") != "", F.expr("substring(conv, 2)")).cast(kind).alias("conv_id"), F.col("chunk").alias("part"),
        "cost", "n_turns", "n_turns_out", "actions", "rendered",
    )
