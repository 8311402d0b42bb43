"""Chat formatting with minimum-cost role repair.

A legal conversation is [system] (user assistant)+. Each turn is kept under its role or relabelled, then starts a turn of its own, after an empty turn where the automaton
asks for one, or is merged into the turn before it if that has the same role. Costs: COSTS below; an end after anything but an assistant's turn
is repaired by empty turns. Of the repairs of least cost the one is taken whose choices, turn by turn, come first in the order of CHOICES.

The dynamic program is a chain of small min-plus matrices over the automaton's four states, and matrices of adjacent stretches multiply. So rows are sorted by range over (conversation, turn), a conversation may run over many
partitions, and no conversation is gathered: a first pass multiplies each stretch at a partition's edge, the stretches' matrices (two a partition at most) are chained, a second pass finds
which state each stretch leaves in for every state it may be entered in, and a last pass takes the choices and renders.

Each row gives one piece of text, inserted turns and turn ends included; a conversation is its pieces joined in order of pos. Null turns sort first, ties by role and hash of the text; rows that repeat are turns of their own; a null
or unknown role is free to take any role at COSTS["unknown"]; null text counts as empty; a null conv_id is a conversation of its own; other columns, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
COSTS = {"merge": 10, "insert": 20, "relabel": 31, "unknown": 5}
FAR = 1 << 40
#: (from state, to state): roles that are inserted in between. The automaton's legal steps have none.
STEPS = {
    (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,),
    (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
    (USER, ASSISTANT): (), (USER, USER): (ASSISTANT,),
    (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): (USER,),
}
ENDS = {START: (USER, ASSISTANT), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
ALIASES = {"human": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant"}


def _choices(s: int, role: int | None):
    """(next state, cost, inserted roles, merged, relabelled) of a turn in state s; role None is unknown."""
    for to in (SYSTEM, USER, ASSISTANT):
        changed = role is not None and to != role
        label = COSTS["relabel"] * changed + COSTS["unknown"] * (role is None)
        if (s, to) in STEPS:
            put = STEPS[s, to]
            yield to, label + COSTS["insert"] * len(put), put, False, changed or role is None
        if s == to:
            yield to, label + COSTS["merge"], (), True, changed or role is None


#: For each role (unknown last) and state, the choices in order: without insertions first, then merges, insertions, relabels.
CHOICES = [[sorted(_choices(s, r), key=lambda c: (c[4], len(c[2]), c[3], c[0])) for s in range(4)] for r in (SYSTEM, USER, ASSISTANT, None)]
END_COST = np.array([COSTS["insert"] * len(ENDS[s]) for s in range(4)], np.int64)


def _matrix(kind: int) -> np.ndarray:
    m = np.full((4, 4), FAR, np.int64)
    for s in range(4):
        for c in CHOICES[kind][s]:
            m[s, c[0]] = min(m[s, c[0]], c[1])
    return m


MATRICES = [_matrix(k) for k in range(4)]


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), FAR)


def kind_of(role: str | None) -> int:
    role = (role or "").strip().lower()
    role = ALIASES.get(role, role)
    return ROLES.index(role) if role in ROLES else 3


def _ahead(kinds, end: np.ndarray) -> np.ndarray:
    """Row i: for each state before turn i, the least cost from there on."""
    out = np.empty((len(kinds) + 1, 4), np.int64)
    out[-1] = end
    for i in range(len(kinds) - 1, -1, -1):
        out[i] = np.minimum((MATRICES[kinds[i]] + out[i + 1][None, :]).min(axis=1), FAR)
    return out


def _walk(kinds, ahead, state):
    for i, k in enumerate(kinds):
        # The first choice that is on a path of least cost.
        c = min(CHOICES[k][state], key=lambda c: c[1] + ahead[i + 1][c[0]])
        yield c
        state = c[0]


def repair(roles: list[str | None]):
    """The choices for one conversation, and its cost; the plain form of what the passes below do in stretches."""
    kinds = [kind_of(r) for r in roles]
    ahead = _ahead(kinds, END_COST)
    return list(_walk(kinds, ahead, START)), int(ahead[0][START])


def _stretches(batches, cols):
    """Runs of rows of one conversation as (place in the partition, is last, rows)."""
    held, key, n = [], None, 0
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in cols)):
            if held and row[0] != key:
                yield n, False, held
                held, n = [], n + 1
            key = row[0]
            held.append(row)
    if held:
        yield n, True, held


def _kinds_pass(batches):
    """The matrices of a partition's first and last stretch."""
    part, out = TaskContext.get().partitionId(), []
    first = None
    for n, last, rows in _compact(batches):
        if n == 0 or last:
            out.append((part, n, rows[0], rows[1], *rows[2].ravel().tolist()))
        first = first or n
    yield pa.RecordBatch.from_pylist([dict(zip(EDGE_NAMES, x)) for x in out], EDGE_SCHEMA)


def _compact(batches):
    """As _stretches, but holds each stretch's matrix instead of its rows: (conversation, rows, matrix)."""
    m, key, n, rows, begun = None, None, 0, 0, False
    for b in batches:
        for conv, role in zip(b.column("conv").to_pylist(), b.column("role").to_pylist()):
            if begun and conv != key:
                yield n, False, (key, rows, m)
                n, rows, m = n + 1, 0, None
            begun, key, rows = True, conv, rows + 1
            k = MATRICES[kind_of(role)]
            m = k if m is None else _times(m, k)
    if begun:
        yield n, True, (key, rows, m)


EDGE_NAMES = ["part", "n", "conv", "rows", *(f"m{i}" for i in range(16))]
EDGE_SCHEMA = pa.schema([("part", pa.int32()), ("n", pa.int32()), ("conv", pa.int64()), ("rows", pa.int64()), *((f"m{i}", pa.int64()) for i in range(16))])
EDGES = "part int, n int, conv long, rows long, " + ", ".join(f"m{i} long" for i in range(16))


def _open(role: int) -> str:
    return f"<|{ROLES[role - 1]}|>\n"


CLOSE = "<|end|>\n"


def _piece(choice, state: int, text: str, first: bool, last: bool):
    to, cost, put, merged, relabelled = choice
    if merged:
        s = "\n" + text
    else:
        s = "" if first else CLOSE
        s += "".join(_open(r) + CLOSE for r in put) + _open(to) + text
    end = ENDS[to] if last else ()
    if last:
        s += CLOSE + "".join(_open(r) + CLOSE for r in end)
    return s, cost + COSTS["insert"] * len(end), len(put) + len(end)


def format_chats(turns: DataFrame) -> DataFrame:
    """A row for each turn: conv_id, pos (from 0 in its conversation), turn, role_in, role_out, merged, relabelled, inserted, cost, piece."""
    src = turns.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Rows that are alike in every column would all sort to one place; a seeded number parts them.
    # The driver samples keys for the ranges, so these hold a text's hash and not the text.
    order = ["conv", "turn", "role", "hash", "salt"]
    dealt = src.withColumn("hash", F.xxhash64("text")).withColumn("salt", F.rand(3)).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = _fixed(dealt.select("conv", "turn", "role", "text"))
    edges = sorted(rows.mapInArrow(_kinds_pass, EDGES).collect(), key=lambda r: (r["part"], r["n"]))  # two rows a partition at most
    chains: dict = {}
    for r in edges:
        chains.setdefault(r["conv"], []).append(r)
    ahead, before, spans = {}, {}, {}
    for chain in chains.values():
        v, seen = END_COST, 0
        for i, r in enumerate(reversed(chain)):
            ahead[r["part"], r["n"]] = v
            spans[r["part"], r["n"]] = len(chain) > 1
            v = np.minimum((np.array(r[4:], np.int64).reshape(4, 4) + v[None, :]).min(axis=1), FAR)
        for r in chain:
            before[r["part"], r["n"]] = seen
            seen += r["rows"]
    entered = {k: START for k in ahead}
    if any(spans.values()):
        def leave(batches):
            part, out = TaskContext.get().partitionId(), []
            for n, _, held in _stretches(batches, ("conv", "role")):
                if spans.get((part, n)):
                    kinds = [kind_of(r[1]) for r in held]
                    av = _ahead(kinds, ahead[part, n])
                    out.append({"part": part, "n": n, **{f"s{s}": [*_walk(kinds, av, s)][-1][0] if av[0][s] < FAR else 0 for s in range(4)}})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("part", pa.int32()), ("n", pa.int32()), *((f"s{s}", pa.int32()) for s in range(4))]))

        maps = {(r["part"], r["n"]): r[2:] for r in rows.mapInArrow(leave, "part int, n int, s0 int, s1 int, s2 int, s3 int").collect()}
        for chain in chains.values():
            s = START
            for r in chain:
                entered[r["part"], r["n"]] = s
                if len(chain) > 1:
                    s = maps[r["part"], r["n"]][s]
    ends = {(c[-1]["part"], c[-1]["n"]) for c in chains.values()}

    def render(batches):
        part = TaskContext.get().partitionId()
        out: list[tuple] = []
        for n, _, held in _stretches(batches, ("conv", "turn", "role", "text")):
            at = (part, n)
            kinds, state, pos = [kind_of(r[2]) for r in held], entered.get(at, START), before.get(at, 0)
            av = _ahead(kinds, ahead.get(at, END_COST))
            closes = at in ends or at not in ahead
            for i, (r, c) in enumerate(zip(held, _walk(kinds, av, state))):
                piece, cost, put = _piece(c, state, r[3], pos + i == 0, closes and i == len(held) - 1)
                out.append((r[0], pos + i, r[1], r[2], ROLES[c[0] - 1], c[3], c[4], put, cost, piece))
                state = c[0]
            if len(out) > 5000:
                yield _rows(out)
                out = []
        yield _rows(out)

    return rows.mapInArrow(render, PIECES)


PIECES = "conv_id long, pos long, turn long, role_in string, role_out string, merged boolean, relabelled boolean, inserted int, cost long, piece string"
_PIECE_SCHEMA = pa.schema([("conv_id", pa.int64()), ("pos", pa.int64()), ("turn", pa.int64()), ("role_in", pa.string()), ("role_out", pa.string()), ("merged", pa.bool_()), ("relabelled", pa.bool_()), ("inserted", pa.int32()), ("cost", pa.int64()), ("piece", pa.string())])


def _rows(out):
    cols = list(zip(*out)) or [[]] * len(_PIECE_SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _PIECE_SCHEMA)], schema=_PIECE_SCHEMA)


def _fixed(rows: DataFrame) -> DataFrame:
    """Partitions and their order made fast by a checkpoint, since each pass must see the same stretches."""
    spark = rows.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return rows.checkpoint()


def query(spark, sf_dir):
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
