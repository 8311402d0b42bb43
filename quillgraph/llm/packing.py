"""Sequence packing as a cutting-stock problem solved by column generation.

Documents become token ids plus an end id; a document longer than a sequence is cut into full sequences and a rest. Pieces fall into length classes of WIDTH
tokens. The class histogram is the demand of a cutting-stock linear program; columns (patterns of classes that fit a sequence) are priced by a knapsack dynamic program
over the duals until none improves. Patterns are rounded down; what is left of the demand, fewer pieces than classes times patterns, is packed first-fit. Pieces
are ranked within their class, and a rank names a pattern's slot, so the plan's size depends on the classes only.

Null texts count as empty and give one piece, the end id. Rows that repeat are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cache, staged

CAPACITY = 4096
WIDTH = 16
END = 2
VOCAB = "word_bpe_49k.json"
CACHE = 500_000  # words whose ids a worker keeps
LONGEST = 48  # longer words aren't kept
BREAK = b"\xff" * 4  # no id


def _classes() -> str:
    """The tokenizer's pattern over characters under U+0180, with line feeds between words kept."""
    of = lambda kind: "".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c))[0] == kind)
    letters, digits, space = of("L"), of("N"), "\t\n\x0b\x0c\r \x85\xa0"
    return f"\n|'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{space}{letters}{digits}]+"


_PARTS = re.compile(_classes()).findall
_OTHER = re.compile("[^\x00-\u017f]|<\\|")  # special tokens begin with <|


def tokenizer_path(name: str = VOCAB) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids as little-endian bytes. The tokenizer parts words at white space, so ids of words met before are looked up. New words of characters under U+0180, where normal form C changes nothing
    and lower case needs no neighbours, are put in lower case and parted by the tokenizer's own pattern here, and only their parts not met before go through its model; other words go through the whole tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model, self.kept, self.old, self.parts = self.tok.model, {"": b""}, {}, {}
        # The model's alphabet shows a byte as its own character where that is a mark or letter, else as the next free character from U+0100 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}

    def _whole(self, w: str) -> bytes:
        return np.array(self.tok.encode(w, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, p: str) -> bytes:
        if not (p.isascii() and p.isprintable()):
            p = p.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.alphabet)
        ids = [t.id for t in self.model.tokenize(p)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        out = {}
        if _OTHER.search("\n".join(words)):
            out = {w: self._whole(w) for w in words if _OTHER.search(w)}
            words = [w for w in words if w not in out]
        if not words:
            return out
        if len(self.parts) > CACHE:
            self.parts = {}
        parts = _PARTS("\n".join(words).lower())
        new = set(parts).difference(self.parts)
        self.parts.update({p: self._part(p) for p in new}, **{"\n": BREAK})
        raw = b"".join(map(self.parts.__getitem__, parts))
        for p in new:
            if len(p) > LONGEST:
                del self.parts[p]
        stop = 4 * np.flatnonzero(np.frombuffer(raw, "<u4") == 0xFFFFFFFF)
        out.update(zip(words, [raw[a:b] for a, b in zip([0, *(stop + 4).tolist()], [*stop.tolist(), len(raw)])]))
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.kept) > CACHE:
            self.old, self.kept = self.kept, {"": b""}
        kept, need = self.kept, set()
        split = [t.replace("\n", " ").split(" ") for t in texts]
        for words in split:
            need.update(words)
        need = need.difference(kept)
        again = need & self.old.keys() if self.old else set()
        kept.update((w, self.old[w]) for w in again)
        new = list(need - again)
        for i in range(0, len(new), 50_000):
            kept.update(self._learn(new[i : i + 50_000]))
        out = [b"".join(map(kept.__getitem__, words)) for words in split]
        for w in new:
            if len(w) > LONGEST:
                del kept[w]
        return out


_encoders: dict[str, Encoder] = cache()


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


PIECE = "rid long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, cls int, part int, nth long"


def _pieces(path: str, keep_ids: bool):
    def run(batches):
        enc, part = encoder(path), TaskContext.get().partitionId()
        met = np.zeros(CAPACITY // WIDTH + 1, np.int64)
        end = END.to_bytes(4, "little")
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            raws = [raw + end for at in range(0, len(texts), 2000) for raw in enc(texts[at : at + 2000])]
            tokens = np.fromiter(map(len, raws), np.int64, len(raws)) // 4
            n = -(-tokens // CAPACITY)  # pieces of each document
            row = np.repeat(np.arange(n.size), n)
            start = (np.arange(row.size) - np.repeat(np.cumsum(n) - n, n)) * CAPACITY
            if row.size > n.size:
                raws = [raws[r][4 * s : 4 * (s + CAPACITY)] for r, s in zip(row.tolist(), start.tolist())]
            length = np.minimum(tokens[row] - start, CAPACITY)
            cls = -(-length // WIDTH)
            # Numbers within a class go on from batch to batch.
            order = np.argsort(cls, kind="stable")
            count = np.bincount(cls, minlength=met.size)
            nth = np.empty(cls.size, np.int64)
            nth[order] = np.arange(cls.size) - np.repeat(np.cumsum(count) - count - met, count)
            met += count
            crc = np.fromiter(map(zlib.crc32, raws), np.int64, len(raws))
            at = pa.array(row)
            cols = [b.column("rid").take(at), b.column("doc_id").take(at), *map(pa.array, (start, length, crc, tokens[row], cls.astype(np.int32), np.full(cls.size, part, np.int32), nth))]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(raws, pa.binary())] * keep_ids, ["rid", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "cls", "part", "nth"] + ["ids"] * keep_ids)

    return run


def price(dual: np.ndarray, limit: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """The bounded knapsack: the pattern of classes 1..size of greatest dual value that fits, by dynamic programming over the room used."""
    best, take = np.zeros(size + 1), []
    for c in range(1, size + 1):
        got = np.zeros(size + 1, np.int32)
        if dual[c] > 1e-12 and limit[c] > 0:
            base = best
            best = base.copy()
            for n in range(1, min(int(limit[c]), size // c) + 1):
                with_n = base[: size + 1 - n * c] + n * dual[c]
                better = with_n > best[n * c :] + 1e-12
                best[n * c :][better] = with_n[better]
                got[n * c :][better] = n
        take.append(got)
    pattern, room = np.zeros(size + 1, np.int64), int(np.argmax(best))
    value = float(best[room])
    for c in range(size, 0, -1):
        n = take[c - 1][room]
        pattern[c] = n
        room -= n * c
    return pattern, value


def solve(demand: np.ndarray, size: int) -> list[tuple[np.ndarray, float]]:
    """The linear program by column generation with a revised simplex: (pattern, times) pairs. It ends when no column prices under its cost, or when degenerate steps have left the
    value as it was for as many rounds as there are patterns in a basis, four times over."""
    rows = np.flatnonzero(demand)
    if not rows.size:
        return []
    m = rows.size
    fit = np.zeros(size + 1, np.int64)
    fit[rows] = size // rows
    basis = np.zeros((m, m))
    np.fill_diagonal(basis, fit[rows])
    inverse = np.diag(1.0 / fit[rows])
    x = inverse @ demand[rows].astype(float)
    k, least, since = 0, float("inf"), 0
    while since <= 4 * m:
        k += 1
        dual = np.zeros(size + 1)
        dual[rows] = inverse.sum(axis=0)  # every column costs one sequence
        pattern, value = price(dual, np.minimum(fit, demand), size)
        if value <= 1 + 1e-7:
            break
        col = inverse @ pattern[rows]
        up = col > 1e-9
        ratio = np.where(up, x / np.where(up, col, 1), np.inf)
        r = int(np.argmin(ratio))
        step = ratio[r]
        x = x - step * col
        x[r] = step
        basis[:, r] = pattern[rows]
        total = float(x.sum())
        least, since = (total, 0) if total < least - 1e-9 * max(1.0, least if least < float("inf") else 1.0) else (least, since + 1)
        if k % 64 == 0:  # fresh inverse against drift
            inverse = np.linalg.inv(basis)
            x = inverse @ demand[rows].astype(float)
        else:
            pivot = inverse[r] / col[r]
            inverse = inverse - np.outer(col, pivot)
            inverse[r] = pivot
    out = []
    for j in range(m):
        p = np.zeros(size + 1, np.int64)
        p[rows] = np.rint(basis[:, j]).astype(np.int64)
        out.append((p, max(0.0, float(x[j]))))
    return out


def plan(demand: np.ndarray, size: int) -> list[tuple[np.ndarray, int]]:
    """Whole patterns that hold exactly the demand: the rounded program, then first fit, longest first, for what is left."""
    left = demand.astype(np.int64).copy()
    out = []
    for p, times in solve(demand, size):
        used = p > 0
        n = min(int(times + 1e-6), int((left[used] // p[used]).min())) if used.any() else 0
        if n:
            left -= n * p
            out.append((p, n))
    while left.any():
        p, room = np.zeros(size + 1, np.int64), size
        for c in range(size, 0, -1):
            n = min(int(left[c]), room // c)
            p[c], room = n, room - n * c
        used = p > 0
        n = int((left[used] // p[used]).min())
        left -= n * p
        out.append((p, n))
    return out


def _slots(patterns, size: int) -> tuple[np.ndarray, ...]:
    """Blocks of ranks, ascending by class and rank: class, first rank, its pattern's first sequence, copies of the class in the pattern, and the class's place there. A row for each class of each pattern."""
    rows, first, ranks = [], 0, np.zeros(size + 1, np.int64)
    for p, n in patterns:
        at = 0
        for c in np.flatnonzero(p)[::-1].tolist():
            k = int(p[c])
            rows.append((c, int(ranks[c]), first, k, at))
            ranks[c] += n * k
            at += k
        first += n
    return tuple(np.array(sorted(rows), np.int64).reshape(-1, 5).T)


def pack(docs: DataFrame, path: str | None = None, id_col="doc_id", text_col="text", keep_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (little-endian) if asked for."""
    src = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces, _ = staged(src.mapInArrow(_pieces(path or tokenizer_path(), keep_ids), PIECE + ", ids binary" * keep_ids), "pack")
    # Pieces of each class in each task: as many rows as tasks times classes, whatever the corpus.
    met = pieces.groupBy("part", "cls").agg((F.max("nth") + 1).alias("n"))
    met, _ = staged(met.select(F.col("part").alias("p_"), F.col("cls").alias("c_"), "n", (F.sum("n").over(Window.partitionBy("cls").orderBy("part")) - F.col("n")).alias("before")), "pack-met")
    size = CAPACITY // WIDTH
    demand = np.zeros(size + 1, np.int64)
    for r in met.groupBy("c_").agg(F.sum("n").alias("n")).collect():
        demand[r["c_"]] = r["n"]
    cls, begin, first, copies, at = _slots(plan(demand, size), size)
    wide = int(demand.max()) + 1
    keys = cls * wide + begin

    def place(batches):
        for b in batches:
            k = b.column("rank").to_numpy()
            i = np.searchsorted(keys, b.column("cls").to_numpy().astype(np.int64) * wide + k, "right") - 1
            q, r = np.divmod(k - begin[i], copies[i])
            keep = [n for n in b.schema.names if n not in ("cls", "rank")]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(first[i] + q), pa.array(at[i] + r)], [*keep, "sequence_id", "place"])

    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids
    ranked = pieces.join(met, (F.col("part") == F.col("p_")) & (F.col("cls") == F.col("c_"))).select(*cols, "cls", (F.col("before") + F.col("nth")).alias("rank"))
    placed = ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, " + "ids binary, " * keep_ids + "sequence_id long, place long")
    # A sequence holds CAPACITY pieces at most.
    before = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long"))).drop("place")


def query(spark, sf_dir):
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
