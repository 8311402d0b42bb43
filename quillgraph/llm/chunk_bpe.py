"""BPE encoding with reuse of content-defined chunks, and decoding.

A rolling hash over the last WINDOW bytes cuts each text where its leading bits are zero, so that a passage is cut alike wherever it stands. Chunks are told apart by a 128-bit BLAKE2 digest. Those that
stand in two places or more are encoded once, at their first place; every text that holds them takes their ids from there, and encodes only the stretches between them. A chunk's own ids may be wrong at
its ends, since a cut may part a word. So each join is repaired: the last words before it and the first after it are encoded together, with a further word as a guard on either side, and the window grows
until the guards' ids agree with those that the chunks gave them (or until it holds all there is on that side). Texts without a shared chunk are encoded where they are and not shuffled.

Decoding joins the tokens' own strings with a space, as the tokenizer does without a decoder of its own.

Null texts count as empty: no ids. Very long texts are cut into more chunks; a text is held whole by one task. Rows that repeat keep a row each, and so do equal texts; an empty table gives an empty result. Only the
columns of id and text are read, so that further columns may have any name.
"""

from __future__ import annotations

from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, parted, small_batches, staged, unstage
from .packing import encoder, tokenizer_path

WINDOW = 32  # bytes that the rolling hash sees
BITS = 9  # a cut every 512 bytes on average
LEAST, MOST = 64, 4096  # bytes of a chunk
_GEAR = np.array([int.from_bytes(blake2b(bytes([b]), digest_size=4).digest(), "little") for b in range(256)], np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte the hash of the WINDOW bytes that end there: each byte's number, shifted by its distance. Doubling gives it in five passes."""
    h, s = _GEAR[data], 1
    while s < WINDOW:
        h[s:] = h[s:] + (h[:-s] << np.uint32(s))
        s *= 2
    return h


def cuts(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """For each text, which is data[offsets[i]:offsets[i + 1]], where its chunks begin, and its end. No cut parts a character."""
    inner = (data & 0xC0) == 0x80
    at = np.flatnonzero(rolling(data) >> np.uint32(32 - BITS) == 0) + 1
    at = at[at < data.size]
    at = at[~inner[at]]
    bounds, at, out = np.searchsorted(at, offsets), at.tolist(), []
    for i, (s, e) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        own, last = [s], s
        for c in [*at[bounds[i] : bounds[i + 1]], e]:
            while c - last > MOST:
                last += MOST
                while inner[last]:
                    last -= 1
                own.append(last)
            if c < e and c - last >= LEAST:
                own.append(last := c)
        out.append([*own, e] if e > s else [])
    return out


def _bytes(column) -> tuple[memoryview, np.ndarray, np.ndarray]:
    """The bytes of all texts, also as an array, and the offsets of each text."""
    a = column.cast(pa.large_binary())
    _, off, buf = a.buffers()
    offsets = np.frombuffer(off, np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    return memoryview(data), data, offsets - offsets[0]


def _digest(chunk) -> bytes:
    return blake2b(chunk, digest_size=16).digest()


def _chunks(batches):
    """A row for each chunk of each text: key, id, number, digest."""
    for b in batches:
        raw, data, offsets = _bytes(b.column("text"))
        row, no, digest = [], [], []
        for i, c in enumerate(cuts(data, offsets)):
            row += [i] * (len(c) - 1)
            no += range(len(c) - 1)
            digest += [_digest(raw[s:e]) for s, e in zip(c, c[1:])]
        at = pa.array(row, pa.int32())
        yield pa.RecordBatch.from_arrays([b.column("key").take(at), b.column("id").take(at), pa.array(no, pa.int32()), pa.array(digest, pa.binary())], ["key", "id", "no", "digest"])


def _first(path: str):
    """The ids of the chunks named in want, each encoded by itself."""

    def run(batches):
        enc = encoder(path)
        for b in batches:
            raw, data, offsets = _bytes(b.column("text"))
            digest, texts = [], []
            for c, want in zip(cuts(data, offsets), b.column("want").to_pylist()):
                for w in want:
                    digest.append(w["digest"])
                    texts.append(str(raw[c[w["no"]] : c[w["no"] + 1]], "utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array([_narrow(x) for x in enc(texts)], pa.binary())], ["digest", "ids"])

    return run


def _narrow(ids: bytes) -> bytes:
    """Ids as little-endian 16-bit numbers if they all fit, behind a byte that says so."""
    wide = np.frombuffer(ids, "<u4")
    return b"\x02" + wide.astype("<u2").tobytes() if not wide.size or wide.max() < 1 << 16 else b"\x04" + ids


def _widen(ids: bytes) -> bytes:
    return np.frombuffer(ids, f"<u{ids[0]}", offset=1).astype("<u4").tobytes()


def _back(text: bytes, lo: int, end: int, words: int) -> int:
    """Where the last words before end begin, behind a space, or lo."""
    for _ in range(words):
        end = text.rfind(b" ", lo, end)
        if end < 0:
            return lo
    return end + 1


def _forth(text: bytes, start: int, hi: int, words: int) -> int:
    """Where the first words from start on end, before a space, or hi."""
    start -= 1
    for _ in range(words):
        start = text.find(b" ", start + 1, hi)
        if start < 0:
            return hi
    return start


class Joiner:
    """Puts the ids of stretches together. enc gives the ids (bytes) of texts."""

    def __init__(self, enc):
        self.enc, self.grown = enc, 0

    def _window(self, text: bytes, lo: int, at: int, hi: int, words: int):
        """The window around the join at: where it and its guards begin and end; the texts of left, right, both, and the guards."""
        a, b = _back(text, lo, at, words + 1), _forth(text, at, hi, words + 1)
        ga = min(_forth(text, a, at, 1), at) if a > lo else a
        gb = max(_back(text, at, b, 1), at) if b < hi else b
        return a, b, [str(text[i:j], "utf-8", "replace") for i, j in ((a, at), (at, b), (a, b), (a, ga), (gb, b))]

    def joined(self, texts: list[bytes], stretches: list[list[tuple[int, int, bytes]]]) -> list[bytes]:
        """For each text the ids of its stretches (begin, end, own ids), repaired at their joins."""
        joins = [(t, k) for t, own in enumerate(stretches) for k in range(1, len(own))]
        windows = [self._window(texts[t], 0, stretches[t][k][0], stretches[t][k][1], 1) for t, k in joins]
        ids = self.enc([x for _, _, five in windows for x in five])
        first = {j: (*w[:2], ids[5 * i : 5 * i + 5]) for i, (j, w) in enumerate(zip(joins, windows))}
        out = []
        for t, own in enumerate(stretches):
            if not own:
                out.append(b"")
                continue
            parts = [own[0][2]]
            for k in range(1, len(own)):
                at, hi, new = own[k]
                a, b, five = first[t, k]
                words = 1
                while not self._agree(parts, new, a, at, b, hi, five):
                    words *= 2
                    self.grown += 1
                    a, b, five = self._window(texts[t], 0, at, hi, words)
                    five = self.enc(five)
                left, right, both = five[:3]
                self._cut(parts, len(left)) if a else parts.clear()
                parts += [both, new[len(right) :] if b < hi else b""]
            out.append(b"".join(parts))
        return out

    @staticmethod
    def _tail(parts: list[bytes], n: int) -> bytes:
        tail = b""
        for p in reversed(parts):
            if len(tail) >= n:
                break
            tail = p[-(n - len(tail)) :] + tail
        return tail

    @staticmethod
    def _cut(parts: list[bytes], n: int) -> None:
        while n:
            p = parts.pop()
            if len(p) > n:
                parts.append(p[:-n])
                return
            n -= len(p)

    def _agree(self, parts, new, a, at, b, hi, five) -> bool:
        left, right, both, before, after = five
        ok = not a or self._tail(parts, len(left)) == left and both.startswith(before) and left.startswith(before)
        return ok and (b >= hi or new.startswith(right) and both.endswith(after) and right.endswith(after))


_shown: dict[str, list[bytes]] = {}


def shown(path: str) -> list[bytes]:
    """Each id's token and a space, as UTF-8."""
    if path not in _shown:
        tok = encoder(path).tok
        _shown[path] = [(tok.id_to_token(i) or "").encode() + b" " for i in range(max(tok.get_vocab(with_added_tokens=True).values()) + 1)]
    return _shown[path]


def decoded(path: str, ids: bytes) -> bytes:
    """The text of ids (little-endian 32-bit), special tokens included."""
    return b"".join(map(shown(path).__getitem__, np.frombuffer(ids, "<u4").tolist()))[:-1]


def _texts(path: str, keep_ids: bool):
    """The ids of each text; shared names its shared chunks with their ids, if it has any."""

    def run(batches):
        enc = encoder(path)
        joiner = Joiner(enc)
        for b in batches:
            raw, data, offsets = _bytes(b.column("text"))
            whole = [bytes(raw[s:e]).replace(b"\n", b" ") for s, e in zip(offsets.tolist(), offsets[1:].tolist())]
            shared = b.column("shared").to_pylist() if "shared" in b.schema.names else [None] * len(whole)
            stretches, at = [], cuts(data, offsets) if any(shared) else [None] * len(whole)
            local = []  # (text, stretch, its own text)
            for t, (text, c, got) in enumerate(zip(whole, at, shared)):
                own, ids = [], {x["no"]: x["ids"] for x in got or ()}
                if not ids:
                    own = [(0, len(text), None)] if text else []
                else:
                    base = c[0]
                    for k, (s, e) in enumerate(zip(c, c[1:])):
                        if k in ids:
                            own.append((s - base, e - base, _widen(ids[k])))
                        elif own and own[-1][2] is None:
                            own[-1] = (own[-1][0], e - base, None)
                        else:
                            own.append((s - base, e - base, None))
                local += [(t, k, str(text[s:e], "utf-8", "replace")) for k, (s, e, x) in enumerate(own) if x is None]
                stretches.append(own)
            for (t, k, _), ids in zip(local, enc([x for _, _, x in local])):
                stretches[t][k] = (*stretches[t][k][:2], ids)
            ids = joiner.joined(whole, stretches)
            cols = [b.column("id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([sha256(x).hexdigest() for x in ids]), pa.array([sha256(decoded(path, x)).hexdigest() for x in ids])]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.binary())] * keep_ids, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids)

    return run


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """A row for each row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids (little-endian 32-bit) if asked for."""
    path, spark = path or tokenizer_path(), docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("key", F.unhex(F.sha2("text", 256)))
    kind = src.schema["id"].dataType.simpleString()
    with small_batches(spark):
        chunks, p1 = staged(src.mapInArrow(_chunks, f"key binary, id {kind}, no int, digest binary"), "bpe-chunks")
        met = chunks.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("key", "id", "no")).alias("at")).where("n > 1").drop("n")
        met, p2 = staged(met, "bpe-met")
        # One place each; rows that repeat with their id may be that place together.
        want = met.groupBy(F.col("at.key").alias("k_"), F.col("at.id").alias("i_")).agg(F.collect_list(F.struct(F.col("at.no").alias("no"), "digest")).alias("want"))
        want, p3 = staged(want, "bpe-want")
        near, _ = parted(src, want.select(F.col("k_").alias("key")), "key")
        firsts = near.join(want, (F.col("key") == F.col("k_")) & F.col("id").eqNullSafe(F.col("i_"))).select("text", "want")
        ids, p4 = staged(firsts.mapInArrow(_first(path), "digest binary, ids binary").dropDuplicates(["digest"]), "bpe-ids")
        # Equal texts hold the same chunks, so a text's chunks are named once, whatever its copies.
        held = chunks.join(met.select("digest"), "digest", "left_semi").select("key", "no", "digest").distinct()
        held, p5 = staged(held.join(ids, "digest").groupBy("key").agg(F.collect_list(F.struct("no", "ids")).alias("shared")).withColumnRenamed("key", "k_"), "bpe-held")
        unstage(spark, p1, p2, p3, p4)
        forget(spark)
        schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
        near, far = parted(src, held.select(F.col("k_").alias("key")), "key")
        reused = near.join(held, F.col("key") == F.col("k_"), "left").select("id", "text", "shared").mapInArrow(_texts(path, keep_ids), schema)
        out, _ = staged(reused.unionAll(far.select("id", "text").mapInArrow(_texts(path, keep_ids), schema)), "bpe-out")
        unstage(spark, p5)
    return out


def query(spark, sf_dir):
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
