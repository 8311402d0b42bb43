"""Removal of repeated substrings of SPAN bytes within and across documents.

A byte goes if a SPAN-byte string that covers it also starts earlier (smaller doc_id, then row; or earlier in the document); overlaps count and strings are judged on the input.

Each SPAN-byte window of a text is filed under the least hash of its GRAM-byte strings. Windows that are equal share that hash, and neighbouring windows mostly do, so a text becomes
runs of windows, one row each. Rows meet by hash, in the order of their starts: a run whose bytes were met before goes whole; where runs under a hash differ, the first of each kind is fetched
with its bytes, and the runs of a group of hashes are a collection: its Burrows-Wheeler transform and common prefixes are built column-wise, one symbol of STEP bytes of each sequence a round, and neighbouring suffixes
with SPAN bytes in common are equal windows. Runs with no window whose hash is met twice stay out of it.
Runs, not texts, bound the number of rounds ((RUN + SPAN) / STEP at most), and a collection's size bounds its arrays, so these are rewritten
in memory and not in files.

Null texts count as empty; texts of fewer than SPAN bytes lose nothing; rows that repeat are documents of their own, the first one stays; null ids come last; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, unstage

SPAN, GRAM = 100, 24
WIDE = SPAN - GRAM + 1  # grams in a window
RUN = 128  # windows in a run at most; only runs of a gram that repeats are longer than WIDE
STEP = 4  # bytes in a symbol; SPAN is a multiple of it
TOGETHER = 1 << 18  # bytes of a collection; more only where one hash has more
LAST = (1 << 63) - 1


def _hashes(b: np.ndarray) -> np.ndarray:
    """Mixed polynomial hashes of the GRAM-byte strings."""
    with np.errstate(over="ignore"):
        k = [np.uint64(0x9E3779B97F4A7C15)]
        for _ in range(4):
            k.append(k[-1] * k[-1])
        h = b.astype(np.uint64) + np.uint64(1)
        by = {1: h}
        for j, n in enumerate((1, 2, 4, 8)):
            h = h[:-n] * k[j] + h[n:]
            by[2 * n] = h
        h = by[16][: b.size - GRAM + 1] * k[3] + by[8][16 : 16 + b.size - GRAM + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def _least(h: np.ndarray) -> np.ndarray:
    """Minima of WIDE neighbours."""
    m, n = h, 1
    while 2 * n <= WIDE:
        m = np.minimum(m[:-n], m[n:])
        n *= 2
    rest = WIDE - n
    return np.minimum(m[: m.size - rest], m[rest:]) if rest else m


def runs(raw: bytes):
    """Starts and lengths (in windows) of a text's runs, their hashes, and whether a run may hold a window twice."""
    b = np.frombuffer(raw, np.uint8)
    h = _hashes(b)
    m = _least(h)
    cut = np.flatnonzero(m[1:] != m[:-1]) + 1
    start = np.r_[0, cut]
    size = np.diff(np.r_[start, m.size])
    if (size > RUN).any():
        start = np.concatenate([np.arange(s, s + n, RUN) for s, n in zip(start, size)])
        size = np.diff(np.r_[start, m.size])
    key = m[start]
    s = np.sort(h)
    twice = s[1:][s[1:] == s[:-1]]
    own = np.isin(key, twice) if twice.size else np.zeros(key.size, bool)
    for i in np.flatnonzero(own):
        own[i] = (h[start[i] : start[i] + size[i] + WIDE - 1] == key[i]).sum() > 1
    return start, size, key, own


def _runs(batches):
    for b in batches:
        cols = [[] for _ in range(7)]
        for rid, doc, t in zip(b.column("rid").to_pylist(), b.column("ord").to_pylist(), b.column("text").to_pylist()):
            raw = (t or "").encode("utf-8", "surrogatepass")
            if len(raw) < SPAN:
                continue
            start, size, key, own = runs(raw)
            n = start.size
            d = np.fromiter((xxhash.xxh3_64_intdigest(raw[s:e]) for s, e in zip(start.tolist(), (start + size + SPAN - 1).tolist())), np.uint64, n)
            for c, x in zip(cols, (key.view(np.int64), d.view(np.int64), np.full(n, doc, np.int64), np.full(n, rid, np.int64), start.astype(np.int32), size.astype(np.int32), own)):
                c.append(x)
            if sum(map(len, cols[0])) > 200_000:
                yield _batch(cols)
                cols = [[] for _ in range(7)]
        if cols[0]:
            yield _batch(cols)


NAMES = ["m", "d", "ord", "rid", "s", "n", "own"]


def _batch(cols):
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], NAMES)


def _groups(batches, key="m"):
    """Tables of whole groups; rows come sorted by key."""
    held = []
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        k = t.column(key).to_numpy()
        if held and held[0].column(key)[0].as_py() == k[-1]:
            held.append(t)
            continue
        last = int(np.searchsorted(k, k[-1]))
        if held or last:
            yield pa.concat_tables([*held, t.slice(0, last)])
        held = [t.slice(last)]
    if held:
        yield pa.concat_tables(held)


def _resolve(batches):
    """Runs that were met before (kind 0), and the first of each kind where kinds differ or a run may repeat itself (kind 1)."""
    for t in _groups(batches):
        c = {n: t.column(n).to_numpy() for n in NAMES}
        m, own = c["m"], c["own"].astype(bool)
        same = np.r_[False, m[1:] == m[:-1]]
        many = same | np.r_[same[1:], False]
        out = [np.flatnonzero(~many & own)], [np.flatnonzero(many)]
        alone, at = out[0][0], out[1][0]
        gone, ask = [], alone.tolist()
        firsts: dict = {}
        last = None
        ms, ds, ns = m[at].tolist(), c["d"][at].tolist(), c["n"][at].tolist()
        for i, mm, dd, nn in zip(at.tolist(), ms, ds, ns):
            if mm != last:
                if len(firsts) > 1:
                    ask += firsts.values()
                elif firsts:
                    ask += [x for x in firsts.values() if own[x]]
                firsts, last = {}, mm
            if (dd, nn) in firsts:
                gone.append(i)
            else:
                firsts[dd, nn] = i
        ask += firsts.values() if len(firsts) > 1 else [x for x in firsts.values() if own[x]]
        idx = np.array(gone + ask, np.int64)
        kind = np.r_[np.zeros(len(gone), np.int32), np.ones(len(ask), np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(kind), *(pa.array(c[n][idx]) for n in ("m", "rid", "s", "n"))], ["kind", "m", "rid", "s", "n"])


def _fetch(batches):
    """The bytes of the runs asked for."""
    for b in batches:
        out = [[] for _ in range(5)]
        for rid, doc, t, asked in zip(*(b.column(n).to_pylist() for n in ("rid", "ord", "text", "asked"))):
            raw = (t or "").encode("utf-8", "surrogatepass")
            for x in asked:
                for col, v in zip(out, (x["m"], doc, rid, x["s"], raw[x["s"] : x["s"] + x["n"] + SPAN - 1])):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.binary())], ["m", "ord", "rid", "s", "bytes"])


def _range_minima(v: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minima of v[low..high], both included; only one level of the doubling table is held at a time."""
    out = np.zeros(low.size, v.dtype)
    level = (np.frexp((high - low + 1).astype(np.float64))[1] - 1).astype(np.uint8)
    by_level, stops = np.argsort(level, kind="stable"), np.cumsum(np.bincount(level))
    table, done = v, 0
    for k, stop in enumerate(stops.tolist()):
        if stop > done:
            at = by_level[done:stop]
            out[at] = np.minimum(table[low[at]], table[high[at] - (1 << k) + 1])
            done = stop
        table = np.minimum(table[: -(1 << k)], table[1 << k :])
        if not table.any():  # nor is any minimum of more
            break
    return out


def transform(symbols: np.ndarray, size: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform of a collection (the type's largest number where a sequence begins) and the common prefixes of neighbouring suffixes, at most cap.

    symbols holds the sequences end to end, none empty. Column-wise: round j puts the suffix of length j of every sequence that long into the order of all suffixes. A suffix's place follows from
    the place of the one before it: equal symbols of the transform stand in the order of the suffixes they begin. Its common prefix with a neighbour is one more than the least between the two
    equal symbols. Both arrays are read and rewritten from front to back each round.
    """
    none, end, m = np.iinfo(symbols.dtype).max, np.cumsum(size), size.size
    bwt, lcp = symbols[end - 1], np.zeros(m, np.uint8)
    at = live = np.arange(m)  # rows, ascending, of the newest suffixes, and their sequences
    for j in range(1, int(size.max()) + 1):
        newest = np.zeros(bwt.size, bool)
        newest[at] = True
        order = np.argsort(bwt, kind="stable")
        rank = np.flatnonzero(newest[order])
        row = order[rank]
        who = live[np.searchsorted(at, row)]
        before, after = order[rank - 1], order[np.minimum(rank + 1, order.size - 1)]
        has_before = (rank > 0) & (bwt[before] == bwt[row])
        has_after = (after > row) & (bwt[after] == bwt[row])
        place = m + rank
        after_place = place[has_after] + 1
        least = _range_minima(lcp, np.r_[before[has_before], row[has_after]] + 1, np.r_[row[has_before], after[has_after]])
        least = np.minimum(least + 1, cap).astype(np.uint8)
        old = np.ones(bwt.size + place.size, bool)
        old[place] = False
        wider, longer = np.empty(old.size, bwt.dtype), np.zeros(old.size, np.uint8)
        wider[old], longer[old] = bwt, lcp
        goes_on = size[who] > j
        wider[place] = np.where(goes_on, symbols[end[who] - j - goes_on], none)
        longer[place] = 0
        longer[place[has_before]] = least[: int(has_before.sum())]
        longer[after_place] = least[int(has_before.sum()) :]
        bwt, lcp, at, live = wider, longer, place[goes_on], who[goes_on]
    return bwt, lcp


def met_before(runs_: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that are also in an earlier run or earlier in their own: run, offset and number of neighbouring ones. All runs have SPAN bytes or more.

    A symbol is STEP bytes, and each run gives STEP sequences, one for each remainder of the offset: as many suffixes as by single bytes, in a STEP-th of the rounds.
    """
    text = np.frombuffer(b"".join(runs_), np.uint8)
    stop = np.cumsum([len(x) for x in runs_])
    start = np.r_[0, stop[:-1]]
    parts = [np.arange(a + r, b - STEP + 1, STEP) for a, b in zip(start.tolist(), stop.tolist()) for r in range(STEP)]
    parts = [x for x in parts if x.size]
    place = np.concatenate(parts)  # of each symbol's first byte
    size = np.array([x.size for x in parts], np.int64)
    values, symbols = np.unique(sum(text[place + i].astype(np.uint32) << np.uint32(8 * (STEP - 1 - i)) for i in range(STEP)), return_inverse=True)
    bwt, lcp = transform(symbols.astype(np.uint16 if values.size < 0xFFFF else np.uint32), size, SPAN // STEP)
    end, m = np.cumsum(size), size.size
    order = np.argsort(bwt, kind="stable")[: bwt.size - m]  # where sequences begin sorts last
    step = np.zeros(bwt.size, np.int64)
    step[order] = m + np.arange(order.size)
    begins = np.full(bwt.size, -1, np.int64)  # first byte of each row's suffix
    live, at = np.arange(m), np.arange(m)
    for j in range(1, int(size.max()) + 1):
        at = step[at]
        begins[at] = place[end[live] - j]
        more = size[live] > j
        live, at = live[more], at[more]
    head = np.flatnonzero(lcp < SPAN // STEP)
    first = np.repeat(np.minimum.reduceat(begins, head), np.diff(np.r_[head, lcp.size]))
    met = np.zeros(text.size + 1, bool)
    met[begins[begins != first]] = True
    edge = np.flatnonzero(np.diff(np.r_[False, met]))  # a run's last SPAN - 1 bytes begin no window, so none crosses runs
    opens, closes = edge[::2], edge[1::2]
    run = np.searchsorted(stop, opens, "right")
    return run, opens - start[run], closes - opens


def _compare(batches):
    """Windows met before, by their bytes, as runs; rows come sorted by m, then in the order of their starts. Equal windows have one m, so whole groups of m are a collection."""
    held: list[pa.Table] = []
    for group in _groups(batches):
        held.append(group)
        if sum(t.column("bytes").nbytes for t in held) >= TOGETHER:
            yield _met(held)
            held = []
    if held:
        yield _met(held)


def may_repeat(runs_: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs with a window whose 64-bit hash is met more than once in the collection, and the first and last such offset. Equal windows have equal hashes, so no other run can hold a repeated one."""
    text = np.frombuffer(b"".join(runs_), np.uint8)
    stop = np.cumsum([len(x) for x in runs_])
    with np.errstate(over="ignore"):
        h, n, k = text.astype(np.uint64) + np.uint64(1), 1, np.uint64(0x9E3779B97F4A7C15)
        parts = []  # SPAN's binary digits
        while n <= SPAN:
            if SPAN & n:
                parts.append((h, n, k))
            h, n, k = h[:-n] * k + h[n:], 2 * n, k * k
        whole, at = np.zeros(max(text.size - SPAN + 1, 0), np.uint64), 0
        for h, n, k in parts:
            whole = whole * k + h[at : at + whole.size]
            at += n
    inside = np.ones(whole.size, bool)  # not over two runs
    for e in stop[:-1].tolist():
        inside[e - SPAN + 1 : e] = False
    ordered = np.sort(whole[inside])
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    at = np.flatnonzero(inside)
    if not twice.size:
        return at[:0], at[:0], at[:0]
    near = np.searchsorted(twice, whole[at])
    at = at[twice[np.minimum(near, twice.size - 1)] == whole[at]]
    run = np.searchsorted(stop, at, "right")
    head = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    start = np.r_[0, stop[:-1]]
    return run[head], at[head] - start[run[head]], at[np.r_[head[1:], at.size] - 1] - start[run[head]]


def _met(tables):
    t = pa.concat_tables(tables)
    rid, s, runs_ = t.column("rid").to_numpy(), t.column("s").to_numpy(), t.column("bytes").to_pylist()
    kept, low, high = may_repeat(runs_)
    if kept.size:
        run, offset, n = met_before([runs_[i][a : b + SPAN] for i, a, b in zip(kept.tolist(), low.tolist(), high.tolist())])
    else:
        run = offset = n = np.zeros(0, np.int64)
    at = kept[run]
    return pa.RecordBatch.from_arrays([pa.array(rid[at]), pa.array((s[at] + low[run] + offset).astype(np.int32)), pa.array(n.astype(np.int32))], ["rid", "s", "n"])


def spans_of(gone) -> list[tuple[int, int]]:
    """Maximal removed runs of bytes from runs of windows."""
    out: list[list[int]] = []
    for s, n in sorted((x["s"], x["n"]) for x in gone or []):
        e = s + n + SPAN - 1
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _finish(batches):
    for b in batches:
        total, removed, count, sha, kept = [], [], [], [], []
        for t, gone in zip(b.column("text").to_pylist(), b.column("gone").to_pylist()):
            raw = (t or "").encode("utf-8", "surrogatepass")
            at, parts, spans = 0, [], spans_of(gone)
            for s, e in spans:
                parts.append(raw[at:s])
                at = e
            left = b"".join([*parts, raw[at:]])
            total.append(len(raw)), removed.append(len(raw) - len(left)), count.append(len(spans)), sha.append(hashlib.sha256(left).hexdigest()), kept.append(left)
        yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())], ["rid", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: rid, doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_bytes."""
    spark = docs.sparkSession
    src = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows, _ = staged(src, "repeats-docs")  # written, so that row numbers don't change
    base = rows.select("rid", F.coalesce("doc_id", F.lit(LAST)).alias("ord"), "text")
    order = ["m", "ord", "rid", "s"]
    met = base.mapInArrow(_runs, "m long, d long, ord long, rid long, s int, n int, own boolean")
    met, met_path = staged(met.repartition("m").sortWithinPartitions(*order).mapInArrow(_resolve, "kind int, m long, rid long, s int, n int"), "repeats-runs")
    asked = met.where("kind = 1").groupBy("rid").agg(F.collect_list(F.struct("m", "s", "n")).alias("asked")).withColumnRenamed("rid", "r_")  # a document's own runs
    fetched = base.join(asked, F.col("rid") == F.col("r_")).select("rid", "ord", "text", "asked").mapInArrow(_fetch, "m long, ord long, rid long, s int, bytes binary")
    found, _ = staged(fetched.repartition("m").sortWithinPartitions(*order).mapInArrow(_compare, "rid long, s int, n int"), "repeats-windows")
    gone = met.where("kind = 0").select("rid", "s", "n").unionAll(found)
    gone = gone.groupBy("rid").agg(F.collect_list(F.struct("s", "n")).alias("gone")).withColumnRenamed("rid", "r_")
    return rows.join(gone, F.col("rid") == F.col("r_"), "left").select("rid", "doc_id", "text", "gone").mapInArrow(_finish, "rid long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary")


def query(spark, sf_dir):
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("rid", "kept_bytes")
