"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints of 64 bits link at 4 differing bits at most. Cut into three segments, one segment of any such pair differs by one bit at
most. So each distinct fingerprint is indexed 64 times: for every bit, by its segment with that bit wiped. Fingerprints that meet under a
signature are verified on all 64 bits; of each bucket only a spanning forest of its verified links leaves the task. Components follow by alternating
large-star and small-star rounds over written tables.

Rows that share a fingerprint are one node from the start, so copies never meet in pairs. Null and empty texts have fingerprint zero and link
like any other. Rows that repeat keep a row each. A component's id is its smallest non-null doc_id.

That is op9's contract. near_dedup, the pipeline's stage, links at a similarity (common shingles over all shingles) of 4/5 or more of the sets of five-word shingles. Its candidates are the pairs that the fingerprints of five-word shingles link by the same
signatures; the whole sets then decide. Most pairs so similar differ in more than BITS bits (about ten at 4/5), so an exact check follows that misses none: sets are put in one fixed order, and two sets that alike share one of their first n - ceil(4n/5) + 1 shingles. The order is by how often a
sample holds a shingle, rare ones first, so the sample bears on cost only, not on what is found. Sets that meet are held to the bounds that their sizes and places give, then to the bound of their sketches (parities in slots), which loses no similar pair either; pairs left
are compared on the whole sets. First rows of a bucket are compared with neighbours of other components only (by size, then by chance); then all pairs whose rows aren't in one component yet; those take the bound of brief sketches, of BRIEF slots, in the bucket itself. Equal sets are one node. Texts of fewer than
five words are one shingle, so null and empty texts are alike. Shingles are 64-bit hashes, equal sets 128-bit ones.
"""

from __future__ import annotations

from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, free, left, parted, plain, small_batches, staged, unstage, without

BITS, SEGMENTS = 4, ((0, 21), (21, 42), (42, 64))
SHINGLE = 5  # words of near_dedup's shingles
ORDER_ROWS, ORDER_SHINGLES = 20_000, 100_000  # sample and length of the list of common shingles; they bear on cost only
CHANCES = 2  # rounds in which near_dedup compares neighbours in an order by chance; they bear on cost only
BRIEF = 1024  # slots of the sketch that rows carry into their buckets; it bears on cost only
SMALL = 8  # buckets up to this size are compared all at once in numpy


def hashes(text: str | None, n: int) -> np.ndarray:
    """Hashes of a text's n-word shingles, repeats included; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    parts = [joined[a : b - 1] for a, b in zip([0, *ends[:-1]], ends[n - 1 :])] or [joined]
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), np.uint64, len(parts))


def majority_bits(h: np.ndarray) -> int:
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > h.size, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = 4) -> int:
    return majority_bits(hashes(text, shingle)) if text and text.strip(" \t\n\x0b\x0c\r") else 0


def _fingerprints(shingle):
    def run(batches):
        for b in batches:
            f = np.fromiter((fingerprint(t, shingle) for t in b.column("text").to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("doc_id"), pa.array(f.view(np.int64))], ["rid", "doc_id", "fp"])

    return run


def _far(a, b):
    return np.bitwise_count(a ^ b)


def _forest(members: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints. A found member leaves the set that later ones are held against."""
    left, links = members, []
    while left.size:
        queue, left = [left[0]], left[1:]
        while queue and left.size:
            x = queue.pop()
            near = _far(left, x) <= BITS
            if near.any():
                got = left[near]
                left = left[~near]
                links += [(x, y) for y in got]
                queue += list(got)
    return links


def _runs(keys: np.ndarray, fps: np.ndarray):
    """Links within runs of equal keys."""
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    start, end = np.r_[0, cut], np.r_[cut, keys.size]
    size = end - start
    run = np.repeat(np.arange(size.size), size)
    small = np.repeat(size <= SMALL, size)
    u, v = [], []
    for d in range(1, min(SMALL, keys.size)):
        ok = small[:-d] & (run[:-d] == run[d:]) & (_far(fps[:-d], fps[d:]) <= BITS)
        u.append(fps[:-d][ok])
        v.append(fps[d:][ok])
    for i in np.flatnonzero(size > SMALL):
        if pairs := _forest(np.unique(fps[start[i] : end[i]])):
            a, b = zip(*pairs)
            u.append(np.array(a, np.uint64))
            v.append(np.array(b, np.uint64))
    return (np.concatenate(u), np.concatenate(v)) if u else (fps[:0], fps[:0])


def _links(batches):
    """Rows come sorted by key; the last run of a batch waits for the next batch."""
    keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)

    def out(k, f):
        u, v = _runs(k, f)
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(u.view(np.int64), v.view(np.int64))), pa.array(np.minimum(u.view(np.int64), v.view(np.int64)))], ["u", "v"])

    wait = []
    for b in batches:
        k, f = b.column("key").to_numpy(), b.column("fp").to_numpy().view(np.uint64)
        if not k.size:
            continue
        if k[0] == k[-1] and (not wait or wait[0][0][-1] == k[0]):
            wait.append((k, f))
            continue
        keys, fps = np.concatenate([*(x[0] for x in wait), k]), np.concatenate([*(x[1] for x in wait), f])
        last = np.searchsorted(keys, keys[-1])
        yield out(keys[:last], fps[:last])
        wait = [(keys[last:], fps[last:])]
    if wait:
        yield out(np.concatenate([x[0] for x in wait]), np.concatenate([x[1] for x in wait]))


def links(nodes: DataFrame) -> DataFrame:
    """Verified links (u > v) between distinct fingerprints fp: a spanning forest of each signature's bucket."""
    keys = []
    for a, b in SEGMENTS:
        for bit in range(a, b):
            mask = ((1 << (b - a)) - 1) & ~(1 << (bit - a))
            keys.append(F.shiftrightunsigned("fp", a).bitwiseAND(F.lit(mask)).bitwiseOR(F.lit(bit << 22)))
    # Buckets are found by equality of the whole key; the partition is only a place to sort it.
    dealt = nodes.select("fp", F.explode(F.array(*keys)).alias("key")).repartition("key").sortWithinPartitions("key")
    return dealt.select("key", "fp").mapInArrow(_links, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """For each node of an edge list (u, v): node, root, the smallest node of its component."""
    spark = edges.sparkSession
    cur, path = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "cc")
    mark = None
    while True:
        both = cur.unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(low, both["u"] == low["k"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(low, large["u"] == low["k"]).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        new, new_path = staged(small, "cc")
        now = new.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        unstage(spark, path)
        cur, path = new, new_path
        if now == mark:
            break
        mark = now
    roots = cur.select("v").distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rid_col: str | None = None, shingle: int = 4) -> DataFrame:
    """A row for each row of docs: rid, doc_id, fp, component_id, and kept (the row that stays of a component: smallest doc_id, then first row)."""
    src = docs.select((F.col(rid_col) if rid_col else F.monotonically_increasing_id()).alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    prints, _ = staged(src.mapInArrow(_fingerprints(shingle), "rid long, doc_id long, fp long"), "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("rid").alias("r")))
    nodes, _ = staged(prints.groupBy("fp").agg(first.alias("first")), "simhash-nodes")
    comp, _ = staged(components(links(nodes)), "simhash-cc")
    labelled = nodes.join(comp, nodes["fp"] == comp["node"], "left").select(F.col("fp").alias("k"), F.coalesce("root", "fp").alias("root"), "first")
    best = labelled.groupBy("root").agg(F.min("first").alias("best")).withColumnRenamed("root", "root_")
    of = labelled.join(best, labelled["root"] == best["root_"]).select("k", "best")
    return prints.join(of, prints["fp"] == of["k"]).select("rid", "doc_id", "fp", F.col("best.d").alias("component_id"), (F.col("rid") == F.col("best.r")).alias("kept"))


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of a text's n-word shingles, ascending; a shorter text is one shingle."""
    return np.unique(hashes(text, n).view(np.int64))


def alike(common, a, b):
    """Whether sets of a and b members, common of them shared, are similar at 4/5 or more."""
    return 9 * common >= 4 * (a + b)


def _lists(sets):
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))


def _shingled(batches):
    free()
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("rid"), _lists([shingles(t) for t in b.column("text").to_pylist()])], ["rid", "set"])


def sketch(s: np.ndarray, slots: int = 0) -> bytes:
    """Parities of a set's members dealt to slots, a power of two of them and, if not given, twice as many as members at least. Halves of a sketch, added, are the sketch of half as many slots."""
    slots = slots or 1 << max(3, int(2 * s.size - 1).bit_length())
    return np.packbits(np.bincount(s & (slots - 1), minlength=slots) & 1, bitorder="little").tobytes()


def most_common(a: int, b: int, x: bytes, y: bytes) -> int:
    """The most members that sets of a and b members can share by their sketches: each slot of unlike parity holds a member of one set only."""
    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while p.size > q.size:
        p = p[: p.size // 2] ^ p[p.size // 2 :]
    while q.size > p.size:
        q = q[: q.size // 2] ^ q[q.size // 2 :]
    return (a + b - int(np.bitwise_count(p ^ q).sum())) // 2


def _possible(batches):
    """Pairs whose sketches allow them to be similar."""
    for b in batches:
        ok = [bool(alike(most_common(m, n, x, y), m, n)) for m, n, x, y in zip(*(b.column(c).to_pylist() for c in ("m", "n", "x", "y")))]
        yield b.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))


def _prefixes(common, ranks):
    """A row for each text: its fingerprint, a digest, the size, the sketch and the brief sketch of its set, and the set's prefix in the order."""

    def run(batches):
        free()
        for b in batches:
            prints, digest, sizes, sketches, briefs, heads = [], [], [], [], [], []
            for t in b.column("text").to_pylist():
                h = hashes(t, SHINGLE)
                prints.append(majority_bits(h))
                s = np.unique(h.view(np.int64))
                digest.append(xxhash.xxh128_digest(s.tobytes()))
                sizes.append(s.size)
                sketches.append(sketch(s))
                briefs.append(sketch(s, BRIEF))
                if common.size:
                    i = np.minimum(np.searchsorted(common, s), common.size - 1)
                    s = s[np.argsort(np.where(common[i] == s, ranks[i], 0), kind="stable")]
                heads.append(s[: s.size - (4 * s.size + 4) // 5 + 1].copy())  # not the whole set
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("doc_id"), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(digest, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(briefs, pa.binary()), _lists(heads)], ["rid", "doc_id", "fp", "digest", "n", "sketch", "brief", "head"])

    return run


def _whole_runs(batches):
    """Tables of rows that come sorted by key, cut between keys only."""
    free()
    wait = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column("key").to_numpy()
        if wait and wait[0].column("key")[0].as_py() == k[-1]:
            wait.append(b)
            continue
        last = int(np.searchsorted(k, k[-1]))
        if wait or last:
            yield pa.Table.from_batches([*wait, b.slice(0, last)]).combine_chunks()
        wait = [b.slice(last)]
    if wait:
        yield pa.Table.from_batches(wait).combine_chunks()


def _met(batches):
    """Rows of keys that two sets hold."""
    for t in _whole_runs(batches):
        k = t.column("key").to_numpy()
        same = k[1:] == k[:-1]
        yield from t.filter(pa.array(np.r_[False, same] | np.r_[same, False])).to_batches()


def _other_root(key, root):
    """For each row, the place of the next row that has its key and another root, or -1; rows of one root that follow each other are a run."""
    cut = np.flatnonzero((key[1:] != key[:-1]) | (root[1:] != root[:-1])) + 1
    after = np.repeat(np.r_[cut, key.size], np.diff(np.r_[0, cut, key.size]))
    return np.where((after < key.size) & (key[np.minimum(after, key.size - 1)] == key), after, -1)


def _adjacent(key, n, root):
    """Pairs of each row with the next and with the last row before it of another root in its bucket: two a row at most."""
    after = _other_root(key, root)
    before = key.size - 1 - _other_root(key[::-1], root[::-1])[::-1]  # where there is none: key.size
    i, j = np.flatnonzero(after >= 0), np.flatnonzero(before < key.size)
    yield np.r_[i, before[j]], np.r_[after[i], j]


def _all_pairs(key, n, root):
    """All pairs of a bucket whose roots differ and whose sizes allow them. One of such a pair isn't of the bucket's most frequent root, so only rows of other roots look for partners."""
    order = np.lexsort((root, key))
    k, r = key[order], root[order]
    head = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (r[1:] != r[:-1])])
    size = np.diff(np.r_[head, k.size])
    by_size = np.lexsort((-size, k[head]))
    most = by_size[np.r_[True, k[head][by_size][1:] != k[head][by_size][:-1]]]  # one run a key, in the order of keys
    often = r[head][most][np.searchsorted(k[head][most], key)]
    few = root != often
    begin, end = np.searchsorted(key, key, side="left"), np.searchsorted(key, key, side="right")
    up = down = np.flatnonzero(few)
    d = 1
    # Sizes ascend in a bucket: a row whose partner d places on is too large, or d places back too small, has none further.
    while up.size or down.size:
        up = up[up + d < end[up]]
        up = up[4 * n[up + d] <= 5 * n[up]]
        down = down[down - d >= begin[down]]
        down = down[4 * n[down] <= 5 * n[down - d]]
        back = down[~few[down - d]]  # the partner doesn't look for itself
        yield np.r_[up, back - d], np.r_[up + d, back]
        d += 1


def _allowed(t, pairs_of):
    """Those of a bucket's pairs that its sizes and places allow, of rows that aren't in one component."""
    key, n, at, root = (t.column(c).to_numpy() for c in ("key", "n", "at", "root"))
    for i, j in pairs_of(key, n, root):
        ok = (4 * n[j] <= 5 * n[i]) & (4 * n[i] <= 5 * n[j]) & (root[i] != root[j]) & alike(np.minimum(n[i] - at[i], n[j] - at[j]), n[i], n[j])
        if ok.any():
            yield i[ok], j[ok]


def _open(batches):
    """Rows that an allowed pair holds: as many as come in at most, whatever the number of pairs."""
    for t in _whole_runs(batches):
        held = np.zeros(t.num_rows, bool)
        for i, j in _allowed(t, _all_pairs):
            held[i] = held[j] = True
        yield from t.filter(pa.array(held)).to_batches()


def _candidates(pairs_of):
    """Allowed pairs; where rows carry brief sketches, those that they leave."""

    def run(batches):
        for t in _whole_runs(batches):
            node, n = t.column("node").to_numpy(), t.column("n").to_numpy()
            bits = np.frombuffer(b"".join(t.column("brief").to_pylist()), np.uint64).reshape(-1, BRIEF // 64) if "brief" in t.column_names else None
            for i, j in _allowed(t, pairs_of):
                if bits is not None:
                    ok = alike((n[i] + n[j] - np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)) // 2, n[i], n[j])
                    i, j = i[ok], j[ok]
                u, v = node[i], node[j]
                if u.size:
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])

    return run


def _similar(batches):
    for b in batches:
        if b.num_rows:
            x, y = b.column("x"), b.column("y")
            ok = [alike(np.intersect1d(s.values.to_numpy(), o.values.to_numpy(), assume_unique=True).size, len(s.values), len(o.values)) for s, o in zip(x, y)]
            yield b.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))


def _verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (u, v) whose whole sets are similar, from the texts of rows."""
    ids, _ = staged(pairs.select(F.explode(F.array("u", "v")).alias("rid")).distinct(), "near-ids")
    maybe, _ = parted(rows.select("rid", "text"), ids)
    sets, _ = staged(maybe.join(ids.withColumnRenamed("rid", "id"), F.col("rid") == F.col("id"), "left_semi").mapInArrow(_shingled, "rid long, set array<long>"), "near-sets")
    x, y = sets.toDF("a_", "x"), sets.toDF("b_", "y")
    both = pairs.join(x, F.col("u") == F.col("a_")).join(y, F.col("v") == F.col("b_"))
    return both.select("u", "v", "x", "y").mapInArrow(_similar, "u long, v long")


def fingerprint_pairs(prints: DataFrame) -> DataFrame:
    """Pairs (u > v) of the rows (node, fp) that the fingerprints allow: each row and the first of its fingerprint, and the firsts of fingerprints that links joins."""
    first, _ = staged(prints.groupBy("fp").agg(F.min("node").alias("first")), "near-prints")
    same = prints.join(first.withColumnRenamed("fp", "f_"), F.col("fp") == F.col("f_")).where("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    near = links(first.select("fp")).join(first.toDF("a_", "x"), F.col("u") == F.col("a_")).join(first.toDF("b_", "y"), F.col("v") == F.col("b_"))
    return same.unionAll(near.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")))


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rid_col: str | None = None) -> DataFrame:
    """A row for each row of docs: rid, doc_id, component_id and kept, as classes has them, by similarity of shingle sets."""
    src = docs.select((F.col(rid_col) if rid_col else F.monotonically_increasing_id()).alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if not rid_col:
        src, _ = staged(src, "near-docs")  # written, so that row numbers don't change
    total = src.count()
    part = src.where(F.pmod(F.xxhash64("rid"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, ORDER_ROWS / max(total, 1))))
    often = part.select("rid", "text").mapInArrow(_shingled, "rid long, set array<long>").select(F.explode("set").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c"))
    often = sorted(often.where("c > 2").orderBy(F.desc("c"), "s").limit(ORDER_SHINGLES).collect())
    common, ranks = np.array([r["s"] for r in often], np.int64), np.array([r["c"] for r in often], np.int64)
    heads, _ = staged(src.mapInArrow(_prefixes(common, ranks), "rid long, doc_id long, fp long, digest binary, n long, sketch binary, brief binary, head array<long>"), "near-heads")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("rid").alias("r")))
    nodes, _ = staged(heads.groupBy("digest").agg(F.min("rid").alias("node"), first.alias("first")), "near-nodes")
    sets = heads.join(nodes.select(F.col("node").alias("k_")), heads["rid"] == F.col("k_"))
    index = sets.select(F.posexplode("head").alias("at", "key"), F.col("rid").alias("node"), "n")
    index = index.select("key", "node", "n", F.col("at").cast("long").alias("at"))
    met, _ = staged(index.repartition("key").sortWithinPartitions("key").mapInArrow(_met, "key long, node long, n long, at long"), "near-met")

    def checked(pairs):
        of = lambda *names: heads.select("rid", "n", "sketch").toDF(*names)
        both = pairs.distinct().join(of("a_", "m", "x"), F.col("u") == F.col("a_")).join(of("b_", "n", "y"), F.col("v") == F.col("b_"))
        got, _ = staged(both.select("u", "v", "m", "n", "x", "y").mapInArrow(_possible, "u long, v long"), "near-pairs")
        return staged(_verified(got, src), "near-links")[0]

    def links_of(comp, pairs_of, *order):
        rows = met.join(comp.toDF("c_", "r_"), F.col("node") == F.col("c_"), "left").select("key", "node", "n", "at", F.coalesce("r_", "node").alias("root"))
        if pairs_of is _all_pairs:
            # Buckets in which components still differ: their rows get brief sketches, so that unlike pairs never leave a bucket.
            rows = rows.repartition("key").sortWithinPartitions("key", *order).mapInArrow(_open, "key long, node long, n long, at long, root long")
            rows = rows.join(heads.select(F.col("rid").alias("h_"), "brief"), F.col("node") == F.col("h_")).drop("h_")
        return checked(rows.repartition("key").sortWithinPartitions("key", *order).mapInArrow(_candidates(pairs_of), "u long, v long"))

    # SimHash first. The exact check follows, for the similar pairs whose fingerprints lie further apart: neighbours by size, then by chance, join large groups at a cost in proportion to their rows. All pairs are left to find what lies between components.
    found = checked(fingerprint_pairs(sets.select(F.col("rid").alias("node"), "fp")))
    comp, _ = staged(components(found), "near-cc")
    found = found.unionAll(links_of(comp, _adjacent, "n", "node"))
    comp, _ = staged(components(found), "near-cc")
    for seed in range(CHANCES):
        found = found.unionAll(links_of(comp, _adjacent, F.xxhash64("node", F.lit(seed))))
        comp, _ = staged(components(found), "near-cc")
    found = found.unionAll(links_of(comp, _all_pairs, "n", "node"))
    comp, _ = staged(components(found), "near-cc")
    labelled = nodes.join(comp.withColumnRenamed("node", "c_"), F.col("node") == F.col("c_"), "left").select(F.col("digest").alias("k"), F.coalesce("root", "node").alias("root"), "first")
    best = labelled.groupBy("root").agg(F.min("first").alias("best")).withColumnRenamed("root", "root_")
    of = labelled.join(best, labelled["root"] == best["root_"]).select("k", "best")
    return heads.join(of, heads["digest"] == of["k"]).select("rid", "doc_id", F.col("best.d").alias("component_id"), (F.col("rid") == F.col("best.r")).alias("kept"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row of each component of similar docs; every column stays, whatever its name."""
    rows, at = plain(docs)
    rows, _ = staged(rows.withColumn("rid", F.monotonically_increasing_id()), "simhash-docs")
    before = left()
    with small_batches(docs.sparkSession):
        gone, path = staged(similar_classes(rows, at("doc_id"), at("text"), "rid").where("not kept").select("rid"), "simhash-gone")
    drop(docs.sparkSession, left() - before - {path})
    return without(rows, gone).drop("rid").toDF(*docs.columns)


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


SQL = None
