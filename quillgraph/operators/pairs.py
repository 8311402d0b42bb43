"""How many groups each two items share, where a group may hold a large part of all items.

Groups are parted by their measured size. Pairs of a light group are made where its rows are. A heavy group's pairs are too many for one task, and an item in several of them would be paired several times: its heavy groups become bits, items are dealt to blocks, and each two
blocks are one task's work, which counts the bits that two items have in common. No task's work grows with a group; the blocks' does not either. Pairs without a common group never come out, and what comes out is added up.

Pairs of whole numbers aren't shuffled: ranges of items are blocks with about BLOCK pairs each. A block is sent the light groups that its items are in, from its first item on, as packed differences, and makes and adds up all pairs whose lesser item is its own. A group in one block is sent
once, one dealt over many costs a few bytes a pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

LIGHT = 256  # items of a light group, at most
HEAVY = 4096  # groups that have a bit, at most: the largest ones
ITEMS = 512  # of a block
ROWS, MOST = 1 << 18, 10_000  # rows of a task; partitions, at most
PAIRS = 1 << 16  # pairs that leave a task at once
BLOCK = 1 << 20  # pairs of a range of items, about
SENT = 1 << 22  # bytes for blocks that leave a task at once, about
SAMPLE = 1 << 16  # rows, about, that the ranges are laid by


def _bits(width: int):
    """A block's items and their bits."""

    def run(batches):
        for b in batches:
            rows = []
            for own in b.column("bits").to_pylist():
                line = np.zeros(width, np.uint8)
                line[own] = 1
                rows.append(np.packbits(line).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("item"), b.column("block"), pa.array(rows, pa.binary())], ["item", "block", "bits"])

    return run


def _counted(kind: pa.DataType):
    def run(batches):
        for b in batches:
            for i, j, left, right in zip(*(b.column(c).to_pylist() for c in ("i", "j", "left", "right"))):
                m = [np.frombuffer(b"".join(x["bits"] for x in side), np.uint8).reshape(len(side), -1) for side in (left, right)]
                a, c, w = [], [], []
                for x, line in enumerate(m[0]):
                    n = np.bitwise_count(m[1] & line).sum(axis=1, dtype=np.int64)
                    if i == j:
                        n[: x + 1] = 0
                    at = np.flatnonzero(n)
                    a += [left[x]["item"]] * at.size
                    c += [right[y]["item"] for y in at.tolist()]
                    w += n[at].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(c, kind), pa.array(w, pa.int64())], ["a", "b", "weight"])

    return run


def _paired(kind: pa.DataType):
    """Pairs of different items of a group, the lesser first, from rows that come sorted by group and item; a task holds the rows of one group and batch, whatever the number of their pairs."""

    def pairs(t: pa.Table):
        g, item = (t.column(c).combine_chunks() for c in ("g", "item"))
        n = len(g)
        new = np.r_[True, pa.compute.not_equal(g.slice(1), g.slice(0, n - 1)).to_numpy(zero_copy_only=False)]
        other = np.r_[True, pa.compute.not_equal(item.slice(1), item.slice(0, n - 1)).to_numpy(zero_copy_only=False)]
        kept = np.flatnonzero(new | other)
        start = np.flatnonzero(new[kept])
        end = np.repeat(np.r_[start[1:], kept.size], np.diff(np.r_[start, kept.size]))
        at, d, left, right, held = np.flatnonzero(end - np.arange(kept.size) > 1), 1, [], [], 0
        while at.size:
            left.append(at)
            right.append(at + d)
            held += at.size
            d += 1
            at = at[at + d < end[at]]
            if held >= PAIRS or not at.size:
                i, j = kept[np.concatenate(left)], kept[np.concatenate(right)]
                for x in range(0, i.size, PAIRS):
                    yield pa.RecordBatch.from_arrays([item.take(pa.array(i[x : x + PAIRS])), item.take(pa.array(j[x : x + PAIRS])), pa.array(np.ones(i[x : x + PAIRS].size, np.int64))], ["source", "target", "weight"])
                left, right, held = [], [], 0

    def run(batches):
        wait = []
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column("g")
            if wait and wait[0].column("g")[0] == g[b.num_rows - 1]:
                wait.append(b)
                continue
            last = b.num_rows - 1 - int(np.argmin(np.r_[pa.compute.equal(g, g[b.num_rows - 1]).to_numpy(zero_copy_only=False)[::-1], False])) + 1
            if wait or last:
                yield from pairs(pa.Table.from_batches([*wait, b.slice(0, last)]))
            wait = [b.slice(last)]
        if wait:
            yield from pairs(pa.Table.from_batches(wait))

    return run


def parts(rows: int, each: int = ROWS) -> int:
    """Partitions for so many rows, so that a task's rows don't grow with the table."""
    return min(MOST, max(1, -(-rows // each)))


def _whole(batches):
    """Tables of whole groups from rows that come sorted by group, each of ROWS rows or more, but for the last."""
    wait, held = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        wait.append(b)
        held += b.num_rows
        if held >= ROWS:
            g = b.column("g")
            last = b.num_rows - int(np.argmin(np.r_[pa.compute.equal(g, g[b.num_rows - 1]).to_numpy(zero_copy_only=False)[::-1], False]))
            if last:
                yield pa.Table.from_batches([*wait[:-1], b.slice(0, last)])
                wait, held = [b.slice(last)], b.num_rows - last
    if wait:
        yield pa.Table.from_batches(wait)


def _packed(*arrays: np.ndarray) -> bytes:
    """Whole numbers by their bytes' places, as many places as they need: the arrays' lengths and places, then the compressed bytes."""
    head, planes = [], []
    for a in arrays:
        places = -(-int(a.max(initial=0)).bit_length() // 8)
        head += [a.size, places]
        planes.append(np.ascontiguousarray(a, np.uint64).view(np.uint8).reshape(-1, 8)[:, :places].T.tobytes())
    return np.array(head, np.int64).tobytes() + pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def _unpacked(data: bytes, arrays: int) -> list[np.ndarray]:
    head = np.frombuffer(data, np.int64, 2 * arrays).reshape(-1, 2)
    raw = np.frombuffer(pa.decompress(data[head.nbytes :], int(head.prod(axis=1).sum()), codec="zstd"), np.uint8)
    out, at = [], 0
    for n, places in head.tolist():
        a = np.zeros((n, 8), np.uint8)
        a[:, :places] = raw[at : at + n * places].reshape(places, n).T
        out.append(a.view(np.uint64).reshape(-1))
        at += n * places
    return out


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each, so many."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["block", "sent"])


def _sent(lows: np.ndarray):
    """(block, sent) from rows that come sorted by group and item: of each group of two items or more and each block (the items from lows on) with items of it, these and all greater ones, with how many are before and how many are the block's own."""

    def of(t: pa.Table):
        g, item = t.column("g").combine_chunks(), t.column("item").to_numpy()
        n = len(g)
        new = np.r_[True, pa.compute.not_equal(g.slice(1), g.slice(0, n - 1)).to_numpy(zero_copy_only=False)]
        kept = np.flatnonzero(new | np.r_[True, item[1:] != item[:-1]])
        item, new = item[kept], new[kept]
        block = np.searchsorted(lows[1:], item, "right")
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, item.size])
        begin, size = np.repeat(first, size), np.repeat(size, size)
        at = np.flatnonzero(new | np.r_[True, block[1:] != block[:-1]])
        own = np.diff(np.r_[at, item.size])
        some = size[at] > 1
        at, own = at[some], own[some]
        order = np.argsort(block[at], kind="stable")
        at, own = at[order], own[order]
        before = at - begin[at]
        length = size[at] - before
        # Differences wrap around, so that any two whole numbers have one.
        wide = item.astype(np.int64).view(np.uint64)
        gap = np.r_[np.zeros(1, np.uint64), wide[1:] - wide[:-1]]
        cut = np.flatnonzero(np.r_[True, block[at[1:]] != block[at[:-1]]]) if at.size else []
        for x, y in zip(cut, [*cut[1:], at.size]):
            i, b = _spread(at[x:y], length[x:y]), int(block[at[x]])
            d = gap[i]
            d[np.cumsum(length[x:y]) - length[x:y]] = wide[at[x:y]] - lows[b : b + 1].view(np.uint64)
            yield b, _packed(own[x:y], before[x:y], length[x:y], d)

    def run(batches):
        for t in _whole(batches):
            rows, held = [], 0
            for row in of(t):
                rows.append(row)
                held += len(row[1])
                if held >= SENT:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    return run


def _added(a: np.ndarray, b: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each pair once, sorted, with its sums of values, or with how often it is met."""
    if not a.size:
        return a, b, *(values or [np.zeros(0, np.int64)])
    bits = int(b.max()).bit_length()
    codes = None if int(a.max()).bit_length() + bits < 64 else np.unique(np.concatenate([a, b]))
    key = a << np.uint64(bits) | b if codes is None else (np.searchsorted(codes, a) * codes.size + np.searchsorted(codes, b)).astype(np.uint64)
    if values:
        order = np.argsort(key, kind="stable")
        key = key[order]
    else:
        key.sort()
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sums = [np.add.reduceat(v[order], first) for v in values] or [np.diff(np.r_[first, key.size])]
    key = key[first]
    if codes is None:
        return key >> np.uint64(bits), key & np.uint64((1 << bits) - 1), *sums
    return codes[key // np.uint64(codes.size)], codes[key % np.uint64(codes.size)], *sums


def _made(sent: bytes, others: list | None):
    """Pairs (lesser item, greater item) of what a block was sent, a part of BLOCK at once; items less the block's low. others takes its own items and how many others their groups have."""
    own, before, length, d = _unpacked(sent, 4)
    own, before, length = (x.astype(np.int64) for x in (own, before, length))
    end = np.cumsum(length)
    item = np.cumsum(d)
    item -= np.repeat(item[end - length] - d[end - length], length)
    left, end = _spread(end - length, own), np.repeat(end, own)
    later = end - left - 1
    if others is not None:
        others.append((item[left], np.repeat(before + length - 1, own)))
    total = np.cumsum(later)
    x = 0
    while x < left.size:
        y = max(x + 1, int(np.searchsorted(total, total[x] - later[x] + BLOCK // 4, "right")))
        yield np.repeat(item[left[x:y]], later[x:y]), item[_spread(left[x:y] + 1, later[x:y])]
        x = y


def _blocks(batches):
    """(block, what it was sent) for each block of rows that come sorted by block."""
    now, sent = None, []
    for batch in batches:
        for b, data in zip(batch.column("block").to_pylist(), batch.column("sent")):
            if sent and b != now:
                yield now, sent
                sent = []
            now = b
            sent.append(data)
    if sent:
        yield now, sent


def _summed(sent: list, others: list | None = None):
    """A block's pairs, each once with its weight; others takes its own items and how many others their groups have."""
    done, wait, held = None, [], 0

    def add():
        new = _added(*(np.concatenate(x) for x in zip(*wait)))
        wait.clear()
        return new if done is None else _added(*(np.concatenate(x) for x in zip(done, new)))

    for data in sent:
        for made in _made(data.as_py(), others):
            wait.append(made)
            held += made[0].size
            if held >= 2 * BLOCK:
                done, held = add(), 0
    return add() if wait else done


def _pairs_of(lows: np.ndarray):
    """(source, target, weight)"""

    def run(batches):
        for b, sent in _blocks(batches):
            a, c, w = _summed(sent) or [()] * 3
            low = lows[b : b + 1].view(np.uint64)
            for x in range(0, len(a), PAIRS):
                yield pa.RecordBatch.from_pydict({"source": (a[x : x + PAIRS] + low).view(np.int64), "target": (c[x : x + PAIRS] + low).view(np.int64), "weight": w[x : x + PAIRS]})

    return run


def _counts_of(lows: np.ndarray):
    """(item, shared, again): how many others the groups of a block's own items have, and of any item's pairs how often they are met again."""

    def run(batches):
        for b, sent in _blocks(batches):
            others = []
            a, c, w = _summed(sent, others) or [np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
            own, shared = (np.concatenate(x) for x in zip(*others))
            more = np.flatnonzero(w > 1)
            item, none, again = np.concatenate([own, a[more], c[more]]), np.zeros(2 * more.size, np.int64), w[more] - 1
            _, item, shared, again = _added(np.zeros_like(item), item, np.concatenate([shared, none]), np.concatenate([np.zeros(own.size, np.int64), again, again]))
            item = (item + lows[b : b + 1].view(np.uint64)).view(np.int64)
            for x in range(0, item.size, PAIRS):
                yield pa.RecordBatch.from_pydict({"item": item[x : x + PAIRS], "shared": shared[x : x + PAIRS], "again": again[x : x + PAIRS]})

    return run


def _lows(t: DataFrame, n: int, made: float, least: int) -> np.ndarray:
    """The least item of each range, by the pairs of some groups that an item is the lesser one of. Where they lie changes no result."""
    blocks = min(MOST, max(1, int(-(-made // BLOCK))))
    if blocks == 1:
        return np.array([least], np.int64)
    every = max(1, n // SAMPLE)
    some = t.where(F.pmod(F.xxhash64("g"), F.lit(every)) == 0)
    rows = some.select(F.hash("g").alias("h"), "item").limit(4 * SAMPLE).toArrow()
    rows = sorted(set(zip(rows.column("h").to_pylist(), rows.column("item").to_pylist())))
    if not rows:
        return np.array([least], np.int64)
    h, item = (np.array(x) for x in zip(*rows))
    end = np.searchsorted(h, h, "right")
    later = end - np.arange(h.size) - 1
    order = np.argsort(item, kind="stable")
    total = np.cumsum(later[order])
    at = np.searchsorted(total, np.arange(1, blocks) * (total[-1] / blocks), "right")
    return np.unique(np.r_[least, item[order][np.minimum(at, h.size - 1)]]).astype(np.int64)


def _parted(rows: DataFrame, item: str, group: str, light: int, heavy: int):
    """Rows (g, item); those of light groups; the heavy groups and, for each, a bit; how many rows there are, pairs of light and of heavy groups; the least item."""
    t = rows.where(F.col(item).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(item).alias("item"))
    spark = rows.sparkSession
    n, least = t.agg(F.count(F.lit(1)), F.min("item")).first()
    # All of a group's rows are in one partition: neither distinct nor sizes shuffle them again.
    sizes = t.repartition(parts(n), "g").distinct().groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    of = lambda n: F.coalesce(F.sum(F.when(n, F.expr("cast(n as double) * (n - 1) / 2"))), F.lit(0.0))
    made, over, most = sizes.agg(of(F.col("n") <= light), of(F.col("n") > light), F.count_if(F.col("n") > light)).first()
    lights, large, bits = t, [], None
    if most:
        large = sizes.where(F.col("n") > light).orderBy(F.desc("n"), "g").limit(heavy).select("g").collect()
        bits = F.broadcast(spark.createDataFrame([(r["g"], i) for i, r in enumerate(large)], f"g {t.schema['g'].dataType.simpleString()}, bit int"))  # HEAVY rows at most
        lights = t.join(bits, "g", "left_anti")
    # What was shuffled so far, also for rows that are written, leaves the disk.
    spark.sparkContext._jvm.System.gc()
    return t, lights, large, bits, n, made, over, least


def _in_blocks(lights: DataFrame, n: int, made: float, least: int, result, schema: str) -> DataFrame:
    """result (of the blocks' lows) of what each block is sent."""
    lows = _lows(lights, n, made, least or 0)
    sent = lights.select("g", F.col("item").cast("long").alias("item")).repartition(parts(n), "g").sortWithinPartitions("g", "item").mapInArrow(_sent(lows), "block int, sent binary")
    return sent.repartition(lows.size, "block").sortWithinPartitions("block").mapInArrow(result(lows), schema)


def shared_counts(rows: DataFrame, item: str, group: str, light: int = LIGHT, heavy: int = HEAVY, items: int = ITEMS) -> DataFrame:
    """(item, partners, shared): for each item with a partner, with how many others it shares groups, and the sum of how many it shares with each.

    The sum takes no pairs, and partners are as many but for pairs that are met again; so pairs leave no task. Where groups are heavy, or items aren't whole numbers, shared_pairs are counted."""
    parted = _parted(rows, item, group, light, heavy)
    _, lights, large, _, n, made, _, least = parted
    kind = rows.schema[item].dataType
    if large or not isinstance(kind, IntegralType):
        ends = _joined(*parted, items).select(F.explode(F.array("source", "target")).alias("item"), "weight")
        return ends.groupBy("item").agg(F.count(F.lit(1)).alias("partners"), F.sum("weight").alias("shared"))
    counts = _in_blocks(lights, n, made, least, _counts_of, "item long, shared long, again long")
    return counts.repartition(parts(n), "item").groupBy(F.col("item").cast(kind).alias("item")).agg((F.sum("shared") - F.sum("again")).alias("partners"), F.sum("shared").alias("shared"))


def shared_pairs(rows: DataFrame, item: str, group: str, light: int = LIGHT, heavy: int = HEAVY, items: int = ITEMS) -> DataFrame:
    """(source, target, weight): for each two items with a common group (nulls are in none), source < target, the number of groups that they share; each two once. Groups of more than light items are heavy, the largest ones up to heavy groups; their sizes are measured first.

    rows are read four times or so: write them first, if they cost much."""
    return _joined(*_parted(rows, item, group, light, heavy), items)


def _joined(t: DataFrame, lights: DataFrame, large: list, bits: DataFrame | None, n: int, made: float, over: float, least, items: int) -> DataFrame:
    spark, kind, dealt = t.sparkSession, t.schema["item"].dataType.simpleString(), parts(n)
    arrow = {f.name: f.type for f in t.limit(0).toArrow().schema}["item"]
    if isinstance(t.schema["item"].dataType, IntegralType):
        pairs = _in_blocks(lights, n, made, least, _pairs_of, "source long, target long, weight long").select(F.col("source").cast(kind).alias("source"), F.col("target").cast(kind).alias("target"), "weight")
        if not large:
            return pairs
    else:
        pairs = lights.repartition(dealt, "g").sortWithinPartitions("g", "item").mapInArrow(_paired(arrow), f"source {kind}, target {kind}, weight long")
    if large:
        own = t.repartition(dealt, "g").distinct().join(bits, "g").groupBy("item").agg(F.collect_list("bit").alias("bits"))  # a bit for each heavy group
        n = own.count()
        blocks = max(1, -(-n // items))
        made += min(over, n * (n - 1) / 2)
        own = own.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")).mapInArrow(_bits(len(large)), f"item {kind}, block int, bits binary")
        block = own.groupBy("block").agg(F.collect_list(F.struct("item", "bits")).alias("own"))  # ITEMS or so
        left = block.select(F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.lit(blocks - 1))).alias("j"), F.col("own").alias("left"))
        right = block.select(F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"), F.col("block").alias("j"), F.col("own").alias("right"))
        met = left.join(right, ["i", "j"]).repartition(min(2000, blocks * (blocks + 1) // 2), "i", "j").mapInArrow(_counted(arrow), f"a {kind}, b {kind}, weight long")
        pairs = pairs.unionByName(met.select(F.least("a", "b").alias("source"), F.greatest("a", "b").alias("target"), "weight"))
    # Most pairs are met once, so that tables of them before the shuffle would take memory and save nothing.
    return pairs.repartition(parts(int(made), 4 * ROWS), "source", "target").groupBy("source", "target").agg(F.sum("weight").alias("weight"))
