"""Exact nearest vectors by cosine, where blocks that can't hold a result are skipped.

Vectors are put on the unit sphere once. PIVOTS of them (bounded, so that they may go to every task) part the rest into cells; a cell's rows are cut, by their angle to its pivot, into blocks: shells lo <= angle <= hi. By the triangle inequality of angles, no row of a shell
is nearer to a query than the query's own angle to the pivot is to [lo, hi]. Queries are blocked likewise. First each query meets the blocks nearest to it by that bound, which gives a lower bound of its k-th best score; then all pairs of blocks in which some query's bound
reaches its own go to one matrix product each. Where there is no structure (random directions), few pairs are skipped, and the rest is a join in blocks.

Up to FEW queries, as many as may go to every task, meet all rows in one pass instead, which costs less than finding bounds.

Nulls and numbers that aren't finite count as zeros; vectors without a norm have similarity 0 to all; shorter vectors count as padded with zeros. Null vectors go. Scores are rounded to four decimals before ranking, ties go by id.
"""

from __future__ import annotations

from decimal import ROUND_CEILING, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.sources.versions import scratch

PIVOTS = 64
FEW = 512  # queries that go to every task
ROWS = 1024  # of a block
SLACK = 2e-4  # scores tie when they are equal to four decimals
TILE = 1 << 22  # scores that a task holds at once
ASKED, DEALT = 4096, 1 << 14  # queries of a block that all rows meet, and rows that meet it in one task, or so


def units(column: pa.Array) -> np.ndarray:
    """Rows of length one (or zero), padded to the longest."""
    column = column.cast(pa.large_list(pa.float64()))
    n = np.asarray(pa.compute.list_value_length(column).fill_null(0)).astype(np.int64)
    out = np.zeros((n.size, int(n.max(initial=0))))
    flat = column.flatten().fill_null(0.0).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(n.size), n)
    out[rows, np.arange(rows.size) - np.repeat(np.cumsum(n) - n, n)] = np.where(np.isfinite(flat), flat, 0.0)
    most = np.abs(out).max(axis=1, initial=0.0, keepdims=True)
    out = np.divide(out, most, out=np.zeros_like(out), where=most > 0)  # squares neither vanish nor overflow
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def _fit(m: np.ndarray, width: int) -> np.ndarray:
    return m[:, :width] if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def _angles(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_fit(m, pivots.shape[1]) @ pivots.T, -1.0, 1.0))


def _celled(pivots: np.ndarray):
    """Rows with their cell and the angle to its pivot."""

    def run(batches):
        for b in batches:
            u = units(b.column("v"))
            a = _angles(u, pivots)
            cell = a.argmin(axis=1) if a.size else np.zeros(len(u), np.int64)
            cols = [*(b.column(n) for n in b.schema.names if n != "v"), pa.array(cell.astype(np.int32)), pa.array(a[np.arange(len(u)), cell] if a.size else np.zeros(len(u))), pa.array([r.tobytes() for r in u], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, [*(n for n in b.schema.names if n != "v"), "cell", "angle", "u"])

    return run


def _matrix(raw: list[bytes]) -> np.ndarray:
    width = max((len(r) for r in raw), default=0)
    return np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raw), np.float64).reshape(len(raw), width // 8)


def _blocked(kind: pa.DataType, grouping: pa.DataType):
    """Sorted rows in blocks of one group and cell: g, cell, lo, hi, n, ids, dim, m."""

    def run(batches):
        held, key = [], None

        def flush():
            ids, angles, raw = zip(*held)
            m = _matrix(list(raw))
            row = [[key[0]], [key[1]], [min(angles)], [max(angles)], [len(ids)], [list(ids)], [m.shape[1]], [m.tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (grouping, pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.list_(kind), pa.int32(), pa.binary()))], ["g", "cell", "lo", "hi", "n", "ids", "dim", "m"])

        for b in batches:
            for g, cell, i, a, u in zip(*(b.column(c).to_pylist() for c in ("g", "cell", "id", "angle", "u"))):
                if held and (key != (g, cell) or len(held) >= ROWS):
                    yield flush()
                    held = []
                key = (g, cell)
                held.append((i, a, u))
        if held:
            yield flush()

    return run


def _blocks(rows: DataFrame, pivots: np.ndarray, tag: str) -> DataFrame:
    """rows (g, id, v) as blocks, written once and read by what follows."""
    spark = rows.sparkSession
    of = {f.name: f.dataType.simpleString() for f in rows.schema}
    celled = rows.mapInArrow(_celled(pivots), f"g {of['g']}, id {of['id']}, cell int, angle double, u binary")
    # Ranges of (group, cell, angle): a hot cell lies over many partitions.
    dealt = celled.repartitionByRange("g", "cell", "angle", F.xxhash64("id")).sortWithinPartitions("g", "cell", "angle", "id")
    arrow = {f.name: f.type for f in rows.limit(0).toArrow().schema}
    path = scratch(spark, tag)
    out = dealt.mapInArrow(_blocked(arrow["id"], arrow["g"]), f"g {of['g']}, cell int, lo double, hi double, n int, ids array<{of['id']}>, dim int, m binary")
    out.withColumn("block", F.monotonically_increasing_id()).write.parquet(path)
    return spark.read.parquet(path)


def _placed(pivots: np.ndarray, kind: pa.DataType):
    """Each query's place in its block, and its angle to each pivot: block, query_id, cell, angle."""

    def run(batches):
        for b in batches:
            for block, ids, dim, m in zip(*(b.column(c).to_pylist() for c in ("block", "ids", "dim", "m"))):
                a = _angles(np.frombuffer(m).reshape(len(ids), dim), pivots)
                n, p = a.shape
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n * p, block)), pa.array([i for i in ids for _ in range(p)], kind), pa.array(np.tile(np.arange(p, dtype=np.int32), n)), pa.array(a.ravel())], ["block", "query_id", "cell", "angle"])

    return run


def _best(k: int):
    def best(scores: np.ndarray, least: float, ids: list):
        """Places of what may be among the k best: all that ties with the k-th to four decimals."""
        keep = np.flatnonzero(scores >= least)
        if keep.size > k:
            kth = np.partition(scores[keep], keep.size - k)[keep.size - k]
            keep = keep[scores[keep] >= kth - SLACK]
        if keep.size > 4 * k:  # of equal scores, the k least ids
            order = sorted(keep.tolist(), key=lambda j: (-scores[j], ids[j] is not None, ids[j]))
            s = scores[order]
            new = np.r_[True, s[1:] != s[:-1]]
            at = np.arange(s.size) - np.maximum.accumulate(np.where(new, np.arange(s.size), 0))
            keep = np.array(order)[at < k]
        return keep

    return best


def _direct(k: int, qids: list, q: np.ndarray, qkind: pa.DataType, kind: pa.DataType, grouping: pa.DataType, counter=None):
    """All rows against a few queries."""
    best = _best(k)

    def run(batches):
        for b in batches:
            u, ids, groups = units(b.column("v")), b.column("id").to_pylist(), b.column("g").to_pylist()
            width = min(u.shape[1], q.shape[1])
            of: dict = {}
            for i, g in enumerate(groups):
                of.setdefault(g, []).append(i)
            if counter is not None:
                counter.add(len(ids) * len(qids))
            out = ([], [], [], [])
            for g, rows in of.items():
                for s in range(0, len(rows), max(1, TILE // max(1, len(qids)))):
                    part = rows[s : s + max(1, TILE // max(1, len(qids)))]
                    own = [ids[i] for i in part]
                    for i, line in zip(qids, q[:, :width] @ u[part, :width].T):
                        keep = best(line, -2.0, own)
                        out[0].extend([i] * keep.size)
                        out[1].extend([g] * keep.size)
                        out[2].extend(own[j] for j in keep)
                        out[3].extend(line[keep].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (qkind, grouping, kind, pa.float64()))], ["query_id", "g", "id", "raw"])

    return run


def _scored(k: int, qkind: pa.DataType, kind: pa.DataType, grouping: pa.DataType, counter=None):
    """Pairs of blocks: of each query that may find something there (own: place and bound), what may be among its k best."""
    best = _best(k)

    def run(batches):
        for b in batches:
            for g, ids, dim, m, qids, qdim, qm, own in zip(*(b.column(c).to_pylist() for c in ("g", "ids", "dim", "m", "qids", "qdim", "qm", "own"))):
                rows, q = np.frombuffer(m).reshape(len(ids), dim), np.frombuffer(qm).reshape(len(qids), qdim)
                place = {x["query_id"]: x["least"] for x in own} if own is not None else dict.fromkeys(qids, -2.0)
                at = [i for i, x in enumerate(qids) if x in place]
                width = min(dim, qdim)
                if counter is not None:
                    counter.add(len(at) * len(ids))
                out = ([], [], [])
                for s in range(0, len(at), max(1, TILE // max(1, len(ids)))):
                    part = at[s : s + max(1, TILE // max(1, len(ids)))]
                    scores = q[part, :width] @ rows[:, :width].T
                    for i, line in zip(part, scores):
                        keep = best(line, place[qids[i]], ids)
                        out[0].extend([qids[i]] * keep.size)
                        out[1].extend(ids[j] for j in keep)
                        out[2].extend(line[keep].tolist())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], qkind), pa.array([g] * len(out[0]), grouping), pa.array(out[1], kind), pa.array(out[2], pa.float64())], ["query_id", "g", "id", "raw"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int, keep: Column | None = None, id_col: str = "vec_id", vector: str = "embedding", group: str | None = None, pivots: int = PIVOTS, few: int = FEW, counter=None) -> DataFrame:
    """(query_id, rank, id_col, score): of the rows that keep allows, the k most similar ones to each query (query_id, q), ties by id; with group, of each of its values (and that column). A filter comes before the cut, so k rows come back where
    there are as many. Query ids must differ. counter: an accumulator of the pairs that are scored after the first bound."""
    rows = vectors if keep is None else vectors.where(keep)
    rows = rows.where(F.col(vector).isNotNull()).select((F.col(group) if group else F.lit(0)).alias("g"), F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    asked = queries.where("q is not null").select(F.lit(0).alias("g"), F.col("query_id").alias("id"), F.col("q").cast("array<double>").alias("v"))
    kinds = {n: {f.name: f.type for f in d.limit(0).toArrow().schema} for n, d in (("rows", rows), ("asked", asked))}
    kind, qkind, grouping = kinds["rows"]["id"], kinds["asked"]["id"], kinds["rows"]["g"]
    of = {f.name: f.dataType.simpleString() for f in rows.schema} | {"q": asked.schema["id"].dataType.simpleString()}
    hits = f"query_id {of['q']}, g {of['g']}, id {of['id']}, raw double"
    own = asked.select("id", "v").limit(few + 1).toArrow() if few else None
    if own is not None and own.num_rows <= few:
        q = units(own.column("v").combine_chunks()) if own.num_rows else np.zeros((0, 0))
        return _ranked(rows.mapInArrow(_direct(k, own.column("id").to_pylist(), q, qkind, kind, grouping, counter), hits), k, id_col, group)
    # A bounded sample: which pivots there are changes what is skipped, not what is found.
    some = rows.orderBy(F.xxhash64("id"), "id").limit(pivots).select("v").toArrow()
    p = units(some.column("v").combine_chunks()) if some.num_rows else np.zeros((0, 0))
    p = p[np.any(p != 0, axis=1)] if len(p) else p
    p = p if len(p) else np.ones((1, 1))
    blocks, qblocks = _blocks(rows, p, "near-rows"), _blocks(asked, p, "near-queries")
    qb = qblocks.select(F.col("block").alias("qblock"), F.col("ids").alias("qids"), F.col("dim").alias("qdim"), F.col("m").alias("qm"))

    def scored(pairs: DataFrame, count=None) -> DataFrame:
        """pairs: block, qblock, own."""
        full = pairs.join(blocks.select("block", "g", "ids", "dim", "m"), "block").join(qb, "qblock")
        return full.select("g", "ids", "dim", "m", "qids", "qdim", "qm", "own").mapInArrow(_scored(k, qkind, kind, grouping, count), hits)

    if group:
        pairs = blocks.select("block").crossJoin(qblocks.select(F.col("block").alias("qblock")))  # blocks, not rows
        found = scored(pairs.withColumn("own", F.lit(None).cast(f"array<struct<query_id:{of['q']},least:double>>")), counter)
    else:
        shells = blocks.select("block", "cell", "lo", "hi", "n")
        places = qblocks.select("block", "ids", "dim", "m").mapInArrow(_placed(p, qkind), f"block long, query_id {of['q']}, cell int, angle double").withColumnRenamed("block", "qblock")
        gap = F.greatest(F.lit(0.0), F.col("lo") - F.col("angle"), F.col("angle") - F.col("hi"))
        bounds = places.join(shells, "cell").select("qblock", "query_id", "block", "n", F.cos(gap).alias("most"), (F.col("angle") + F.col("lo")).alias("far"))
        # First the blocks nearest by the bound, and by the angle where several hold the query itself, until k rows are there.
        w = Window.partitionBy("query_id").orderBy(F.desc("most"), "far", "block")
        first = bounds.withColumn("r_", F.row_number().over(w)).where(F.col("r_") <= 2 * k + 4).withColumn("before", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1))).where(F.coalesce("before", F.lit(0)) < k)
        listed = lambda d: d.groupBy("block", "qblock").agg(F.collect_list(F.struct("query_id", "least")).alias("own"))  # noqa: E731  a block's queries
        probe = scored(listed(first.withColumn("least", F.lit(-2.0))))
        kth = probe.withColumn("r_", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("raw")))).where(F.col("r_") <= k).where(F.col("r_") == k).select(F.col("query_id").alias("q_"), F.col("raw").alias("kth"))
        may = bounds.join(kth, F.col("query_id") == F.col("q_"), "left").withColumn("least", F.coalesce(F.col("kth") - SLACK, F.lit(-2.0))).where(F.col("most") >= F.col("least") - 1e-9)
        found = scored(listed(may), counter)
    return _ranked(found, k, id_col, group)


def _ranked(found: DataFrame, k: int, id_col: str, group: str | None) -> DataFrame:
    found = found.withColumn("raw", F.round("raw", 4) + F.lit(0.0))  # no negative zero
    best = Window.partitionBy("query_id", "g").orderBy(F.desc("raw"), "id")
    out = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return out.select("query_id", *([F.col("g").alias(group)] if group else []), "rank", F.col("id").alias(id_col), F.col("raw").alias("score"))


def _parcels(kind: pa.DataType, grouping: pa.DataType):
    """Rows sorted by g in blocks of one g: g, ids, dim, m. Rows with a number that isn't finite are all NaN."""

    def run(batches):
        for b in batches:
            v = b.column("v").cast(pa.large_list(pa.float64()))
            u, n = units(v), np.asarray(pa.compute.list_value_length(v).fill_null(0)).astype(np.int64)
            u[np.unique(np.repeat(np.arange(n.size), n)[~np.isfinite(v.flatten().fill_null(0.0).to_numpy(zero_copy_only=False))])] = np.nan
            g, ids = b.column("g").to_pylist(), b.column("id").to_pylist()
            cuts = [i for i in range(len(g)) if i == 0 or g[i] != g[i - 1]]
            for start, stop in zip(cuts, [*cuts[1:], len(g)]):
                for a in range(start, stop, ROWS):
                    z = min(a + ROWS, stop)
                    row = [[g[a]], [ids[a:z]], [u.shape[1]], [np.ascontiguousarray(u[a:z]).tobytes()]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (grouping, pa.list_(kind), pa.int32(), pa.binary()))], ["g", "ids", "dim", "m"])

    return run


def _reached(base: float, qkind: pa.DataType, grouping: pa.DataType):
    """Pairs of blocks: for each query the best score of the rows, their number, and how many reach base when rounded to four decimals, half up."""
    k = int((Decimal(str(base)) * 10000).to_integral_value(ROUND_CEILING))
    least = float((Decimal(k) - Decimal("0.5")) / 10000)

    def run(batches):
        for b in batches:
            for g, ids, dim, m, qids, qdim, qm in zip(*(b.column(c).to_pylist() for c in ("g", "ids", "dim", "m", "qids", "qdim", "qm"))):
                rows, q = np.frombuffer(m).reshape(len(ids), dim), np.frombuffer(qm).reshape(len(qids), qdim)
                width, best, high = min(dim, qdim), [], []
                for s in range(0, len(qids), max(1, TILE // len(ids))):
                    scores = q[s : s + max(1, TILE // len(ids)), :width] @ rows[:, :width].T
                    best.append(scores.max(axis=1))
                    high.append(((scores >= least if k > 0 else scores > least) | np.isnan(scores)).sum(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(qids, qkind), pa.array([g] * len(qids), grouping), pa.array(np.concatenate(best)), pa.array(np.full(len(qids), len(ids))), pa.array(np.concatenate(high).astype(np.int64))], ["query_id", "g", "best", "n", "high"])

    return run


def reached(vectors: DataFrame, queries: DataFrame, base: float, group: str, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, group, best, n, high): each query (query_id, q) against all rows, by the rows' group: the best score, the rows, and those whose score reaches base. Null vectors score 0, numbers that aren't finite NaN, which is above all others.

    Blocks of rows meet blocks of queries in matrix products; only a row for each query and block of rows leaves a task, and what a task does is the same whatever the tables' sizes.
    """
    vec = lambda c: F.coalesce(F.col(c).cast("array<double>"), F.array().cast("array<double>")).alias("v")
    rows = vectors.select(F.col(group).alias("g"), F.col(id_col).alias("id"), vec(vector))
    n_rows, n_asked = rows.count(), queries.count()
    blocks, deals = max(1, -(-n_asked // ASKED)), max(1, -(-n_rows // DEALT))
    asked = queries.select(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("g"), F.col("query_id").alias("id"), vec("q"))
    kinds = {n: {f.name: f.type for f in d.limit(0).toArrow().schema} for n, d in (("rows", rows), ("asked", asked))}
    of = {f.name: f.dataType.simpleString() for f in rows.schema} | {"q": asked.schema["id"].dataType.simpleString()}
    own = rows.sortWithinPartitions("g").mapInArrow(_parcels(kinds["rows"]["id"], kinds["rows"]["g"]), f"g {of['g']}, ids array<{of['id']}>, dim int, m binary")
    own = own.select("*", F.pmod(F.xxhash64("g", "ids"), F.lit(deals)).cast("int").alias("deal"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("j"))
    ask = asked.sortWithinPartitions("g").mapInArrow(_parcels(kinds["asked"]["id"], pa.int32()), f"g int, ids array<{of['q']}>, dim int, m binary")
    ask = ask.select(F.col("g").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal"), F.col("ids").alias("qids"), F.col("dim").alias("qdim"), F.col("m").alias("qm"))
    met = own.repartition(blocks * deals, "deal", "j").join(ask.repartition(blocks * deals, "deal", "j").hint("merge"), ["deal", "j"])
    part = met.select("g", "ids", "dim", "m", "qids", "qdim", "qm").mapInArrow(_reached(base, kinds["asked"]["id"], kinds["rows"]["g"]), f"query_id {of['q']}, g {of['g']}, best double, n long, high long")
    return part.groupBy("query_id", F.col("g").alias(group)).agg(F.round(F.max("best"), 4).alias("best"), F.sum("n").alias("n"), F.sum("high").alias("high"))
