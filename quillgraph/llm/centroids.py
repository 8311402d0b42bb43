"""Exact k-means over integer vectors, with distances by matrix products.

Components become integers, floor(SCALE * x). A block of vectors meets all centroids in |x|^2 - 2 x.c + |c|^2, whose middle term is one product of float64 matrices in BLAS. All its terms and partial sums are integers; while a bound
on their magnitudes, from the largest components of the block and of the centroids, stays below 2^53, float64 holds each exactly, whatever the order of summation, and so the distances are exact. A block that breaks the bound is computed in
64-bit integers while they hold it, else in Python's integers. Sums for the next centroids are exact the same way, and are combined over the RDD of blocks by treeAggregate, so that the driver gets one K x DIM sum and not one of each task.

Vectors with a null or a number that isn't finite, or with another length, go; null vectors too. Rows that repeat stay, each for itself. Ties for the starting centroids (equal ids) go by the components. With fewer vectors than K, each starts a centroid;
an empty table gives an empty result. A null id counts as an empty text when starting centroids are chosen. Distances and inertias beyond 64 bits are null (the assignment stays exact). Only the columns of id and vector are read, so that further columns may have any name.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

CLUSTERS, ROUNDS, DIM, SCALE = 8, 10, 64, 1024
EXACT = 1 << 53
WIDE = 1 << 63
BLOCK = 4096  # vectors


def _integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of doubles: 64-bit integers, or Python's where those don't hold them."""
    y = np.floor(SCALE * values)
    if not y.size or np.abs(y).max() < 1 << 62:
        return y.astype(np.int64)
    return np.array([[SCALE * int(v) if abs(v) >= 1 << 53 else int(np.floor(SCALE * v)) for v in row] for row in values.tolist()], object).reshape(values.shape)


def _pack(x: np.ndarray) -> bytes:
    """Rows of a block; numbers beyond 64 bits as decimal text."""
    return b"i" + x.astype("<i8").tobytes() if x.dtype != object else b"t" + ",".join(map(str, x.ravel().tolist())).encode()


def _unpack(raw: bytes, dim: int) -> np.ndarray:
    if raw[:1] == b"i":
        return np.frombuffer(raw, "<i8", offset=1).reshape(-1, dim)
    return np.array([int(v) for v in raw[1:].decode().split(",")], object).reshape(-1, dim)


def _blocks(dim: int):
    """Blocks of kept vectors: ids (and which are null), components."""

    def run(batches):
        for b in batches:
            col = b.column("v")
            keep = np.array(pa.compute.list_value_length(col).fill_null(-1)) == dim
            ids, col = b.column("id").filter(pa.array(keep)), col.filter(pa.array(keep))
            values = col.flatten().cast(pa.float64())
            flat = values.fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim)
            good = np.isfinite(flat).all(axis=1)
            ids, flat = ids.filter(pa.array(good)), flat[good]
            huge = np.abs(flat).max(axis=1, initial=0) >= 2.0**51
            null, nums = np.asarray(ids.is_null()), ids.fill_null(0).to_numpy()
            rows = []
            for part in (~huge, huge):  # vectors that need wide numbers slow only their own blocks
                i = np.flatnonzero(part)
                for s in range(0, i.size, BLOCK):
                    j = i[s : s + BLOCK]
                    rows.append((nums[j].astype("<i8").tobytes(), np.packbits(null[j]).tobytes(), _pack(_integers(flat[j]))))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary()) for k in range(3)], ["ids", "null", "x"])

    return run


def _most(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min())) if x.size else 0


def distances(x: np.ndarray, c: np.ndarray, exact: int = EXACT, wide: int = WIDE) -> np.ndarray:
    """Squared distances of the rows of x and c, exact: float64 where the bound holds, else 64-bit integers, else Python's. exact, wide: the bounds, to be lowered in tests."""
    a, b = _most(x), _most(c)
    bound = x.shape[1] * (a + b) ** 2  # of |x|^2 + 2 |x.c| + |c|^2, and of every partial sum
    if bound < exact:
        x, c = x.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    kind = np.int64 if bound < wide else object
    x, c = x.astype(kind), c.astype(kind)
    return (x * x).sum(axis=1)[:, None] - 2 * x.dot(c.T) + (c * c).sum(axis=1)


def sums(x: np.ndarray, cluster: np.ndarray, k: int, exact: int = EXACT, wide: int = WIDE) -> np.ndarray:
    """Exact sums of the rows of each cluster: a product with the matrix of memberships where the bound holds."""
    bound = _most(x) * max(len(x), 1)
    if bound < exact:
        return ((cluster == np.arange(k)[:, None]).astype(np.float64) @ x.astype(np.float64)).astype(np.int64)
    x = x if bound < wide else x.astype(object)
    return np.array([x[cluster == j].sum(axis=0) if (cluster == j).any() else np.zeros(x.shape[1], x.dtype) for j in range(k)])


def _add(a: list, b: list) -> list:
    return [p + q for p, q in zip(a, b)]


def _listed(a: np.ndarray) -> list:
    return [int(v) for v in a.ravel().tolist()]


def start(kept: DataFrame, k: int, dim: int) -> list[list[int]]:
    """The components of the k vectors whose text `3:<id>` has the least SHA-256. k rows come to the driver."""
    hashed = kept.select("v", F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256).alias("h"))
    rows = hashed.orderBy("h", "v").limit(k).collect()
    return [_listed(_integers(np.array([r["v"]], np.float64))) for r in rows]


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: a row for each vector that is kept."""
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    c = start(src.where((F.size("v") == dim) & finite), k, dim)
    blocks, _ = staged(src.mapInArrow(_blocks(dim), "ids binary, null binary, x binary"), "kmeans-blocks")
    k = len(c)
    rdd = blocks.select("x").rdd.map(lambda r: bytes(r[0]))
    width = k * dim

    def assigned(raw: bytes, c: list[list[int]]):
        x = _unpack(raw, dim)
        d = distances(x, _array(c))
        return x, d.argmin(axis=1), d.min(axis=1)

    for _ in range(rounds if k else 0):

        def step(acc, raw, c=c):
            x, own, _ = assigned(raw, c)
            return _add(acc, _listed(sums(x, own, k)) + np.bincount(own, minlength=k).tolist())

        got = rdd.treeAggregate([0] * (width + k), step, _add)
        n = got[width:]
        c = [[s // n[j] for s in got[j * dim : (j + 1) * dim]] if n[j] else c[j] for j in range(k)]

    def inertia(acc, raw):
        _, own, d = assigned(raw, c)
        return _add(acc, [sum(_listed(d[own == j])) for j in range(k)])

    each = rdd.treeAggregate([0] * k, inertia, _add) if k else []
    names = [sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    fit = lambda v: int(v) if v < WIDE else None

    def rows(batches):
        for b in batches:
            for ids, null, raw in zip(*(b.column(n).to_pylist() for n in ("ids", "null", "x"))):
                _, own, d = assigned(raw, c)
                gone = np.unpackbits(np.frombuffer(null, np.uint8))[: own.size].astype(bool)
                own = own.tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.frombuffer(ids, "<i8"), mask=gone), pa.array(own, pa.int32()), pa.array([fit(v) for v in d.tolist()], pa.int64()),
                        pa.array([fit(each[j]) for j in own], pa.int64()), pa.array([fit(sum(each))] * len(own), pa.int64()), pa.array([names[j] for j in own], pa.string()),
                    ],
                    ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return blocks.mapInArrow(rows, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")


def _array(c: list[list[int]]) -> np.ndarray:
    return np.array(c, np.int64 if all(abs(v) < 1 << 62 for row in c for v in row) else object)


def query(spark, sf_dir):
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    """Rows of (vector, place, component), a step for each round."""
    out = [f"""
with k as materialized (select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v from embeddings
  where len(embedding) = {DIM} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {DIM}),
c0 as materialized (select (row_number() over (order by sha256('3:' || coalesce(vec_id::varchar, '')), v) - 1)::int as c, v from k qualify c < {CLUSTERS}),
"""]
    near = lambda t: f"(select rid, vec_id, k.v as v, arg_min(c, struct_pack(d := d, c := c)) as c, min(d) as d from (select k.rid, k.vec_id, k.v, {t}.c, list_sum(list_transform(list_zip(k.v, {t}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d from k, {t}) k group by rid, vec_id, v)"
    for r in range(ROUNDS):
        out.append(f"""m{r} as materialized (select c, list(s order by i) as v from (select c, i, floor_div(sum(x)::hugeint, count(*)) as s from (select c, unnest(v) as x, unnest(range(1, {DIM} + 1)) as i from {near(f'c{r}')}) group by c, i) group by c),
c{r + 1} as materialized (select c{r}.c, coalesce(m{r}.v, c{r}.v) as v from c{r} left join m{r} using (c)),
""")
    out.append(f"""a as materialized {near(f'c{ROUNDS}')}
select a.vec_id, a.c as cluster, a.d as distance, sum(a.d) over (partition by a.c)::bigint as cluster_inertia, sum(a.d) over ()::bigint as inertia, sha256(array_to_string(z.v, ',')) as centroid_sha256
from a join c{ROUNDS} z using (c)""")
    # Integer division rounds towards zero, floors are sought.
    return "".join(out).replace("floor_div(sum(x)::hugeint, count(*))", "((sum(x)::hugeint - ((sum(x)::hugeint % count(*)) + count(*)) % count(*)) // count(*))::bigint")


SQL = _sql()
