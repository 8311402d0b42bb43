"""Ranked lexical search by the three phases of TPUT over term-partitioned postings.

A posting is a document and its share g of a term's score; a term's list is cut into blocks of documents, sorted by document, and dealt by ranges of (term, block), so that a common term's list lies over
many partitions. With a query's terms as its lists:

1. The HEAD * K largest postings of each list give partial sums. The LOOKED * K documents of largest sums are looked up in all lists, and the K-th best of their scores is a lower bound of the K-th best of all.
2. One threshold holds for all lists of a query: the largest at which a document that is under it in every list can't reach the bound. What a list's head leaves is no larger than the head's last posting (nothing, where the head is the list), so that counts
   where it is less. Every list gives all its postings over that, as arrays for each block of documents, which are summed there. The sums bound the K-th best score again, and documents whose sum, with the most that other lists may add, stays under a bound go.
3. Every list is looked up for the documents that are left, and their exact scores rank them.

The terms sought are the queries' own; they go to the tasks in parts of TERMS, so that each part is bounded; each part is a pass over the documents. All else is joined.

Terms are as in the contract: maximal runs of letters, digits and characters over U+007F, only A-Z lower-cased. Null and empty texts have no terms: such documents count for nothing and such queries give no rows. Rows that
repeat are documents or queries of their own; ties go by ascending id (nulls first), then by place in the table. Very long texts count whole, in one task. Empty tables give an empty result. Only the columns of id and text are
read, so that further columns may have any name.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, small_batches, staged, unstage

K = 50
HEAD, LOOKED = 4, 4  # times K postings of a list are its head; times K documents are looked up for the first bound
BLOCKS = 50  # rows of an Arrow batch where a row is a block's
TERMS = 1_000_000  # terms that one pass over the documents seeks
WORDS, DOCS = 4_000_000, 1 << 14  # of a block of documents, at most (but for a last batch)
_PLAIN = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


def _texts(b) -> list[bytes]:
    return [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]


def _sizes(batches):
    """N and L of each batch."""
    for b in batches:
        n = [len(terms(t)) for t in _texts(b)]
        yield pa.RecordBatch.from_arrays([pa.array([sum(x > 0 for x in n)], pa.int64()), pa.array([sum(n)], pa.int64())], ["docs", "words"])


def _asked(batches):
    for b in batches:
        each = [sorted(set(terms(t))) for t in _texts(b)]
        at = pa.array([i for i, own in enumerate(each) for _ in own], pa.int32())
        yield pa.RecordBatch.from_arrays([b.column("q").take(at), b.column("item_id").take(at), pa.array(list(chain(*each)), pa.binary())], ["q", "item_id", "term"])


def share(tf: np.ndarray, n: np.ndarray, docs: int, words: int) -> np.ndarray:
    """What a term's weight is multiplied with."""
    if n.size and 50 * int(n.max()) * docs >= 1 << 63:
        m = np.array([50 + 50 * x * docs // words for x in n.tolist()], np.int64)
    else:
        m = 50 + 50 * n * docs // max(words, 1)
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


BLOCK = "tid long, block long, n long, idx binary, g binary"


def _postings(index: dict[bytes, int], docs: int, words: int, ids: bool):
    """A row for each term of a block of documents: indices in the block, ascending, and shares. Its number is that of its first document. A row with tid -1 has the block's ids in g, if asked for."""

    def run(batches):
        held, first, at, size = [], None, 0, 0

        def flush():
            tid, idx, g, own, null = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(tid, kind="stable")
            tid, idx, g = tid[order], idx[order], g[order]
            begin = np.flatnonzero(np.r_[True, tid[1:] != tid[:-1]]) if tid.size else np.zeros(0, np.int64)
            ends = [*begin[1:].tolist(), tid.size]
            rows = [(int(tid[s]), e - s, idx[s:e].tobytes(), g[s:e].tobytes()) for s, e in zip(begin.tolist(), ends)]
            if ids:
                rows.append((-1, own.size, np.packbits(null).tobytes(), own.tobytes()))
            t, n, i, s = zip(*rows) if rows else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array([first] * len(t), pa.int64()), pa.array(n, pa.int64()), pa.array(i, pa.binary()), pa.array(s, pa.binary())], ["tid", "block", "n", "idx", "g"])

        for b in batches:
            if not b.num_rows:
                continue
            if first is None:
                first = b.column("rid")[0].as_py()
            split = [terms(t) for t in _texts(b)]
            n = np.fromiter(map(len, split), np.int64, len(split))
            met = np.fromiter((index.get(w, -1) for w in chain(*split)), np.int64, int(n.sum()))
            doc = np.repeat(np.arange(n.size), n)[met >= 0]
            key, tf = np.unique(doc * len(index) + met[met >= 0], return_counts=True)
            doc, tid = np.divmod(key, max(len(index), 1))
            g = share(tf.astype(np.int64), n[doc], docs, words)
            idc = b.column("id")
            held.append((tid, (doc + at).astype("<i4"), g.astype("<i4"), idc.fill_null(0).to_numpy().astype("<i8"), np.asarray(idc.is_null())))
            at, size = at + n.size, size + int(n.sum())  # blocks are alike whatever terms are sought
            if size >= WORDS or at >= DOCS:
                yield flush()
                held, first, at, size = [], None, 0, 0
        if held:
            yield flush()

    return run


def _heads(k: int):
    """Of each list, what a partition has of its k largest postings."""

    def rows(best):
        t = np.repeat(np.array(list(best), np.int64), [x[0].size for x in best.values()])
        col = lambda i, kind: np.concatenate([x[i] for x in best.values()]).astype(kind) if best else np.zeros(0, kind)
        return pa.RecordBatch.from_arrays([pa.array(t), pa.array(col(0, np.int64)), pa.array(col(1, np.int32)), pa.array(col(2, np.int64))], ["tid", "block", "idx", "g"])

    def run(batches):
        best: dict[int, tuple] = {}
        for b in batches:
            for tid, block, idx, g in zip(*(b.column(c).to_pylist() for c in ("tid", "block", "idx", "g"))):
                idx, g = np.frombuffer(idx, "<i4"), np.frombuffer(g, "<i4")
                own = np.full(idx.size, block), idx, g
                if tid in best:
                    own = tuple(np.concatenate(x) for x in zip(best[tid], own))
                if own[2].size > k:
                    top = np.argpartition(own[2], own[2].size - k)[-k:]
                    own = tuple(x[top] for x in own)
                best[tid] = own
            if len(best) > 20_000:  # lists of earlier rows are mostly over
                yield rows(best)
                best = {}
        yield rows(best)

    return run


def threshold(bound: int, rest: list[int]) -> int:
    """The largest T for which postings under T, and no larger than what each list has left (rest), add up to less than the bound; 1 at least, under which there is nothing."""
    rest, below = sorted(rest), 0
    for i, m in enumerate(rest):
        t = (bound - 1 - below) // (len(rest) - i) + 1  # the lists before give all that they have left, this one and those after T - 1
        if t - 1 < m:
            return max(1, t)
        below += m
    return max(1, (rest[-1] if rest else 0) + 1)


def _thresholds(batches):
    """For each list of a query the least share that it has to give, and the most of what it needn't (cap); the caps' sum."""
    for b in batches:
        out = []
        for q, bound, lists in zip(*(b.column(c).to_pylist() for c in ("q", "bound", "lists"))):
            t = threshold(bound or 0, [x["w"] * x["rest"] for x in lists])
            caps = [min(t - 1, x["w"] * x["rest"]) for x in lists]
            out += [(q, x["tid"], x["w"], c // x["w"] + 1, c, sum(caps), bound or 0) for x, c in zip(lists, caps)]
        yield _rows(out, tuple((n, pa.int64()) for n in ("q", "tid", "w", "least", "cap", "caps", "bound")))


def _given(batches):
    """The postings at or over the threshold of each query that asks for the list."""
    for b in batches:
        out, size = [], 0
        for block, idx, g, ask in zip(*(b.column(c).to_pylist() for c in ("block", "idx", "g", "ask"))):
            idx, g = np.frombuffer(idx, "<i4"), np.frombuffer(g, "<i4")
            for a in ask:
                at = np.flatnonzero(g >= a["least"])
                if at.size:
                    out.append((a["q"], block, a["w"], a["cap"], idx[at].tobytes(), g[at].tobytes()))
                    size += at.size
            if size > 500_000:
                yield _rows(out, GIVEN)
                out, size = [], 0
        yield _rows(out, GIVEN)


GIVEN = (("q", pa.int64()), ("block", pa.int64()), ("w", pa.int64()), ("cap", pa.int64()), ("idx", pa.binary()), ("g", pa.binary()))
SUMMED = (("q", pa.int64()), ("block", pa.int64()), ("idx", pa.binary()), ("s", pa.binary()), ("room", pa.binary()))


def _rows(out: list[tuple], schema):
    cols = list(zip(*out)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, schema)], [n for n, _ in schema])


def _summed(batches):
    """What a block's documents were given for a query: sums, and the sum less the caps of the lists that gave."""
    for b in batches:
        out = []
        for q, block, parts in zip(*(b.column(c).to_pylist() for c in ("q", "block", "parts"))):
            lists = [(np.frombuffer(x["idx"], "<i4"), np.frombuffer(x["g"], "<i4").astype(np.int64) * x["w"], x["cap"]) for x in parts]
            s = np.zeros(1 + max(int(i[-1]) for i, _, _ in lists), np.int64)
            room, met = s.copy(), np.zeros(s.size, bool)
            for i, v, cap in lists:  # a document is once in a list
                s[i] += v
                room[i] += v - cap
                met[i] = True
            at = np.flatnonzero(met)
            out.append((q, block, at.astype("<i4").tobytes(), s[at].tobytes(), room[at].tobytes()))
        yield _rows(out, SUMMED)


def _best_sums(k: int):
    def run(batches):
        for b in batches:
            out = []
            for q, s in zip(b.column("q").to_pylist(), b.column("s").to_pylist()):
                s = np.frombuffer(s, np.int64)
                s = np.partition(s, s.size - k)[-k:] if s.size > k else s
                out += [(q, int(v)) for v in s]
            yield _rows(out, (("q", pa.int64()), ("s", pa.int64())))

    return run


def _may_reach(batches):
    """Of each block the documents that may reach the bound."""
    for b in batches:
        out = []
        for q, block, idx, room, caps, bound in zip(*(b.column(c).to_pylist() for c in ("q", "block", "idx", "room", "caps", "bound"))):
            at = np.frombuffer(idx, "<i4")[np.frombuffer(room, np.int64) + caps >= (bound or 0)]
            if at.size:
                out.append((q, block, at.tobytes()))
        yield _rows(out, (("q", pa.int64()), ("block", pa.int64()), ("want", pa.binary())))


def _looked_up(batches):
    """Candidates' postings in a list, as those that are given are; their ids, where the list is that of ids."""
    for b in batches:
        out, size = [], 0
        for tid, block, idx, g, asks in zip(*(b.column(c).to_pylist() for c in ("tid", "block", "idx", "g", "asks"))):
            for a in asks:
                want = np.frombuffer(a["want"], "<i4")
                if tid < 0:
                    null = np.unpackbits(np.frombuffer(idx, np.uint8))[want]
                    out.append((a["q"], block, 0, 0, a["want"], np.frombuffer(g, "<i8")[want].tobytes() + null.tobytes()))
                else:
                    have = np.frombuffer(idx, "<i4")
                    at = np.minimum(np.searchsorted(have, want), have.size - 1)
                    hit = have[at] == want
                    out.append((a["q"], block, a["w"], 0, want[hit].tobytes(), np.frombuffer(g, "<i4")[at[hit]].tobytes()))
                size += want.size
            if size > 500_000:
                yield _rows(out, GIVEN)
                out, size = [], 0
        yield _rows(out, GIVEN)


def _ranked(k: int):
    """Of a block's candidates the k best: q, rid, s, doc_id. Equal scores go by id, nulls first, then by place."""

    def run(batches):
        for b in batches:
            out = []
            for q, block, parts in zip(*(b.column(c).to_pylist() for c in ("q", "block", "parts"))):
                lists = [x for x in parts if x["w"] > 0]
                ids = next(x for x in parts if x["w"] == 0)
                want = np.frombuffer(ids["idx"], "<i4")
                own, null = np.frombuffer(ids["g"], "<i8", want.size), np.frombuffer(ids["g"], np.uint8, offset=8 * want.size).astype(bool)
                s = np.zeros(int(want[-1]) + 1, np.int64)
                for x in lists:
                    s[np.frombuffer(x["idx"], "<i4")] += np.frombuffer(x["g"], "<i4").astype(np.int64) * x["w"]
                s = s[want]
                best = np.lexsort((want, own, ~null, -s))[:k]
                out += [(q, block + int(want[i]), int(s[i]), None if null[i] else int(own[i])) for i in best.tolist() if s[i] > 0]
            yield _rows(out, tuple((n, pa.int64()) for n in ("q", "rid", "s", "doc_id")))

    return run


def _packed(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("q"), b.column("block"), pa.array([np.array(x, "<i4").tobytes() for x in b.column("l").to_pylist()], pa.binary())], ["q", "block", "want"])


def _kth(sums: DataFrame, k: int) -> DataFrame:
    """The k-th largest sum of each query, no row where it has fewer."""
    return sums.withColumn("r_", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s")))).where(f"r_ <= {k}").where(f"r_ = {k}").select("q", F.col("s").alias("bound"))


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", most_terms: int = TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of highest score for each row of items."""
    spark = docs.sparkSession
    src = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ask = items.select(F.monotonically_increasing_id().alias("q"), F.col(item_id_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    kind, paths = ask.schema["item_id"].dataType.simpleString(), []

    def keep(df: DataFrame, tag: str) -> DataFrame:
        df, path = staged(df, f"tput-{tag}")
        paths.append(path)
        return df

    with small_batches(spark):
        asked = keep(ask.mapInArrow(_asked, f"q long, item_id {kind}, term binary"), "asked")
        size = src.select("text").mapInArrow(_sizes, "docs long, words long").agg(F.sum("docs"), F.sum("words")).first()
        n_docs, n_words = size[0] or 0, size[1] or 0
        # Terms by number: the part, and the place in it.
        names = asked.select("term").distinct()
        parts = -(-names.count() // most_terms) or 1
        parts = 2 * parts if parts > 1 else 1  # hashing deals unevenly
        if parts > 1:
            src = keep(src, "documents")  # all passes number the documents alike
        part = F.pmod(F.xxhash64("term"), F.lit(parts))
        lists, numbers = [], []
        for p in range(parts):
            own = sorted(bytes(r[0]) for r in names.where(part == p).collect())
            index = {t: i for i, t in enumerate(own)}
            numbers.append(spark.createDataFrame([(bytearray(t), (p << 32) + i) for t, i in index.items()], "term binary, tid long"))
            rows = src.mapInArrow(_postings(index, n_docs, n_words, not p), BLOCK)
            lists.append(rows.withColumn("tid", F.when(F.col("tid") >= 0, F.col("tid") + (p << 32)).otherwise(F.col("tid"))))
        union = lambda dfs: dfs[0] if len(dfs) == 1 else union([dfs[0].unionAll(dfs[1]), *dfs[2:]])
        blocks = keep(union(lists), "blocks")
        posted = keep(blocks.repartitionByRange("tid", "block"), "postings")
        unstage(spark, paths.pop(-2))
        forget(spark)
    with small_batches(spark, BLOCKS):
        real = posted.where("tid >= 0")
        weight = F.floor(1000 * F.log((2.0 * F.lit(n_docs) + 2.0) / (2 * F.col("df") + 1).cast("double")))
        df = real.groupBy("tid").agg(F.sum("n").alias("df")).select("tid", weight.cast("long").alias("w")).where("w > 0")
        qt = keep(asked.join(union(numbers), "term").join(df, "tid").select("q", "item_id", "tid", "w"), "terms")

        by_block = lambda rows: rows.groupBy("q", "block").agg(F.collect_list(F.struct("w", "cap", "idx", "g")).alias("parts"))  # noqa: E731  a block's documents, at most once for each of the query's terms
        given_rows = "q long, block long, w long, cap long, idx binary, g binary"

        def looked_up(wanted: DataFrame) -> DataFrame:
            """q, rid, s, doc_id: of documents (q, block, want: their places in the block) the k best of each block."""
            lookups = wanted.join(qt.select("q", "tid", "w"), "q").unionByName(wanted.withColumns({"tid": F.lit(-1).cast("long"), "w": F.lit(0).cast("long")}))
            lookups = lookups.groupBy("tid", "block").agg(F.collect_list(F.struct("q", "w", "want")).alias("asks"))  # the queries of a list
            found = posted.join(lookups, ["tid", "block"]).select("tid", "block", "idx", "g", "asks").mapInArrow(_looked_up, given_rows)
            return by_block(found).mapInArrow(_ranked(k), "q long, rid long, s long, doc_id long")

        # 1: heads, and a lower bound of the k-th best score.
        heads = real.select("tid", "block", "idx", "g").mapInArrow(_heads(HEAD * k), "tid long, block long, idx int, g long")
        heads = heads.withColumn("r_", F.row_number().over(Window.partitionBy("tid").orderBy(F.desc("g")))).where(f"r_ <= {HEAD * k}")
        heads = keep(heads.drop("r_"), "heads")
        sums = qt.join(heads, "tid").groupBy("q", "block", "idx").agg(F.sum(F.col("w") * F.col("g")).alias("s"))
        first = sums.withColumn("r_", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s")))).where(f"r_ <= {LOOKED * k}")
        first = first.groupBy("q", "block").agg(F.array_sort(F.collect_list("idx")).alias("l")).mapInArrow(_packed, "q long, block long, want binary")
        bounds = _kth(looked_up(keep(first, "first")), k)
        # 2: all postings over the threshold, summed by document.
        rest = heads.groupBy("tid").agg(F.when(F.count("*") < HEAD * k, 0).otherwise(F.min("g")).alias("rest"))
        lists_of = qt.join(rest, "tid").groupBy("q").agg(F.collect_list(F.struct("tid", "w", "rest")).alias("lists"))
        asks = keep(lists_of.join(bounds, "q", "left").select("q", "bound", "lists").mapInArrow(_thresholds, "q long, tid long, w long, least long, cap long, caps long, bound long"), "asks")
        by_list = asks.groupBy("tid").agg(F.collect_list(F.struct("q", "w", "cap", "least")).alias("ask"))
        given = by_block(real.join(by_list, "tid").select("block", "idx", "g", "ask").mapInArrow(_given, given_rows))
        given = keep(given.mapInArrow(_summed, "q long, block long, idx binary, s binary, room binary"), "given")
        better = _kth(given.select("q", "s").mapInArrow(_best_sums(k), "q long, s long"), k).withColumnRenamed("bound", "better")
        left = given.join(asks.select("q", "caps", "bound").distinct(), "q").join(better, "q", "left").select("q", "block", "idx", "room", "caps", F.greatest("bound", "better").alias("bound"))
        left = left.mapInArrow(_may_reach, "q long, block long, want binary")
        # 3: exact scores of what is left.
        exact = looked_up(keep(left, "left")).withColumnRenamed("s", "score")
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc_id", "rid"))
        best = exact.withColumn("rank", rank).where(f"rank <= {k}")
        out, _ = staged(best.join(qt.select("q", "item_id").distinct(), "q").select("item_id", "rank", "doc_id", "score"), "tput-out")
        unstage(spark, *paths)
        forget(spark)
    return out


def query(spark, sf_dir):
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as t from documents),
sizes as (select sum(case when len(t) > 0 then 1 else 0 end)::bigint as n_all, sum(len(t))::bigint as l_all from d),
p as (select rid, doc_id, len(t)::bigint as n, unnest(t) as term from d),
tf as (select rid, any_value(doc_id) as doc_id, any_value(n) as n, term, count(*)::bigint as tf from p group by rid, term),
w as (select term, floor(1000 * ln((2 * n_all + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, sizes group by term, n_all),
i as (select row_number() over () as q, item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+'))) as term from benchmark),
s as (select q, any_value(item_id) as item_id, rid, any_value(doc_id) as doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_all) // l_all))))::bigint as score
  from i join tf using (term) join w using (term), sizes group by q, rid),
r as (select *, row_number() over (partition by q order by score desc, doc_id nulls first, rid)::int as rank from s where score > 0)
select item_id, rank, doc_id, score from r where rank <= 50
"""
