"""A BM25 index that follows its corpus: a change costs what it changes, and searches give what a rebuilt index would.

Each update adds a segment to each table and rewrites none: postings and a forward row for each new text, a mark for each document that was replaced or deleted (rows of older generations don't count any more), and the differences that
the change makes to the terms' document frequencies and to the corpus's size. What a replaced document had is found in its forward row. All of an update is one commit of versioned tables. Postings lie by buckets of terms, so that a search reads those of its terms;
compact puts segments together and leaves out what doesn't count.

Null texts are deletions; of several rows for one document in an update the greatest text counts. A text without tokens is a document without postings. Document ids are whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.text import tokens
from quillgraph.operators.pairs import parts
from quillgraph.operators.retrieval import B, K1, best
from quillgraph.sources.versions import Versions

SCHEMAS = {
    "docs": "doc_id long, gen long, dl long, terms array<struct<term:string,tf:long>>",
    "postings": "term string, doc_id long, gen long, tf long, dl long",
    "gone": "doc_id long, gen long",
    "df": "term string, n long",
    "size": "docs long, words long",
}
BUCKETS = 16
TEXTS, FORWARD, POSTINGS = 1 << 12, 1 << 13, 1 << 19  # rows of a task: texts, forward rows (a text's terms), postings
PARTS, SENT = 1 << 18, 100_000  # parts of scores of a task; terms of queries that are sent to all tasks
SLICE = 256  # texts whose terms are counted at once


def _counted(batches):
    """The terms of each text and how often it holds them, counted where the text is."""
    for whole in batches:
        for a in range(0, whole.num_rows, SLICE):
            b = whole.slice(a, SLICE)
            toks = b.column("toks")
            words, row = toks.flatten().dictionary_encode(), pc.list_parent_indices(toks).to_numpy().astype(np.int64)
            n = max(len(words.dictionary), 1)
            held, tf = np.unique(row * n + words.indices.to_numpy(), return_counts=True)
            terms = pa.StructArray.from_arrays([words.dictionary.take(pa.array(held % n)), pa.array(tf, pa.int64())], ["term", "tf"])
            cuts = pa.array(np.searchsorted(held, np.arange(b.num_rows + 1) * n), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pc.list_value_length(toks).cast(pa.int64()), pa.ListArray.from_arrays(cuts, terms)], ["doc_id", "dl", "terms"])


class Bm25Index:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.tables, self.buckets = Versions(spark, path), buckets

    def _read(self, name: str, version: int) -> DataFrame:
        return self.tables.read(name, SCHEMAS[name], version)

    def _postings(self, version: int, only=None) -> DataFrame:
        return self.tables.read_buckets("postings", SCHEMAS["postings"], only, version)

    def _live(self, rows: DataFrame, version: int) -> DataFrame:
        """Rows but those of documents that have been replaced or deleted since."""
        gone = self._read("gone", version).groupBy(F.col("doc_id").alias("d_")).agg(F.max("gen").alias("g_"))
        return rows.join(gone, (F.col("doc_id") == F.col("d_")) & (F.col("gen") < F.col("g_")), "left_anti")

    def _bucket(self, term):
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _within(self, postings: int):
        """How many tasks write a bucket of so many postings in all."""
        return self.buckets, parts(postings, POSTINGS * self.buckets), F.col("doc_id")

    def update(self, changes: DataFrame) -> int:
        """Add, replace and delete (null text) documents (doc_id, text); gives the new version."""
        base, _ = self.tables.current()
        gen = base + 1
        c = changes.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        c = c.repartition(parts(c.count(), TEXTS), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"))
        toks = c.where("text is not null").select("doc_id", tokens(F.col("text")).alias("toks"))
        counted = toks.mapInArrow(_counted, "doc_id long, dl long, terms array<struct<term:string,tf:long>>")
        docs = self.tables.stage(counted.select("doc_id", F.lit(gen).cast("long").alias("gen"), "dl", "terms"))
        new = self.tables.staged(docs, SCHEMAS["docs"])
        forward = self._read("docs", base)
        old = self._live(forward.repartition(parts(forward.count(), FORWARD), "doc_id"), base).join(c.select("doc_id"), "doc_id", "left_semi")
        gone = self.tables.stage(old.select("doc_id", F.lit(gen).cast("long").alias("gen")).distinct())
        each = new.select("doc_id", "gen", "dl", F.explode("terms").alias("t")).select("t.term", "doc_id", "gen", "t.tf", "dl")
        postings = self.tables.stage_in_buckets(each, self._bucket("term"), "term", within=self._within(new.agg(F.sum(F.size("terms"))).first()[0] or 0))
        signed = new.select("dl", "terms", F.lit(1).alias("s")).unionByName(old.select("dl", "terms", F.lit(-1).alias("s")))
        df = self.tables.stage(signed.select("s", F.explode("terms").alias("t")).groupBy("t.term").agg(F.sum("s").alias("n")).where("n <> 0"))
        size = self.tables.stage(signed.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("docs"), F.coalesce(F.sum(F.col("s") * F.col("dl")), F.lit(0)).alias("words")))
        return self.tables.commit(append={"docs": [docs], "gone": [gone], "df": [df], "size": [size]} | {f"postings/{b:03d}": [f] for b, f in postings.items()}, base=base)

    def compact(self) -> int:
        """Put each table's segments together, without rows that don't count; gives the new version."""
        base, _ = self.tables.current()
        docs = self._read("docs", base)
        docs = self._live(docs.repartition(parts(docs.count(), FORWARD), "doc_id"), base)
        rows = self._postings(base)
        postings = self.tables.stage_in_buckets(self._live(rows, base), self._bucket("term"), "term", within=self._within(rows.count()))
        postings = {f"postings/{b:03d}": [postings[b]] if b in postings else [] for b in range(self.buckets)}
        df = self._read("df", base).groupBy("term").agg(F.sum("n").alias("n")).where("n <> 0")
        size = self._read("size", base).agg(F.sum("docs").alias("docs"), F.sum("words").alias("words"))
        stage = self.tables.stage
        return self.tables.commit(replace={"docs": [stage(docs)], "df": [stage(df)], "size": [stage(size)]} | postings, drop=("gone",), base=base)

    def statistics(self) -> DataFrame:
        """One row: docs, avgdl."""
        s = self._read("size", self.tables.current()[0]).agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"))
        return s.select("docs", F.when(F.col("docs") > 0, F.col("words") / F.col("docs")).alias("avgdl"))

    def parts(self, queries: DataFrame) -> DataFrame:
        """(query_id, doc_id, term, tf, idf, part) for each term of a query (query_id, text) that a document holds."""
        version, _ = self.tables.current()
        asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
        terms = asked.select("term").distinct()
        buckets = {r[0] for r in terms.select(self._bucket("term")).distinct().collect()}  # numbers of buckets
        df = self._read("df", version).join(terms, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
        asked = asked.join(df, "term")
        n_asked, n_parts = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum("df"), F.lit(0))).first()
        # A document's postings are in one task, and the tasks are as many as the parts need that they give, one for each query of a term.
        rows = self._postings(version, buckets).join(terms, "term", "left_semi").repartition(parts(n_parts, PARTS), "doc_id")
        p = self._live(rows, version).join(F.broadcast(asked) if n_asked <= SENT else asked, "term").crossJoin(self.statistics())  # one row
        idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        return p.select("query_id", "doc_id", "term", "tf", idf.alias("idf"), part.alias("part"))

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(query_id, rank, doc_id, score, matched): the k best documents of each query, ties by id."""
        scored = self.parts(queries).groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"), F.count(F.lit(1)).alias("matched")).where("score > 0")
        return best(scored, k).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score", "matched")
