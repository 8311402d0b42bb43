"""BM25 and vector retrieval, chunking, and rank operators as DataFrame plans."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillgraph.functions.text import tokens
from quillgraph.sources.versions import scratch

K1, B = 1.5, 0.75


def corpus(docs: DataFrame) -> DataFrame:
    """(doc_id, toks): what searches of a corpus share; persist it where there are several."""
    return docs.select("doc_id", tokens(F.col("text")).alias("toks"))


def bm25_parts(docs: DataFrame, queries: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, term, tf, idf, part) for each term of a query that a document holds. queries: query_id, text. Statistics come from all docs, rows from keep if given.

    Only postings of query terms are built, once: they are written to the shared folder, and df, scores and parts read them. Whether the queries' terms are sent to all tasks or dealt out by term is left to their size. For a corpus that is searched again and again see index.Bm25Index.
    """
    toks, spark = corpus(docs), docs.sparkSession
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    words = toks.select("doc_id", F.size("toks").alias("dl"), F.explode("toks").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    path = scratch(spark, "postings")
    words.groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf")).write.parquet(path)
    postings = spark.read.schema(StructType([docs.schema["doc_id"], *StructType.fromDDL("dl int, term string, tf long")])).parquet(path)
    stats = toks.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("toks")).alias("avgdl"))
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = df.crossJoin(F.broadcast(stats)).select("term", idf.alias("idf"), "avgdl")  # one row
    rows = postings if keep is None else postings.join(keep.select("doc_id"), "doc_id", "left_semi")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return rows.join(asked.join(weights, "term"), "term").select("query_id", "doc_id", "term", "tf", "idf", part.alias("part"))


def bm25(docs: DataFrame, queries: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score, matched) of the documents with a positive score for each query."""
    parts = bm25_parts(docs, queries, keep)
    return parts.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"), F.count(F.lit(1)).alias("matched")).where("score > 0")


def best(scored: DataFrame, k: int, tie: str = "doc_id") -> DataFrame:
    """The k best rows of each query, with rank from 1; each task keeps k a query before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def explained(parts: DataFrame, hits: DataFrame, most: int = 6) -> DataFrame:
    """hits with terms, their heaviest parts (term, tf, idf, score; to four decimals, ties by term), n_terms, all of them, and line, which says so."""
    p = parts.join(hits.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
    one = F.struct((-F.round("part", 4)).alias("k"), "term", "tf", F.round("idf", 4).alias("idf"), F.round("part", 4).alias("score"))
    g = p.groupBy("query_id", "doc_id").agg(F.sort_array(F.collect_list(one)).alias("l"), F.count(F.lit(1)).alias("n_terms"))  # a query's terms
    terms = F.transform(F.slice("l", 1, most), lambda x: F.struct(x["term"].alias("term"), x["tf"].alias("tf"), x["idf"].alias("idf"), x["score"].alias("score")))
    line = F.array_join(F.transform(F.slice("l", 1, 3), lambda x: F.concat(x["term"], F.lit(" ("), x["tf"].cast("string"), F.lit("x)"))), ", ")
    return hits.join(g.select("query_id", "doc_id", terms.alias("terms"), "n_terms", line.alias("line")), ["query_id", "doc_id"])


@lru_cache(4096)
def _finder(term: str):
    """Starts of a term: Latin ones as whole words, others at every place, overlaps too."""
    latin = term.isascii() and term.isalnum()
    return re.compile(rf"(?<![a-z0-9]){re.escape(term)}(?![a-z0-9])" if latin else rf"(?={re.escape(term)})").finditer


def term_spans(texts: DataFrame) -> DataFrame:
    """(id, start, end, top) where the terms of a text stand in it, whatever their case. texts: id, text, terms (array of term, in lower case, and top). A pass over each text, nothing is shuffled."""

    def run(batches):
        for b in batches:
            ids, starts, ends, tops = [], [], [], []
            for i, text, terms in zip(*(b.column(c).to_pylist() for c in ("id", "text", "terms"))):
                low = (text or "").lower()
                for t in terms or []:
                    found = [m.start() for m in _finder(t["term"])(low)] if t["term"] else []
                    ids += [i] * len(found)
                    starts += found
                    ends += [x + len(t["term"]) for x in found]
                    tops += [t["top"]] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(tops, pa.bool_())], ["id", "start", "end", "top"])

    return texts.select(F.col("id").cast("long"), "text", "terms").mapInArrow(run, "id long, start int, end int, top boolean")


def top(df: DataFrame, k: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(k)


def chunk_fixed(docs: DataFrame, size: int) -> DataFrame:
    """Windows of size characters, stripped; blank ones are left out and don't count."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(size)), lambda i: F.struct(i.alias("start"), strip(F.substring(F.col("text"), i + 1, F.lit(size))).alias("chunk")))
    # Numbered within the row, so that nothing is shuffled.
    rows = docs.select("doc_id", F.posexplode(F.filter(cut, lambda x: x["chunk"] != "")).alias("chunk_index", "c"))
    return rows.select("doc_id", "chunk_index", "c.start", F.length("c.chunk").alias("n_chars"), "c.chunk")


def majority(rows: DataFrame, key: str, value: str, ordinal: str) -> DataFrame:
    """The most frequent value of each key; ties go to the one seen first."""
    n = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(ordinal).alias("first"))
    return n.groupBy(key).agg(F.max_by(value, F.struct("n", (-F.col("first")).alias("f"))).alias(value))


def merge_spans(spans: DataFrame) -> DataFrame:
    """(id, island, start, end, n_spans, top): spans that overlap or touch become one, top if one of them is."""
    if "top" not in spans.columns:
        spans = spans.withColumn("top", F.lit(False))
    w = Window.partitionBy("id").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = spans.withColumn("new", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0))
    return flagged.withColumn("island", F.sum("new").over(w)).groupBy("id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_spans"), F.bool_or("top").alias("top"))
