"""Two searches of one store side by side, by meaning and by words, for a table of questions.

The order of steps is part of what comes out. A rewritten question, unless the guard refuses it, is what both searches look for; a vector may be that of a drafted answer, and serves the search by meaning only. Each column is reranked by itself, by verdicts on the question as it was
asked; what it keeps are its hits from then on, so that evidence and contexts see these. Evidence by sentences is marked in the column by meaning, words' parts are told in the column by words, and the columns are never fused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import rewrite_fault
from quillgraph.operators import rerank, retrieval, store
from quillgraph.operators.nearest import nearest

COLUMNS = ("semantic", "bm25")


def effective(questions: DataFrame) -> DataFrame:
    """query_id, question, text (what is searched for) and fault: why a rewritten question was refused. questions: query_id, question, rewritten (null for none)."""
    q = questions.withColumn("fault", F.when(F.col("rewritten").isNotNull(), rewrite_fault(F.col("question"), F.col("rewritten"))))
    return q.select("query_id", "question", F.when(F.col("rewritten").isNotNull() & F.col("fault").isNull(), F.col("rewritten")).otherwise(F.col("question")).alias("text"), "fault")


def hits(chunks: DataFrame, questions: DataFrame, vectors: DataFrame, k: int = 5, verdicts: DataFrame | None = None, include_generated: bool = True) -> DataFrame:
    """The hits of both columns: query_id, engine, id, score, rank_before, rank (rank_before without verdicts), moved, kept, and the chunk's document, page, chunk_index, text, source; those that verdicts pushed out are there too. chunks: store.SCHEMA; vectors: query_id, q;
    verdicts: query_id, id, raw, tokens (see rerank.judged). Words' statistics are those of the whole store, whether generated rows are searched or not."""
    searched = chunks if include_generated else store.without_generated(chunks)
    most = k if verdicts is None else rerank.pool(k)
    near = nearest(searched.where(F.col("vector").isNotNull()), vectors, most, None, "id", "vector").select("query_id", F.lit(COLUMNS[0]).alias("engine"), "id", "score", F.col("rank").alias("rank_before"))
    words = retrieval.bm25(chunks.select(F.col("id").alias("doc_id"), "text"), effective(questions).select("query_id", "text"), None if include_generated else searched.select(F.col("id").alias("doc_id")))
    found = retrieval.best(words, most).select("query_id", F.lit(COLUMNS[1]).alias("engine"), F.col("doc_id").alias("id"), "score", F.col("rank").alias("rank_before"))
    both = near.unionByName(found).join(store.rows(searched).select("id", "document", "page", "chunk_index", "text", "source"), "id")
    if verdicts is None:
        return both.withColumns({"rank": F.col("rank_before"), "moved": F.lit(0), "kept": F.lit(True)})
    judged = rerank.judged(both.withColumnRenamed("score", "found").join(verdicts.select("query_id", "id", "raw", "tokens"), ["query_id", "id"], "left"))
    r = rerank.rerank(judged.withColumn("column_", F.concat_ws("\n", F.col("query_id").cast("string"), "engine")), k, "column_")
    return r.select("query_id", "engine", "id", F.col("found").alias("score"), "rank_before", F.col("rank_after").alias("rank"), "moved", "kept", "document", "page", "chunk_index", "text", "source", F.col("score").alias("judged"), "verdict", "score_source")


def marked(found: DataFrame, sentence_vectors: DataFrame, vectors: DataFrame) -> DataFrame:
    """Sentences of the kept hits by meaning with rank and level (see rerank.evidence): query_id, id, sent_no, start, end, sentence, score, base. sentence_vectors: id, sent_no, vector; vectors: query_id, q."""
    h = found.where((F.col("engine") == COLUMNS[0]) & F.col("kept")).select("query_id", F.xxhash64("id").alias("hit_id"), "id", "text", F.col("score").alias("base"))
    s = rerank.sentence_scores(h.drop("id"), sentence_vectors.select(F.xxhash64("id").alias("hit_id"), "sent_no", "vector"), vectors)
    s = s.join(h.select("query_id", "hit_id", "id"), ["query_id", "hit_id"])
    return rerank.evidence(s, ("query_id", "id")).drop("hit_id")


def contexts(found: DataFrame) -> DataFrame:
    """query_id, engine, context: what each column's answer rests on."""
    c = found.where("kept").withColumn("key_", F.struct("query_id", "engine"))
    return rerank.context(c, "key_").select("key_.query_id", "key_.engine", "context")


def overlap(found: DataFrame) -> DataFrame:
    """query_id and shared: hits that both columns keep."""
    kept = found.where("kept").select("query_id", "id", "engine").distinct()
    n = kept.groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("n")).groupBy("query_id").agg(F.count_if(F.col("n") == len(COLUMNS)).alias("shared"))
    return n
