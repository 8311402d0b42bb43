"""The store of chunks with vectors, and the tables of documents beside it, as operations from table to table; a sink at the end makes one of them the new table.

Chunks: id, document, chunk_index, page, strategy, n_chars, text, vector, source, question, engine, based_on, created. A null source is a document's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.operators.nearest import nearest as nearest

GENERATED, GENERATED_DOC = "generated", "generated answers"
SCHEMA = "id string, document string, chunk_index int, page int, strategy string, n_chars int, text string, vector array<float>, source string, question string, engine string, based_on string, created string"
QUESTION_CHARS, BASED_ON_CHARS, LEAST_CHARS = 300, 500, 20
#: Fixed value: what an answer says that found nothing.
NOT_FOUND = "확인되지 않습니다"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def reset(spark: SparkSession, confirm: bool = False) -> DataFrame:
    """The empty store; an error without confirmation."""
    if not confirm:
        raise ValueError("a reset takes confirm=True")
    return empty(spark)


def _whole(rows: DataFrame) -> DataFrame:
    """rows with all columns of a store, null where it has none."""
    names = {c.lower() for c in rows.columns}
    return rows.select(*((F.col(f.name) if f.name.lower() in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty(rows.sparkSession).schema))


def is_generated() -> Column:
    return F.col("source").eqNullSafe(GENERATED)


def add(store: DataFrame, document: str, chunks: DataFrame) -> DataFrame:
    """store with the chunks (chunk_index, page, strategy, n_chars, text, vector) of a document in place of those it had under the same ids."""
    new = _whole(chunks.withColumns({"id": F.concat(F.lit(document + "#"), F.col("chunk_index").cast("string")), "document": F.lit(document), "source": F.lit("document")}))
    return store.join(new.select("id"), "id", "left_anti").select(*store.columns).unionByName(new)


def append_embedded(store: DataFrame, document: str, chunks: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The store with a document's chunks and their vectors (chunk_index, vector), and one row: rows before, added, replaced, without (chunks without a vector, which stay out), after. Indexes of the store's words have to follow: see index.Bm25Index."""
    have = vectors.select("chunk_index", "vector").dropDuplicates(["chunk_index"])
    whole = chunks.drop("vector").join(have, "chunk_index")
    out = add(store, document, whole)
    ids = whole.select(F.concat(F.lit(document + "#"), F.col("chunk_index").cast("string")).alias("id"))
    n = lambda d, name: d.agg(F.count(F.lit(1)).alias(name))
    totals = n(store, "before").crossJoin(n(whole, "added_")).crossJoin(n(store.join(ids, "id", "left_semi"), "replaced")).crossJoin(n(chunks, "all_"))  # one row each
    return out, totals.select("before", (F.col("added_") - F.col("replaced")).alias("added"), "replaced", (F.col("all_") - F.col("added_")).alias("without"), (F.col("before") + F.col("added_") - F.col("replaced")).alias("after"))


def replace(store: DataFrame, key: str, rows: DataFrame) -> DataFrame:
    """store without the rows whose key is among those of rows, and with rows: an upsert."""
    return store.join(rows.select(key).distinct(), key, "left_anti").select(*store.columns).unionByName(rows, allowMissingColumns=True)


def add_generated(store: DataFrame, answers: DataFrame) -> DataFrame:
    """store with answers (text, vector, question, engine, based_on, at: a time in nanoseconds, created) as rows of their own document; indexes go on from the number of rows."""
    # The answers of one question, a few rows.
    n = F.row_number().over(Window.orderBy("at")) - 1
    have = store.agg(F.count(F.lit(1)).alias("have_"))
    new = answers.withColumn("n_", n).crossJoin(F.broadcast(have)).withColumns({
        "id": F.concat(F.lit("gen#"), F.col("at").cast("string")), "document": F.lit(GENERATED_DOC), "chunk_index": F.col("have_") + F.col("n_"), "page": F.lit(0), "strategy": F.lit(GENERATED), "source": F.lit(GENERATED),
        "n_chars": F.length("text"), "question": F.substring("question", 1, QUESTION_CHARS), "based_on": F.substring("based_on", 1, BASED_ON_CHARS),
    })
    return store.unionByName(_whole(new))


def without_generated(store: DataFrame) -> DataFrame:
    return store.where(~is_generated())


def clear_generated(store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The store without generated rows, and one row: how many went."""
    return without_generated(store), store.agg(F.count_if(is_generated()).alias("removed"))


def rows(store: DataFrame) -> DataFrame:
    """The store without vectors: the corpus of word search. A null source is a document's; question, based_on, created and engine are there for generated rows only."""
    out = store.select("id", "document", "chunk_index", "page", "strategy", "n_chars", "text", F.coalesce("source", F.lit("document")).alias("source"), *(F.when(is_generated(), F.col(c)).alias(c) for c in ("question", "based_on", "created", "engine")))
    return out


def status(store: DataFrame, order: str = "chunk_index") -> DataFrame:
    """For each document: chunks, strategy and source of its first one, and how many are generated."""
    first = lambda c: F.min_by(c, order).alias(c)
    return store.withColumn("source", F.coalesce("source", F.lit("document"))).groupBy("document").agg(F.count(F.lit(1)).alias("chunks"), first("strategy"), first("source"), F.count_if(F.col("source") == GENERATED).alias("generated"))


def peek(store: DataFrame, document: str, chunk_index: int, head: int = 10) -> DataFrame:
    """dim and the first numbers of one chunk's vector, to four decimals."""
    one = store.where((F.col("document") == document) & (F.col("chunk_index") == chunk_index))
    return one.select(F.size("vector").alias("dim"), F.transform(F.slice("vector", 1, head), lambda x: F.round(x.cast("double"), 4)).alias("head"))


def quantized(vector: Column, places: int = 5) -> Column:
    return F.transform(vector.cast("array<double>"), lambda x: F.round(x, places) + F.lit(0.0))  # no negative zero


def savable(answers: DataFrame) -> DataFrame:
    """answers (engine_ord, engine, text, n_hits) with why: no_hits, short, not_found or same as an earlier one, whichever comes first; null where the answer is to be saved."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", "")
    why = F.when(F.col("n_hits") == 0, "no_hits").when(F.length(text) < LEAST_CHARS, "short").when(F.contains(text, F.lit(NOT_FOUND)), "not_found")
    a = answers.withColumn("why", why).withColumn("text", text)
    earlier = F.count_if(F.col("why").isNull()).over(Window.partitionBy("text").orderBy("engine_ord").rowsBetween(Window.unboundedPreceding, -1))
    return a.withColumn("why", F.coalesce("why", F.when(earlier > 0, "same")))


def delete_documents(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """A document's deletion from every table: each one without the rows of the documents in gone (column doc). Indexes and edges are computed from what is left."""
    ids = gone.select(F.col("doc").alias("gone_")).distinct()
    return {name: t.join(ids, F.col("doc") == F.col("gone_"), "left_anti") for name, t in tables.items()}
