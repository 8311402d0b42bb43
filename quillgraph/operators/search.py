"""Keyword search, related keywords, and hybrid search over chapters, for a table of queries.

chapters: chapter, doc, doc_title, title, summary, category, text, ord (the chapter's place in the library, which decides ties). refs: chapter, term, weight. keywords: term, label, category, n_chapters, ord. queries: query_id, text. Every result has query_id.

Whether a keyword, title or summary contains a word of a query is found by an index of grams: a word is looked up by its rarest gram of three characters (or of all it has), and only what holds that gram is compared. Whether a word contains a keyword is an
equality of its substrings. So the work follows the matches, not queries times keywords.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import STOP, composed, normalize_keyword, occurrences, truncate
from quillgraph.operators.retrieval import majority
from quillgraph.sources.versions import scratch

HITS, SOURCES, CANDIDATES = 12, 10, 400
CONTEXT_SOURCES, CONTEXT_CHARS, LEAST_SCORE = 8, 2200, 0.05
GRAM, LONGEST = 3, 60  # characters of a gram; of a keyword
GRAMS, SLICE = 100_000, 256  # grams that a task may hold; texts that it takes at once


def asked(queries: DataFrame) -> DataFrame:
    """query_id, full (the normalised query) and words: its distinct words of two characters or more, in order."""
    q = queries.select("query_id", normalize_keyword(composed(F.coalesce("text", F.lit("")))).alias("full"))
    return q.select("query_id", "full", F.array_distinct(F.filter(F.split("full", r"[\s,;/|]+"), lambda t: F.length(t) >= 2)).alias("words"))


def frequency_keywords(chapters: DataFrame, most: int = 8) -> DataFrame:
    """(chapter, term, label, weight, pos): the commonest words of each chapter's title (four times) and of its text, where capitalised Latin words and Hangul runs count; ties to those seen first. Weights are shares of the commonest one's count."""
    split = F.transform(F.split(composed(F.col("title")), r"[\s,:;()]+"), lambda w: F.struct(w.alias("w"), normalize_keyword(w).alias("term"), F.lit(4).alias("n")))
    found = F.regexp_extract_all(composed(F.coalesce("text", F.lit(""))), F.lit(r"((?<![A-Za-z0-9_])[A-Z][a-zA-Z]{3,}(?![A-Za-z0-9_])|[가-힣]{2,})"), F.lit(1))
    # What is found in a text is letters only, so lower case is its normal form.
    words = F.concat(F.coalesce(split, F.array()), F.transform(found, lambda w: F.struct(w.alias("w"), F.lower(w).alias("term"), F.lit(1).alias("n"))))
    w = chapters.select("chapter", F.posexplode(words).alias("at", "x")).select("chapter", "at", F.col("x.w").alias("raw"), "x.n", "x.term")
    w = w.where((F.length("term") >= 2) & ~F.col("term").isin(*STOP) & ~F.col("term").rlike("^[0-9]+$"))
    c = w.groupBy("chapter", "term").agg(F.sum("n").alias("n"), F.min_by("raw", "at").alias("label"), F.min("at").alias("first"))
    by = Window.partitionBy("chapter")
    c = c.withColumn("pos", F.row_number().over(by.orderBy(F.desc("n"), "first"))).withColumn("top", F.max("n").over(by)).where(F.col("pos") <= most)
    return c.select("chapter", "term", "label", F.round(F.col("n") / F.col("top"), 2).alias("weight"), "pos")


def keyword_table(refs: DataFrame, chapters: DataFrame) -> DataFrame:
    """Keywords of refs (chapter, term, label, pos): term, label (of the first chapter), category (majority of its chapters', ties to the first), n_chapters, ord. chapters: chapter, category, ord."""
    r = refs.join(chapters.select("chapter", "category", "ord"), "chapter")
    k = r.groupBy("term").agg(F.min_by("label", "ord").alias("label"), F.count(F.lit(1)).alias("n_chapters"), F.min(F.struct("ord", "pos")).alias("o"))
    k = k.join(majority(r, "term", "category", "ord"), "term")
    return k.select("term", "label", "category", "n_chapters", (F.col("o.ord") * 1000 + F.col("o.pos")).alias("ord"))


def stored(chapters: DataFrame, refs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """refs and keywords of chapters, written once to the shared folder, so that a search reads them and computes neither."""
    spark, path = chapters.sparkSession, scratch(chapters.sparkSession, "keywords")
    (frequency_keywords(chapters) if refs is None else refs).write.parquet(f"{path}/refs")
    refs = spark.read.parquet(f"{path}/refs")
    keyword_table(refs, chapters).write.parquet(f"{path}/keywords")
    return refs, spark.read.parquet(f"{path}/keywords")


def _grams(s: Column, n) -> Column:
    """The distinct stretches of n characters."""
    return F.when(F.length(s) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substring(s, i, F.lit(n) if isinstance(n, int) else n)))).otherwise(F.array().cast("array<string>"))


def _lengths(keep) -> dict:
    """The sets of grams to look for, by length; without any, all grams."""
    return {n: None if keep is None else {g for g in keep if len(g) == n} for n in range(1, GRAM + 1)}


def _held(s: str, sets: dict) -> list[str]:
    """The distinct grams of a text that are in their length's set."""
    out: list[str] = []
    for n, keep in sets.items():
        if keep is None or keep:
            own = {s[i : i + n] for i in range(len(s) - n + 1)}
            out += own if keep is None else own & keep
    return out


def _gram_counts(sets: dict):
    """Texts that hold each gram, combined before the shuffle."""

    def run(batches):
        held: Counter = Counter()

        def out():
            r = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["gram", "n"])
            held.clear()
            return r

        for b in batches:
            for s in b.column("s").to_pylist():
                if s:
                    held.update(_held(s, sets))
                    if len(held) > GRAMS:
                        yield out()
        if held:
            yield out()

    return run


def _gram_rows(sets: dict):
    """A row of the texts for each gram that they hold."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE):  # one gram may be in every text, and a text may hold many
                b = batch.slice(a, SLICE)
                of = [_held(s, sets) if s else [] for s in b.column("s").to_pylist()]
                at = pa.array([i for i, g in enumerate(of) for _ in g], pa.int64())
                yield pa.RecordBatch.from_arrays([*b.take(at).columns, pa.array([x for g in of for x in g], pa.string())], [*b.schema.names, "gram"])

    return run


def _few(grams: DataFrame):
    """The grams, if they are few enough for every task to hold them."""
    rows = grams.limit(GRAMS + 1).collect()
    return [r[0] for r in rows] if len(rows) <= GRAMS else None


def containing(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(needle, and the columns of texts but s): the rows of texts whose s contains a needle. needles: needle, distinct and not empty. Each needle is looked up by its rarest gram.

    Two passes over the texts: one counts the needles' grams, the other gives a row for each rarest gram that a text holds. Up to GRAMS grams go to the tasks, which leave out all others; of more, a join picks them.
    """
    own = needles.select("needle", F.explode(_grams(F.col("needle"), F.least(F.lit(GRAM), F.length("needle")))).alias("gram"))
    keep = _few(own.select("gram").distinct())
    columns = [c for c in texts.columns if c != "s"]
    if keep == []:
        return texts.select(F.lit("").alias("needle"), *columns).where("false")
    counts = texts.select("s").mapInArrow(_gram_counts(_lengths(keep)), "gram string, n long")
    df = counts.groupBy("gram").agg(F.sum("n").alias("n_"))
    # A gram that no text has has no row there: its needle is in none.
    rare = own.join(df, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n_", F.lit(0)).alias("n"), "gram")).alias("g")).where("g.n > 0").select("needle", F.col("g.gram").alias("gram"))
    path = scratch(needles.sparkSession, "rare")
    rare.write.parquet(path)
    rare = needles.sparkSession.read.schema("needle string, gram string").parquet(path)
    keep = _few(rare.select("gram").distinct())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema) + ", gram string"
    rows = texts.mapInArrow(_gram_rows(_lengths(keep)), schema)
    # Few grams stand for few needles or so; the texts stay where they are then.
    return rows.join(rare if keep is None or rare.count() > GRAMS else F.broadcast(rare), "gram").where(F.contains("s", F.col("needle"))).select("needle", *columns)


def keyword_score(full: Column, words: Column, term: Column, label: Column) -> Column:
    """5 or 3 for the whole query, and 2, 1 or 0.8 for each word: equal, contained in the keyword, containing it."""
    low = F.lower(label)
    inside = lambda t: F.contains(term, t) | F.contains(low, t)
    equal = lambda t: (term == t) | (low == t)
    whole = F.when(full == "", 0.0).when(equal(full), 5.0).when(inside(full), 3.0).otherwise(0.0)
    each = F.transform(words, lambda t: F.when(equal(t), 2.0).when(inside(t), 1.0).when(F.contains(t, term) & (F.length(term) >= 2), 0.8).otherwise(0.0))
    return F.round(F.aggregate(each, whole, lambda s, x: s + x), 9)


def keyword_hits(keywords: DataFrame, q: DataFrame) -> DataFrame:
    """The HITS best keywords of each query of asked: query_id, s, and the columns of keywords."""
    needles = q.select("query_id", F.explode(F.array_distinct(F.concat("words", F.array("full")))).alias("needle")).where("needle <> ''")
    one = needles.select("needle").distinct()
    k = keywords.select("term", F.lower("label").alias("l_"))
    texts = k.select("term", F.col("term").alias("s")).unionAll(k.where("l_ <> term").select("term", F.col("l_").alias("s")))
    held = containing(one, texts).select("needle", "term")
    # Words that contain a keyword: a substring equals it. Keywords have LONGEST characters at most; longer ones aren't in this index.
    parts = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.least(F.length("needle"), F.lit(LONGEST)))), lambda n: _grams(F.col("needle"), n))))
    words = q.select(F.explode("words").alias("needle")).distinct()
    holding = words.select("needle", F.explode(parts).alias("term")).join(k.select("term"), "term", "left_semi").select("needle", "term")
    longer = k.where(F.length("term") > LONGEST).select(F.col("term").alias("needle"))
    long_words = one.where(F.length("needle") > LONGEST)
    holding = holding.unionAll(containing(longer, long_words.select(F.col("needle").alias("word"), F.col("needle").alias("s"))).select(F.col("word").alias("needle"), F.col("needle").alias("term")))
    pairs = needles.join(held.unionAll(holding), "needle").select("query_id", "term").distinct()
    scored = pairs.join(keywords, "term").join(q, "query_id").withColumn("s", keyword_score(F.col("full"), F.col("words"), F.col("term"), F.col("label"))).where("s > 0").drop("full", "words")
    w = Window.partitionBy("query_id").orderBy(F.desc("s"), "ord")
    return scored.withColumn("k_", F.row_number().over(w)).where(F.col("k_") <= HITS).withColumnRenamed("k_", "hit_rank")


def snippet(text: Column, words: Column, fallback: Column) -> Column:
    """What stands around the earliest word found, blanks collapsed, ellipses where it is cut; else the start of the fallback, or of the text."""
    low = F.lower(text)
    at = F.array_min(F.filter(F.transform(words, lambda t: F.position(t, low)), lambda p: p > 0))
    start = F.greatest(at - 111, F.lit(0))
    stop = F.least(at + 189, F.length(text))
    cut = F.regexp_replace(F.regexp_replace(F.substring(text, start + 1, stop - start), r"\s+", " "), "^ | $", "")
    cut = F.concat(F.when(start > 0, "…").otherwise(""), cut, F.when(stop < F.length(text), "…").otherwise(""))
    return F.when(at.isNotNull(), cut).otherwise(truncate(F.when(F.coalesce(fallback, F.lit("")) != "", fallback).otherwise(text), 240))


def _heads(chapters: DataFrame, q: DataFrame) -> DataFrame:
    """query_id, chapter, head: 1.5 for each word in the title, else 0.6 for one in the summary."""
    words = q.select("query_id", F.explode("words").alias("needle"))
    row = lambda c, points: chapters.select("chapter", F.lower(c).alias("s"), F.lit(points).alias("p"))
    found = containing(words.select("needle").distinct(), row("title", 1.5).unionAll(row("summary", 0.6)))
    each = words.join(found, "needle").groupBy("query_id", "chapter", "needle").agg(F.max("p").alias("p"))
    return each.groupBy("query_id", "chapter").agg(F.sum("p").alias("head"))


def chapter_scores(chapters: DataFrame, refs: DataFrame, hits: DataFrame, q: DataFrame) -> DataFrame:
    """query_id, chapter, ord, score (matched keywords, title, summary, text) and matched (labels, by weight); only those with a score. The texts of the first CANDIDATES chapters of a query are read, scored ones before others."""
    one = F.struct((-F.col("weight")).alias("w"), "term", "label")
    by_term = refs.select("chapter", "term", "weight").join(hits.select("query_id", "term", "label", "s"), "term").groupBy("query_id", "chapter").agg(F.sum(F.col("s") * (0.4 + F.col("weight"))).alias("head"), F.transform(F.sort_array(F.collect_list(one)), lambda x: x["label"]).alias("matched"))
    heads = by_term.unionByName(_heads(chapters, q), allowMissingColumns=True)
    heads = heads.groupBy("query_id", "chapter").agg(F.sum("head").alias("head"), F.max("matched").alias("matched")).join(chapters.select("chapter", "ord"), "chapter")
    # The first 2 * CANDIDATES chapters hold CANDIDATES that have no score, or those with a score are CANDIDATES already.
    first = chapters.orderBy("ord").limit(2 * CANDIDATES).select("chapter", "ord")
    others = q.select("query_id").crossJoin(F.broadcast(first)).select("query_id", "chapter", "ord", F.lit(0.0).alias("head"), F.lit(None).cast("array<string>").alias("matched"))
    c = heads.unionByName(others).groupBy("query_id", "chapter").agg(F.max("ord").alias("ord"), F.max("head").alias("head"), F.max("matched").alias("matched"))
    w = Window.partitionBy("query_id").orderBy((F.col("head") > 0).desc(), "ord")
    c = c.withColumn("read", F.row_number().over(w) <= CANDIDATES)
    # Each text once, whatever the number of queries that read it.
    readers = c.where("read").join(q, "query_id").groupBy("chapter").agg(F.collect_list(F.struct("query_id", "full", "words")).alias("qs"))
    low = F.col("low_")
    n_of = lambda x: F.aggregate(F.transform(x["words"], lambda t: occurrences(low, t).cast("double")), F.lit(0.0), lambda s, v: s + v) + F.when((F.size(x["words"]) > 1) & (x["full"] != "") & F.contains(low, x["full"]), 6.0).otherwise(0.0)
    texts = chapters.select("chapter", F.lower(F.coalesce("text", F.lit(""))).alias("low_")).join(readers, "chapter")
    texts = texts.select("chapter", F.explode(F.transform("qs", lambda x: F.struct(x["query_id"].alias("query_id"), n_of(x).alias("n")))).alias("x")).where("x.n > 0").select("chapter", "x.query_id", "x.n")
    c = c.join(texts, ["query_id", "chapter"], "left").withColumn("score", F.round(F.col("head") + F.least(F.lit(4.0), 0.3 * F.coalesce("n", F.lit(0.0))), 9))
    return c.where("score > 0").select("query_id", "chapter", "ord", "score", "matched")


def keyword_sources(chapters: DataFrame, refs: DataFrame, hits: DataFrame, q: DataFrame) -> DataFrame:
    """The SOURCES best chapters of each query: query_id, rank, chapter, doc, doc_title, title, category, score, matched (labels), snippet."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "ord"))
    best = chapter_scores(chapters, refs, hits, q).withColumn("rank", rank).where(F.col("rank") <= SOURCES).drop("ord")
    best = best.join(chapters, "chapter").join(q.select("query_id", "words"), "query_id")
    return best.select("query_id", "rank", "chapter", "doc", F.coalesce("doc_title", "doc").alias("doc_title"), "title", "category", F.round("score", 3).alias("score"), F.coalesce("matched", F.array().cast("array<string>")).alias("matched"), snippet(F.coalesce("text", F.lit("")), F.col("words"), F.col("summary")).alias("snippet"))


def related_keywords(refs: DataFrame, keywords: DataFrame, hits: DataFrame, limit: int = 10) -> DataFrame:
    """Of each query's four best hits, each one's twelve keywords that share most chapters with it, hits left out; shared chapters weigh by the hit's score. query_id, term, label, category, n_chapters, score."""
    best = hits.where("hit_rank <= 4").select("query_id", F.col("term").alias("hit"), "s")
    r = refs.select("chapter", "term")
    # A hit's neighbours are the same for all queries that it is a hit of.
    own = r.join(best.select(F.col("hit").alias("term")).distinct(), "term", "left_semi").select("chapter", F.col("term").alias("hit"))
    near = r.join(own, "chapter").where("term <> hit").groupBy("hit", "term").agg(F.count(F.lit(1)).alias("shared")).join(keywords.select("term", "ord"), "term")
    first = near.withColumn("k", F.row_number().over(Window.partitionBy("hit").orderBy(F.desc("shared"), "ord"))).where("k <= 12").drop("ord")
    out = best.join(first, "hit").join(hits.select("query_id", "term"), ["query_id", "term"], "left_anti").groupBy("query_id", "term").agg(F.round(F.sum(F.col("shared") * F.col("s")), 9).alias("raw"))
    out = out.join(keywords, "term").withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("raw"), "ord"))).where(F.col("k") <= limit)
    return out.select("query_id", "term", "label", "category", "n_chapters", F.round("raw", 2).alias("score"))


def result_category(sources: DataFrame, hits: DataFrame, q: DataFrame) -> DataFrame:
    """A row for each query: the commonest category of its first three sources, ties to the better ranked; without sources the best hit's; else misc."""
    first = sources.where("rank <= 3").groupBy("query_id", "category").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("r"))
    of_sources = first.groupBy("query_id").agg(F.max_by("category", F.struct("n", (-F.col("r")).alias("r"))).alias("a"))
    of_hits = hits.where("hit_rank = 1").select("query_id", F.col("category").alias("b"))
    return q.select("query_id").join(of_sources, "query_id", "left").join(of_hits, "query_id", "left").select("query_id", F.coalesce("a", "b", F.lit("misc")).alias("category"))


def hybrid_rank(chapters: DataFrame, refs: DataFrame, hits: DataFrame, sources: DataFrame, chunk_hits: DataFrame, q: DataFrame) -> DataFrame:
    """The CONTEXT_SOURCES best chapters of each query by 0.7 of their best chunk's similarity and 0.3 of their keyword score: query_id, rank, chapter, doc, doc_title, title, category, score, context, snippet, matched.

    chunk_hits: query_id, chapter, text, score of the chunks found by similarity. Chapters of the three best keywords count as found by keyword with 0.35 at least. The snippet is the keyword source's, else what stands around the earliest word in the context's whole
    text without its header (all up to the first blank line).
    """
    most = sources.where("rank = 1").select("query_id", F.when(F.col("score") > 0, F.col("score")).otherwise(1.0).alias("most"))
    by_word = sources.join(most, "query_id").select("query_id", "chapter", F.lit(0.0).alias("emb"), (F.col("score") / F.col("most")).alias("kw"))
    expanded = refs.select("chapter", "term").join(hits.where("hit_rank <= 3").select("query_id", "term"), "term").select("query_id", "chapter", F.lit(0.0).alias("emb"), F.lit(0.35).alias("kw")).distinct()
    by_chunk = chunk_hits.select("query_id", "chapter", F.greatest("score", F.lit(0.0)).alias("emb"), F.lit(0.0).alias("kw"))
    both = by_chunk.unionByName(by_word).unionByName(expanded).groupBy("query_id", "chapter").agg(F.round(0.7 * F.max("emb") + 0.3 * F.max("kw"), 9).alias("raw")).where(F.col("raw") > LEAST_SCORE)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("raw"), "ord"))
    best = both.join(chapters.select("chapter", "ord"), "chapter").withColumn("rank", rank).where(F.col("rank") <= CONTEXT_SOURCES).drop("ord")
    # A query has ten chunks or so; those of equal score keep no order but their text's.
    texts = chunk_hits.groupBy("query_id", "chapter").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "text"))), lambda x: x["text"]), "\n…\n").alias("chunks"))
    best = best.join(chapters, "chapter").join(texts, ["query_id", "chapter"], "left").join(sources.select("query_id", "chapter", "matched", F.col("snippet").alias("found")), ["query_id", "chapter"], "left").join(q.select("query_id", "words"), "query_id")
    full = F.coalesce(F.nullif("chunks", F.lit("")), F.nullif("text", F.lit("")), "summary", F.lit(""))
    body = F.regexp_replace(full, r"\A[^\n]*\n\n", "")
    return best.select("query_id", "rank", "chapter", "doc", F.coalesce("doc_title", "doc").alias("doc_title"), "title", "category", F.round("raw", 3).alias("score"), truncate(full, CONTEXT_CHARS).alias("context"), F.coalesce(F.nullif("found", F.lit("")), snippet(body, F.col("words"), F.col("summary"))).alias("snippet"), F.coalesce("matched", F.array().cast("array<string>")).alias("matched"))


def search_events(mode: str, category: DataFrame, keywords: DataFrame, sources: DataFrame) -> DataFrame:
    """The events of each query's search in order: category, keywords, sources, done. run_id (the query's), seq, type, payload (JSON). A query without keywords or sources has empty lists."""

    def listed(df: DataFrame, kind: str) -> DataFrame:  # HITS and SOURCES rows of a query
        cols = [c for c in df.columns if c != "query_id"]
        lists = df.groupBy("query_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct(*cols)))).alias("payload"), F.count(F.lit(1)).alias("found"))
        return category.select("query_id").join(lists, "query_id", "left").select("query_id", F.lit(kind).alias("type"), F.coalesce("payload", F.lit("[]")).alias("payload"), F.coalesce("found", F.lit(0)).alias("found"))

    s = listed(sources, "sources")
    parts = [category.select("query_id", F.lit("category").alias("type"), F.to_json(F.struct("category")).alias("payload")), listed(keywords, "keywords"), s, s.select("query_id", F.lit("done").alias("type"), F.to_json(F.struct(F.lit(mode).alias("mode"), "found")).alias("payload"))]
    out = None
    for seq, p in enumerate(parts):
        p = p.select(F.col("query_id").cast("string").alias("run_id"), F.lit(seq).alias("seq"), "type", "payload")
        out = p if out is None else out.unionByName(p)
    return out


def doc_search(docs: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """The first documents that hold a word of the query: doc, word (the first in the query's order), snippet (400 characters from 100 before it)."""
    words = query.lower().split()
    low = F.lower("text")
    at = F.coalesce(*[F.nullif(F.instr(low, w), F.lit(0)) for w in words]) if words else F.lit(None).cast("int")
    word = F.coalesce(*[F.when(F.contains(low, F.lit(w)), w) for w in words]) if words else F.lit(None).cast("string")
    found = docs.select("doc", "text", at.alias("at"), word.alias("word")).where("at is not null").orderBy("doc").limit(limit)
    return found.select("doc", "word", F.substring("text", F.greatest(F.col("at") - 100, F.lit(1)), F.lit(400)).alias("snippet"))
