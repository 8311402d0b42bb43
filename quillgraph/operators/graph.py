"""The document, chapter and keyword graph: index, edges, neighbours and the pruned view."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pairs import parts, shared_counts, shared_pairs
from .retrieval import majority

MOST_KEYWORDS = 2000  # of a view


def refs(mentions: DataFrame) -> DataFrame:
    """(doc, chapter, term, weight): a term once a chapter, by its greatest weight."""
    return mentions.where("term is not null").groupBy("doc", "chapter", "term").agg(F.max("weight").alias("weight"))


def keyword_index(r: DataFrame, chapters: DataFrame) -> DataFrame:
    """(term, n_chapters, n_docs, category): category by majority of the chapters', ties to the first chapter."""
    n = parts(r.count())
    of_term = r.repartition(n, "term")
    counts = of_term.groupBy("term").agg(F.count(F.lit(1)).alias("n_chapters")).join(of_term.select("term", "doc").distinct().groupBy("term").agg(F.count("doc").alias("n_docs")), "term")
    at = r.repartition(n, "chapter").join(chapters.select("chapter", "category").repartition(n, "chapter"), "chapter")
    return counts.join(majority(at.repartition(n, "term"), "term", "category", "chapter"), "term")


def cooccurrence(r: DataFrame) -> DataFrame:
    """(source, target, weight): chapters that two terms share."""
    return shared_pairs(r, "term", "chapter")


def shares(r: DataFrame) -> DataFrame:
    """(source, target, weight): terms that two documents share. Every pair that shares one is an edge."""
    return shared_pairs(r, "doc", "term")


def partners(r: DataFrame) -> DataFrame:
    """(doc, partners, shared): for each document how many others share terms with it, and the sum of the weights of these edges."""
    return shared_counts(r, "doc", "term").withColumnRenamed("item", "doc")


def neighbours(r: DataFrame, term) -> DataFrame:
    """(term, shared): terms in the chapters of one term."""
    own = r.where(F.col("term") == term).select("chapter")
    return r.join(own, "chapter", "left_semi").where(F.col("term") != term).groupBy("term").agg(F.count(F.lit(1)).alias("shared"))


def neighbours_of(r: DataFrame, terms: DataFrame, n: int = 12) -> DataFrame:
    """(hit, term, shared, rank): for each of terms the n terms that share most chapters with it, ties by term."""
    p = parts(r.count())
    own = r.select("chapter", "term").repartition(p, "term").join(terms.select("term").repartition(p, "term"), "term", "left_semi").select("chapter", F.col("term").alias("hit"))
    near = r.select("chapter", "term").repartition(p, "chapter").join(own.repartition(p, "chapter"), "chapter").where("term <> hit").repartition(p, "hit").groupBy("hit", "term").agg(F.count(F.lit(1)).alias("shared"))
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("hit").orderBy(F.desc("shared"), "term"))).where(F.col("rank") <= n)


def strongest(edges: DataFrame, n: int, most: int | None = None) -> DataFrame:
    """The n strongest edges of either end, each edge once. most: how many edges there may be; else they are counted first (write them, if they cost much)."""
    p = parts(2 * (edges.count() if most is None else most))
    ends = edges.select(F.explode(F.array("source", "target")).alias("end_"), "source", "target", "weight").repartition(p, "end_")
    w = Window.partitionBy("end_").orderBy(F.col("weight").desc(), "source", "target")
    return ends.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).repartition(p, "source", "target").groupBy("source", "target").agg(F.max("weight").alias("weight"))


def keyword_nodes(r: DataFrame, chapters: DataFrame, labels: DataFrame) -> DataFrame:
    """keyword_index with label (the term where there is none), chapters and docs in the library's order (each document once). chapters: chapter, doc, category, ord."""
    at = r.join(chapters.select("chapter", "ord"), "chapter").groupBy("term").agg(F.sort_array(F.collect_list(F.struct("ord", "chapter", "doc"))).alias("l"))  # what a node holds
    lists = at.select(F.col("term").alias("t_"), F.transform("l", lambda x: x["chapter"]).alias("chapters"), F.array_distinct(F.transform("l", lambda x: x["doc"])).alias("docs"))
    k = keyword_index(r, chapters.withColumn("chapter", F.col("chapter"))).join(lists, F.col("term") == F.col("t_")).drop("t_")
    return k.join(labels.select("term", F.col("label").alias("l_")), "term", "left").withColumn("label", F.coalesce("l_", "term")).drop("l_")


def contains(chapters: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Edges from documents to their chapters; dangling ones are left out."""
    c = chapters if docs is None else chapters.join(docs.select("doc"), "doc", "left_semi")
    return c.select(F.col("doc").cast("string").alias("source"), F.col("chapter").cast("string").alias("target"), F.lit("contains").alias("type"), F.lit(1.0).alias("weight"))


def _edge_rows(df: DataFrame, a: str, b: str, kind: str) -> DataFrame:
    return df.select(F.col(a).cast("string").alias("source"), F.col(b).cast("string").alias("target"), F.lit(kind).alias("type"), F.col("weight").cast("double").alias("weight"))


def mentions(r: DataFrame) -> DataFrame:
    """Edges from chapters to the terms that they hold."""
    return _edge_rows(r, "chapter", "term", "mentions")


def edges(r: DataFrame, chapters: DataFrame, keywords: DataFrame | None = None) -> DataFrame:
    """The four kinds of edges as rows (source, target, type, weight): contains, mentions, cooccurs, shares. Only terms among keywords count, if these are given."""
    if keywords is not None:
        r = r.join(keywords.select("term"), "term", "left_semi")
    return contains(chapters).unionByName(mentions(r)).unionByName(_edge_rows(cooccurrence(r), "source", "target", "cooccurs")).unionByName(_edge_rows(shares(r), "source", "target", "shares"))


def view_keywords(keywords: DataFrame, min_count: int = 1, most: int = 400) -> DataFrame:
    """The commonest keywords that a view shows; ties by ord."""
    return keywords.where(F.col("n_chapters") >= max(1, min_count)).orderBy(F.desc("n_chapters"), "ord").limit(min(MOST_KEYWORDS, max(10, most)))


def nodes(docs: DataFrame, chapters: DataFrame, keywords: DataFrame, include_chapters: bool = True) -> DataFrame:
    """Nodes of a view: id, kind, label, category, size, n. Sizes: documents 8 and a chapter each up to 12, chapters 3, keywords 1.5 and a chapter each up to 10."""
    n = chapters.groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    d = docs.join(n, "doc", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = d.select(F.col("doc").cast("string").alias("id"), F.lit("document").alias("kind"), F.col("title").alias("label"), "category", (8 + F.least(F.lit(12), F.col("n"))).cast("double").alias("size"), "n")
    if include_chapters:
        out = out.unionByName(chapters.select(F.col("chapter").cast("string").alias("id"), F.lit("chapter").alias("kind"), F.col("title").alias("label"), "category", F.lit(3.0).alias("size")), allowMissingColumns=True)
    return out.unionByName(keywords.select(F.col("term").cast("string").alias("id"), F.lit("keyword").alias("kind"), "label", "category", (1.5 + F.least(F.lit(10), F.col("n_chapters"))).cast("double").alias("size"), F.col("n_chapters").alias("n")))


def view_edges(r: DataFrame, chapters: DataFrame, kept: DataFrame) -> DataFrame:
    """What a view's links read of edges: co-occurrences of kept keywords only."""
    own = r.join(kept.select("term"), "term", "left_semi")
    return contains(chapters).unionByName(mentions(r)).unionByName(_edge_rows(cooccurrence(own), "source", "target", "cooccurs")).unionByName(_edge_rows(shares(r), "source", "target", "shares"))


def view_links(all_edges: DataFrame, chapters: DataFrame, kept: DataFrame, include_chapters: bool = True, per_keyword: int = 4) -> DataFrame:
    """Links of a view: those of kept keywords, of co-occurrences the strongest of either end, shares; without chapters, mentions go from the document. Equal links are one, with the greatest weight; shares have each two documents once already."""
    k = kept.select(F.col("term").cast("string").alias("k_"))
    of = lambda kind: all_edges.where(F.col("type") == kind)
    held = of("mentions").join(k, F.col("target") == F.col("k_"), "left_semi")
    if include_chapters:
        out = of("contains").unionByName(held)
    else:
        home = chapters.select(F.col("chapter").cast("string").alias("c_"), F.col("doc").cast("string").alias("d_"))
        out = held.join(home, F.col("source") == F.col("c_")).select(F.col("d_").alias("source"), "target", "type", "weight")
    both = of("cooccurs").join(k, F.col("source") == F.col("k_"), "left_semi").join(k, F.col("target") == F.col("k_"), "left_semi")
    co = strongest(both.select("source", "target", "weight"), per_keyword, MOST_KEYWORDS * (MOST_KEYWORDS - 1) // 2).withColumn("type", F.lit("cooccurs"))
    return merged_links(out.unionByName(co)).unionByName(of("shares").select("type", "source", "target", "weight"))


def merged_links(links: DataFrame) -> DataFrame:
    return links.groupBy("type", "source", "target").agg(F.max("weight").alias("weight"))


def adjacent(links: DataFrame, node_table: DataFrame, node: str, n: int = 24) -> DataFrame:
    """The nodes linked to one, in either direction, commonest first, n at most."""
    ends = links.where(F.col("source") == node).select(F.col("target").alias("id")).unionByName(links.where(F.col("target") == node).select(F.col("source").alias("id"))).distinct()
    return node_table.join(ends, "id", "left_semi").orderBy(F.coalesce("n", F.lit(0)).desc(), "id").limit(n)


def named(node_table: DataFrame, text: str) -> DataFrame:
    """Nodes whose label holds the text, whatever its case, and all documents."""
    return node_table.where(F.contains(F.lower("label"), F.lit(text.lower())) | (F.col("kind") == "document"))


def focused(node_table: DataFrame, text: str) -> DataFrame:
    """The first node of that id or label."""
    return node_table.where((F.col("id") == text) | (F.lower("label") == text.lower())).orderBy("kind", "id").limit(1)


def link_width(kind, weight):
    """Width of a drawn link by its kind."""
    return F.when(kind == "shares", 1 + F.least(F.lit(4.0), weight * 0.6)).when(kind == "contains", 0.8).otherwise(0.3 + F.least(F.lit(1.5), weight * 0.4))


def labels_of(terms: DataFrame, keywords: DataFrame, term: str = "term") -> DataFrame:
    """terms with label, the term itself where keywords has none."""
    return terms.join(keywords.select(F.col("term").alias("t_"), F.col("label").alias("l_")), F.col(term) == F.col("t_"), "left").withColumn("label", F.coalesce("l_", term)).drop("t_", "l_")


def stats(**tables: DataFrame) -> DataFrame:
    """One row: the number of rows of each table."""
    out = None
    for name, t in tables.items():
        n = t.agg(F.count(F.lit(1)).alias(name))
        out = n if out is None else out.crossJoin(n)  # one row each
    return out


def best_refs(r: DataFrame) -> DataFrame:
    """Of each chapter's mentions, one a term with its greatest weight, heaviest first: chapter, rank, term, weight. Empty terms are left out."""
    one = r.where("term <> ''").groupBy("chapter", "term").agg(F.max("weight").alias("weight"))
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("chapter").orderBy(F.desc("weight"), "term")))


def apply_merges(r: DataFrame, merges: DataFrame, hops: int = 5) -> DataFrame:
    """refs with each term replaced by what merges (from_term, to_term) lead to, hops steps at most, then one a chapter by its greatest weight."""
    m = merges.groupBy(F.col("from_term").alias("f_")).agg(F.max("to_term").alias("t_"))
    for _ in range(hops):
        r = r.join(m, F.col("term") == F.col("f_"), "left").withColumn("term", F.coalesce("t_", "term")).drop("f_", "t_")
    return refs(r)


def known_terms(r: DataFrame, doc, most: int = 300) -> DataFrame:
    """The commonest terms of other documents, which a new document's terms may be merged into: term, n."""
    n = r.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("doc") != doc).alias("other"))
    return n.where("other").select("term", "n").orderBy(F.desc("n"), "term").limit(most)


def repeated_terms(r: DataFrame, doc, least: int = 2) -> DataFrame:
    """Terms of a document in two chapters or more: term, n."""
    return r.where(F.col("doc") == doc).groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def new_terms(r: DataFrame, known: DataFrame, doc) -> DataFrame:
    return r.where(F.col("doc") == doc).select("term").distinct().join(known.select("term"), "term", "left_anti")


def document_keywords(r: DataFrame, picked: DataFrame, labels: DataFrame, n: int = 8) -> DataFrame:
    """For each document its keywords: those that a summary picked (doc, label, ord) and the document holds, then its heaviest, n in all: doc, rank, term."""
    p = parts(r.count())
    own = r.repartition(p, "doc").groupBy("doc", "term").agg(F.sum("weight").alias("w"))
    low = labels.select(F.lower("label").alias("l_"), F.col("term").alias("lt_")).groupBy("l_").agg(F.max("lt_").alias("lt_"))
    chosen = picked.join(low, F.lower("label") == F.col("l_"), "left").select("doc", F.coalesce("lt_", F.lower("label")).alias("term"), F.col("ord").cast("double").alias("at_"))
    rest = own.select("doc", "term", (-F.col("w")).alias("at_"), F.lit(1).alias("first_"))
    # What the document doesn't hold has no row of rest.
    both = chosen.withColumn("first_", F.lit(0)).unionByName(rest).repartition(p, "doc").groupBy("doc", "term").agg(F.min(F.struct("first_", "at_")).alias("k_"), F.max("first_").alias("own_")).where("own_ = 1").drop("own_")
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("doc").orderBy("k_", "term"))).where(F.col("rank") <= n).select("doc", "rank", "term")


def newest(docs: DataFrame) -> DataFrame:
    """Documents, newest first by created (text), ties by doc."""
    return docs.orderBy(F.desc("created"), "doc")


def ordered_chapters(docs: DataFrame, chapters: DataFrame) -> DataFrame:
    """Chapters of each document in the order of its list (docs.chapters); ids without a chapter are left out: doc, pos, and the chapter's columns."""
    at = docs.select("doc", F.posexplode("chapters").alias("pos", "chapter"))
    return at.join(chapters.drop("doc"), "chapter").select("doc", "pos", "chapter", *(c for c in chapters.columns if c not in ("doc", "chapter")))


def beside(chapters: DataFrame) -> DataFrame:
    """chapters with the ids of those before and after, by index one less and one more in the same document."""
    w = Window.partitionBy("doc").orderBy("index")
    near = lambda f, step: F.when(f("index").over(w) == F.col("index") + step, f("chapter").over(w))
    return chapters.withColumn("previous", near(F.lag, -1)).withColumn("next", near(F.lead, 1))


def texts_of(chapters: DataFrame, texts: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """chapter and text, empty where there is none; of ids only, if given."""
    c = chapters.select("chapter") if ids is None else chapters.select("chapter").join(ids.select("chapter"), "chapter", "left_semi")
    return c.join(texts.select("chapter", "text"), "chapter", "left").withColumn("text", F.coalesce("text", F.lit("")))
