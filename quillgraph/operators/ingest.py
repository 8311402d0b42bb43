"""From positioned runs to a library of documents, chapters, keywords and edges that is kept up by differences.

structured() composes the parts of page structure: lines, running headers and page numbers off, paragraphs, title, headings, chapters. Library keeps tables of what comes out, each in buckets of its key, under one set of versions: an ingest finds what its documents had before, what terms and partners
are touched, and rewrites the touched buckets of each table in one commit. Keywords are counted anew for touched terms only; co-occurrences change by the pairs of old and new chapters of these documents; shares are paired anew between these documents and those that hold one
of their terms. After any order of ingests the tables equal those of one ingest of what is there.

A document is named by the slug of its title, so one of the same title replaces it; of two in one ingest the one of the greatest source name stays. The library's order, which decides ties, is by document and chapter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.operators import graph as G
from quillgraph.operators import layout as L
from quillgraph.operators import search, structure
from quillgraph.operators.retrieval import majority
from quillgraph.sources.sinks import chapter_file
from quillgraph.sources.versions import Versions

RUNS = "doc string, page int, run_no int, str string, x double, right double, y double, font_size double, bold boolean, width double, height double"
META = "doc string, meta_title string, fallback string, pages int"
MOST_CHAPTERS = 60


def structured(runs: DataFrame, meta: DataFrame, most: int = MOST_CHAPTERS, picked: DataFrame | None = None, keep=lambda df: df) -> DataFrame:
    """Chapters of documents (structure.CHAPTERS, and doc_title). meta: META, a row for each document; picked: headings that a model chose, if any; keep: what writes lines and paragraphs, each read many times, and gives the table of what it wrote."""
    l = keep(structure.lines(runs))
    edge = (F.col("y") > F.col("height") * 0.9) | (F.col("y") < F.col("height") * 0.09)
    key = X.repeat_key(F.col("text"))
    l = keep(structure.without_running(l, L.repeated_keys(l.where(edge).select("doc", "page", key.alias("key")), pages=meta), key))
    body = keep(L.body_size(l.withColumn("at_", F.col("page").cast("long") * 1_000_000 + F.col("line_no")), text="text", order="at_"))
    paras = keep(structure.paragraphs(l, body))
    titles = keep(structure.title(l.where("page = 1"), body, meta))
    chosen = keep(structure.select_headings(structure.heading_candidates(paras, body), picked))
    parted = structure.chapters_by_headings(paras, chosen, body, titles)
    rest = structure.chapters_by_pages(paras.join(chosen.select("doc").distinct(), "doc", "left_anti"), meta)
    return structure.fold_chapters(parted.unionByName(rest), most).join(titles.select("doc", F.col("title").alias("doc_title")), "doc")


SCHEMAS = {
    "documents": "doc string, title string, source_file string, pages int, category string, summary string, keywords array<string>, chapters array<string>",
    "chapters": "chapter string, doc string, index int, title string, path string, pages array<int>, chars int, summary string, category string, text string",
    "refs": "doc string, chapter string, term string, label string, weight double, pos int",
    "keywords": "term string, label string, category string, n_chapters long, ord string",
    "contains": "source string, target string, type string, weight double, doc string",
    "mentions": "source string, target string, type string, weight double, doc string",
    "cooccurs": "source string, target string, type string, weight double",
    "shares": "source string, target string, type string, weight double",
}
KEYS = {"documents": "doc", "chapters": "doc", "refs": "doc", "keywords": "term", "contains": "doc", "mentions": "doc", "cooccurs": "source", "shares": "source"}


class Library:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.tables, self.buckets = spark, Versions(spark, path), buckets

    def _bucket(self, key: str):
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def read(self, name: str, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """A table, or some of its buckets."""
        return self.tables.read_buckets(name, SCHEMAS[name], only, version)

    def edges(self) -> DataFrame:
        """The four kinds of edges as rows."""
        out = None
        for name in ("contains", "mentions", "cooccurs", "shares"):
            e = self.read(name).select("source", "target", "type", "weight")
            out = e if out is None else out.unionByName(e)
        return out

    def _buckets(self, keys: DataFrame, column: str) -> list[int]:
        """The buckets that keys fall in."""
        return sorted(r[0] for r in keys.where(F.col(column).isNotNull()).select(self._bucket(column)).distinct().collect())

    def _rewritten(self, name: str, version: int, touched: list[int], kept, new: DataFrame) -> dict[str, list[str]]:
        """Buckets of a table: what kept, a function of the rows, leaves of them, and the new ones."""
        if not touched:
            return {}
        old = kept(self.read(name, version, touched)).select(*new.columns)
        folders = self.tables.stage_in_buckets(old.unionByName(new), self._bucket(KEYS[name]), KEYS[name])
        return {f"{name}/{b:03d}": [folders[b]] if b in folders else [] for b in touched}

    def ingest(self, runs: DataFrame, meta: DataFrame, merges: DataFrame | None = None, batch: tuple[str, int] | None = None, keywords=None) -> int:
        """Add documents, or put them in place of those of the same slug; gives the version. merges: what terms (from_term) a model would have as others (to_term). batch: a stream's name and number of the batch, done once. keywords: what finds a chapter's
        keywords, in place of its commonest words."""
        if self._done(batch):
            return self.tables.current()[0]
        chapters = structured(runs, meta, keep=lambda df: self.spark.read.schema(df.schema).parquet(f"{self.tables.path}/{self.tables.stage(df)}"))
        slug = X.slugify(F.coalesce("doc_title", "fallback"))
        c = chapters.join(meta.select("doc", "fallback", F.col("pages").alias("n_pages")), "doc").withColumn("slug", slug)
        c = c.withColumn("last_", F.max("doc").over(Window.partitionBy("slug"))).where("doc = last_")
        text = F.array_join(F.transform("paragraphs", lambda p: F.when(p["heading"].isNotNull(), F.concat(F.lit("["), p["text"], F.lit("]"))).otherwise(p["text"])), "\n\n")
        summary = F.substring(F.coalesce(F.get(F.filter("paragraphs", lambda p: p["heading"].isNull()), F.lit(0))["text"], F.lit("")), 1, 200)
        c = c.select(
            X.chapter_id(F.col("slug"), F.col("chapter_no")).alias("chapter"), F.col("slug").alias("doc"), F.col("chapter_no").alias("index"), "title", F.concat("slug", F.lit("/"), chapter_file(F.col("chapter_no"), F.col("title"))).alias("path"),
            F.array("first_page", "last_page").alias("pages"), "chars", summary.alias("summary"), F.lit("misc").alias("category"), text.alias("text"), "doc_title", "fallback", "n_pages",
        )
        # Structure is worked out once; all else reads it.
        new = self.tables.staged(self.tables.stage(c), f"{SCHEMAS['chapters']}, doc_title string, fallback string, n_pages int")
        changed = self.tables.staged(self.tables.stage(new.select("doc").distinct()), "doc string")
        return self._replace(changed, new, merges, batch, keywords)

    def _done(self, batch: tuple[str, int] | None) -> bool:
        return batch is not None and int((self.tables.current()[1].get(f"stream/{batch[0]}") or ["-1"])[0]) >= batch[1]

    def delete(self, docs: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Take documents (doc) out of every table; gives the version."""
        none = self.spark.createDataFrame([], f"{SCHEMAS['chapters']}, doc_title string, fallback string, n_pages int")
        return self._replace(docs.select("doc").distinct(), none, None, batch, None)

    def _replace(self, changed: DataFrame, new: DataFrame, merges, batch, keywords) -> int:
        base, _ = self.tables.current()
        if self._done(batch):
            return base
        mine = lambda rows, column="doc": rows.join(changed.select(F.col("doc").alias("c_")), F.col(column) == F.col("c_"), "left_semi")
        others = lambda rows, column="doc": rows.join(changed.select(F.col("doc").alias("c_")), F.col(column) == F.col("c_"), "left_anti")
        out: dict[str, list[str]] = {}
        again = lambda rows, schema: self.tables.staged(self.tables.stage(rows), schema)  # noqa: E731  worked out once, read several times
        own = self._buckets(changed, "doc")
        # Refs of the new chapters, and of the old.
        found = (keywords or search.frequency_keywords)(new.withColumn("ord", F.col("chapter")))
        fresh = new.select("chapter", "doc").join(found, "chapter").select("doc", "chapter", "term", "label", "weight", "pos")
        if merges is not None:
            m = G.apply_merges(fresh.select("doc", "chapter", "term", "weight"), merges).withColumn("pos", F.row_number().over(Window.partitionBy("chapter").orderBy(F.desc("weight"), "term")))
            names = fresh.groupBy("term").agg(F.min_by("label", F.struct("chapter", "pos")).alias("label"))
            fresh = m.join(names, "term", "left").select("doc", "chapter", "term", F.coalesce("label", "term").alias("label"), "weight", "pos")
        fresh = again(fresh, SCHEMAS["refs"])
        old = mine(self.read("refs", base, own))
        out |= self._rewritten("chapters", base, own, others, new.select(*(n.split()[0] for n in SCHEMAS["chapters"].split(", "))))
        out |= self._rewritten("refs", base, own, others, fresh)
        # Documents.
        weights = fresh.groupBy("doc", "term").agg(F.round(F.sum("weight"), 6).alias("w"), F.min(F.struct("chapter", "pos")).alias("f"))
        top = weights.withColumn("k", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("w"), "f"))).where("k <= 8").groupBy("doc").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "term"))), lambda x: x["term"]).alias("keywords"))
        heads = new.groupBy("doc").agg(F.max("doc_title").alias("title"), F.max("fallback").alias("source_file"), F.max("n_pages").alias("pages"), F.min_by("summary", "index").alias("summary"), F.transform(F.sort_array(F.collect_list(F.struct("index", "chapter"))), lambda x: x["chapter"]).alias("chapters"))
        docs = heads.join(top, "doc", "left").join(majority(new, "doc", "category", "index"), "doc").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))
        out |= self._rewritten("documents", base, own, others, docs.select(*(n.split()[0] for n in SCHEMAS["documents"].split(", "))))
        # Keywords of touched terms, counted over all refs.
        terms = again(old.select("term").union(fresh.select("term")).distinct(), "term string")
        touched = again(self._touched(base, terms, changed).unionByName(fresh), SCHEMAS["refs"])
        categories = others(self.read("chapters", base)).select("chapter", "category").join(touched.select("chapter"), "chapter", "left_semi").unionByName(new.select("chapter", "category"))
        table = _keywords(touched, categories)
        without = lambda rows, column="term": rows.join(terms.select(F.col("term").alias("t_")), F.col(column) == F.col("t_"), "left_anti")
        out |= self._rewritten("keywords", base, self._buckets(terms, "term"), without, table)
        # Edges.
        out |= self._rewritten("contains", base, own, others, G.contains(new).withColumn("doc", F.col("source")))
        out |= self._rewritten("mentions", base, own, others, fresh.select(F.col("chapter").alias("source"), F.col("term").alias("target"), F.lit("mentions").alias("type"), "weight", "doc"))
        delta = G.cooccurrence(fresh).withColumn("s", F.lit(1)).unionByName(G.cooccurrence(old).withColumn("s", F.lit(-1))).groupBy("source", "target").agg(F.sum(F.col("weight") * F.col("s")).alias("d_")).where("d_ <> 0")
        delta = again(delta, "source string, target string, d_ long")
        ends = self._buckets(delta, "source")
        changed_pairs = lambda rows: rows.join(delta.select("source", "target"), ["source", "target"], "left_anti")
        before = self.read("cooccurs", base, ends).select("source", "target", F.col("weight").alias("w_"))
        pairs = delta.join(before, ["source", "target"], "left").withColumn("weight", (F.coalesce("w_", F.lit(0.0)) + F.col("d_")).cast("double")).where("weight > 0").select("source", "target", F.lit("cooccurs").alias("type"), "weight")
        out |= self._rewritten("cooccurs", base, ends, changed_pairs, pairs)
        mine_now, theirs = fresh.select("doc", "term").distinct(), touched.select("doc", "term").distinct()
        met = mine_now.select(F.col("doc").alias("a"), "term").join(theirs.select(F.col("doc").alias("b"), "term"), "term").where("a <> b").groupBy(F.least("a", "b").alias("source"), F.greatest("a", "b").alias("target"), (F.col("a") < F.col("b")).alias("way")).agg(F.count(F.lit(1)).alias("n"))
        # A pair of two changed documents is met from either end.
        shares = met.groupBy("source", "target").agg(F.max("n").cast("double").alias("weight")).select("source", "target", F.lit("shares").alias("type"), "weight")
        partners = changed.select("doc").union(touched.select("doc")).distinct()
        out |= self._rewritten("shares", base, self._buckets(partners, "doc"), lambda rows: others(others(rows, "source"), "target"), shares)
        if batch:
            out[f"stream/{batch[0]}"] = [str(batch[1])]
        return self.tables.commit(replace=out, base=base)

    def _touched(self, base: int, terms: DataFrame, changed: DataFrame) -> DataFrame:
        """Refs of other documents to touched terms."""
        kept = self.read("refs", base).join(changed.select(F.col("doc").alias("c_")), F.col("doc") == F.col("c_"), "left_anti")
        return kept.join(terms, "term", "left_semi").select("doc", "chapter", "term", "label", "weight", "pos")

    def follow(self, runs: DataFrame, meta: DataFrame, checkpoint: str, name: str = "ingest"):
        """Ingest a stream of runs as it comes, batch by batch, each once even if it is tried again; all runs of a document come in one batch (a file holds whole documents). Gives the started query's writer; meta is a table that has the documents' rows."""

        def one(batch: DataFrame, number: int) -> None:
            batch.persist()
            try:
                own = meta.join(batch.select("doc").distinct(), "doc", "left_semi")
                self.ingest(batch, own, batch=(name, number))
            finally:
                batch.unpersist()

        return runs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).queryName(name)


def _keywords(refs: DataFrame, categories: DataFrame) -> DataFrame:
    """Keywords of refs: label and order of the first chapter by name, category by majority."""
    r = refs.join(categories, "chapter")
    k = refs.groupBy("term").agg(F.min_by("label", F.struct("chapter", "pos")).alias("label"), F.count(F.lit(1)).alias("n_chapters"), F.min(F.struct("chapter", "pos")).alias("o"))
    m = r.groupBy("term", "category").agg(F.count(F.lit(1)).alias("n"), F.min("chapter").alias("first"))
    w = Window.partitionBy("term").orderBy(F.desc("n"), "first")
    m = m.withColumn("k", F.row_number().over(w)).where("k = 1").select("term", "category")
    return k.join(m, "term").select("term", "label", "category", "n_chapters", F.concat("o.chapter", F.lit("#"), F.col("o.pos").cast("string")).alias("ord"))
