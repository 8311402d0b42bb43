"""Tables and texts written in place of what was there: first beside it, then moved. And the store, the graph, uploads and listings as tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.text import slugify
from quillgraph.operators import graph, store
from quillgraph.sources.versions import Versions

MOST_BYTES = 2 * 1024 * 1024
GRAPH = {
    "documents": "doc string, title string, source_file string, pages int, category string, summary string, keywords array<string>, chapters array<string>, created string",
    "chapters": "chapter string, doc string, index int, title string, path string, pages array<int>, chars int, summary string, category string, keywords array<struct<term:string,weight:double>>",
    "keywords": "term string, label string, category string, chapters array<string>, docs array<string>, n_chapters int",
    "edges": "source string, target string, type string, weight double",
}


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def settle(spark: SparkSession, path: str) -> None:
    """End a move that failed half way: if there is no table at path, the one that was put aside comes back."""
    fs, to = _fs(spark, path)
    _, aside = _fs(spark, f"{path}.old")
    if not fs.exists(to) and fs.exists(aside):
        _rename(spark, f"{path}.old", path)


def _rename(spark: SparkSession, source: str, target: str) -> None:
    fs, a = _fs(spark, source)
    _, b = _fs(spark, target)
    if not fs.rename(a, b):
        raise OSError(f"can't move {source} to {target}")


def put(df: DataFrame, path: str, form: str = "parquet", by: str | None = None) -> None:
    """df as the table at path, in place of one that was there, from which df may be computed. It is written beside it; the old one is put aside, the new one moved, the old one deleted. A failure before the last move leaves the old table, there or aside, where settle finds it; all
    readers here settle first. For tables that change together, or that have readers elsewhere, use versions.Versions."""
    spark, fresh = df.sparkSession, f"{path}.new-{uuid.uuid4().hex}"
    settle(spark, path)
    (df.write.partitionBy(by) if by else df.write).format(form).save(fresh)
    fs, to = _fs(spark, path)
    _, aside = _fs(spark, f"{path}.old")
    fs.delete(aside, True)
    if fs.exists(to):
        _rename(spark, path, f"{path}.old")
    _rename(spark, fresh, path)
    fs.delete(aside, True)


def put_file(spark: SparkSession, path: str, text: str) -> None:
    """A small file of text, in one step: written beside it and moved over it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder, _, name = path.rpartition("/")
    fresh = f"{folder}/.{name}.new-{uuid.uuid4().hex}"
    fs, p = _fs(spark, fresh)
    out = fs.create(p, False)
    out.write(bytearray(text.encode()))
    out.close()
    _, to = _fs(spark, path)
    kind = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    over = jvm.java.lang.reflect.Array.newInstance(kind, 1)
    over[0] = kind.getEnumConstants()[1]
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), conf).rename(p, to, over)


def delete_file(spark: SparkSession, path: str) -> bool:
    """Delete a file; whether it was there."""
    fs, p = _fs(spark, path)
    return fs.delete(p, False)


def put_texts(texts: DataFrame, folder: str) -> None:
    """Texts (name, text) as a folder a name."""
    put(texts.select("name", "text"), folder, "text", "name")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    settle(spark, path)
    return spark.read.schema(store.SCHEMA).parquet(path) if exists(spark, path) else store.empty(spark)


STAMPED = ", updated string"


def read_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The graph's tables as of its last write; empty ones for those that aren't there. Columns that a table lacks are null."""
    tables = Versions(spark, path)
    version, _ = tables.current()
    return {name: tables.read(name, schema + STAMPED, version).drop("updated") for name, schema in GRAPH.items()}


def write_graph(tables: dict[str, DataFrame], spark: SparkSession, path: str) -> int:
    """The graph's tables (documents, chapters, keywords; those left out stay) with edges computed anew from chapters and their keywords, each with the time of writing: all of them at once or none. Gives the version."""
    store_ = Versions(spark, path)
    version, _ = store_.current()
    t = {name: tables.get(name, store_.read(name, GRAPH[name], version)) for name in ("documents", "chapters", "keywords")}
    refs = t["chapters"].select("doc", "chapter", F.explode("keywords").alias("k")).select("doc", "chapter", "k.term", "k.weight")
    t["edges"] = graph.edges(graph.refs(refs), t["chapters"], t["keywords"])
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return store_.commit({name: d.withColumn("updated", now) for name, d in t.items()}, base=version)


def inside(path: Column) -> Column:
    """A path below a folder; null for one that is absolute, empty, or leaves the folder."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when((p != "") & ~p.startswith("/") & ~p.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & ~p.rlike(r"(^|/)\.\.(/|$)") & ~p.rlike(r"[\x00-\x1f]"), p)


def chapter_contents(spark: SparkSession, folder: str, chapters: DataFrame) -> DataFrame:
    """chapter and text of chapters (chapter, path below folder); empty where there is no such file, or the path leaves the folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(folder)
    root = _fs(spark, folder)[0].makeQualified(_fs(spark, folder)[1]).toUri().getPath().rstrip("/")
    at = F.url_decode(F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*(?=/)", ""), r"\+", "%2B"))
    files = raw.select(F.substring(at, len(root) + 2, 1 << 20).alias("p_"), F.decode("content", "UTF-8").alias("text"))
    c = chapters.select("chapter", inside(F.col("path")).alias("path"))
    return c.join(files, F.col("path") == F.col("p_"), "left").select("chapter", F.coalesce("text", F.lit("")).alias("text"))


def safe_name(name: Column) -> Column:
    """A file's name without folders; null for names that are none, begin with a dot or hold a control character."""
    base = F.regexp_extract(name, r"([^/\\\\]*)$", 1)
    return F.when((base != "") & ~base.startswith(".") & ~base.rlike(r"[\x00-\x1f]"), base)


def uploads(files: DataFrame, have: DataFrame, endings=("csv", "txt", "json"), replace: bool = False) -> DataFrame:
    """files (name, base64) with content (text) and fault: name, ending, base64, size (over MOST_BYTES), utf8, or exists where have (name) has it and nothing may be replaced; null where the file is to be written."""
    name = safe_name(F.col("name"))
    strict = F.col("base64").rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
    raw = F.when(strict, F.unbase64("base64"))
    f = files.select(name.alias("name"), raw.alias("raw")).join(have.select(F.col("name").alias("n_"), F.lit(True).alias("there")).distinct(), F.col("name") == F.col("n_"), "left").drop("n_")
    fault = F.when(F.col("name").isNull(), "name").when(~F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)).isin(*endings), "ending").when(F.col("raw").isNull(), "base64").when(F.octet_length("raw") > MOST_BYTES, "size").when(~F.is_valid_utf8(F.col("raw")), "utf8")
    fault = fault if replace else F.coalesce(fault, F.when(F.col("there"), "exists"))
    return f.select("name", F.when(F.is_valid_utf8(F.col("raw")), F.decode("raw", "UTF-8")).alias("content"), fault.alias("fault"))


def write_uploads(judged: DataFrame, folder: str) -> list[str]:
    """Write the files (name, content, fault of uploads) without a fault, each in one step; gives their names. One upload's files, of MOST_BYTES at most."""
    spark, names = judged.sparkSession, []
    for r in judged.where("fault is null").orderBy("name").toLocalIterator():
        put_file(spark, f"{folder.rstrip('/')}/{r['name']}", r["content"])
        names.append(r["name"])
    return names


def listing(spark: SparkSession, folder: str, endings=("pdf",), loaded: DataFrame | None = None) -> DataFrame:
    """name and bytes of a folder's files, and the chunks that a store's status (document, chunks) has of them; contents aren't read."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(endings) + "}").load(folder)
    out = raw.select(F.url_decode(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\+", "%2B")).alias("name"), F.col("length").alias("bytes"))
    return out if loaded is None else out.join(loaded.select(F.col("document").alias("name"), "chunks"), "name", "left")


def chapter_file(index: Column, title: Column) -> Column:
    """NN-slug.md."""
    short = F.regexp_replace(F.substring(slugify(title), 1, 40), "-+$", "")
    return F.concat(F.lpad(index.cast("string"), 2, "0"), F.lit("-"), short, F.lit(".md"))


def front_matter(fields: dict[str, Column]) -> Column:
    """Fields as JSON values between lines of dashes; null ones are left out."""
    value = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"(?s)^\[|\]$", "")
    lines = [F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), value(c))) for name, c in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"))


def chapter_markdown(chapters: DataFrame) -> DataFrame:
    """doc, name and text of chapters (doc, doc_title, index, title, first_page, last_page, category, summary, keywords, paragraphs of heading and text)."""
    line = lambda p: F.concat(F.when(p["heading"].isNull(), "").otherwise(F.concat(F.repeat(F.lit("#"), p["heading"]), F.lit(" "))), p["text"])
    head = front_matter({"doc": F.col("doc"), "docTitle": F.col("doc_title"), "chapter": F.col("index"), "title": F.col("title"), "pages": F.array("first_page", "last_page"), "category": F.col("category"), "summary": F.col("summary"), "keywords": F.col("keywords")})
    body = F.array_join(F.transform("paragraphs", line), "\n\n")
    return chapters.select("doc", chapter_file(F.col("index"), F.col("title")).alias("name"), F.concat(head, F.lit("\n# "), F.col("title"), F.lit("\n\n"), body, F.lit("\n")).alias("text"))


def index_markdown(docs: DataFrame, chapters: DataFrame) -> DataFrame:
    """doc and text of each document's index: front matter, title, summary, and a numbered list of its chapters (index, title, first_page, last_page)."""
    item = F.concat(F.col("index").cast("string"), F.lit(". ["), F.col("title"), F.lit("]("), chapter_file(F.col("index"), F.col("title")), F.lit(") — p."), F.col("first_page").cast("string"), F.lit("-"), F.col("last_page").cast("string"))
    lists = chapters.groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("index", item.alias("t")))), lambda x: x["t"]), "\n").alias("list"), F.count(F.lit(1)).cast("int").alias("n"))  # a document's chapters
    d = docs.join(lists, "doc", "left")
    head = front_matter({"doc": F.col("doc"), "title": F.col("title"), "source": F.col("source_file"), "pages": F.col("pages"), "chapters": F.coalesce("n", F.lit(0)), "category": F.col("category"), "keywords": F.col("keywords"), "createdAt": F.col("created")})
    return d.select("doc", F.concat(head, F.lit("\n# "), F.col("title"), F.lit("\n\n"), F.coalesce("summary", F.lit("")), F.lit("\n\n## 챕터\n\n"), F.coalesce("list", F.lit("")), F.lit("\n")).alias("text"))


def document_list(docs: DataFrame) -> DataFrame:
    """title, name and length of documents read from files."""
    return docs.select("title", "name", F.length("text").alias("n_chars"))


def names_block(docs: DataFrame, column: str = "document") -> DataFrame:
    """One row: the names of loaded documents for a prompt, a line each, or that there are none."""
    names = F.sort_array(F.collect_set(F.nullif(F.col(column), F.lit(""))))  # a store's documents
    return docs.agg(F.when(F.size(names) > 0, F.concat(F.lit("[검색 대상 문서]\n- "), F.array_join(names, "\n- "), F.lit("\n"))).otherwise("[검색 대상 문서] (아직 적재된 문서가 없습니다)\n").alias("block"))
