"""Notes: numbering, search, and changes that can't lose a note. A note is id, title, body, date, ord (its place in the file)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import note_title, strip
from quillgraph.operators.search import containing

SCHEMA = "id string, title string, body string, date string, ord long"


class NoteLost(Exception):
    """A change would drop notes that it may not drop."""


def assign_ids(notes: DataFrame) -> DataFrame:
    """notes with an id each: the first of equal ids stays, others and missing ones get the smallest free numbers m1, m2, ... in order. Notes of one file: one partition orders them."""
    n = notes.withColumn("id_", F.nullif(strip(F.coalesce("id", F.lit(""))), F.lit("")))
    n = n.withColumn("id_", F.when(F.row_number().over(Window.partitionBy("id_").orderBy("ord")) == 1, F.col("id_")))
    lacking = n.where("id_ is null").withColumn("k_", F.row_number().over(Window.orderBy("ord")))
    total = n.count()
    free = n.sparkSession.range(1, 2 * total + 1).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("free_"), F.col("id").alias("number_"))
    free = free.join(n.where("id_ is not null").select("id_"), F.col("free_") == F.col("id_"), "left_anti").withColumn("k_", F.row_number().over(Window.orderBy("number_")))
    given = lacking.join(free, "k_").select("ord", F.col("free_").alias("new_"))
    return n.join(given, "ord", "left").withColumn("id", F.coalesce("id_", "new_")).select("id", "title", "body", "date", "ord")


def next_number(notes: DataFrame, used: int = 0) -> int:
    """The number after the greatest one in use, now or before; numbers are never used twice."""
    top = notes.agg(F.max(F.regexp_extract("id", "^m([0-9]+)$", 1).try_cast("long"))).first()[0]  # one row
    return max(top or 0, used) + 1


def search(notes: DataFrame, text: str = "") -> DataFrame:
    """The note of that id if there is one, else notes that hold any of the words, case counts, in title or body; all of them for no words."""
    key, words = text.strip(), text.split()
    if not words:
        return notes
    hay = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("body", F.lit("")))
    found = notes.where((F.col("id") == key) | reduce(or_, [F.contains(hay, F.lit(w)) for w in words])).withColumn("exact_", F.col("id") == key)
    any_exact = F.broadcast(found.agg(F.coalesce(F.bool_or("exact_"), F.lit(False)).alias("any_")))  # one row
    return found.crossJoin(any_exact).where(F.col("exact_") | ~F.col("any_")).select(*notes.columns)


def search_each(notes: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id and the columns of notes: search for each query (query_id, text) that has a word. Words are looked up by an index of grams."""
    q = queries.select("query_id", strip(F.coalesce("text", F.lit(""))).alias("key"))
    words = q.select("query_id", F.explode(F.array_distinct(F.split("key", r"(?U)\s+"))).alias("needle")).where("needle <> ''")
    hay = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("body", F.lit("")))
    held = containing(words.select("needle").distinct(), notes.select("id", hay.alias("s")))
    # Notes are merged by id, and not sent whole to the tasks, however small their files are.
    exact = q.join(notes.select("id").hint("merge"), F.col("key") == F.col("id")).select("query_id", "id")
    found = words.join(held, "needle").select("query_id", "id").distinct().join(exact.select("query_id").distinct(), "query_id", "left_anti")
    return exact.unionByName(found).join(notes.hint("merge"), "id").select("query_id", *notes.columns)


def lost(previous: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Keys that new lacks."""
    return previous.select(key).exceptAll(new.select(key)) if key == "id" else previous.select(key).subtract(new.select(key))


def guarded(previous: DataFrame, new: DataFrame, deleting: str | None = None) -> DataFrame:
    """new, if it holds every id of previous, or all but exactly the one to be deleted; else NoteLost."""
    gone = sorted(r[0] for r in lost(previous, new).limit(21).collect())  # to name them in the error
    if gone != ([] if deleting is None else [deleting]):
        raise NoteLost(f"notes that would be lost: {', '.join(gone) or 'none'}; to be deleted: {deleting or 'none'}")
    return new


def append(notes: DataFrame, text: str, used: int = 0) -> DataFrame:
    """notes and one more, its title the first line's start."""
    body = text.strip()
    if not body:
        raise ValueError("a note needs a text")
    last = notes.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("o_"))
    one = last.select(F.lit(f"m{next_number(notes, used)}").alias("id"), note_title(F.lit(body)).alias("title"), F.lit(body).alias("body"), F.lit("").alias("date"), (F.col("o_") + 1).alias("ord"))
    return guarded(notes, notes.unionByName(one))


def _known(notes: DataFrame, note_id: str) -> str:
    key = (note_id or "").strip()
    if not key:
        raise ValueError("a note's id is needed")
    if notes.where(F.col("id") == key).isEmpty():
        ids = [r[0] for r in notes.orderBy("ord").select("id").limit(100).collect()]
        raise KeyError(f"no note {key}; there are {', '.join(ids)}")
    return key


def update(notes: DataFrame, note_id: str, text: str) -> DataFrame:
    """notes with one's text and title changed; its id, date and place stay."""
    body = text.strip()
    if not body:
        raise ValueError("a note needs a text")
    hit = F.col("id") == _known(notes, note_id)
    return guarded(notes, notes.withColumns({"title": F.when(hit, note_title(F.lit(body))).otherwise(F.col("title")), "body": F.when(hit, F.lit(body)).otherwise(F.col("body"))}))


def delete(notes: DataFrame, note_id: str) -> DataFrame:
    """notes without one."""
    key = _known(notes, note_id)
    return guarded(notes, notes.where(F.col("id") != key), deleting=key)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The notes of a JSON file, numbered. An error where it is no list of objects."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("a"))
    items = raw.select(F.posexplode("a").alias("ord", "item"))
    if raw.where("a is null").count() or items.where(~F.coalesce(F.ltrim("item").startswith("{"), F.lit(False))).count():
        raise ValueError(f"no list of notes: {path}")
    fields = "id string, title string, body string, date string"
    return assign_ids(items.select(F.from_json("item", fields).alias("n"), F.col("ord").cast("long").alias("ord")).select("n.*", "ord"))


def read_or_none(spark: SparkSession, path: str) -> DataFrame:
    """As read; no notes where the file is missing or no list of notes."""
    from pyspark.errors import PySparkException

    try:
        notes = read(spark, path)
        notes.isEmpty()
        return notes
    except (ValueError, PySparkException):
        return spark.createDataFrame([], SCHEMA)


def as_json(notes: DataFrame) -> DataFrame:
    """One row: the notes as a JSON list in order, what a file of notes holds."""
    item = F.struct("id", "title", "body", "date")
    return notes.agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("ord", item.alias("n")))), lambda x: x["n"])).alias("json"))  # a file's notes


def write(notes: DataFrame, path: str) -> None:
    """notes as a file, in one step."""
    from quillgraph.sources.sinks import put_file

    put_file(notes.sparkSession, path, as_json(notes).first()["json"])  # a file's notes


def reset(spark: SparkSession, path: str, seed: str) -> DataFrame:
    """The file's notes put back to those of the seed file, numbered; gives them."""
    notes = read(spark, seed)
    write(notes, path)
    return notes
