"""Folders of text files as tables: Markdown with front matter, plain documents, data sheets. A file is a row; names are matched when the folder is listed, so other files aren't read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a data sheet may be, the characters of it that are shown, and those of a title.
SHEETS = ("csv", "txt", "json")
SHEET_CHARS = 6000
TITLE_CHARS = 80


def whole_files(spark: SparkSession, folder: str, endings) -> DataFrame:
    """name and text (line ends as \\n, no byte order mark) of the files of a folder with one of the endings; no rows where there is none. Spark's listing leaves out files of no bytes."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(endings) + "}").load(folder)
    text = F.regexp_replace(F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", ""), "\r\n?", "\n")
    return raw.select(F.url_decode(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\+", "%2B")).alias("name"), text.alias("text"))


def _plain(value: Column) -> Column:
    """A JSON string without its quotes, other JSON as it is written, and what isn't JSON as it is."""
    return F.coalesce(F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>")[0], value)


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """name, meta (map of the front matter; of equal keys the last one) and body of a folder's Markdown files. Lines without a key before a colon are no entries; a file without front matter is all body."""
    front = r"(?s)\A---\n(.*?)\n---[ \t]*(?:\n|\z)"
    files = whole_files(spark, folder, ["md"])
    lines = F.filter(F.split(F.regexp_extract("text", front, 1), "\n"), lambda x: F.instr(x, ":") > 1)
    entries = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.regexp_replace(x, r"\A[^:]*:", "")).alias("value")))
    entries = F.transform(entries, lambda x: F.struct(x["key"].alias("key"), _plain(x["value"]).alias("value")))
    meta = F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["key"]), F.create_map(x["key"], x["value"])))
    return files.select("name", meta.alias("meta"), F.regexp_replace("text", front, "").alias("body"))


def local_docs(spark: SparkSession, folder: str) -> DataFrame:
    """name, title (first line that isn't blank, without hashes and blanks around it) and text of a folder's .md and .txt files; the name is the title of a blank file."""
    first = F.regexp_extract("text", r"(?m)^[^\n]*\S[^\n]*$", 0)
    title = F.substring(F.regexp_replace(first, r"\A[# \t]+|[# \t]+\z", ""), 1, TITLE_CHARS)
    return whole_files(spark, folder, ["md", "txt"]).select("name", F.when(title == "", F.col("name")).otherwise(title).alias("title"), "text")


def sheets(spark: SparkSession, folder: str, chars: int | None = SHEET_CHARS) -> DataFrame:
    """name, text (its first chars characters; all of it with None), n_chars of the whole, and whether it was cut."""
    text = F.col("text") if chars is None else F.substring("text", 1, chars)
    return whole_files(spark, folder, SHEETS).select("name", text.alias("text"), F.length("text").alias("n_chars"), (F.length("text") > F.length(text)).alias("cut"))
