"""Layout statistics of pages: weighted mode of sizes, elements of sorted gaps and edges, keys that recur over pages, fonts of segments.

Values are counted before they are ordered, so what a document's window sorts is its distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nth_of(df: DataFrame, key: str, value: Column, share: float, default: float, out: str = "value") -> DataFrame:
    """Element floor(share * n), counted from 0, of each key's values in ascending order; nulls aren't values; default where a key has none. share is less than 1."""
    counts = df.groupBy(key, value.cast("double").alias("v_")).agg(F.count("*").alias("c_"))
    counts = counts.withColumn("c_", F.when(F.col("v_").isNotNull(), F.col("c_")).otherwise(0))
    upto = F.sum("c_").over(Window.partitionBy(key).orderBy("v_"))
    total = F.sum("c_").over(Window.partitionBy(key))
    picked = counts.select(key, "v_", (upto > F.floor(F.lit(share) * total)).alias("reached_"))
    return picked.groupBy(key).agg(F.coalesce(F.min(F.when(F.col("reached_"), F.col("v_"))), F.lit(default)).alias(out))


def median_gap(lines: DataFrame, key: str = "doc", gap: str = "gap") -> DataFrame:
    """Upper median of the line gaps between 0.5 and 60; 12 where there are none."""
    return nth_of(lines, key, F.when((F.col(gap) > 0.5) & (F.col(gap) < 60), F.col(gap)), 0.5, 12.0, "median_gap")


def body_size(runs: DataFrame, key: str = "doc", size: str = "font_size", text: str = "str", order: str = "run_no") -> DataFrame:
    """Size, rounded to a half, of most characters; of equal ones that which is seen first; 10 where no run has a size or a character."""
    half = F.round(F.col(size) * 2) / 2
    sizes = runs.groupBy(key, half.alias("s_")).agg(F.sum(F.length(text)).alias("w_"), F.min(order).alias("o_"))
    usable = F.col("s_").isNotNull() & (F.col("w_") > 0)
    best = F.max(F.when(usable, F.struct("w_", (-F.col("o_")).alias("o_"), "s_")))
    return sizes.groupBy(key).agg(F.coalesce(best["s_"], F.lit(10.0)).alias("body_size"))


def repeated_keys(lines: DataFrame, doc: str = "doc", page: str = "page", key: str = "key", pages: DataFrame | None = None, least: int = 3) -> DataFrame:
    """Keys of at least so many characters on at least two pages and at least two fifths of a document's pages, in documents of three pages or more. pages: doc, pages; where it isn't given, the pages among lines are all there are, so give it when lines are only those at the edges."""
    per_page = lines.select(doc, page, key).distinct()
    n = per_page.groupBy(doc).agg(F.countDistinct(page).alias("pages")) if pages is None else pages.select(doc, F.col("pages").cast("long").alias("pages"))
    keys = per_page.where(F.length(key) >= least).groupBy(doc, key).agg(F.count("*").alias("on_pages"))
    return keys.join(n, doc).where((F.col("pages") >= 3) & (F.col("on_pages") >= F.greatest(F.lit(2), F.ceil(F.lit(0.4) * F.col("pages")))))


def segment_font(runs: DataFrame, key: str = "segment", size: str = "font_size", bold: str = "bold", text: str = "str") -> DataFrame:
    """Mean size by characters, to one decimal, and whether over 60 % of the characters are bold; null and false for a segment without characters."""
    n = F.length(text)
    chars = F.sum(n)
    return runs.groupBy(key).agg(F.when(chars > 0, F.round(F.sum(F.col(size) * n) / chars, 1)).alias("size"), F.coalesce(F.sum(F.when(F.col(bold), n).otherwise(0)) > F.lit(0.6) * chars, F.lit(False)).alias("bold"))
