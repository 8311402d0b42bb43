"""Quality rules: a table of thresholds compiled into Spark expressions, evaluated without user functions.

Words are stretches of anything but space and TAB to CR; lines end at a line feed. All ratios come from arrays within the row, so nothing is shuffled. Three-word windows are told apart by 64-bit
hashes of their words; only texts in which two windows agree are sorted by window, to find which words they cover.

Null texts have no words and fail the base rule, as empty ones do. Rows that repeat keep a row each; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WS = r"[\x20\x09-\x0D]"
_TRIM = " \t\n\x0b\x0c\r"

#: Common function words of the languages at hand.
STOP_WORDS = (
    "the be to of and that have with in is it for on as was by this at or an are "
    "le la les de des du et en un une que qui dans pour est "
    "der die das und zu den von mit ein eine ist nicht auf "
    "el los las del y se por con para es su"
).split()

#: name: (numerator, denominator, least, most); a text is kept if all ratios lie within. Ratios with denominator 0 hold.
RULES = {
    "mean_word_length": ("word_chars", "n_words", 2.0, 14.0),
    "symbols_per_word": ("n_symbols", "n_words", 0.0, 0.1),
    "stop_word_share": ("n_stop_words", "n_words", 0.01, 1.0),
    "duplicate_lines": ("n_dup_lines", "n_lines", 0.0, 0.5),
    "upper_share": ("n_upper", "word_chars", 0.0, 0.5),
}
LEAST_WORDS, MOST_REPEATED = 50, 50


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of keep, and the counts that the rules use."""
    t = docs.select(*keep, F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    # Each projection names what later ones use more than once.
    trimmed = F.expr(f"trim(BOTH '{_TRIM}' FROM _t)")
    w = t.select(*keep, "doc_id", "_t", trimmed.alias("_s")).select(*keep, "doc_id", "_t", F.when(F.col("_s") == "", F.array().cast("array<string>")).otherwise(F.split("_s", WS + "+")).alias("_w"))
    w = w.select(
        *keep, "doc_id", "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.array_join("_w", "").alias("_j"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"),
        F.when(F.size("_w") >= 3, F.expr("transform(slice(_w, 1, size(_w) - 2), (x, i) -> xxhash64(x, get(_w, i + 1), get(_w, i + 2)))")).otherwise(F.array().cast("array<bigint>")).alias("_h"),
    )
    w = w.select(
        *keep, "doc_id", "n_words",
        F.length("_j").cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_j", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("_j", r"[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.size(F.filter("_w", lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.expr("array_sort(transform(_h, (h, i) -> struct(h, i)))")).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("_o"),
    )
    met = "filter(_o, (x, j) -> coalesce(get(_o, j - 1).h = x.h, false) or coalesce(get(_o, j + 1).h = x.h, false))"
    return w.withColumn("n_repeat_words", F.expr(f"cast(size(array_distinct(flatten(transform({met}, x -> array(x.i, x.i + 1, x.i + 2))))) as bigint)")).drop("_o")


def verdict(rules=RULES):
    """The table as one expression over the counts."""
    ok = F.lit(True)
    for over, under, least, most in rules.values():
        ok = ok & (F.col(under).eqNullSafe(0) | (F.col(over) / F.nullif(F.col(under), F.lit(0))).between(least, most))
    return ok


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each row of docs: doc_id, the counts, base_failed, kept."""
    c = counted(docs, id_col, text_col, keep)
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return c.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    ok = " and ".join(f"(u.{b} = 0 or u.{a}::double / u.{b} between {lo} and {hi})" for a, b, lo, hi in RULES.values())
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
w as (select rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
win as (select rid, i, count(*) over (partition by rid, w[i], w[i + 1], w[i + 2]) as c from (select rid, w, unnest(range(1, len(w) - 1)) as i from w)),
rep as (select rid, count(distinct p) as n from (select rid, unnest([i, i + 1, i + 2]) as p from win where c > 1) group by rid),
u as (select w.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, length(regexp_replace(t, '[^A-Z]+', '', 'g'))::bigint as n_upper,
  len(list_filter(w, lambda x: lower(x) in ({stop})))::bigint as n_stop_words, len(l)::bigint as n_lines,
  (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words
  from w left join rep using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words as base_failed,
  not (n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words) and {ok} as kept
from u
"""


SQL = _sql()
