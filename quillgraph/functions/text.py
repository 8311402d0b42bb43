"""Text expressions: tokens, slugs, snippets, normal forms. All of them but nfc are built-in expressions, evaluated in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that never count as keywords.
STOP = ("the", "and", "of", "in", "to", "for", "with", "on", "by", "an", "a", "is", "are", "from", "that", "this")
#: Marks taken off a keyword's ends.
LEADING = r"\s\"'“”‘’`(\[{"
TRAILING = r"\s\"'“”‘’`)\]}.,;:!?"
_EDGES = r"(?U)^\s+|\s+$"


def tokens(text: Column) -> Column:
    """Lower-cased runs of a-z and 0-9 first, then two-character windows of Hangul runs; a single Hangul character stays."""
    low = F.lower(F.coalesce(text, F.lit("")))
    latin = F.regexp_extract_all(low, F.lit("([a-z0-9]+)"))
    runs = F.regexp_extract_all(low, F.lit("([가-힣]+)"))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2))))))
    return F.concat(latin, pairs)


def nfc(s: Column) -> Column:
    """Unicode normal form C, which Spark has no function for; ASCII is left as it is."""

    @F.pandas_udf("string")
    def compose(x: pd.Series) -> pd.Series:
        return x.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFC", v))

    return compose(s)


#: Characters that are in normal form C whatever stands beside them: those before combining marks, most punctuation, kana, Han and Hangul syllables.
_COMPOSED = "\\x00-\\x{2ff}\\x{2002}-\\x{2027}\\x{3041}-\\x{3096}\\x{30a1}-\\x{30fa}\\x{3400}-\\x{9fff}\\x{ac00}-\\x{d7a3}"


def composed(s: Column) -> Column:
    """nfc, where only texts that may need it leave the JVM. The test runs over a text once from its start: looking for a character that isn't in the set takes about ten times as long."""
    return F.coalesce(nfc(F.when(~s.rlike(f"\\A[{_COMPOSED}]*+\\z"), s)), s)


def strip(s: Column) -> Column:
    """Without white space, of any script, at either end."""
    return F.regexp_replace(s, _EDGES, "")


def query_tokens(q: Column) -> Column:
    """Distinct words of a normalised query in the order they are first seen, two characters at least."""
    return F.array_distinct(F.filter(F.split(normalize_keyword(composed(q)), r"[\s,;/|]+"), lambda t: F.length(t) >= 2))


def slugify(s: Column) -> Column:
    """Lower case in normal form C, no file ending, other characters to single dashes, 60 at most; short results become a name made from the hash."""
    s = composed(s)
    x = F.regexp_replace(F.lower(s), r"\.[a-z0-9]{1,5}$", "")
    x = F.regexp_replace(F.regexp_replace(x, "[^a-z0-9가-힣]+", "-"), "^-+|-+$", "")
    x = F.regexp_replace(F.substring(x, 1, 60), "^-+|-+$", "")
    return F.when(F.length(x) < 2, F.concat(F.lit("doc-"), F.substring(F.sha1(s), 1, 8))).otherwise(x)


def normalize_keyword(s: Column) -> Column:
    """A keyword's key: marks off its ends, blanks collapsed, lower case. Compose s by nfc first where it may be decomposed."""
    x = F.regexp_replace(strip(s), f"(?U)^[{LEADING}]+|[{TRAILING}]+$", "")
    return F.lower(F.regexp_replace(x, r"(?U)\s+", " "))


def truncate(s: Column, most: int) -> Column:
    """The text, or its first characters and an ellipsis, most characters in all."""
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.regexp_replace(F.substring(s, 1, most - 1), r"\s+$", ""), F.lit("…")))


def repeat_key(s: Column) -> Column:
    """A line's form for finding running headers: digits alike, blanks collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(s, "[0-9]+", "#"), r"\s+", " ")))


def occurrences(text: Column, token: Column, most: int = 10) -> Column:
    """Non-overlapping occurrences of a token, at most so many."""
    n = (F.length(text) - F.length(F.replace(text, token, F.lit("")))) / F.length(token)
    return F.least(F.lit(most), n.cast("int"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles over their common length; 0 if either has norm 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.coalesce(p * q, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def chapter_id(doc: Column, index: Column) -> Column:
    return F.concat(doc, F.lit("__c"), index.cast("string"))


def parse_chapter_id(s: Column) -> Column:
    """(doc, index) of a chapter's id; null if it is none."""
    form = r"(?s)^(.*)__c([0-9]+)$"
    return F.when(s.rlike(form), F.struct(F.regexp_extract(s, form, 1).alias("doc"), F.regexp_extract(s, form, 2).cast("long").alias("index")))


def snip(s: Column, most: int) -> Column:
    """Blanks collapsed; longer texts cut at so many characters, with an ellipsis behind a blank."""
    x = strip(F.regexp_replace(s, r"(?U)\s+", " "))
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.substring(x, 1, most), F.lit(" …")))


def shorten(s: Column, most: int = 2000) -> Column:
    """A log value, cut with an ellipsis behind a blank."""
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.substring(s, 1, most), F.lit(" …")))


def has_cjk(s: Column) -> Column:
    """Whether Hangul, kana or Han characters are in it."""
    return s.rlike("[\\u1100-\\u11ff\\u3040-\\u30ff\\u3130-\\u318f\\u3400-\\u4dbf\\u4e00-\\u9fff\\uac00-\\ud7af\\uf900-\\ufaff]")


def utf16_offset(text: Column, at: Column) -> Column:
    """An offset in code points as one in UTF-16 units."""
    before = F.substring(text, F.lit(1), at)
    return at + F.length(F.regexp_replace(before, r"[^\x{10000}-\x{10FFFF}]", ""))


def plain_body(markdown: Column) -> Column:
    """Markdown without heading markers."""
    return F.regexp_replace(markdown, r"(?m)^#{1,6}\s+", "")


def clamp(value: Column, low, high, default) -> Column:
    """A parameter as a whole number (rounded down) within bounds, however large it is; the default where it is no number."""
    n = value.try_cast("double")
    bounded = F.least(F.greatest(F.floor(F.when(F.abs(n) < 1e18, n)), F.lit(low).cast("long")), F.lit(high).cast("long"))
    return F.when(n.isNull() | F.isnan(n), F.lit(default)).when(n >= 1e18, F.lit(high)).when(n <= -1e18, F.lit(low)).otherwise(bounded)


def clamp_weight(w: Column) -> Column:
    """Within 0 and 1; a half where it isn't a finite number."""
    d = w.try_cast("double")
    bad = d.isNull() | F.isnan(d) | (F.abs(d) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.5)).otherwise(F.least(F.greatest(d, F.lit(0.0)), F.lit(1.0)))


def coerce_category(c: Column, known, other: str = "misc") -> Column:
    return F.when(c.isin(*known), c).otherwise(F.lit(other))


def usable_terms(terms: Column, most: int = 60) -> Column:
    """Of an array, the terms with 1 to most characters once trimmed, trimmed."""
    return F.filter(F.transform(terms, strip), lambda t: F.length(t).between(1, most))


def lenient_bool(s: Column) -> Column:
    return F.coalesce(F.lower(strip(s.cast("string"))).isin("1", "true", "y", "yes"), F.lit(False))


def expand_vars(s: Column, variables: Column) -> Column:
    """(text, missing): ${NAME} replaced from a map, and the distinct names that the map lacks, which are replaced by nothing."""
    names = F.array_distinct(F.regexp_extract_all(s, F.lit(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}"), F.lit(1)))
    text = F.reduce(names, s, lambda t, n: F.replace(t, F.concat(F.lit("${"), n, F.lit("}")), F.coalesce(variables[n], F.lit(""))))
    return F.struct(text.alias("text"), F.filter(names, lambda n: variables[n].isNull()).alias("missing"))


def tool_text(parts: Column, failed: Column, most: int = 12000) -> Column:
    """A tool's result from its parts (type, text): the texts by lines, cut, marked where the tool failed."""
    text = F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit(""))), "\n")
    cut = F.substring(text, 1, most)
    return F.when(failed, F.concat(F.lit("error: "), cut)).otherwise(cut)


def server_of(url: Column) -> Column:
    """(name, label, scheme) of a server's address: its host as a short name, and as it is."""
    host = F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1), F.lit(""))
    name = F.regexp_replace(F.regexp_replace(F.lower(host), "^www\\.", ""), "[^a-z0-9]+", "-")
    return F.struct(F.regexp_replace(name, "^-+|-+$", "").alias("name"), host.alias("label"), F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)).alias("scheme"))


def note_title(body: Column) -> Column:
    return F.substring(F.split_part(body, F.lit("\n"), F.lit(1)), 1, 30)


def first_line(s: Column) -> Column:
    """The first line that isn't blank once quotes are off its ends; empty if there is none."""
    lines = F.transform(F.split(F.coalesce(s, F.lit("")), r"\r\n|\r|\n"), lambda x: F.regexp_replace(strip(x), "^[\"“”‘’']+|[\"“”‘’']+$", ""))
    return F.coalesce(F.get(F.filter(lines, lambda x: x != ""), F.lit(0)), F.lit(""))


def rewrite_fault(original: Column, rewritten: Column) -> Column:
    """Why a rewritten query is refused: empty, too long (over 120 characters and four times the original), or a number that the original lacks; null if it isn't."""
    text = first_line(rewritten)
    numbers = lambda s: F.regexp_extract_all(s, F.lit("([0-9]+)"), F.lit(1))
    new = F.array_except(numbers(text), numbers(original))
    return F.when(text == "", "empty").when(F.length(text) > F.greatest(F.lit(120), 4 * F.length(original)), "long").when(F.size(new) > 0, "numbers")


def citations(answer: Column) -> Column:
    """Numbers of the sources that an answer cites as [n], each once, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[([0-9]{1,9})\]"), F.lit(1)), lambda n: n.cast("int")))


def markdown_blocks(body: Column) -> Column:
    """Blocks between blank lines as an array of (kind, text): h1, h2, h3 without their marks, or p."""
    parts = F.filter(F.transform(F.split(body, r"\n{2,}"), strip), lambda x: x != "")
    kind = lambda x: F.when(x.startswith("### "), "h3").when(x.startswith("## "), "h2").when(x.startswith("# "), "h1").otherwise("p")
    return F.transform(parts, lambda x: F.struct(kind(x).alias("kind"), F.regexp_replace(x, "^#{1,3} ", "").alias("text")))


def sse_encode(payload: Column) -> Column:
    """A JSON payload as a frame of an event stream."""
    return F.concat(F.lit("data: "), payload, F.lit("\n\n"))


def sse_decode(stream: Column) -> Column:
    """The payloads of a stream's frames; data lines of one frame are joined by line feeds, other lines ignored."""
    lines = lambda f: F.filter(F.split(f, "\n"), lambda x: x.startswith("data:"))
    frames = F.filter(F.split(F.regexp_replace(stream, "\r\n?", "\n"), "\n\n"), lambda f: F.size(lines(f)) > 0)
    return F.transform(frames, lambda f: F.array_join(F.transform(lines(f), lambda x: F.regexp_replace(x, "^data: ?", "")), "\n"))
