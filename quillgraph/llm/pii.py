"""Personal data: base patterns, and terms that disclose a protected entity.

Base: e-mail, IP, card and phone, each kind's leftmost non-overlapping matches; matches that fail the kind's test are dropped without a retry.

Method: the information that a term gives about a protected entity is their pointwise mutual information over the corpus,
pmi = log(N * n(e, t) / (n(e) * n(t))), counted in documents; n(e, t) counts documents that hold both, wherever they stand. It is held against the entity's own
information, ic = log(N / n(e)). A term that gives GENERALISE of it or more about some entity, and means that entity with a probability of LEAST or more, is replaced by a placeholder, and taken
out if it gives REMOVE or more, at every place where it stands in any text, outside base spans. pmi rests on the share n(e, t) / n(t); of pairs seen in fewer than SUPPORT documents, on that
share's lower bound (Wilson's, one-sided at 95 %), so entities of one or two documents have estimates too, as sure as so few documents allow.

Counts cover every row. Document frequencies are combined in each Arrow batch before the shuffle; pairs are
formed only where n(t) is small enough for LEAST to be met at all: n(e, t) is n(e) at most. Null
text counts as empty; rows that repeat are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, left, parted, plain, small_batches, staged

KINDS = ("email", "ip", "card", "phone")
#: The base patterns and the placeholders.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: The base pattern [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), whose matches begin where a run of digits does: long runs cost no more than their length.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]{2,}")
PLACEHOLDER = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]", "gone": ""}

SUPPORT = 3
Z = 1.645  # one-sided 95 %
GENERALISE = 0.8
LEAST = 0.25  # of n(e, t) / n(t)
REMOVE = 0.98
#: A Bloom filter of two hashes tells a task which words may disclose: slots for each such term, and in all (32 MB at most; beyond that it lets more words pass, and the join decides all the same).
SLOTS_EACH, LEAST_SLOTS, MOST_SLOTS = 16, 1 << 20, 1 << 28
FLUSH = 200_000  # distinct terms that a task holds before it hands its counts on


def _emails(t: str):
    """EMAIL's matches, found from each @ outwards, so that texts of long runs cost no more than their length."""
    done, at = 0, t.find("@")
    while at >= 0:
        a = at
        while a > done and (c := t[a - 1]).isascii() and (c.isalnum() or c in "._%+-"):
            a -= 1
        m = DOMAIN.match(t, at + 1) if a < at else None
        if m:
            yield a, m.end()
            done = m.end()
        at = t.find("@", max(at + 1, done))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


_DIGITS = re.compile(r"[^0-9]")
_DIGIT = re.compile(r"[0-9]")


def base_spans(t: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed."""
    if not t:
        return []
    out = [("email", a, b) for a, b in _emails(t)] if "@" in t else []
    if _DIGIT.search(t):
        out += [("ip", m.start(), m.end()) for m in IP.finditer(t) if all(map(_small, m[0].split(".")))]
        for m in CARD.finditer(t):
            if m.end() - m.start() >= 12 and 12 <= len(d := _DIGITS.sub("", m[0])) <= 19 and _luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in t:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(t) if 9 <= len(_DIGITS.sub("", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def told(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _words(t: str, spans):
    """(term, start, end) for the words that no base span covers."""
    starts, ends = [s[1] for s in spans], list(accumulate((s[2] for s in spans), max))
    for m in TERM.finditer(t):
        i = bisect_left(starts, m.end())
        if not i or ends[i - 1] <= m.start():
            yield m[0].lower(), m.start(), m.end()


def _scan(batches):
    """A row for each document, with its distinct entities and, where it has any, its distinct terms."""
    for b in batches:
        counts, strings, held, terms = {k: [] for k in KINDS}, [], [], []
        for t in b.column("text").to_pylist():
            spans = base_spans(t)
            c = Counter(s[0] for s in spans)
            for k in KINDS:
                counts[k].append(c[k])
            strings.append(told(spans))
            held.append(list({f"{k}:{t[x:y].lower()}" for k, x, y in spans}))
            terms.append(list({w[0] for w in _words(t, spans)}) if spans else [])
        sha = [hashlib.sha256(s.encode()).hexdigest() for s in strings]
        yield pa.RecordBatch.from_arrays(
            [b.column("rid"), b.column("doc_id"), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(sha, pa.string()), pa.array(strings, pa.string()), pa.array(held, pa.list_(pa.string())), pa.array(terms, pa.list_(pa.string()))],
            ["rid", "doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "held", "terms"],
        )


SCAN = "rid long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, held array<string>, terms array<string>"


def _frequencies(batches):
    """Documents that hold each term, combined before the shuffle."""
    held: Counter = Counter()

    def out():
        r = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["term", "n"])
        held.clear()
        return r

    for b in batches:
        for t in b.column("text").to_pylist():
            if t:
                held.update(set(TERM.findall(t.lower())))
                if len(held) > FLUSH:
                    yield out()
    if held:
        yield out()


def disclosing(src: DataFrame, scan: DataFrame) -> DataFrame:
    """(entity, term, given): terms that give a share of GENERALISE or more of an entity's information."""
    total = float(max(scan.count(), 1))
    held = scan.select("rid", F.explode("held").alias("entity"))
    counts = held.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")).withColumnRenamed("entity", "e_")
    held, _ = staged(held.join(counts, F.col("entity") == F.col("e_")).select("rid", "entity", "n_e"), "pii-held")
    # The largest n(t) at which a term that every document of an entity holds still means it with a probability of LEAST.
    most = F.col("n_e") / LEAST
    top = held.agg(F.max(most)).first()[0] or 0.0
    terms = src.select("text").mapInArrow(_frequencies, "term string, n long")
    freq = terms.groupBy("term").agg(F.sum("n").alias("n_t")).where(F.col("n_t") <= top).withColumnRenamed("term", "t_")
    rare, _ = staged(scan.select(F.col("rid").alias("r_"), F.explode("terms").alias("term")).join(freq, F.col("term") == F.col("t_")).select("r_", "term", "n_t"), "pii-terms")
    both = held.join(rare, (F.col("rid") == F.col("r_")) & (F.col("n_t") <= most)).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_et"), F.max("n_e").alias("n_e"), F.max("n_t").alias("n_t"))
    ic = F.log(F.lit(total) / F.col("n_e"))
    n = F.greatest("n_t", "n_et")
    share = F.col("n_et") / n
    low = (share + Z * Z / (2 * n) - Z * F.sqrt(share * (1 - share) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)
    sure = F.when(F.col("n_et") < SUPPORT, low).otherwise(share)
    return both.where((ic > 0) & (sure >= LEAST)).select("entity", "term", (1 + F.log(sure) / ic).alias("given")).where(F.col("given") >= GENERALISE)


def _slots(terms: int) -> int:
    """A power of two that follows the number of terms, so that the share of other words that pass doesn't grow with it."""
    return min(max(1 << max(SLOTS_EACH * terms - 1, 0).bit_length(), LEAST_SLOTS), MOST_SLOTS)


def filter_of(terms: DataFrame, col: str) -> bytes:
    """The filter of the terms; its parts, 4 kB each, are made by tasks."""
    slots = _slots(terms.count())
    h = F.xxhash64(col)
    at = F.explode(F.array(h.bitwiseAND(F.lit(slots - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(slots - 1))))
    rows = terms.select(at.alias("at")).select((F.col("at") + 1).alias("at")).select(F.bitmap_bucket_number("at").alias("part"), F.bitmap_bit_position("at").alias("bit"))
    bits = bytearray(slots // 8)
    for r in rows.repartition("part").groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        a = (r["part"] - 1) * len(r["bits"])
        bits[a : a + len(r["bits"])] = r["bits"]
    return bytes(bits)


def _in(bits: bytes, word: str) -> bool:
    h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42)
    for x in (h, h >> 32):
        x &= len(bits) * 8 - 1
        if not bits[x >> 3] >> (x & 7) & 1:
            return False
    return True


def _places(bits: bytes):
    """Where terms stand that the filter lets pass: those that disclose, and few others."""

    def run(batches):
        known: dict[str, bool] = {}

        def wanted(w):
            if (got := known.get(w)) is None:
                if len(known) > FLUSH:
                    known.clear()
                got = known[w] = _in(bits, w)
            return got

        for b in batches:
            rid, term, start, end = [], [], [], []
            for r, t in zip(b.column("rid").to_pylist(), b.column("text").to_pylist()):
                if t and any(wanted(w.lower()) for w in set(TERM.findall(t))):
                    for w, x, y in _words(t, base_spans(t)):
                        if wanted(w):
                            rid.append(r)
                            term.append(w)
                            start.append(x)
                            end.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(term, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["rid", "term", "a", "b"])

    return run


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rid_col: str | None = None) -> DataFrame:
    """A row for each row of docs: rid, doc_id, n_email, n_ip, n_card, n_phone, base_sha256, base, and extra (term spans: kind term or gone, a, b)."""
    src = docs.select((F.col(rid_col) if rid_col else F.monotonically_increasing_id()).alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if not rid_col:
        src, _ = staged(src, "pii-docs")  # written, so that row numbers don't change
    scan, _ = staged(src.mapInArrow(_scan, SCAN), "pii")
    rules, _ = staged(disclosing(src, scan).groupBy("term").agg(F.max("given").alias("g")).withColumnRenamed("term", "t_"), "pii-rules")
    places = src.select("rid", "text").mapInArrow(_places(filter_of(rules, "t_")), "rid long, term string, a long, b long")
    hits = places.join(rules, F.col("term") == F.col("t_")).select("rid", F.struct("a", "b", F.when(F.col("g") >= REMOVE, "gone").otherwise("term").alias("kind")).alias("x"))
    # A document's own spans, as many as it has words at most.
    hits = hits.groupBy("rid").agg(F.sort_array(F.collect_list("x")).alias("extra")).withColumnRenamed("rid", "r_")
    return scan.drop("held", "terms").join(hits, F.col("rid") == F.col("r_"), "left").drop("r_")


def all_spans(base: str, extra) -> str:
    """Base and term spans as one string, by start, then kind as listed."""
    spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in base.split(",") if x)]
    spans += [(x["kind"], x["a"], x["b"]) for x in extra or []]
    return told(sorted(spans, key=lambda s: (s[1], (*KINDS, "term", "gone").index(s[0]))))


def sanitised(text: str, base: str, extra) -> str:
    """The text with base spans replaced, disclosing terms replaced or taken out; overlapping base spans become one placeholder."""
    spans = [(int(a), int(b), k) for k, a, b in (x.split(":") for x in base.split(",") if x)] + [(x["a"], x["b"], x["kind"]) for x in extra or []]
    out, at = [], 0
    for a, b, k in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= at:
            out += [text[at:a], PLACEHOLDER[k]]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _joined(batches):
    for b in batches:
        d = b.to_pydict()
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c != "extra"), pa.array([all_spans(x, y) for x, y in zip(d["base"], d["extra"])], pa.string())], [*(c for c in b.schema.names if c != "extra"), "spans"])


def _clean(text: str):
    """Batches with the text sanitised, and without the column of term spans."""

    def run(batches):
        for b in batches:
            d = b.select([text, "base", "extra"]).to_pydict()
            new = [t if t is None or not (x or y) else sanitised(t, x or "", y) for t, x, y in zip(d[text], d["base"], d["extra"])]
            names = [n for n in b.schema.names if n != "extra"]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if n == text else b.column(n) for n in names], names)

    return run


def sanitise(docs: DataFrame) -> DataFrame:
    """Docs with sanitised text, and n_chars, where there is one, to match; other columns stay, whatever their names."""
    rows, at = plain(docs)
    text, n_chars = at("text"), at("n_chars")
    rows, _ = staged(rows.withColumn("rid", F.monotonically_increasing_id()), "pii-docs")
    before = left()
    with small_batches(docs.sparkSession):
        found, path = staged(find(rows, at("doc_id"), text, "rid").where("base <> '' or extra is not null").select("rid", "base", "extra"), "pii-found")
    drop(docs.sparkSession, left() - before - {path})
    # Only rows with personal data or disclosing terms, and the few that share their hash slots, are shuffled and rewritten.
    maybe, untouched = parted(rows, found)
    hit = maybe.join(found.withColumnRenamed("rid", "r_"), F.col("rid") == F.col("r_"), "left").drop("rid", "r_")
    cleaned = hit.mapInArrow(_clean(text), hit.drop("extra").schema)
    if n_chars:
        cleaned = cleaned.withColumn(n_chars, F.when(F.col("base").isNotNull(), F.length(text).cast(rows.schema[n_chars].dataType)).otherwise(F.col(n_chars)))
    return cleaned.drop("base").unionByName(untouched.drop("rid")).toDF(*docs.columns)


def query(spark, sf_dir):
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("rid")
    return found.mapInArrow(_joined, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, spans string").drop("base")


SQL = None
assert math.isfinite(GENERALISE)
