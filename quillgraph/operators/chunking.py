"""Sentences and chunks of documents.

A document is a row, and its pieces come from its own text alone, so nothing is shuffled: folds whose state is reset by what they meet (packing, merging of short pieces) run over Arrow batches, a text at a time; windows and
boundaries are array expressions. Offsets count code points. Null and empty texts have no pieces.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import cosine, strip
from quillgraph.sources.versions import Versions

#: Where sentences end, what begins a new block, what is a heading line.
SENTENCE_END = re.compile(r"(?<![0-9]\.)(?<=[.!?。！？])\s+")
LINE_ENDS = re.compile(r"\n+")
NEW_BLOCK = re.compile(r"\s*(\d+(\.\d+)*\.?\s|[-•·*]\s|제\s*\d+\s*조|[A-Z][A-Z ]{3,})")
HEADING = re.compile(r"^\s*(\d+(\.\d+)+\.?\s+\S|제\s*\d+\s*조|(Section|Chapter|Appendix)\s+\S|\d+\.\s+[A-Z가-힣])", re.IGNORECASE)
SENTENCE = re.compile(r"[^.!?。]+[.!?。]*\s*|[.!?。]+\s*")
SHORT, LONG = 25, 220
FLOOR, TAIL = 0.4, 0.2
SEMANTIC_MOST = 2000

SLICE = 256  # texts that a task takes apart at once

Span = tuple[int, int]


def _slices(batches):
    """Batches of SLICE rows at most: what Python makes of a batch is several times its size."""
    for b in batches:
        for a in range(0, b.num_rows, SLICE):
            yield b.slice(a, SLICE)


def _trimmed(text: str, a: int, b: int) -> list[Span]:
    """The span without white space at its ends, or none."""
    piece = text[a:b]
    size = len(piece.strip())
    a += len(piece) - len(piece.lstrip())
    return [(a, a + size)] if size else []


def _within(text: str, a: int, b: int) -> list[Span]:
    """A long span in parts of LONG characters at most, cut at the last white space of a part's second half where there is one."""
    out = []
    while b - a > LONG:
        half = LONG // 2 + 1
        blanks = [m.start() for m in re.finditer(r"\s", text[a + half : a + LONG])]
        cut = a + (half + blanks[-1] if blanks else LONG)
        out += _trimmed(text, a, cut)
        a = cut
    return out + _trimmed(text, a, b)


def sentence_spans(text: str | None) -> list[Span]:
    """Sentences as (start, end): parted at their ends and at lines that begin a block, long ones cut, and what is shorter than SHORT joined with what follows while that stays within LONG."""
    if not text or not text.strip():
        return []
    ends = {m.end() for m in SENTENCE_END.finditer(text)}
    ends |= {m.end() for m in LINE_ENDS.finditer(text) if len(m[0]) > 1 or NEW_BLOCK.match(text, m.end())}
    marks = [0, *sorted(ends - {0, len(text)}), len(text)]
    out: list[Span] = []
    for a, b in zip(marks, marks[1:]):
        for whole in _trimmed(text, a, b):
            for x, y in _within(text, *whole):
                if out and out[-1][1] - out[-1][0] < SHORT and y - out[-1][0] <= LONG:
                    out[-1] = (out[-1][0], y)
                else:
                    out.append((x, y))
    return out


def _long_parts(body: str, start: int, size: int) -> list[tuple[str, int]]:
    """Windows of size characters; a last one with little in it stays with the one before."""
    cuts = list(range(0, len(body), size))
    if len(cuts) > 1 and len(body[cuts[-1] :].strip()) < size * TAIL:
        cuts.pop()
    return [(body[a:b], start + a) for a, b in zip(cuts, [*cuts[1:], len(body)])]


def fixed(text: str, size: int):
    return [(text[a : a + size], a) for a in range(0, len(text), size)]


def structure(text: str, size: int):
    """Blocks that begin at heading lines; short ones join the block before while that stays within size, long ones are cut."""
    blocks: list[list] = []
    at = 0
    for line in text.split("\n"):
        if not blocks or HEADING.match(line):
            blocks.append([line, at])
        else:
            blocks[-1][0] += "\n" + line
        at += len(line) + 1
    joined: list[list] = []
    for body, start in blocks:
        if joined and len(body.strip()) < size * FLOOR and len(joined[-1][0]) + 1 + len(body) <= size:
            joined[-1][0] += "\n" + body
        else:
            joined.append([body, start])
    return [p for body, start in joined if body.strip() for p in (_long_parts(body, start, size) if len(body) > size else [(body, start)])]


def paragraph(text: str, size: int):
    """Paragraphs packed one after another while they stay within size, a blank line between; a longer one is cut and stands alone."""
    out: list[list] = []
    is_open, marks = False, [0, *(x for m in re.finditer(r"\n\s*\n", text) for x in m.span()), len(text)]
    for start, stop in zip(marks[::2], marks[1::2]):
        body = text[start:stop]
        if not body.strip():
            continue
        if len(body) > size:
            out += map(list, _long_parts(body, start, size))
            is_open = False
        elif is_open and len(out[-1][0]) + 2 + len(body) <= size:
            out[-1][0] += "\n\n" + body
        else:
            out.append([body, start])
            is_open = True
    return [tuple(x) for x in out]


def packed(paragraphs: list[tuple[str, bool]], header: str, target: int) -> list[tuple[str, int, int, int]]:
    """Paragraphs (text, whether it is a heading) put together until target characters would be passed, each chunk under the header: the chunk, the number of its first paragraph, where in that it begins, and the number of its last one. Headings stand in brackets. A paragraph
    of more than twice target is cut behind its sentences' ends, all marks kept, into parts of target characters where its sentences allow; what is left of it opens the next chunk, and its length counts there."""
    out: list[tuple[str, int, int, int]] = []
    current: list[str] = []
    size, begin = 0, (0, 0)

    def flush(last: int) -> None:
        nonlocal current, size
        if current:
            out.append((header + "\n\n" + "\n\n".join(current), *begin, last))
        current, size = [], 0

    for no, (body, heading) in enumerate(paragraphs):
        text = f"[{body}]" if heading else body
        if current and size + len(text) > target:
            flush(no - 1)
        if not current:
            begin = no, 0
        if len(text) <= 2 * target:
            current.append(text)
            size += len(text)
            continue
        held, at = "", 0
        for part in SENTENCE.findall(text) or [text]:
            if held and len(held) + len(part) > target:
                current.append(held.strip())
                flush(no)
                begin, held = (no, at), ""
            held += part
            at += len(part)
        if held.strip():
            current.append(held.strip())
        size += len(held)
    flush(len(paragraphs) - 1)
    return out


PACKED = "doc string, chapter_no int, chunk_index int, first_para int, start int, last_para int, n_chars int, chunk string"


def pack_chapters(chapters: DataFrame, target: int) -> DataFrame:
    """Chunks of chapters (doc, chapter_no, header, paragraphs: array of heading, text): PACKED, start being where the chunk begins in its first paragraph. A chapter is a row, so nothing is shuffled."""
    kinds = (pa.string(), *[pa.int32()] * 6, pa.string())

    def run(batches):
        for b in _slices(batches):
            rows = []
            for doc, no, header, paras in zip(*(b.column(c).to_pylist() for c in ("doc", "chapter_no", "header", "paragraphs"))):
                for i, (chunk, first, start, last) in enumerate(packed([(p["text"] or "", p["heading"] is not None) for p in paras or []], header or "", target)):
                    rows.append((doc, no, i, first, start, last, len(chunk), chunk))
            cols = list(zip(*rows)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [f.split()[0] for f in PACKED.split(", ")])

    return chapters.select(F.col("doc").cast("string"), F.col("chapter_no").cast("int"), "header", "paragraphs").mapInArrow(run, PACKED)


CHUNKERS = {"fixed": fixed, "structure": structure, "paragraph": paragraph}
CHUNK = "doc_id long, chunk_index int, start int, n_chars int, strategy string, chunk string"


def chunk(docs: DataFrame, strategy: str, size: int = 500) -> DataFrame:
    """doc_id, chunk_index, start, n_chars, strategy, chunk (stripped; blank ones are left out and don't count). The strategy is one of CHUNKERS; size is held within 100 and 2000."""
    if strategy not in CHUNKERS:
        raise ValueError(f"unknown strategy {strategy!r}: one of {', '.join(CHUNKERS)}, or semantic_chunks")
    cut, size = CHUNKERS[strategy], min(2000, max(100, int(size)))

    def run(batches):
        for b in _slices(batches):
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                kept = [(p.strip(), a) for p, a in cut(text or "", size) if p.strip()]
                rows += [(doc, i, a, len(p), strategy, p) for i, (p, a) in enumerate(kept)]
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()))], ["doc_id", "chunk_index", "start", "n_chars", "strategy", "chunk"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, CHUNK)


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, sent_no, start, end, sentence."""

    def run(batches):
        for b in _slices(batches):
            rows = [(d, i, x, y, t[x:y]) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) for i, (x, y) in enumerate(sentence_spans(t))]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()))], ["doc_id", "sent_no", "start", "end", "sentence"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, sent_no int, start int, end int, sentence string")


def distances(vectors: DataFrame, doc: str = "doc_id", order: str = "sent_no", vector: str = "vector") -> DataFrame:
    """vectors with dist, the cosine distance to the next one of the document, to four decimals; null at the last."""
    w = Window.partitionBy(doc).orderBy(order)
    v = vectors.withColumn("v_", F.col(vector).cast("array<double>")).withColumn("next_", F.lead("v_").over(w))
    return v.withColumn("dist", F.when(F.col("next_").isNotNull(), F.round(1 - cosine(F.col("v_"), F.col("next_")), 4))).drop("v_", "next_")


def breakpoints(dists: DataFrame, doc: str = "doc_id", percentile: int = 10) -> DataFrame:
    """dists with threshold and cut: a boundary where the distance reaches the document's percentile 100 - percentile (1 to 50), linearly interpolated."""
    p = 1 - min(50, max(1, percentile)) / 100
    t = dists.where("dist is not null").groupBy(doc).agg(F.round(F.percentile("dist", p), 4).alias("threshold"))
    return dists.join(t, doc, "left").withColumn("cut", F.coalesce(F.col("dist") >= F.col("threshold"), F.lit(False)))


def grouped(cuts: DataFrame, doc: str = "doc_id", order: str = "sent_no") -> DataFrame:
    """cuts with grp: a sentence at a cut ends its group."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return cuts.withColumn("grp", F.coalesce(F.sum(F.col("cut").cast("int")).over(w), F.lit(0)).cast("int"))


DISTANCES = "doc_id long, sha string, sent_no int, start int, end int, dist double"


def sentence_distances(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Of each sentence of docs that has a vector (doc_id, sent_no, vector): DISTANCES, sha being the text's, dist the distance to the next one."""
    s = sentences(docs).join(vectors.select("doc_id", "sent_no", "vector"), ["doc_id", "sent_no"])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    return distances(s).join(texts, "doc_id").select("doc_id", "sha", "sent_no", "start", "end", "dist")


class SentenceCache:
    """Distances of sentences kept under a document and its text, so that another percentile, and texts that haven't changed, need no vectors. Versioned tables under path."""

    def __init__(self, spark, path: str):
        self.tables = Versions(spark, path)

    def unknown(self, docs: DataFrame) -> DataFrame:
        """The documents (doc_id, text) whose text isn't known: those that vectors are needed for."""
        known = self.tables.read("texts", "doc_id long, sha string")
        d = docs.withColumn("sha_", F.sha2(F.coalesce("text", F.lit("")), 256))
        return d.join(known, (F.col("sha_") == known["sha"]) & (d["doc_id"] == known["doc_id"]), "left_anti").drop("sha_")

    def put(self, docs: DataFrame, vectors: DataFrame) -> int:
        """Keep what is new of docs; gives the version."""
        base, _ = self.tables.current()
        new = self.tables.staged(self.tables.stage(self.unknown(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "doc_id long, text string")
        texts = self.tables.stage(new.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")))
        return self.tables.commit(append={"texts": [texts], "distances": [self.tables.stage(sentence_distances(new, vectors))]}, base=base)

    def distances(self, docs: DataFrame) -> DataFrame:
        """DISTANCES of docs as they are now."""
        d = docs.select(F.col("doc_id").cast("long").alias("d_"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("s_"))
        known = self.tables.read("distances", DISTANCES)
        return known.join(d, (F.col("doc_id") == F.col("d_")) & (F.col("sha") == F.col("s_")), "left_semi")


def chunks_of_distances(docs: DataFrame, dists: DataFrame, percentile: int = 10) -> DataFrame:
    """Chunks of sentences between the boundaries of their distances (DISTANCES), with the white space inside; longer ones than SEMANTIC_MOST are cut. Columns as of chunk, and capped: whether the chunk is a part of a longer one. Texts without a sentence have none."""
    spans = grouped(breakpoints(dists, percentile=percentile)).groupBy("doc_id", "grp").agg(F.min("start").alias("a"), F.max("end").alias("b"))
    spans = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))  # a document's own
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_())

    def run(batches):
        for b in _slices(batches):
            rows = []
            for doc, text, own in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "spans"))):
                parts = [(p, a, len(cut) > 1) for x in own for cut in [_long_parts(text[x["a"] : x["b"]], x["a"], SEMANTIC_MOST)] for p, a in cut if p.strip()]
                rows += [(doc, i, a, len(p.strip()), "semantic", p.strip(), capped) for i, (p, a, capped) in enumerate(parts)]
            cols = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "chunk_index", "start", "n_chars", "strategy", "chunk", "capped"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(spans, "doc_id").mapInArrow(run, CHUNK + ", capped boolean")


def semantic_chunks(docs: DataFrame, vectors: DataFrame, percentile: int = 10) -> DataFrame:
    """Chunks of sentences between the boundaries of their vectors (doc_id, sent_no, vector). Columns as of chunk."""
    return chunks_of_distances(docs, sentence_distances(docs, vectors), percentile).drop("capped")


def semantic_report(docs: DataFrame, dists: DataFrame, percentile: int = 10, cached: DataFrame | None = None) -> DataFrame:
    """A row for each document: percentile, threshold, sentences, boundaries, cuts, cached (whether cached, doc_id, has it), capped (groups that were cut for their length), distances, and snippets: the ends of both sentences at each boundary. Zeros and empty lists for a text without
    sentences."""
    p = min(50, max(1, percentile))
    w = Window.partitionBy("doc_id").orderBy("sent_no")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    b = breakpoints(dists, percentile=p).withColumn("n_start", F.lead("start").over(w)).withColumn("n_end", F.lead("end").over(w)).join(text, "doc_id")
    head = strip(F.substring(F.col("text"), F.greatest(F.col("start"), F.col("end") - 30) + 1, F.col("end") - F.greatest(F.col("start"), F.col("end") - 30)))
    tail = strip(F.substring(F.col("text"), F.col("n_start") + 1, F.least(F.col("n_end"), F.col("n_start") + 30) - F.col("n_start")))
    at = F.when(F.col("dist").isNotNull(), F.struct("sent_no", "dist", F.array(head, tail).alias("ends")))
    g = b.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.count("dist").alias("boundaries"), F.count_if("cut").alias("cuts"), F.max("threshold").alias("threshold"), F.sort_array(F.collect_list(at)).alias("l"))  # a document's sentences
    spans = grouped(breakpoints(dists, percentile=p)).groupBy("doc_id", "grp").agg((F.max("end") - F.min("start")).alias("n")).groupBy("doc_id").agg(F.count_if(F.col("n") > SEMANTIC_MOST).alias("capped"))
    out = text.select("doc_id").join(g, "doc_id", "left").join(spans, "doc_id", "left")
    known = F.lit(False) if cached is None else F.col("c_").isNotNull()
    if cached is not None:
        out = out.join(cached.select(F.col("doc_id").alias("c_")).distinct(), F.col("doc_id") == F.col("c_"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select("doc_id", F.lit(p).alias("percentile"), F.coalesce("threshold", F.lit(0.0)).alias("threshold"), zero("sentences"), zero("boundaries"), zero("cuts"), known.alias("cached"), zero("capped"), F.coalesce(F.transform("l", lambda x: x["dist"]), F.array().cast("array<double>")).alias("distances"), F.coalesce(F.transform("l", lambda x: x["ends"]), F.array().cast("array<array<string>>")).alias("snippets"))


def boundary_snippets(cuts: DataFrame, doc: str = "doc_id", order: str = "sent_no", text: str = "sentence") -> DataFrame:
    """Around each boundary: the last 30 characters before it and the first 30 after it."""
    w = Window.partitionBy(doc).orderBy(order)
    return cuts.withColumn("after", F.substring(F.lead(text).over(w), 1, 30)).where("cut").select(doc, order, "dist", F.right(F.col(text), F.lit(30)).alias("before"), "after")


def summarize(chunks: DataFrame, size: str = "n_chars") -> DataFrame:
    """One row: n, least, most, mean (to the nearest even whole); zeros for no chunks."""
    zero = F.lit(0)
    return chunks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.min(size), zero).alias("least"), F.coalesce(F.max(size), zero).alias("most"), F.coalesce(F.bround(F.avg(size), 0), F.lit(0.0)).cast("long").alias("mean"))


def show(chunks: DataFrame, start: int, count: int = 5) -> DataFrame:
    """Chunks from an index on, twenty at most."""
    return chunks.where(F.col("chunk_index").between(max(0, start), max(0, start) + min(20, max(1, count)) - 1))


def page_of(starts: DataFrame, pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """starts (doc, start) with page: the first whose running end, a character more for each page, is beyond start; the last page for what lies behind. pages: doc, page, n_chars.

    Ends and starts of a document are put in one order, and each start takes the next page after it: one shuffle by document, no range join.
    """
    run = F.sum(F.col("n_chars") + 1).over(Window.partitionBy(doc).orderBy("page"))
    ends = pages.select(doc, (run - 1).alias("at"), F.col("page").alias("page_"), F.lit(1).alias("kind"))
    asked = starts.select(doc, F.col("start").cast("long").alias("at"), F.lit(None).cast("int").alias("page_"), F.lit(0).alias("kind"))
    w = Window.partitionBy(doc).orderBy("at", "kind")
    after = F.first("page_", ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    last = F.max("page_").over(Window.partitionBy(doc))
    both = ends.select(doc, "at", F.col("page_").cast("int"), "kind").unionByName(asked)
    return both.withColumn("page", F.coalesce(after, last)).where("kind = 0").select(doc, F.col("at").alias("start"), "page")


def page_report(pages: DataFrame, thin: int = 120) -> DataFrame:
    """One row: pages, least, most, mean (floor) characters, and the numbers of the first 25 thin and the first 25 empty pages."""
    n = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", ""))
    p = pages.select("page", F.length(F.coalesce("text", F.lit(""))).alias("c"), n.alias("n"))
    numbers = lambda ok: F.slice(F.sort_array(F.collect_list(F.when(ok, F.col("page")))), 1, 25)  # noqa: E731  a document's own pages
    return p.agg(F.count(F.lit(1)).alias("pages"), F.min("c").alias("least"), F.max("c").alias("most"), F.floor(F.avg("c")).alias("mean"), numbers((F.col("n") < thin) & (F.col("n") > 0)).alias("thin"), numbers(F.col("n") == 0).alias("empty"))


def read_pages(pages: DataFrame, first: int, last: int, thin: int = 120) -> DataFrame:
    """Pages first to last, with a flag for those of little text."""
    stripped = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", "")
    return pages.where(F.col("page").between(first, last)).withColumn("thin", F.length(stripped) < thin)
