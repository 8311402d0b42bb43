"""From positioned runs of a PDF to lines, paragraphs, headings and chapters.

Predicates and selections are column expressions. Folds whose state is reset by what they meet (bands, paragraphs, merging of small chapters) run on one page or one document at a time.
Runs: doc, page, run_no, str, x, right, y, font_size, bold, and the page's width and height. Lines: doc, page, line_no, text, x, right, y, font_size, bold, full, column_no, width, height.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import has_cjk

#: Numbered headings, words that are headings, ends of sentences, lines that hold a page's number, metadata that is no title.
TOP_NUMBER = (
    r"(?i)^(chapter|part|section|appendix|unit|lesson)\s+([0-9]{1,3}|[ivxlc]{1,6})\b",
    r"^제\s*[0-9]{1,3}\s*[장절편부과강](?=[A-Za-z0-9_])",
    r"^[0-9]{1,2}\.?\s+[^\d\s.].{1,90}$",
    r"^[IVX]{1,5}\.\s+\S.{1,90}$",
)
SUB_NUMBER = (r"^[0-9]{1,2}(\.[0-9]{1,2}){1,3}\.?\s+\S", r"^[0-9]{1,2}\.[0-9]{1,2}\s")
SECTION_WORDS = (  # one pattern, over two lines
    r"(?i)^(abstract|introduction|background|related work|methods?|methodology|results?|discussion|conclusions?|summary|references|bibliography|acknowledg(e)?ments?|appendix|preface|foreword|contents|table of contents|index"
    r"|glossary|요약|초록|서론|서문|머리말|들어가며|본론|결론|맺음말|나가며|참고\s*문헌|부록|목차|감사의\s*글)$"
)
TERMINAL = r"[.!?。」』\"”)\]]\s*$"
PAGE_NUMBER = (r"^[-–—]?\s*\d{1,4}\s*[-–—]?$", r"(?i)^(page|p\.|pg\.?)\s*\d+(\s*(of|/)\s*\d+)?$", r"^\d+\s*/\s*\d+$", r"(?i)^[ivxlc]{1,6}$")
NO_TITLE, FILE_TITLE = r"(?i)^(untitled|microsoft word|document|title)\b", r"(?i)\.(docx?|pdf|tex|pptx?)$"


def _any(c: Column, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def numbered_kind(text: Column) -> Column:
    """sub, top or none; sub is looked for first."""
    return F.when(_any(text, SUB_NUMBER), "sub").when(_any(text, TOP_NUMBER), "top").otherwise("none")


def is_page_number(text: Column, y: Column, height: Column) -> Column:
    """Whether a line at a page's edge is its number."""
    return ((y > height * 0.9) | (y < height * 0.09)) & _any(F.trim(text), PAGE_NUMBER)


def is_heading(text: Column, size: Column, bold: Column, body: Column) -> Column:
    """Whether a line reads as a heading: larger than the body, bold, numbered, or a section's usual word; never an address, nor too long."""
    t = F.trim(text)
    words = F.size(F.split(t, r"\s+"))
    sentence = t.rlike(r"[.,;:]$") & ~t.rlike(r"\d\.$")
    larger = size >= body * 1.05
    by_size = (size >= body * 1.15) & (words <= 24) & ~(sentence & (words > 8))
    by_weight = bold & (words <= 16) & ~sentence & (size >= body * 0.95)
    by_number = (numbered_kind(t) != "none") & (words <= 18) & ~sentence & (larger | bold | (size >= body * 0.98))
    by_word = t.rlike(SECTION_WORDS) & (larger | bold | (words <= 2))
    return F.length(t).between(2, 140) & ~t.rlike(r"(?i)https?://") & (by_size | by_weight | by_number | by_word)


def joined(lines: Column) -> Column:
    """An array of lines as one text: a hyphen before a small letter goes, lines of Chinese, Japanese or Korean join without a blank, others with one."""
    def step(acc, line):
        a, b = F.regexp_replace(acc, r"\s+$", ""), F.regexp_replace(line, r"^\s+", "")
        hyphen = a.endswith("-") & b.rlike("^[a-z가-힣]")
        close = has_cjk(F.right(a, F.lit(1))) & has_cjk(F.left(b, F.lit(1)))
        return F.when(a == "", b).when(b == "", a).when(hyphen, F.concat(F.substring(a, F.lit(1), F.length(a) - 1), b)).when(close, F.concat(a, b)).otherwise(F.concat(a, F.lit(" "), b))

    return F.aggregate(lines, F.lit(""), step)


LINES = "doc string, page int, line_no int, text string, x double, right double, y double, font_size double, bold boolean, full boolean, column_no int, width double, height double"


def _page_lines(page: pd.DataFrame) -> pd.DataFrame:
    """The lines of one page, in reading order."""
    names = [f.split()[0] for f in LINES.split(", ")]
    runs = page.sort_values(["y", "x"], ascending=[False, True], kind="stable").to_dict("records")
    width = float(page["width"].iloc[0])
    bands: list[list[dict]] = []
    for r in runs:
        if bands and abs(bands[-1][0]["y"] - r["y"]) <= max(1.5, 0.4 * max(bands[-1][0]["font_size"], r["font_size"])):
            bands[-1].append(r)
        else:
            bands.append([r])
    segments: list[list[dict]] = []
    for band in bands:
        last = None
        for r in sorted(band, key=lambda r: r["x"]):
            if last is None or r["x"] - last["right"] > 2.5 * max(last["font_size"], r["font_size"]):
                segments.append([])
            segments[-1].append(r)
            last = r
    rows = []
    for s in segments:
        text = ""
        for before, r in zip([None, *s], s):
            apart = before is not None and r["x"] - before["right"] > 0.12 * r["font_size"] and not text[-1:].isspace() and not r["str"][:1].isspace()
            text += " " * apart + r["str"]
        n = sum(len(r["str"]) for r in s)
        size = sum(r["font_size"] * len(r["str"]) for r in s) / n if n else s[0]["font_size"]
        x, right = min(r["x"] for r in s), max(r["right"] for r in s)
        rows.append({
            "text": " ".join(text.split()), "x": x, "right": right, "y": s[0]["y"], "font_size": int(size * 10 + 0.5) / 10, "bold": bool(n and sum(len(r["str"]) for r in s if r["bold"]) / n > 0.6),
            "full": bool(right - x > 0.55 * width or (x < width * 0.4 and right > width * 0.62)),
        })
    rows.sort(key=lambda r: (-r["y"], r["x"]))
    part = [r for r in rows if not r["full"]]
    left = sum(r["x"] < width * 0.45 for r in part)
    two = two_columns(len(part), left)
    stretch = 0
    for r in rows:
        side = int(two and not r["full"] and r["x"] >= width * 0.45)
        stretch += 2 * r["full"]  # a full line stands between the stretch before it and the one after
        r["column_no"], r["key"] = side, (stretch - r["full"], side) if two else (0, 0)
    rows.sort(key=lambda r: r["key"])
    rows = [r for r in rows if r["text"]]
    for i, r in enumerate(rows):
        r |= {"doc": page["doc"].iloc[0], "page": int(page["page"].iloc[0]), "line_no": i, "width": width, "height": float(page["height"].iloc[0])}
    return pd.DataFrame(rows, columns=names)


def two_columns(partial: int, left: int) -> bool:
    """Whether a page of so many lines that aren't of full width, so many of them on the left, is set in two columns."""
    right = partial - left
    return partial >= 10 and min(left, right) >= 5 and min(left, right) / partial > 0.2


def lines(runs: DataFrame) -> DataFrame:
    """Lines of pages in reading order: runs on one base line, parted at wide gaps; in two columns the left one first, lines of full width between."""
    return runs.groupBy("doc", "page").applyInPandas(_page_lines, LINES)


def without_running(line_table: DataFrame, keys: DataFrame, key: Column) -> DataFrame:
    """Lines without page numbers, and without those whose key recurs over the document's pages (keys: doc, key) at a page's edge."""
    edge = (F.col("y") > F.col("height") * 0.9) | (F.col("y") < F.col("height") * 0.09)
    l = line_table.where(~is_page_number(F.col("text"), F.col("y"), F.col("height"))).withColumn("key_", key).withColumn("edge_", edge)
    k = keys.select(F.col("doc").alias("d_"), F.col("key").alias("k_"))
    return l.join(k, (F.col("doc") == F.col("d_")) & (F.col("key_") == F.col("k_")) & F.col("edge_"), "left_anti").drop("key_", "edge_")


PARAGRAPHS = "doc string, para_no int, text string, page int, heading int, font_size double"


def _assemble(doc: pd.DataFrame) -> pd.DataFrame:
    """Paragraphs of one document from its lines (with is_heading, kind, spacing, edge)."""
    out: list[dict] = []
    own, before, heading = [], None, False

    def close():
        if own:
            out.append({"doc": own[0]["doc"], "lines": [x["text"] for x in own], "page": own[0]["page"], "heading": 1 if heading else None, "font_size": sum(x["font_size"] for x in own) / len(own)})
            own.clear()

    for x in doc.sort_values(["page", "line_no"]).to_dict("records"):
        same_page = before is not None and before["page"] == x["page"]
        gap = before["y"] - x["y"] if same_page else float("inf")
        if x["is_heading"]:
            goes_on = own and heading and same_page and abs(before["font_size"] - x["font_size"]) < 0.6 and gap < 1.8 * x["spacing"] and x["kind"] == "none"
        elif not own or heading:
            goes_on = False
        else:
            beside = same_page and before["column_no"] == x["column_no"] and before["full"] == x["full"]
            ended = bool(re.search(TERMINAL, before["text"]))
            breaks = (
                abs(before["font_size"] - x["font_size"]) > 1.0,
                beside and gap > 1.65 * x["spacing"],
                beside and x["x"] - min(y["x"] for y in own) > 0.9 * x["font_size"],
                ended and before["right"] < x["edge"] - 2.2 * before["font_size"],
                ended and not beside,
            )
            goes_on = not any(breaks)
        if not goes_on:
            close()
            heading = bool(x["is_heading"])
        own.append(x)
        before = x
    close()
    frame = pd.DataFrame(out, columns=["doc", "lines", "page", "heading", "font_size"])
    frame["heading"] = frame["heading"].astype("Int32")
    frame["n"] = range(len(frame))
    return frame


def paragraphs(line_table: DataFrame, body: DataFrame) -> DataFrame:
    """doc, para_no, text, page, heading (1 or null), font_size from lines and body sizes (doc, body_size). Paragraphs of a character, or of digits and marks only, are left out."""
    l = line_table.join(body.select("doc", "body_size"), "doc", "left").withColumn("body_size", F.coalesce("body_size", F.lit(10.0)))
    l = l.withColumn("is_heading", is_heading(F.col("text"), F.col("font_size"), F.col("bold"), F.col("body_size"))).withColumn("kind", numbered_kind(F.trim("text")))
    l = l.join(line_spacing(line_table), ["doc", "page"], "left").join(right_edges(line_table), ["doc", "page", "column_no"], "left").withColumn("spacing", F.coalesce("spacing", F.lit(12.0))).withColumn("edge", F.coalesce("edge", F.when(F.col("column_no") == 0, F.col("width") * 0.9).otherwise(F.col("width"))))
    raw = l.groupBy("doc").applyInPandas(_assemble, "doc string, lines array<string>, page int, heading int, font_size double, n int")
    p = raw.select("doc", "n", F.trim(joined(F.col("lines"))).alias("text"), "page", "heading", F.round("font_size", 1).alias("font_size")).where((F.length("text") >= 2) & ~F.col("text").rlike(r"^[\d\s.,;:-]+$"))
    return p.select("doc", (F.row_number().over(Window.partitionBy("doc").orderBy("n")) - 1).alias("para_no"), "text", "page", "heading", "font_size")


def line_spacing(line_table: DataFrame) -> DataFrame:
    """For each page: spacing, the upper median of the gaps between lines of a column."""
    side = F.when(F.col("full"), 2).otherwise(F.col("column_no"))
    l = line_table.withColumn("side_", side).withColumn("gap_", F.lag("y").over(Window.partitionBy("doc", "page", "side_").orderBy(F.desc("y"))) - F.col("y"))
    gaps = l.where((F.col("gap_") > 0.5) & (F.col("gap_") < 60)).groupBy("doc", "page").agg(F.sort_array(F.collect_list("gap_")).alias("g"))  # a page's own
    return gaps.select("doc", "page", F.get("g", F.floor(F.size("g") / 2).cast("int")).alias("spacing"))


def right_edges(line_table: DataFrame) -> DataFrame:
    """For each column of a page: edge, what nine tenths of its lines end before."""
    e = line_table.where(~F.col("full")).groupBy("doc", "page", "column_no").agg(F.sort_array(F.collect_list("right")).alias("r"))  # a page's own
    return e.select("doc", "page", "column_no", F.get("r", F.floor(F.size("r") * 0.9).cast("int")).alias("edge"))


def title(first_page: DataFrame, body: DataFrame, meta: DataFrame) -> DataFrame:
    """doc and title: the metadata's if it is one; else the largest lines of the first page, with lines of that size close by; else the fallback. meta: doc, meta_title, fallback."""
    l = first_page.join(body.select("doc", "body_size"), "doc")
    big = l.where(F.length("text").between(3, 160) & (F.col("font_size") >= F.col("body_size") * 1.2))
    top = big.groupBy("doc").agg(F.max_by(F.struct("font_size", "y", "text"), F.struct("font_size", "y")).alias("t"))
    near = first_page.join(top, "doc").where((F.abs(F.col("font_size") - F.col("t.font_size")) < 0.6) & (F.abs(F.col("y") - F.col("t.y")) < F.col("t.font_size") * 4))
    found = near.groupBy("doc").agg(F.trim(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y", "text")), asc=False), lambda x: x["text"]), " ")).alias("all_"), F.first("t.text").alias("one_"))
    m = F.trim("meta_title")
    usable = F.length(m).between(3, 200) & ~m.rlike(NO_TITLE) & ~m.rlike(FILE_TITLE)
    return meta.join(found, "doc", "left").select("doc", F.coalesce(F.when(usable, m), F.when(F.length("all_").between(3, 200), F.col("all_")), "one_", "fallback").alias("title"))


def heading_candidates(paras: DataFrame, body: DataFrame, most: int = 250) -> DataFrame:
    """Headings of 140 characters at most: doc, para_no, page, size, bold (well above the body), numbered, text; of more than most, numbered ones first, then the largest."""
    p = paras.where((F.col("heading").isNotNull()) & (F.length("text") <= 140)).join(body.select("doc", "body_size"), "doc")
    c = p.select("doc", "para_no", "page", F.round("font_size", 1).alias("size"), (F.col("font_size") >= F.col("body_size") * 1.15).alias("bold"), numbered_kind(F.col("text")).alias("numbered"), "text")
    w = Window.partitionBy("doc").orderBy((F.col("numbered") == "top").desc(), F.desc("size"), "para_no")
    return c.withColumn("k_", F.row_number().over(w)).where(F.col("k_") <= most).drop("k_")


def clean_selection(picked: DataFrame, paras: DataFrame) -> DataFrame:
    """What a model picked (doc, para_no, title, ord) as it can be used: paragraphs there are, each once, the first time it is named; titles trimmed."""
    p = picked.withColumn("n_", F.col("para_no").try_cast("double")).where(F.col("n_") == F.floor("n_")).withColumn("para_no", F.col("n_").cast("int"))
    one = p.groupBy("doc", "para_no").agg(F.min_by("title", "ord").alias("title"))
    return one.join(paras.select("doc", "para_no"), ["doc", "para_no"], "left_semi").select("doc", "para_no", F.trim("title").alias("title"))


def select_headings(candidates: DataFrame, picked: DataFrame | None = None) -> DataFrame:
    """doc, para_no, title, method. A document's chapters begin where a model picked them; else at numbered headings, if 2 to 80; else at those of the largest size (rounded) that 2 to 80 have. Documents without any are left out."""
    c = candidates.withColumn("whole_", F.floor(F.col("size") + 0.5))
    top = c.where("numbered = 'top'").groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, 80)).select("doc")
    sizes = c.groupBy("doc", "whole_").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, 80)).groupBy("doc").agg(F.max("whole_").alias("best_"))
    sizes = sizes.join(top, "doc", "left_anti")
    out = c.where("numbered = 'top'").join(top, "doc", "left_semi").select("doc", "para_no", F.col("text").alias("title"), F.lit("numbered").alias("method"))
    out = out.unionByName(c.join(sizes, "doc").where("whole_ = best_").select("doc", "para_no", F.col("text").alias("title"), F.lit("font-size").alias("method")))
    if picked is None:
        return out
    return out.join(picked.select("doc").distinct(), "doc", "left_anti").unionByName(picked.select("doc", "para_no", "title", F.lit("model").alias("method")))


def demoted(heading: Column, size: Column, body: Column) -> Column:
    """A heading's level within a chapter."""
    return F.when(heading.isNotNull(), F.when(size >= body * 1.15, 2).otherwise(3))


def chapters_by_headings(paras: DataFrame, selected: DataFrame, body: DataFrame, titles: DataFrame) -> DataFrame:
    """Paragraphs with chapter_no and chapter_title of the last chosen heading at or before them, the chosen headings themselves left out. What comes before the first is a chapter of its own if it has 200 characters of body, else it is dropped."""
    p = paras.join(selected.select("doc", "para_no", F.col("title").alias("sel_")), ["doc", "para_no"], "left").join(selected.select("doc").distinct(), "doc", "left_semi").join(body.select("doc", "body_size"), "doc").join(titles.select("doc", F.col("title").alias("doc_title")), "doc", "left")
    w = Window.partitionBy("doc").orderBy("para_no")
    chosen = F.col("sel_").isNotNull()
    p = p.withColumn("chapter_no", F.sum(chosen.cast("int")).over(w)).withColumn("chapter_title", F.last(F.when(chosen, F.coalesce(F.nullif("sel_", F.lit("")), "text")), ignorenulls=True).over(w))
    front = F.sum(F.when((F.col("chapter_no") == 0) & F.col("heading").isNull(), F.length("text")).otherwise(0)).over(Window.partitionBy("doc"))
    p = p.withColumn("front_", front).where((F.col("chapter_no") > 0) | (F.col("front_") >= 200))
    p = p.withColumn("chapter_title", F.coalesce("chapter_title", F.substring(F.concat(F.lit("서두 · "), F.col("doc_title")), 1, 120)))
    return p.select("doc", "chapter_no", "chapter_title", "para_no", "page", F.when(chosen, 0).otherwise(demoted(F.col("heading"), F.col("font_size"), F.col("body_size"))).alias("heading"), F.when(chosen, "").otherwise(F.col("text")).alias("text"))


def chapters_by_pages(paras: DataFrame, n_pages: DataFrame) -> DataFrame:
    """Paragraphs with chapter_no and chapter_title of equal stretches of pages: one for six pages, 1 to 12 of them. Stretches without text have none. n_pages: doc, pages."""
    g = F.greatest(F.lit(1), F.least(F.lit(12), F.ceil(F.col("pages") / 6)))
    p = paras.join(n_pages.select("doc", "pages"), "doc").withColumn("per_", F.greatest(F.lit(1), F.ceil(F.col("pages") / g))).withColumn("at_", F.floor((F.col("page") - 1) / F.col("per_")))
    p = p.withColumn("chapter_no", F.dense_rank().over(Window.partitionBy("doc").orderBy("at_")))
    first, last = F.col("at_") * F.col("per_") + 1, F.least("pages", (F.col("at_") + 1) * F.col("per_"))
    name = F.concat(F.lit("Part "), F.col("chapter_no").cast("string"), F.lit(" (pp. "), first.cast("string"), F.lit("–"), last.cast("string"), F.lit(")"))
    return p.select("doc", "chapter_no", name.alias("chapter_title"), "para_no", "page", F.when(F.col("heading").isNotNull(), 2).alias("heading"), "text")


CHAPTERS = "doc string, chapter_no int, title string, first_page int, last_page int, chars int, paragraphs array<struct<heading:int,text:string,page:int>>"


def _fold(most: int):
    def run(doc: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, rows in doc.sort_values("para_no").groupby("chapter_no", sort=True):
            r = rows.to_dict("records")
            body = [{"heading": None if pd.isna(x["heading"]) else int(x["heading"]), "text": x["text"], "page": int(x["page"])} for x in r if x["heading"] != 0]
            pages = [x["page"] for x in body] or [int(x["page"]) for x in r]
            found.append({"title": r[0]["chapter_title"], "paragraphs": body, "first_page": min(pages), "last_page": max(pages)})
        size = lambda c: sum(len(x["text"]) for x in c["paragraphs"])

        def merge(i: int) -> None:
            """Chapters i and i + 1 become one under the title of the first; the second's title becomes a heading."""
            a, b = found[i], found[i + 1]
            mark = {"heading": 2, "text": b["title"], "page": b["first_page"]}
            found[i : i + 2] = [{"title": a["title"], "paragraphs": [*a["paragraphs"], mark, *b["paragraphs"]], "first_page": min(a["first_page"], b["first_page"]), "last_page": max(a["last_page"], b["last_page"])}]

        def merge_first() -> None:
            """The first chapter joins the second, behind its text and under the first's title; the second's title becomes a heading."""
            a, b = found[0], found[1]
            mark = {"heading": 2, "text": b["title"], "page": b["first_page"]}
            found[:2] = [{"title": a["title"], "paragraphs": [mark, *b["paragraphs"], *a["paragraphs"]], "first_page": min(a["first_page"], b["first_page"]), "last_page": max(a["last_page"], b["last_page"])}]

        i = 0
        while i < len(found) and len(found) > 1:
            if size(found[i]) >= 300:
                i += 1
            elif i:
                merge(i - 1)
            else:
                merge_first()
        while len(found) > most:
            sizes = [size(c) for c in found]
            both = [a + b for a, b in zip(sizes, sizes[1:])]
            merge(both.index(min(both)))
        found = [c for c in found if c["paragraphs"] or len(found) == 1]
        return pd.DataFrame([{"doc": doc["doc"].iloc[0], "chapter_no": k, "title": c["title"], "first_page": c["first_page"], "last_page": c["last_page"], "chars": size(c), "paragraphs": c["paragraphs"]} for k, c in enumerate(found, 1)], columns=[x.split()[0] for x in CHAPTERS.split(", ")[:6]] + ["paragraphs"])

    return run


def fold_chapters(parted: DataFrame, most: int = 60) -> DataFrame:
    """Chapters of documents from paragraphs with chapter_no: those under 300 characters join the one before (the first, the one after); of more than most, the smallest neighbours are joined. Numbered from 1."""
    return parted.groupBy("doc").applyInPandas(_fold(most), CHAPTERS)
