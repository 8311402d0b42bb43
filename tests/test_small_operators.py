"""Operators that no query registers, on worked cases; searches for many queries against brute force; plans of the largest operators."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.operators import chunking, graph, notes, rerank, search, structure, tools
from quillgraph.sources import sinks


def _rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_library_reads(spark):
    docs = spark.createDataFrame([("a", "2026-01-02", ["a2", "gone", "a1"]), ("b", "2026-01-03", []), ("c", "2026-01-02", ["c1"])], "doc string, created string, chapters array<string>")
    chapters = spark.createDataFrame([("a1", "a", "One"), ("a2", "a", "Two"), ("c1", "c", "See"), ("x1", "x", "Dangling")], "chapter string, doc string, title string")
    assert _rows(graph.newest(docs), "doc") == [("b",), ("a",), ("c",)]
    assert sorted(_rows(graph.ordered_chapters(docs, chapters), "doc", "pos", "title")) == [("a", 0, "Two"), ("a", 2, "One"), ("c", 0, "See")]
    texts = spark.createDataFrame([("a1", "t1"), ("c1", None)], "chapter string, text string")
    assert dict(_rows(graph.texts_of(chapters, texts, chapters.where("doc = 'a'")), "chapter", "text")) == {"a1": "t1", "a2": ""}
    assert dict(_rows(graph.texts_of(chapters, texts), "chapter", "text")) == {"a1": "t1", "a2": "", "c1": "", "x1": ""}
    assert {(r.source, r.target) for r in graph.contains(chapters, docs).collect()} == {("a", "a1"), ("a", "a2"), ("c", "c1")}


def test_nodes_of_a_view(spark):
    nodes = spark.createDataFrame([("d1", "document", "Paper", 3), ("k1", "keyword", "Deep Nets", 9), ("k2", "keyword", "nets", 2), ("c1", "chapter", "Intro", None)], "id string, kind string, label string, n int")
    assert sorted(_rows(graph.named(nodes, "NETS"), "id")) == [("d1",), ("k1",), ("k2",)]
    assert _rows(graph.focused(nodes, "deep nets"), "id") == [("k1",)] and _rows(graph.focused(nodes, "c1"), "id") == [("c1",)] and graph.focused(nodes, "none").count() == 0
    links = spark.createDataFrame([("d1", "k1"), ("k2", "d1"), ("c1", "d1"), ("d1", "k1")], "source string, target string")
    assert _rows(graph.adjacent(links, nodes, "d1"), "id") == [("k1",), ("k2",), ("c1",)] and _rows(graph.adjacent(links, nodes, "d1", 1), "id") == [("k1",)]
    refs = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.5), (1, "b", 0.9), (1, "", 1.0), (2, "a", 0.1)], "chapter int, term string, weight double")
    assert sorted(_rows(graph.best_refs(refs), "chapter", "rank", "term", "weight")) == [(1, 1, "b", 0.9), (1, 2, "a", 0.5), (2, 1, "a", 0.1)]


def test_keyword_nodes(spark):
    r = spark.createDataFrame([("d", 1, "a"), ("d", 2, "a"), ("e", 3, "a"), ("e", 3, "b")], "doc string, chapter long, term string").withColumn("weight", F.lit(1.0))
    ch = spark.createDataFrame([(1, "d", "x", 2), (2, "d", "y", 1), (3, "e", "y", 3)], "chapter long, doc string, category string, ord int")
    got = {x.term: (x.label, x.chapters, x.docs, x.n_chapters, x.category) for x in graph.keyword_nodes(r, ch, spark.createDataFrame([("a", "A")], "term string, label string")).collect()}
    assert got == {"a": ("A", [2, 1, 3], ["d", "e"], 3, "y"), "b": ("b", [3], ["e"], 1, "y")}


def test_chunk_reads(spark):
    c = spark.createDataFrame([(i, f"c{i}") for i in range(50)], "chunk_index int, chunk string")
    assert [r.chunk_index for r in chunking.show(c, 3).collect()] == [3, 4, 5, 6, 7] and chunking.show(c, 0, 99).count() == 20 and chunking.show(c, -5, 0).count() == 1
    cuts = spark.createDataFrame([(1, 0, "a" * 40, 0.2, False), (1, 1, "b" * 40 + "end", 0.9, True), (1, 2, "start" + "c" * 40, None, False)], "doc_id int, sent_no int, sentence string, dist double, cut boolean")
    assert _rows(chunking.boundary_snippets(cuts), "sent_no", "before", "after") == [(1, "b" * 27 + "end", "start" + "c" * 25)]
    pages = spark.createDataFrame([(1, "x" * 130), (2, " "), (3, None), (4, "short")], "page int, text string")
    r = chunking.page_report(pages).first()
    assert (r.pages, r.least, r.most, r.mean, r.thin, r.empty) == (4, 0, 130, 34, [4], [2, 3])


def test_searches_of_documents(spark):
    d = spark.createDataFrame([("a", "x" * 200 + " Beta and alpha"), ("b", "nothing"), ("c", "ALPHA first, beta last")], "doc string, text string")
    got = _rows(search.doc_search(d, "alpha beta"), "doc", "word", "snippet")
    assert [g[:2] for g in got] == [("a", "alpha"), ("c", "alpha")] and got[0][2].endswith("Beta and alpha") and search.doc_search(d, "alpha", 1).count() == 1 and search.doc_search(d, " ").count() == 0


def test_selections_and_columns(spark):
    paras = spark.createDataFrame([("d", i) for i in range(5)], "doc string, para_no int")
    picked = spark.createDataFrame([("d", "3", " Third ", 0), ("d", "3", "again", 1), ("d", "9", "none", 2), ("d", "1.5", "half", 3), ("d", "x", "no", 4), ("d", "1", "First", 5)], "doc string, para_no string, title string, ord int")
    assert sorted(_rows(structure.clean_selection(picked, paras), "para_no", "title")) == [(1, "First"), (3, "Third")]
    assert structure.two_columns(20, 10) and not structure.two_columns(9, 4) and not structure.two_columns(40, 36) and not structure.two_columns(20, 16)
    # Two columns with a line of full width between: left before it, right before it, the line, left and right after it.
    run = lambda y, x, s: ("d", 1, 0, s, float(x), x + 5.0 * len(s), float(y), 10.0, False, 600.0, 800.0)
    rows = [run(700 - 12 * k, x, f"{side}{k} of a column") for k in range(12) for side, x in (("left", 50), ("right", 330)) if k != 6] + [run(700 - 12 * 6, 50, "w" * 90)]
    random.Random(1).shuffle(rows)
    l = structure.lines(spark.createDataFrame(rows, "doc string, page int, run_no int, str string, x double, right double, y double, font_size double, bold boolean, width double, height double")).orderBy("line_no").collect()
    names = [r.text.split()[0] for r in l]
    assert names == [f"left{k}" for k in range(6)] + [f"right{k}" for k in range(6)] + ["w" * 90] + [f"left{k}" for k in range(7, 12)] + [f"right{k}" for k in range(7, 12)]


def test_runs_of_tools(spark):
    t = spark.createDataFrame([("x", "d", 0), ("y", "e", 1), ("x", "later", 2)], "name string, description string, ord int")
    roles = spark.createDataFrame([("boss", "x"), ("boss", "none"), ("clerk", "y")], "role string, name string")
    assert _rows(tools.of_role(t, roles, "boss"), "name", "description") == [("x", "d")]
    steps = spark.createDataFrame([("r", 2, 5, "b"), ("r", 1, None, "a"), ("r", 3, 7, "a"), ("r", 4, 1, None), ("s", 1, None, None)], "run_id string, seq int, tokens int, search string")
    assert sorted(_rows(tools.loop_totals(steps), "run_id", "steps", "tokens", "searches")) == [("r", 4, 13, ["a", "b"]), ("s", 1, 0, [])]
    runs = spark.createDataFrame([(5, 1.5, 1), (7, 0.5, None)], "calls int, latency double, failed int")
    assert rerank.column_stats(runs).first().asDict() == {"calls": 12, "latency": 1.5, "failed": 1}


def test_texts_for_people(spark):
    rows = spark.createDataFrame([(1, 2, 1, 1, True, True, "Y", 0.123456789, 0.5, "logprob", "t" * 80), (1, 1, 2, -1, False, False, "", None, None, "", None)], "query_id int, rank_before int, rank_after int, moved int, kept boolean, ok boolean, verdict string, score double, said double, score_source string, text string")
    assert [(r.verdict, r.score, len(r.head)) for r in rerank.report(rows).orderBy("rank_after").collect()] == [("Y", 0.123457, 60), ("?", None, 0)]
    hits = spark.createDataFrame([(1, 2, "b", 0, 4, "two"), (1, 1, "a", 3, 7, "one")], "query_id int, rank int, document string, page int, chunk_index int, text string")
    assert rerank.context(hits).first().context == "[근거 1] (a · p.3 · #7)\none\n\n[근거 2] (b · — · #4)\ntwo"
    assert spark.range(1).select(rerank.evidence_line(F.lit(0.75), F.lit(0.5)).alias("l")).first().l.count("0.2500") == 1
    assert _rows(sinks.document_list(spark.createDataFrame([("T", "n.md", "abc")], "title string, name string, text string")), "title", "name", "n_chars") == [("T", "n.md", 3)]
    names = spark.createDataFrame([("b",), ("a",), ("b",), ("",), (None,)], "document string")
    assert "- a\n- b\n" in sinks.names_block(names).first().block and "- " not in sinks.names_block(names.limit(0)).first().block
    assert spark.range(1).select(X.shorten(F.lit("x" * 9), 4).alias("s"), X.shorten(F.lit("x"), 4).alias("t")).first().asDict() == {"s": "xxxx …", "t": "x"}


def test_containing_equals_brute_force(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abé語") for _ in range(n))
    texts = [(i, word(rng.randint(0, 12))) for i in range(150)]
    needles = sorted({word(rng.randint(1, 5)) for _ in range(60)})
    got = sorted(_rows(search.containing(spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame(texts, "i int, s string")), "needle", "i"))
    assert got == sorted((n, i) for n in needles for i, t in texts if n in t)


def _score(full, words, term, label):
    low = label.lower()
    s = 0.0
    if full and full in (term, low):
        s += 5
    elif full and (full in term or full in low):
        s += 3
    for w in words:
        s += 2 if w in (term, low) else 1 if w in term or w in low else 0.8 if term in w and len(term) >= 2 else 0
    return round(s, 9)


def test_keyword_hits_of_many_queries(spark):
    rng = random.Random(6)
    terms = sorted({"".join(rng.choice(["net", "deep", "로", "graph", "a", " "]) for _ in range(rng.randint(1, 4))).strip() for _ in range(120)} - {""}) + ["x" * 70]
    keywords = [(t, t.upper() if i % 3 else f"Label {t}", "c", 1, i) for i, t in enumerate(terms)]
    queries = [(1, "deep net graph"), (2, "netgraph"), (3, "로로"), (4, ""), (5, None), (6, "zz"), (7, "y" + "x" * 80), (8, "a, deepnet; graph|a")]
    q = search.asked(spark.createDataFrame(queries, "query_id int, text string")).persist()
    k = spark.createDataFrame(keywords, "term string, label string, category string, n_chapters long, ord long")
    got = sorted((r.query_id, r.hit_rank, r.term, r.s) for r in search.keyword_hits(k, q).collect())
    want = []
    for r in q.collect():
        best = sorted((-s, o, t) for t, l, _, _, o in keywords if (s := _score(r.full, r.words, t, l)) > 0)[: search.HITS]
        want += [(r.query_id, i, t, -s) for i, (s, _, t) in enumerate(best, 1)]
    assert got == sorted(want) and {g[0] for g in got} >= {1, 2, 3, 7, 8}


def test_search_as_a_whole(spark):
    """Chapters, sources, related keywords, category, hybrid ranking and events of two queries and one that finds nothing."""
    ch = spark.createDataFrame([(1, "d1", "Doc One", "Deep Nets", "about deep nets", "ml", "Header\n\nThe Network learns. Deep nets are Network things.", 1), (2, "d1", "Doc One", "Graphs", "all on graphs", "math", "Graph Theory and Network flows, a Graph.", 2), (3, "d2", None, "Cooking", "no science", "food", "Bread and Butter.", 3)], "chapter long, doc string, doc_title string, title string, summary string, category string, text string, ord long")
    refs, keywords = search.stored(ch)
    q = search.asked(spark.createDataFrame([(1, "deep network"), (2, "graph"), (3, "qqqq")], "query_id int, text string"))
    hits = search.keyword_hits(keywords, q)
    sources = search.keyword_sources(ch, refs, hits, q)
    by = {(r.query_id, r.rank): r for r in sources.collect()}
    assert [by[1, i].chapter for i in (1, 2)] == [1, 2] and by[2, 1].chapter == 2 and (3, 1) not in by
    assert "Network" in by[1, 1].matched and by[1, 1].doc_title == "Doc One" and "Network learns" in by[1, 1].snippet
    cats = {r.query_id: r.category for r in search.result_category(sources, hits, q).collect()}
    assert cats == {1: "ml", 2: "math", 3: "misc"}
    rel = search.related_keywords(refs, keywords, hits).where("query_id = 2").collect()
    assert rel and all(r.term not in {h.term for h in hits.where("query_id = 2").collect()} for r in rel)
    chunks = spark.createDataFrame([(3, 3, "Header here\n\nBread is baked.", 0.9), (1, 2, "low", 0.2)], "query_id int, chapter long, text string, score double")
    h = {(r.query_id, r.rank): r for r in search.hybrid_rank(ch, refs, hits, sources, chunks, q).collect()}
    assert (h[3, 1].chapter, h[3, 1].score, h[3, 1].context, h[3, 1].snippet, h[3, 1].doc_title) == (3, 0.63, "Header here\n\nBread is baked.", "no science", "d2")
    assert h[1, 1].chapter == 1 and h[1, 1].context.startswith("Header") and h[1, 1].snippet == by[1, 1].snippet
    events = search.search_events("keyword", search.result_category(sources, hits, q), hits.select("query_id", "term", "s"), sources.select("query_id", "chapter", "score")).orderBy("run_id", "seq").collect()
    assert [(e.run_id, e.type) for e in events] == [(str(i), t) for i in (1, 2, 3) for t in ("category", "keywords", "sources", "done")] and events[-1].payload == '{"mode":"keyword","found":0}'


def test_notes_for_many_queries(spark):
    n = spark.createDataFrame([("m1", "회의 메모", "예산", "", 0), ("m2", None, "the Budget m1", "", 1)], notes.SCHEMA)
    q = spark.createDataFrame([(1, "회의 Budget"), (2, " m1 "), (3, "budget"), (4, None), (5, "예 예")], "query_id int, text string")
    assert sorted(_rows(notes.search_each(n, q), "query_id", "id")) == [(1, "m1"), (1, "m2"), (2, "m1"), (5, "m1")]


@pytest.mark.parametrize("name", ["kg_shares", "kg_cooccurrence"])
def test_plans_copy_no_rows(spark, name):
    """Pairs of light groups come from one join on the group, without copies of rows for salts."""
    from quillgraph.plans import catalog

    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
