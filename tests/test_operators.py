"""Operators on small worked cases: text, chunks, store, verdicts, notes, tools, graph, page structure, sinks, runs."""

import math

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.operators import chunking, graph, notes, rerank, retrieval, search, store, structure, tools
from quillgraph.sources import sinks
from quillgraph.streaming import runs


def one(spark, **exprs):
    return spark.range(1).select(*(e.alias(n) for n, e in exprs.items())).first()


def test_text(spark):
    v = F.create_map(F.lit("A"), F.lit("1"))
    r = one(
        spark, key=X.normalize_keyword(F.lit(" “(Soft  Error).” ")), words=X.query_tokens(F.lit("The a, Cat;cat/dog")), cid=X.parse_chapter_id(X.chapter_id(F.lit("doc__c1"), F.lit(12))), none=X.parse_chapter_id(F.lit("doc")),
        snip=X.snip(F.lit(" a \n b  cdef "), 4), cjk=X.has_cjk(F.lit("소프트")), latin=X.has_cjk(F.lit("soft")), utf=X.utf16_offset(F.lit("a😀b"), F.lit(2)), w=X.clamp_weight(F.lit("inf")), c=X.clamp(F.lit("99999"), 10, 2000, 400), bad=X.clamp(F.lit("x"), 10, 2000, 400),
        yes=X.lenient_bool(F.lit(" Yes ")), env=X.expand_vars(F.lit("${A}/${B}/${A}"), v), cites=X.citations(F.lit("a [2], b [1][2]")), blocks=X.markdown_blocks(F.lit("# t\n\na\nb\n\n\n### u")), server=X.server_of(F.lit("https://www.Ex-ample.com:80/x")),
        title=X.note_title(F.lit("first\nsecond")), nfc=X.nfc(F.lit("é")), terms=X.usable_terms(F.array(F.lit(" a "), F.lit(" "), F.lit("b" * 61))), tool=X.tool_text(F.array(F.struct(F.lit("text").alias("type"), F.lit("a").alias("text")), F.struct(F.lit("image").alias("type"), F.lit("b").alias("text"))), F.lit(True)),
        sse=X.sse_decode(F.concat(X.sse_encode(F.lit('{"a":1}')), F.lit(": ping\n\n"), X.sse_encode(F.lit("x")))), plain=X.plain_body(F.lit("## a\nb")),
    )
    assert (r.key, r.words, (r.cid["doc"], r.cid["index"]), r.none) == ("soft error", ["the", "cat", "dog"], ("doc__c1", 12), None)
    assert (r.snip, r.cjk, r.latin, r.utf, r.w, r.c, r.bad, r.yes) == ("a b  …", True, False, 3, 0.5, 2000, 400, True)
    assert (r.env.text, r.env.missing, r.cites, [b.kind for b in r.blocks], r.server.name, r.server.scheme) == ("1//1", ["B"], [2, 1], ["h1", "p", "h3"], "ex-ample-com", "https")
    assert (r.title, r.nfc, r.terms, r.tool, r.sse, r.plain) == ("first", "é", ["a"], "error: a", ['{"a":1}', "x"], "a\nb")


def test_sentences():
    cut = lambda t: [t[a:b] for a, b in chunking.sentence_spans(t)]
    assert cut("This sentence ends right here. And the value 3.5 is in rev05.pdf too! Done? yes") == ["This sentence ends right here.", "And the value 3.5 is in rev05.pdf too!", "Done? yes"]
    assert cut("one line that goes on\nin the next line of it") == ["one line that goes on\nin the next line of it"]
    assert cut("a first part of twenty five and more\n- item one of the list stands here") == ["a first part of twenty five and more", "- item one of the list stands here"]
    long = " ".join(["word"] * 200)
    assert all(b - a <= chunking.LONG for a, b in chunking.sentence_spans(long)) and "".join(cut(long)).replace(" ", "") == "word" * 200
    assert cut("x" * 500) == ["x" * 220, "x" * 220, "x" * 60] and chunking.sentence_spans(" \n") == chunking.sentence_spans(None) == []


def test_chunks(spark):
    assert chunking.paragraph("aa\n\nbbb\n\n\nc", 7) == [("aa\n\nbbb", 0), ("c", 10)] and chunking.paragraph("a" * 25, 10) == [("a" * 10, 0), ("a" * 10, 10), ("a" * 5, 20)]
    assert chunking.paragraph("a" * 21, 10) == [("a" * 10, 0), ("a" * 11, 10)]  # too short a tail stays
    text = "intro\n1.1 First\nbody of it\n1.2 Second\n" + "x" * 120
    assert [p for p, _ in chunking.structure(text, 100)] == ["intro\n1.1 First\nbody of it", "1.2 Second\n" + "x" * 89, "x" * 31]
    docs = spark.createDataFrame([(1, text), (2, None), (3, " ")], "doc_id long, text string")
    got = chunking.chunk(docs, "structure", 100).collect()
    assert [r.chunk_index for r in got] == [0, 1, 2] and all(text[r.start : r.start + 5] == r.chunk[:5] for r in got)
    with pytest.raises(ValueError):
        chunking.chunk(docs, "other")
    s = chunking.sentences(docs)
    v = s.select("doc_id", "sent_no", F.array(F.cos("sent_no"), F.sin("sent_no")).alias("vector"))
    chunks = chunking.semantic_chunks(docs, v, 50).orderBy("chunk_index").collect()
    assert chunks and "".join(c.chunk for c in chunks).replace("\n", "").replace(" ", "") == text.replace("\n", "").replace(" ", "")
    assert chunking.summarize(s.limit(0).select(F.lit(1).alias("n_chars"))).first().asDict() == {"n": 0, "least": 0, "most": 0, "mean": 0}


def test_store(spark):
    s = store.add(store.empty(spark), "d", spark.createDataFrame([(0, 1, "fixed", 1, "a", [1.0, 0.0]), (1, 1, "fixed", 1, "b", [0.0, 1.0])], "chunk_index int, page int, strategy string, n_chars int, text string, vector array<float>"))
    v = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.5, 0.5])], "chunk_index int, vector array<float>")
    more, totals = store.append_embedded(s, "d", spark.createDataFrame([(i, 1, "fixed", 1, t) for i, t in ((1, "b"), (2, "c"), (3, "d"))], "chunk_index int, page int, strategy string, n_chars int, text string"), v)
    assert totals.first().asDict() == {"before": 2, "added": 1, "replaced": 1, "without": 1, "after": 3} and {r.id for r in more.collect()} == {"d#0", "d#1", "d#2"}
    s = store.add_generated(s, spark.createDataFrame([("answer", [1.0, 1.0], "q" * 400, "bm25", "d#0", 7, "now")], "text string, vector array<float>, question string, engine string, based_on string, at long, created string"))
    got = {r.id: r for r in s.collect()}
    assert set(got) == {"d#0", "d#1", "gen#7"} and got["gen#7"].chunk_index == 2 and len(got["gen#7"].question) == 300
    kept, gone = store.clear_generated(s.withColumn("source", F.when(F.col("id") != "d#0", F.col("source"))))
    assert {r.id for r in kept.collect()} == {"d#0", "d#1"} and gone.first().removed == 1
    near = store.nearest(s, spark.createDataFrame([(1, [1.0, 0.1])], "query_id long, q array<float>"), 2, ~store.is_generated(), "id", "vector")
    assert [(r.rank, r.id) for r in near.orderBy("rank").collect()] == [(1, "d#0"), (2, "d#1")]
    with pytest.raises(ValueError):
        store.reset(spark)
    why = store.savable(spark.createDataFrame([(0, "semantic", "a long enough answer", 1), (1, "bm25", "a long enough answer ", 1), (2, "x", "short", 1), (3, "y", "a", 0)], "engine_ord int, engine string, text string, n_hits int"))
    assert [r.why for r in why.orderBy("engine_ord").collect()] == [None, "same", "short", "no_hits"]


def test_verdicts(spark):
    tokens = "array<struct<token:string,logprob:double,top:array<struct<token:string,logprob:double>>>>"
    rows = [(1, "Y 0.3", [("Y", -0.1, [("Y", math.log(0.6)), ("N", math.log(0.2))])], 1), (2, "N 0.10", None, 2), (3, "text", None, 3), (4, "y", None, 4)]
    r = rerank.judged(spark.createDataFrame(rows, f"doc int, raw string, tokens {tokens}, rank_before int").withColumn("tokens", rerank.with_probs(F.col("tokens"))).withColumn("query_id", F.lit(1)))
    r = rerank.rerank(r, 2)
    got = [(x.doc, x.rank_after, x.kept, x.score_source, x.score and round(x.score, 6)) for x in r.orderBy("rank_after").collect()]
    assert got == [(4, 1, True, "verdict", 1.0), (1, 2, True, "logprob", 0.6), (2, 3, False, "said", 0.1), (3, 4, False, "", None)]
    assert rerank.tallies(r).first().asDict() == {"query_id": 1, "calls": 4, "judged": 3, "failed": 1, "by_logprob": 1, "by_said": 1, "by_verdict": 1, "moved": 4}
    none = rerank.rerank(spark.createDataFrame([(1, i, False, None, 0.9) for i in (2, 1)], "query_id int, rank_before int, ok boolean, score double, said double"), 1)
    assert all(x.moved == 0 for x in none.collect()) and rerank.pool(5) == 10 and rerank.pool(20) == 20


def test_notes(spark):
    n = notes.assign_ids(spark.createDataFrame([("m2", "t", "회의 기록", "", 0), ("m2", "u", "b", "", 1), (None, "v", "c", "", 2), ("x", "w", "d", "", 3)], notes.SCHEMA))
    assert [r.id for r in n.orderBy("ord").collect()] == ["m2", "m1", "m3", "x"]
    assert {r.id for r in notes.search(n, "회의 메모").collect()} == {"m2"} and {r.id for r in notes.search(n, " x ").collect()} == {"x"} and notes.search(n).count() == 4
    more = notes.append(n, " new one\nbody ", used=9)
    assert more.where("id = 'm10'").first().title == "new one" and notes.update(n, "m1", "other").where("id = 'm1'").first().body == "other"
    assert notes.delete(n, "x").count() == 3
    with pytest.raises(notes.NoteLost):
        notes.guarded(n, n.where("id <> 'x'"))
    with pytest.raises(KeyError):
        notes.delete(n, "m77")


def test_put_keeps_a_table_whatever_fails(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    sinks.put(spark.range(3), path)
    moves = []
    real = sinks._rename
    for at in range(2):

        def move(s, a, b, at=at):
            moves.append(a)
            if len(moves) > at:
                raise OSError("lost")
            real(s, a, b)

        moves.clear()
        monkeypatch.setattr(sinks, "_rename", move)
        with pytest.raises(OSError):
            sinks.put(spark.range(9), path)
        monkeypatch.setattr(sinks, "_rename", real)
        sinks.settle(spark, path)
        assert spark.read.parquet(path).count() == 3
    sinks.put(spark.range(9), path)
    assert spark.read.parquet(path).count() == 9


def test_chapter_contents(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "01-a b.md").write_text("text")
    (tmp_path.parent / "secret.md").write_text("secret")
    c = spark.createDataFrame([(1, "d/01-a b.md"), (2, "../secret.md"), (3, "d/none.md"), (4, "/etc/x.md"), (5, None), (6, "d/../d/01-a b.md")], "chapter int, path string")
    assert {r.chapter: r.text for r in sinks.chapter_contents(spark, str(tmp_path), c).collect()} == {1: "text", 2: "", 3: "", 4: "", 5: "", 6: ""}


def test_packed_chapters(spark):
    p = chunking.packed
    assert p([("Head", True), ("aaaa", False), ("bbbb", False), ("cc", False)], "H", 10) == [("H\n\n[Head]\n\naaaa", 0, 0, 1), ("H\n\nbbbb\n\ncc", 2, 0, 3)]
    # Over twice the target: cut behind sentences, all marks kept, the rest opens the next chunk and counts.
    long = "One two?! Three four... Five six. Seven"
    assert p([("x", False), (long, False), ("tail", False)], "H", 12) == [("H\n\nx", 0, 0, 0), ("H\n\nOne two?!", 1, 0, 1), ("H\n\nThree four...", 1, 10, 1), ("H\n\nFive six.", 1, 24, 1), ("H\n\nSeven\n\ntail", 1, 34, 2)]
    assert "".join(c[0][3:] for c in p([(long, False)], "H", 12)).replace(" ", "") == long.replace(" ", "") and p([], "H", 5) == []
    rows = chunking.pack_chapters(spark.createDataFrame([("d", 1, "H", [(2, "Head"), (None, "body")]), ("d", 2, "H", None)], "doc string, chapter_no int, header string, paragraphs array<struct<heading:int,text:string>>"), 100).collect()
    assert [(r.chapter_no, r.chunk, r.last_para) for r in rows] == [(1, "H\n\n[Head]\n\nbody", 1)]


def test_semantic_report_and_cache(spark, tmp_path):
    text = "The first sentence says one thing here. The second sentence says it again here. " + "Quite another matter is told in this one, at length. " * 60
    docs = spark.createDataFrame([(1, text), (2, " "), (3, "Only one sentence stands in this text.")], "doc_id long, text string")
    s = chunking.sentences(docs)
    vectors = s.select("doc_id", "sent_no", F.when(F.col("sent_no") < 2, F.array(F.lit(1.0), F.lit(0.1) * F.col("sent_no"))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).alias("vector"))
    cache = chunking.SentenceCache(spark, str(tmp_path / "c"))
    assert cache.unknown(docs).count() == 3 and cache.put(docs, vectors) == 1 and cache.unknown(docs).count() == 0
    d = cache.distances(docs)
    r = {x.doc_id: x for x in chunking.semantic_report(docs, d, 1, docs.where("doc_id = 3")).collect()}
    spans = chunking.sentence_spans(text)
    assert (r[1].sentences, r[1].boundaries, r[1].cuts, r[1].cached, r[1].capped) == (len(spans), len(spans) - 1, 1, False, 1)
    assert r[1].distances[:2] == [0.005, 0.9005] and r[1].threshold == 0.3632  # between the two largest
    a, b = spans[1], spans[2]
    assert r[1].snippets[1] == [text[max(a[0], a[1] - 30) : a[1]].strip(), text[b[0] : min(b[1], b[0] + 30)].strip()]
    assert (r[2].sentences, r[2].cuts, r[2].distances, r[2].snippets, r[2].threshold) == (0, 0, [], [], 0.0) and (r[3].sentences, r[3].boundaries, r[3].cached) == (1, 0, True)
    chunks = chunking.chunks_of_distances(docs, d, 1).orderBy("doc_id", "chunk_index").collect()
    assert [(c.doc_id, c.capped) for c in chunks] == [(1, False), (1, True), (1, True), (3, False)] and chunks[0].chunk == text[: spans[1][1]]
    # A changed text needs vectors, the others don't.
    new = docs.withColumn("text", F.when(F.col("doc_id") == 3, "Another sentence stands here, and a second one. It is new.").otherwise(F.col("text")))
    assert [x.doc_id for x in cache.unknown(new).collect()] == [3]
    hits = spark.createDataFrame([(7, 1, text, 0.5), (8, 1, text, 0.999), (7, 2, " ", 0.1)], "query_id long, hit_id long, text string, base double")
    q = spark.createDataFrame([(7, [0.0, 1.0]), (8, [1.0, 0.0])], "query_id long, q array<double>")
    m = rerank.evidence(rerank.sentence_scores(hits, vectors.withColumnRenamed("doc_id", "hit_id"), q), ("query_id", "hit_id"))
    e = {(x.query_id, x.hit_id): (x.best_score, x.n_segments, x.n_marked, x.gain) for x in rerank.evidence_summary(m, ("query_id", "hit_id")).collect()}
    assert e == {(7, 1): (1.0, len(spans), len(spans) - 2, 0.5), (8, 1): (1.0, len(spans), 1, 0.001)}
    top = m.where("level = 'top'").orderBy("query_id").collect()
    assert [text[x.start : x.end] == x.sentence for x in top] == [True, True] and [x.sent_no for x in top] == [2, 0]


def test_clean_schemas(spark):
    import json

    from quillgraph.functions.schema import clean_schemas

    cases = {
        "flat": ({"type": "object", "title": "x", "properties": {"b": {"type": "string", "minLength": 3, "default": None}, "a": {"type": "integer", "default": 5}}, "required": ["a", 7]}, {"type": "object", "properties": {"a": {"type": "integer", "default": 5}, "b": {"type": "string"}}, "required": ["a", "7"]}),
        "union": ({"properties": {"t": {"anyOf": [{"type": "null"}, {"type": "array", "items": {"enum": ["x", 1], "$id": "q"}}], "default": None, "description": "d \"q\""}}}, {"type": "object", "properties": {"t": {"type": "array", "items": {"type": "string", "enum": ["x", 1]}, "description": 'd "q"'}}}),
        "deep": ({"type": "object", "properties": {"p": {"type": "object", "properties": {"q": {"items": {"properties": {"r": {"oneOf": [{"type": "number"}, {"type": "string"}]}}}}}}}}, {"type": "object", "properties": {"p": {"type": "object", "properties": {"q": {"type": "string", "items": {"type": "object", "properties": {"r": {"type": "number"}}}}}}}}),
        "only null": ({"anyOf": [{"type": "null"}], "oneOf": [{"type": "boolean", "description": "own"}], "description": "outer", "default": False}, {"type": "boolean", "description": "own", "default": False}),
        "empty": ({"type": "object"}, {"type": "object", "properties": {}}),
        "no object": (["a"], {"type": "string"}),
        "odd child": ({"type": "object", "properties": {"x": 5, "y": {}}}, {"type": "object", "properties": {"x": {"type": "string"}, "y": {"type": "string"}}}),
    }
    rows = [(n, json.dumps(c)) for n, (c, _) in cases.items()] + [("broken", "{")]
    got = {r.name: json.loads(r.schema) for r in clean_schemas(spark.createDataFrame(rows, "name string, schema string")).collect()}
    assert got == {n: w for n, (_, w) in cases.items()} | {"broken": {"type": "string"}}


def test_progress_of_a_stream(spark, tmp_path):
    from quillgraph.streaming import progress

    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text('{"id": 1}\n' * (i + 2))
    log = progress.ProgressLog(spark, str(tmp_path / "log"), "ingest", 9)
    spark.streams.addListener(log)
    try:
        s = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        q = s.writeStream.format("noop").queryName("ingest").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        for _ in range(100):
            rows = progress.progress(spark, str(tmp_path / "log")).orderBy("seq").collect()
            if rows and rows[-1].stage == "done":
                break
            import time

            time.sleep(0.2)
    finally:
        spark.streams.removeListener(log)
    assert [(r.stage, r.done, r.total) for r in rows if r.stage in ("start", "batch", "done")] == [("start", 0, 9), ("batch", 2, 9), ("batch", 5, 9), ("batch", 9, 9), ("done", 9, 9)]
    assert {r.stage for r in rows if r.batch == 1} >= {"plan", "write", "batch"} and all(r.ms is not None for r in rows if r.batch == 1)
    assert [(r.stage, r.done) for r in progress.shown(progress.progress(spark, str(tmp_path / "log"))).orderBy("seq").collect()] == [("start", 0), ("batch", 9), ("done", 9)]


def test_clamp_and_normal_form(spark):
    r = one(spark, nan=X.clamp(F.lit("NaN"), 10, 2000, 400), huge=X.clamp(F.lit("1e30"), 10, 2000, 400), low=X.clamp(F.lit("-1e30"), 10, 2000, 400), inf=X.clamp(F.lit("Infinity"), 10, 2000, 400), half=X.clamp(F.lit("12.7"), 10, 2000, 400))
    assert (r.nan, r.huge, r.low, r.inf, r.half) == (400, 2000, 10, 2000, 12)
    import unicodedata

    name = unicodedata.normalize("NFD", "소프트 에러.pdf")
    assert one(spark, s=X.slugify(F.lit(name))).s == "소프트-에러" and one(spark, q=X.query_tokens(F.lit(unicodedata.normalize("NFD", "가나 Über")))).q == ["가나", "über"]
    assert one(spark, c=X.composed(F.lit("plain")), d=X.composed(F.lit("Å"))).c == "plain"
    w = spark.createDataFrame([("shares", 2.0), ("shares", 90.0), ("contains", 5.0), ("cooccurs", 1.0), ("mentions", 9.0)], "k string, w double").select(graph.link_width(F.col("k"), F.col("w")).alias("x")).collect()
    assert [round(x.x, 6) for x in w] == [2.2, 5.0, 0.8, 0.7, 1.8]


def test_small_first_chapter(spark):
    rows = [("d", n, t, i, 1, None, "x" * k) for i, (n, t, k) in enumerate([(0, "Zero", 50), (1, "One", 400), (2, "Two", 100)])]
    c = structure.fold_chapters(spark.createDataFrame(rows, "doc string, chapter_no int, chapter_title string, para_no int, page int, heading int, text string")).collect()
    assert [(x.title, [(p.heading, len(p.text)) for p in x.paragraphs]) for x in c] == [("Zero", [(2, 3), (None, 400), (None, 50), (2, 3), (None, 100)])]


def test_running_headers_at_edges(spark):
    from quillgraph.operators import layout

    lines = spark.createDataFrame([("d", p, "journal #") for p in (1, 2, 3, 4)] + [("d", 1, "ab"), ("d", 2, "ab"), ("d", 3, "ab"), ("d", 4, "ab")], "doc string, page int, key string")
    got = layout.repeated_keys(lines, pages=spark.createDataFrame([("d", 10)], "doc string, pages int")).collect()
    assert [(r.key, r.on_pages, r.pages) for r in got] == [("journal #", 4, 10)]
    assert layout.repeated_keys(lines, pages=spark.createDataFrame([("d", 11)], "doc string, pages int")).count() == 0


def test_notes_file(spark, tmp_path):
    (tmp_path / "n.json").write_text('[{"title": "a", "body": "b"}, {"id": "m1", "title": "c", "body": "d"}]')
    (tmp_path / "bad.json").write_text('{"title": "a"}')
    assert [r.id for r in notes.read(spark, str(tmp_path / "n.json")).orderBy("ord").collect()] == ["m2", "m1"]
    assert notes.read_or_none(spark, str(tmp_path / "bad.json")).count() == notes.read_or_none(spark, str(tmp_path / "none.json")).count() == 0
    n = notes.append(notes.read(spark, str(tmp_path / "n.json")), "more")
    notes.write(n, str(tmp_path / "m.json"))
    assert notes.read(spark, str(tmp_path / "m.json")).count() == 3 and notes.reset(spark, str(tmp_path / "m.json"), str(tmp_path / "n.json")).count() == notes.read(spark, str(tmp_path / "m.json")).count() == 2
    assert '"id":"m2"' in notes.as_json(notes.read(spark, str(tmp_path / "n.json"))).first().json


def test_tools(spark):
    base, custom = spark.createDataFrame([("a", "A", "1"), ("b", "B", "2")], "name string, label string, spec string"), spark.createDataFrame([("b", "C", "3")], "name string, label string, spec string")
    t = spark.createDataFrame([("x", "b", "d", 0), ("x", "a", "e", 1), ("y", "b", "f", 2)], "name string, source string, description string, ord int")
    c = {r.name: r for r in tools.catalog(base, custom, spark.createDataFrame([("b",)], "name string"), t).collect()}
    assert (c["b"].spec, c["b"].custom, c["b"].connected, c["b"].n_tools, c["a"].n_tools) == ("3", True, True, 2, 1)
    o = tools.override(spark.createDataFrame([("x", "old")], "name string, description string"), "x", "new")
    assert {r.name: r.description for r in tools.described(tools.registry(t), o).collect()} == {"x": "new", "y": "f"} and tools.override(o, "x", " ").count() == 0


def test_merges_and_keywords(spark):
    r = spark.createDataFrame([("d", 1, "a", 0.5), ("d", 1, "b", 0.9), ("d", 2, "b", 0.4), ("e", 3, "c", 1.0)], "doc string, chapter long, term string, weight double")
    m = graph.apply_merges(r, spark.createDataFrame([("a", "b"), ("b", "c")], "from_term string, to_term string"))
    assert {(x.chapter, x.term, x.weight) for x in m.collect()} == {(1, "c", 0.9), (2, "c", 0.4), (3, "c", 1.0)}
    picked = spark.createDataFrame([("d", "LabelA", 0), ("d", "nowhere", 1)], "doc string, label string, ord int")
    k = graph.document_keywords(r, picked, spark.createDataFrame([("a", "labela")], "term string, label string"))
    assert [x.term for x in k.where("doc = 'd'").orderBy("rank").collect()] == ["a", "b"]
    assert {x.term for x in graph.new_terms(r, graph.known_terms(r, "d"), "d").collect()} == {"a", "b"} and [x.term for x in graph.repeated_terms(r, "d").collect()] == ["b"]


def test_related_and_snippet(spark):
    text = "x" * 150 + " The\n cat " + "y" * 300
    r = one(spark, s=search.snippet(F.lit(text), F.array(F.lit("cat"), F.lit("dog")), F.lit("f")), none=search.snippet(F.lit(text), F.array(F.lit("dog")), F.lit("fall")))
    assert r.s.startswith("…") and "The cat" in r.s and r.s.endswith("…") and r.none == "fall"
    asked = search.asked(spark.createDataFrame([(1, " “The Cat, a cat” ")], "query_id long, text string")).first()
    assert (asked.full, asked.words) == ("the cat, a cat", ["the", "cat"])
    docs = spark.createDataFrame([(1, "소프트에러 fitting fit", [("fit", True), ("소프", False), ("프트", False)])], "id long, text string, terms array<struct<term:string,top:boolean>>")
    assert [(x.start, x.end, x.top) for x in retrieval.merge_spans(retrieval.term_spans(docs)).orderBy("start").collect()] == [(0, 3, False), (14, 17, True)]


def test_structure(spark):
    run = lambda page, y, s, size=10.0, x=50.0, bold=False: ("d", page, 0, s, x, x + 5.0 * len(s), float(y), size, bold, 600.0, 800.0)
    body = lambda k: f"line {k} of the body of this chapter goes on to the margin of the page and is long enough to matter much"
    rows = [run(1, 750, "A Study of Things", 20.0)]
    for page, head in ((1, "1. First matter"), (2, "2. Second matter")):
        rows += [run(page, 700, head, 14.0), *(run(page, 680 - 12 * k, body(k)) for k in range(8)), run(page, 30, str(page))]
    r = spark.createDataFrame(rows, "doc string, page int, run_no int, str string, x double, right double, y double, font_size double, bold boolean, width double, height double")
    l = structure.without_running(structure.lines(r), spark.createDataFrame([], "doc string, key string"), X.repeat_key(F.col("text")))
    sizes = spark.createDataFrame([("d", 10.0)], "doc string, body_size double")
    assert l.where("text in ('1', '2')").count() == 0 and l.where("not full").count() == 3
    p = structure.paragraphs(l, sizes)
    assert [x.heading for x in p.orderBy("para_no").collect()].count(1) == 3
    title = structure.title(l.where("page = 1"), sizes, spark.createDataFrame([("d", "untitled", "file")], "doc string, meta_title string, fallback string"))
    assert title.first().title == "A Study of Things"
    chosen = structure.select_headings(structure.heading_candidates(p, sizes))
    assert [(x.title, x.method) for x in chosen.orderBy("para_no").collect()] == [("1. First matter", "numbered"), ("2. Second matter", "numbered")]
    c = structure.fold_chapters(structure.chapters_by_headings(p, chosen, sizes, title)).orderBy("chapter_no").collect()
    assert [(x.chapter_no, x.title, x.first_page) for x in c] == [(1, "1. First matter", 1), (2, "2. Second matter", 2)] and all(x.chars > 300 for x in c)
    by_pages = structure.chapters_by_pages(p, spark.createDataFrame([("d", 12)], "doc string, pages int"))
    assert {x.chapter_title for x in by_pages.collect()} == {"Part 1 (pp. 1–6)"}
    j = one(spark, a=structure.joined(F.array(*map(F.lit, ("exam-", "ple of", "글자", "한글")))), k=structure.numbered_kind(F.lit("2.1 Part")), t=structure.numbered_kind(F.lit("Chapter 4")), n=structure.numbered_kind(F.lit("words")))
    assert (j.a, j.k, j.t, j.n) == ("example of 글자한글", "sub", "top", "none")


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.put(spark.range(3), path)
    sinks.put(spark.read.parquet(path).where("id > 0"), path)  # computed from what it replaces
    assert spark.read.parquet(path).count() == 2 and sinks.read_store(spark, str(tmp_path / "none")).count() == 0
    g = sinks.read_graph(spark, str(tmp_path / "g"))
    assert all(t.count() == 0 for t in g.values())
    c = spark.createDataFrame([("d__c1", "d", 1, [("a", 0.5), ("b", 1.0)]), ("d__c2", "d", 2, [("a", 0.7), ("x", 1.0)])], "chapter string, doc string, index int, keywords array<struct<term:string,weight:double>>")
    k = spark.createDataFrame([("a", "A"), ("b", "B")], "term string, label string")
    assert sinks.write_graph({"chapters": c, "keywords": k}, spark, str(tmp_path / "g")) == 1
    edges = {(r.source, r.target, r.type): r.weight for r in sinks.read_graph(spark, str(tmp_path / "g"))["edges"].collect()}
    assert edges == {("d", "d__c1", "contains"): 1.0, ("d", "d__c2", "contains"): 1.0, ("d__c1", "a", "mentions"): 0.5, ("d__c1", "b", "mentions"): 1.0, ("d__c2", "a", "mentions"): 0.7, ("a", "b", "cooccurs"): 1.0}
    sinks.write_graph({"keywords": k.where("term = 'a'")}, spark, str(tmp_path / "g"))  # chapters stay, edges follow
    assert sinks.read_graph(spark, str(tmp_path / "g"))["edges"].where("target = 'b'").count() == 0
    files = [("../a.csv", "YWJj"), ("b.exe", "YWJj"), ("c.txt", "YW=Jj"), (".d.txt", "YQ=="), ("e.txt", "/w=="), ("f.txt", "YQ==")]
    u = {r.name: r for r in sinks.uploads(spark.createDataFrame(files, "name string, base64 string"), spark.createDataFrame([("f.txt",)], "name string")).collect()}
    assert (u["a.csv"].content, u["a.csv"].fault, u["b.exe"].fault, u["c.txt"].fault, u[None].fault, u["e.txt"].fault, u["f.txt"].fault) == ("abc", None, "ending", "base64", "name", "utf8", "exists")
    judged = sinks.uploads(spark.createDataFrame(files, "name string, base64 string"), spark.createDataFrame([], "name string"))
    (tmp_path / "up").mkdir()
    assert sinks.write_uploads(judged, str(tmp_path / "up")) == ["a.csv", "f.txt"] and (tmp_path / "up" / "a.csv").read_text() == "abc"
    assert sinks.delete_file(spark, str(tmp_path / "up" / "a.csv")) and not sinks.delete_file(spark, str(tmp_path / "up" / "a.csv"))
    c = spark.createDataFrame([("d", "Doc", 3, 'A "b" Title.', 1, 2, "misc", None, ["k"], [(2, "Head"), (None, "text")])], "doc string, doc_title string, index int, title string, first_page int, last_page int, category string, summary string, keywords array<string>, paragraphs array<struct<heading:int,text:string>>")
    m = sinks.chapter_markdown(c).first()
    assert m.name == "03-a-b-title.md" and m.text == '---\ndoc: "d"\ndocTitle: "Doc"\nchapter: 3\ntitle: "A \\"b\\" Title."\npages: [1,2]\ncategory: "misc"\nkeywords: ["k"]\n---\n\n# A "b" Title.\n\n## Head\n\ntext\n'
    d = spark.createDataFrame([("d", "Doc", "s.pdf", 2, "misc", ["k"], "now", "Sum")], "doc string, title string, source_file string, pages int, category string, keywords array<string>, created string, summary string")
    assert sinks.index_markdown(d, c).first().text.endswith('# Doc\n\nSum\n\n## 챕터\n\n3. [A "b" Title.](03-a-b-title.md) — p.1-2\n')
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.pdf").write_bytes(b"1234")
    assert [tuple(r) for r in sinks.listing(spark, str(tmp_path / "x")).collect()] == [("a.pdf", 4)]


def test_index_and_snapshots(spark):
    built = []
    index = runs.Index(lambda: spark.range(2), lambda c: built.append(1) or c)
    assert index.table().count() == index.table().count() == 2 and len(built) == 1
    index.invalidate()
    index.table()
    assert len(built) == 2
    log = spark.createDataFrame([("r", 0, "delegate", "a", True), ("r", 1, "return", "a", True), ("r", 2, "delegate", "b", True)], runs.LOG)
    assert runs.snapshots(log).first().asDict() == {"run_id": "r", "seq": 2, "state": "delegate", "delegations": 2, "at_work": 1}
    assert {(r.seq, r.returned) for r in runs.paired(log).collect()} == {(0, 1), (2, None)}
