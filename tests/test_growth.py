"""Tests of what round 3 found: work that grew faster than its input."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text
from quillgraph.operators import chunking, pairs, rerank, search


def test_evidence_of_all_is_evidence_of_each(spark):
    """In matrix products, what evidence gives row by row: shorter, null and zero vectors, ties at the base, null hits; and no plan that pairs rows."""
    rng = random.Random(5)
    rows = [(i, rng.choice([0, 1, 2, None]), [rng.uniform(-1, 1) for _ in range(rng.choice([4, 4, 3]))]) for i in range(400)] + [(400, 1, None), (401, 3, [0.0] * 4), (402, 4, [-1.0, 0.0, 0.0, 0.0]), (403, 0, [1.0, None, 0.5, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    q = v.where("vec_id % 50 = 1 or vec_id in (401, 402)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    for base in (0.1, -0.2):
        s = v.crossJoin(q).select("query_id", F.col("label").alias("hit_id"), F.col("vec_id").alias("sent_no"), F.round(text.cosine(F.col("embedding").cast("array<double>"), F.col("q").cast("array<double>")), 4).alias("score"), F.lit(base).alias("base"))
        want = rerank.evidence_summary(rerank.evidence(s, ("query_id", "hit_id")), ("query_id", "hit_id"))
        got = rerank.evidence_of_all(v, q, base, "label")
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_evidence_marks_pairs_no_rows(spark):
    from quillgraph.plans import catalog

    plan = catalog.evidence_marks(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("most", [100_000, 5])
def test_containing_is_brute_force(spark, monkeypatch, most):
    """With all grams in the tasks, and with a join picking them."""
    rng = random.Random(3)
    monkeypatch.setattr(search, "GRAMS", most)
    texts = ["".join(rng.choice("abc가나 ") for _ in range(rng.randrange(30))) for _ in range(700)] + [None, "", "😀ab"]
    needles = {"".join(rng.choice("abc가나 ") for _ in range(rng.randrange(1, 7))) for _ in range(40)} | {"😀", "zz", "나가나가나가"}
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, s string").withColumn("x", F.col("id") % 3)
    got = search.containing(spark.createDataFrame([(n,) for n in needles], "needle string"), rows)
    assert got.columns == ["needle", "id", "x"]
    assert sorted(got.select("needle", "id").collect()) == sorted((n, i) for n in needles for i, t in enumerate(texts) if t and n in t)
    assert search.containing(spark.createDataFrame([], "needle string"), rows).count() == 0


def test_notes_are_not_broadcast(spark):
    from quillgraph.plans import catalog

    plan = catalog.notes_search(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [id#" not in plan and "BroadcastHashJoin [key#" not in plan


@pytest.mark.parametrize("kind", ["long", "string"])
def test_pairs_come_whole_from_split_batches(spark, monkeypatch, kind):
    """Groups over several Arrow batches, rows that repeat, and more pairs than leave a task at once."""
    monkeypatch.setattr(pairs, "ROWS", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rng = random.Random(4)
        rows = [(i if kind == "long" else f"é{i}", rng.randrange(40)) for i in range(60) for _ in range(8)] + [(1 if kind == "long" else "é1", 99)]
        got = {(r.source, r.target): r.weight for r in pairs.shared_pairs(spark.createDataFrame(rows, f"item {kind}, grp int"), "item", "grp").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups = {}
    for item, g in set(rows):
        groups.setdefault(g, set()).add(item)
    assert got == Counter(p for g in groups.values() for p in itertools.combinations(sorted(g), 2))


@pytest.mark.parametrize("name", ["top_terms", "kg_cooccurrence", "kg_edges", "kg_edge_rows", "kg_keyword_index", "kg_neighbors", "kg_nodes", "kg_shares", "kg_view", "kg_view_links", "document_keywords"])
def test_partitions_follow_the_rows(spark, monkeypatch, name):
    """Where a task has so many rows at most, large tables are dealt to more tasks than there are shuffle partitions."""
    from quillgraph.plans import catalog

    asked = []
    monkeypatch.setattr(catalog, "parts", lambda rows, *each: asked.append(rows) or pairs.parts(rows, *each), raising=False)
    catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert max(asked, default=0) >= spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert pairs.parts(216_000_000) > 800 and pairs.parts(0) == 1


def test_chunks_leave_a_task_in_slices(spark):
    """However many rows an Arrow batch has, Python takes a few texts apart at once."""
    import pyarrow as pa

    n = 3 * chunking.SLICE + 5
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(["1.1 a b.\n" * 3] * n)], ["doc_id", "text"])
    got = list(chunking._slices([batch]))
    assert [b.num_rows for b in got] == [chunking.SLICE] * 3 + [5] and pa.Table.from_batches(got).equals(pa.Table.from_batches([batch]))
    df = spark.createDataFrame([(i, "1.1 a b.\n" * (i % 4)) for i in range(n)], "doc_id long, text string").coalesce(1)
    rows = chunking.chunk(df, "structure", 800).collect()
    assert [r.doc_id for r in rows] == [i for i in range(n) if i % 4] and all(r.chunk_index == 0 for r in rows)


def test_index_tasks_follow_the_rows(spark, tmp_path, monkeypatch):
    """A bucket's postings are several tasks' where there are many, texts are counted where they are, and searches give the same."""
    from quillgraph.operators import index, retrieval

    for name in ("TEXTS", "FORWARD", "POSTINGS"):
        monkeypatch.setattr(index, name, 8)
    monkeypatch.setattr(index, "PARTS", 1)
    docs = spark.createDataFrame([(i, " ".join(f"w{i * k % 23}" for k in range(i % 9))) for i in range(60)] + [(60, "소프트에러 가 ABC abc")], "doc_id long, text string")
    i = index.Bm25Index(spark, str(tmp_path / "i"), 2)
    i.update(docs)
    files = [p for p in (tmp_path / "i" / "data").glob("*/bucket_=0/*.parquet")]
    assert len(files) > 3
    q = spark.createDataFrame([(1, "w1 w2 abc"), (2, "프트")], "query_id long, text string")
    want = sorted(map(str, retrieval.bm25(docs, q).collect()))
    assert sorted(map(str, i.search(q, 100).select("query_id", "doc_id", "score", "matched").collect())) == want
    assert i.parts(q).rdd.getNumPartitions() > 4
    i.update(docs.where("doc_id < 30"))
    i.compact()
    assert sorted(map(str, i.search(q, 100).select("query_id", "doc_id", "score", "matched").collect())) == want


def test_frequency_keywords_pass_a_text_once(spark):
    """What needs normal form C is told by one run from a text's start, and words found in a text aren't normalised one by one; keywords are as before."""
    rng = random.Random(8)
    made = ["".join(rng.choice("aZé가\n😀́̈漢 -가") for _ in range(rng.randrange(12))) for _ in range(800)] + ["", None, "a\n", "\ń"]
    df = spark.createDataFrame([(s,) for s in made], "s string")
    assert [r[0] for r in df.coalesce(1).select(text.composed(F.col("s"))).collect()] == [s and __import__("unicodedata").normalize("NFC", s) for s in made]
    c = spark.createDataFrame([(1, "“Alpha”, beta: (The) 42", "Gamma gamma Gamma 소프트에러 Delta_x Alpha Cafés 소프트에러 가\n(Delta)."), (2, None, "Omega"), (3, "Omega", None)], "chapter long, title string, text string")
    got = sorted((r.chapter, r.pos, r.term, r.label, r.weight) for r in search.frequency_keywords(c).collect())
    assert got == [(1, 1, "alpha", "“Alpha”", 1.0), (1, 2, "beta", "beta", 0.8), (1, 3, "gamma", "Gamma", 0.4), (1, 4, "소프트에러", "소프트에러", 0.4), (1, 5, "delta", "Delta", 0.2), (2, 1, "omega", "Omega", 1.0), (3, 1, "omega", "Omega", 1.0)]
    plan = search.frequency_keywords(c)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE(" in plan.upper() and plan.count("*+\\z") == plan.upper().count("RLIKE(") - plan.count("^[0-9]+$")
