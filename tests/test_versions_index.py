"""Tables that change together, under failures at every step, and the index that follows its corpus against a rebuilt one."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import retrieval as R
from quillgraph.operators.index import Bm25Index
from quillgraph.sources.versions import Conflict, Versions


def test_versions(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "t"))
    assert v.current() == (0, {}) and v.read("a", "id long").count() == 0
    assert v.commit({"a": spark.range(3), "b": spark.range(2)}) == 1
    assert v.commit({"a": v.read("a", "id long").where("id > 0")}, append={"b": [v.stage(spark.range(5, 6))]}) == 2  # computed from what it replaces
    assert (v.read("a", "id long").count(), v.read("b", "id long").count(), v.read("b", "id long", 1).count(), v.read("a", "id long", 0).count()) == (2, 3, 2, 0)
    assert v.commit(drop=("b",)) == 3 and v.read("b", "id long").count() == 0
    v.vacuum(keep=1, age_s=-60)
    assert v.current()[0] == 3 and v.read("a", "id long").count() == 2 and len(list((tmp_path / "t" / "data").iterdir())) == 1
    # Numbers go on, so that a version's name is never used again.
    assert v.commit({"a": spark.range(9)}) == 4


@pytest.mark.parametrize("step", ["stage", "_note", "_move"])
def test_a_failure_at_each_step_leaves_the_old_version(spark, tmp_path, step, monkeypatch):
    v = Versions(spark, str(tmp_path / "t"))
    v.commit({"a": spark.range(3), "b": spark.range(2)})

    def fail(*_a, **_k):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(v, step, fail)
        with pytest.raises(OSError):
            v.commit({"a": spark.range(1), "b": spark.range(1)})
    assert v.current()[0] == 1 and v.read("a", "id long").count() == 3 and v.read("b", "id long").count() == 2
    assert v.commit({"a": spark.range(1)}) == 2 and v.read("a", "id long").count() == 1


def test_of_two_writers_one_begins_anew(spark, tmp_path):
    a, b = Versions(spark, str(tmp_path / "t")), Versions(spark, str(tmp_path / "t"))
    a.commit({"x": spark.range(1)})
    base = b.current()[0]
    a.commit({"x": spark.range(2)})
    with pytest.raises(Conflict):
        b.commit({"x": spark.range(3)}, base=base)
    fresh = b._note({"x": []})
    with pytest.raises(Conflict):  # the name is taken while the commit is under way
        b._move(fresh, 2)
    assert a.read("x", "id long").count() == 2


def _texts(rng, n):
    words = [f"w{i}" for i in range(60)] + ["소프트에러", "가"]
    return [" ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.randint(0, 30))) for _ in range(n)]


def _rows(df):
    return sorted((r["query_id"], r["doc_id"], r["score"], r["matched"]) for r in df.collect())


def test_index_equals_a_rebuild(spark, tmp_path):
    rng = random.Random(3)
    index, have = Bm25Index(spark, str(tmp_path / "i"), 4), {}
    queries = spark.createDataFrame([(1, "w0 w5 w59"), (2, "소프트에러 w1"), (3, "nothing"), (4, "")], "query_id long, text string")

    def check():
        docs = spark.createDataFrame([(i, t) for i, t in have.items()], "doc_id long, text string")
        assert _rows(index.search(queries, 1000)) == _rows(R.bm25(docs, queries))
        s = index.statistics().first()
        assert s["docs"] == len(have)

    assert index.search(queries).count() == 0
    for step in range(6):
        ids = rng.sample(range(40), 15)
        changes = dict(zip(ids, _texts(rng, 15)))
        for i in ids[:5]:
            changes[i] = None  # some of them aren't there
        if step == 3:
            changes = {i: None for i in have}
        index.update(spark.createDataFrame(list(changes.items()), "doc_id long, text string"))
        have = {i: t for i, t in (have | changes).items() if t is not None}
        if step == 4:
            index.compact()
        if have:
            check()
        else:
            assert index.search(queries).count() == 0 and index.statistics().first()["docs"] == 0
    assert index._postings(index.tables.current()[0]).groupBy("term").count().count() > 5
    # The same change again changes nothing that a search shows.
    index.update(spark.createDataFrame(list(have.items()), "doc_id long, text string"))
    check()


def test_an_update_that_fails_leaves_the_index(spark, tmp_path, monkeypatch):
    index = Bm25Index(spark, str(tmp_path / "i"), 2)
    index.update(spark.createDataFrame([(1, "a b"), (2, "a")], "doc_id long, text string"))
    q = spark.createDataFrame([(1, "a b")], "query_id long, text string")
    before = _rows(index.search(q))

    def fail(*_):
        raise OSError("lost")

    monkeypatch.setattr(index.tables, "_move", fail)
    with pytest.raises(OSError):
        index.update(spark.createDataFrame([(1, None), (3, "b b")], "doc_id long, text string"))
    monkeypatch.undo()
    assert _rows(index.search(q)) == before
    # Of several rows for one document the greatest text counts.
    index.update(spark.createDataFrame([(1, None), (1, "b"), (None, "x")], "doc_id long, text string"))
    docs = spark.createDataFrame([(1, "b"), (2, "a")], "doc_id long, text string")
    assert _rows(index.search(q)) == _rows(R.bm25(docs, q)) and index.parts(q).where(F.col("doc_id") == 3).count() == 0
