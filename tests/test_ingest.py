"""A library kept up by differences against one built at once, from positioned runs; pairs over hot groups; nearest vectors."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import graph as G
from quillgraph.operators import ingest
from quillgraph.operators import nearest as NV
from quillgraph.operators.ingest import META, RUNS, Library
from quillgraph.operators.pairs import shared_pairs

WORDS = ["Alpha", "Beta", "Gamma", "Delta", "Entropy", "Kernel", "Lattice", "소프트", "Matrix", "Vector"]


def _doc(name, title, seed, chapters=3, pages=4):
    """Runs of a document: a title, chapters with numbered headings, a running header, page numbers."""
    rng = random.Random(seed)
    rows = []
    run = lambda page, y, s, size=10.0, x=50.0: rows.append((name, page, len(rows), s, x, x + 5.0 * len(s), float(y), size, False, 600.0, 800.0))
    run(1, 690, title, 20.0)
    for page in range(1, pages + 1):
        run(page, 780, f"Journal of tests {page}")
        run(page, 20, str(page))
        y = 660
        if page <= chapters:
            run(page, y, f"{page}. {rng.choice(WORDS)} and {rng.choice(WORDS)}", 14.0)
            y -= 20
        for k in range(12):
            run(page, y - 12 * k, f"{rng.choice(WORDS)} line {k} of the text that goes on to the margin of the page with {rng.choice(WORDS)} in it and more")
    return rows


def _frames(spark, docs):
    rows = [r for d in docs for r in _doc(*d)]
    return spark.createDataFrame(rows, RUNS), spark.createDataFrame([(d[0], None, f"{d[0]} file", d[4] if len(d) > 4 else 4) for d in docs], META)


def _all(library):
    out = {}
    for name in ("documents", "chapters", "refs", "keywords", "contains", "mentions", "cooccurs", "shares"):
        out[name] = sorted(map(str, library.read(name).collect()))
    return out


def test_ingest_equals_a_rebuild(spark, tmp_path):
    first = [("a", "Paper One", 1), ("b", "Paper Two", 2, 2), ("c", "Paper Three", 3)]
    second = [("b", "Paper Two", 7, 3), ("d", "Paper Four", 4), ("a2", "Paper One", 9, 2)]  # b anew, and a2 in place of a, whose title it has
    library = Library(spark, str(tmp_path / "x"), 4)
    library.ingest(*_frames(spark, first))
    assert library.read("chapters").count() == 8 and library.read("documents").where("title = 'Paper One'").count() == 1
    texts = " ".join(r["text"] for r in library.read("chapters").collect())
    assert "Journal of tests" not in texts and "line 3" in texts  # running headers are found from the lines at the edges
    version = library.ingest(*_frames(spark, second), batch=("s", 5))
    whole = Library(spark, str(tmp_path / "y"), 3)
    whole.ingest(*_frames(spark, [first[2], *second]))
    assert _all(library) == _all(whole)
    assert library.ingest(*_frames(spark, first), batch=("s", 5)) == version  # a batch that is tried again is done once
    library.delete(spark.createDataFrame([("paper-four",), ("none",)], "doc string"))
    assert sorted(r["doc"] for r in library.read("documents").collect()) == ["paper-one", "paper-three", "paper-two"]
    # Edges and keywords are those that a build over the refs and chapters that are left gives.
    refs, chapters = library.read("refs"), library.read("chapters")
    assert sorted(map(str, G.edges(refs, chapters).collect())) == sorted(map(str, library.edges().collect()))
    assert sorted(map(str, ingest._keywords(refs, chapters.select("chapter", "category")).collect())) == sorted(map(str, library.read("keywords").collect()))


def test_a_stream_of_runs(spark, tmp_path):
    docs = [("a", "Paper One", 1), ("b", "Paper Two", 2, 2)]
    (tmp_path / "in").mkdir()
    _, meta = _frames(spark, docs)
    library = Library(spark, str(tmp_path / "x"), 2)
    for i, d in enumerate([docs, [("b", "Paper Two", 5)]]):
        runs, _ = _frames(spark, d)
        runs.coalesce(1).write.json(str(tmp_path / f"one{i}"))
        for f in (tmp_path / f"one{i}").glob("*.json"):
            f.rename(tmp_path / "in" / f"{i}.json")
        library.follow(spark.readStream.schema(RUNS).json(str(tmp_path / "in")), meta, str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    whole = Library(spark, str(tmp_path / "y"), 2)
    whole.ingest(*_frames(spark, [docs[0], ("b", "Paper Two", 5)]))
    assert _all(library) == _all(whole)


def _brute_pairs(rows):
    groups = {}
    for item, group in set(rows):
        if item is not None and group is not None:
            groups.setdefault(group, set()).add(item)
    return Counter(p for g in groups.values() for p in itertools.combinations(sorted(g), 2))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_pairs_of_light_and_heavy_groups(spark, kind):
    rng = random.Random(2)
    items = range(300) if kind == "long" else [f"d{i}" for i in range(300)]
    rows = [(i, g) for i in items for g in rng.sample(range(40), 2)] + [(i, 100) for i in items if rng.random() < 0.6] + [(i, 101) for i in items] + [(None, 1), (items[0], None), (items[0], 101)]
    df = spark.createDataFrame(rows, f"item {kind}, grp int")
    for options in ({}, {"light": 50, "items": 32}, {"light": 10, "heavy": 3, "items": 64}):
        got = {(r["source"], r["target"]): r["weight"] for r in shared_pairs(df, "item", "grp", **options).collect()}
        assert got == _brute_pairs(rows)
    assert shared_pairs(df.limit(0), "item", "grp").count() == 0


def test_no_task_has_much_more_than_others(spark):
    """One term in a third of the documents."""
    df = spark.range(3000).select(F.col("id").alias("item"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 700 + 1).cast("int").alias("grp"))
    got = shared_pairs(df, "item", "grp", light=100, items=128)
    assert got.count() == sum(n * (n - 1) // 2 for n in Counter(0 if i % 3 == 0 else i % 700 + 1 for i in range(3000)).values())
    # Heavy pairs are dealt by pairs of blocks: see how many each makes.
    heavy = df.where("grp = 0").select(F.pmod(F.xxhash64("item"), F.lit(8)).alias("b")).groupBy("b").count().collect()
    sizes = sorted(r["count"] for r in heavy)
    assert sizes[-1] ** 2 <= 3 * sizes[len(sizes) // 2] ** 2


def _near(vectors, queries, k, allowed=lambda i: True):
    unit = lambda v: np.array(v) / n if (n := np.linalg.norm(v)) else np.zeros(len(v))
    out = []
    for q, v in queries:
        best = sorted((-float(f"{round(float(unit(v)[: len(w)] @ unit(w)[: len(v)]) + 0.0, 4):.4f}") + 0.0, i) for i, w in vectors if allowed(i))[:k]
        out += [(q, r, i, -s + 0.0) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_nearest_equals_brute_force(spark):
    g = np.random.default_rng(5)
    centers = g.normal(size=(12, 16)) * 4
    vectors = [(i, (centers[i % 12] + g.normal(size=16) * 0.3).tolist()) for i in range(1500)]
    vectors += [(2000 + i, vectors[7][1]) for i in range(60)] + [(3000, [0.0] * 16), (3001, [1.0, 2.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    queries = [v for v in vectors if v[0] % 50 == 0]
    q = spark.createDataFrame(queries, "query_id long, q array<double>")
    counter = spark.sparkContext.accumulator(0)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in NV.nearest(df, q, 10, pivots=24, few=0, counter=counter).collect())
    assert got == _near(vectors, queries, 10)
    assert counter.value < 0.7 * len(vectors) * len(queries)  # most blocks are passed over
    assert got == sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in NV.nearest(df, q, 10).collect())  # all rows against a few queries
    few = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in NV.nearest(df, q, 3, F.col("vec_id") >= 1999).collect())
    assert few == _near(vectors, queries, 3, lambda i: i >= 1999)
    for options in ({}, {"few": 0}):
        by = NV.nearest(df.withColumn("kind", F.col("vec_id") % 3), q, 1, group="kind", **options).collect()
        assert sorted((r["query_id"], r["kind"], r["vec_id"], r["score"]) for r in by) == sorted((a, i % 3, i, s) for kind in range(3) for a, _, i, s in _near(vectors, queries, 1, lambda i, kind=kind: i % 3 == kind))
    assert NV.nearest(df.limit(0), q, 3).count() == 0 and NV.nearest(df.limit(0), q, 3, few=0).count() == 0 and NV.nearest(df, q.limit(0), 3, few=0).count() == 0 and NV.nearest(df, q.limit(0), 3).count() == 0
    # Ids may be text.
    named = NV.nearest(df.select(F.concat(F.lit("v"), "vec_id").alias("id"), F.col("embedding").alias("vector")), q.where("query_id = 50"), 1, None, "id", "vector").first()
    assert named["id"] == "v50"
