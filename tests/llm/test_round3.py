"""Tests of what round 3 found in the training-data operators."""

import random

from pyspark.sql import functions as F

from quillgraph.llm import pii, simhash


def test_near_dedup_has_fingerprints(spark, monkeypatch):
    """Candidates of near dedup come from fingerprints of five-word shingles by op9's signatures; those that the whole sets bear out are links before any prefix is looked at."""
    rng = random.Random(9)
    base = [[f"w{rng.randrange(4000)}" for _ in range(400)] for _ in range(6)]
    rows = [" ".join([*w[:i], f"edit{i}", *w[i + 1 :]]) for w in base for i in (5, 100, 399)] + ["one two", "One  two", "", None]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    asked, first = [], []
    monkeypatch.setattr(simhash, "links", lambda nodes, f=simhash.links: asked.append({r[0] for r in nodes.collect()}) or f(nodes))
    monkeypatch.setattr(simhash, "components", lambda edges, f=simhash.components: first.append({(r.u, r.v) for r in edges.collect()}) or f(edges))
    got = {r.doc_id: r.component_id for r in simhash.similar_classes(df.coalesce(1)).collect()}
    prints = [simhash.majority_bits(simhash.hashes(t, 5)) for t in rows]
    assert asked == [{p - (1 << 64) if p >> 63 else p for p in prints}]
    sets = [set(simhash.shingles(t).tolist()) for t in rows]
    assert first[0] and all((prints[u] ^ prints[v]).bit_count() <= 4 and 5 * len(sets[u] & sets[v]) >= 4 * len(sets[u] | sets[v]) for u, v in first[0])
    assert got == {i: i - i % 3 if i < 18 else 18 if i < 20 else 20 for i in range(22)}


def test_filter_follows_its_terms(spark):
    """However many terms disclose, all of them pass the tasks' filter, and few other words do."""
    n = 300_000
    bits = pii.filter_of(spark.range(n, numPartitions=4).select(F.concat(F.lit("é가t"), "id").alias("t_")), "t_")
    assert len(bits) * 8 >= 16 * n
    assert all(pii._in(bits, f"é가t{i}") for i in range(0, n, 7))
    assert sum(pii._in(bits, f"é가u{i}") for i in range(20_000)) < 600
    assert not pii._in(pii.filter_of(spark.range(0).select(F.col("id").cast("string").alias("t_")), "t_"), "a")
