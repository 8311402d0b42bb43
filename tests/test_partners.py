"""Tests of what round 4 found: pairs of documents that went to disk."""

import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillgraph.operators import pairs


def _brute(rows):
    groups = {}
    for item, g in set(rows):
        if item is not None and g is not None:
            groups.setdefault(g, set()).add(item)
    return Counter(p for g in groups.values() for p in itertools.combinations(sorted(g), 2))


def _ends(made):
    n, shared = Counter(), Counter()
    for p, w in made.items():
        for item in p:
            n[item] += 1
            shared[item] += w
    return {i: (n[i], shared[i]) for i in n}


@pytest.mark.parametrize("name", ["kg_shares", "kg_edges", "kg_cooccurrence"])
def test_pairs_are_not_shuffled(spark, name):
    from quillgraph.plans import catalog

    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [block" in plan and "RepartitionByExpression [source" not in plan


@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_partners_are_brute_force(spark, monkeypatch, kind):
    """Many blocks and few, groups over blocks, batches and tasks, heavy groups, rows that repeat, nulls, whole numbers from end to end."""
    rng = random.Random(6)
    item = {"long": lambda i: [-(2**63), 2**63 - 1, -5, 0][i] if i < 4 else rng.choice([1, 2**40]) * i, "int": lambda i: i * 7 - 900, "string": lambda i: f"é{i}"}[kind]
    items = [item(i) for i in range(250)]
    rows = [(i, g) for i in items for g in rng.choices(range(90), k=5)] + [(items[3], 200), (None, 1), (items[0], None), (items[5], 201), (items[6], 201)]
    df = spark.createDataFrame(rows, f"item {kind}, grp int")
    made = _brute(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for block, light in ((pairs.BLOCK, 256), (400, 256), (800, 12)):
            monkeypatch.setattr(pairs, "BLOCK", block)
            monkeypatch.setattr(pairs, "ROWS", 300)
            got = {r.item: (r.partners, r.shared) for r in pairs.shared_counts(df, "item", "grp", light=light).collect()}
            assert got == _ends(made)
            found = pairs.shared_pairs(df, "item", "grp", light=light)
            assert found.schema["source"].dataType == df.schema["item"].dataType
            assert {(r.source, r.target): r.weight for r in found.collect()} == made
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert pairs.shared_counts(df.limit(0), "item", "grp").count() == 0 and pairs.shared_counts(df.where("grp = 200"), "item", "grp").count() == 0


def _table(groups):
    rows = sorted((g, i) for g, own in enumerate(groups) for i in own)
    return [pa.RecordBatch.from_pydict({"g": [g for g, _ in rows], "item": [i for _, i in rows]})]


def test_a_pair_costs_few_bytes_and_is_held_once(monkeypatch):
    """Groups dealt over all blocks cost under three bytes a pair (a row of a pair has 32), groups in one block a few bytes an item; a block's pairs are added up part by part."""
    monkeypatch.setattr(pairs, "BLOCK", 1000)
    rng = random.Random(7)
    lows = np.arange(0, 1 << 20, 1 << 13)
    wide = [rng.sample(range(1 << 20), 30) for _ in range(2000)]
    near = [rng.sample(range(b, b + (1 << 13)), 30) for b in lows.tolist() for _ in range(20)]
    size = lambda groups: sum(len(x) for b in pairs._sent(lows)(_table(groups)) for x in b.column("sent").to_pylist())
    assert size(wide) < 3 * 2000 * 30 * 29 / 2 and size(near) < 4 * 30 * len(near)
    some = wide[:40] + near[:300] + wide[:10]
    got = Counter()
    for b in pairs._sent(lows)(_table(some)):
        for o in pairs._pairs_of(lows)([b]):
            got.update({(x["source"], x["target"]): x["weight"] for x in o.to_pylist()})
    assert got == Counter(p for g in some for p in itertools.combinations(sorted(set(g)), 2))
