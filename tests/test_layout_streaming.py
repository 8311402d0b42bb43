"""Layout statistics on worked cases, and streams against the same plans over tables."""

import json

from quillgraph.operators import layout as L
from quillgraph.streaming import runs as S


def _map(df, key, *values):
    return {r[key]: tuple(r[v] for v in values) for r in df.collect()}


def test_median_gap(spark):
    df = spark.createDataFrame([("a", 10.0), ("a", 14.0), ("a", 0.2), ("a", 99.0), ("b", None), ("c", 11.0), ("c", 11.0), ("c", 13.0)], "doc string, gap double")
    assert _map(L.median_gap(df), "doc", "median_gap") == {"a": (14.0,), "b": (12.0,), "c": (11.0,)}
    assert L.median_gap(df.limit(0)).count() == 0


def test_body_size(spark):
    df = spark.createDataFrame([("a", 0, 9.9, "abc"), ("a", 1, 12.1, "abc"), ("b", 0, None, "abc"), ("c", 0, 8.0, "ab"), ("c", 1, 11.0, "abcd"), ("d", 0, 8.0, None)], "doc string, run_no int, font_size double, str string")
    assert _map(L.body_size(df), "doc", "body_size") == {"a": (10.0,), "b": (10.0,), "c": (11.0,), "d": (10.0,)}


def test_repeated_keys(spark):
    rows = [("a", p, "head") for p in (1, 2, 2)] + [("a", p, f"own{p}") for p in (1, 2, 3)] + [("b", p, "head") for p in (1, 2)] + [("a", 3, None)]
    df = spark.createDataFrame(rows, "doc string, page int, key string")
    assert [(r["doc"], r["key"], r["on_pages"], r["pages"]) for r in L.repeated_keys(df).collect()] == [("a", "head", 2, 3)]


def test_segment_font(spark):
    df = spark.createDataFrame([("a", 10.0, True, "abcdefg"), ("a", 20.0, False, "abc"), ("b", 10.0, None, "abc"), ("c", 10.0, True, "")], "segment string, font_size double, bold boolean, str string")
    assert _map(L.segment_font(df), "segment", "size", "bold") == {"a": (13.0, True), "b": (10.0, False), "c": (None, False)}


def _drain(df, name):
    q = df.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(60)
    return df.sparkSession.table(name)


def test_streams_end_as_tables_do(spark, tmp_path):
    log = [[{"run_id": "r1", "seq": 0, "kind": "delegate", "ok": True}, {"run_id": "r2", "seq": 5, "kind": "error", "ok": False}], [{"run_id": "r1", "seq": 2, "kind": "done", "ok": True}, {"run_id": "r1", "seq": 1, "kind": "delegate", "ok": None}]]
    events = [[{"run_id": "r1", "seq": 2, "type": "delta", "payload": "b"}, {"run_id": "r1", "seq": 0, "type": "category", "payload": "x"}], [{"run_id": "r1", "seq": 1, "type": "delta", "payload": "a"}, {"run_id": "r1", "seq": 3, "type": "done", "payload": None}, {"run_id": "r2", "seq": 0, "type": "error", "payload": "e"}]]
    for name, parts in (("log", log), ("events", events)):
        (tmp_path / name).mkdir()
        for i, part in enumerate(parts):
            (tmp_path / name / f"{i}.json").write_text("\n".join(map(json.dumps, part)))
    states = _drain(S.run_states(S.follow(spark, str(tmp_path / "log"), S.LOG, 1)), "states")
    assert _map(states, "run_id", "state", "entries", "delegations", "failed") == {"r1": ("done", 3, 2, 0), "r2": ("error", 1, 0, 1)}
    folded = _drain(S.fold_events(S.follow(spark, str(tmp_path / "events"), S.EVENTS, 1)), "folded")
    want = {"r1": ("x", "ab", True, None), "r2": (None, "", False, "e")}
    assert _map(folded, "run_id", "category", "answer", "done", "error") == want
    table = spark.read.schema(S.EVENTS).json(str(tmp_path / "events"))
    assert _map(S.fold_events(table), "run_id", "category", "answer", "done", "error") == want
    assert set(_map(S.fold_events(table, "r1"), "run_id", "done")) == {"r1"}
