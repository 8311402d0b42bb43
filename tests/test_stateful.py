"""Runs with state: order, stops, late and stale runs, over restarts from a checkpoint."""

import json

import pytest

from quillgraph.streaming import stateful as S


def _put(folder, name, rows, keys):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps({k: v for k, v in zip(keys, r) if v is not None}) for r in rows))


ENTRY, STOP = ("run_id", "at", "seq", "kind", "role", "payload"), ("run_id", "at", "seq")


def _t(minute):
    return f"2026-01-01T{minute // 60:02d}:{minute % 60:02d}:00Z"


@pytest.fixture
def log(spark, tmp_path):
    """Writes entries and marks, reads all there is, and gives the rows that are new since."""
    seen = []
    for d in ("entries", "stops"):
        (tmp_path / d).mkdir()

    def go(name, entries=(), stops=(), **options):
        if entries:
            _put(tmp_path / "entries", f"{name}.json", entries, ENTRY)
        if stops:
            _put(tmp_path / "stops", f"{name}.json", stops, STOP)
        # A new plan each time, as after a restart: all it knows comes from the checkpoint.
        e = spark.readStream.schema(S.ENTRIES).json(str(tmp_path / "entries"))
        s = spark.readStream.schema(S.STOPS).json(str(tmp_path / "stops"))
        rows = S.released(e, s, idle="10 minutes", keep="30 minutes", late="5 minutes", **options)
        out = sorted((r["run_id"], r["seq"], r["event"], r["payload"], r["entries"], r["delegations"], r["at_work"]) for r in S.run_until_read(rows, str(tmp_path / "out"), str(tmp_path / "state")).collect() for r in [r.asDict() | {"payload": r["payload"] or ""}])
        new = list(out)
        for r in seen:
            new.remove(r)
        seen[:] = out
        return new

    return go


def test_order_stops_and_stale_runs_over_restarts(log):
    got = log("1", [("a", _t(1), 1, "delta", None, "B"), ("a", _t(1), 0, "delegate", "x", "A"), ("a", _t(2), 3, "delta", None, "D"), ("b", _t(1), 0, "delegate", "y", "b0"), ("b", _t(1), 2, "delta", None, "b2"), ("c", _t(1), 0, "delegate", "z", "c0")])
    assert got == [("a", 0, "entry", "A", 1, 1, 1), ("a", 1, "entry", "B", 2, 1, 1), ("b", 0, "entry", "b0", 1, 1, 1), ("c", 0, "entry", "c0", 1, 1, 1)]
    # Restart: what waited is still there; a stop mark of the second stream ends b; c has an entry that was read before.
    got = log("2", [("a", _t(3), 2, "return", "x", "C"), ("b", _t(3), 1, "delta", None, "b1"), ("c", _t(2), 0, "delegate", "z", "c0")], [("b", _t(3), 1)])
    assert got == [("a", 2, "entry", "C", 3, 1, 0), ("a", 3, "entry", "D", 4, 1, 0), ("b", 1, "entry", "b1", 2, 1, 1), ("b", 1, "stopped", "", 2, 1, 1), ("b", 2, "ignored", "b2", 1, 1, 1), ("c", 0, "again", "c0", 1, 1, 1)]
    # Restart: time goes on with d, so a and c are stale (c with a gap before what waits); b is over; an entry behind the watermark of the last batch is late and left out.
    got = log("3", [("c", _t(4), 5, "delta", None, "c5"), ("b", _t(4), 3, "delta", None, "b3"), ("d", _t(30), 0, "done", None, "d0")])
    assert [r for r in got if r[0] in "bd"] == [("b", 3, "ignored", "b3", 2, 1, 1), ("d", 0, "done", "", 1, 0, 0), ("d", 0, "entry", "d0", 1, 0, 0)]
    assert [r for r in got if r[0] == "a"] == [("a", 3, "stale", "", 4, 1, 0)]
    assert [r for r in got if r[0] == "c"] == [("c", 5, "entry", "c5", 2, 1, 1), ("c", 5, "gap", "", 1, 1, 1), ("c", 5, "stale", "", 2, 1, 1)]
    # Late: older than the watermark (25 minutes). A run that is over stays so until its mark is forgotten.
    got = log("4", [("e", _t(10), 0, "delta", None, "late"), ("a", _t(31), 4, "delta", None, "stale"), ("f", _t(120), 0, "delegate", "x", "f0")])
    assert got == [("a", 4, "ignored", "stale", 4, 1, 0), ("f", 0, "entry", "f0", 1, 1, 1)]
    # All marks are forgotten by now, so the name may be used again.
    got = log("5", [("a", _t(121), 0, "error", None, "new")])
    assert got == [("a", 0, "entry", "new", 1, 0, 0), ("a", 0, "error", "", 1, 0, 0)]


def test_what_waits_is_bounded(log):
    got = log("1", [("a", _t(1), i, "delta", None, f"p{i:02d}") for i in range(5, 30)], most_waiting=8)
    # The gap is given up when nine wait; then every entry goes out as it comes.
    assert [r[2] for r in got if r[1] == 5] == ["entry", "gap"] and [r[3] for r in got if r[2] == "entry"] == [f"p{i:02d}" for i in range(5, 30)]
    assert log("2", [("a", _t(2), 2, "delta", None, "p02"), ("a", _t(2), 30, "done", None, "end")], most_waiting=8) == [("a", 2, "again", "p02", 25, 0, 0), ("a", 30, "done", "", 26, 0, 0), ("a", 30, "entry", "end", 26, 0, 0)]


def test_a_mark_without_a_place_stops_where_the_run_is(log):
    log("1", [("a", _t(1), 0, "delta", None, "0"), ("a", _t(1), 2, "delta", None, "2")])
    got = log("2", (), [("a", _t(2), None)])
    assert got == [("a", 0, "stopped", "", 1, 0, 0), ("a", 2, "ignored", "2", 1, 0, 0)]
    assert log("3", [("a", _t(3), 1, "delta", None, "1")]) == [("a", 1, "ignored", "1", 1, 0, 0)]
