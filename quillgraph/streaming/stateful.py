"""Logs of runs followed with state for each run: entries go out once and in order, runs end, and what a run holds is bounded.

A run's entries (run_id, at, seq, kind, role, payload) are numbered by seq without gaps; files may bring them in any order and more than once. A second stream has stop marks (run_id, at, seq): the run may go no further than seq (a null seq: no
further than it has come). Each released entry is a row; so the pieces of an answer leave the state as soon as the pieces before them are there, and the answer is what the rows hold. State of a run: a few
counters, entries that wait for earlier ones (MOST_WAITING at most; then the gap is given up), and, once it is over, a mark that it is, kept for a while and then forgotten.

Rows come out as (run_id, seq, event, kind, role, payload, entries, delegations, at_work):

- entry: the next entry; counters as of then.
- gap: entries from here on came after others that never arrived; seq is the first one that is there.
- again: an entry that had been released before; it counts for nothing.
- ignored: an entry or a stop mark of a run that is over, or beyond its stop mark.
- done, error, stopped, stale: the run is over. Stale runs have had no entry for idle.

Time is that of the entries (at). What is older than the watermark, late behind the latest entry seen, is left out by Spark, as it always is. A restarted query goes on from its checkpoint: state, timers and what files were read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ENTRIES = "run_id string, at timestamp, seq int, kind string, role string, payload string"
STOPS = "run_id string, at timestamp, seq int"
RELEASED = "run_id string, seq int, event string, kind string, role string, payload string, entries long, delegations long, at_work long"
MOST_WAITING = 1000
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RunLog(StatefulProcessor):
    """The state of one run. idle, keep: milliseconds until a run is stale, and until its end is forgotten."""

    def __init__(self, idle: int, keep: int, first: int = 0, most_waiting: int = MOST_WAITING):
        self.idle, self.keep, self.first, self.most_waiting = idle, keep, first, most_waiting

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "next int, entries long, delegations long, at_work long, timer long")
        self.waiting = handle.getMapState("waiting", "seq int", "kind string, role string, payload string")
        self.stop = handle.getValueState("stop", "seq int")
        self.over = handle.getValueState("over", "reason string")

    def _row(self, run: str, seq, event: str, head: list, kind=None, role=None, payload=None) -> Row:
        return Row(run_id=run, seq=seq, event=event, kind=kind, role=role, payload=payload, entries=head[1], delegations=head[2], at_work=head[3])

    def _timer(self, head: list, at: int) -> None:
        if head[4] > 0:
            self.handle.deleteTimer(head[4])
        head[4] = at
        self.handle.registerTimer(at)

    def _end(self, run: str, head: list, waiting: dict, reason: str, now: int) -> Iterator[Row]:
        yield self._row(run, head[0] - 1, reason, head)
        for seq in sorted(waiting):
            yield self._row(run, seq, "ignored", head, *waiting[seq])
            self.waiting.removeKey((seq,))
        waiting.clear()
        self.over.update((reason,))
        self.stop.clear()
        self._timer(head, now + self.keep)

    def _release(self, run: str, head: list, waiting: dict, stop: int | None, now: int, all_of_it: bool = False) -> Iterator[Row]:
        """What is next, and after a gap what there is, if it has to go out."""
        while waiting and not self.over.exists() and (stop is None or head[0] <= stop):
            if head[0] not in waiting:
                if not all_of_it and len(waiting) <= self.most_waiting:
                    return
                head[0] = min(waiting)
                if stop is not None and head[0] > stop:
                    return
                yield self._row(run, head[0], "gap", head)
            entry = waiting.pop(head[0])
            self.waiting.removeKey((head[0],))
            kind, seq = entry[0], head[0]
            head[0], head[1] = seq + 1, head[1] + 1
            head[2] += kind == "delegate"
            head[3] += (kind == "delegate") - (kind == "return")
            yield self._row(run, seq, "entry", head, *entry)
            if kind in ("done", "error"):
                yield from self._end(run, head, waiting, kind, now)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        (run,) = key
        head = list(self.head.get()) if self.head.exists() else [self.first, 0, 0, 0, -1]
        stop = self.stop.get()[0] if self.stop.exists() else None
        waiting = {k[0]: tuple(v) for k, v in self.waiting.iterator()}
        over, latest = self.over.exists(), -1
        # Marks, entries in the order of their numbers, marks without one: a batch gives the same whatever the order within it.
        for r in sorted(rows, key=lambda r: (2 if r["seq"] is None else 0 if r["stop"] else 1, r["seq"] or 0)):
            latest = max(latest, r["ms"])
            if over or not r["stop"] and stop is not None and r["seq"] > stop:
                yield self._row(run, r["seq"], "ignored", head, r["kind"], r["role"], r["payload"])
            elif r["stop"]:
                mark = head[0] - 1 if r["seq"] is None else r["seq"]
                stop = mark if stop is None else min(stop, mark)
                self.stop.update((stop,))
                for seq in [s for s in waiting if s > stop]:
                    yield self._row(run, seq, "ignored", head, *waiting.pop(seq))
                    self.waiting.removeKey((seq,))
            elif r["seq"] < head[0] or r["seq"] in waiting:
                yield self._row(run, r["seq"], "again", head, r["kind"], r["role"], r["payload"])
            else:
                waiting[r["seq"]] = (r["kind"], r["role"], r["payload"])
                self.waiting.updateValue((r["seq"],), waiting[r["seq"]])
                yield from self._release(run, head, waiting, stop, latest)
                over = self.over.exists()
        if not over:
            if stop is not None and head[0] > stop:
                yield from self._end(run, head, waiting, "stopped", latest)
            else:
                self._timer(head, max(latest + self.idle, head[4]))
        self.head.update(tuple(head))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        (run,) = key
        head = list(self.head.get())
        if self.over.exists():
            for s in (self.head, self.waiting, self.stop, self.over):
                s.clear()
            return
        now, head[4] = expiredTimerInfo.getExpiryTimeInMs(), -1
        waiting = {k[0]: tuple(v) for k, v in self.waiting.iterator()}
        stop = self.stop.get()[0] if self.stop.exists() else None
        yield from self._release(run, head, waiting, stop, now, all_of_it=True)
        if not self.over.exists():
            yield from self._end(run, head, waiting, "stale" if stop is None else "stopped", now)
        self.head.update(tuple(head))

    def close(self) -> None:
        pass


def released(entries: DataFrame, stops: DataFrame | None = None, idle: str = "10 minutes", keep: str = "1 hour", late: str = "1 minute", first: int = 0, most_waiting: int = MOST_WAITING) -> DataFrame:
    """The rows (RELEASED) of a stream of entries, and of one of stop marks. The session must use ROCKS for the state (see rocks)."""
    e = entries.select("run_id", "at", "seq", "kind", "role", "payload", F.lit(False).alias("stop"))
    if stops is not None:
        e = e.unionByName(stops.select("run_id", "at", "seq", F.lit(True).alias("stop")), allowMissingColumns=True)
    # One watermark over both, so that a stream without marks doesn't hold it back.
    processor = RunLog(_millis(entries.sparkSession, idle), _millis(entries.sparkSession, keep), first, most_waiting)
    return e.where("run_id is not null and at is not null and (seq is not null or stop)").withColumn("ms", F.unix_millis("at")).withWatermark("at", late).groupBy("run_id").transformWithState(processor, RELEASED, "Append", "EventTime")


def _millis(spark: SparkSession, interval: str) -> int:
    return spark.sql(f"select unix_millis(timestamp_seconds(0) + interval '{interval}') as ms").first()["ms"]


def rocks(spark: SparkSession) -> None:
    """Use the state store that this state needs, for queries started from now on."""
    spark.conf.set(STORE, ROCKS)


def run_until_read(rows: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Read all there is, write the rows to a folder exactly once, and give the folder's table. Called again with the same folders, it goes on where it ended or failed."""
    spark = rows.sparkSession
    before = spark.conf.get(STORE)
    rocks(spark)
    try:
        q = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(folder)
        q.awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    return spark.read.schema(rows.schema).parquet(folder)
