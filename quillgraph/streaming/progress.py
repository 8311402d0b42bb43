"""What a stream reports of its batches, as rows that can be read, compacted and followed like any other log."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from quillgraph.sources.sinks import exists, put_file
from quillgraph.streaming.runs import compacted

PROGRESS = "run_id string, name string, seq long, batch long, stage string, message string, done long, total long, ms long"
#: The stages of a batch in their order, by the names that Spark gives their durations.
STAGES = (("latestOffset", "list"), ("getBatch", "read"), ("queryPlanning", "plan"), ("walCommit", "note"), ("addBatch", "write"), ("commitOffsets", "commit"))


class ProgressLog(StreamingQueryListener):
    """A listener that writes each report of the queries of one name as a file of rows under a folder: a row for each stage of the batch, with rows read so far as done, and one for its end. total: the number of rows there will be, if it is known. Files are small and have one writer, the driver."""

    def __init__(self, spark: SparkSession, folder: str, name: str, total: int | None = None):
        self.spark, self.folder, self.name, self.total, self.done = spark, folder.rstrip("/"), name, total, 0
        self._ids: dict[str, str] = {}

    def _write(self, run: str, number: int, rows: list[dict]) -> None:
        rows = [{"run_id": run, "name": self.name, "seq": number * 10 + i} | r for i, r in enumerate(rows)]
        put_file(self.spark, f"{self.folder}/{run}-{number:08d}.json", "\n".join(map(json.dumps, rows)) + "\n")

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self._ids[str(event.runId)] = self.name
            self._write(str(event.runId), 0, [{"batch": -1, "stage": "start", "message": "started", "done": 0, "total": self.total}])

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name != self.name or not p.numInputRows:
            return
        took = p.durationMs
        rows = [{"batch": p.batchId, "stage": stage, "message": f"batch {p.batchId}", "done": self.done, "total": self.total, "ms": took[key]} for key, stage in STAGES if key in took]
        self.done += p.numInputRows
        rows.append({"batch": p.batchId, "stage": "batch", "message": f"{p.numInputRows} rows", "done": self.done, "total": self.total, "ms": took.get("triggerExecution", 0)})
        self._write(str(p.runId), p.batchId + 1, rows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) in self._ids:
            failed = event.exception is not None
            self._write(str(event.runId), 90_000_000, [{"batch": -1, "stage": "error" if failed else "done", "message": (event.exception or "ended")[:300], "done": self.done, "total": self.total}])


def progress(spark: SparkSession, folder: str) -> DataFrame:
    """The rows there are (PROGRESS), of all runs."""
    return spark.read.schema(PROGRESS).json(folder) if exists(spark, folder) else spark.createDataFrame([], PROGRESS)


def shown(rows: DataFrame) -> DataFrame:
    """What a display keeps: of a run's rows that follow one another in one stage and have a total, the last."""
    return compacted(rows.where(F.col("stage").isin("start", "batch", "done", "error")), "run_id", ("seq",), "stage", "total")
