"""Logs of runs as streams of files: the last state of each run, and the fold of a search's events. The same plans serve tables.

State is a row a run (the fold also keeps a run's answer pieces). Runs never end here, so there is no watermark; a source that can say when a run is over should add one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENTS = "run_id string, seq int, type string, payload string"
LOG = "run_id string, seq int, kind string, role string, ok boolean"


def follow(spark: SparkSession, folder: str, schema: str = EVENTS, files_a_batch: int = 100) -> DataFrame:
    """Stream of the JSON lines that files of a folder hold and will hold."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).json(folder)


def run_states(log: DataFrame) -> DataFrame:
    """Of each run: the kind of its last entry by seq, entries, delegations, and entries that failed."""
    return log.groupBy("run_id").agg(
        F.max_by("kind", "seq").alias("state"),
        F.count("*").alias("entries"),
        F.count_if(F.col("kind") == "delegate").alias("delegations"),
        F.count_if(~F.col("ok")).alias("failed"),
    )


def fold_events(events: DataFrame, run_id: str | None = None) -> DataFrame:
    """Final state of each run: last category, keywords and sources, the answer joined from its pieces in order of seq, and whether it is done or failed. With run_id, entries of other runs are stale and ignored."""
    if run_id is not None:
        events = events.where(F.col("run_id") == run_id)

    def last(kind: str):
        return F.max(F.when(F.col("type") == kind, F.struct("seq", "payload")))["payload"]

    pieces = F.sort_array(F.collect_list(F.when(F.col("type") == "delta", F.struct("seq", "payload"))))
    return events.groupBy("run_id").agg(
        last("category").alias("category"),
        last("keywords").alias("keywords"),
        last("sources").alias("sources"),
        F.array_join(F.transform(pieces, lambda x: x["payload"]), "").alias("answer"),
        F.coalesce(F.bool_or(F.col("type") == "done"), F.lit(False)).alias("done"),
        last("error").alias("error"),
    )


def snapshots(log: DataFrame, timeout: str = "1 hour") -> DataFrame:
    """Of each run: seq and kind of its last entry, delegations so far, and roles at work (delegated to and not yet returned from), for polling. On a stream with a time column at, rows later than timeout are dropped and so is what they would count for."""
    if log.isStreaming and "at" in log.columns:
        log = log.withWatermark("at", timeout)
    open_roles = F.count_if(F.col("kind") == "delegate") - F.count_if(F.col("kind") == "return")
    return log.groupBy("run_id").agg(F.max(F.struct("seq", "kind")).alias("last"), F.count_if(F.col("kind") == "delegate").alias("delegations"), open_roles.alias("at_work")).select("run_id", "last.seq", F.col("last.kind").alias("state"), "delegations", "at_work")


def paired(log: DataFrame, key: str = "run_id", order: str = "seq") -> DataFrame:
    """Each delegation with the return that follows it in its run and role: key, role, order, returned (null while at work), gap."""
    w = Window.partitionBy(key, "role").orderBy(order)
    p = log.where(F.col("kind").isin("delegate", "return")).withColumn("next_kind", F.lead("kind").over(w)).withColumn("next_", F.lead(order).over(w))
    back = F.when(F.col("next_kind") == "return", F.col("next_"))
    return p.where("kind = 'delegate'").select(key, "role", order, back.alias("returned"), (back - F.col(order)).alias("gap"))


def compacted(progress: DataFrame, key: str, order, stage: str, total: str | None = None) -> DataFrame:
    """Of progress entries that follow one another in the same stage, and have a total, the last; others all stay."""
    w = Window.partitionBy(key).orderBy(*order)
    same = F.coalesce(F.lead(stage).over(w) == F.col(stage), F.lit(False))
    counts = F.lit(True) if total is None else F.col(total).isNotNull() & F.lead(total).over(w).isNotNull()
    return progress.withColumn("drop_", same & counts).where(~F.col("drop_")).drop("drop_")


def until_stopped(log: DataFrame, stops: DataFrame) -> DataFrame:
    """Entries up to their run's stop mark (run_id, seq); all of them where it has none."""
    s = stops.groupBy(F.col("run_id").alias("r_")).agg(F.min("seq").alias("s_"))
    return log.join(s, F.col("run_id") == F.col("r_"), "left").where(F.col("s_").isNull() | (F.col("seq") <= F.col("s_"))).drop("r_", "s_")


def status_rows(spark: SparkSession, children: dict[str, bool]) -> DataFrame:
    """name and up of processes: this one, and its children as they were probed."""
    return spark.createDataFrame([("self", True), *children.items()], "name string, up boolean")


class Index:
    """A table computed from a corpus and kept until the corpus changes."""

    def __init__(self, corpus, build):
        self._corpus, self._build, self._kept = corpus, build, None

    def table(self) -> DataFrame:
        if self._kept is None:
            self._kept = self._build(self._corpus()).persist()
        return self._kept

    def invalidate(self) -> None:
        if self._kept is not None:
            self._kept.unpersist()
            self._kept = None
