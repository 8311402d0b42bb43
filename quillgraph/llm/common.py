"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WS = b" \t\n\x0b\x0c\r"

_left: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a folder of our own only where that is unset and driver and executors are one process, as in tests."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="quillgraph-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def staged(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Cut the lineage: write df as Parquet in the shared folder and read it back. Gives the table and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillgraph/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _left.append((spark, path))
    return spark.read.schema(df.schema).parquet(path), path


def unstage(spark: SparkSession, *paths: str) -> None:
    """Delete staged tables that no later plan reads."""
    for p in paths:
        _delete(spark, p)
        _left[:] = [x for x in _left if x[1] != p]


def left() -> set[str]:
    """Paths of the staged tables that there are."""
    return {p for _, p in _left}


def drop(spark: SparkSession, paths, *readers: DataFrame) -> None:
    """Delete those of the staged tables that none of the readers reads."""
    read = [f for r in readers for f in r.inputFiles()]
    unstage(spark, *(p for p in paths if p in left() and not any(p.rsplit("/", 1)[1] in f for f in read)))


def forget(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of tables that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


BATCH = 1000  # rows of an Arrow batch where each row holds whole texts or sets


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH):
    """Arrow batches of so many rows at most for what is planned and run meanwhile: an executor holds a batch several times (rows, Arrow buffers of a power of two, Python)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


_caches: list[dict] = []


def cache() -> dict:
    """A dictionary that a Python worker keeps from task to task, until free."""
    _caches.append({})
    return _caches[-1]


def free() -> None:
    """Give back what this worker keeps of earlier stages, and memory that it has freed: a worker outlives its stages, and an executor has the memory of all its workers to hold."""
    for c in _caches:
        c.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


SLOTS = 1 << 20  # bound of the rows that are broadcast to tell which rows a few ids may mean


def _slot(col: str):
    return F.pmod(F.xxhash64(col), F.lit(SLOTS))


def parted(rows: DataFrame, ids: DataFrame, col: str = "rid") -> tuple[DataFrame, DataFrame]:
    """Rows whose col may be among those of ids, and rows whose col surely isn't, told by hash slots (SLOTS at most are broadcast), so that the latter, wide as they may be, need no shuffle."""
    slots = F.broadcast(ids.select(_slot(col).alias("slot_")).distinct())
    return rows.join(slots, _slot(col) == F.col("slot_"), "left_semi"), rows.join(slots, _slot(col) == F.col("slot_"), "left_anti")


def without(rows: DataFrame, ids: DataFrame, col: str = "rid") -> DataFrame:
    """Rows whose col isn't among those of ids."""
    maybe, surely_not = parted(rows, ids, col)
    return maybe.join(ids.select(F.col(col).alias("id_")), F.col(col) == F.col("id_"), "left_anti").unionAll(surely_not)


def plain(docs: DataFrame):
    """docs with columns c0, c1, ..., and what finds the new name of an old one: an exact match, else the first that differs in case only."""
    names = docs.columns

    def at(name: str) -> str | None:
        hit = [i for i, n in enumerate(names) if n == name] or [i for i, n in enumerate(names) if n.lower() == name]
        return f"c{hit[0]}" if hit else None

    return docs.toDF(*(f"c{i}" for i in range(len(names)))), at


@atexit.register
def _clean() -> None:
    for spark, p in _left:
        try:
            _delete(spark, p)
        except Exception:  # noqa: BLE001  the session may have ended
            pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col, n: int):
    """crc32(doc_id as text) mod n."""
    return F.crc32(col.cast("string").cast("binary")) % n
