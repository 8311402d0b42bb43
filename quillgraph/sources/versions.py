"""Tables that change together: versions under one folder, each named by a small file that is moved into place in one step.

    path/data/<id>/          a table's rows, written once
    path/commits/00000007    which folders make up each table in version 7

A reader takes the greatest commit there is, so that a writer that fails at any step leaves the version before, and one whose commit is there has all its tables there. A commit's name is taken once: of two writers that began from the same version the second
gets Conflict and starts anew. Nothing is deleted but by vacuum.
"""

from __future__ import annotations

import atexit
import json
import re
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has committed since the version that a change was computed from."""


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of our own only where that is unset and they are one process, as in tests."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="quillgraph-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


_scratch: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, tag: str) -> str:
    """A folder of the shared one for this session, deleted when it ends."""
    path = f"{shared_dir(spark)}/quillgraph/{tag}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


@atexit.register
def _clean() -> None:
    for spark, path in _scratch:
        try:
            fs, p = _fs(spark, path)
            fs.delete(p, True)
        except Exception:  # noqa: BLE001  the session may have ended
            pass


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


class Versions:
    """The tables under a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _listed(self, folder: str) -> list:
        fs, p = _fs(self.spark, f"{self.path}/{folder}")
        return list(fs.listStatus(p)) if fs.exists(p) else []

    def _numbers(self) -> list[int]:
        return sorted(int(n) for s in self._listed("commits") if (n := s.getPath().getName()).isdigit())

    def _noted(self, version: int) -> dict[str, list[str]]:
        fs, p = _fs(self.spark, f"{self.path}/commits/{version:08d}")
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def current(self) -> tuple[int, dict[str, list[str]]]:
        """The version, 0 before the first, and the folders of each table."""
        n = self._numbers()
        return (n[-1], self._noted(n[-1])) if n else (0, {})

    def read(self, name: str, schema: str, version: int | None = None) -> DataFrame:
        """A table as of a version, the current one by default; without rows where it isn't there."""
        tables = self.current()[1] if version is None else self._noted(version) if version else {}
        folders = tables.get(name, [])
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], schema)

    def stage(self, df: DataFrame, by: str | None = None) -> str:
        """Write rows that a later commit may name; gives their folder."""
        folder = f"data/{uuid.uuid4().hex}"
        (df.write.partitionBy(by) if by else df.write).parquet(f"{self.path}/{folder}")
        return folder

    def stage_in_buckets(self, df: DataFrame, bucket: Column, *order: str, within: tuple[int, int, Column] | None = None) -> dict[int, str]:
        """Write rows, each to its bucket's folder; gives the folders there are. A bucket's rows are one task's; with within (the number of buckets, that of tasks for each, and a column whose hash deals its rows to them) they are several tasks', so that a task's rows needn't grow with the table."""
        rows = df.withColumn("bucket_", bucket)
        if within:
            buckets, tasks, key = within
            rows = rows.repartitionById(buckets * tasks, (F.col("bucket_") * tasks + F.pmod(F.xxhash64(key), F.lit(tasks))).cast("int"))
        else:
            rows = rows.repartition("bucket_")
        folder = self.stage(rows.sortWithinPartitions("bucket_", *order) if order else rows, "bucket_")
        names = (s.getPath().getName() for s in self._listed(folder))
        return {int(n.split("=")[1]): f"{folder}/{n}" for n in names if n.startswith("bucket_=")}

    def read_buckets(self, name: str, schema: str, only=None, version: int | None = None) -> DataFrame:
        """A table whose buckets are tables name/000, name/001, ...; only some of them, if given."""
        tables = self.current()[1] if version is None else self._noted(version) if version else {}
        folders = [f"{self.path}/{f}" for t, fs in tables.items() if t.rpartition("/")[0] == name and (only is None or int(t.rpartition("/")[2]) in only) for f in fs]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def staged(self, folder: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}")

    def _note(self, tables: dict[str, list[str]]) -> str:
        fresh = f"{self.path}/commits/.new-{uuid.uuid4().hex}"
        fs, p = _fs(self.spark, fresh)
        out = fs.create(p, False)
        out.write(bytearray(json.dumps(tables).encode()))
        out.close()
        return fresh

    def _move(self, fresh: str, version: int) -> None:
        jvm = self.spark.sparkContext._jvm
        _, source = _fs(self.spark, fresh)
        _, target = _fs(self.spark, f"{self.path}/commits/{version:08d}")
        kind = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        never_over_another = jvm.java.lang.reflect.Array.newInstance(kind, 1)
        never_over_another[0] = kind.getEnumConstants()[0]
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(source, target, never_over_another)
        except Exception as e:
            if version in self._numbers():
                raise Conflict(f"version {version} of {self.path} is another writer's") from e
            raise

    def commit(self, new: dict[str, DataFrame] | None = None, append: dict[str, list[str]] | None = None, replace: dict[str, list[str]] | None = None, drop=(), base: int | None = None) -> int:
        """Make the next version: tables of new in place of what they were, staged folders added to tables (append) or in place of them (replace), tables in drop gone, all others as they are. base: the version that the change was computed from."""
        version, tables = self.current()
        if base is not None and base != version:
            raise Conflict(f"{self.path} is at version {version}, not {base}")
        tables = {n: list(f) for n, f in tables.items() if n not in drop}
        for name, df in (new or {}).items():
            tables[name] = [self.stage(df)]
        for name, folders in (replace or {}).items():
            tables[name] = list(folders)
        for name, folders in (append or {}).items():
            tables[name] = tables.get(name, []) + list(folders)
        self._move(self._note(tables), version + 1)
        return version + 1

    def vacuum(self, keep: int = 2, age_s: float = 24 * 3600) -> None:
        """Delete commits but the last ones, and folders that none of these names and that are older than any writer takes (age_s)."""
        numbers = self._numbers()
        named = {f for n in numbers[-keep:] for folders in self._noted(n).values() for f in folders}
        for n in numbers[:-keep]:
            fs, p = _fs(self.spark, f"{self.path}/commits/{n:08d}")
            fs.delete(p, False)
        for s in self._listed("data"):
            if f"data/{s.getPath().getName()}" not in named and s.getModificationTime() < 1000 * (time.time() - age_s):
                fs, p = _fs(self.spark, s.getPath().toString())
                fs.delete(p, True)
