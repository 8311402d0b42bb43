"""Exact deduplication by distributed MSD radix partitioning.

A text is the byte string left after its white space (space, TAB to CR) is deleted. Texts are split by
length and then by successive digits of bytes, each digit several times as long as the last. A group that has
one member drops out; a group whose bytes are used up is a class of equal texts. Groups are named by their smallest row number,
so equality is never decided by a digest. Each round is one aggregation (combined before the shuffle) and one join of digits, not texts, with a
row a group. Groups with more than one in HOT of all rows, HOT of them at most, join by a broadcast instead, so that no task meets a hot group; no group is gathered in a task.

Null texts count as empty; empty texts are one class. Rows that repeat, ids included, stay rows of their own: one row of a class is
kept (most code points in the original text, then smallest doc_id, nulls last, then the first row). Columns keep their names, whatever they are; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, drop, free, left, parted, plain, staged, without

FIRST_DIGIT, GROWTH = 48, 8
HOT, HOT_BYTES = 1000, 64 << 20  # groups that are broadcast in a round, and the bytes of their digits, at most


def _normalised(batches):
    free()
    for b in batches:
        norm, cps, sha = [], [], []
        for t in b.column("text").to_pylist():
            t = t or ""
            n = t.encode("utf-8", "surrogatepass").translate(None, WS)
            norm.append(n)
            cps.append(len(t))
            sha.append(hashlib.sha256(n).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [b.column("rid"), b.column("doc_id"), pa.array(cps, pa.int64()), pa.array(map(len, norm), pa.int64()), pa.array(sha, pa.string()), pa.array([n[:FIRST_DIGIT] for n in norm], pa.binary()), pa.array([n[FIRST_DIGIT:] for n in norm], pa.binary())],
            ["rid", "doc_id", "n_cp", "n_bytes", "sha", "digit", "rest"],
        )


def _by_group(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int, most: int) -> DataFrame:
    """Rows with the columns of their group. Groups of more than total / most rows, so fewer than most, are broadcast."""
    names = [f"_k{i}" for i in range(len(on))]
    groups = groups.withColumnsRenamed(dict(zip(on, names)))
    same = [F.col(c) == F.col(k) for c, k in zip(on, names)]
    hot = F.broadcast(groups.where(F.col(size) * most > total))
    cold = rows.join(hot, same, "left_anti").join(groups.where(F.col(size) * most <= total), same)
    return rows.join(hot, same).unionByName(cold).drop(*names)


def _split(rows: DataFrame, on: list[str], total: int, digit: int) -> DataFrame:
    """One radix round: rid, n_bytes and gid, the new group's name, of the rows of groups with two members at least."""
    groups, _ = staged(rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), F.min("rid").alias("_g")).where("_n > 1"), "radix-groups")
    found = _by_group(rows.select("rid", "n_bytes", *(c for c in on if c != "n_bytes")), groups, on, "_n", total, max(1, min(HOT, HOT_BYTES // digit)))
    return found.select("rid", "n_bytes", F.col("_g").alias("gid"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rid_col: str | None = None) -> DataFrame:
    """A row for each row of docs: rid (rid_col, else a number of our own), doc_id, sha, and of its class keep_id, group_size, kept."""
    src = docs.select((F.col(rid_col) if rid_col else F.monotonically_increasing_id()).alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base, _ = staged(src.mapInArrow(_normalised, "rid long, doc_id long, n_cp long, n_bytes long, sha string, digit binary, rest binary"), "radix-base")
    total, size, used, done = base.count(), FIRST_DIGIT, FIRST_DIGIT, []
    alive, _ = staged(_split(base, ["n_bytes", "digit"], total, size), "radix-round")
    while True:
        done.append(alive.where(F.col("n_bytes") <= used).select("rid", "gid"))
        alive = alive.where(F.col("n_bytes") > used)
        if alive.isEmpty():
            break
        size *= GROWTH
        # Only the next digit of rows that are still in a group is shuffled.
        digits, _ = parted(base.select("rid", F.expr(f"substring(rest, {used - FIRST_DIGIT + 1}, {size})").alias("digit")), alive)
        rows, _ = staged(alive.join(digits.withColumnRenamed("rid", "_r"), F.col("rid") == F.col("_r")).drop("_r"), "radix-digits")
        alive, _ = staged(_split(rows, ["gid", "digit"], total, size), "radix-round")
        used += size
    equal = done[0]
    for d in done[1:]:
        equal = equal.unionAll(d)
    equal = equal.withColumnRenamed("rid", "_r").join(base.select("rid", "doc_id", "n_cp"), F.col("_r") == F.col("rid")).drop("_r")
    equal, _ = staged(equal, "radix-classes")
    best = equal.groupBy("gid").agg(F.min(F.struct((-F.col("n_cp")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"), F.col("rid").alias("d"))).alias("m"), F.count(F.lit(1)).alias("group_size"))
    best, _ = staged(best.select("gid", F.col("m.c").alias("keep_id"), F.col("m.d").alias("keep_rid"), "group_size"), "radix-best")
    found = _by_group(equal.select("rid", "gid"), best, ["gid"], "group_size", total, HOT)
    found = found.select(F.col("rid").alias("_r"), "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.lit(True).alias("_in"))
    return (
        base.select("rid", "doc_id", "sha")
        .join(found, F.col("rid") == F.col("_r"), "left")
        .select("rid", "doc_id", "sha", F.when(F.col("_in"), F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.coalesce("kept", F.lit(True)).alias("kept"))
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Docs without the rows that equal a kept row; every column stays, whatever its name."""
    rows, at = plain(docs)
    rows, _ = staged(rows.withColumn("rid", F.monotonically_increasing_id()), "radix-docs")  # written, so that row numbers don't change
    before = left()
    gone, path = staged(classes(rows, at("doc_id"), at("text"), "rid").where("not kept").select("rid"), "radix-gone")
    drop(docs.sparkSession, left() - before - {path})
    return without(rows, gone).drop("rid").toDF(*docs.columns)


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classes(docs).select("doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


SQL = r"""
with n as (select doc_id, length(coalesce(text, '')) as cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as t from documents),
r as (select *, row_number() over (partition by t order by cp desc, doc_id) as k, count(*) over (partition by t) as c, first_value(doc_id) over (partition by t order by cp desc, doc_id) as f from n)
select doc_id, f as keep_id, c as group_size, k = 1 as kept, sha256(t) as text_sha256 from r
"""
