"""The corpus pipeline: quality classifier, exact dedup, near-dedup, personal data, packing; each stage is written and read again by the next.

Null and empty texts pass through every stage by the rules of its operator; rows that repeat are one row after exact dedup; an empty table gives an empty result; all columns of documents
stay up to the last stage, whatever their names.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import exact_dedup, packing, pii, quality, simhash
from quillgraph.llm.common import drop, forget, left, staged, table

_stages_left: set[str] = set()


def _stage(f):
    """A stage: when it begins, the result of the stage before it is written, so what that one staged and docs doesn't read can go."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop(spark, _stages_left, docs)
        forget(spark)
        before = left()
        _stages_left.intersection_update(before)
        out = f(spark, docs, sf_dir)
        _stages_left.update(left() - before)
        return out

    return run_stage


@_stage
def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; it learns from documents and labels of sf_dir."""
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


@_stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal texts."""
    return exact_dedup.exact_dedup(docs)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts similar at 4/5 or more."""
    return simhash.near_dedup(docs)


@_stage
def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced, and terms that disclose it generalised or taken out."""
    return pii.sanitise(docs)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row for each piece."""
    return packing.pack(docs)


STAGES = [("quality", drop_poor), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("pii", hide_personal_data), ("packing", pack)]

#: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        before = path
        docs, path = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop(spark, [before], docs)
    return STAGES[-1][1](spark, docs, sf_dir)

