"""Each registered query against its SQL on the smallest tables, and the text expressions on worked cases."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.operators import retrieval as R
from quillgraph.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(f"{r[i]:.5f}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert _rows(df.collect(), df.columns) == _rows(want.fetchall(), want.columns)


def test_every_query_has_its_sql_or_a_test():
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == {"sentence_split", "chunk_structure", "chunk_paragraph"}  # tests/test_operators.py


def _one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t"))).first()[0]


def test_tokens(spark):
    assert _one(spark, "Abc 소프트에러 가 d1", X.tokens) == ["abc", "d1", "소프", "프트", "트에", "에러", "가"]
    assert _one(spark, None, X.tokens) == []


def test_normal_forms(spark):
    assert _one(spark, ' "Self  Attention." ', X.normalize_keyword) == "self attention"
    assert _one(spark, "My Report v2.pdf", X.slugify) == "my-report-v2"
    assert _one(spark, "!!", X.slugify).startswith("doc-")
    assert _one(spark, "abcdef", lambda c: X.truncate(c, 4)) == "abc…"


def test_merge_spans(spark):
    df = spark.createDataFrame([(1, 0, 3), (1, 3, 5), (1, 7, 9), (1, 8, 8)], "id int, start int, end int")
    assert sorted((r["start"], r["end"]) for r in R.merge_spans(df).collect()) == [(0, 5), (7, 9)]


def test_majority_ties_go_to_first_seen(spark):
    df = spark.createDataFrame([("k", "a", 1), ("k", "b", 2), ("k", "b", 3), ("k", "a", 4)], "key string, v string, o int")
    assert R.majority(df, "key", "v", "o").first()["v"] == "a"
