"""Two columns of one store, with the rules of their order."""

from pyspark.sql import functions as F

from quillgraph.operators import chunking, rerank, store
from quillgraph.operators import sidebyside as S


def _store(spark):
    rows = [("d#0", "d", 0, 1, "Alpha particles hit the chip. They cause a soft error in memory cells.", [1.0, 0.0], None), ("d#1", "d", 1, 2, "Neutrons are heavier and hit less often than others do.", [0.8, 0.6], "document"), ("d#2", "d", 2, 0, "Cooking with butter.", [0.0, 1.0], "document"), ("gen#1", "generated answers", 3, 0, "Alpha alpha alpha soft error answer.", [0.9, 0.1], "generated")]
    return spark.createDataFrame(rows, "id string, document string, chunk_index int, page int, text string, vector array<float>, source string").select("id", "document", "chunk_index", "page", F.lit("fixed").alias("strategy"), F.length("text").alias("n_chars"), "text", "vector", "source", *(F.lit(None).cast("string").alias(c) for c in ("question", "engine", "based_on", "created")))


def test_side_by_side(spark):
    s = _store(spark)
    q = spark.createDataFrame([(1, "what is a soft error", "alpha error"), (2, "butter", "butter 2024"), (3, "heavier", None)], "query_id int, question string, rewritten string")
    e = {r.query_id: (r.text, r.fault) for r in S.effective(q).collect()}
    assert e == {1: ("alpha error", None), 2: ("butter", "numbers"), 3: ("heavier", None)}
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.8, 0.6])], "query_id int, q array<double>")
    h = S.hits(s, q, v, 2).collect()
    got = {(r.query_id, r.engine, r.rank): r.id for r in h}
    assert (got[1, "semantic", 1], got[1, "semantic", 2], got[1, "bm25", 1], got[2, "bm25", 1], got[3, "semantic", 1]) == ("d#0", "gen#1", "gen#1", "d#2", "d#1") and (2, "bm25", 2) not in got
    # Without generated rows they are in neither column, but words' statistics stay those of the whole store.
    few = S.hits(s, q, v, 2, include_generated=False)
    assert few.where("source = 'generated'").count() == 0
    with_all = {(r.query_id, r.id): r.score for r in h if r.engine == "bm25"}
    assert all(with_all[r.query_id, r.id] == r.score for r in few.where("engine = 'bm25'").collect() if (r.query_id, r.id) in with_all)
    assert {r.query_id: r.shared for r in S.overlap(S.hits(s, q, v, 2)).collect()} == {1: 2, 2: 1, 3: 1}
    # Verdicts on the question as asked push hits out; each column by itself, from a larger pool.
    none = F.lit(None).cast("array<struct<token:string,logprob:double,prob:double,top:array<struct<token:string,logprob:double,prob:double>>>>")
    verdicts = spark.createDataFrame([(1, "d#0", "N 0.2"), (1, "gen#1", "Y 0.95"), (1, "d#1", "Y 0.99")], "query_id int, id string, raw string").withColumn("tokens", none)
    r = S.hits(s, q, v, 1, verdicts)
    by = {(x.query_id, x.engine, x.rank): (x.id, x.rank_before, x.moved, x.kept) for x in r.collect()}
    assert by[1, "semantic", 1] == ("gen#1", 2, 1, True) and by[1, "semantic", 2] == ("d#0", 1, -1, False) and by[1, "bm25", 1] == ("gen#1", 1, 0, True)  # the pool of one is two
    assert by[2, "semantic", 1] == ("d#2", 1, 0, True)  # nothing judged: ranks stay
    c = {(x.query_id, x.engine): x.context for x in S.contexts(r).collect()}
    assert c[1, "semantic"] == "[근거 1] (generated answers · — · #3)\nAlpha alpha alpha soft error answer." and c[2, "semantic"].startswith("[근거 1] (d · — · #2)")
    # Evidence is marked in what is kept by meaning only.
    kept = S.hits(s, q, v, 2)
    sent = chunking.sentences(s.select(F.xxhash64("id").alias("doc_id"), "text")).join(s.select(F.xxhash64("id").alias("doc_id"), "id"), "doc_id").select("id", "sent_no", F.when(F.col("sent_no") == 0, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.6), F.lit(0.8))).alias("vector"))
    m = S.marked(kept, sent, v).collect()
    assert {(x.query_id, x.id) for x in m} == {(x.query_id, x.id) for x in kept.where("engine = 'semantic'").collect()}
    first = {(x.query_id, x.id): x for x in m if x.level == "top"}
    assert first[1, "d#0"].sent_no == 0 and first[1, "d#0"].score == 1.0 and first[2, "d#2"].base == 1.0
    summary = rerank.evidence_summary(spark.createDataFrame(m), ("query_id", "id")).where("query_id = 1 and id = 'd#0'").first()
    assert (summary.n_segments, summary.n_marked, summary.gain) == (2, 1, 0.0)
    assert store.without_generated(s).count() == 3
