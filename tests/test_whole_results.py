"""Cases that small tables hide: common terms, vectors of several lengths, long reply chains, null keys."""

import pytest
from pyspark.sql import functions as F

from threadloom import session
from threadloom.operators import bm25, dense, graph, ordering, store


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_a_term_in_every_text_still_matches(spark):
    docs = spark.range(1_000_000).select(F.col("id").alias("doc_id"), F.lit("common").alias("text"))
    queries = spark.createDataFrame([(1, "common")], "query_id long, query_text string")
    for strategy in (None, "join"):
        assert [r[0] for r in rows(bm25.bm25_corpus(queries, docs, 5, strategy=strategy), "doc_id")] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("strategy", [None, "grid"])
def test_vectors_of_several_lengths(spark, strategy):
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0, 1.0]), (3, [1.0])], "query_id long, query_vec array<double>")
    chunks = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0, 1.0]), (3, [0.5, 0.5]), (4, None)], "doc_id long, vec array<double>")
    assert rows(dense.dense_topk(queries, chunks, 5, strategy=strategy), "query_id", "doc_id") == [(1, 1), (1, 3), (2, 2)]


def test_replies_lead_to_the_root(spark):
    chain = [(f"m{k}", f"m{k - 1}" if k else "", "t") for k in range(9)] + [("x", "gone", "u"), ("a", "b", "v"), ("b", "a", "v")]
    got = {r.msg_id: (r.ancestors, r.top) for r in graph.reply_context(
        spark.createDataFrame(chain, "msg_id string, parent_id string, thread_id string")).collect()}
    assert all(got[f"m{k}"] == (k, "m0") for k in range(9)) and got["x"] == (0, "x") and {"a", "b"} <= set(got)


def test_hops_keep_the_best(spark):
    edges = spark.createDataFrame([(f"s{k % 3}", f"n{k}", "reply") for k in range(60)] + [(f"n{k}", f"f{k}", "reply") for k in range(60)],
                                  "src string, dst string, kind string")
    seeds = spark.createDataFrame([(1, f"s{k}", 0.9 - k / 10) for k in range(3)], "query_id int, doc_id string, score double")
    edges = edges.withColumn("kind", F.lit(graph.fv.EDGE_PRIORS[0][0]))
    whole = rows(graph.hop_expand(seeds, edges, k=1000), "rank", "doc_id", "score")
    assert len(whole) > 100 and rows(graph.hop_expand(seeds, edges, k=10), "rank", "doc_id", "score") == whole[:10]


def test_store_keeps_rows_without_a_namespace(spark):
    columns = "namespace string, id string, text string"
    chunks = store.ChunkStore(spark, session.scratch_path(spark, "nulls"), columns, buckets=1)
    chunks.create(spark.createDataFrame([(None, "1", "x"), ("a", "2", "y")], columns))
    batch = spark.createDataFrame([(None, "3", "z", 1), ("a", "2", "w", 1)], columns + ", ord int")
    chunks.upsert(batch, "ord")
    chunks.upsert(batch, "ord")
    assert {(r.namespace, r.id, r.text) for r in chunks.read().collect()} == {(None, "1", "x"), (None, "3", "z"), ("a", "2", "w")}
    chunks.delete_ids(spark.createDataFrame([(None, "1")], "namespace string, id string"))
    assert {(r.namespace, r.id) for r in chunks.read().collect()} == {(None, "3"), ("a", "2")}


def test_quantiles_of_a_hot_key_in_many_slices(spark):
    df = spark.range(10_001).select(F.lit("k").alias("k"), F.col("id").cast("double").alias("v"))
    row = ordering.exact_quantiles(df, ["k"], "v", [0.0, 0.5, 1.0], slice_values=100).first()
    assert (row.q0, row.q1, row.q2, row.n) == (0.0, 5000.0, 10000.0, 10_001)


def test_sizes_are_measured(spark):
    wide = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("s"))
    assert session.fits_broadcast(wide, 20_000) and not session.fits_broadcast(wide, 9_000)
