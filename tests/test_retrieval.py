"""Retrieval strategies against each other and against plain references."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.operators import bm25, cells, dense, graph, rerank
from threadloom.plans import fixtures, retrieval
from threadloom.plans.grouping import chat_rows
from threadloom.operators import grouping
from threadloom.streaming import streams
from threadloom.plans.changes import as_log, stm_anchor_groups
from threadloom.session import scratch_path
from threadloom.tables import table

SF = "/root/testdata/sf0.001"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def test_join_strategies_agree(spark):
    q, docs = fixtures.query_texts(spark, SF), fixtures.corpus(spark, SF)
    cols = ("query_id", "rank", "doc_id", "score")
    a = rows(bm25.bm25_corpus(q, docs, 20), *cols)
    assert a == rows(bm25.bm25_corpus(q, docs, 20, strategy="join"), *cols) and a
    plain = bm25.keyword_topk(q, docs, 20)
    original = bm25.bounded_rows
    bm25.bounded_rows = lambda *args: None
    try:
        assert rows(plain, *cols) == rows(bm25.keyword_topk(q, docs, 20), *cols)
    finally:
        bm25.bounded_rows = original


def test_no_queries(spark):
    q, docs = fixtures.query_texts(spark, SF).filter("false"), fixtures.corpus(spark, SF)
    assert bm25.bm25_corpus(q, docs).count() == 0
    assert bm25.keyword_topk(q, docs).count() == 0
    none = fixtures.query_vectors(spark, SF).filter("false")
    assert dense.dense_topk(none, fixtures.vectors(spark, SF)).count() == 0
    assert bm25.bm25_candidates(fixtures.query_texts(spark, SF), spark.createDataFrame([], "query_id long, doc_id long"), docs).count() == 0


def test_okapi_variant(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a c"), (3, "a d d")], "doc_id long, text string")
    q = spark.createDataFrame([(7, "a d")], "query_id long, query_text string")
    pairs = docs.select(F.lit(7).cast("long").alias("query_id"), "doc_id")
    got = {r["doc_id"]: r["score"] for r in bm25.bm25_candidates(q, pairs, docs, k1=1.5, variant="okapi").collect()}
    idf = {t: np.log((3 - df + 0.5) / (df + 0.5)) for t, df in {"a": 3, "b": 1, "c": 1, "d": 1}.items()}
    floor = 0.25 * np.mean(list(idf.values()))
    mean = 7 / 3
    part = lambda tf, ln: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * ln / mean))
    assert got[3] == pytest.approx(floor * part(1, 3) + idf["d"] * part(2, 3), abs=1e-6)
    assert got[1] == pytest.approx(floor * part(1, 2), abs=1e-6)


def test_ann_finds_most(spark):
    q, v = fixtures.query_vectors(spark, SF), fixtures.vectors(spark, SF)
    exact = set(rows(dense.dense_topk(q, v, 10, threshold=None), "query_id", "doc_id"))
    path = scratch_path(spark, "test-cells")
    cells.build(v, path, cells=10)
    assert set(rows(cells.search(spark, path, q, 10, probes=10, threshold=None), "query_id", "doc_id")) == exact
    assert cells.search(spark, path, q, 10, probes=3).count() > 0


def test_mmr_and_greedy_duplicates(spark):
    vec = {1: [1.0, 0.0], 2: [1.0, 0.01], 3: [0.0, 1.0], 4: [0.7, 0.7]}
    v = spark.createDataFrame(list(vec.items()), "doc_id long, vec array<double>")
    hits = spark.createDataFrame([(0, 1, 0.9, 1), (0, 2, 0.89, 2), (0, 3, 0.5, 3), (0, 4, 0.4, 4)],
                                 "query_id long, doc_id long, score double, rank long")
    assert [r["doc_id"] for r in rerank.mmr(hits, v, 4).orderBy("rank").collect()] == [1, 3, 2, 4]
    for greedy in (False, True):
        kept = rerank.drop_near_duplicates(hits, v, 0.95, greedy)
        assert rows(kept, "doc_id") == [(1,), (3,), (4,)]
    # 4 is close to 2 only: 2 is dropped, so the greedy rule keeps 4
    chain = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.96, 0.28]), (4, [0.85, 0.53])], "doc_id long, vec array<double>")
    hits = hits.filter("doc_id <> 3")
    assert rows(rerank.drop_near_duplicates(hits, chain, 0.95, False), "doc_id") == [(1,)]
    assert rows(rerank.drop_near_duplicates(hits, chain, 0.95, True), "doc_id") == [(1,), (4,)]


def test_pagerank_keeps_mass(spark):
    edges = spark.createDataFrame([(1, 2, "reply"), (2, 3, "reply"), (1, 3, "similar"), (4, 1, "reply")],
                                  "src long, dst long, kind string")
    seeds = spark.createDataFrame([(0, 1, 2.0), (0, 4, 2.0)], "query_id long, doc_id long, score double")
    got = {r["doc_id"]: r["score"] for r in graph.personalised_pagerank(seeds, edges).collect()}
    home = np.array([0.5, 0, 0, 0.5])
    step = np.zeros((4, 4))
    step[0, 1], step[0, 2], step[1, 2], step[3, 0] = 1 / 1.3, 0.3 / 1.3, 1, 1
    mass = home.copy()
    for _ in range(20):
        moved = mass @ step
        mass = 0.85 * moved + home * (0.15 + 0.85 * (1 - moved.sum()))
    assert sum(got.values()) == pytest.approx(1.0, abs=1e-5)
    assert [got[i] for i in (1, 2, 3, 4)] == pytest.approx(list(mass), abs=1e-5)


def test_pushes_near_the_seeds(spark):
    """A random graph with sinks: every score is short of full rounds by the bound at most, all together too."""
    rng = np.random.default_rng(2)
    rows = {(int(a), int(b)) for a, b in zip(rng.integers(0, 150, 400), rng.integers(0, 200, 400)) if a != b}
    kinds = ["reply", "same_thread", "reference", "similar"]
    edges = spark.createDataFrame([(a, b, kinds[(a + b) % 4]) for a, b in rows], "src long, dst long, kind string")
    seeds = spark.createDataFrame([(0, 1, 2.0), (0, 4, 1.0), (1, 199, 3.0), (2, 7, 1.0)], "query_id long, doc_id long, score double")
    full = {(r.query_id, r.doc_id): r.score for r in graph.personalised_pagerank(seeds, edges, iterations=25, k=1000).collect()}
    for bound in (0.15,):
        got = {(r.query_id, r.doc_id): r.score for r in graph.pushed_pagerank(seeds, edges, bound, k=1000).collect()}
        short = {key: full[key] - got.get(key, 0.0) for key in full}
        slack = 0.02 + 1e-6 * len(full)  # 25 rounds leave 0.85 ** 25, and rounding
        assert all(-slack <= d <= bound + slack for d in short.values()) and set(got) <= set(full)
        for q in range(3):
            assert sum(d for key, d in short.items() if key[0] == q) <= bound + slack


@pytest.mark.parametrize("score", [lambda *a, **k: graph.personalised_pagerank(*a, iterations=5, **k),
                                   lambda *a, **k: graph.pushed_pagerank(*a, bound=0.4, **k)])
def test_walks_in_tasks_equal_joins(spark, score):
    """Repeated edges and seeds, ends and seeds without an id, sinks and ids that no edge has."""
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b), ["reply", "reference"][a % 2]) for a, b in zip(rng.integers(0, 30, 90), rng.integers(0, 40, 90))]
    edges = spark.createDataFrame(edges + edges[:9] + [(None, 5, "reply"), (5, None, "reply"), (900, 901, "reply")],
                                  "src long, dst long, kind string")
    seeds = spark.createDataFrame([(0, 1, 2.0), (0, 1, 2.0), (0, 4, 1.0), (1, 999, 3.0), (1, 7, 1.0), (2, None, 1.0), (2, 5, 1.0)],
                                  "query_id long, doc_id long, score double")
    cols = ("query_id", "rank", "doc_id", "score")
    near = graph.reachable(seeds, graph.with_priors(edges).drop("kind"), 20, 1000)
    assert near.filter("src = 900").isEmpty() and near.filter("src = 5").count() > 1  # only what seeds lead to
    key = lambda df: {r[:3]: r[3] for r in df.select(*cols).collect()}
    got, want = key(score(seeds, edges, k=12)), key(score(seeds, edges, k=12, limit=16))
    assert set(got) == set(want) and all(got[r] == pytest.approx(want[r], abs=1.1e-6) for r in want) and len(got) > 15


def test_edges_are_chosen_before_they_are_grouped(spark):
    """No shuffle takes edges that no candidate has."""
    edges = spark.range(5000).select((F.col("id") + 100).alias("src"), F.col("id").alias("dst"), F.lit("reply").alias("kind"))
    taken = graph.leaving(graph.both_ways(edges), spark.createDataFrame([(7,), (105,), (None,)], "doc_id long"))
    assert rows(taken, "src", "dst") == [(7, 107), (105, 5), (105, 205)]
    plan = taken._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_plans_push_down(spark):
    plan = retrieval.dense_hits(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    vec = fixtures.vectors(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "label" not in vec


def test_stream_groups_equal_batch(spark):
    batch = grouping.user_groups(chat_rows(spark, SF)).select(
        "channel_id", "id", "user_name", "ts", F.size("message_ids").cast("long").alias("message_count"), "text")
    cols = ("channel_id", "id", "user_name", "ts", "message_count", "text")
    stream = stm_anchor_groups(spark, SF).filter("id <> 'beat'")
    assert rows(stream, *cols) == rows(batch, *cols)


def test_telemetry_on_a_batch(spark):
    got = streams.telemetry_windows(as_log(table(spark, SF, "events").withColumn("ts", F.col("ts").cast("timestamp"))))
    assert got.agg(F.sum("queries")).first()[0] == table(spark, SF, "events").count()
