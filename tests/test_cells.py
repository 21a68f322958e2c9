"""Inverted lists on disk and streams by time slot, against the exact forms."""

import re

import numpy as np
from pyspark.sql import functions as F

from threadloom.operators import cells, dense, grouping
from threadloom.plans.grouping import chat_rows
from threadloom.session import scratch_path
from threadloom.streaming import streams

SF = "/root/testdata/sf0.001"


def clustered(spark, n=4000, groups=40, dims=32):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(groups, dims))
    points = centre[rng.integers(0, groups, n)] + rng.normal(size=(n, dims)) * 0.35
    rows = [(k, [float(x) for x in p]) for k, p in enumerate(points)]
    return spark.createDataFrame(rows, "doc_id long, vec array<double>").repartition(4)


def read_rows(df):
    """Rows that the scan of the lists has given out, as the run plan counts them."""
    out, queue = [], [df._jdf.queryExecution().executedPlan()]
    while queue:
        node = queue.pop()
        kind = node.getClass().getSimpleName()
        if kind == "FileSourceScanExec" and "dynamicpruning" in node.toString().lower():
            out.append(node.metrics().apply("numOutputRows").value())
        if kind == "AdaptiveSparkPlanExec":
            queue.append(node.executedPlan())
        if "QueryStage" in kind:
            queue.append(node.plan())
        children = node.children()
        queue.extend(children.apply(i) for i in range(children.size()))
    return sum(out)


def test_recall_and_rows_read(spark):
    vectors, path = clustered(spark), scratch_path(spark, "test-cells")
    cells.build(vectors, path, part_rows=50)
    queries = vectors.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("vec").alias("query_vec"))
    exact = {(r.query_id, r.doc_id) for r in dense.dense_topk(queries, vectors, 50).collect()}
    found = {(r.query_id, r.doc_id): r.score for r in cells.search(spark, path, queries, 50).collect()}
    assert len(exact & set(found)) >= 0.9 * len(exact) > 0
    probing = cells.probed(spark, path, queries)
    sizes = spark.read.parquet(f"{path}/centres").select("cell", "rows")
    read = probing.join(sizes, "cell").groupBy("query_id").agg(F.sum("rows").alias("n"))
    assert read.agg(F.avg("n")).first()[0] < vectors.count() / 4
    # the scan itself: one query reads its cells' folders and no others
    one = cells.probed_lists(spark, path, cells.probed(spark, path, queries.limit(1)))
    assert "dynamicpruning" in one._jdf.queryExecution().executedPlan().toString().lower()
    wanted = one.count()
    rows = cells.probed_lists(spark, path, cells.probed(spark, path, queries.limit(1)))
    assert len(rows.collect()) == wanted < vectors.count() / 4
    assert read_rows(rows) == wanted


def test_crowded_cells_are_split(spark):
    vectors = spark.range(1000).select(F.col("id").alias("doc_id"), F.array(F.lit(1.0), F.lit(0.5)).alias("vec"))
    path = scratch_path(spark, "test-cells")
    cells.build(vectors, path, cells=3, part_rows=100)
    files = [f for f in spark.read.parquet(f"{path}/lists").inputFiles()]
    assert max(len([f for f in files if f"cell={c}/" in f]) for c in {re.search(r"cell=(\d+)", f)[1] for f in files}) >= 8
    queries = spark.createDataFrame([(7, [1.0, 0.5]), (8, None)], "query_id long, query_vec array<double>")
    got = cells.search(spark, path, queries, 5, probes=3).orderBy("rank").collect()
    assert [(r.query_id, r.doc_id) for r in got] == [(7, k) for k in range(5)]


def test_no_chunks(spark):
    none = spark.createDataFrame([(1, None)], "doc_id long, vec array<double>")
    path = scratch_path(spark, "test-cells")
    cells.build(none, path)
    queries = spark.createDataFrame([(7, [1.0, 0.5])], "query_id long, query_vec array<double>")
    assert cells.search(spark, path, queries).count() == 0


def test_groups_over_many_batches(spark):
    """Messages of three files, each a batch: groups go over the borders of batches and slots."""
    rows = chat_rows(spark, SF).filter("thread_ts IS NULL AND channel_id IS NOT NULL").select(
        "channel_id", F.timestamp_micros(F.round(F.col("t") * 1e6).cast("long")).alias("event_time"), "t", "id", "ts", "user", "msg")
    path = scratch_path(spark, "test-chat")
    # One after the other: the stream takes files by the time they were written, and drops what comes far behind the others.
    edges = [float("-inf"), *rows.approxQuantile("t", [1 / 3, 2 / 3], 0.0), float("inf")]
    for low, high in zip(edges, edges[1:]):
        rows.filter((F.col("t") > low) & (F.col("t") <= high)).coalesce(1).write.mode("append").parquet(path)
    beat = rows.select("channel_id").distinct().select("channel_id", F.lit("2030-01-01 00:00:00").cast("timestamp").alias("event_time"), *[
        F.lit(v).alias(n) for n, v in (("t", 1893456000.0), ("id", "beat"), ("ts", "beat"), ("user", "beat"), ("msg", "beat"))])
    beat.coalesce(1).write.mode("append").parquet(path)
    out = streams.run_to_table(streams.anchor_groups(streams.watch_files(spark, path, rows.schema, max_files=1)), "test-groups")
    columns = ["channel_id", "id", "user_name", "ts", "message_count", "text"]
    got = spark.read.schema(streams.GROUP_SCHEMA).parquet(out).filter("id <> 'beat'").select(*columns)
    batch = grouping.user_groups(chat_rows(spark, SF)).select(*columns[:4], F.size("message_ids").cast("long").alias("message_count"), "text")
    assert got.count() == batch.count() and got.exceptAll(batch).count() == 0
