"""A change of the store reads the folders it touches and no others."""

import re

from pyspark.sql import functions as F

from threadloom.operators.store import ChunkStore
from threadloom.session import scratch_path


def stored_rows(store):
    return {(r.namespace, r.id): r.text for r in store.read().collect()}


def partition_filters(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [f for f in re.findall(r"PartitionFilters: \[([^\]]*)", plan) if f]


def files_read(df):
    """Files that the scans of a run plan have opened."""
    found, queue = [], [df._jdf.queryExecution().executedPlan()]
    while queue:
        node = queue.pop()
        kind = node.getClass().getSimpleName()
        if kind == "FileSourceScanExec":
            found.append(node.metrics().apply("numFiles").value())
        queue += [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if "QueryStage" in kind else []
        queue += [node.children().apply(k) for k in range(node.children().size())]
    return sum(found)


def test_reads_are_pruned(spark):
    rows = [(ns, f"id{k}", f"text {k}") for ns in ("a", "b", None) for k in range(200)]
    store = ChunkStore(spark, scratch_path(spark, "test-store"), "namespace string, id string, text string", buckets=16)
    store.create(spark.createDataFrame(rows, store.schema))
    place = store._scan().filter("id = 'id7'").select("namespace", "bucket").distinct()
    for where, names in (("namespace = 'a'", ["a"]), ("namespace IS NULL", [None]), ("true", ["a", "b", None])):
        part = store._in(place.filter(where))
        assert partition_filters(part)
        assert {r.namespace for r in part.collect()} == set(names)
        assert files_read(part) < len(store._scan().inputFiles()) / 4
    assert store._in(place.filter("false")).count() == 0


def test_changes_of_null_and_other_namespaces(spark):
    rows = {(ns, f"id{k}"): f"text {k}" for ns in ("a", "b", None) for k in range(50)}
    store = ChunkStore(spark, scratch_path(spark, "test-store"), "namespace string, id string, text string, doc string", buckets=8)
    frame = lambda some: spark.createDataFrame([(*key, text, f"d{int(key[1][2:]) // 5}") for key, text in some.items()], store.schema)
    store.create(frame(rows))
    new = {("a", "id3"): "new", (None, "id3"): "new", (None, "id900"): "more", ("c", "id1"): "c"}
    store.upsert(frame(new).withColumn("v", F.lit(1)), "v")
    rows |= new
    assert stored_rows(store) == rows
    store.delete_ids(spark.createDataFrame([("b", "id1"), (None, "id2"), ("zz", "id1")], "namespace string, id string"))
    rows = {k: v for k, v in rows.items() if k not in (("b", "id1"), (None, "id2"))}
    assert stored_rows(store) == rows
    store.replace_documents(spark.createDataFrame([("a", "id700", "whole", "d1"), (None, "id701", "null", "d2")], store.schema), "doc")
    rows = {k: v for k, v in rows.items() if not (k[0] == "a" and int(k[1][2:]) // 5 == 1 or k[0] is None and int(k[1][2:]) // 5 == 2)}
    rows |= {("a", "id700"): "whole", (None, "id701"): "null"}
    assert stored_rows(store) == rows
