"""Telemetry, index, evaluation and cost summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.ordering import exact_quantiles


def ratio(part: Column, whole: Column, default: float = 0.0) -> Column:
    return F.when(whole > 0, part / whole).otherwise(default)


def query_telemetry(log: DataFrame) -> DataFrame:
    """Totals, success rate and latency figures of a query log."""
    totals = log.agg(
        F.count(F.lit(1)).alias("total_queries"),
        ratio(F.count(F.when(F.coalesce("success", F.lit(True)), 1)), F.count(F.lit(1))).alias("success_rate"),
        F.avg("total_time_ms").alias("mean_ms"), F.max("total_time_ms").alias("max_ms"),
        F.min("total_time_ms").alias("min_ms"))
    marks = exact_quantiles(log.withColumn("_all", F.lit(1)), ["_all"], "total_time_ms", [0.5, 0.95, 0.99])
    mark = lambda i: marks.select(f"q{i}").scalar()
    return totals.select(
        "total_queries", "success_rate", "mean_ms", mark(0).alias("median_ms"),
        mark(1).alias("p95_ms"), mark(2).alias("p99_ms"), "max_ms", "min_ms")


def stage_telemetry(log: DataFrame) -> DataFrame:
    """Figures per stage; stages are a map from name to ``elapsed_ms``."""
    stages = log.select(F.explode("stages").alias("stage", "s")).select(
        "stage", F.col("s.elapsed_ms").alias("elapsed_ms"))
    means = stages.groupBy("stage").agg(F.avg("elapsed_ms").alias("mean_ms"))
    marks = exact_quantiles(stages, ["stage"], "elapsed_ms", [0.5, 0.95])
    return means.join(marks, "stage").select(
        "stage", "mean_ms", F.col("q0").alias("median_ms"), F.col("q1").alias("p95_ms"),
        F.col("n").alias("count"))


def cache_stats(log: DataFrame, files: DataFrame, max_mb: float) -> DataFrame:
    """Hit rate of a log of cache events, and how full the cache is."""
    times = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    events = log.agg(times("hit").alias("hits"), times("miss").alias("misses"),
                     times("eviction").alias("evictions"))
    size = files.agg(F.count(F.lit(1)).alias("file_count"),
                     F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"))
    mb = F.col("total_bytes") / (1024.0 * 1024.0)
    return events.withColumns({c: size.select(c).scalar() for c in ("file_count", "total_bytes")}).select(
        "hits", "misses", "evictions",
        ratio(F.col("hits"), F.col("hits") + F.col("misses")).alias("hit_rate"),
        "file_count", "total_bytes",
        (mb / max_mb if max_mb > 0 else F.lit(0.0)).alias("utilization"))


def index_stats(index: DataFrame, kind: str) -> DataFrame:
    return index.groupBy("namespace").agg(
        F.count(F.lit(1)).alias("vectors"),
        F.coalesce(F.max(F.size("vec")), F.lit(0)).cast("long").alias("dimension")
    ).withColumn("index", F.lit(kind))


def index_delta(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """Namespaces whose two indexes hold different numbers of records."""
    a = dense.groupBy("namespace").agg(F.count(F.lit(1)).alias("_d"))
    b = sparse.groupBy("namespace").agg(F.count(F.lit(1)).alias("_s"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return (
        a.join(b, "namespace", "full_outer")
        .select("namespace", n(F.col("_d")).alias("dense"), n(F.col("_s")).alias("sparse"))
        .withColumn("delta", F.col("dense") - F.col("sparse")).filter("delta <> 0")
    )


def channel_summary(messages: DataFrame) -> DataFrame:
    return messages.groupBy("channel_id").agg(
        F.count(F.lit(1)).alias("message_count"), F.max("ts").alias("last_activity")
    ).orderBy(F.desc("last_activity"), "channel_id")


def status_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    times = lambda kind: F.count(F.when(F.col(status) == kind, 1))
    return rows.agg(times("added").alias("added_count"), times("updated").alias("updated_count"),
                    times("failed").alias("failed_count"), F.count(F.lit(1)).alias("total_processed"))


def review_votes(votes: DataFrame, name: str, kinds: list[str], top: int = 5) -> DataFrame:
    """Votes per kind and in total; the libraries with most votes."""
    per = [F.count(F.when(F.col("vote") == k, 1)).alias(k) for k in kinds]
    total = reduce(lambda a, b: a + b, [F.col(k) for k in kinds])
    return (votes.groupBy(name).agg(*per).withColumn("total", total)
            .orderBy(F.desc("total"), name).limit(top))


def cost_rollup(costs: DataFrame, levels: list[str]) -> DataFrame:
    """Cost at every level of the hierarchy and its share of everything."""
    rolled = costs.rollup(*levels).agg(F.sum("cost").alias("cost"), F.grouping_id().alias("level"))
    whole = costs.agg(F.sum("cost")).scalar()
    return rolled.select(*levels, "level", "cost", (F.col("cost") / whole).alias("share"))


def summary_depth(topics: DataFrame) -> DataFrame:
    """Per method: topics, and assertions and timeline entries per topic."""
    return topics.groupBy("method").agg(
        F.count(F.lit(1)).alias("topics"),
        F.avg(F.size("assertions")).alias("avg_assertions"),
        F.avg(F.size("timeline")).alias("avg_timeline"))


def subject_overlap(topics: DataFrame) -> DataFrame:
    """How many subjects each set of methods shares."""
    sets = topics.groupBy("subject").agg(
        F.array_join(F.array_sort(F.collect_set("method")), "+").alias("methods"))
    return sets.groupBy("methods").agg(F.count(F.lit(1)).alias("subjects"))
