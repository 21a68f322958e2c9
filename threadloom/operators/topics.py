"""Topics of recent discussions and their timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.ordering import row_number


def recent_threads(mail: DataFrame, start: str, end: str, most: int = 5) -> DataFrame:
    """Threads with most messages between two ISO dates (``sent_at``)."""
    return (
        mail.filter((F.col("sent_at") >= start) & (F.col("sent_at") < end))
        .groupBy("thread_id").agg(F.count(F.lit(1)).alias("messages"))
        .orderBy(F.desc("messages"), "thread_id").limit(most))


def clusters(vectors: DataFrame, k: int = 10, seed: int = 42) -> DataFrame:
    """Topics by KMeans: ``doc_id, topic``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = vectors.select("doc_id", array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed, maxIter=20).fit(points).transform(points).select(
        "doc_id", F.col("prediction").alias("topic"))


def timeline(recent: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Recent and retrieved messages of each topic, once each, in order of time.

    Both carry ``topic, msg_id, sent_at, url``. Positions are counted day by day, so a
    topic that holds most messages does not end up in one task.
    """
    rows = recent.unionByName(retrieved).dropDuplicates(["topic", "msg_id"])
    day = F.coalesce(F.unix_date(F.substring("sent_at", 1, 10).try_cast("date")), F.lit(0))
    return row_number(rows, ["topic"], [F.col("sent_at"), F.col("msg_id")], day, "position")


def timeline_by_day(rows: DataFrame) -> DataFrame:
    return rows.groupBy("topic", F.substring("sent_at", 1, 10).alias("date")).agg(
        F.count(F.lit(1)).alias("messages"),
        F.array_sort(F.collect_set("url")).alias("references"))
