"""Ranking windows over candidates ``query_id, doc_id, score``.

Candidates are few per query (a retriever's top k), so a window per query is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_score(*keys: str, score: str = "score", tie: str = "doc_id") -> Window:
    return Window.partitionBy(*keys).orderBy(F.desc(score), tie)


def ranked(df: DataFrame, *keys: str, score: str = "score", tie: str = "doc_id",
           name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(by_score(*keys, score=score, tie=tie)).cast("long"))


def top_k(df: DataFrame, k: int, *keys: str, score: str = "score", tie: str = "doc_id") -> DataFrame:
    """The k best rows per key; the limit is applied before the shuffle as well."""
    keys = keys or ("query_id",)
    return ranked(df, *keys, score=score, tie=tie).filter(F.col("rank") <= k)


def best_per_id(df: DataFrame, priority: Column) -> DataFrame:
    """One row per query and id: the highest score, then the lowest ``priority``."""
    others = [c for c in df.columns if c not in ("query_id", "doc_id")]
    return (
        df.withColumn("_p", priority).groupBy("query_id", "doc_id")
        .agg(F.max_by(F.struct(*others), F.struct(F.col("score"), -F.col("_p"))).alias("_best"))
        .select("query_id", "doc_id", "_best.*")
    )


def page(df: DataFrame, search_limit: int, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Ranks after ``offset``; a positive limit replaces the search limit."""
    last = offset + limit if limit and limit > 0 else search_limit
    return df.filter((F.col("rank") > offset) & (F.col("rank") <= last))


def near_top(df: DataFrame, share: float, score: str = "score") -> DataFrame:
    """Rows that reach ``share`` of their query's best score."""
    top = F.max(score).over(Window.partitionBy("query_id"))
    return df.withColumn("_top", top).filter(F.col(score) >= share * F.col("_top")).drop("_top")


def diversify(df: DataFrame, source: str, most: Column) -> DataFrame:
    """At most so many rows per query and source, best first."""
    place = F.row_number().over(by_score("query_id", source))
    return df.withColumn("_place", place).filter(F.col("_place") <= most).drop("_place")


def calibrated(df: DataFrame, *keys: str, temperature: float = 1.0) -> DataFrame:
    """z-score, min-max, softmax and percentile of the score within each key."""
    w = Window.partitionBy(*keys)
    s = F.col("score")
    mean, dev = F.avg(s).over(w), F.stddev_pop(s).over(w)
    low, high = F.min(s).over(w), F.max(s).over(w)
    power = F.exp((s - high) / temperature)
    return df.select(
        "*",
        F.when(dev > 1e-12, (s - mean) / dev).otherwise(0.0).alias("zscore"),
        F.when(high > low, (s - low) / (high - low)).otherwise(0.0).alias("minmax"),
        (power / F.sum(power).over(w)).alias("softmax"),
        F.percent_rank().over(w.orderBy("score")).alias("percentile"))
