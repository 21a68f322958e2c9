"""Joins and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.session import fits_broadcast


def small_left_join(facts: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Left join to a dimension. It is broadcast only when its size was checked;
    otherwise the planner joins by key and splits skewed ones at run time."""
    side = F.broadcast(dim) if fits_broadcast(dim) else dim
    return facts.join(side, key, "left")


def paper_metadata(papers: DataFrame, index: DataFrame) -> DataFrame:
    """Papers with the metadata of their path, else of their file name; others drop out."""
    fields = ["url", "author", "title", "date"]
    by = lambda name: index.select(F.col("key").alias(name), F.struct(*fields).alias(f"m_{name}"))
    return (
        papers.join(by("relative"), "relative", "left")
        .join(by("filename"), "filename", "left")
        .withColumn("m", F.coalesce("m_relative", "m_filename"))
        .filter(F.col("m").isNotNull())
        .select(*papers.columns, "m.*")
    )


def only_ids(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    return rows.join(wanted.select(key), key, "left_semi")


def without_ids(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return rows.join(known.select(key), key, "left_anti")


def flag_existing(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Incoming rows with ``exists``: is the key stored already?"""
    known = existing.select(key).distinct().withColumn("_known", F.lit(True))
    return (incoming.join(known, key, "left")
            .withColumn("exists", F.coalesce("_known", F.lit(False))).drop("_known"))


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def id_set_stats(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Sizes of two id sets and of what they share, in one full outer join."""
    a = left.select(key).distinct().withColumn("_a", F.lit(1))
    b = right.select(key).distinct().withColumn("_b", F.lit(1))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return a.join(b, key, "full_outer").agg(
        F.count("_a").alias("left_ids"), F.count("_b").alias("right_ids"),
        F.count(F.when(both, 1)).alias("both_ids"), F.count(F.lit(1)).alias("all_ids"))


def search_kind(term: Column, channels: list[str], playlists: list[str]) -> Column:
    return (F.when(term.isin(channels), "channel").when(term.isin(playlists), "playlist")
            .otherwise("video"))
