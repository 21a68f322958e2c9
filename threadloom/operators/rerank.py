"""Reranking of candidates. Candidates are few per query; groups below are per query."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators.dense import cosine, unit_rows
from threadloom.operators.ranking import ranked, top_k


def recency(df: DataFrame, kind: Column, bonus: Column) -> DataFrame:
    """Mail counts with score · (0.5 + bonus); other rows keep their score."""
    score = F.when(kind == "mail", F.col("score") * (0.5 + bonus)).otherwise(F.col("score"))
    return ranked(df.withColumn("score", F.round(score, 6)), "query_id")


def max_sim(query_tokens: DataFrame, doc_tokens: DataFrame, pairs: DataFrame) -> DataFrame:
    """Late interaction: for each query token the best dot product with a doc token, summed.

    Token tables carry ``query_id|doc_id, tokens ARRAY<ARRAY<…>>``. Runs inside the row,
    for the given pairs only.
    """
    dot = lambda a, b: F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    best = lambda q, ds: F.array_max(F.transform(ds, lambda d: dot(q, d)))
    rows = pairs.join(query_tokens.withColumnRenamed("tokens", "qt"), "query_id").join(
        doc_tokens.withColumnRenamed("tokens", "dt"), "doc_id")
    total = F.aggregate(F.transform("qt", lambda q: best(q, F.col("dt"))), F.lit(0.0), lambda s, x: s + x)
    return rows.select("query_id", "doc_id", F.round(total, 6).alias("score"))


def two_stage(stage_one: DataFrame, second: DataFrame, query_code: DataFrame, k1: int = 20,
              k2: int = 5) -> DataFrame:
    """The best k1 by the first score; reordered by the second where code is involved.

    ``stage_one`` has ``has_code`` per row, ``query_code`` per query; code counts when the
    query or one of the best five rows has it.
    """
    first = top_k(stage_one, k1)
    head = F.max(F.when(F.col("rank") <= 5, F.col("has_code"))).over(Window.partitionBy("query_id"))
    rows = (first.withColumn("_head", F.coalesce(head, F.lit(False)))
            .join(query_code, "query_id", "left")
            .join(second.select("query_id", "doc_id", F.col("score").alias("late")), ["query_id", "doc_id"], "left")
            .withColumn("rescored", F.col("_head") | F.coalesce("query_has_code", F.lit(False))))
    score = F.when(F.col("rescored"), F.coalesce("late", F.lit(0.0))).otherwise(F.col("score"))
    return top_k(rows.drop("rank").withColumn("score", score), k2).select(
        "query_id", "doc_id", "score", "rescored", "rank")


def external_scores(merged: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """Rank by scores computed elsewhere. Queries without any keep their merged order."""
    rows = merged.join(scores.select("query_id", "doc_id", F.col("score").alias("given")),
                       ["query_id", "doc_id"], "left")
    any_given = F.max(F.col("given").isNotNull()).over(Window.partitionBy("query_id"))
    rows = rows.withColumn("reranked", any_given).filter(~F.col("reranked") | F.col("given").isNotNull())
    return top_k(rows.drop("rank").withColumn("score", F.coalesce("given", "score")), k).select(
        "query_id", "doc_id", "score", "reranked", "rank")


def mmr(candidates: DataFrame, vectors: DataFrame, k: int = 10, weight: float = 0.5) -> DataFrame:
    """Maximal marginal relevance over each query's candidates, ties by id."""
    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id").reset_index(drop=True)
        rel = pdf["score"].to_numpy(dtype=float)
        span = rel.max() - rel.min()
        rel = (rel - rel.min()) / span if span > 0 else np.zeros_like(rel)
        unit = unit_rows(np.stack([np.asarray(v, dtype=float) for v in pdf["vec"]]))
        nearest = np.full(len(pdf), -np.inf)
        chosen: list[int] = []
        while len(chosen) < min(k, len(pdf)):
            gain = rel if not chosen else weight * rel - (1 - weight) * nearest
            gain = np.where(np.isin(np.arange(len(pdf)), chosen), -np.inf, np.round(gain, 9))
            at = int(np.argmax(gain))
            chosen.append(at)
            nearest = np.maximum(nearest, unit @ unit[at])
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[chosen].to_numpy(),
                             "doc_id": pdf["doc_id"].iloc[chosen].to_numpy(),
                             "rank": np.arange(1, len(chosen) + 1)})

    rows = candidates.select("query_id", "doc_id", "score").join(vectors, "doc_id")
    schema = (f"query_id {rows.schema['query_id'].dataType.simpleString()}, "
              f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, rank long")
    return rows.groupBy("query_id").applyInPandas(pick, schema)


def drop_near_duplicates(candidates: DataFrame, vectors: DataFrame, limit: float = 0.95,
                         greedy: bool = False) -> DataFrame:
    """Drop a row too close to a better-ranked one of its query.

    By default any better-ranked row counts; ``greedy`` compares with kept rows only.
    """
    rows = candidates.join(vectors, "doc_id")
    columns = list(candidates.columns)
    if greedy:
        def keep(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("rank")
            unit = unit_rows(np.stack([np.asarray(v, dtype=float) for v in pdf["vec"]]))
            kept: list[int] = []
            for at in range(len(pdf)):
                if not kept or np.round(unit[kept] @ unit[at], 6).max() < limit:
                    kept.append(at)
            return pdf.iloc[kept][columns]

        return rows.groupBy("query_id").applyInPandas(keep, candidates.schema)
    # The better-ranked rows of a query travel with each row as one bounded array.
    ahead = F.collect_list(F.struct("doc_id", "vec")).over(
        Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    close = F.exists("_ahead", lambda a: F.round(cosine(a["vec"], F.col("vec")), 6) >= limit)
    return rows.withColumn("_ahead", ahead).filter(~close).select(*columns)


def authority(candidates: DataFrame, messages: DataFrame, sender_weight: float = 0.2,
              thread_weight: float = 0.15) -> DataFrame:
    """Boost busy senders and active threads.

    messages: ``doc_id, sender, thread_id``. Counts are aggregated before they are joined.
    """
    senders = messages.groupBy("sender").agg(F.count(F.lit(1)).alias("ns"))
    threads = messages.groupBy("thread_id").agg(F.count(F.lit(1)).alias("nt"))
    rows = candidates.join(messages, "doc_id").join(senders, "sender").join(threads, "thread_id")
    boost = (1.0 + sender_weight * F.log1p("ns") / senders.agg(F.max(F.log1p("ns"))).scalar()
             + thread_weight * F.log1p("nt") / threads.agg(F.max(F.log1p("nt"))).scalar())
    return ranked(rows.select("query_id", "doc_id", F.round(F.col("score") * boost, 6).alias("score")), "query_id")


def context(ranked_rows: DataFrame, budget: int = 2000, min_score: float = 0.6) -> DataFrame:
    """Ranked texts of a query joined while they fit the budget; the first that does not
    fit ends the context."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = (ranked_rows.filter(F.col("score") >= min_score)
            .withColumn("used", F.sum(F.length("text")).over(w)).filter(F.col("used") <= budget))
    parts = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return rows.groupBy("query_id").agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("context"),
        F.count(F.lit(1)).alias("parts"), F.max("used").cast("long").alias("chars"))


def retrieval_quality(results: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """Precision, recall and reciprocal rank per query from judgments ``query_id, doc_id``."""
    relevant = judged.select("query_id", "doc_id").distinct()
    hits = results.select("query_id", "doc_id").join(relevant, ["query_id", "doc_id"], "left_semi")
    totals = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    return quality_from_counts(results, hits, totals, k)


def quality_from_counts(results: DataFrame, hits: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """The same from the relevant results and the number of relevant docs per query."""
    flagged = results.filter(F.col("rank") <= k).join(
        hits.select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
    per = flagged.groupBy("query_id").agg(
        F.count("hit").alias("hits"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"))
    return per.join(totals.select("query_id", "relevant"), "query_id", "left").select(
        "query_id", "hits", F.round(F.col("hits") / k, 6).alias("precision"),
        F.round(F.coalesce(F.col("hits") / F.col("relevant"), F.lit(0.0)), 6).alias("recall"),
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"))
