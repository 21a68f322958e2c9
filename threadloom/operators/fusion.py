"""Joining result lists of several retrievers. Lists carry ``query_id, doc_id, score, rank``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom import fixed_values as fv
from threadloom.operators.ranking import best_per_id, ranked, top_k


def union_hits(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """Both lists, with the method that found a row."""
    cols = ["query_id", "doc_id", "score", "rank"]
    return dense.select(*cols, F.lit("dense").alias("method")).unionByName(
        sparse.select(*cols, F.lit("sparse").alias("method")))


def merged_hits(hits: DataFrame, k: int | None = None) -> DataFrame:
    """One row per document with its highest score; dense wins ties."""
    best = best_per_id(hits.drop("rank"), F.when(F.col("method") == "dense", 0).otherwise(1))
    return ranked(best, "query_id") if k is None else top_k(best, k)


def reciprocal(df: DataFrame) -> DataFrame:
    return df.withColumn("reciprocal", 1.0 / F.col("rank"))


def weighted_reciprocal(dense: DataFrame, sparse: DataFrame, dense_weight: float = fv.DENSE_WEIGHT,
                        sparse_weight: float = fv.SPARSE_WEIGHT) -> DataFrame:
    """0.6/rank in the dense list + 0.4/rank in the sparse list."""
    d = dense.select("query_id", "doc_id", F.col("rank").alias("dense_rank"))
    s = sparse.select("query_id", "doc_id", F.col("rank").alias("sparse_rank"))
    part = lambda w, c: F.coalesce(F.lit(w) / F.col(c), F.lit(0.0))
    both = d.join(s, ["query_id", "doc_id"], "full_outer")
    return ranked(both.withColumn("score", F.round(
        part(dense_weight, "dense_rank") + part(sparse_weight, "sparse_rank"), 6)), "query_id")


def rrf(lists: DataFrame, constant: int = fv.RRF_K, k: int = 10) -> DataFrame:
    """Reciprocal rank fusion of the lists of all variants of a query."""
    fused = lists.groupBy("query_id", "doc_id").agg(
        F.round(F.sum(1.0 / (constant + F.col("rank"))), 6).alias("score"),
        F.count(F.lit(1)).alias("lists"))
    return top_k(fused, k)


def by_weights(hits: DataFrame, weights: DataFrame, keys: list[str], k: int = 10) -> DataFrame:
    """Weighted sum of method scores; weights come from a small table."""
    fused = (hits.join(F.broadcast(weights), keys).groupBy("query_id", "doc_id")
             .agg(F.round(F.sum(F.col("score") * F.col("weight")), 6).alias("score")))
    return top_k(fused, k)


def append_unseen(first: DataFrame, more: DataFrame, k: int) -> DataFrame:
    """The first list, then what only the second has, up to k."""
    cols = ["query_id", "doc_id", "rank"]
    both = first.select(*cols, F.lit(0).alias("part")).unionByName(
        more.select(*cols, F.lit(1).alias("part")))
    kept = both.groupBy("query_id", "doc_id").agg(F.min(F.struct("part", "rank")).alias("at"))
    place = (-(F.col("at.part") * 1_000_000_000 + F.col("at.rank"))).cast("double")
    return top_k(kept.withColumn("score", place), k).select(
        "query_id", "doc_id", F.when(F.col("at.part") == 0, "fused").otherwise("feedback").alias("origin"), "rank")


def learn_to_rank(features: DataFrame, names: list[str], label: str, k: int = 10) -> DataFrame:
    """Fusion learnt from judged rows: a logistic model over the method scores."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=names, outputCol="features").transform(features)
    judged = rows.filter(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("double"))
    model = LogisticRegression(featuresCol="features", labelCol=label, maxIter=20, regParam=0.01).fit(judged)
    scored = model.transform(rows.drop(label)).select(
        "query_id", "doc_id", F.round(vector_to_array("probability")[1], 6).alias("score"))
    return top_k(scored, k)


def recency_blend(raw: Column, age_days: Column) -> Column:
    """raw · (0.7 + 0.3 · weight), the weight decaying with age."""
    from threadloom.functions.dates import decay

    return raw * (0.7 + 0.3 * decay(age_days, fv.BLEND_DAYS))
