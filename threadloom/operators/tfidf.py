"""TF-IDF over one- and two-word terms, and reranking by it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom import fixed_values as fv
from threadloom.functions.text import WORD_SET, let
from threadloom.operators.bm25 import wanted_docs
from threadloom.operators.ranking import top_k
from threadloom.session import cut_lineage, stored

BUCKETS = 1 << 20


def kept_words(c: Column) -> Column:
    """Words of two characters or more without stop words."""
    raw = F.regexp_extract_all(F.lower(c), F.lit(f"[{WORD_SET}]{{2,}}"), F.lit(0))
    return F.filter(raw, lambda w: ~w.isin(fv.STOP_WORDS))


def terms(c: Column) -> Column:
    """Those words, then neighbouring pairs."""
    return let(kept_words(c), _with_pairs)


def _with_pairs(kept: Column) -> Column:
    pairs = F.zip_with(F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))),
                       F.slice(kept, F.lit(2), F.greatest(F.size(kept) - 1, F.lit(0))),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(kept, pairs)


@dataclass(frozen=True)
class TfidfModel:
    """``vocabulary``: term, idf. At most ``features`` rows, so it may be broadcast."""

    vocabulary: DataFrame


def _terms(batch: pa.RecordBatch, buckets: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of lists of words: the distinct words, row and key of every term, and the term's bucket. A key has the place of the
    first word and, for a pair, that of the second."""
    lists = batch.column(0)
    lens = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = lists.flatten().dictionary_encode()
    words, code = codes.dictionary, codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    hashes = pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)[code]
    row = np.repeat(np.arange(len(lens)), lens)
    pair = np.flatnonzero(row[1:] == row[:-1])
    second = hashes[pair + 1] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
    mixed = np.concatenate([hashes, (hashes[pair] ^ (second >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + second])
    key = np.concatenate([code * (len(words) + 1), code[pair] * (len(words) + 1) + code[pair + 1] + 1])
    return words, np.concatenate([row, row[pair]]), key, (mixed >> np.uint64(32)).astype(np.int64) % buckets


def _count_buckets(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            n += np.bincount(_terms(batch, buckets)[3], minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["bucket", "n"])
    return count


def _count_terms(chosen: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts the terms of the chosen buckets, and the documents that hold them."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, row, key, bucket = _terms(batch, len(chosen))
            some = chosen[bucket]
            keys, at, total = np.unique(key[some], return_inverse=True, return_counts=True)
            df = np.bincount(np.unique(at * (len(batch) + 1) + row[some]) // (len(batch) + 1), minlength=len(keys))
            first, second = words.take(pa.array(keys // (len(words) + 1))), keys % (len(words) + 1)
            other = words.take(pa.array(second - 1, mask=second == 0))
            term = pc.if_else(pa.array(second == 0), first, pc.binary_join_element_wise(first, other, " "))
            yield pa.RecordBatch.from_arrays([term, pa.array(total), pa.array(df)], ["term", "total", "df"])
    return count


def fit(docs: DataFrame, features: int = 10_000, buckets: int = BUCKETS) -> TfidfModel:
    """Vocabulary of the most frequent terms (count, then term) with smoothed idf.

    Every term is counted into one of the ``buckets``. A bucket's count bounds those of its terms, so only terms of the
    fullest buckets are counted each by itself; should another bucket reach the least count that was taken, those that
    do are counted as well. Texts are split once.
    """
    spark, n = docs.sparkSession, docs.count()
    split = stored(docs.select(kept_words(F.col("text")).alias("words")), "tfidf-words")
    sums = split.mapInArrow(_count_buckets(buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    sums = stored(sums, "tfidf-buckets")
    chosen = sums.orderBy(F.desc("n"), "bucket").limit(2 * features)
    while True:
        chosen = cut_lineage(chosen)
        flags = np.zeros(buckets, bool)
        flags[[r.bucket for r in chosen.select("bucket").collect()]] = True
        shared = spark.sparkContext.broadcast(flags)
        counted = split.mapInArrow(lambda batches: _count_terms(shared.value)(batches), "term string, total long, df long")
        most = cut_lineage(counted.groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))
                           .orderBy(F.desc("total"), "term").limit(features))
        least = most.agg(F.when(F.count(F.lit(1)) >= features, F.min("total")).otherwise(0)).first()[0]
        if sums.join(chosen, "bucket", "left_anti").filter(F.col("n") >= least).isEmpty():
            break
        chosen = sums.filter(F.col("n") >= least).unionByName(chosen).distinct()
    return TfidfModel(cut_lineage(most.select(
        "term", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0).alias("idf"))))


def vectors(model: TfidfModel, rows: DataFrame, key: str, text: str) -> DataFrame:
    """Long, L2-normalised vectors: ``key, term, w``."""
    exploded = rows.select(key, F.explode(terms(F.col(text))).alias("term"))
    weighted = (exploded.join(F.broadcast(model.vocabulary), "term").groupBy(key, "term")
                .agg((F.count(F.lit(1)) * F.first("idf")).alias("w")))
    norms = weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norms, key).select(key, "term", (F.col("w") / F.col("norm")).alias("w"))


def similarity(model: TfidfModel, queries: DataFrame, pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Cosine of the given (query, doc) pairs only; 0 when no term is shared."""
    wanted = wanted_docs(docs, pairs)
    d = vectors(model, wanted, "doc_id", "text").withColumnRenamed("w", "dw")
    q = vectors(model, queries, "query_id", "query_text").withColumnRenamed("w", "qw")
    shared = (pairs.select("query_id", "doc_id").join(q, "query_id").join(d, ["doc_id", "term"])
              .groupBy("query_id", "doc_id").agg(F.sum(F.col("qw") * F.col("dw")).alias("similarity")))
    return pairs.join(shared, ["query_id", "doc_id"], "left").withColumn(
        "similarity", F.coalesce("similarity", F.lit(0.0)))


def rerank(model: TfidfModel, queries: DataFrame, fused: DataFrame, docs: DataFrame,
           k: int = 50) -> DataFrame:
    """0.9 · score + 0.1 · similarity, ranked."""
    pairs = similarity(model, queries, fused.select("query_id", "doc_id", "score"), docs)
    final = F.round(fv.ENSEMBLE_WEIGHT * F.col("score") + fv.TFIDF_WEIGHT * F.col("similarity"), 6)
    return top_k(pairs.select("query_id", "doc_id", F.round("similarity", 6).alias("similarity"),
                              final.alias("score")), k)
