"""Keyword retrieval: BM25 over the corpus or over candidates, and plain term matching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import words
from threadloom.operators.dense import CELLS, Best, bounded_rows
from threadloom.operators.ranking import top_k
from threadloom.session import cut_lineage, sent

K1, B = 1.2, 0.75


def tokens(c: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def idf(n: Column, df: Column) -> Column:
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def saturation(tf: Column, length: Column, mean: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * length / mean))


def query_terms(queries: DataFrame, split: Column) -> DataFrame:
    """``query_id, term, qtf`` of the query texts."""
    return queries.select("query_id", F.explode(split).alias("term")).groupBy(
        "query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def bm25_corpus(queries: DataFrame, docs: DataFrame, k: int = 50, k1: float = K1, b: float = B,
                strategy: str | None = None) -> DataFrame:
    """Top k per query over all docs ``doc_id, text``; docs without a query term drop out.

    Statistics of the query terms come from one pass over the corpus. Then every task
    scores its own docs and keeps k per query. With too many query terms for a broadcast,
    postings are joined by term instead.
    """
    terms = query_terms(queries, tokens(F.col("query_text")))
    split = docs.select("doc_id", tokens(F.col("text")).alias("toks"))
    few = None if strategy == "join" else bounded_rows(terms)
    if few is not None and few["term"].nunique() * few["query_id"].nunique() > CELLS:
        few = None
    if few is None:
        return _by_join(terms, split, k, k1, b)
    return _by_broadcast(few, terms, split, k, k1, b)


def _by_join(terms: DataFrame, split: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    totals = split.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("toks")).alias("mean")).first()
    known = terms.select("term").distinct()
    postings = (
        split.select("doc_id", F.size("toks").alias("len"), F.explode("toks").alias("term"))
        .join(known, "term", "left_semi")
        .groupBy("term", "doc_id", "len").agg(F.count(F.lit(1)).alias("tf")))
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighted = terms.join(df, "term").select(
        "query_id", "term", (F.col("qtf") * idf(F.lit(float(totals["n"])), F.col("df"))).alias("w"))
    part = F.col("w") * saturation(F.col("tf"), F.col("len"), F.lit(totals["mean"]), k1, b)
    scored = (postings.join(weighted, "term").groupBy("query_id", "doc_id")
              .agg(F.round(F.sum(part), 6).alias("score")))
    return top_k(scored, k)


def _by_broadcast(few: pd.DataFrame, terms: DataFrame, split: DataFrame, k: int, k1: float,
                  b: float) -> DataFrame:
    spark = split.sparkSession
    schema = (f"query_id {terms.schema['query_id'].dataType.simpleString()}, "
              f"doc_id {split.schema['doc_id'].dataType.simpleString()}, score double")
    vocabulary = np.array(sorted(few["term"].unique()), dtype=object)
    if not len(vocabulary):
        return top_k(spark.createDataFrame([], schema), k)
    known = spark.sparkContext.broadcast(pa.array(vocabulary, type=pa.string()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per task: how many docs hold each query term, and the size of the docs."""
        df, n, length = np.zeros(len(known.value), dtype=np.int64), 0, 0
        for batch in batches:
            rows, cols, lens = term_places(batch.column(1), known.value)
            df += np.bincount(np.unique(rows * len(df) + cols) % len(df), minlength=len(df))
            n, length = n + len(lens), length + int(lens.sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, len(df))), pa.array(np.concatenate([[n], df])),
             pa.array(np.concatenate([[length], np.zeros(len(df), dtype=np.int64)]))],
            ["place", "docs", "length"])

    stats = (split.mapInArrow(count, "place long, docs long, length long")
             .groupBy("place").agg(F.sum("docs").alias("docs"), F.sum("length").alias("length"))
             .toPandas().sort_values("place"))
    if stats.empty or stats["docs"].iloc[0] == 0:
        return top_k(spark.createDataFrame([], schema), k)
    n, mean = float(stats["docs"].iloc[0]), float(stats["length"].iloc[0]) / float(stats["docs"].iloc[0])
    df = stats["docs"].to_numpy()[1:].astype(float)
    term_idf = np.log(1.0 + (n - df + 0.5) / (df + 0.5))
    query_ids = few["query_id"].drop_duplicates().sort_values().to_numpy()
    weights = np.zeros((len(vocabulary), len(query_ids)))
    at_term = np.searchsorted(vocabulary.astype(str), few["term"].to_numpy().astype(str))
    at_query = np.searchsorted(query_ids, few["query_id"].to_numpy())
    weights[at_term, at_query] = few["qtf"].to_numpy() * term_idf[at_term]
    shared = spark.sparkContext.broadcast((query_ids, weights))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, weights = shared.value
        best = Best(len(query_ids), k, None)
        holds = (weights > 0).astype(float)
        types = None
        for batch in batches:
            types = batch.schema
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            rows, cols, lens = term_places(batch.column(1), known.value)
            step = max(1, CELLS // max(len(weights), len(query_ids)))
            for start in range(0, len(ids), step):
                size = min(step, len(ids) - start)
                here = (rows >= start) & (rows < start + size)
                tf = np.bincount((rows[here] - start) * len(weights) + cols[here],
                                 minlength=size * len(weights)).reshape(size, -1).astype(float)
                base = k1 * (1.0 - b + b * lens[start:start + size, None] / mean)
                scores = np.round((tf * (k1 + 1.0) / (tf + base)) @ weights, 6)
                matched = tf @ holds > 0  # however little a frequent term adds
                for q in range(len(query_ids)):
                    best.offer(q, ids[start:start + size][matched[:, q]], scores[matched[:, q], q])
        for query_id, ids, scores in best.rows(query_ids):
            yield pa.RecordBatch.from_arrays(
                [pa.array([query_id] * len(ids)), pa.array(ids, type=types.field(0).type),
                 pa.array(scores)], ["query_id", "doc_id", "score"])

    return top_k(split.mapInArrow(score, schema), k)


def token_counts(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch ``doc_id, toks``: the distinct words, and row, word and count of every word in a row, by row; list lengths."""
    toks = batch.column(1)
    lens = pc.fill_null(pc.list_value_length(toks), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = toks.flatten().dictionary_encode()
    known = max(1, len(codes.dictionary))
    places = np.repeat(np.arange(len(lens)), lens) * known + codes.indices.to_numpy(zero_copy_only=False)
    places, tf = np.unique(places, return_counts=True)
    return codes.dictionary, places // known, places % known, tf, lens


def repeated(docs: DataFrame) -> DataFrame:
    """The ``doc_id`` that come more than once, null among them."""
    return docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("again"))


def alone_and_repeated(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` whose doc_id comes once, which need no grouping, and the others, if there are."""
    again = cut_lineage(repeated(docs))
    if again.isEmpty():
        return docs, None
    same = F.col("doc_id").eqNullSafe(F.col("again"))
    return docs.join(sent(again), same, "left_anti"), docs.join(sent(again), same, "left_semi")


# Rows of whole groups are scored together up to about this many bytes.
GROUP_BYTES = 16 * 1024 * 1024
NO_ID = np.iinfo(np.int64).min  # stands for a null doc_id within a task


def whole_groups(batches: Iterator[pa.RecordBatch], most: int = GROUP_BYTES) -> Iterator[pa.Table]:
    """Tables of about ``most`` bytes that part no group; rows of a group, the first column, follow each other."""
    held, size, last = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        if size >= most and (other := np.flatnonzero(keys != last)).size:
            yield pa.Table.from_batches([*held, batch.slice(0, other[0])])
            batch = batch.slice(other[0])
            held, size = [], 0
        held.append(batch)
        size, last = size + batch.nbytes, keys[-1]
    if held:
        yield pa.Table.from_batches(held)


def weight_rows(weighted: DataFrame) -> pd.DataFrame | None:
    """The rows ``query_id, term, w``, if they and a matrix of terms and queries are small; otherwise None."""
    few = bounded_rows(weighted)
    if few is not None and few["term"].nunique() * few["query_id"].nunique() > CELLS:
        return None
    return few


def blocks_topk(blocks: DataFrame, few: pd.DataFrame, query_type: str, mean: float, k: int, k1: float = K1,
                b: float = B) -> DataFrame:
    """Top k per query from postings ``group, term, doc_ids, lens, tfs``; all postings of a document lie in one group.

    Postings of the terms of ``few(query_id, term, w)`` go to the task of their group, each once for all queries. A task
    scores its documents and keeps k per query.
    """
    spark = blocks.sparkSession
    schema = f"query_id {query_type}, doc_id long, score double"
    if few.empty:
        return top_k(spark.createDataFrame([], schema), k)
    vocabulary, query_ids = np.array(sorted(few["term"].unique()), dtype=object), np.sort(few["query_id"].unique())
    weights = np.zeros((len(vocabulary), len(query_ids)))
    weights[np.searchsorted(vocabulary.astype(str), few["term"].to_numpy().astype(str)),
            np.searchsorted(query_ids, few["query_id"].to_numpy())] = few["w"].to_numpy()
    places = F.broadcast(spark.createDataFrame([(t, n) for n, t in enumerate(vocabulary.tolist())], "term string, place int"))
    shared = spark.sparkContext.broadcast((query_ids, weights))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, weights = shared.value
        best, holds = Best(len(query_ids), k, None), (weights > 0).astype(float)
        step = max(1, CELLS // max(weights.shape))
        for rows in whole_groups(batches):
            _, place, doc_ids, lens, tfs = (c.combine_chunks() for c in rows.columns)
            cols = np.repeat(place.to_numpy(), pc.list_value_length(doc_ids).to_numpy())
            tf, length = tfs.flatten().to_numpy().astype(float), lens.flatten().to_numpy().astype(float)
            ids, at = np.unique(pc.fill_null(doc_ids.flatten(), NO_ID).to_numpy(), return_inverse=True)
            part = tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * length / mean))
            order = np.argsort(at, kind="stable")
            cells, part = (at * len(weights) + cols)[order], part[order]
            edges = np.searchsorted(at[order], np.arange(0, len(ids) + step, step))
            for start, lo, hi in zip(range(0, len(ids), step), edges, edges[1:]):
                size = min(step, len(ids) - start)
                held = np.bincount(cells[lo:hi] - start * len(weights), part[lo:hi], size * len(weights)).reshape(size, -1)
                scores, matched = np.round(held @ weights, 6), held @ holds > 0
                for q in range(len(query_ids)):
                    best.offer(q, ids[start:start + size][matched[:, q]], scores[matched[:, q], q])
        for query_id, ids, scores in best.rows(query_ids):
            yield pa.RecordBatch.from_arrays([pa.array([query_id] * len(ids)), pa.array(ids, mask=ids == NO_ID), pa.array(scores)],
                                             ["query_id", "doc_id", "score"])

    sought = blocks.join(places, "term").select("group", "place", "doc_ids", "lens", "tfs")
    return top_k(sought.repartition("group").sortWithinPartitions("group").mapInArrow(score, schema), k)


def term_places(column: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, vocabulary place) of every known token of a list column, and list lengths."""
    lens = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    places = pc.index_in(column.flatten(), value_set=vocabulary)
    rows = np.repeat(np.arange(len(lens)), lens)
    found = pc.is_valid(places).to_numpy(zero_copy_only=False)
    cols = pc.fill_null(places, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return rows[found], cols[found], lens


def wanted_docs(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ``docs`` that ``pairs(doc_id)`` name, which are few: the others are dropped where they are read."""
    return docs.join(sent(pairs.select("doc_id").distinct()), "doc_id", "left_semi")


def bm25_candidates(queries: DataFrame, candidates: DataFrame, docs: DataFrame, k: int = 50,
                    k1: float = K1, b: float = B, variant: str = "plus_one") -> DataFrame:
    """BM25 whose statistics come from each query's own candidates ``query_id, doc_id``.

    Tokens are split at white space, case kept. Candidates without a query term stay,
    with score 0. ``variant="okapi"`` uses the plain idf, negative values replaced by a
    quarter of the mean idf.
    """
    pairs = cut_lineage(candidates.select("query_id", "doc_id"))
    texts = wanted_docs(docs, pairs).select("doc_id", words(F.col("text")).alias("toks"))
    rows = pairs.join(texts, "doc_id")
    terms = query_terms(queries, words(F.col("query_text")))
    if variant != "okapi":  # the plain idf needs no other terms than the query's
        known = terms.groupBy("query_id").agg(F.collect_set("term").alias("known"))
        rows = rows.join(sent(known), "query_id", "left").select(
            "query_id", "doc_id", F.size("toks").alias("len"), F.filter("toks", lambda t: F.array_contains("known", t)).alias("toks"))
    else:
        rows = rows.select("query_id", "doc_id", F.size("toks").alias("len"), "toks")
    rows = cut_lineage(rows)
    size = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"))
    exploded = rows.select("query_id", "doc_id", "len", F.explode("toks").alias("term"))
    tf = exploded.groupBy("query_id", "doc_id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    if variant == "okapi":
        every = tf.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("df")).join(size, "query_id")
        raw = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        floor = 0.25 * F.avg("raw").over(Window.partitionBy("query_id"))
        value = every.withColumn("raw", raw).withColumn("floor", floor).select(
            "query_id", "term", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))
    else:
        matched = tf.join(terms.select("query_id", "term"), ["query_id", "term"], "left_semi")
        value = (matched.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("df"))
                 .join(size, "query_id")
                 .select("query_id", "term", idf(F.col("n"), F.col("df")).alias("idf")))
    part = (F.col("qtf") * F.col("idf")
            * saturation(F.col("tf"), F.col("len"), F.col("mean"), k1, b))
    scored = (tf.join(terms, ["query_id", "term"]).join(value, ["query_id", "term"])
              .join(size, "query_id").groupBy("query_id", "doc_id").agg(F.sum(part).alias("s")))
    out = rows.select("query_id", "doc_id").join(scored, ["query_id", "doc_id"], "left").select(
        "query_id", "doc_id", F.round(F.coalesce("s", F.lit(0.0)), 6).alias("score"))
    return top_k(out, k)


def keyword_topk(queries: DataFrame, docs: DataFrame, k: int = 50) -> DataFrame:
    """Share of the distinct query terms a text holds, +0.1 for the whole phrase.

    Terms must stand as tokens; a text without any of them has no score. Inside a longer
    word only the first and last term of a phrase can hide, so the phrase is looked for
    in texts that hold all other terms.
    """
    terms = queries.select("query_id", F.array_distinct(tokens(F.col("query_text"))).alias("terms"),
                           F.lower("query_text").alias("phrase")).filter(F.size("terms") > 0)
    few = bounded_rows(terms)
    schema = (f"query_id {queries.schema['query_id'].dataType.simpleString()}, "
              f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    split = docs.select("doc_id", F.array_distinct(tokens(F.col("text"))).alias("toks"),
                        F.lower("text").alias("low"))
    if few is not None and few["terms"].explode().nunique() * len(few) > CELLS:
        few = None  # the matrix of terms and queries would be too large to broadcast
    if few is None:
        each = terms.select("query_id", F.explode("terms").alias("term"))
        hits = (split.select("doc_id", F.explode("toks").alias("term")).join(each, "term")
                .groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("hits")))
        scored = (hits.join(terms, "query_id").join(split.select("doc_id", "low"), "doc_id")
                  .select("query_id", "doc_id", F.round(
                      F.col("hits") / F.size("terms")
                      + F.when(F.contains("low", F.col("phrase")), 0.1).otherwise(0.0), 6).alias("score")))
        return top_k(scored, k)
    if few.empty:
        return top_k(docs.sparkSession.createDataFrame([], schema), k)
    vocabulary = np.array(sorted({t for ts in few["terms"] for t in ts}), dtype=object)
    member = np.zeros((len(vocabulary), len(few)))
    for q, ts in enumerate(few["terms"]):
        member[np.searchsorted(vocabulary.astype(str), np.array(list(ts)).astype(str)), q] = 1.0 / len(ts)
    shared = docs.sparkSession.sparkContext.broadcast((
        pa.array(vocabulary, type=pa.string()), member, few["query_id"].to_numpy(), list(few["phrase"]),
        [len(ts) for ts in few["terms"]]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, member, query_ids, phrases, sizes = shared.value
        best = Best(len(query_ids), k, None)
        types = None
        for batch in batches:
            types = batch.schema
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            rows, cols, _ = term_places(batch.column(1), known)
            step = max(1, CELLS // max(len(member), len(query_ids)))
            for start in range(0, len(ids), step):
                size = min(step, len(ids) - start)
                here = (rows >= start) & (rows < start + size)
                present = np.bincount((rows[here] - start) * len(member) + cols[here],
                                      minlength=size * len(member)).reshape(size, -1).astype(float)
                scores = present @ member
                matched = scores > 0
                lows = batch.column(2).slice(start, size)
                for q, phrase in enumerate(phrases):
                    full = (scores[:, q] > 0) & (scores[:, q] >= 1.0 - 2.0 / sizes[q] - 1e-9)
                    if full.any():
                        has = pc.match_substring(lows.filter(pa.array(full)), phrase)
                        at = np.flatnonzero(full)
                        scores[at, q] += 0.1 * pc.fill_null(has, False).to_numpy(zero_copy_only=False)
                    best.offer(q, ids[start:start + size][matched[:, q]], np.round(scores[matched[:, q], q], 6))
        for query_id, ids, scores in best.rows(query_ids):
            yield pa.RecordBatch.from_arrays(
                [pa.array([query_id] * len(ids)), pa.array(ids, type=types.field(0).type),
                 pa.array(scores)], ["query_id", "doc_id", "score"])

    return top_k(split.mapInArrow(score, schema), k)
