"""A keyword index as tables: built once from a corpus, searched by many query sets.

``postings`` holds ``term, chunk, doc_ids, lens, tfs``, a term's postings in one chunk of documents, in files by a hash of the
term and in order of the term inside, so that a search reads the folders and row groups of its terms only. A chunk is
what a task read in a row, up to CHUNK_TOKENS; a row without a term lists its documents. ``terms`` holds the
document frequencies and ``corpus`` one row with the number of documents and their mean length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.bm25 import (
    B, K1, alone_and_repeated, blocks_topk, idf, query_terms, saturation, token_counts, tokens, weight_rows)
from threadloom.operators.ranking import top_k

CHUNK_TOKENS = 2_000_000
CHUNK_DOCS = 5_000
POSTINGS = "term string, chunk long, doc_ids array<long>, lens array<int>, tfs array<int>"


def bucket_of(buckets: int):
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def posting_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the documents ``doc_id, toks``, each doc_id once, by chunk and term."""
    first = TaskContext.get().partitionId() << 32
    held, size, docs, number = [], 0, 0, 0
    for batch in batches:
        held.append(batch)
        size, docs = size + len(batch.column(1).flatten()), docs + len(batch)
        if size >= CHUNK_TOKENS or docs >= CHUNK_DOCS:
            yield _chunk(held, first + number)
            held, size, docs, number = [], 0, 0, number + 1
    if docs:
        yield _chunk(held, first + number)


def _chunk(batches: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
    whole = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
    words, rows, cols, tf, _ = token_counts(whole)
    order = np.argsort(cols, kind="stable")
    rows, cols, tf = rows[order], cols[order], tf[order]
    lens = pc.list_value_length(whole.column(1))
    edges = np.searchsorted(cols, np.arange(len(words) + 1))
    edges = np.append(edges, len(rows) + len(whole)).astype(np.int32)  # the last row is that of the documents
    at = pa.array(np.concatenate([rows, np.arange(len(whole))]))
    lists = [pa.ListArray.from_arrays(pa.array(edges), values) for values in (
        whole.column(0).take(at), lens.take(at), pa.array(np.concatenate([tf, np.zeros(len(whole), np.int64)]).astype(np.int32)))]
    return pa.RecordBatch.from_arrays(
        [pa.concat_arrays([words, pa.array([None], words.type)]), pa.array(np.full(len(words) + 1, number)), *lists],
        names=[f.split()[0] for f in POSTINGS.split(", ")])


def _grouped_blocks(split: DataFrame) -> DataFrame:
    """The same of documents whose doc_id comes again: rows of one id and length count as one document."""
    counted = (split.select("doc_id", F.size("toks").alias("len"), F.explode_outer("toks").alias("term"))
               .groupBy("doc_id", "len", "term").agg(F.count(F.lit(1)).cast("int").alias("tf")))
    listed = counted.filter("term IS NOT NULL").unionByName(
        counted.select("doc_id", "len").distinct().select("*", F.lit(None).cast("string").alias("term"), F.lit(0).alias("tf")))
    chunk = -1 - F.pmod(F.xxhash64("doc_id"), F.lit(max(1, split.count() // CHUNK_DOCS)))
    blocks = listed.groupBy("term", chunk.alias("chunk")).agg(F.collect_list(F.struct("doc_id", "len", "tf")).alias("d"))
    return blocks.select("term", "chunk", F.col("d.doc_id").alias("doc_ids"), F.col("d.len").alias("lens"), F.col("d.tf").alias("tfs"))


def build(docs: DataFrame, path: str, buckets: int = 64) -> None:
    """Index ``docs(doc_id, text)`` below ``path``. The texts are read and split once.

    Postings are counted where a text is read and shuffled once, by term. A frequent term's postings are spread by
    chunk over several tasks and files.
    """
    alone, again = alone_and_repeated(docs)
    split = lambda rows: rows.select("doc_id", tokens(F.col("text")).alias("toks"))
    blocks = split(alone).mapInArrow(posting_blocks, POSTINGS)
    if again is not None:
        blocks = blocks.unionByName(_grouped_blocks(split(again)))
    spread = F.pmod(F.xxhash64("chunk"), F.lit(8))
    (blocks.withColumn("bucket", F.when(F.col("term").isNull(), -1).otherwise(bucket_of(buckets)))  # -1: the documents
     .repartition("bucket", spread).sortWithinPartitions("bucket", "term", "chunk")
     .write.partitionBy("bucket").parquet(f"{path}/postings"))
    stored = _postings(docs.sparkSession, path)
    stored.filter("bucket >= 0").groupBy("term", "bucket").agg(F.sum(F.size("doc_ids")).alias("df")).write.parquet(f"{path}/terms")
    per_doc = (stored.filter("bucket = -1").select(F.explode(F.arrays_zip("doc_ids", "lens")).alias("d"))
               .groupBy(F.col("d.doc_ids").alias("doc_id")).agg(F.max("d.lens").alias("len")))
    per_doc.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"), F.lit(buckets).alias("buckets")).write.parquet(f"{path}/corpus")


def _postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POSTINGS + ", bucket int").parquet(f"{path}/postings")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 50, k1: float = K1, b: float = B) -> DataFrame:
    """BM25 top k of ``queries(query_id, query_text)``, as over the corpus itself.

    With too many query terms for a broadcast, postings are joined by term.
    """
    corpus = spark.read.parquet(f"{path}/corpus").first()
    terms = query_terms(queries, tokens(F.col("query_text"))).withColumn("bucket", bucket_of(corpus["buckets"]))
    df = spark.read.parquet(f"{path}/terms")
    weighted = terms.join(df, ["bucket", "term"]).select(
        "query_id", "bucket", "term", (F.col("qtf") * idf(F.lit(float(corpus["n"])), F.col("df"))).alias("w"))
    postings = _postings(spark, path)
    few = weight_rows(weighted.select("query_id", "term", "w"))
    if few is None:
        part = F.col("w") * saturation(F.col("d.tfs"), F.col("d.lens"), F.lit(corpus["mean"]), k1, b)
        scored = (postings.join(weighted, ["bucket", "term"])
                  .select("query_id", "w", F.explode(F.arrays_zip("doc_ids", "lens", "tfs")).alias("d"))
                  .groupBy("query_id", F.col("d.doc_ids").alias("doc_id")).agg(F.round(F.sum(part), 6).alias("score")))
        return top_k(scored, k)
    here = postings.join(F.broadcast(weighted.select("bucket", "term").distinct()), ["bucket", "term"], "left_semi")
    return blocks_topk(here.withColumnRenamed("chunk", "group"), few, queries.schema["query_id"].dataType.simpleString(),
                       corpus["mean"], k, k1, b)
