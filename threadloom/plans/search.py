"""The whole way from documents to ranked chunks, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.ids import chunk_record_id
from threadloom.functions.quality import is_valid_chunk
from threadloom.functions.text import clean_text, strip
from threadloom.operators import bm25, chunking, dense, fusion
from threadloom.plans import fixtures
from threadloom.session import stored
from threadloom.tables import spread, table


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned documents in overlapping chunks, valid ones only, with stable ids."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).select(
        "doc_id", F.col("lang").alias("namespace"), clean_text(F.col("text")).alias("text"))
    cut = chunking.fixed_stride(docs, "doc_id", keep=("namespace",))
    body = strip(F.col("chunk"))
    return cut.filter(is_valid_chunk(body)).select(
        chunk_record_id(F.col("doc_id").cast("string"), F.col("start_index"), body).alias("id"),
        "doc_id", "namespace", "start_index", body.alias("text"))


def search(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """All query texts against all chunks: keyword and dense lists, fused."""
    queries = fixtures.query_texts(spark, sf_dir)
    # Every search reads the chunks several times, so they are written once.
    pieces = stored(chunks(spark, sf_dir), "chunks", "namespace")
    keyword = bm25.bm25_corpus(queries, pieces.select(F.col("id").alias("doc_id"), "text"))
    # Vectors exist per document; each chunk answers with its document's vector.
    vectors = fixtures.vectors(spark, sf_dir).join(pieces.select("doc_id", "id"), "doc_id").select(
        F.col("id").alias("doc_id"), "vec")
    near = dense.dense_topk(fixtures.query_vectors(spark, sf_dir), vectors)
    fused = fusion.weighted_reciprocal(near, keyword).filter(F.col("rank") <= k)
    return fused.join(pieces.select(F.col("id").alias("doc_id"), "namespace", "text"), "doc_id").select(
        "query_id", "rank", "doc_id", "score", "namespace", "text")
