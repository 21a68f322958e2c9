"""Exact dense retrieval: cosine top-k of many queries at once.

No pair of query and chunk ever becomes a row. Every task multiplies its own chunks with
the queries and keeps k results per query; only those are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.ranking import top_k
from threadloom.session import BROADCAST_LIMIT_BYTES, measured_bytes

CELLS = 4_000_000  # scores held at once in a task


def bounded_rows(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> pd.DataFrame | None:
    """The rows, if their measured size is within the limit; otherwise None."""
    return df.toPandas() if measured_bytes(df) <= limit else None


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


class Best:
    """The k best ids per query seen so far in one task; ties go to the lower id."""

    def __init__(self, n_queries: int, k: int, threshold: float | None):
        self.k, self.threshold = k, threshold
        self.kept: list[tuple[np.ndarray, np.ndarray] | None] = [None] * n_queries

    def offer(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if self.threshold is not None:
            good = scores >= self.threshold
            ids, scores = ids[good], scores[good]
        if self.kept[q] is not None:
            ids = np.concatenate([self.kept[q][0], ids])
            scores = np.concatenate([self.kept[q][1], scores])
        if len(scores) > self.k:
            cut = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            near = scores >= cut
            ids, scores = ids[near], scores[near]
            order = np.lexsort((ids, -scores))[: self.k]
            ids, scores = ids[order], scores[order]
        if len(scores):
            self.kept[q] = (ids, scores)

    def rows(self, query_ids: np.ndarray) -> Iterator[tuple[object, np.ndarray, np.ndarray]]:
        for q, kept in enumerate(self.kept):
            if kept is not None:
                yield query_ids[q], kept[0], kept[1]


def offer_products(best: Best, ids: np.ndarray, chunks: np.ndarray, queries: np.ndarray,
                   chunk_space: np.ndarray | None, query_space: np.ndarray | None) -> None:
    """Score ``chunks`` against ``queries``, block by block, inside equal name spaces."""
    spaces = [None] if query_space is None else list(np.unique(query_space))
    for space in spaces:
        c_at = np.arange(len(ids)) if space is None else np.flatnonzero(chunk_space == space)
        q_at = np.arange(len(queries)) if space is None else np.flatnonzero(query_space == space)
        if not len(c_at):
            continue
        step = max(1, CELLS // len(c_at))
        for start in range(0, len(q_at), step):
            block = q_at[start:start + step]
            scores = np.round(chunks[c_at] @ queries[block].T, 6)
            for col, q in enumerate(block):
                best.offer(q, ids[c_at], scores[:, col])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return unit_rows(flat.reshape(len(column), -1)) if len(column) else flat.reshape(0, 0)


def _np(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _ddl(df: DataFrame, name: str) -> str:
    return f"{name} {df.schema[name].dataType.simpleString()}"


def dense_topk(queries: DataFrame, chunks: DataFrame, k: int = 50, threshold: float | None = 0.3,
               within: str | None = None, strategy: str | None = None) -> DataFrame:
    """``query_id, doc_id, score, rank`` of the k nearest chunks per query.

    queries: ``query_id, query_vec`` · chunks: ``doc_id, vec``; both carry the column
    named by ``within`` when results must share it. Few queries are broadcast; more are
    spread over a grid of query and chunk blocks. A query meets the chunks whose vectors
    are as long as its own, and no others.
    """
    extra = [within] if within else []
    queries = queries.filter("query_vec IS NOT NULL").select("query_id", "query_vec", *extra)
    chunks = chunks.filter("vec IS NOT NULL").select("doc_id", "vec", *extra)
    few = None if strategy == "grid" else bounded_rows(queries)
    if few is not None:
        found = _with_broadcast(few, queries, chunks, k, threshold, within)
    else:
        found = _on_grid(queries, chunks, k, threshold, within)
    return top_k(found, k)


def _with_broadcast(few: pd.DataFrame, queries: DataFrame, chunks: DataFrame, k: int,
                    threshold: float | None, within: str | None) -> DataFrame:
    schema = f"{_ddl(queries, 'query_id')}, {_ddl(chunks, 'doc_id')}, score double"
    spark = chunks.sparkSession
    if few.empty:
        return spark.createDataFrame([], schema)
    groups = {}
    for dim, part in few.groupby(few["query_vec"].map(len)):
        groups[dim] = (part["query_id"].to_numpy(),
                       unit_rows(np.stack([np.asarray(v, dtype=np.float64) for v in part["query_vec"]])),
                       part[within].to_numpy() if within else None)
    shared = spark.sparkContext.broadcast(groups)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bests = {dim: Best(len(ids), k, threshold) for dim, (ids, _, _) in shared.value.items()}
        types = None
        for batch in batches:
            types = batch.schema
            lengths = pc.list_value_length(batch.column(1))
            for dim, best in bests.items():
                rows = batch.filter(pc.equal(lengths, dim))
                _, vectors, query_space = shared.value[dim]
                offer_products(best, _np(rows.column(0)), _matrix(rows.column(1)), vectors,
                               _np(rows.column(2)) if within else None, query_space)
        for dim, best in bests.items():
            for query_id, ids, scores in best.rows(shared.value[dim][0]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([query_id] * len(ids)), pa.array(ids, type=types.field(0).type),
                     pa.array(scores)], ["query_id", "doc_id", "score"])

    return chunks.mapInArrow(search, schema)


def _on_grid(queries: DataFrame, chunks: DataFrame, k: int, threshold: float | None,
             within: str | None, block_numbers: int = 4_000_000) -> DataFrame:
    """Blocks are cut by a hash of the id, so a hot name space is spread like any other. A block
    has about ``block_numbers`` components, however long the vectors are."""
    def blocks(df: DataFrame, vec: str) -> int:
        return max(1, -(-(df.agg(F.sum(F.size(vec))).first()[0] or 0) // block_numbers))

    q_blocks, c_blocks = blocks(queries, "query_vec"), blocks(chunks, "vec")
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("_qb", block("query_id", q_blocks)).withColumn("_cb", every(c_blocks)).withColumn(
        "_dim", F.size("query_vec"))
    right = chunks.withColumn("_cb", block("doc_id", c_blocks)).withColumn("_qb", every(q_blocks)).withColumn(
        "_dim", F.size("vec"))
    cell = ["_qb", "_cb", "_dim"]

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(q) and len(c):
            stack = lambda s: unit_rows(np.stack([np.asarray(v, dtype=np.float64) for v in s]))
            best = Best(len(q), k, threshold)
            offer_products(best, c["doc_id"].to_numpy(), stack(c["vec"]), stack(q["query_vec"]),
                           c[within].to_numpy() if within else None,
                           q[within].to_numpy() if within else None)
            rows = [pd.DataFrame({"query_id": qid, "doc_id": ids, "score": scores})
                    for qid, ids, scores in best.rows(q["query_id"].to_numpy())]
        return pd.concat(rows) if rows else pd.DataFrame(columns=["query_id", "doc_id", "score"])

    schema = f"{_ddl(queries, 'query_id')}, {_ddl(chunks, 'doc_id')}, score double"
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(search, schema)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vector columns, for pairs that are already rows."""
    dot = lambda p, q: F.aggregate(
        F.zip_with(p, q, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
        lambda acc, x: acc + x)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)
