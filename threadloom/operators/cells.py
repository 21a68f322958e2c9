"""Approximate dense search over inverted lists on disk.

``build`` learns cell centres on all chunks and writes every chunk to the folder of its nearest cell, in files
of bounded size (a crowded cell is written as several parts by several tasks). ``search`` sends each query to the
cells nearest to it; only the folders of those cells are read, as the cells a run probes prune the scan while it
runs, and inside a cell the exact kernel compares. An index is built once and serves many query sets.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.dense import dense_topk
from threadloom.operators.ranking import top_k
from threadloom.session import BROADCAST_LIMIT_BYTES, stored

PART_ROWS = 100_000
PROBED = 0.15  # share of the cells a query is sent to, unless given


def build(chunks: DataFrame, path: str, cells: int | None = None, part_rows: int = PART_ROWS, seed: int = 42) -> None:
    """Index ``chunks(doc_id, vec)`` below ``path``. Vectors must be of one length; null ones are left out.

    Unless given, there are four times the root of the number of chunks as cells, as far as their centres can be
    sent to all tasks.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    chunks = chunks.filter("vec IS NOT NULL").select("doc_id", "vec")
    total, size = chunks.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(1))).first()
    cells = max(1, min(cells or round(4 * total ** 0.5), total, BROADCAST_LIMIT_BYTES // (16 * max(1, size))))
    spark = chunks.sparkSession
    if total:
        # directions decide, not lengths
        norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        unit = F.transform("vec", lambda x: F.when(F.col("norm") > 0, x.cast("double") / F.col("norm")).otherwise(0.0))
        points = chunks.withColumn("norm", norm).select("doc_id", "vec", array_to_vector(unit).alias("features"))
        model = KMeans(k=cells, seed=seed, maxIter=10).fit(points)
        centres = [(k, [float(x) for x in c]) for k, c in enumerate(model.clusterCenters())]
        placed = model.transform(points).select("doc_id", "vec", F.col("prediction").alias("cell"))
    else:
        centres, placed = [], chunks.withColumn("cell", F.lit(0))
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"))
    sizes = sizes.withColumn("parts", F.ceil(F.col("rows") / part_rows).cast("int"))
    part = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    placed.limit(0).select("doc_id", "vec", "cell").write.parquet(f"{path}/types")  # the lists' columns, if there are no lists
    (placed.join(F.broadcast(sizes.select("cell", "parts")), "cell").withColumn("part", part)  # a row per cell
     .repartition("cell", "part").sortWithinPartitions("cell", "doc_id").select("doc_id", "vec", "cell")
     .write.option("maxRecordsPerFile", part_rows).partitionBy("cell").parquet(f"{path}/lists"))
    spark.createDataFrame(centres, "cell int, vec array<double>").join(sizes.select("cell", "rows", "parts"), "cell", "left").write.parquet(
        f"{path}/centres")


def probed(spark: SparkSession, path: str, queries: DataFrame, probes: int | None = None) -> DataFrame:
    """``query_id, query_vec, cell``: the cells nearest to each of ``queries(query_id, query_vec)``."""
    centres = spark.read.parquet(f"{path}/centres").filter("rows > 0")
    probes = probes or max(1, math.ceil(PROBED * centres.count()))
    near = dense_topk(queries, centres.select(F.col("cell").alias("doc_id"), "vec"), k=probes, threshold=None)
    # written: the scan of the lists can only be pruned by cells it can look up again
    return stored(queries.select("query_id", "query_vec").join(
        near.select("query_id", F.col("doc_id").alias("cell")), "query_id"), "cells-probed")


def probed_lists(spark: SparkSession, path: str, probing: DataFrame) -> DataFrame:
    """The chunks of the cells that any query probes. The cells, at most as many as there are, prune the scan."""
    cells = probing.select("cell").distinct().filter("cell >= 0")
    lists = spark.read.schema(spark.read.parquet(f"{path}/types").schema).parquet(f"{path}/lists")
    return lists.join(F.broadcast(cells), "cell", "left_semi")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 50, probes: int | None = None,
           threshold: float | None = 0.3) -> DataFrame:
    """``query_id, doc_id, score, rank``: the k nearest chunks found per query, scores as in the exact search."""
    probing = probed(spark, path, queries.filter("query_vec IS NOT NULL"), probes)
    # a query probes several cells; each probe is a query of its own inside its cell
    probe = F.struct("query_id", "cell")
    names = probing.select(F.to_json(probe).alias("query_id"), "query_vec", "cell")
    found = dense_topk(names, probed_lists(spark, path, probing), k=k, threshold=threshold, within="cell")
    kind = probing.schema["query_id"].dataType.simpleString()
    back = F.from_json("query_id", f"query_id {kind}")["query_id"]
    return top_k(found.drop("rank").withColumn("query_id", back), k)
