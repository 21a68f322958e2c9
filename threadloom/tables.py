"""The given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


TASK_ROWS = 50_000


def spread(scan: DataFrame, task_rows: int | None = None) -> DataFrame:
    """Put a scan with fewer splits than cores on all cores, for work that is heavy per row.

    A table of many files or row groups has splits enough and is left as it is. With ``task_rows`` there
    are so many parts that a task has no more rows than that, however large the table is. Takes a
    plain scan, projected to the columns needed.
    """
    parts = scan.sparkSession.sparkContext.defaultParallelism
    if task_rows:
        parts = max(parts, -(-scan.count() // task_rows))
    return scan.repartition(parts) if scan.rdd.getNumPartitions() < parts else scan
