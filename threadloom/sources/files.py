"""File readers. Each gives one row per file: ``path``, ``value``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, root: str, *suffixes: str) -> DataFrame:
    """Whole text of every file below ``root`` with one of the suffixes."""
    names = ",".join(s.lstrip(".") for s in suffixes)
    return (
        spark.read.text(root, wholetext=True, recursiveFileLookup=True,
                        pathGlobFilter=f"*.{{{names}}}")
        .select(F.col("_metadata.file_path").alias("path"), "value")
    )


def relative_path(path: Column, root: str) -> Column:
    """Path below ``root``; the scheme in front does not matter."""
    plain = root.split(":", 1)[-1].rstrip("/") + "/"
    return F.element_at(F.split(path, "\\Q" + plain + "\\E", 2), -1)


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``path, length`` of the files below a folder. Contents are never read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True)
            .option("pathGlobFilter", pattern).load(root).select("path", "length"))


def file_stats(files: DataFrame) -> DataFrame:
    """Files and bytes per lower-cased suffix of a listing ``path, length``."""
    name = F.regexp_extract("path", r"[^/]*\z", 0)
    suffix = F.lower(F.regexp_extract(name, r"[^/](\.[^.]+)\z", 1))
    return (
        files.select(suffix.alias("extension"), "length")
        .groupBy("extension")
        .agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
    )


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all columns text, plus ``row_order`` for "last row wins"."""
    return (
        spark.read.option("header", True).option("multiLine", False).option("escape", '"').csv(path)
        .withColumn("row_order", F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row")))
    )
