"""The chunk table: upserts and deletes on plain Parquet.

Rows live in ``namespace`` and hash ``bucket`` partitions. A change reads and rewrites
only the partitions it touches, through a staged copy. Every rewritten partition keeps
one marker row without an id, so that a partition that becomes empty is replaced too.
Rows are rebalanced by folder at run time: a large folder is written by several tasks
into several files, small ones share a task.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.session import stored

PLACE = ["namespace", "bucket"]


def _is(column: str, value: object) -> Column:
    """Equality that holds for nulls, and that prunes partitions."""
    return F.col(column).isNull() if value is None else F.col(column) == value


def last_per_id(incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the one with the highest ``order``; aggregated before the shuffle."""
    rest = [c for c in incoming.columns if c not in keys]
    return (incoming.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
            .select(*keys, "_r.*").select(*incoming.columns))


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Semi or anti join by keys in which null equals null."""
    right = right.select(*[F.col(k).alias(f"_{k}") for k in keys])
    match = [left[k].eqNullSafe(right[f"_{k}"]) for k in keys]
    return left.join(right, reduce(and_, match), how)


def upserted(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows without the incoming keys, and all incoming rows."""
    kept = null_safe(existing, incoming.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(incoming)


def without(existing: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return null_safe(existing, gone.select(*keys).distinct(), keys, "left_anti")


def split_valid(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Rows to keep, and rejected rows with their ``reason``."""
    judged = rows.withColumn("reason", reason)
    return (judged.filter("reason IS NULL").drop("reason"), judged.filter("reason IS NOT NULL"))


def failed_documents(rows: DataFrame, reason: Column) -> DataFrame:
    """Dead-letter rows ``doc_id, type, reason, text_length, metadata``."""
    _, bad = split_valid(rows, reason)
    return bad.select(
        "doc_id", F.coalesce("type", F.lit("unknown")).alias("type"), "reason",
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("text_length"), "metadata")


class ChunkStore:
    """A table of rows ``namespace, id, …`` below ``path``."""

    def __init__(self, spark: SparkSession, path: str, columns: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.schema = spark.createDataFrame([], columns).schema
        self.names = self.schema.names

    def _placed(self, rows: DataFrame) -> DataFrame:
        bucket = F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")
        return rows.select(*self.names).withColumn("bucket", bucket)

    def _scan(self) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])
        return self.spark.read.schema(schema).parquet(self.path)

    def create(self, rows: DataFrame) -> None:
        (self._placed(rows).hint("rebalance", *PLACE).write.mode("errorifexists")
         .partitionBy(*PLACE).parquet(self.path))

    def read(self) -> DataFrame:
        return self._scan().filter("id IS NOT NULL").select(*self.names)

    def _replace(self, touched: DataFrame, change: DataFrame) -> None:
        """Overwrite the touched partitions with ``change`` and their markers."""
        markers = touched.select(*PLACE, *[
            F.lit(None).cast(self.schema[n].dataType).alias(n) for n in self.names if n != "namespace"])
        columns = [*self.names, "bucket"]
        staged = stored(change.select(*columns).unionByName(markers.select(*columns)), "stage")
        (staged.hint("rebalance", *PLACE).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(*PLACE).parquet(self.path))

    def _in(self, touched: DataFrame) -> DataFrame:
        """Rows of the touched folders; no other folder is read. The folders, of which a change touches at most as
        many as there are, become a plain condition on the partition columns."""
        buckets: dict[str | None, list[int]] = {}
        for place in touched.collect():
            buckets.setdefault(place.namespace, []).append(place.bucket)
        inside = [_is("namespace", name) & (F.col("bucket").isin([b for b in some if b is not None])
                                            | (F.col("bucket").isNull() if None in some else F.lit(False)))
                  for name, some in buckets.items()]
        return self._scan().filter(reduce(or_, inside, F.lit(False))).filter("id IS NOT NULL")

    def upsert(self, incoming: DataFrame, order: str) -> None:
        """Insert or replace by id; inside the batch the last row by ``order`` wins."""
        new = last_per_id(incoming.select(*self.names, order), ["namespace", "id"], order)
        new = stored(self._placed(new), "incoming")
        touched = new.select(*PLACE).distinct()
        self._replace(touched, upserted(self._in(touched), new, ["namespace", "id"]))

    def delete_ids(self, gone: DataFrame) -> None:
        """Delete rows ``namespace, id``."""
        bucket = F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")
        placed = gone.select("namespace", "id").withColumn("bucket", bucket)
        touched = placed.select(*PLACE).distinct()
        self._replace(touched, without(self._in(touched), placed, ["namespace", "id"]))

    def delete_namespace(self, namespace: str) -> None:
        """Empty a namespace. Its rows are not read."""
        touched = self._scan().filter(F.col("namespace") == namespace).select(*PLACE).distinct()
        touched = stored(touched, "gone")
        self._replace(touched, self._scan().filter(F.lit(False)))

    def replace_documents(self, incoming: DataFrame, document: str) -> None:
        """Replace all rows of the incoming documents, however many chunks each had."""
        new = stored(self._placed(incoming), "incoming")
        changed = new.select("namespace", document).distinct()
        names = [r.namespace for r in changed.select("namespace").distinct().collect()]  # only their folders are read
        there = self._scan().filter(reduce(or_, [_is("namespace", n) for n in names], F.lit(False))).filter("id IS NOT NULL")
        old = null_safe(there, changed, ["namespace", document], "left_semi").select(*PLACE)
        touched = stored(old.unionByName(new.select(*PLACE)).distinct(), "touched")
        kept = without(self._in(touched), changed, ["namespace", document])
        self._replace(touched, kept.select(*self.names, "bucket").unionByName(new.select(*self.names, "bucket")))
