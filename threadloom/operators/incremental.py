"""What changes between two states of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.joins import flag_existing
from threadloom.operators.ordering import running_sum


def mail_status(incoming: DataFrame, existing: DataFrame, key: str, valid: Column) -> DataFrame:
    """Incoming messages with ``status``: failed, updated or added."""
    flagged = flag_existing(incoming, existing, key)
    return flagged.withColumn("status", F.when(~valid, "failed").when(F.col("exists"), "updated")
                              .otherwise("added")).drop("exists")


def patched(existing: DataFrame, patch: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Existing rows with the given fields of the patch; null leaves a field as it is."""
    new = patch.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    joined = existing.join(new, key, "left")
    return joined.select(*[
        F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in existing.columns])


def hash_actions(stored_rows: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """What to do per key: insert, touch (same hash), replace (changed) or keep (absent)."""
    old = stored_rows.select(*keys, F.col("hash").alias("old_hash"))
    new = incoming.select(*keys, F.col("hash").alias("new_hash"))
    action = (
        F.when(F.col("new_hash").isNull(), "keep").when(F.col("old_hash").isNull(), "insert")
        .when(F.col("old_hash") == F.col("new_hash"), "touch").otherwise("replace"))
    return old.join(new, keys, "full_outer").select(*keys, action.alias("action"))


def metadata_actions(stored_rows: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """``new``, ``reembed`` (text changed), ``metadata`` (only metadata changed) or ``same``.

    Both carry ``text`` and a map or struct ``meta``.
    """
    prints = lambda df, p: df.select(
        key, F.md5("text").alias(f"{p}_text"), F.md5(F.to_json("meta")).alias(f"{p}_meta"))
    action = (
        F.when(F.col("old_text").isNull(), "new").when(F.col("old_text") != F.col("new_text"), "reembed")
        .when(F.col("old_meta") != F.col("new_meta"), "metadata").otherwise("same"))
    return prints(incoming, "new").join(prints(stored_rows, "old"), key, "left").select(key, action.alias("action"))


def unexpired(rows: DataFrame, ts: str, as_of: float, ttl: float) -> DataFrame:
    """Rows younger than the time to live (times in seconds)."""
    return rows.filter(F.col(ts) > as_of - ttl)


def newest_within(rows: DataFrame, keys: list[str], size: str, age: Column, bucket: Column,
                  cap: int) -> DataFrame:
    """The newest rows per key whose sizes add up to at most ``cap``.

    ``age`` grows with age and is unique per key; ``bucket`` follows it.
    """
    summed = running_sum(rows, keys, [age], bucket, F.col(size), "_total")
    return summed.filter(F.col("_total") <= cap).drop("_total")
