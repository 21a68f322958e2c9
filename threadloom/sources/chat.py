"""Chat messages with their channel, team and user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.joins import small_left_join


def read_jdbc_table(spark: SparkSession, url: str, name: str, *, split_on: str | None = None,
                    bounds: tuple[str, str] | None = None, parts: int = 64,
                    **options: str) -> DataFrame:
    """A database table, read in ``parts`` ranges of ``split_on`` where one is given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
    for key, value in options.items():
        reader = reader.option(key, value)
    if split_on and bounds:
        reader = (reader.option("partitionColumn", split_on).option("numPartitions", parts)
                  .option("lowerBound", bounds[0]).option("upperBound", bounds[1]))
    return reader.load()


def chat_messages(message: DataFrame, channel: DataFrame, team: DataFrame, user: DataFrame,
                  start: object = None, end: object = None) -> DataFrame:
    """Messages left-joined to their dimensions, inside an optional time range."""
    if start is not None:
        message = message.filter(F.col("ts") >= F.lit(start))
    if end is not None:
        message = message.filter(F.col("ts") <= F.lit(end))
    channels = channel.select(F.col("id").alias("_channel"), "channel_id",
                              F.col("team_id").alias("_team_ref"))
    teams = team.select(F.col("id").alias("_team"), "team_id")
    users = user.select(F.col("email_id").alias("_user"), "display_name",
                        F.col("username").alias("user_name"))
    facts = message.select(F.col("ts").alias("id"), "ts", "message", "thread_ts",
                           F.col("channel_id").alias("_channel"), F.col("user_id").alias("_user"))
    out = small_left_join(facts, channels, "_channel")
    out = small_left_join(out.withColumnRenamed("_team_ref", "_team"), teams, "_team")
    out = small_left_join(out, users, "_user")
    return out.select("id", "ts", "message", "thread_ts", "channel_id", "team_id",
                      "display_name", "user_name")
