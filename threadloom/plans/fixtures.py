"""Stand-ins: how the given tables play mail, chat, video and log data.

Every stand-in is a projection of whole given tables. ``SQL_*`` hold the same
projections for the comparison engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.dates import epoch
from threadloom.tables import TASK_ROWS, spread, table

AS_OF = "2024-02-01 00:00:00"
AS_OF_EPOCH = 1706745600
BASE_EPOCH = 1704067200

# --- mail: one conversation is one thread -------------------------------------
LISTS = "CASE WHEN conv_id < 50 THEN 'dev@lists.example.org' ELSE 'users@lists.example.org' END"


def mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = F.timestamp_seconds(F.lit(BASE_EPOCH) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    root = F.concat(F.lit("M"), F.col("conv_id"), F.lit("T0"))
    msg = F.concat(F.lit("M"), F.col("conv_id"), F.lit("T"), F.col("turn"))
    parent = F.when(F.col("turn") > 0, F.concat(
        F.lit("M"), F.col("conv_id"), F.lit("T"), F.col("turn") - 1)).otherwise("")
    base = F.concat(F.lit("http://archive.example.org/list/"), F.col("list_name"))
    return (
        spread(table(spark, sf_dir, "conversations"))
        .withColumn("list_name", F.expr(LISTS))
        .select(
            "conv_id", "turn",
            msg.alias("msg_id"), parent.alias("parent_id"), root.alias("thread_id"),
            F.concat(F.lit("Topic "), "conv_id").alias("subject"),
            F.col("text").alias("content"), "list_name",
            F.date_format(sent, "yyyy-MM-dd'T'HH:mm:ss").alias("sent_at"),
            F.concat("role", F.lit("@example.org")).alias("sender_address"),
            F.concat(base, F.lit("/email/"), msg, F.lit("/")).alias("message_url"),
            F.concat(base, F.lit("/thread/"), root, F.lit("/")).alias("thread_url"),
        )
    )


SQL_MAIL = f"""mail AS (
  SELECT conv_id, turn, 'M' || conv_id || 'T' || turn AS msg_id,
    CASE WHEN turn > 0 THEN 'M' || conv_id || 'T' || (turn - 1) ELSE '' END AS parent_id,
    'M' || conv_id || 'T0' AS thread_id, 'Topic ' || conv_id AS subject, text AS content,
    {LISTS} AS list_name,
    strftime(make_timestamp(({BASE_EPOCH} + conv_id * 3600 + turn * 60) * 1000000), '%Y-%m-%dT%H:%M:%S') AS sent_at,
    role || '@example.org' AS sender_address,
    'http://archive.example.org/list/' || {LISTS} || '/email/M' || conv_id || 'T' || turn || '/' AS message_url,
    'http://archive.example.org/list/' || {LISTS} || '/thread/M' || conv_id || 'T0/' AS thread_url
  FROM conversations)"""


# --- chat: an event is a message, its type the channel ------------------------
_CHAT_TEXT = (
    "concat('Hi <@U', user_id, '> please look at the ', event_type, ' in <#C', user_id, '|', "
    "event_type, '>! It took ', value, ' ms :smile: in <https://ex.example.org/', event_id, "
    "'|the report>.  ok thanks. Then retry with ', props, '?')"
)
# every second or so message is small talk that cleaning removes
_CHAT_CASE = (
    "CASE WHEN value < 2 THEN 'ok thanks :+1:' WHEN value < 4 THEN '' ELSE " + _CHAT_TEXT + " END"
)
_CHAT_NAME = (
    "CASE WHEN value < 30 THEN 'ada' WHEN value < 60 THEN '' ELSE NULL END"
)
_CHAT_USER = "CASE WHEN value < 50 THEN 'bob' WHEN value < 200 THEN '' ELSE NULL END"


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages; those with more than 80 in ``value`` belong to an hourly thread."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    ts = F.concat(
        F.floor(micros / 1000000).cast("string"), F.lit("."),
        F.lpad((micros % 1000000).cast("string"), 6, "0"))
    thread = F.concat((F.floor(micros / 3600000000) * 3600).cast("string"), F.lit(".000000"))
    return spread(table(spark, sf_dir, "events"), TASK_ROWS).select(
        ts.alias("id"), ts.alias("ts"), F.expr(_CHAT_CASE).alias("message"),
        F.when(F.col("value") > 80, thread).alias("thread_ts"),
        F.concat(F.lit("C-"), "event_type").alias("channel_id"), F.lit("T1").alias("team_id"),
        F.expr(_CHAT_NAME).alias("display_name"), F.expr(_CHAT_USER).alias("user_name"),
        "event_id", "user_id", "value")


SQL_CHAT = f"""chat AS (
  SELECT id, id AS ts, message, CASE WHEN value > 80 THEN (floor(us / 3600000000) * 3600)::BIGINT || '.000000' END AS thread_ts,
    'C-' || event_type AS channel_id, 'T1' AS team_id, display_name, user_name, event_id, user_id, value
  FROM (SELECT (us // 1000000) || '.' || lpad((us % 1000000)::VARCHAR, 6, '0') AS id, us,
      {_CHAT_CASE} AS message, {_CHAT_NAME} AS display_name, {_CHAT_USER} AS user_name,
      event_type, event_id, user_id, value
    FROM (SELECT *, epoch_us(ts) AS us FROM events)))"""


# --- query log: an event is one query or one stage of it -----------------------
def epoch_ts(c: str = "ts") -> F.Column:
    return epoch(F.col(c))


# --- texts to retrieve with, and the corpus ------------------------------------
def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as it lies there, to take some documents from."""
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(texts(spark, sf_dir))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query text borrows the vector with its number."""
    vec = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"),
        F.col("label").alias("query_label"))
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id")).join(vec, "query_id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))


SQL_DENSE = """qv AS (SELECT item_id AS query_id, embedding AS qvec, label AS qlabel
  FROM benchmark JOIN embeddings ON vec_id = item_id),
dense_all AS (
  SELECT query_id, vec_id AS doc_id,
    round(list_cosine_similarity(qvec::DOUBLE[], embedding::DOUBLE[]), 6) AS score
  FROM qv, embeddings),
dense AS (
  SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
  FROM dense_all WHERE score >= 0.3 QUALIFY rank <= 50)"""


# --- questions: phrased from the events ----------------------------------------
_QUESTION = (
    "CASE event_type "
    "WHEN 'error' THEN concat('Why does async_read() fail with error ', user_id, ' in boost::asio::ip code?') "
    "WHEN 'click' THEN concat('how to use std::vector<Widget', user_id, '> with a thread and mutex') "
    "WHEN 'view' THEN concat('compare Boost.Beast vs Python requests, which to use for ', user_id, ' clients') "
    "WHEN 'signup' THEN concat('recent discussion on the mailing list thread ', user_id, '?') "
    "ELSE concat('performance ', user_id) END"
)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (spread(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id"))
            .select(F.col("event_id").alias("query_id"), F.expr(_QUESTION).alias("query_text"))
            .unionByName(table(spark, sf_dir, "benchmark").select(
                (-F.col("item_id") - 1).alias("query_id"), F.col("text").alias("query_text"))))


SQL_QUESTIONS = f"""questions AS (
  SELECT event_id AS query_id, {_QUESTION} AS query_text FROM events
  UNION ALL SELECT -item_id - 1, text FROM benchmark)"""
