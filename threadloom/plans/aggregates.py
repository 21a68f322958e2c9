"""Summaries over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import aggregates as agg
from threadloom.operators import ordering
from threadloom.plans import fixtures
from threadloom.plans.registry import query
from threadloom.tables import table


def rounded(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


def query_log(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_id").alias("query_id"), F.col("value").alias("total_time_ms"),
        (F.col("event_type") != "error").alias("success"), "ts",
        F.create_map(
            F.lit("dense"), F.struct((F.col("value") * 2).alias("elapsed_ms")),
            F.col("event_type"), F.struct(F.col("value").alias("elapsed_ms"))).alias("stages"))


@query("agg_thread_groups", f"""WITH {fixtures.SQL_MAIL}
SELECT thread_id, list(msg_id ORDER BY sent_at, msg_id) AS messages, count(*) AS n FROM mail GROUP BY thread_id""")
def agg_thread_groups(spark, sf):
    return fixtures.mail(spark, sf).groupBy("thread_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("sent_at", "msg_id"))), lambda x: x["msg_id"]).alias("messages"),
        F.count(F.lit(1)).alias("n"))


@query("agg_query_telemetry", """SELECT count(*) AS total_queries, round(avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0 END), 6)::DOUBLE AS success_rate,
  round(avg(value), 6) AS mean_ms, round(quantile_cont(value, 0.5), 6) AS median_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms,
  round(quantile_cont(value, 0.99), 6) AS p99_ms, max(value) AS max_ms, min(value) AS min_ms FROM events""")
def agg_query_telemetry(spark, sf):
    return rounded(agg.query_telemetry(query_log(spark, sf)), "success_rate", "mean_ms", "median_ms", "p95_ms", "p99_ms")


@query("agg_stage_telemetry", """
WITH s AS (SELECT event_type AS stage, value AS v FROM events UNION ALL SELECT 'dense', value * 2 FROM events)
SELECT stage, round(avg(v), 6) AS mean_ms, round(quantile_cont(v, 0.5), 6) AS median_ms, round(quantile_cont(v, 0.95), 6) AS p95_ms,
  count(*) AS count FROM s GROUP BY stage""")
def agg_stage_telemetry(spark, sf):
    return rounded(agg.stage_telemetry(query_log(spark, sf)), "mean_ms", "median_ms", "p95_ms")


@query("agg_cache_stats", """
WITH e AS (SELECT count(*) FILTER (event_type IN ('click', 'view')) AS hits, count(*) FILTER (event_type = 'error') AS misses,
    count(*) FILTER (event_type = 'signup') AS evictions FROM events),
f AS (SELECT count(*) AS file_count, sum(n_chars)::BIGINT AS total_bytes FROM documents)
SELECT hits, misses, evictions, round(hits::DOUBLE / (hits + misses), 6) AS hit_rate, file_count, total_bytes,
  round(total_bytes / 1048576.0 / 64, 6)::DOUBLE AS utilization FROM e, f""")
def agg_cache_stats(spark, sf):
    log = table(spark, sf, "events").select(F.expr(
        "CASE WHEN event_type IN ('click', 'view') THEN 'hit' WHEN event_type = 'error' THEN 'miss' "
        "WHEN event_type = 'signup' THEN 'eviction' ELSE 'write' END").alias("kind"))
    files = table(spark, sf, "documents").select(F.col("n_chars").alias("size_bytes"))
    return rounded(agg.cache_stats(log, files, 64.0), "hit_rate", "utilization")


def dense_index(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.concat(F.lit("ns"), "label").alias("namespace"), F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))


def sparse_index(spark, sf):
    """The vectors whose document has been judged."""
    docs = table(spark, sf, "labels").select("doc_id")
    return dense_index(spark, sf).join(docs, "doc_id").withColumn("vec", F.array().cast("array<float>"))


@query("agg_index_stats", """SELECT 'ns' || label AS namespace, count(*) AS vectors, max(len(embedding))::BIGINT AS dimension, 'dense' AS "index"
FROM embeddings GROUP BY label
UNION ALL SELECT 'ns' || label, count(*), 0, 'sparse' FROM embeddings JOIN labels ON doc_id = vec_id GROUP BY label""")
def agg_index_stats(spark, sf):
    return agg.index_stats(dense_index(spark, sf), "dense").unionByName(
        agg.index_stats(sparse_index(spark, sf), "sparse"))


@query("agg_index_delta", """
WITH d AS (SELECT 'ns' || label AS namespace, count(*) AS n FROM embeddings GROUP BY label),
s AS (SELECT 'ns' || label AS namespace, count(*) AS n FROM embeddings JOIN labels ON doc_id = vec_id GROUP BY label)
SELECT namespace, coalesce(d.n, 0) AS dense, coalesce(s.n, 0) AS sparse, coalesce(d.n, 0) - coalesce(s.n, 0) AS delta
FROM d FULL JOIN s USING (namespace) WHERE coalesce(d.n, 0) <> coalesce(s.n, 0)""")
def agg_index_delta(spark, sf):
    return agg.index_delta(dense_index(spark, sf), sparse_index(spark, sf))


@query("agg_method_counts", "SELECT coalesce(source, 'unknown') AS method, count(*) AS results FROM documents GROUP BY 1")
def agg_method_counts(spark, sf):
    return table(spark, sf, "documents").groupBy(
        F.coalesce("source", F.lit("unknown")).alias("method")).agg(F.count(F.lit(1)).alias("results"))


@query("agg_channel_summary", f"""WITH {fixtures.SQL_CHAT}
SELECT channel_id, count(*) AS message_count, max(ts) AS last_activity FROM chat GROUP BY channel_id ORDER BY last_activity DESC, channel_id""")
def agg_channel_summary(spark, sf):
    return agg.channel_summary(fixtures.chat(spark, sf))


@query("agg_ingest_stats", """
SELECT count(*) FILTER (s = 'added') AS added_count, count(*) FILTER (s = 'updated') AS updated_count,
  count(*) FILTER (s = 'failed') AS failed_count, count(*) AS total_processed
FROM (SELECT CASE WHEN d.text IS NULL OR length(d.text) <= 20 THEN 'failed' WHEN l.doc_id IS NULL THEN 'added' ELSE 'updated' END AS s
  FROM documents d LEFT JOIN labels l USING (doc_id))""")
def agg_ingest_stats(spark, sf):
    from threadloom.operators.joins import flag_existing
    rows = flag_existing(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels"), "doc_id")
    return agg.status_counts(rows.select(
        F.when(F.coalesce(F.length("text"), F.lit(0)) <= 20, "failed").when(F.col("exists"), "updated")
        .otherwise("added").alias("status")))


@query("agg_review_votes", """
SELECT p_brand AS library, count(*) FILTER (l_returnflag = 'A') AS accept, count(*) FILTER (l_returnflag = 'N') AS conditional,
  count(*) FILTER (l_returnflag = 'R') AS reject, count(*) FILTER (l_returnflag IN ('A', 'N', 'R')) AS total
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand ORDER BY total DESC, library LIMIT 5""")
def agg_review_votes(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("library"))
    vote = F.expr("CASE l_returnflag WHEN 'A' THEN 'accept' WHEN 'N' THEN 'conditional' WHEN 'R' THEN 'reject' END")
    # Votes are counted per part before the join, so hot parts travel as one row each.
    votes = table(spark, sf, "lineitem").groupBy("l_partkey", vote.alias("vote")).agg(F.count(F.lit(1)).alias("n"))
    joined = votes.join(part, "l_partkey")
    kinds = ["accept", "conditional", "reject"]
    per = [F.coalesce(F.sum(F.when(F.col("vote") == k, F.col("n"))), F.lit(0)).alias(k) for k in kinds]
    return (joined.groupBy("library").agg(*per)
            .withColumn("total", F.col("accept") + F.col("conditional") + F.col("reject"))
            .orderBy(F.desc("total"), "library").limit(5))


@query("agg_cost_rollup", """
WITH c AS (SELECT l_returnflag AS category, l_linestatus AS item, CAST(round(l_extendedprice * 100) AS BIGINT) AS cost FROM lineitem),
r AS (SELECT category, item, grouping(category, item)::BIGINT AS level, sum(cost)::BIGINT AS cost FROM c GROUP BY ROLLUP (category, item))
SELECT category, item, level, cost, round(cost::DOUBLE / (SELECT sum(cost) FROM c), 6) AS share FROM r""")
def agg_cost_rollup(spark, sf):
    costs = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("category"), F.col("l_linestatus").alias("item"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cost"))
    return rounded(agg.cost_rollup(costs, ["category", "item"]), "share")


def topics(spark, sf):
    """Conversations as topics of two methods; the second knows only the longer ones."""
    base = table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.count(F.when(F.col("role") == "user", 1)).alias("u"), F.count(F.when(F.col("role") != "user", 1)).alias("a"))
    one = lambda method, cond: base.filter(cond).select(
        F.lit(method).alias("method"), F.concat(F.lit("Topic "), "conv_id").alias("subject"),
        F.expr("array_repeat('x', cast(u as int))").alias("assertions"),
        F.expr("array_repeat('x', cast(a as int))").alias("timeline"))
    return one("thread", F.col("u") + F.col("a") >= 2).unionByName(one("cluster", F.col("u") + F.col("a") <= 6))


@query("agg_summary_stats", """
WITH b AS (SELECT conv_id, count(*) FILTER (role = 'user') AS u, count(*) FILTER (role <> 'user') AS a FROM conversations GROUP BY conv_id),
t AS (SELECT 'thread' AS method, conv_id, u, a FROM b WHERE u + a >= 2 UNION ALL SELECT 'cluster', conv_id, u, a FROM b WHERE u + a <= 6),
s AS (SELECT conv_id, string_agg(DISTINCT method, '+' ORDER BY method) AS methods FROM t GROUP BY conv_id)
SELECT method AS name, count(*) AS topics, round(avg(u), 6) AS avg_assertions, round(avg(a), 6) AS avg_timeline FROM t GROUP BY method
UNION ALL SELECT 'shared by ' || methods, count(*), NULL, NULL FROM s GROUP BY methods""")
def agg_summary_stats(spark, sf):
    rows = topics(spark, sf)
    depth = rounded(agg.summary_depth(rows), "avg_assertions", "avg_timeline").withColumnRenamed("method", "name")
    shared = agg.subject_overlap(rows).select(
        F.concat(F.lit("shared by "), "methods").alias("name"), F.col("subjects").alias("topics"))
    return depth.unionByName(shared, allowMissingColumns=True)


@query("win_cumulative_length", """SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS length_to
FROM conversations""")
def win_cumulative_length(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("len"))
    return ordering.running_sum(rows, ["conv_id"], [F.col("turn")], F.floor(F.col("turn") / 4096),
                                F.col("len"), "length_to").drop("len")
