"""Sinks, incremental changes and streams over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import quality, text
from threadloom.operators import chunking, documents, grouping, incremental, markdown, store
from threadloom.plans import duck, fixtures
from threadloom.plans.filters import D_FMT, D_PUNCT, D_RULE, D_WORDS, SQL_SNIPPETS, snippets
from threadloom.plans.grouping import cues, SQL_USER_GROUPS
from threadloom.plans.registry import query
from threadloom.plans.sources import blog_files, video_files
from threadloom.session import scratch_path
from threadloom.sources import parsers
from threadloom.streaming import streams
from threadloom.tables import table, TASK_ROWS

COLUMNS = "namespace string, id string, doc_id long, text string, version long"


def rows_of(docs, body, version):
    key = F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("_0")))
    return docs.select(F.col("lang").alias("namespace"), key.alias("id"), "doc_id", body.alias("text"),
                       F.lit(version).cast("long").alias("version"))


def filled_store(spark, sf):
    """A table that holds the labelled documents."""
    docs = table(spark, sf, "documents")
    known = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    chunks = store.ChunkStore(spark, scratch_path(spark, "chunks"), COLUMNS, buckets=4)
    chunks.create(rows_of(known, F.col("text"), 0))
    return chunks


def summary(chunks):
    return chunks.read().select("namespace", "id", "doc_id", F.md5("text").alias("hash"))


@query("snk_upsert_chunks", """
SELECT lang AS namespace, md5(doc_id || '_0') AS id, doc_id, md5(CASE WHEN quality = 1 THEN text || ' v2' ELSE text END) AS hash
FROM documents LEFT JOIN labels USING (doc_id)""")
def snk_upsert_chunks(spark, sf):
    """All documents into a table of the labelled ones; good ones come twice, changed."""
    chunks = filled_store(spark, sf)
    docs = table(spark, sf, "documents")
    good = docs.join(table(spark, sf, "labels").filter("quality = 1").select("doc_id"), "doc_id", "left_semi")
    batch = rows_of(docs, F.col("text"), 1).unionByName(rows_of(good, F.concat("text", F.lit(" v2")), 2))
    chunks.upsert(batch.withColumn("order", F.col("version")), "order")
    return summary(chunks)


@query("snk_delete_ids", """SELECT lang AS namespace, md5(doc_id || '_0') AS id, doc_id, md5(text) AS hash FROM documents
JOIN labels USING (doc_id) WHERE quality = 1""")
def snk_delete_ids(spark, sf):
    chunks = filled_store(spark, sf)
    bad = table(spark, sf, "documents").join(
        table(spark, sf, "labels").filter("quality = 0").select("doc_id"), "doc_id", "left_semi")
    chunks.delete_ids(rows_of(bad, F.col("text"), 0))
    return summary(chunks)


@query("snk_delete_namespace", """SELECT lang AS namespace, md5(doc_id || '_0') AS id, doc_id, md5(text) AS hash FROM documents
JOIN labels USING (doc_id) WHERE lang <> 'en'""")
def snk_delete_namespace(spark, sf):
    chunks = filled_store(spark, sf)
    chunks.delete_namespace("en")
    return summary(chunks)


@query("snk_update_docs", """
WITH f AS (SELECT lang, doc_id, text, quality, unnest(range(1 + quality)) AS i FROM documents JOIN labels USING (doc_id))
SELECT lang AS namespace, md5(doc_id || CASE WHEN quality = 1 THEN '_new' || i ELSE '_0' END) AS id, doc_id,
  md5(CASE WHEN quality = 1 THEN text || i ELSE text END) AS hash FROM f""")
def snk_update_docs(spark, sf):
    """Good documents are replaced by two chunks each."""
    chunks = filled_store(spark, sf)
    good = table(spark, sf, "documents").join(
        table(spark, sf, "labels").filter("quality = 1").select("doc_id"), "doc_id", "left_semi")
    two = good.withColumn("i", F.explode(F.array(F.lit(0), F.lit(1))))
    fresh = two.select(
        F.col("lang").alias("namespace"), F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("_new"), "i")).alias("id"),
        "doc_id", F.concat("text", F.col("i").cast("string")).alias("text"), F.lit(1).cast("long").alias("version"))
    chunks.replace_documents(fresh, "doc_id")
    return summary(chunks)


@query("snk_failed_docs", f"""WITH {SQL_SNIPPETS},
j AS (SELECT id AS doc_id, text, CASE WHEN length(text) < 10 THEN 'Text too short (length: ' || length(text) || ', minimum: 10)' WHEN {D_RULE} THEN 'Table separator'
  WHEN {D_FMT} > 0.7 THEN 'Mostly formatting' WHEN {D_WORDS} < 3 THEN 'Too few words' WHEN {D_PUNCT} > 0.5 THEN 'Mostly punctuation' END AS reason FROM snippets)
SELECT doc_id, 'unknown' AS type, reason, length(text) AS text_length FROM j WHERE reason IS NOT NULL""")
def snk_failed_docs(spark, sf):
    rows = snippets(spark, sf).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("type"), "text",
                                      F.create_map(F.lit("id"), F.col("id")).alias("metadata"))
    return store.failed_documents(rows, quality.reject_reason(F.col("text"))).drop("metadata")


SQL_SECTION = """'## Message ' || no || chr(10) || chr(10) || g || '**From:** ' || sender_address || chr(10) || g || '**Date:** ' || sent_at || chr(10)
  || g || '**TYPE_ID:** message/' || msg_id || chr(10) || CASE WHEN parent_id <> '' THEN g || '**In Reply To:** message/' || parent_id || chr(10) ELSE '' END
  || g || chr(10) || g || content || chr(10) || chr(10) || g || '---' || chr(10) || chr(10)"""


@query("snk_markdown_threads", f"""WITH {fixtures.SQL_MAIL},
s AS (SELECT *, '  ' || chr(10) AS g, row_number() OVER (PARTITION BY thread_id ORDER BY sent_at, msg_id) AS no FROM mail)
SELECT 'emails_' || translate(any_value(list_name), '@.-', '___') AS folder, 'thread_' || thread_id || '.md' AS file,
  '# LIST_NAME: ' || any_value(list_name) || chr(10) || any_value(g) || '# SUBJECT: ' || any_value(subject) || chr(10) || any_value(g) || '**TYPE_ID:** thread/' || thread_id || chr(10)
  || any_value(g) || '**DATE:** ' || min(sent_at) || chr(10) || any_value(g) || chr(10) || '---' || chr(10) || chr(10) || string_agg({SQL_SECTION}, '' ORDER BY no) AS content
FROM s GROUP BY thread_id""")
def snk_markdown_threads(spark, sf):
    mail = fixtures.mail(spark, sf)
    return markdown.thread_files(documents.thread_info(mail), markdown.thread_sections(mail))


@query("snk_append_threads", f"""WITH {fixtures.SQL_MAIL},
s AS (SELECT *, '  ' || chr(10) AS g, row_number() OVER (PARTITION BY thread_id ORDER BY turn < 2 DESC, sent_at, msg_id) AS no FROM mail)
SELECT thread_id, msg_id, no, {SQL_SECTION} AS section FROM s WHERE turn >= 2""")
def snk_append_threads(spark, sf):
    """Sections of messages not rendered yet, numbered after those that are."""
    mail = fixtures.mail(spark, sf)
    known = mail.filter(~F.col("msg_id").rlike("T([2-9]|[0-9]{2,})$")).select("thread_id", "msg_id")
    return markdown.thread_sections(mail, known)


@query("snk_markdown_blogs", f"""
WITH p AS (SELECT doc_id, source, lang, {duck.strip('text')} AS body, CASE lang WHEN 'en' THEN '2024-01-05' ELSE strftime(make_date(2023, 7, (n_chars % 28 + 1)::INTEGER), '%Y-%m-%d') END AS day FROM documents WHERE lang IN ('en', 'de'))
SELECT CASE source WHEN 'src1' THEN 'unknown' ELSE source END AS folder, day || '_Post ' || doc_id || '.md' AS file,
  '# Post ' || doc_id || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'author: ' || CASE source WHEN 'src1' THEN '' ELSE source END || '  ' || chr(10)
  || 'url: http://b.example.org/' || doc_id || CASE lang WHEN 'en' THEN '.html' ELSE '' END || '  ' || chr(10) || 'published: ' || day || 'T00:00:00Z  ' || chr(10) || 'type: blog-html'
  || chr(10) || chr(10) || '---' || chr(10) || chr(10) || body AS content FROM p WHERE length(body) >= 50""")
def snk_markdown_blogs(spark, sf):
    return markdown.blog_files(documents.blog_documents(parsers.blog_posts(blog_files(spark, sf))))


def named_videos(spark, sf):
    return parsers.video_metadata(video_files(spark, sf)).withColumn("video_id", F.concat(F.lit("v"), "video_id"))


@query("snk_markdown_videos")
def snk_markdown_videos(spark, sf):
    return markdown.video_files(named_videos(spark, sf), chunking.sentences(cues(spark, sf)))


@query("vid_topic", """
SELECT doc_id, CASE WHEN source = 'src3' THEN 'CppCon' WHEN lang = 'en' THEN 'C++17' WHEN lang = 'de' THEN 'Boost discussion' WHEN lang = 'fr' THEN 'C++ lambda'
  WHEN contains(text, 'boost') OR contains(text, 'Boost') THEN 'Boost discussion' END AS folder FROM documents""")
def vid_topic(spark, sf):
    channel = F.when(F.col("source") == "src3", "CppCon").otherwise(F.col("source"))
    term = F.when(F.col("lang") == "en", "C++17").otherwise("")
    tags = F.when(F.col("lang") == "fr", F.array(F.lit("x"), F.lit("C++ lambda"), F.lit("C++11"))).otherwise(
        F.array().cast("array<string>"))
    content = F.when(F.col("lang") == "de", F.concat("text", F.lit(" C++ tree in Boost"))).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", markdown.topic_folder(channel, term, tags, content).alias("folder"))


@query("snk_query_log", "SELECT event_id AS query_id, value AS total_time_ms, event_type <> 'error' AS success FROM events")
def snk_query_log(spark, sf):
    """Append the log as JSON lines and read it back."""
    path = scratch_path(spark, "log")
    rows = table(spark, sf, "events").select(
        F.col("event_id").alias("query_id"), F.col("value").alias("total_time_ms"), (F.col("event_type") != "error").alias("success"))
    rows.write.mode("append").json(path)
    return spark.read.schema(rows.schema).json(path)


# --- incremental -------------------------------------------------------------------------
def mail_batch(spark, sf):
    return fixtures.mail(spark, sf).select("message_url", "content", "thread_id", "msg_id", "sent_at")


@query("inc_mail_upsert", f"""WITH {fixtures.SQL_MAIL},
s AS (SELECT message_url AS url, content, CASE WHEN length({duck.squeeze('content')}) <= 20 THEN 'failed' WHEN msg_id = thread_id THEN 'updated' ELSE 'added' END AS status FROM mail)
SELECT url, md5(content || CASE WHEN status = 'failed' THEN '' ELSE ' new' END) AS hash, status FROM s
WHERE status <> 'failed' OR url LIKE '%T0/'""")
def inc_mail_upsert(spark, sf):
    """The first message of each thread is stored; all messages come in, changed."""
    mail = mail_batch(spark, sf)
    stored_rows = mail.filter("msg_id = thread_id").select(F.col("message_url").alias("url"), F.col("content").alias("text"))
    batch = mail.select(F.col("message_url").alias("url"), F.concat("content", F.lit(" new")).alias("text"),
                        (F.length(text.squeeze(F.col("content"))) > 20).alias("valid"))
    judged = incremental.mail_status(batch, stored_rows, "url", F.col("valid"))
    good = judged.filter("status <> 'failed'").select("url", "text", "status")
    kept = stored_rows.withColumn("status", F.lit("failed"))
    return store.upserted(kept, good, ["url"]).select("url", F.md5("text").alias("hash"), "status")


@query("inc_partial_update", """
SELECT doc_id, CASE WHEN quality = 1 THEN upper(lang) ELSE lang END AS lang, CASE WHEN toxic = 1 THEN 'moved' ELSE source END AS source, n_chars
FROM documents LEFT JOIN labels USING (doc_id)""")
def inc_partial_update(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    patch = table(spark, sf, "labels").join(docs.select("doc_id", F.upper("lang").alias("up")), "doc_id").select(
        "doc_id", F.when(F.col("quality") == 1, F.col("up")).alias("lang"),
        F.when(F.col("toxic") == 1, "moved").alias("source"))
    return incremental.patched(docs, patch, "doc_id", ["lang", "source"])


@query("inc_delete_by_url", """SELECT doc_id, (i * 800)::INTEGER AS start_index FROM (SELECT doc_id, unnest(range(greatest(ceil((length(text) - 200) / 800.0), 1)::BIGINT)) AS i
  FROM documents WHERE length(text) > 0) WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def inc_delete_by_url(spark, sf):
    chunks = chunking.fixed_stride(table(spark, sf, "documents"), "doc_id").select("doc_id", "start_index")
    return store.without(chunks, table(spark, sf, "labels").filter("toxic = 1"), ["doc_id"])


@query("inc_hash_upsert", """
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'keep' WHEN l.doc_id IS NULL THEN 'insert'
  WHEN quality = 1 THEN 'touch' ELSE 'replace' END AS action
FROM documents d FULL JOIN (SELECT * FROM labels UNION ALL SELECT -item_id - 1, 1, 0 FROM benchmark) l ON d.doc_id = l.doc_id""")
def inc_hash_upsert(spark, sf):
    docs = table(spark, sf, "documents")
    known = table(spark, sf, "labels").join(docs.select("doc_id", "text"), "doc_id").select(
        "doc_id", F.sha2(F.when(F.col("quality") == 1, F.col("text")).otherwise(F.concat("text", F.lit("!"))), 256).alias("hash"))
    lost = table(spark, sf, "benchmark").select((-F.col("item_id") - 1).alias("doc_id"), F.sha2("text", 256).alias("hash"))
    return incremental.hash_actions(known.unionByName(lost), docs.select("doc_id", F.sha2("text", 256).alias("hash")), ["doc_id"])


@query("inc_skip_existing", "SELECT doc_id, md5(doc_id || '_0') AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def inc_skip_existing(spark, sf):
    key = lambda df: df.select("doc_id", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("_0"))).alias("id"))
    return store.without(key(table(spark, sf, "documents")), key(table(spark, sf, "labels")), ["id"])


@query("inc_metadata_only", """
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'new' WHEN toxic = 1 THEN 'reembed' WHEN quality = 0 THEN 'metadata' ELSE 'same' END AS action
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def inc_metadata_only(spark, sf):
    docs = table(spark, sf, "documents")
    now = docs.select("doc_id", "text", F.struct("lang", "source").alias("meta"))
    before = docs.join(table(spark, sf, "labels"), "doc_id").select(
        "doc_id", F.when(F.col("toxic") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"),
        F.struct("lang", F.when(F.col("quality") == 0, "old").otherwise(F.col("source")).alias("source")).alias("meta"))
    return incremental.metadata_actions(before, now, "doc_id")


@query("inc_ttl_expire", f"SELECT event_id FROM events WHERE epoch_us(ts) / 1e6 > {fixtures.AS_OF_EPOCH} - 14 * 86400")
def inc_ttl_expire(spark, sf):
    rows = table(spark, sf, "events").select("event_id", fixtures.epoch_ts().alias("t"))
    return incremental.unexpired(rows, "t", float(fixtures.AS_OF_EPOCH), 14 * 86400.0).select("event_id")


@query("inc_size_cap", """SELECT doc_id, source, n_chars FROM documents
QUALIFY sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id DESC) <= 40000""")
def inc_size_cap(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    age = -F.col("doc_id")
    return incremental.newest_within(rows, ["source"], "n_chars", age, F.floor(age / 10_000), 40_000)


@query("inc_resume_terms", "SELECT DISTINCT p_name AS term FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_type = 'SMALL' AND p_size > 45)")
def inc_resume_terms(spark, sf):
    part = table(spark, sf, "part")
    done = part.filter("p_type = 'SMALL' AND p_size > 45").select(F.col("p_name").alias("term"))
    return store.without(part.select(F.col("p_name").alias("term")).distinct(), done, ["term"])


# --- streams ---------------------------------------------------------------------------------
def event_files(spark, sf, *extra):
    """The events as a folder of files, one group of files per day."""
    path = scratch_path(spark, "events")
    rows = table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), "event_id", "user_id", "event_type", "value", *extra)
    rows.repartition(8, F.to_date("ts")).write.parquet(path)
    return path, rows.schema


def heartbeat(spark, path, schema):
    """One late row that moves the watermark past all data; its own window stays open."""
    row = spark.range(1).select(*[
        F.lit("2030-01-01 00:00:00").cast("timestamp").alias("ts") if f.name == "ts"
        else F.lit("heartbeat").alias(f.name) if f.name == "event_type"
        else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
    row.write.mode("append").parquet(path)


def as_log(rows):
    return rows.select("ts", F.col("value").alias("total_time_ms"), (F.col("event_type") != "error").alias("success"),
                       F.col("event_type").isin("click", "view").alias("cache_hit"))


@query("stm_file_watch", "SELECT event_id, event_type, value FROM events")
def stm_file_watch(spark, sf):
    path, schema = event_files(spark, sf)
    out = streams.run_to_table(streams.watch_files(spark, path, schema, max_files=4), "watched")
    return spark.read.parquet(out).select("event_id", "event_type", "value")


@query("stm_mail_sync", """SELECT event_type || '-' || user_id AS id, max(event_id) AS last_event FROM events GROUP BY 1""")
def stm_mail_sync(spark, sf):
    """Repeated messages are dropped, the rest is upserted by id batch by batch."""
    path, schema = event_files(spark, sf)
    stream = streams.new_messages(streams.watch_files(spark, path, schema), "event_id", "ts", "1 hour")
    chunks = store.ChunkStore(spark, scratch_path(spark, "synced"), "namespace string, id string, event_id long", buckets=4)
    chunks.create(spark.createDataFrame([], "namespace string, id string, event_id long"))

    def save(batch, _):
        rows = batch.select(F.col("event_type").alias("namespace"), F.concat("event_type", F.lit("-"), "user_id").alias("id"), "event_id")
        chunks.upsert(rows.withColumn("order", F.col("event_id")), "order")

    streams.run_batches(stream, "sync", save)
    return chunks.read().select("id", F.col("event_id").alias("last_event"))


@query("stm_telemetry_5m", """
WITH e AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS s, value, event_type FROM events)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS queries, round(avg(value), 6) AS mean_ms, max(value) AS max_ms,
  round(avg(CASE WHEN event_type IN ('click', 'view') THEN 1.0 ELSE 0 END), 6)::DOUBLE AS hit_rate,
  round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END), 6)::DOUBLE AS error_rate,
  avg(value) > 5000 AS high_latency, avg(CASE WHEN event_type IN ('click', 'view') THEN 1.0 ELSE 0 END) < 0.3 AS low_hit_rate,
  avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END) > 0.1 AS high_error_rate FROM e GROUP BY s""")
def stm_telemetry_5m(spark, sf):
    path, schema = event_files(spark, sf)
    heartbeat(spark, path, schema)
    out = streams.run_to_table(streams.telemetry_windows(as_log(streams.watch_files(spark, path, schema))), "telemetry")
    return spark.read.parquet(out).select(
        F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "queries", F.round("mean_ms", 6).alias("mean_ms"),
        "max_ms", F.round("hit_rate", 6).alias("hit_rate"), F.round("error_rate", 6).alias("error_rate"),
        "high_latency", "low_hit_rate", "high_error_rate")


@query("stm_sessions_30m", """
WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS events FROM s GROUP BY user_id, n""")
def stm_sessions_30m(spark, sf):
    path, schema = event_files(spark, sf)
    heartbeat(spark, path, schema)
    out = streams.run_to_table(streams.conversation_sessions(streams.watch_files(spark, path, schema), "user_id"), "sessions")
    clock = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return spark.read.parquet(out).select("user_id", clock("start"), clock("end"), "events")


@query("stm_sliding_rate", """
WITH e AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) - to_minutes((5 * unnest([0, 1, 2]))::INTEGER) AS s, event_type FROM events)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS queries, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END), 6)::DOUBLE AS error_rate,
  avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END) > 0.1 AS high_error_rate FROM e GROUP BY s""")
def stm_sliding_rate(spark, sf):
    path, schema = event_files(spark, sf)
    heartbeat(spark, path, schema)
    out = streams.run_to_table(streams.sliding_error_rate(as_log(streams.watch_files(spark, path, schema))), "rate")
    return spark.read.parquet(out).select(
        F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "queries",
        F.round("error_rate", 6).alias("error_rate"), "high_error_rate")


@query("stm_anchor_groups", f"""WITH RECURSIVE {SQL_USER_GROUPS}
SELECT channel_id, id::VARCHAR AS id, user_name, ts::VARCHAR AS ts, len(message_ids) AS message_count, text FROM ug""")
def stm_anchor_groups(spark, sf):
    path = scratch_path(spark, "chat")
    # The ranges are found on raw messages, so that texts are cleaned once, by many tasks.
    raw = fixtures.chat(spark, sf).filter("thread_ts IS NULL")
    parts = max(8, -(-raw.count() // TASK_ROWS))
    rows = grouping.filtered(raw.repartitionByRange(parts, F.col("ts").cast("double"))).select(
        "channel_id", F.timestamp_micros(F.round(F.col("t") * 1e6).cast("long")).alias("event_time"), "t", "id", "ts", "user", "msg")
    rows.write.parquet(path)
    beat = rows.select("channel_id").distinct().select(
        "channel_id", F.lit("2030-01-01 00:00:00").cast("timestamp").alias("event_time"), F.lit(1893456000.0).alias("t"),
        F.lit("beat").alias("id"), F.lit("beat").alias("ts"), F.lit("beat").alias("user"), F.lit("beat").alias("msg"))
    beat.write.mode("append").parquet(path)
    out = streams.run_to_table(streams.anchor_groups(streams.watch_files(spark, path, rows.schema)), "groups")
    return spark.read.schema(streams.GROUP_SCHEMA).parquet(out)


