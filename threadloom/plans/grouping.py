"""Chat grouping and chunking over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import chunking, documents, grouping, segmentation
from threadloom.plans import duck, fixtures
from threadloom.plans.registry import query
from threadloom.plans.sources import SQL_CUES, transcripts, video_files
from threadloom.sources import parsers
from threadloom.tables import spread, table

SQL_FILTERED = f"""{fixtures.SQL_CHAT},
{duck.filter_message_ctes('chat', 'event_id', duck.strip("coalesce(message, '')"))},
rows AS (SELECT chat.*, msg, ts::DOUBLE AS t,
  coalesce(nullif(display_name, ''), nullif(user_name, ''), 'unknown') AS uname FROM chat JOIN filtered USING (event_id))"""


def chat_rows(spark, sf):
    return grouping.filtered(fixtures.chat(spark, sf))


@query("grp_user_name", f"WITH {fixtures.SQL_CHAT} SELECT event_id, coalesce(nullif(display_name, ''), nullif(user_name, ''), 'unknown') AS name FROM chat")
def grp_user_name(spark, sf):
    return fixtures.chat(spark, sf).select(
        "event_id", grouping.user_name(F.col("display_name"), F.col("user_name")).alias("name"))


SQL_THREADS = """th AS (SELECT thread_ts, arg_min(id, (t, id)) AS id, arg_min(uname, (t, id)) AS user_name, channel_id, arg_min(ts, (t, id)) AS ts,
  list(id ORDER BY t, id) FILTER (length(msg) >= 10) AS message_ids, string_agg(msg, ' ' ORDER BY t, id) FILTER (length(msg) >= 10) AS text
  FROM rows WHERE thread_ts IS NOT NULL GROUP BY channel_id, thread_ts)"""


@query("grp_thread_merge", f"""WITH {SQL_FILTERED}, {SQL_THREADS}
SELECT id, message_ids, text, user_name, channel_id, ts, thread_ts, 'T1' AS team_id FROM th WHERE text IS NOT NULL""")
def grp_thread_merge(spark, sf):
    return grouping.thread_groups(chat_rows(spark, sf))


SQL_USER_GROUPS = f"""{SQL_FILTERED},
k AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY t, id) AS rn FROM rows WHERE thread_ts IS NULL AND msg <> ''),
g AS (SELECT channel_id, rn, t AS start, rn AS anchor, uname FROM k WHERE rn = 1
  UNION ALL SELECT k.channel_id, k.rn, CASE WHEN k.uname = g.uname AND k.t - g.start > 0 AND k.t - g.start <= 3600 THEN g.start ELSE k.t END,
    CASE WHEN k.uname = g.uname AND k.t - g.start > 0 AND k.t - g.start <= 3600 THEN g.anchor ELSE k.rn END, k.uname
  FROM g JOIN k ON k.channel_id = g.channel_id AND k.rn = g.rn + 1),
ug AS (SELECT k.channel_id, anchor, min(k.t) AS start, max(k.t) AS last, arg_min(k.id, k.rn) AS id, arg_min(k.uname, k.rn) AS user_name,
  arg_max(k.ts, k.rn) AS ts, list(k.id ORDER BY k.rn) AS message_ids, string_agg(msg, ' ' ORDER BY k.rn) AS text
  FROM k JOIN g USING (channel_id, rn) GROUP BY k.channel_id, anchor)"""


@query("grp_user_anchor_merge", f"WITH RECURSIVE {SQL_USER_GROUPS} SELECT id, message_ids, text, user_name, channel_id, 'T1' AS team_id, ts FROM ug")
def grp_user_anchor_merge(spark, sf):
    return grouping.user_groups(chat_rows(spark, sf)).drop("start", "last")


SQL_MERGED_GROUPS = f"""{SQL_USER_GROUPS},
u AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY last, id) AS rn FROM ug),
h AS (SELECT channel_id, rn, start, rn AS anchor FROM u WHERE rn = 1
  UNION ALL SELECT u.channel_id, u.rn, CASE WHEN u.last - h.start > 0 AND u.last - h.start <= 3600 THEN h.start ELSE u.start END,
    CASE WHEN u.last - h.start > 0 AND u.last - h.start <= 3600 THEN h.anchor ELSE u.rn END
  FROM h JOIN u ON u.channel_id = h.channel_id AND u.rn = h.rn + 1),
mg AS (SELECT u.channel_id, h.anchor, arg_min(u.id, u.rn) AS id, arg_min(user_name, u.rn) AS user_name, arg_max(ts, u.rn) AS ts,
  flatten(list(message_ids ORDER BY u.rn)) AS message_ids, string_agg(text, ' ' ORDER BY u.rn) AS text
  FROM u JOIN h USING (channel_id, rn) GROUP BY u.channel_id, h.anchor)"""


@query("grp_consecutive_merge", f"WITH RECURSIVE {SQL_MERGED_GROUPS} SELECT id, message_ids, text, user_name, channel_id, ts, NULL::VARCHAR AS thread_ts, 'T1' AS team_id FROM mg")
def grp_consecutive_merge(spark, sf):
    return grouping.consecutive_groups(grouping.user_groups(chat_rows(spark, sf)))


@query("slack_documents", f"""WITH RECURSIVE {SQL_MERGED_GROUPS}, {SQL_THREADS},
a AS (SELECT ts, channel_id, user_name, thread_ts, message_ids, text FROM th WHERE text IS NOT NULL
  UNION ALL SELECT ts, channel_id, user_name, NULL, message_ids, text FROM mg)
SELECT ts AS doc_id, 'T1' AS team_id, 'slack' AS type, channel_id, user_name, ts AS timestamp, coalesce(thread_ts, '') AS thread_ts,
  len(message_ids)::BIGINT AS group_size, text FROM a WHERE length({duck.strip('text')}) >= 10""")
def slack_documents(spark, sf):
    return documents.chat_documents(grouping.chat_groups(fixtures.chat(spark, sf)))


@query("grp_gap_sessions", """
WITH e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t FROM events),
f AS (SELECT *, CASE WHEN t - lag(t) OVER w > 3600 OR lag(t) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT event_id, user_id, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id)::BIGINT AS session FROM f""")
def grp_gap_sessions(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", fixtures.epoch_ts().alias("t"))
    return grouping.gap_sessions(rows, ["user_id"], "t", "event_id", 3600.0).select("event_id", "user_id", "session")


# --- chunking --------------------------------------------------------------------------
@query("chunk_recursive")
def chunk_recursive(spark, sf):
    return chunking.recursive(spread(table(spark, sf, "documents").select("doc_id", "text")), "doc_id")


@query("chunk_fixed_stride", """
SELECT doc_id, i::INTEGER AS chunk_no, (i * 800)::INTEGER AS start_index, substring(text, i * 800 + 1, 1000) AS chunk
FROM (SELECT doc_id, text, unnest(range(greatest(ceil((length(text) - 200) / 800.0), 1)::BIGINT)) AS i FROM documents WHERE length(text) > 0)""")
def chunk_fixed_stride(spark, sf):
    return chunking.fixed_stride(table(spark, sf, "documents"), "doc_id")


def cues(spark, sf):
    return parsers.transcript_cues(transcripts(spark, sf))


@query("chunk_cues", f"""WITH RECURSIVE {SQL_CUES},
l AS (SELECT *, upto - length(text) AS lead FROM (SELECT *, sum(length(text)) OVER (PARTITION BY video_id ORDER BY pos) AS upto, max(pos) OVER (PARTITION BY video_id) AS final FROM cues)),
nx AS (SELECT a.video_id, a.pos, min(b.pos) AS nxt FROM l a JOIN l b ON a.video_id = b.video_id AND b.lead - a.lead > 700 GROUP BY ALL),
ov AS (SELECT a.video_id, a.pos, min(b.pos) AS over FROM l a JOIN l b ON a.video_id = b.video_id AND b.pos >= a.pos AND b.upto - a.lead > 900 GROUP BY ALL),
st AS (SELECT video_id, 0 AS k, pos AS s FROM l WHERE pos = 0
  UNION ALL SELECT st.video_id, k + 1, nxt FROM st JOIN nx ON nx.video_id = st.video_id AND nx.pos = st.s),
so AS (SELECT st.*, over, final FROM st JOIN (SELECT DISTINCT video_id, final FROM l) USING (video_id) LEFT JOIN ov ON ov.video_id = st.video_id AND ov.pos = st.s),
en AS (SELECT video_id, k, s, coalesce(over, final) AS e, over IS NULL AS done FROM so WHERE k = 0
  UNION ALL SELECT so.video_id, so.k, so.s, CASE WHEN over IS NULL OR greatest(over, e + 1) > final THEN final ELSE greatest(over, e + 1) END,
    over IS NULL OR greatest(over, e + 1) > final FROM en JOIN so ON so.video_id = en.video_id AND so.k = en.k + 1 WHERE NOT done)
SELECT en.video_id, k::INTEGER AS i, min(start_time) AS start_time, max(end_time) AS end_time, string_agg(text, ' ' ORDER BY pos) AS text
FROM en JOIN l ON l.video_id = en.video_id AND pos BETWEEN s AND e GROUP BY en.video_id, k""")
def chunk_cues(spark, sf):
    return chunking.cues(cues(spark, sf))


@query("chunk_sentences", f"""WITH RECURSIVE {SQL_CUES},
sp AS (SELECT video_id, pos, start_time, unnest(string_split(regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS part,
  generate_subscripts(string_split(regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), 1) AS k FROM cues),
p AS (SELECT video_id, start_time, part, length(part) AS l, row_number() OVER (PARTITION BY video_id ORDER BY pos, k) AS n FROM sp WHERE part <> ''),
b AS (SELECT video_id, n, 0 AS i, l AS len FROM p WHERE n = 1
  UNION ALL SELECT p.video_id, p.n, CASE WHEN b.len + 1 + p.l <= 500 THEN b.i ELSE b.i + 1 END, CASE WHEN b.len + 1 + p.l <= 500 THEN b.len + 1 + p.l ELSE p.l END
  FROM b JOIN p ON p.video_id = b.video_id AND p.n = b.n + 1),
s AS (SELECT video_id, i, sum(l + 1) - 1 AS len FROM b JOIN p USING (video_id, n) GROUP BY ALL),
t AS (SELECT video_id, max(i) AS final, arg_max(len, i) AS len FROM s GROUP BY ALL),
g AS (SELECT p.*, CASE WHEN b.i = final AND final > 0 AND t.len < 300 THEN b.i - 1 ELSE b.i END AS i FROM p JOIN b USING (video_id, n) JOIN t USING (video_id)),
f AS (SELECT video_id, arg_min(start_time, pos) AS first FROM cues GROUP BY ALL)
SELECT video_id, i::INTEGER AS i, CASE WHEN i = 0 THEN any_value(first) ELSE arg_min(start_time, n) END AS start_time, string_agg(part, ' ' ORDER BY n) AS text
FROM g JOIN f USING (video_id) GROUP BY video_id, i""")
def chunk_sentences(spark, sf):
    return segmentation.sentence_chunks(cues(spark, sf))


@query("chunk_semantic", r"""WITH RECURSIVE s AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_extract_all(text, '[.!?\n]*[^.!?\n]+[.!?\n]*|[.!?\n]+'),
  lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '')) AS t, generate_subscripts(list_filter(list_transform(
  regexp_extract_all(text, '[.!?\n]*[^.!?\n]+[.!?\n]*|[.!?\n]+'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> ''), 1) AS k FROM documents),
c AS (SELECT doc_id, k, j, substring(t, j * 1000 + 1, 1000) AS part FROM (SELECT *, unnest(range((length(t) - 1) // 1000 + 1)) AS j FROM s)),
p AS (SELECT *, length(part) AS l, list_distinct(regexp_extract_all(lower(part), '[a-z0-9]+')) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) AS n FROM c),
u AS (SELECT a.*, coalesce(len(list_intersect(a.w, b.w)) / sqrt(len(a.w)::DOUBLE * len(b.w)), 0) < 0.7 OR len(a.w) * len(b.w) = 0 AS unlike
  FROM p a LEFT JOIN p b ON b.doc_id = a.doc_id AND b.n = a.n - 1),
g AS (SELECT doc_id, n, 0 AS i, l AS len FROM u WHERE n = 1
  UNION ALL SELECT u.doc_id, u.n, CASE WHEN g.len + 1 + u.l > 1000 OR (u.unlike AND g.len >= 100) THEN g.i + 1 ELSE g.i END,
    CASE WHEN g.len + 1 + u.l > 1000 OR (u.unlike AND g.len >= 100) THEN u.l ELSE g.len + 1 + u.l END
  FROM g JOIN u ON u.doc_id = g.doc_id AND u.n = g.n + 1)
SELECT doc_id, i::INTEGER AS chunk_no, string_agg(part, ' ' ORDER BY n) AS chunk FROM g JOIN u USING (doc_id, n) GROUP BY doc_id, i""")
def chunk_semantic(spark, sf):
    return segmentation.semantic_chunks(spread(table(spark, sf, "documents").select("doc_id", "text")))


@query("chunk_windowed")
def chunk_windowed(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "text", chunking.window_size(F.col("text")).alias("size"))
    return chunking.recursive(docs, "doc_id", size="size", overlap=50)


@query("local_chunk_id", """
SELECT md5(doc_id::VARCHAR) || '-' || CASE WHEN i < 1000 THEN lpad(i::VARCHAR, 3, '0') ELSE i::VARCHAR END AS chunk_id, doc_id
FROM (SELECT doc_id, text, unnest(range(greatest(ceil((length(text) - 200) / 800.0), 1)::BIGINT)) AS i FROM documents WHERE length(text) > 0)
WHERE length(substring(text, i * 800 + 1, 1000)) >= 50""")
def local_chunk_id(spark, sf):
    from threadloom.functions.ids import local_chunk_id as chunk_id
    cut = chunking.fixed_stride(table(spark, sf, "documents"), "doc_id")
    return cut.filter(F.length("chunk") >= 50).select(
        chunk_id(F.col("doc_id").cast("string"), F.col("chunk_no")).alias("chunk_id"), "doc_id")


@query("video_segments", f"""WITH {SQL_CUES}
SELECT c.video_id || '_' || pos AS doc_id, 'youtube_video' AS type, c.video_id, 'https://www.youtube.com/watch?v=' || c.video_id || '&t=' || floor(start_time)::BIGINT AS url,
  source AS channel_title, 1704448800.0::DOUBLE AS published_at, n_chars AS duration_seconds, n_chars * 1000 AS view_count, doc_id AS like_count,
  CASE lang WHEN 'en' THEN 'C++17' ELSE '' END AS search_term, start_time, end_time,
  'Title: Talk ' || doc_id || chr(10) || chr(10) || 'Channel Title: ' || source || chr(10) || chr(10) || CASE lang WHEN 'en' THEN 'Search Term: C++17' || chr(10) || chr(10) ELSE '' END
    || CASE WHEN d.text <> '' THEN 'Description: ' || CASE WHEN length(d.text) > 500 THEN substring(d.text, 1, 497) || '...' ELSE d.text END || chr(10) || chr(10) ELSE '' END
    || chr(10) || 'Transcript:' || chr(10) || c.text AS text
FROM cues c JOIN documents d ON c.video_id = 'v' || d.doc_id""")
def video_segments(spark, sf):
    """Each cue as a segment, so that the result can be checked by SQL."""
    meta = parsers.video_metadata(video_files(spark, sf)).withColumn("video_id", F.concat(F.lit("v"), "video_id"))
    segments = cues(spark, sf).withColumnRenamed("pos", "i")
    return documents.video_segments(segments, meta)
