"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom import fixed_values as fv
from threadloom.functions import dates, numbers, text
from threadloom.plans import duck, fixtures
from threadloom.plans.registry import query
from threadloom.tables import TASK_ROWS, spread, table


@query("str_clean_text", f"SELECT doc_id, {duck.clean_text('text')} AS cleaned FROM documents")
def str_clean_text(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", text.clean_text(F.col("text")).alias("cleaned"))


@query("str_filter_sentence", f"""
WITH l AS (SELECT conv_id, turn, lower({duck.strip('text')}) AS l FROM conversations),
d AS (SELECT conv_id, turn, {duck.drop_phrases('l')} AS d FROM l)
SELECT conv_id, turn, CASE WHEN len({duck.words('d')}) > 3 THEN {duck.strip('d')} ELSE '' END AS kept
FROM d""")
def str_filter_sentence(spark, sf):
    return spread(table(spark, sf, "conversations").select("conv_id", "turn", "text")).select(
        "conv_id", "turn", text.filter_sentence(F.col("text")).alias("kept"))


@query("str_clean_slack", f"""WITH {fixtures.SQL_CHAT}
SELECT event_id, {duck.clean_chat('message')} AS cleaned FROM chat""")
def str_clean_slack(spark, sf):
    return fixtures.chat(spark, sf).select(
        "event_id", text.clean_chat(F.col("message")).alias("cleaned"))


@query("str_filter_message", f"""WITH {fixtures.SQL_CHAT},
{duck.filter_message_ctes('chat', 'event_id', 'message')}
SELECT event_id, msg FROM filtered""")
def str_filter_message(spark, sf):
    return fixtures.chat(spark, sf).select(
        "event_id", text.filter_message(F.col("message")).alias("msg"))


@query("str_strip_html", f"SELECT page_id, {duck.strip_html('html')} AS plain FROM pages")
def str_strip_html(spark, sf):
    return spread(table(spark, sf, "pages").select("page_id", "html")).select(
        "page_id", text.strip_html(F.col("html")).alias("plain"))


@query("str_html_text", f"""
WITH t AS (SELECT page_id, {duck.html_text('html')} AS content FROM pages)
SELECT page_id, content FROM t WHERE length(content) > 50""")
def str_html_text(spark, sf):
    return (spread(table(spark, sf, "pages").select("page_id", "html"))
            .select("page_id", text.html_text(F.col("html")).alias("content"))
            .filter(F.length("content") > 50))


@query("str_first_url", f"""
WITH t AS (SELECT page_id, concat('see (', url, '), or www.x.example.org/', page_id, '!') AS t FROM pages
  UNION ALL SELECT -doc_id - 1, text FROM documents)
SELECT page_id, regexp_replace(coalesce(
    nullif(regexp_extract(t, {duck.lit('https?://' + duck.NOT_WS + '+')}), ''),
    nullif(regexp_extract(t, {duck.lit('www[.]' + duck.NOT_WS + '+')}), '')),
  '[.,;:!?)]+\\z', '') AS url FROM t""")
def str_first_url(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.concat(
        F.lit("see ("), "url", F.lit("), or www.x.example.org/"), "page_id", F.lit("!")).alias("t"))
    docs = table(spark, sf, "documents").select(
        (-F.col("doc_id") - 1).alias("page_id"), F.col("text").alias("t"))
    return pages.unionByName(docs).select("page_id", text.first_url(F.col("t")).alias("url"))


@query("str_truncate", """SELECT doc_id, CASE WHEN length(text) > 500
  THEN substring(text, 1, 497) || '...' ELSE text END AS cut FROM documents""")
def str_truncate(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", text.truncate(F.col("text")).alias("cut"))


@query("str_safe_path", r"""
WITH t AS (SELECT page_id AS id, url AS name FROM pages UNION ALL SELECT -doc_id - 1, text FROM documents),
u AS (SELECT id, regexp_replace(regexp_replace(name, '[<>:"/\\|?*\x00-\x1f]', '_', 'g'),
  '\A[ .]+|[ .]+\z', '', 'g') AS s FROM t)
SELECT id, CASE WHEN coalesce(s, '') = '' THEN 'unknown' ELSE substring(s, 1, 200) END AS path FROM u""")
def str_safe_path(spark, sf):
    names = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("name"))
    names = names.unionByName(table(spark, sf, "documents").select(
        (-F.col("doc_id") - 1).alias("id"), F.col("text").alias("name")))
    return names.select("id", text.safe_path(F.col("name")).alias("path"))


@query("str_video_id", """SELECT doc_id, 'v' || doc_id || 'x' || CASE lang WHEN 'de' THEN '-de' ELSE '' END AS video_id
FROM documents""")
def str_video_id(spark, sf):
    name = F.concat(F.lit("/data/v"), "doc_id", F.lit("x"),
                    F.when(F.col("lang") == "de", "-de.json").otherwise(
                        F.concat(F.lit("."), "lang", F.lit(".vtt"))))
    return table(spark, sf, "documents").select("doc_id", text.video_id(name).alias("video_id"))


@query("str_strip_quotes", "SELECT doc_id, replace('>> ' || text, '>>', '') AS body FROM documents")
def str_strip_quotes(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", text.strip_quotes(F.concat(F.lit(">> "), "text")).alias("body"))


@query("str_cache_key", """
SELECT doc_id, md5(translate(text || ':k=10:types=' || array_to_string(list_sort([lang, source]), ','),
  chr(10) || chr(13) || chr(9) || '?!` .,', '')) AS cache_key FROM documents""")
def str_cache_key(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.cache_key(
        F.col("text"), F.lit(10), F.array("lang", "source")).alias("cache_key"))


_NUMS = ("CASE event_type WHEN 'click' THEN concat(user_id, ',', lpad(CAST(event_id AS STRING), 3, '0')) "
         "WHEN 'view' THEN concat(' ', value, 'K') WHEN 'error' THEN concat(user_id, 'm') "
         "WHEN 'signup' THEN 'abc' ELSE CAST(event_id AS STRING) END")


@query("num_safe_int", """
SELECT event_id, CASE event_type
  WHEN 'click' THEN (user_id || CASE WHEN length(event_id::VARCHAR) < 3 THEN lpad(event_id::VARCHAR, 3, '0') ELSE substring(event_id::VARCHAR, 1, 3) END)::BIGINT
  WHEN 'view' THEN trunc(value * 1000)::BIGINT WHEN 'error' THEN user_id * 1000000
  WHEN 'signup' THEN 0 ELSE event_id END AS as_int,
  CASE event_type WHEN 'purchase' THEN event_id::DOUBLE ELSE 0.0::DOUBLE END AS as_float FROM events""")
def num_safe_int(spark, sf):
    raw = F.expr(_NUMS)
    return table(spark, sf, "events").select(
        "event_id", numbers.safe_int(raw).alias("as_int"), numbers.safe_float(raw).alias("as_float"))


@query("num_normalize_meta", """
SELECT event_id, CASE event_type WHEN 'click' THEN '' WHEN 'view' THEN '-' || user_id
    WHEN 'error' THEN event_id::VARCHAR ELSE event_type END AS str_value,
  CASE event_type WHEN 'view' THEN -user_id WHEN 'error' THEN event_id END AS int_value FROM events""")
def num_normalize_meta(spark, sf):
    raw = F.expr("CASE event_type WHEN 'click' THEN NULL WHEN 'view' THEN concat(' -', user_id) "
                 "WHEN 'error' THEN concat(event_id, ' ') ELSE event_type END")
    return table(spark, sf, "events").select(
        "event_id", numbers.meta_text(raw).alias("str_value"), numbers.meta_int(raw).alias("int_value"))


# Each event date is written in one of the formats, chosen by its number.
_FORMATS = [
    ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S", "s"),
    ("yyyy-MM-dd'T'HH:mm:ss'Z'", "%Y-%m-%dT%H:%M:%SZ", "s"),
    ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "%Y-%m-%dT%H:%M:%S.%f", "us"),
    ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "%Y-%m-%dT%H:%M:%S.%fZ", "us"),
    ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S", "s"),
    ("yyyy-MM-dd", "%Y-%m-%d", "d"),
    ("dd/MM/yyyy", "%d/%m/%Y", "d"),
    ("MM/dd/yyyy", "%m/%d/%Y", "us-order"),
    ("dd-MM-yyyy", "%d-%m-%Y", "d"),
    ("MM-dd-yyyy", "%m-%d-%Y", "us-order"),
    ("EEE, dd MMM yyyy HH:mm:ss +0200", "", "+2"),
    ("EEE, dd MMM yyyy HH:mm:ss", "", "s"),
    ("dd MMM yyyy", "%d %b %Y", "d"),
    ("MMM dd, yyyy", "%b %d, %Y", "d"),
    ("yyyy-MM-dd HH:mm:ss-0130", "", "-1.5"),
    ("yyyy-MM-dd'T'HH:mm:ss+02:00", "", "s"),
    ("'junk' yyyy", "", "none"),
]


def _written(ts):
    out = None
    for i, (fmt, _, _) in enumerate(_FORMATS):
        if "+0200" in fmt or "-0130" in fmt or "+02:00" in fmt:
            tail = fmt[-5:] if fmt[-6] != "+" else fmt[-6:]
            body = F.concat(F.date_format(ts, fmt[: -len(tail)]), F.lit(tail))
        else:
            body = F.date_format(ts, fmt)
        cond = F.col("event_id") % len(_FORMATS) == i
        out = F.when(cond, body) if out is None else out.when(cond, body)
    return out


_US_ORDER = ("epoch(CASE WHEN day(ts) <= 12 THEN make_timestamp(year(ts), day(ts), month(ts), 0, 0, 0) "
             "ELSE date_trunc('day', ts) END)")
_KIND = {"s": "epoch(date_trunc('second', ts))", "us": "epoch_us(ts) / 1e6",
         "d": "epoch(date_trunc('day', ts))", "us-order": _US_ORDER,
         "+2": # a T in the text (Tue, Thu) makes the zone count as an ISO zone, which is dropped
         "epoch(date_trunc('second', ts)) - CASE WHEN dayofweek(ts) IN (2, 4) THEN 0 ELSE 7200 END",
         "-1.5": "epoch(date_trunc('second', ts)) + 5400", "none": "0"}


@query("dt_parse_any", f"""
SELECT event_id, round((CASE event_id % {len(_FORMATS)} {' '.join(
    f'WHEN {i} THEN {_KIND[k]}' for i, (_, _, k) in enumerate(_FORMATS))} END)::DOUBLE, 6) AS epoch,
  strftime(make_timestamp((floor(CASE event_id % {len(_FORMATS)} {' '.join(
    f'WHEN {i} THEN {_KIND[k]}' for i, (_, _, k) in enumerate(_FORMATS))} END))::BIGINT * 1000000), '%Y-%m-%dT%H:%M:%S') AS iso
FROM events""")
def dt_parse_any(spark, sf):
    rows = spread(table(spark, sf, "events").select("event_id", "ts"), TASK_ROWS).select(
        "event_id", _written(F.col("ts").cast("timestamp")).alias("written"))
    return rows.select(
        "event_id", F.round(dates.epoch_from_date(F.col("written")), 6).alias("epoch"),
        F.substring(dates.date_to_iso(F.col("written")), 1, 19).alias("iso"))


@query("dt_pdf", """SELECT event_id, CASE event_type WHEN 'click' THEN 0.0::DOUBLE
  ELSE epoch(date_trunc('day', ts)) END AS epoch FROM events""")
def dt_pdf(spark, sf):
    ts = F.col("ts").cast("timestamp")
    raw = (F.when(F.col("event_type") == "click", F.concat(F.lit("D:2024"), F.lit("99991")))
           .otherwise(F.date_format(ts, "'D:'yyyyMMddHHmmss'+00''00'''")))
    return table(spark, sf, "events").select(
        "event_id", dates.epoch_from_pdf(raw).alias("epoch"))


@query("dt_filename", """SELECT event_id, CASE event_type WHEN 'click' THEN 0.0::DOUBLE
  ELSE epoch(date_trunc('day', ts)) END AS epoch FROM events""")
def dt_filename(spark, sf):
    ts = F.col("ts").cast("timestamp")
    name = (F.when(F.col("event_type") == "click", "posts/notes.2024-01-01")
            .when(F.col("event_type") == "view", F.date_format(ts, "'a/site.com_'yyyy_MM_dd'_02.json'"))
            .otherwise(F.date_format(ts, "yyyy-MM-dd'.json'")))
    return table(spark, sf, "events").select(
        "event_id", dates.epoch_from_filename(name).alias("epoch"))


@query("dt_published", """SELECT event_id, CASE event_type WHEN 'click' THEN 0.0::DOUBLE
  WHEN 'view' THEN epoch(date_trunc('day', ts)) WHEN 'error' THEN 0.0::DOUBLE
  ELSE epoch(date_trunc('second', ts)) END AS epoch FROM events""")
def dt_published(spark, sf):
    ts = F.col("ts").cast("timestamp")
    raw = (F.when(F.col("event_type") == "click", None)
           .when(F.col("event_type") == "view", F.date_format(ts, "'['yyyy', 'M', 'd', 7, 30]'"))
           .when(F.col("event_type") == "error", "[2024, 13, 45]")
           .otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    return table(spark, sf, "events").select(
        "event_id", dates.epoch_from_published(raw).alias("epoch"))


@query("dt_hms_to_seconds", """SELECT event_id, round(hour(ts) * 3600 + minute(ts) * 60 + second(ts)
  + CASE event_type WHEN 'click' THEN 0 ELSE ((epoch_us(ts) // 1000) % 1000) / 1000.0 END, 6)::DOUBLE AS seconds FROM events""")
def dt_hms_to_seconds(spark, sf):
    ts = F.col("ts").cast("timestamp")
    clock = F.when(F.col("event_type") == "click", F.date_format(ts, "HH:mm:ss")).otherwise(
        F.date_format(ts, "HH:mm:ss.SSS"))
    return table(spark, sf, "events").select(
        "event_id", F.round(dates.clock_to_seconds(clock), 6).alias("seconds"))


@query("dt_seconds_to_hms", """SELECT event_id,
  CASE WHEN s // 3600 < 10 THEN '0' ELSE '' END || (s // 3600) || ':' || lpad(((s % 3600) // 60)::VARCHAR, 2, '0')
    || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS clock
FROM (SELECT event_id, greatest(0, trunc(value * 1000 - 5000))::BIGINT AS s FROM events)""")
def dt_seconds_to_hms(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", dates.seconds_to_clock(F.col("value") * 1000 - 5000).alias("clock"))


@query("dt_iso_duration", """
WITH d AS (SELECT event_id, user_id // 60 AS h, user_id % 60 AS m, event_id % 60 AS s, event_type FROM events)
SELECT event_id, CASE event_type WHEN 'view' THEN 0 ELSE h * 3600 + m * 60 + s END::BIGINT AS seconds,
  CASE WHEN event_type = 'view' THEN '0s' WHEN h + m + s = 0 THEN '0s' ELSE
    trim(CASE WHEN h > 0 THEN h || 'h ' ELSE '' END || CASE WHEN m > 0 THEN m || 'm ' ELSE '' END
      || CASE WHEN s > 0 THEN s || 's' ELSE '' END) END AS readable FROM d""")
def dt_iso_duration(spark, sf):
    raw = F.expr(
        "CASE event_type WHEN 'view' THEN 'PT' ELSE concat('PT', "
        "CASE WHEN user_id >= 60 THEN concat(user_id DIV 60, 'H') ELSE '' END, "
        "CASE WHEN user_id % 60 > 0 THEN concat(user_id % 60, 'M') ELSE '' END, "
        "event_id % 60, 'S') END")
    # in steps, so that a text is built once and read once
    rows = spread(table(spark, sf, "events").select("event_id", "user_id", "event_type"), TASK_ROWS).select("event_id", raw.alias("raw"))
    rows = rows.select("event_id", dates.iso_duration_seconds(F.col("raw")).alias("seconds"))
    return rows.select("event_id", "seconds", dates.human_duration(F.col("seconds")).alias("readable"))


@query("score_recency_bonus", f"""
SELECT event_id, round(CASE event_type WHEN 'error' THEN 0 ELSE greatest(0.1, least(1.0,
  exp(-floor(({fixtures.AS_OF_EPOCH} - epoch(date_trunc('second', ts - to_days(event_id::INTEGER)))) / 86400.0) / {fv.RECENCY_DAYS}))) END, 6)::DOUBLE AS bonus
FROM events""")
def score_recency_bonus(spark, sf):
    ts = (F.col("ts") - F.make_dt_interval(F.col("event_id"))).cast("timestamp")
    raw = (F.when(F.col("event_type") == "error", F.date_format(ts, "dd/MM/yyyy"))
           .when(F.col("event_type") == "click", F.date_format(ts, "EEE, d MMM yyyy HH:mm:ss' +0900'"))
           .otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss")))
    return table(spark, sf, "events").select("event_id", F.round(
        dates.recency_bonus(raw, fixtures.AS_OF, fv.RECENCY_DAYS), 6).alias("bonus"))
