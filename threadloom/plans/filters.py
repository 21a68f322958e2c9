"""Filters and predicates over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom import fixed_values as fv
from threadloom.functions import dates, quality, text
from threadloom.functions.text import WORD_SET, WS_SET
from threadloom.plans import duck, fixtures
from threadloom.plans.registry import query
from threadloom.tables import spread, table

# Texts of all kinds: prose, raw pages, JSON, and a table rule per source.
SQL_SNIPPETS = """snippets AS (
  SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'p' || page_id, html FROM pages
  UNION ALL SELECT 'e' || event_id, props FROM events
  UNION ALL SELECT 'v' || event_id, event_type || '!!! ??? *** ((( ))) ###' FROM events
  UNION ALL SELECT 't' || n_nationkey, '| --- | ' || repeat('- ', n_nationkey) || '|' FROM nation)"""


def snippets(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text")).select(
        F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    pages = spread(table(spark, sf, "pages").select("page_id", "html")).select(
        F.concat(F.lit("p"), "page_id").alias("id"), F.col("html").alias("text"))
    props = table(spark, sf, "events").select(
        F.concat(F.lit("e"), "event_id").alias("id"), F.col("props").alias("text"))
    noise = table(spark, sf, "events").select(
        F.concat(F.lit("v"), "event_id").alias("id"),
        F.concat("event_type", F.lit("!!! ??? *** ((( ))) ###")).alias("text"))
    rules = table(spark, sf, "nation").select(
        F.concat(F.lit("t"), "n_nationkey").alias("id"),
        F.concat(F.lit("| --- | "), F.expr("repeat('- ', n_nationkey)"), F.lit("|")).alias("text"))
    return docs.unionByName(pages).unionByName(props).unionByName(noise).unionByName(rules)


_CELL = f"[{WS_SET}\\-:]"
D_RULE = f"regexp_matches(text, {duck.lit(f'\\A\\|{_CELL}+\\|{_CELL}*\\|?{_CELL}*\\|?[^\\n]*\\n?\\z')})"
D_FMT = (f"CASE WHEN length(text) > 0 THEN {duck.count('text', f'[|\\-{WS_SET}:]')}::DOUBLE / length(text) "
         "ELSE 0.0::DOUBLE END")
# words: maximal runs of word characters that are ASCII letters and digits throughout
D_WORDS = (f"len(list_filter(regexp_extract_all(text, {duck.lit(f'[{WORD_SET}]+')}), "
           "lambda w: regexp_full_match(w, '[a-zA-Z0-9]+')))")
D_PUNCT = (f"CASE WHEN {duck.count('text', f'[^{WS_SET}]')} > 0 THEN "
           f"{duck.count('text', f'[^{WORD_SET}{WS_SET}]')}::DOUBLE / {duck.count('text', f'[^{WS_SET}]')} "
           "ELSE 0.0::DOUBLE END")
D_VALID = (f"(length(text) >= 10 AND NOT {D_RULE} AND {D_FMT} <= 0.7 AND {D_WORDS} >= 3 "
           f"AND {D_PUNCT} <= 0.5)")


@query("flt_min_length", f"""SELECT conv_id, turn, length({duck.strip('text')}) >= 10 AS min10,
  length({duck.strip('text')}) >= 50 AS min50 FROM conversations WHERE length({duck.strip('text')}) >= 10""")
def flt_min_length(spark, sf):
    c = F.col("text")
    return table(spark, sf, "conversations").filter(quality.long_enough(c, 10)).select(
        "conv_id", "turn", quality.long_enough(c, 10).alias("min10"),
        quality.long_enough(c).alias("min50"))


@query("flt_valid_chunk", f"WITH {SQL_SNIPPETS} SELECT id, {D_VALID} AS valid FROM snippets")
def flt_valid_chunk(spark, sf):
    return snippets(spark, sf).select("id", quality.is_valid_chunk(F.col("text")).alias("valid"))


@query("flt_table_separator", f"WITH {SQL_SNIPPETS} SELECT id FROM snippets WHERE {D_RULE}")
def flt_table_separator(spark, sf):
    return snippets(spark, sf).filter(quality.is_table_rule(F.col("text"))).select("id")


@query("flt_formatting_ratio", f"WITH {SQL_SNIPPETS} SELECT id, round({D_FMT}, 6) AS ratio FROM snippets")
def flt_formatting_ratio(spark, sf):
    return snippets(spark, sf).select(
        "id", F.round(quality.formatting_ratio(F.col("text")), 6).alias("ratio"))


@query("flt_word_count", f"WITH {SQL_SNIPPETS} SELECT id, {D_WORDS}::BIGINT AS n FROM snippets")
def flt_word_count(spark, sf):
    return snippets(spark, sf).select(
        "id", quality.ascii_words(F.col("text")).cast("long").alias("n"))


@query("flt_punct_ratio", f"WITH {SQL_SNIPPETS} SELECT id, round({D_PUNCT}, 6) AS ratio FROM snippets")
def flt_punct_ratio(spark, sf):
    return snippets(spark, sf).select(
        "id", F.round(quality.punctuation_ratio(F.col("text")), 6).alias("ratio"))


@query("flt_time_range", f"""
WITH {fixtures.SQL_QUESTIONS},
q AS (SELECT query_id, CASE WHEN contains(lower(query_text), 'last week') THEN 7 WHEN contains(lower(query_text), 'last month') THEN 30
    WHEN contains(lower(query_text), 'last year') THEN 365
    WHEN {duck.contains_any('lower(query_text)', ['recent', 'latest', 'new', 'current'])} THEN 30 END AS days FROM questions)
SELECT query_id, ({fixtures.AS_OF_EPOCH} - days * 86400)::DOUBLE AS start_epoch FROM q WHERE days IS NOT NULL
UNION ALL SELECT -1000000 - event_id, epoch_us(ts) / 1e6 FROM events
WHERE epoch(ts) >= {fixtures.AS_OF_EPOCH - 30 * 86400} AND epoch(ts) < {fixtures.AS_OF_EPOCH - 7 * 86400}""")
def flt_time_range(spark, sf):
    asked = fixtures.questions(spark, sf).select("query_id", quality.relative_start(
        F.col("query_text"), float(fixtures.AS_OF_EPOCH)).alias("start_epoch"))
    spec = {"timestamp": {"$gte": fixtures.AS_OF_EPOCH - 30 * 86400,
                          "$lt": fixtures.AS_OF_EPOCH - 7 * 86400}}
    rows = (table(spark, sf, "events")
            .select((-F.col("event_id") - 1000000).alias("query_id"),
                    dates.epoch(F.col("ts")).alias("timestamp"))
            .filter(quality.metadata_filter(spec))
            .withColumnRenamed("timestamp", "start_epoch"))
    return asked.filter(F.col("start_epoch").isNotNull()).unionByName(rows)


@query("flt_metadata_dict", """SELECT doc_id, lang, source FROM documents
WHERE (lang = 'en' OR (lang IN ('de', 'fr') AND n_chars > 500)) AND source <> 'src2' AND n_chars <= 20000""")
def flt_metadata_dict(spark, sf):
    spec = {"$or": [{"lang": "en"}, {"$and": [{"lang": {"$in": ["de", "fr"]}}, {"n_chars": {"$gt": 500}}]}],
            "source": {"$ne": "src2"}, "n_chars": {"$lte": 20000}}
    return table(spark, sf, "documents").filter(quality.metadata_filter(spec)).select(
        "doc_id", "lang", "source")


@query("flt_types", """SELECT doc_id, kind FROM (SELECT doc_id, CASE lang WHEN 'en' THEN 'Mail' WHEN 'de' THEN 'slack'
  WHEN 'fr' THEN NULL ELSE 'blog' END AS kind FROM documents)
WHERE lower(coalesce(kind, 'documentation')) IN ('mail', 'documentation')""")
def flt_types(spark, sf):
    kind = F.expr("CASE lang WHEN 'en' THEN 'Mail' WHEN 'de' THEN 'slack' WHEN 'fr' THEN NULL ELSE 'blog' END")
    return table(spark, sf, "documents").select("doc_id", kind.alias("kind")).filter(
        quality.type_filter(F.col("kind"), ["mail", "Documentation"]))


@query("flt_video_duration", """SELECT event_id, s AS seconds, s <= 14400 AS in_video_mode
FROM (SELECT event_id, floor(value * 60)::BIGINT AS s FROM events) WHERE s >= 60""")
def flt_video_duration(spark, sf):
    s = F.floor(F.col("value") * 60).cast("long")
    iso = F.concat(F.lit("PT"), s.cast("string"), F.lit("S"))
    seconds = F.col("seconds")
    return (table(spark, sf, "events")
            .select("event_id", dates.iso_duration_seconds(iso).alias("seconds"))
            .filter(quality.keep_video(seconds))
            .select("event_id", "seconds", quality.keep_video(seconds, True).alias("in_video_mode")))


@query("flt_has_code", f"WITH {SQL_SNIPPETS} SELECT id FROM snippets WHERE {duck.contains_any('text', fv.CODE_MARKERS)}")
def flt_has_code(spark, sf):
    return snippets(spark, sf).filter(quality.has_code(F.col("text"))).select("id")


@query("flt_date_window", """SELECT event_id FROM events
WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-12 06:00:00'""")
def flt_date_window(spark, sf):
    return date_window(table(spark, sf, "events"), "ts", "2024-01-05 00:00:00",
                       "2024-01-12 06:00:00").select("event_id")


def date_window(df, column, start=None, end=None):
    """Optional lower and upper bound, as plain comparisons the scan can use."""
    if start is not None:
        df = df.filter(F.col(column) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.filter(F.col(column) <= F.lit(end).cast("timestamp_ntz"))
    return df
