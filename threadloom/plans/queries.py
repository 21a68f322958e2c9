"""Analysis of query texts, and topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom import fixed_values as fv
from threadloom.operators import bm25, topics
from threadloom.operators import query_analysis as qa
from threadloom.plans import duck, fixtures
from threadloom.plans.registry import query
from threadloom.plans.retrieval import SQL_BM25, SQL_VARIANTS, sparse_hits

Q = fixtures.SQL_QUESTIONS
_HITS = ", ".join(
    "{'i': " + duck.lit(name) + ", 'n': " + " + ".join(
        f"regexp_matches(l, {duck.lit(p)})::INT" for p in patterns) + f", 'of': {len(patterns)}" + "}"
    for name, patterns in fv.INTENT_PATTERNS)
SQL_INTENT = f"""ih AS (SELECT query_id, [{_HITS}] AS h FROM (SELECT query_id, lower(query_text) AS l FROM questions)),
im AS (SELECT query_id, h, list_max(list_transform(h, lambda x: x.n)) AS m FROM ih),
intents AS (SELECT query_id, CASE WHEN m = 0 THEN 'unknown' ELSE list_filter(h, lambda x: x.n = m)[1].i END AS intent,
  CASE WHEN m = 0 THEN 0.5::DOUBLE ELSE m::DOUBLE / list_filter(h, lambda x: x.n = m)[1].of END AS confidence FROM im)"""


@query("qry_intent", f"WITH {Q}, {SQL_INTENT} SELECT query_id, intent, round(confidence, 6) AS confidence FROM intents")
def qry_intent(spark, sf):
    return (fixtures.questions(spark, sf).select("query_id", qa.intent(F.col("query_text")).alias("i"))
            .select("query_id", "i.intent", F.round("i.confidence", 6).alias("confidence")))


def _found(names):
    return f"list_filter([{', '.join(duck.lit(n) for n in names)}], lambda n: contains(lower(query_text), n))"


@query("qry_entities", f"""WITH {Q}
SELECT query_id, list_sort(list_distinct(regexp_extract_all(query_text, '\\b(?:boost|std)::[a-zA-Z_][a-zA-Z0-9_:]*'))) AS namespaces,
  list_sort(list_distinct(regexp_extract_all(query_text, '\\b([a-zA-Z_][a-zA-Z0-9_]*)\\s*\\(', 1))) AS functions,
  list_sort(list_distinct(list_filter(regexp_extract_all(query_text, '[{duck.WORD_SET}]+'), lambda w: regexp_full_match(w, '[A-Z][a-zA-Z0-9_]*')))) AS classes,
  {_found(fv.LIBRARY_NAMES)} AS libraries, {_found(fv.KEYWORD_NAMES)} AS keywords FROM questions""")
def qry_entities(spark, sf):
    return qa.entities(fixtures.questions(spark, sf))


@query("qry_route", f"""WITH {Q}, {SQL_INTENT},
r AS (SELECT * FROM {duck.values([(n, s, b, g, k, t, src) for n, s, b, g, k, t, src, _, _ in fv.ROUTES], 'r', 'intent', 'semantic', 'bm25', 'graph', 'top_k', 'threshold', 'sources')})
SELECT query_id, intent, round(confidence, 6) AS confidence, semantic, bm25, graph, top_k::INTEGER AS top_k, threshold, sources,
  intent = 'comparison' AS diversity FROM intents JOIN r USING (intent)""")
def qry_route(spark, sf):
    return qa.route(fixtures.questions(spark, sf)).select(
        "query_id", "intent", F.round("confidence", 6).alias("confidence"), "semantic", "bm25", "graph",
        "top_k", "threshold", "sources", "diversity")


_CODE = duck.contains_any("query_text", fv.QUERY_CODE_MARKERS)
_TECH = duck.contains_any("lower(query_text)", fv.TECHNICAL_TERMS)
_N = f"len({duck.words('query_text')})"
_ISQ = f"ends_with({duck.strip('query_text')}, '?')"


@query("qry_features", f"""WITH {Q}
SELECT query_id, {_N} AS length, {_CODE} AS has_code, {_TECH} AS has_technical_terms, {_ISQ} AS is_question,
  CASE WHEN {_N} <= 3 AND NOT {_CODE} THEN 'simple' WHEN {_N} > 15 OR ({_CODE} AND {_TECH}) THEN 'complex' ELSE 'medium' END AS complexity,
  list_filter([CASE WHEN contains(lower(query_text), 'c++') OR contains(lower(query_text), 'cpp') THEN 'cpp' END,
    CASE WHEN contains(lower(query_text), 'python') THEN 'python' END, CASE WHEN contains(lower(query_text), 'boost') THEN 'boost' END], lambda x: x IS NOT NULL) AS language_hints,
  CASE WHEN {_N} <= 3 THEN 'simple' WHEN {_N} <= 10 THEN 'medium' ELSE 'complex' END AS word_complexity,
  CASE WHEN {_N} <= 3 THEN 'aggressive_expansion' WHEN {duck.contains_any('lower(query_text)', fv.QUERY_CODE_WORDS)} THEN 'technical_expansion'
    WHEN {_ISQ} THEN 'paraphrase_expansion' ELSE 'standard_expansion' END AS strategy FROM questions""")
def qry_features(spark, sf):
    return qa.features(fixtures.questions(spark, sf))


@query("qry_variations", f"WITH {SQL_VARIANTS.replace('SELECT item_id AS query_id, text AS query_text FROM benchmark', 'SELECT * FROM questions').replace('vq AS', Q + ', vq AS', 1)} SELECT query_id, variant, query_text FROM variants")
def qry_variations(spark, sf):
    return qa.variations(fixtures.questions(spark, sf))


@query("qry_synonyms", f"""WITH {Q},
s AS (SELECT word, list_transform(alts, lambda a: a) AS alts FROM {duck.values(fv.SYNONYMS, 's', 'word', 'alts')}),
w AS (SELECT query_id, query_text, unnest({duck.words('lower(query_text)')}) AS word, unnest(range(1, 1 + len({duck.words('lower(query_text)')}))) AS wi FROM questions),
e AS (SELECT query_id, replace(query_text, w.word, unnest(alts)) AS q, wi, unnest(range(len(alts))) AS si FROM w JOIN s USING (word)),
a AS (SELECT query_id, query_text AS q, 0 AS wi, 0 AS si FROM questions UNION ALL SELECT * FROM e),
d AS (SELECT query_id, q, min(wi * 1000 + si) AS ord FROM a GROUP BY ALL)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY ord) - 1)::INTEGER AS variant, q AS query_text FROM d
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY ord) <= 5""")
def qry_synonyms(spark, sf):
    return qa.synonyms(fixtures.questions(spark, sf))


@query("qry_prf", f"""WITH {SQL_BM25},
en AS (SELECT query_id FROM sparse WHERE rank <= 3 GROUP BY query_id HAVING count(*) >= 3),
tk AS (SELECT query_id, unnest(regexp_extract_all(lower(text), '[{duck.WORD_SET}]{{2,}}')) AS term
  FROM sparse JOIN en USING (query_id) JOIN documents USING (doc_id) WHERE rank <= 3),
tc AS (SELECT query_id, term, count(*) AS c FROM tk WHERE term NOT IN ({', '.join(duck.lit(w) for w in fv.STOP_WORDS)}) GROUP BY ALL),
t5 AS (SELECT * FROM tc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY c DESC, term) <= 5),
ad AS (SELECT query_id, string_agg(term, ' ' ORDER BY term) AS added FROM t5 GROUP BY query_id)
SELECT item_id AS query_id, text || coalesce(' ' || added, '') AS query_text FROM benchmark LEFT JOIN ad ON query_id = item_id""")
def qry_prf(spark, sf):
    return qa.feedback(fixtures.query_texts(spark, sf), sparse_hits(spark, sf, 3), fixtures.corpus(spark, sf))


# What a user may ask for, put together from an order's words.
_ASK = ("concat(CASE o_orderpriority WHEN '1-URGENT' THEN 'give me a few recent emails' WHEN '2-HIGH' THEN 'top 42 slack chats from last month' "
        "WHEN '3-MEDIUM' THEN 'a comprehensive list of WG21 proposals of last year' WHEN '5-LOW' THEN 'Documentation of the latest version' "
        "ELSE 'first 99999 results' END, ' ', o_orderkey)")


@query("qry_params", f"""
SELECT o_orderkey AS query_id, CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 42 WHEN '3-MEDIUM' THEN 20 ELSE 10 END::BIGINT AS top_k,
  CASE o_orderpriority WHEN '2-HIGH' THEN 'slack' WHEN '3-MEDIUM' THEN 'wg21' WHEN '5-LOW' THEN 'cpp-documentation' ELSE 'mailing' END AS namespace,
  ({fixtures.AS_OF_EPOCH} - 86400 * CASE o_orderpriority WHEN '1-URGENT' THEN 30 WHEN '2-HIGH' THEN 30 WHEN '3-MEDIUM' THEN 365 WHEN '5-LOW' THEN 30 END)::DOUBLE AS start_epoch
FROM orders""")
def qry_params(spark, sf):
    from threadloom.tables import table
    asked = table(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"), F.expr(_ASK).alias("query_text"))
    return qa.parameters(asked, float(fixtures.AS_OF_EPOCH))


WEEK = ("2023-12-29T00:00:00", "2024-01-05T00:00:00")
SQL_TOP = f"""{fixtures.SQL_MAIL},
top AS (SELECT thread_id, count(*) AS messages FROM mail WHERE sent_at >= '{WEEK[0]}' AND sent_at < '{WEEK[1]}' GROUP BY thread_id ORDER BY messages DESC, thread_id LIMIT 5)"""


@query("top_threads", f"WITH {SQL_TOP} SELECT * FROM top")
def top_threads(spark, sf):
    return topics.recent_threads(fixtures.mail(spark, sf), *WEEK)


@query("top_clusters")
def top_clusters(spark, sf):
    return topics.clusters(fixtures.vectors(spark, sf))


SQL_TIMELINE = SQL_TOP + """,
toks AS (SELECT msg_id AS doc_id, regexp_extract_all(lower(content), '[a-z0-9]+') AS t FROM mail),
stat AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS mean FROM toks),
qt AS (SELECT topic, term, count(*) AS qtf FROM (SELECT thread_id AS topic, unnest(regexp_extract_all(lower(content), '[a-z0-9]+')) AS term
  FROM mail JOIN top USING (thread_id) WHERE msg_id = thread_id) GROUP BY ALL),
post AS (SELECT doc_id, l, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS l, unnest(t) AS term FROM toks) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
sc AS (SELECT topic, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))), 6) AS score
  FROM post JOIN qt USING (term) JOIN dfs USING (term), stat GROUP BY topic, doc_id),
got AS (SELECT topic, doc_id AS msg_id FROM sc QUALIFY row_number() OVER (PARTITION BY topic ORDER BY score DESC, doc_id) <= 30),
line AS (SELECT topic, msg_id, sent_at, message_url AS url FROM (
  SELECT topic, msg_id FROM got UNION SELECT thread_id, msg_id FROM mail JOIN top USING (thread_id)) JOIN mail USING (msg_id))"""


def timeline_rows(spark, sf):
    mail = fixtures.mail(spark, sf)
    top = topics.recent_threads(mail, *WEEK)
    recent = mail.join(top, "thread_id", "left_semi").select(
        F.col("thread_id").alias("topic"), "msg_id", "sent_at", F.col("message_url").alias("url"))
    asked = mail.filter("msg_id = thread_id").join(top, "thread_id", "left_semi").select(
        F.col("thread_id").alias("query_id"), F.col("content").alias("query_text"))
    hits = bm25.bm25_corpus(asked, mail.select(F.col("msg_id").alias("doc_id"), F.col("content").alias("text")), 30)
    retrieved = hits.select(F.col("query_id").alias("topic"), F.col("doc_id").alias("msg_id")).join(
        mail.select("msg_id", "sent_at", F.col("message_url").alias("url")), "msg_id")
    return topics.timeline(recent, retrieved)


@query("top_timeline", f"WITH {SQL_TIMELINE} SELECT topic, substring(sent_at, 1, 10) AS date, count(*) AS messages, list_sort(list(DISTINCT url)) AS references FROM line GROUP BY ALL".replace("AS references", 'AS "references"'))
def top_timeline(spark, sf):
    return topics.timeline_by_day(timeline_rows(spark, sf))


@query("sort_timeline", f"WITH {SQL_TIMELINE} SELECT topic, msg_id, sent_at, row_number() OVER (PARTITION BY topic ORDER BY sent_at, msg_id) AS position FROM line ORDER BY topic, position")
def sort_timeline(spark, sf):
    return timeline_rows(spark, sf).select("topic", "msg_id", "sent_at", "position").orderBy("topic", "position")
