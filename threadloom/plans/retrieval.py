"""Retrieval, fusion and reranking: whole query set against whole corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom import fixed_values as fv
from threadloom.functions import dates
from threadloom.functions.quality import has_code
from threadloom.operators import bm25, cells, dense, fusion, graph, keyword_index, ranking, rerank, segments, tfidf
from threadloom.plans import duck, fixtures
from threadloom.plans.fixtures import SQL_DENSE
from threadloom.plans.registry import query
from threadloom.session import cut_lineage, scratch_path
from threadloom.tables import table

SQL_BM25 = """toks AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents),
stat AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS mean FROM toks),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY ALL),
post AS (SELECT doc_id, l, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS l, unnest(t) AS term FROM toks) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
sparse_all AS (SELECT query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))), 6) AS score
  FROM post JOIN qt USING (term) JOIN dfs USING (term), stat GROUP BY query_id, doc_id),
sparse AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
  FROM sparse_all QUALIFY rank <= 50)"""


def dense_hits(spark, sf, k=50):
    return dense.dense_topk(fixtures.query_vectors(spark, sf), fixtures.vectors(spark, sf), k)


def sparse_hits(spark, sf, k=50):
    return bm25.bm25_corpus(fixtures.query_texts(spark, sf), fixtures.corpus(spark, sf), k)


def scaled_sparse(spark, sf):
    """Keyword hits with scores of the same size as cosines."""
    return sparse_hits(spark, sf).withColumn("score", F.col("score") / 128)


SQL_SCALED = "scaled AS (SELECT query_id, doc_id, score / 128 AS score, rank FROM sparse)"
SQL_HITS = (f"{SQL_DENSE}, {SQL_BM25}, {SQL_SCALED}, hits AS (SELECT *, 'dense' AS method FROM dense "
            "UNION ALL SELECT query_id, doc_id, score, rank, 'sparse' FROM scaled)")


@query("ret_dense_topk", f"WITH {SQL_DENSE} SELECT query_id, doc_id, score, rank FROM dense")
def ret_dense_topk(spark, sf):
    return dense_hits(spark, sf)


@query("ret_dense_arrow", f"WITH {SQL_DENSE} SELECT query_id, doc_id, score, rank FROM dense")
def ret_dense_arrow(spark, sf):
    """The form for query sets too large to broadcast."""
    return dense.dense_topk(fixtures.query_vectors(spark, sf), fixtures.vectors(spark, sf), 50, strategy="grid")


@query("ret_dense_ann")
def ret_dense_ann(spark, sf):
    path = scratch_path(spark, "cells")
    cells.build(fixtures.vectors(spark, sf), path)
    return cells.search(spark, path, fixtures.query_vectors(spark, sf), 50)


@query("candidate_join", f"""WITH {SQL_DENSE},
s AS (SELECT query_id, vec_id AS doc_id, round(list_cosine_similarity(qvec::DOUBLE[], embedding::DOUBLE[]), 6) AS score
  FROM qv JOIN embeddings ON label = qlabel)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10""")
def candidate_join(spark, sf):
    """Search restricted to the query's own name space (here: the label)."""
    queries = fixtures.query_vectors(spark, sf).withColumnRenamed("query_label", "namespace")
    chunks = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"), F.col("label").alias("namespace"))
    return dense.dense_topk(queries, chunks, 10, threshold=None, within="namespace")


@query("ret_bm25_corpus", f"WITH {SQL_BM25} SELECT * FROM sparse")
def ret_bm25_corpus(spark, sf):
    return sparse_hits(spark, sf)


@query("ret_bm25_index", f"WITH {SQL_BM25} SELECT * FROM sparse")
def ret_bm25_index(spark, sf):
    """The same from an index built once: its tables are all that a search reads."""
    path = scratch_path(spark, "keyword-index")
    keyword_index.build(fixtures.corpus(spark, sf), path)
    return keyword_index.search(spark, path, fixtures.query_texts(spark, sf))


@query("ret_bm25_segments", f"WITH {SQL_BM25} SELECT * FROM sparse")
def ret_bm25_segments(spark, sf):
    """From an index that changed: first drafts replaced, documents deleted and added again, segments merged."""
    docs, index = fixtures.corpus(spark, sf), segments.KeywordSegments(spark, scratch_path(spark, "segments"))
    even, third = F.pmod("doc_id", F.lit(2)) == 0, F.pmod("doc_id", F.lit(3)) == 0
    index.upsert(docs.filter(even).withColumn("text", F.concat("text", F.lit(" draft draft"))))
    index.upsert(docs.filter(~even))
    index.delete(docs.filter(third))
    index.upsert(docs.filter(even))
    index.upsert(docs.filter(third))
    while index.merge():
        pass
    return index.search(fixtures.query_texts(spark, sf))


SQL_CAND_BM25 = f"""ct AS (SELECT query_id, d.doc_id, {duck.words('text')} AS t FROM dense JOIN documents d USING (doc_id)),
cn AS (SELECT query_id, count(*) AS n, avg(len(t)) AS mean FROM ct GROUP BY query_id),
cp AS (SELECT query_id, doc_id, l, term, count(*) AS tf FROM (SELECT query_id, doc_id, len(t) AS l, unnest(t) AS term FROM ct) GROUP BY ALL),
cq AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({duck.words('text')}) AS term FROM benchmark) GROUP BY ALL),
cd AS (SELECT query_id, term, count(*) AS df FROM cp GROUP BY ALL),
cs AS (SELECT query_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))) AS s
  FROM cp JOIN cq USING (query_id, term) JOIN cd USING (query_id, term) JOIN cn USING (query_id) GROUP BY ALL),
cand AS (SELECT query_id, doc_id, round(coalesce(s, 0), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(s, 0), 6) DESC, doc_id) AS rank
  FROM ct LEFT JOIN cs USING (query_id, doc_id))"""


def candidate_bm25(spark, sf):
    return bm25.bm25_candidates(fixtures.query_texts(spark, sf), dense_hits(spark, sf), fixtures.texts(spark, sf))


@query("ret_bm25", f"WITH {SQL_DENSE}, {SQL_CAND_BM25} SELECT query_id, doc_id, score, rank FROM cand WHERE rank <= 50")
def ret_bm25(spark, sf):
    return candidate_bm25(spark, sf)


SQL_KEYWORD = """kq AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS terms, lower(text) AS phrase FROM benchmark),
kd AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
kh AS (SELECT query_id, doc_id, count(*) AS hits FROM (SELECT query_id, unnest(terms) AS term FROM kq) JOIN kd USING (term) GROUP BY ALL),
keyword AS (SELECT query_id, doc_id, round(hits::DOUBLE / len(terms) + CASE WHEN contains(lower(text), phrase) THEN 0.1 ELSE 0 END, 6) AS score
  FROM kh JOIN kq USING (query_id) JOIN documents USING (doc_id))"""


@query("ret_keyword", f"""WITH {SQL_KEYWORD}
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM keyword QUALIFY rank <= 50""")
def ret_keyword(spark, sf):
    return bm25.keyword_topk(fixtures.query_texts(spark, sf), fixtures.corpus(spark, sf))


# The reply graph: order lines link part numbers to supplier numbers. An edge may come many times; scoring
# takes those it needs and then each of them once.
def edges(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"),
        F.expr("CASE l_returnflag WHEN 'A' THEN 'reply' WHEN 'N' THEN 'same_thread' ELSE 'reference' END").alias("kind"))


SQL_EDGES = """edges AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst,
  CASE l_returnflag WHEN 'A' THEN 'reply' WHEN 'N' THEN 'same_thread' ELSE 'reference' END AS kind FROM lineitem),
links AS (SELECT DISTINCT * FROM (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)),
plinks AS (SELECT src, dst, max(prior) AS prior FROM (
  SELECT src, dst, p.prior FROM (SELECT src, dst, kind FROM edges UNION ALL SELECT dst, src, kind FROM edges)
  JOIN (VALUES ('reply', 1.0::DOUBLE), ('same_thread', 0.7::DOUBLE), ('reference', 0.5::DOUBLE), ('similar', 0.3::DOUBLE)) AS p(kind, prior) USING (kind)) GROUP BY ALL)"""
SQL_NEIGHBOUR = """around AS (SELECT d.query_id, d.doc_id, avg(list_cosine_similarity(qvec::DOUBLE[], embedding::DOUBLE[])) AS mean
  FROM {base} d JOIN links ON src = d.doc_id JOIN embeddings ON vec_id = dst JOIN qv USING (query_id) GROUP BY ALL),
blend AS (SELECT query_id, doc_id, round(0.6 * score + 0.4 * coalesce(mean, 0), 6) AS score FROM {base} LEFT JOIN around USING (query_id, doc_id))"""


@query("ret_graph_neighbor", f"""WITH {SQL_DENSE}, {SQL_EDGES}, {SQL_NEIGHBOUR.format(base='dense')}
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM blend""")
def ret_graph_neighbor(spark, sf):
    return graph.neighbour_blend(dense_hits(spark, sf), edges(spark, sf),
                                 fixtures.query_vectors(spark, sf), fixtures.vectors(spark, sf))


@query("ret_hop_expand", f"""WITH {SQL_DENSE}, {SQL_EDGES}, s0 AS (SELECT query_id, doc_id, score FROM dense WHERE rank <= 5),
s1 AS (SELECT query_id, dst AS doc_id, max(score * 0.6 * prior) AS score FROM s0 JOIN plinks ON src = doc_id GROUP BY ALL),
s2 AS (SELECT query_id, dst AS doc_id, max(score * 0.6 * prior) AS score FROM s1 JOIN plinks ON src = doc_id GROUP BY ALL),
a AS (SELECT query_id, doc_id, round(max(score), 6) AS score FROM (FROM s0 UNION ALL FROM s1 UNION ALL FROM s2) GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM a QUALIFY rank <= 50""")
def ret_hop_expand(spark, sf):
    return graph.hop_expand(dense_hits(spark, sf, 5), edges(spark, sf))


def ppr_rounds(rounds: int) -> str:
    """Power iteration, a table per round; sinks return to the seeds."""
    steps = []
    for k in range(rounds):
        steps.append(f"""moved{k} AS MATERIALIZED (SELECT query_id, dst AS doc_id, sum(mass * p) AS mass FROM mass{k} JOIN hop ON src = doc_id GROUP BY ALL),
mass{k + 1} AS MATERIALIZED (SELECT query_id, doc_id, sum(mass) AS mass FROM (SELECT query_id, doc_id, 0.85 * mass AS mass FROM moved{k}
  UNION ALL SELECT h.query_id, h.doc_id, home * (0.15 + 0.85 * (1 - coalesce(kept, 0))) FROM mass0 h
  LEFT JOIN (SELECT query_id, sum(mass) AS kept FROM moved{k} GROUP BY ALL) USING (query_id)) GROUP BY ALL)""")
    return ",\n".join(steps)


@query("ret_ppr", f"""WITH {SQL_DENSE}, {SQL_EDGES},
best AS (SELECT src, dst, max(prior) AS prior FROM edges JOIN (VALUES ('reply', 1.0::DOUBLE), ('same_thread', 0.7::DOUBLE),
  ('reference', 0.5::DOUBLE), ('similar', 0.3::DOUBLE)) AS p(kind, prior) USING (kind) GROUP BY ALL),
hop AS MATERIALIZED (SELECT src, dst, prior / sum(prior) OVER (PARTITION BY src) AS p FROM best),
mass0 AS MATERIALIZED (SELECT query_id, doc_id, score / sum(score) OVER (PARTITION BY query_id) AS home, home AS mass FROM dense WHERE rank <= 5),
{ppr_rounds(20)}
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
FROM (SELECT query_id, doc_id, round(mass, 6) AS score FROM mass20) QUALIFY rank <= 50""")
def ret_ppr(spark, sf):
    return graph.personalised_pagerank(dense_hits(spark, sf, 5), edges(spark, sf))


@query("ret_ppr_push")
def ret_ppr_push(spark, sf):
    """The same ranking from pushes near the seeds, each score short of the full one by the bound at most."""
    return graph.pushed_pagerank(dense_hits(spark, sf, 5), edges(spark, sf))


@query("ret_parent_child", f"""WITH {fixtures.SQL_MAIL}
SELECT m.msg_id, m.parent_id, m.thread_id, (SELECT count(*) FROM mail c WHERE c.parent_id = m.msg_id) AS children,
  turn AS ancestors, 'M' || conv_id || 'T0' AS top FROM mail m""")
def ret_parent_child(spark, sf):
    return graph.reply_context(fixtures.mail(spark, sf).select("msg_id", "parent_id", "thread_id"))


@query("ret_hybrid_cascade", f"""WITH {SQL_DENSE}, {SQL_EDGES}, {SQL_KEYWORD},
sem AS (SELECT query_id, doc_id, score FROM dense QUALIFY score >= 0.8 * max(score) OVER (PARTITION BY query_id) OR rank <= 20),
key AS (SELECT k.query_id, k.doc_id, k.score AS kscore, sem.score FROM keyword k JOIN sem USING (query_id, doc_id)
  QUALIFY kscore >= 0.8 * max(kscore) OVER (PARTITION BY k.query_id)),
{SQL_NEIGHBOUR.format(base='key')},
g AS (SELECT query_id, doc_id, score FROM blend QUALIFY score >= 0.7 * max(score) OVER (PARTITION BY query_id))
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM g QUALIFY rank <= 10""")
def ret_hybrid_cascade(spark, sf):
    """Semantic, then keyword on its ids, then graph on theirs."""
    hits = dense_hits(spark, sf)
    top = F.max("score").over(ranking.Window.partitionBy("query_id"))
    sem = hits.withColumn("_t", top).filter((F.col("score") >= 0.8 * F.col("_t")) | (F.col("rank") <= 20)).drop("_t", "rank")
    key = ranking.near_top(keyword_scores(spark, sf, sem), 0.8, "kscore")
    blended = graph.neighbour_blend(key, edges(spark, sf), fixtures.query_vectors(spark, sf), fixtures.vectors(spark, sf))
    return ranking.top_k(ranking.near_top(blended.drop("rank"), 0.7), 10)


def keyword_scores(spark, sf, pairs):
    """Keyword score of given (query, doc) pairs only."""
    q = fixtures.query_texts(spark, sf).select(
        "query_id", F.array_distinct(bm25.tokens(F.col("query_text"))).alias("terms"), F.lower("query_text").alias("phrase"))
    d = fixtures.corpus(spark, sf).select(
        "doc_id", F.array_distinct(bm25.tokens(F.col("text"))).alias("toks"), F.lower("text").alias("low"))
    hits = F.size(F.array_intersect("terms", "toks"))
    bonus = F.when(F.contains("low", F.col("phrase")), 0.1).otherwise(0.0)
    return (pairs.join(q, "query_id").join(d, "doc_id").withColumn("_h", hits).filter("_h > 0")
            .select("query_id", "doc_id", "score", F.round(F.col("_h") / F.size("terms") + bonus, 6).alias("kscore")))


# --- windows over candidates ---------------------------------------------------------
@query("win_topk_per_query", f"WITH {SQL_BM25} SELECT * FROM sparse WHERE rank <= 10")
def win_topk_per_query(spark, sf):
    return ranking.top_k(sparse_hits(spark, sf).drop("rank"), 10)


@query("union_candidates", f"WITH {SQL_HITS} SELECT query_id, doc_id, score, rank, method FROM hits")
def union_candidates(spark, sf):
    return fusion.union_hits(dense_hits(spark, sf), scaled_sparse(spark, sf))


SQL_MERGED = """merged AS (SELECT query_id, doc_id, score, method FROM hits
  QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, method) = 1),
mranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM merged)"""


@query("win_dedupe_max_score", f"WITH {SQL_HITS}, {SQL_MERGED} SELECT query_id, doc_id, score, method, rank FROM mranked")
def win_dedupe_max_score(spark, sf):
    return fusion.merged_hits(union_candidates(spark, sf))


@query("win_reciprocal_rank", f"WITH {SQL_HITS} SELECT query_id, doc_id, method, round(1.0 / rank, 6)::DOUBLE AS reciprocal FROM hits")
def win_reciprocal_rank(spark, sf):
    return fusion.reciprocal(union_candidates(spark, sf)).select(
        "query_id", "doc_id", "method", F.round("reciprocal", 6).alias("reciprocal"))


@query("win_offset_page", f"WITH {SQL_BM25} SELECT * FROM sparse WHERE rank > 10 AND rank <= 25")
def win_offset_page(spark, sf):
    return ranking.page(sparse_hits(spark, sf), search_limit=10, limit=15, offset=10)


@query("win_top_threshold", f"WITH {SQL_BM25} SELECT * FROM sparse QUALIFY score >= 0.8 * max(score) OVER (PARTITION BY query_id)")
def win_top_threshold(spark, sf):
    return ranking.near_top(sparse_hits(spark, sf), 0.8)


@query("win_source_diversity", f"""WITH {SQL_BM25} SELECT s.*, source FROM sparse s JOIN documents USING (doc_id)
QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) <= 3""")
def win_source_diversity(spark, sf):
    sources = table(spark, sf, "documents").select("doc_id", "source")
    return ranking.diversify(sparse_hits(spark, sf).join(sources, "doc_id"), "source", F.lit(3))


@query("win_score_calibration", f"""WITH {SQL_HITS}
SELECT query_id, doc_id, method, round(CASE WHEN stddev_pop(score) OVER w > 1e-12 THEN (score - avg(score) OVER w) / stddev_pop(score) OVER w ELSE 0 END, 6) AS zscore,
  round(CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END, 6) AS minmax,
  round(exp(score) / sum(exp(score)) OVER w, 6) AS softmax,
  round(percent_rank() OVER (PARTITION BY query_id, method ORDER BY score), 6) AS percentile
FROM hits WINDOW w AS (PARTITION BY query_id, method)""")
def win_score_calibration(spark, sf):
    out = ranking.calibrated(union_candidates(spark, sf), "query_id", "method")
    return out.select("query_id", "doc_id", "method", *[
        F.round(c, 6).alias(c) for c in ("zscore", "minmax", "softmax", "percentile")])


# --- fusion ------------------------------------------------------------------------------
SQL_FUSED = """fused AS (SELECT query_id, doc_id, d.rank AS dense_rank, s.rank AS sparse_rank,
  round(coalesce(0.6 / d.rank, 0) + coalesce(0.4 / s.rank, 0), 6)::DOUBLE AS score FROM dense d FULL JOIN {sparse} s USING (query_id, doc_id))"""


@query("fuse_weighted_rr", f"""WITH {SQL_DENSE}, {SQL_BM25}, {SQL_FUSED.format(sparse='sparse')}
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fused""")
def fuse_weighted_rr(spark, sf):
    return fusion.weighted_reciprocal(dense_hits(spark, sf), sparse_hits(spark, sf))


SQL_VARIANTS = f"""vq AS (SELECT item_id AS query_id, text AS query_text FROM benchmark),
va AS (SELECT query_id, list_filter([query_text, CASE WHEN NOT ends_with({duck.strip('query_text')}, '?') THEN query_text || '?' END,
    CASE WHEN NOT contains(lower(query_text), 'how') THEN 'How to ' || query_text END,
    CASE WHEN NOT regexp_matches(lower(query_text), '^(what|how|why|when|where)') THEN 'What is ' || query_text END], lambda x: x IS NOT NULL) AS v FROM vq),
variants AS (SELECT query_id, i::INTEGER AS variant, v[i + 1] AS query_text FROM (SELECT query_id, v, unnest(range(len(v))) AS i FROM va))"""


@query("fuse_rrf", f"""WITH {SQL_BM25}, {SQL_VARIANTS},
vt AS (SELECT query_id, variant, term, count(*) AS qtf FROM (SELECT query_id, variant, unnest(regexp_extract_all(lower(query_text), '[a-z0-9]+')) AS term FROM variants) GROUP BY ALL),
vs AS (SELECT query_id, variant, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))), 6) AS score
  FROM post JOIN vt USING (term) JOIN dfs USING (term), stat GROUP BY query_id, variant, doc_id),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id, variant ORDER BY score DESC, doc_id) AS rank FROM vs QUALIFY rank <= 20),
f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, count(*) AS lists FROM vr GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= 10""")
def fuse_rrf(spark, sf):
    from threadloom.operators.query_analysis import variations
    v = variations(fixtures.query_texts(spark, sf))
    key = F.concat_ws("#", F.col("query_id").cast("string"), F.col("variant").cast("string"))
    lists = bm25.bm25_corpus(v.select(key.alias("query_id"), "query_text"), fixtures.corpus(spark, sf), 20)
    return fusion.rrf(lists.withColumn("query_id", F.substring_index("query_id", "#", 1).cast("long")))


@query("fuse_weights_by_route", f"""WITH {SQL_HITS}, qi AS (SELECT item_id AS query_id, CASE WHEN length(text) > 200 THEN 'concept' ELSE 'debug' END AS intent FROM benchmark),
w AS (SELECT * FROM (VALUES ('concept', 'dense', 0.6::DOUBLE), ('concept', 'sparse', 0.2::DOUBLE), ('debug', 'dense', 0.4::DOUBLE), ('debug', 'sparse', 0.3::DOUBLE)) AS w(intent, method, weight)),
f AS (SELECT query_id, doc_id, round(sum(score * weight), 6) AS score FROM hits JOIN qi USING (query_id) JOIN w USING (intent, method) GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= 10""")
def fuse_weights_by_route(spark, sf):
    from threadloom.operators.query_analysis import route_weights
    intent = fixtures.query_texts(spark, sf).select(
        "query_id", F.when(F.length("query_text") > 200, "concept").otherwise("debug").alias("intent"))
    weights = route_weights(spark).withColumn("method", F.expr(
        "CASE method WHEN 'semantic' THEN 'dense' WHEN 'bm25' THEN 'sparse' ELSE method END"))
    return fusion.by_weights(union_candidates(spark, sf).join(intent, "query_id"), weights, ["intent", "method"])


@query("fuse_append_prf", f"""WITH {SQL_DENSE}, {SQL_BM25},
b AS (SELECT query_id, doc_id, 0 AS part, rank FROM dense WHERE rank <= 8 UNION ALL SELECT query_id, doc_id, 1, rank FROM sparse WHERE rank <= 20),
k AS (SELECT query_id, doc_id, min(part * 1000000 + rank) AS place FROM b GROUP BY ALL)
SELECT query_id, doc_id, CASE WHEN place < 1000000 THEN 'fused' ELSE 'feedback' END AS origin,
  row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank FROM k QUALIFY rank <= 20""")
def fuse_append_prf(spark, sf):
    return fusion.append_unseen(dense_hits(spark, sf, 8), sparse_hits(spark, sf, 20), 20)


@query("fuse_ltr")
def fuse_ltr(spark, sf):
    both = fusion.weighted_reciprocal(dense_hits(spark, sf), sparse_hits(spark, sf))
    feature = lambda c: F.coalesce(1.0 / F.col(c), F.lit(0.0))
    judged = table(spark, sf, "labels").select("doc_id", "quality")
    rows = both.join(judged, "doc_id", "left").select(
        "query_id", "doc_id", feature("dense_rank").alias("f_dense"), feature("sparse_rank").alias("f_sparse"), "quality")
    return fusion.learn_to_rank(rows, ["f_dense", "f_sparse"], "quality")


# --- reranking ------------------------------------------------------------------------------
_W2 = f"[{duck.WORD_SET}]" + "{2,}"
SQL_TFIDF = f"""sw AS (SELECT [{', '.join(duck.lit(w) for w in fv.STOP_WORDS)}] AS stop),
base AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'q', item_id, text FROM benchmark),
uni AS (SELECT kind, id, list_filter(regexp_extract_all(lower(text), {duck.lit(_W2)}), lambda w: NOT list_contains(stop, w)) AS u FROM base, sw),
tt AS (SELECT kind, id, unnest(list_concat(u, list_transform(range(1, len(u)), lambda i: u[i] || ' ' || u[i + 1]))) AS term FROM uni),
voc AS (SELECT term, count(DISTINCT id) AS df FROM tt WHERE kind = 'd' AND term IN
  (SELECT term FROM (SELECT term, count(*) AS c FROM tt WHERE kind = 'd' GROUP BY term ORDER BY c DESC, term LIMIT 10000)) GROUP BY term),
tw AS (SELECT kind, id, term, count(*) * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + any_value(df))) + 1) AS w FROM tt JOIN voc USING (term) GROUP BY ALL),
tn AS (SELECT kind, id, sqrt(sum(w * w)) AS norm FROM tw GROUP BY ALL),
tv AS (SELECT kind, id, term, w / norm AS w FROM tw JOIN tn USING (kind, id))"""


@query("rr_tfidf", f"""WITH {SQL_DENSE}, {SQL_CAND_BM25}, {SQL_FUSED.format(sparse='cand')}, {SQL_TFIDF},
sim AS (SELECT query_id, doc_id, sum(a.w * b.w) AS s FROM fused JOIN tv a ON a.kind = 'q' AND a.id = query_id JOIN tv b ON b.kind = 'd' AND b.id = doc_id AND a.term = b.term GROUP BY ALL),
r AS (SELECT query_id, doc_id, round(coalesce(s, 0), 6) AS similarity, round(0.9 * score + 0.1 * coalesce(s, 0), 6) AS score FROM fused LEFT JOIN sim USING (query_id, doc_id))
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r QUALIFY rank <= 50""")
def rr_tfidf(spark, sf):
    """Dense, keyword over the dense hits, fusion, then TF-IDF: the whole local search."""
    hits = cut_lineage(dense_hits(spark, sf))  # few rows per query, read several times below
    q, docs = fixtures.query_texts(spark, sf), fixtures.texts(spark, sf)
    fused = cut_lineage(fusion.weighted_reciprocal(hits, bm25.bm25_candidates(q, hits, docs)))
    return tfidf.rerank(tfidf.fit(fixtures.corpus(spark, sf)), q, fused, docs)


@query("search_local", f"""WITH {SQL_DENSE}, {SQL_CAND_BM25}, {SQL_FUSED.format(sparse='cand')}, {SQL_TFIDF},
typed AS (SELECT f.* FROM fused f JOIN documents d USING (doc_id) WHERE lang IN ('en', 'fr')),
sim AS (SELECT query_id, doc_id, sum(a.w * b.w) AS s FROM typed JOIN tv a ON a.kind = 'q' AND a.id = query_id JOIN tv b ON b.kind = 'd' AND b.id = doc_id AND a.term = b.term GROUP BY ALL),
r AS (SELECT query_id, doc_id, round(coalesce(s, 0), 6) AS similarity, round(0.9 * score + 0.1 * coalesce(s, 0), 6) AS score FROM typed LEFT JOIN sim USING (query_id, doc_id)),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r)
SELECT * FROM n WHERE rank > 5 AND rank <= 15""")
def search_local(spark, sf):
    """The whole local path: dense, keyword over its hits, fusion, types asked for, TF-IDF, second page."""
    hits = cut_lineage(dense_hits(spark, sf))  # few rows per query, read several times below
    q, docs = fixtures.query_texts(spark, sf), fixtures.texts(spark, sf)
    fused = cut_lineage(fusion.weighted_reciprocal(hits, bm25.bm25_candidates(q, hits, docs)))
    types = table(spark, sf, "documents").select("doc_id", "lang").filter(F.col("lang").isin("en", "fr"))
    typed = fused.join(types, "doc_id", "left_semi")
    return ranking.page(tfidf.rerank(tfidf.fit(fixtures.corpus(spark, sf)), q, typed, docs), 50, 10, 5)


def dated(spark, sf):
    """A date and a type per doc: the event with its number, mail where English."""
    ev = table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), "ts")
    return table(spark, sf, "documents").select("doc_id", "lang").join(ev, "doc_id").select(
        "doc_id", F.when(F.col("lang") == "en", "mail").otherwise("documentation").alias("type"), "ts")


@query("rr_recency", f"""WITH {SQL_DENSE},
r AS (SELECT query_id, doc_id, round(CASE WHEN lang = 'en' THEN score * (0.5 + greatest(0.1, least(1.0,
  exp(-floor(({fixtures.AS_OF_EPOCH} - epoch(date_trunc('second', ts))) / 86400.0) / 1500.0)))) ELSE score END, 6) AS score
  FROM dense JOIN documents USING (doc_id) JOIN events ON event_id = doc_id)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r""")
def rr_recency(spark, sf):
    rows = dense_hits(spark, sf).join(dated(spark, sf), "doc_id")
    text = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    bonus = dates.recency_bonus(text, fixtures.AS_OF, fv.RECENCY_DAYS)
    return rerank.recency(rows, F.col("type"), bonus).select("query_id", "doc_id", "score", "rank")


@query("rr_recency_blend", f"""WITH {SQL_DENSE}
SELECT query_id, doc_id, round(score * (0.7 + 0.3 * greatest(0.1, least(1.0, exp(-(({fixtures.AS_OF_EPOCH} - epoch_us(ts) / 1e6) / 86400.0) / 1800.0)))), 6) AS gen_score
FROM dense JOIN events ON event_id = doc_id""")
def rr_recency_blend(spark, sf):
    sent = table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), "ts")
    rows = dense_hits(spark, sf).join(sent, "doc_id")
    age = (F.lit(float(fixtures.AS_OF_EPOCH)) - dates.epoch(F.col("ts"))) / 86400.0
    return rows.select("query_id", "doc_id", F.round(fusion.recency_blend(F.col("score"), age), 6).alias("gen_score"))


def token_vectors(df, key, vec):
    """A 64-d vector read as eight token vectors of eight numbers."""
    return df.select(F.col(key), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(
        F.col(vec), i * 8 + 1, F.lit(8))).alias("tokens"))


SQL_MAXSIM = """mt AS (SELECT query_id, doc_id, i, max(list_dot_product(qvec[i * 8 + 1:i * 8 + 8]::DOUBLE[], embedding[j * 8 + 1:j * 8 + 8]::DOUBLE[])) AS m
  FROM dense JOIN qv USING (query_id) JOIN embeddings ON vec_id = doc_id, (SELECT unnest(range(8)) AS i), (SELECT unnest(range(8)) AS j) GROUP BY ALL),
late AS (SELECT query_id, doc_id, round(sum(m), 6) AS score FROM mt GROUP BY ALL)"""


def late_scores(spark, sf, hits):
    return rerank.max_sim(token_vectors(fixtures.query_vectors(spark, sf), "query_id", "query_vec"),
                          token_vectors(fixtures.vectors(spark, sf), "doc_id", "vec"), hits.select("query_id", "doc_id"))


@query("rr_maxsim", f"WITH {SQL_DENSE}, {SQL_MAXSIM} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM late QUALIFY rank <= 5")
def rr_maxsim(spark, sf):
    return ranking.top_k(late_scores(spark, sf, dense_hits(spark, sf)), 5)


@query("rr_two_stage", f"""WITH {SQL_DENSE}, {SQL_MAXSIM},
f AS (SELECT d.query_id, d.doc_id, d.score, d.rank, {duck.contains_any('t.text', fv.CODE_MARKERS)} OR contains(t.text, 'tion') AND length(t.text) < 400 AS code, l.score AS late
  FROM dense d JOIN documents t USING (doc_id) JOIN late l USING (query_id, doc_id)),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r1 FROM f QUALIFY r1 <= 20),
h AS (SELECT g.*, max(CASE WHEN r1 <= 5 THEN code ELSE false END) OVER (PARTITION BY g.query_id) OR {duck.contains_any('b.text', fv.CODE_MARKERS)} AS rescored FROM g JOIN benchmark b ON b.item_id = g.query_id)
SELECT query_id, doc_id, CASE WHEN rescored THEN late ELSE score END AS score, rescored,
  final_rank AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rescored THEN late ELSE score END DESC, doc_id) AS final_rank FROM h)
WHERE final_rank <= 5""")
def rr_two_stage(spark, sf):
    hits = dense_hits(spark, sf)
    # The texts hold no program code; short ones with a common syllable stand in for it.
    looks = has_code(F.col("text")) | (F.contains("text", F.lit("tion")) & (F.length("text") < 400))
    flags = fixtures.corpus(spark, sf).select("doc_id", looks.alias("has_code"))
    asked = fixtures.query_texts(spark, sf).select("query_id", has_code(F.col("query_text")).alias("query_has_code"))
    return rerank.two_stage(hits.join(flags, "doc_id"), late_scores(spark, sf, hits), asked)


@query("rr_external_scores", f"""WITH {SQL_HITS}, {SQL_MERGED},
x AS (SELECT m.query_id, m.doc_id, m.score, round(quality * 0.9 - toxic * 0.5 + m.score / 10, 6) AS given
  FROM mranked m LEFT JOIN qv USING (query_id) LEFT JOIN labels l ON l.doc_id = m.doc_id AND qlabel < 5),
y AS (SELECT *, max(given IS NOT NULL) OVER (PARTITION BY query_id) AS reranked FROM x)
SELECT query_id, doc_id, coalesce(given, score) AS score, reranked,
  row_number() OVER (PARTITION BY query_id ORDER BY coalesce(given, score) DESC, doc_id) AS rank FROM y WHERE NOT reranked OR given IS NOT NULL QUALIFY rank <= 10""")
def rr_external_scores(spark, sf):
    merged = fusion.merged_hits(union_candidates(spark, sf))
    some = fixtures.query_vectors(spark, sf).filter(F.col("query_label") < 5).select("query_id")
    given = merged.join(some, "query_id").join(table(spark, sf, "labels"), "doc_id").select(
        "query_id", "doc_id", F.round(F.col("quality") * 0.9 - F.col("toxic") * 0.5 + F.col("score") / 10, 6).alias("score"))
    return rerank.external_scores(merged, given, 10)


@query("rr_mmr", f"""WITH RECURSIVE {SQL_DENSE},
c AS (SELECT query_id, doc_id, CASE WHEN max(score) OVER q > min(score) OVER q THEN (score - min(score) OVER q) / (max(score) OVER q - min(score) OVER q)
  ELSE 0 END AS rel, embedding::DOUBLE[] AS v FROM dense JOIN embeddings ON vec_id = doc_id WINDOW q AS (PARTITION BY query_id)),
s AS (SELECT query_id, doc_id, rel, v, NULL::DOUBLE AS nearest, NULL::BIGINT AS rank, 0::BIGINT AS step FROM c
  UNION ALL SELECT query_id, doc_id, rel, v, greatest(coalesce(nearest, -9), list_cosine_similarity(v, chosen_v)),
    CASE WHEN rank IS NULL AND doc_id = chosen THEN step + 1 ELSE rank END, step + 1
  FROM (SELECT *, first_value(doc_id) OVER w AS chosen, first_value(v) OVER w AS chosen_v FROM s WHERE step < 10
    WINDOW w AS (PARTITION BY query_id ORDER BY rank IS NOT NULL, round(CASE WHEN step = 0 THEN rel ELSE 0.5 * rel - 0.5 * nearest END, 9) DESC, doc_id)))
SELECT query_id, doc_id, rank FROM s WHERE step = 10 AND rank IS NOT NULL""")
def rr_mmr(spark, sf):
    return rerank.mmr(dense_hits(spark, sf), fixtures.vectors(spark, sf))


@query("rr_near_dup", f"""WITH {SQL_DENSE}
SELECT query_id, doc_id, score, rank FROM dense a JOIN embeddings ea ON ea.vec_id = a.doc_id WHERE NOT EXISTS (
  SELECT 1 FROM dense b JOIN embeddings eb ON eb.vec_id = b.doc_id WHERE b.query_id = a.query_id AND b.rank < a.rank
  AND round(list_cosine_similarity(ea.embedding::DOUBLE[], eb.embedding::DOUBLE[]), 6) >= 0.5)""")
def rr_near_dup(spark, sf):
    # The vectors are far apart, so a limit of 0.5 is used to see the rule at work.
    return rerank.drop_near_duplicates(dense_hits(spark, sf), fixtures.vectors(spark, sf), 0.5)


@query("rr_authority", f"""WITH {SQL_DENSE}, ns AS (SELECT source, count(*) AS n FROM documents GROUP BY source), nt AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
r AS (SELECT query_id, doc_id, round(score * (1 + 0.2 * ln(1 + ns.n) / (SELECT max(ln(1 + n)) FROM ns) + 0.15 * ln(1 + nt.n) / (SELECT max(ln(1 + n)) FROM nt)), 6) AS score
  FROM dense JOIN documents d USING (doc_id) JOIN ns ON ns.source = d.source JOIN nt ON nt.lang = d.lang)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r""")
def rr_authority(spark, sf):
    messages = table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("sender"), F.col("lang").alias("thread_id"))
    return rerank.authority(dense_hits(spark, sf), messages)


@query("ctx_budget", f"""WITH {SQL_BM25},
r AS (SELECT query_id, rank, text, sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM sparse JOIN documents USING (doc_id) WHERE score >= 0.6)
SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS parts, max(used)::BIGINT AS chars FROM r WHERE used <= 2000 GROUP BY query_id""")
def ctx_budget(spark, sf):
    return rerank.context(sparse_hits(spark, sf).join(fixtures.corpus(spark, sf), "doc_id"))


# --- evaluation --------------------------------------------------------------------------------
@query("eval_topk", f"""WITH {SQL_DENSE},
j AS (SELECT query_id, vec_id AS doc_id FROM qv JOIN embeddings ON label = qlabel JOIN labels l ON l.doc_id = vec_id WHERE quality = 1),
t AS (SELECT query_id, count(*) AS relevant FROM j GROUP BY query_id),
p AS (SELECT d.query_id, count(j.doc_id) AS hits, min(CASE WHEN j.doc_id IS NOT NULL THEN rank END) AS first
  FROM dense d LEFT JOIN j ON j.query_id = d.query_id AND j.doc_id = d.doc_id WHERE rank <= 10 GROUP BY d.query_id)
SELECT query_id, hits, round(hits / 10.0, 6)::DOUBLE AS precision, round(coalesce(hits::DOUBLE / relevant, 0), 6) AS recall,
  round(coalesce(1.0::DOUBLE / first, 0), 6) AS reciprocal_rank FROM p LEFT JOIN t USING (query_id)""")
def eval_topk(spark, sf):
    """Relevant: a labelled doc of good quality whose vector has the query's class."""
    asked = fixtures.query_vectors(spark, sf).select("query_id", F.col("query_label").alias("label"))
    good = table(spark, sf, "labels").filter("quality = 1").select("doc_id")
    docs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label").join(good, "doc_id", "left_semi")
    results = dense_hits(spark, sf, 10)
    # Relevance is looked up for the results; only its totals are counted over all docs.
    hits = results.select("query_id", "doc_id").join(asked, "query_id").join(docs, ["doc_id", "label"], "left_semi")
    totals = docs.groupBy("label").agg(F.count(F.lit(1)).alias("relevant"))
    return rerank.quality_from_counts(results, hits, asked.join(totals, "label"), 10)


@query("agg_eval_items", f"""WITH {SQL_DENSE} SELECT query_id, round(avg(score), 6) AS avg_similarity, max(score) AS max_similarity, count(*) AS num_results
FROM dense WHERE rank <= 15 GROUP BY query_id""")
def agg_eval_items(spark, sf):
    return dense_hits(spark, sf, 15).groupBy("query_id").agg(
        F.round(F.avg("score"), 6).alias("avg_similarity"), F.max("score").alias("max_similarity"),
        F.count(F.lit(1)).alias("num_results"))


@query("agg_eval_by_rank", f"WITH {SQL_DENSE} SELECT rank, round(avg(score), 6) AS mean_similarity, count(*) AS questions FROM dense WHERE rank <= 15 GROUP BY rank")
def agg_eval_by_rank(spark, sf):
    return dense_hits(spark, sf, 15).groupBy("rank").agg(
        F.round(F.avg("score"), 6).alias("mean_similarity"), F.count(F.lit(1)).alias("questions"))


@query("agg_eval_methods", f"WITH {SQL_HITS} SELECT method, count(*) AS results, round(avg(score), 6) AS mean_similarity FROM hits GROUP BY method")
def agg_eval_methods(spark, sf):
    return union_candidates(spark, sf).groupBy("method").agg(
        F.count(F.lit(1)).alias("results"), F.round(F.avg("score"), 6).alias("mean_similarity"))

