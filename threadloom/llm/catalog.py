"""Registered queries of this package and the SQL each one must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.session import prepare, scratch_path
from threadloom.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def op(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(prepare(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


QUALITY_CTES = r"""d AS (SELECT row_number() OVER () AS rid, *, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
dup AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, k) > 1),
cov AS (SELECT rid, count(DISTINCT i + j) AS n FROM dup, (SELECT unnest([0, 1, 2]) AS j) GROUP BY rid),
m AS (SELECT w.*, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov USING (rid)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  n_symbols * 10 > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
  OR length(regexp_replace(t, '[^!?]+', '', 'g')) * 4 > n_words OR length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) * 2 > word_chars
  OR n_dup_lines * 2 > len(string_split(t, chr(10))) AS junk FROM m)"""


@op("op4_quality_cascade", f"""WITH {QUALITY_CTES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT junk AS kept FROM judged""")
def op4(spark, sf_dir):
    from threadloom.llm.quality import quality

    return quality(table(spark, sf_dir, "documents")).drop("rejected_by")


@op("op6_token_counts")
def op6(spark, sf_dir):
    from threadloom.llm.wordpieces import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


@op("op5_hierarchical_packing")
def op5(spark, sf_dir):
    from threadloom.llm.packing import packed

    return packed(table(spark, sf_dir, "documents"))


@op("op9_byte_bpe")
def op9(spark, sf_dir):
    from threadloom.llm.byte_bpe import encoded

    return encoded(table(spark, sf_dir, "documents")).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@op("op2_simhash_components")
def op2(spark, sf_dir):
    from threadloom.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@op("op1_toxicity_crf")
def op1(spark, sf_dir):
    from threadloom.llm.toxicity import toxic_scores

    return toxic_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@op("op8_site_style_tree")
def op8(spark, sf_dir):
    from threadloom.llm.html import main_text

    return main_text(table(spark, sf_dir, "pages"))


@op("op3_backoff_automaton")
def op3(spark, sf_dir):
    from threadloom.llm.language_model import scores

    return scores(table(spark, sf_dir, "documents"))


@op("op10_hash_forest")
def op10(spark, sf_dir):
    from threadloom.llm.hash_forest import nearest

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return nearest(vectors, vectors.filter("vec_id % 50 = 0"))


# The key of the registered query, so that its results can be checked; a real run brings its own.
DEMO_KEY = b"registered query"


@op("op7_feistel_pseudonyms")
def op7(spark, sf_dir):
    from threadloom.llm.pseudonyms import pseudonyms

    return pseudonyms(table(spark, sf_dir, "documents"), DEMO_KEY)


# crc32 of a text of ASCII characters, by its definition: a step per bit.
CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)),
  lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x // 2, 3988292384 * (x % 2)))))"""


def merkle_leaf(text: str) -> str:
    parts = [f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


def merkle_levels(name: str, start: str) -> str:
    """All levels of the trees whose leaves are ``start(tree, n, pos, h)``, and each node's siblings in its run."""
    run = "PARTITION BY tree, level, pos // 3 ORDER BY pos ROWS BETWEEN"
    return f"""{name}_levels AS (SELECT tree, n, 0::BIGINT AS level, pos, h FROM {start}
  UNION ALL SELECT tree, (n + 2) // 3, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM {name}_levels WHERE n > 1
  GROUP BY tree, n, level, pos // 3),
{name}_steps AS (SELECT *, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
  coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {name}_levels),
{name}_roots AS (SELECT tree, h FROM {name}_levels WHERE n = 1)"""


def merkle_ways(name: str, start: str) -> str:
    """The way of each row of ``start(rid, tree, pos, proof, fold)`` to the root of its tree."""
    return f"""{name}_ways AS (SELECT rid, tree, pos, 0::BIGINT AS level, proof, fold, false AS done FROM {start}
  UNION ALL SELECT w.rid, w.tree, w.pos // 3, w.level + 1, w.proof || s.b || s.a, CASE WHEN s.n > 1 THEN sha256(s.b || w.fold || s.a) ELSE w.fold END, s.n = 1
  FROM {name}_ways w JOIN {name}_steps s ON s.tree = w.tree AND s.level = w.level AND s.pos = w.pos WHERE NOT w.done)"""


@op("op11_merkle_manifest", f"""WITH RECURSIVE rows_ AS (SELECT *, coalesce('1' || source, '0') AS tree, {merkle_leaf("text")} AS leaf,
  {merkle_leaf("replace(text, chr(10), '')")} AS bare, {CRC32.format("coalesce(doc_id::VARCHAR, '')")} % 2 = 0 AS even FROM documents),
leaves AS (SELECT *, row_number() OVER () AS rid, leaf AS h, count(*) OVER (PARTITION BY tree) AS n,
  row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM rows_),
{merkle_levels("own", "leaves")},
tops AS (SELECT h, 'top' AS tree, tree AS key, count(*) OVER () AS n, row_number() OVER (ORDER BY tree) - 1 AS pos FROM own_roots),
{merkle_levels("top", "tops")},
starts AS (SELECT rid, tree, pos, '' AS proof, CASE WHEN even THEN bare ELSE leaf END AS fold FROM leaves),
{merkle_ways("own", "starts")},
upper AS (SELECT w.rid, t.tree, t.pos, w.proof, w.fold FROM own_ways w JOIN tops t ON t.key = w.tree WHERE w.done),
{merkle_ways("top", "upper")}
SELECT l.doc_id, l.leaf, s.h AS subroot, r.h AS root, sha256(w.proof) AS proof_sha256, w.fold AS folded_root, w.fold = r.h AS verified
FROM top_ways w JOIN leaves l USING (rid) JOIN own_roots s ON s.tree = l.tree, top_roots r WHERE w.done""")
def op11(spark, sf_dir):
    from threadloom.llm.manifest import verified

    return verified(table(spark, sf_dir, "documents"))


@op("op13_token_files")
def op13(spark, sf_dir):
    from threadloom.llm.token_files import read_tokens, write_tokens

    folder = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), folder)
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def lloyd_sql(rounds: int) -> str:
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS MATERIALIZED (SELECT * FROM (SELECT p.rid, p.part, b.e, sum((p.x - b.x) * (p.x - b.x))::BIGINT AS d
  FROM points p JOIN book{k} b USING (part, pos) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY rid, part ORDER BY d, e) = 1)""")
        if k < rounds:
            steps.append(f"""book{k + 1} AS MATERIALIZED (SELECT part, e, pos, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN (
  SELECT part, e, pos, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x FROM points JOIN near{k} USING (rid, part) GROUP BY ALL) m USING (part, e, pos))""")
    return ",\n".join(steps)


@op("op12_cover_tree_codes", f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label,
  list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
points AS MATERIALIZED (SELECT rid, i // (len(v) // 4) AS part, i % (len(v) // 4) AS pos, v[i + 1] AS x
  FROM (SELECT rid, v, unnest(range(len(v))) AS i FROM kept)),
book0 AS MATERIALIZED (SELECT part, e, pos, x FROM points JOIN (SELECT rid, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept
  QUALIFY e < 256) USING (rid)),
{lloyd_sql(4)},
coded AS (SELECT rid, string_agg(format('{{:02x}}', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near4 GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, e, pos)) FROM book4) AS codebooks_sha256 FROM kept JOIN coded USING (rid)""")
def op12(spark, sf_dir):
    from threadloom.llm.cover_codes import codes

    return codes(table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector")))
