"""What a query asks for: intent, entities, features, rewrites."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom import fixed_values as fv
from threadloom.functions.quality import relative_start
from threadloom.functions.text import WORD_SET, contains_any, let, strip, word_count, words


def intent(c: Column) -> Column:
    """``intent, confidence``: the intent with most matching patterns; on a tie the first
    declared. Confidence is the share of its patterns that match."""
    def hits(text: Column) -> Column:
        return F.array(*[
            F.struct(
                F.lit(name).alias("intent"),
                reduce(lambda a, b: a + b, [F.rlike(text, F.lit("(?U)" + p)).cast("int") for p in patterns]).alias("n"),
                F.lit(len(patterns)).alias("of"))
            for name, patterns in fv.INTENT_PATTERNS])

    def best(all_hits: Column) -> Column:
        top = F.aggregate(all_hits, F.lit(0), lambda m, h: F.greatest(m, h["n"]))
        return let(top, lambda m: F.when(m > 0, F.filter(all_hits, lambda h: h["n"] == m)[0]))

    found = let(let(F.lower(c), hits), best)
    return let(found, lambda f: F.when(
        f.isNotNull(), F.struct(f["intent"].alias("intent"), (f["n"] / f["of"]).alias("confidence"))
    ).otherwise(F.struct(F.lit("unknown").alias("intent"), F.lit(0.5).alias("confidence"))))


def _found(c: Column, names: list[str]) -> Column:
    return F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(c, n))


# Word boundaries that know letters of every language.
_START, _END = f"(?<![{WORD_SET}])", f"(?![{WORD_SET}])"


def entities(df: DataFrame) -> DataFrame:
    """Namespaces, functions, types, libraries and keywords a query names."""
    text = F.col("query_text")
    every = lambda p, g: F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(g))))
    lowered = F.lower(text)
    return df.select(
        "query_id",
        every(_START + r"(?:boost|std)::[a-zA-Z_][a-zA-Z0-9_:]*", 0).alias("namespaces"),
        every(_START + r"([a-zA-Z_][a-zA-Z0-9_]*)\s*\(", 1).alias("functions"),
        every(_START + r"([A-Z][a-zA-Z0-9_]*)" + _END, 1).alias("classes"),
        _found(lowered, fv.LIBRARY_NAMES).alias("libraries"),
        _found(lowered, fv.KEYWORD_NAMES).alias("keywords"))


def route_table(spark: SparkSession) -> DataFrame:
    """One row per intent: weights, limits, sources and flags. A fixed small table."""
    rows = [
        (name, sem, bm, graph, k, True, thr, src, depth, per,
         *[name in on for on in fv.ROUTE_FLAGS.values()])
        for name, sem, bm, graph, k, thr, src, depth, per in fv.ROUTES]
    flags = ", ".join(f"{n} boolean" for n in fv.ROUTE_FLAGS)
    return spark.createDataFrame(rows, (
        "intent string, semantic double, bm25 double, graph double, top_k int, rerank boolean, "
        f"threshold double, sources array<string>, graph_depth int, max_per_source int, {flags}"))


def route_weights(spark: SparkSession) -> DataFrame:
    """The weights of all routes as ``intent, method, weight``."""
    return route_table(spark).select("intent", F.explode(F.create_map(
        F.lit("semantic"), "semantic", F.lit("bm25"), "bm25", F.lit("graph"), "graph"))
        .alias("method", "weight"))


def route(df: DataFrame) -> DataFrame:
    found = df.withColumn("_i", intent(F.col("query_text"))).select(
        *df.columns, F.col("_i.intent").alias("intent"), F.col("_i.confidence").alias("confidence"))
    # Every intent has a route; a left join keeps the rules from being run again for a filter.
    return found.join(F.broadcast(route_table(df.sparkSession)), "intent", "left")


def features(df: DataFrame) -> DataFrame:
    """Length, markers and complexity, by both rules in use, and the advised expansion."""
    text = F.col("query_text")
    lowered, n = F.lower(text), word_count(text)
    code = contains_any(text, fv.QUERY_CODE_MARKERS)
    technical = contains_any(lowered, fv.TECHNICAL_TERMS)
    code_word = contains_any(lowered, fv.QUERY_CODE_WORDS)
    question = F.endswith(strip(text), F.lit("?"))
    hints = [F.when(contains_any(lowered, marks), name) for name, marks in fv.LANGUAGE_HINTS]
    return df.select(
        "query_id", n.cast("long").alias("length"), code.alias("has_code"),
        technical.alias("has_technical_terms"), question.alias("is_question"),
        F.when((n <= 3) & ~code, "simple").when((n > 15) | (code & technical), "complex")
        .otherwise("medium").alias("complexity"),
        F.array_compact(F.array(*hints)).alias("language_hints"),
        F.when(n <= 3, "simple").when(n <= 10, "medium").otherwise("complex").alias("word_complexity"),
        F.when(n <= 3, "aggressive_expansion").when(code_word, "technical_expansion")
        .when(question, "paraphrase_expansion").otherwise("standard_expansion").alias("strategy"))


def variations(df: DataFrame, most: int = fv.MAX_VARIATIONS) -> DataFrame:
    """The query and simple rewrites: ``query_id, variant, query_text``."""
    text = F.col("query_text")
    lowered = F.lower(text)
    asks = F.rlike(lowered, F.lit(r"\A(what|how|why|when|where)"))
    options = F.array_compact(F.array(
        text,
        F.when(~F.endswith(strip(text), F.lit("?")), F.concat(text, F.lit("?"))),
        F.when(~F.contains(lowered, F.lit("how")), F.concat(F.lit("How to "), text)),
        F.when(~asks, F.concat(F.lit("What is "), text))))
    return df.select("query_id", F.posexplode(F.slice(options, 1, most)).alias("variant", "query_text"))


def synonyms(df: DataFrame, most: int = fv.MAX_SYNONYM_QUERIES) -> DataFrame:
    """The query with single words replaced: ``query_id, variant, query_text``."""
    text = F.col("query_text")
    table = F.create_map(*[x for word, alts in fv.SYNONYMS
                           for x in (F.lit(word), F.array(*[F.lit(a) for a in alts]))])
    none = F.array().cast("array<string>")
    rewrites = F.flatten(F.transform(words(F.lower(text)), lambda w: F.transform(
        F.coalesce(F.try_element_at(table, w), none), lambda s: F.replace(text, w, s))))
    every = F.array_distinct(F.concat(F.array(text), rewrites))
    return df.select("query_id", F.posexplode(F.slice(every, 1, most)).alias("variant", "query_text"))


def feedback(queries: DataFrame, results: DataFrame, docs: DataFrame, top_n: int = 3,
             num_terms: int = 5) -> DataFrame:
    """Queries with the most frequent terms of their best results appended, in
    alphabetical order. A query with fewer than ``top_n`` results stays as it is."""
    from threadloom.operators.ranking import top_k

    token = F.regexp_extract_all(F.lower("text"), F.lit(f"[{WORD_SET}]{{2,}}"), F.lit(0))
    best = results.filter(F.col("rank") <= top_n)
    enough = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= top_n)
    counted = (
        best.join(enough, "query_id", "left_semi").join(docs, "doc_id")
        .select("query_id", F.explode(token).alias("doc_id"))
        .filter(~F.col("doc_id").isin(fv.STOP_WORDS))
        .groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("score")))
    added = top_k(counted, num_terms).groupBy("query_id").agg(
        F.array_join(F.array_sort(F.collect_list("doc_id")), " ").alias("added"))
    return queries.join(added, "query_id", "left").select(
        "query_id", F.concat_ws(" ", "query_text", "added").alias("query_text"))


def parameters(df: DataFrame, as_of_epoch: float) -> DataFrame:
    """Number of results, namespace and start time a question asks for."""
    text = F.lower("query_text")
    said = F.regexp_extract(text, r"\b(?:top|first|best)\s+([0-9]{1,5})\b", 1).try_cast("long")
    space = (
        F.when(contains_any(text, ["mailing list", "email", "mail "]), "mailing")
        .when(contains_any(text, ["slack", "chat"]), "slack")
        .when(contains_any(text, ["wg21", "proposal", "paper"]), "wg21")
        .when(contains_any(text, ["documentation", "reference manual"]), "cpp-documentation")
        .otherwise("mailing"))
    number = (
        F.when(said.between(1, 10000), said)
        .when(contains_any(text, ["a few", "several"]), 5)
        .when(contains_any(text, ["many", "comprehensive"]), 20).otherwise(10))
    return df.select("query_id", number.cast("long").alias("top_k"), space.alias("namespace"),
                     relative_start(text, as_of_epoch).alias("start_epoch"))


