"""What a task or a shuffle gets must not grow with the tables."""

from pyspark.sql import functions as F

from threadloom.functions import dates
from threadloom.operators import bm25, documents, keyword_index, segmentation, segments, tfidf
from threadloom.plans import fixtures, scalars
from threadloom.session import scratch_path
from threadloom.tables import TASK_ROWS, spread


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def events(spark, folder, rows):
    spark.range(rows).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id")).cast("timestamp_ntz").alias("ts"),
        (F.col("id") % 500).alias("user_id"), F.lit("click").alias("event_type"), (F.col("id") % 100).cast("double").alias("value"),
        F.lit("{}").alias("props")).coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_tasks_have_bounded_rows(spark, tmp_path):
    sf = events(spark, tmp_path, 12 * TASK_ROWS)
    for df in (fixtures.chat(spark, sf), scalars.str_filter_message(spark, sf), scalars.dt_parse_any(spark, sf), scalars.dt_iso_duration(spark, sf)):
        assert df.rdd.getNumPartitions() >= 12
    assert spread(spark.range(10, numPartitions=1), 1).rdd.getNumPartitions() == 10


def test_durations_and_dates_are_read_once(spark, tmp_path):
    sf = events(spark, tmp_path, 10)
    assert plan(scalars.dt_iso_duration(spark, sf)).count("regexp_extract(") <= 3
    assert scalars.dt_iso_duration(spark, sf).filter("event_id = 9").first()[1:] == (9 * 60 + 9, "9m 9s")
    text = spark.createDataFrame([("2024-01-02T03:04:05.5",), ("",), (None,), ("junk",)], "d string")
    iso = text.select(dates.date_to_iso(F.col("d")).alias("iso"))
    assert [r.iso for r in iso.collect()] == ["2024-01-02T03:04:05.500000", "", "", "1970-01-01T00:00:00"]
    once = text.select(dates.epoch_from_date(F.col("d")).alias("e"))
    assert plan(iso).count("MMM d, yyyy") <= plan(once).count("MMM d, yyyy") > 0


def test_files_are_not_dealt_by_category(spark):
    rows = spark.createDataFrame([("a", "en", "p", "x"), ("a", None, "q", None)], "tool_name string, category string, file_path string, text string")
    found = documents.tool_entries(rows, spark.createDataFrame([("en", "ns")], "category string, namespace string"), "now")
    assert "Exchange hashpartitioning" not in plan(found)
    assert sorted((r.file_path, r.namespace) for r in found.collect()) == [("p", "ns"), ("q", None)]


def test_only_candidates_are_split(spark):
    docs = spark.createDataFrame([(1, "a b b"), (1, "b"), (2, "c"), (3, None), (4, "b")], "doc_id long, text string")
    pairs = spark.createDataFrame([(7, 1), (7, 2), (7, 3), (8, 2), (7, 99)], "query_id long, doc_id long")
    assert "Exchange hashpartitioning" not in plan(bm25.wanted_docs(docs, pairs)).split("BroadcastExchange")[0]
    queries = spark.createDataFrame([(7, "b x")], "query_id long, query_text string")
    got = sorted((r.query_id, r.doc_id, r.score > 0) for r in bm25.bm25_candidates(queries, pairs, docs).collect())
    assert got == [(7, 1, True), (7, 1, True), (7, 2, False), (7, 3, False), (8, 2, False)]


def test_texts_are_cut_where_they_are_read(spark):
    """A text alone under its key needs no shuffle, and both ways give the same chunks."""
    parts = ["Ab cd. ", "ab cd! ", "x " * 40 + ".", "K\u00c4se \u212a.\n", "... ", " \t\n", "word " * 300, "a b c d? ", "12 a b c d? "]
    texts = [(k, "".join(parts[(k * j + j // 3) % len(parts)] for j in range(k))) for k in range(1, 40)] + [(90, None), (91, "")]
    docs = spark.createDataFrame(texts + [(7, "Twice. here."), (None, "Alone. here."), (95, "Twice."), (95, "Twice.")], "doc_id long, text string")
    alone = docs.filter("doc_id NOT IN (7, 95)")
    cut = segmentation.semantic_chunks(alone)
    assert "Exchange" not in plan(cut)
    cols = ("doc_id", "chunk_no", "chunk")
    rows = lambda df: sorted((str(r.doc_id), r.chunk_no, r.chunk) for r in df.select(*cols).collect())
    assert rows(cut) == rows(segmentation._chunks_by_joins(alone, "doc_id", "text", 0.7, 100, 1000))
    whole = segmentation.semantic_chunks(docs)
    assert rows(whole.filter("doc_id <> 95")) and {r.doc_id for r in whole.collect()} >= {7, 95}


REPEATED = [(1, "a b b"), (2, "c a"), (3, None), (4, ""), (5, "x"), (5, "x y"), (5, "y x"), (None, "a"), (None, "a b")]


def test_postings_are_kept_in_blocks(spark):
    """A term's postings are a row per chunk, not per document, and repeated ids count as they did row by row."""
    queries = spark.createDataFrame([(7, "a x y"), (8, "nothing")], "query_id long, query_text string")
    many = spark.createDataFrame([(k, f"common w{k % 7} {'more ' * (k % 5)}") for k in range(3000)], "doc_id long, text string").coalesce(1)
    path = scratch_path(spark, "test-blocks")
    keyword_index.build(many, path)
    assert spark.read.parquet(f"{path}/postings").filter("term = 'common'").count() < 10
    asked = spark.createDataFrame([(1, "w3 more"), (2, "common")], "query_id long, query_text string")
    rows = lambda df: sorted((r.query_id, r.rank, r.doc_id, r.score) for r in df.collect())
    assert rows(keyword_index.search(spark, path, asked, 20)) == rows(bm25.bm25_corpus(asked, many, 20))
    path = scratch_path(spark, "test-blocks")
    keyword_index.build(spark.createDataFrame(REPEATED, "doc_id long, text string"), path)
    got = [(r.doc_id, r.score) for r in keyword_index.search(spark, path, queries).orderBy("rank").collect()]
    assert got == [(5, 4.685176), (None, 0.96264), (2, 0.422623), (1, 0.347154)]
    empty = scratch_path(spark, "test-blocks")
    keyword_index.build(many.filter("false"), empty)
    assert keyword_index.search(spark, empty, queries).count() == 0


def test_a_segment_moves_a_row_per_document(spark, monkeypatch):
    """What an upsert keeps and shuffles is a row per document, whatever the number of its terms."""
    seen = []
    original = segments.stored
    monkeypatch.setattr(segments, "stored", lambda df, name, *by: seen.append((name, original(df, name, *by))) or seen[-1][1])
    index = segments.KeywordSegments(spark, scratch_path(spark, "test-index"))
    docs = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(k % 50))) for k in range(200)] + REPEATED[4:7], "doc_id long, text string")
    index.upsert(docs.filter("doc_id >= 6"))
    assert seen[0][1].count() == 194
    index.upsert(docs.filter("doc_id < 6"))
    queries = spark.createDataFrame([(1, "w3 x"), (2, "w48 y")], "query_id long, query_text string")
    few = index.search(queries, 300)
    monkeypatch.setattr(segments, "weight_rows", lambda weights: None)
    rows = lambda df: sorted((r.query_id, r.rank, r.doc_id, r.score) for r in df.collect())
    assert rows(few) == rows(index.search(queries, 300)) and few.count() > 150


def test_a_vocabulary_counts_few_terms_by_themselves(spark, monkeypatch):
    """The same terms as a count of all of them, but only those of full buckets are shuffled."""
    docs = spark.createDataFrame([(k, " ".join([f"word{j % (k % 40 + 1)}" for j in range(60)] + [f"rare{k} rare{k}x"])) for k in range(300)]
                                 + [(900, None), (901, ""), (902, "one")], "doc_id long, text string").coalesce(2)
    split = docs.select("doc_id", tfidf.terms(F.col("text")).alias("terms"))
    every = split.select("doc_id", F.explode("terms").alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("total"), F.countDistinct("doc_id").alias("df"))
    plain = tfidf.stored
    sums = []
    monkeypatch.setattr(tfidf, "stored", lambda df, name: sums.append(plain(df, name)) or sums[-1])
    for features, buckets in ((30, tfidf.BUCKETS), (30, 64), (5000, tfidf.BUCKETS)):
        want = every.orderBy(F.desc("total"), "term").limit(features).select(
            "term", F.round(F.log(304.0 / (1.0 + F.col("df"))) + 1.0, 9).alias("idf"))
        got = tfidf.fit(docs, features, buckets).vocabulary.select("term", F.round("idf", 9).alias("idf"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert every.count() > 1000 and sums[3].count() <= 64
