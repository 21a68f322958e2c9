"""The maintained keyword index against a scan of the documents that are live."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.operators import bm25
from threadloom.operators.segments import KeywordSegments
from threadloom.plans.catalog import CATALOG
from threadloom.session import scratch_path

WORDS = np.array([f"w{k}" for k in range(400)])


def frame(spark, rows, names="doc_id long, text string"):
    return spark.createDataFrame(rows, names)


def topical(n=1500, seed=3):
    """Documents of a few common words and words of one of many topics."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        topic = rng.integers(0, 40)
        own = WORDS[20 + topic * 9 : 29 + topic * 9]
        size = int(rng.integers(5, 60))
        rows.append((k, " ".join([*rng.choice(WORDS[:20], size), *rng.choice(own, rng.integers(1, 8) * (rng.random() < 0.5))])))
    return rows


def same(index, queries, live, spark, k):
    got = {(r.query_id, r.rank): (r.doc_id, r.score) for r in index.search(queries, k).collect()}
    scan = {(r.query_id, r.rank): (r.doc_id, r.score) for r in bm25.bm25_corpus(queries, frame(spark, live), k).collect()}
    assert set(got) == set(scan)
    assert all(got[key][1] == pytest.approx(scan[key][1], abs=2e-6) for key in got)
    assert sum(got[key][0] != scan[key][0] for key in got) <= 0.01 * len(got)  # neighbours whose rounded scores change places


def test_changes_and_merges(spark):
    rows = dict(topical(900))
    queries = frame(spark, [(1, "w0 w25 w30"), (2, "w3"), (3, "w100 w101 nothing"), (4, ""), (5, "w399 w5")], "query_id long, query_text string")
    index = KeywordSegments(spark, scratch_path(spark, "test-index"), range_docs=16, fan=2)
    assert index.search(queries).count() == 0 and not index.merge()
    index.upsert(frame(spark, list(rows.items())[:500]))
    index.upsert(frame(spark, list(rows.items())[500:] + [(5000, None), (5001, "")]))
    rows |= {5000: "", 5001: ""}
    same(index, queries, list(rows.items()), spark, 20)
    changed = {k: f"{rows[k]} w0 w399" for k in range(0, 900, 4)}
    index.upsert(frame(spark, list(changed.items())))
    rows |= changed
    gone = [*range(0, 900, 7), 77_777]
    index.delete(frame(spark, [(k,) for k in gone], "doc_id long"))
    index.delete(frame(spark, [(k,) for k in gone], "doc_id long"))  # once more changes nothing
    rows = {k: t for k, t in rows.items() if k not in gone}
    same(index, queries, list(rows.items()), spark, 20)
    before = len(index.live())
    while index.merge():
        pass
    after = index.live()
    assert len(after) < before and sum(s.docs - s.dead_docs for s in after) == len(rows)
    same(index, queries, list(rows.items()), spark, 20)
    index.delete(frame(spark, [(k,) for k in rows], "doc_id long"))
    assert index.live() == [] and index.search(queries).count() == 0


def test_ranges_below_the_threshold_are_not_read(spark):
    """The same rows from at most half of the postings of the queries' terms."""
    rows = topical(4000)
    queries = frame(spark, [(k, f"{WORDS[20 + 9 * k]} {WORDS[21 + 9 * k]} {WORDS[k % 20]}") for k in range(12)], "query_id long, query_text string")
    index = KeywordSegments(spark, scratch_path(spark, "test-index"), range_docs=16)
    index.upsert(frame(spark, rows))
    same(index, queries, rows, spark, 10)
    parts, reads = index.chosen(index.live(), queries, 10)
    every = parts.agg(F.sum("n")).first()[0]
    read = parts.join(reads, ["query_id", "sid", "range"], "left_semi").agg(F.sum("n")).first()[0]
    assert 0 < read <= every / 2


def test_the_query_searches_merged_segments(spark, tmp_path, monkeypatch):
    """Of the three segments that the changes leave, two with tombstones become one before the search."""
    rows = topical(240)
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    frame(spark, [(k, f"{WORDS[k]} {WORDS[25 + 9 * k]} {WORDS[26 + 9 * k]}") for k in range(10)], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    merge, search, merged, searched = KeywordSegments.merge, KeywordSegments.search, [], []
    monkeypatch.setattr(KeywordSegments, "merge", lambda index: merged.append((len(index.live()), merge(index))) or merged[-1][1])
    monkeypatch.setattr(KeywordSegments, "search", lambda index, queries: searched.extend(index.live()) or search(index, queries))
    got = {(r.query_id, r.rank): (r.doc_id, r.score) for r in CATALOG["ret_bm25_segments"].run(spark, str(tmp_path)).collect()}
    assert merged == [(3, True), (2, False)]
    assert len(searched) == 2 and sum(s.docs for s in searched) == 240 and not any(s.dead_docs or s.graves for s in searched)
    queries = spark.read.parquet(f"{tmp_path}/benchmark.parquet").toDF("query_id", "query_text")
    scan = {(r.query_id, r.rank): (r.doc_id, r.score) for r in bm25.bm25_corpus(queries, frame(spark, rows), 50).collect()}
    assert set(got) == set(scan) and len(got) > 100
    assert all(got[key][1] == pytest.approx(scan[key][1], abs=2e-6) for key in got)


def test_a_merge_writes_what_is_live(spark):
    """A segment that lost much is written again as if the others had never been in it; one that lost little stays."""
    rows = topical(150) + [(900, None), (901, ""), (902, "w1 w1 w2"), (902, "w1 w3 w4"), (903, "w1"), (903, "w2 w3"), (904, "")]
    index = KeywordSegments(spark, scratch_path(spark, "test-index"), range_docs=16)
    index.upsert(frame(spark, rows))
    index.upsert(frame(spark, [(k, "w5 w6") for k in range(2000, 2020)]))
    gone = [*range(0, 150, 12), 2000]
    index.delete(frame(spark, [(k,) for k in gone], "doc_id long"))
    assert not index.merge()
    gone += [*range(0, 150, 3), 901]
    index.delete(frame(spark, [(k,) for k in gone], "doc_id long"))
    small = [s for s in index.live() if s.docs == 20]
    assert index.merge() and not index.merge()
    after = index.live()
    assert len(after) == 2 and [s.asDict() | {"v": 0} for s in after if s.docs == 20] == [s.asDict() | {"v": 0} for s in small]
    alone = KeywordSegments(spark, scratch_path(spark, "test-index"), range_docs=16)
    alone.upsert(frame(spark, [r for r in rows if r[0] not in gone]))
    new, want = next(s for s in after if s.docs != 20), alone.live()[0]
    assert [new[k] for k in ("docs", "length", "dead_docs", "dead_length", "graves")] == [want.docs, want.length, 0, 0, []]
    columns = {"docs": ["doc_id", "len", "range"], "records": ["doc_id", "len"],
               "blocks": ["term", "range", "n", "max_tf", "min_len", F.array_sort("docs")]}
    for what, names in columns.items():
        got, whole = (sorted(map(tuple, i._all([s], what).select(*names).collect())) for i, s in ((index, new), (alone, want)))
        assert got == whole
