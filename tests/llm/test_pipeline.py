"""The pipeline against its operators, stage by stage, and on odd rows."""

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import ODD, SF, WORDS, lower
from threadloom.llm import quality
from threadloom.session import stored


# names that the stages' own columns are like
CLASHES = ("quality", "repeats", "toxic_score", "group_root", "group_number", "group_name", "words", "fp", "root", "start", "by", "q")


def brute_first(texts):
    """The least id of each group of texts that a chain of pairs with Jaccard similarity 0.8 connects, by sets of
    five-word shingles, all pairs compared."""
    def shingles(text):
        words = WORDS.findall(lower(text))
        return frozenset(zip(*[words[k:] for k in range(5)])) or frozenset([tuple(words)] if words else [])

    ids = sorted(texts)
    own, group = {i: shingles(texts[i]) for i in ids}, {i: i for i in ids}
    for at, x in enumerate(ids):
        for y in ids[:at]:
            shared = len(own[x] & own[y])
            if own[x] == own[y] or shared >= 0.8 * (len(own[x]) + len(own[y]) - shared) - 1e-9:
                low, high = sorted((group[x], group[y]))
                group = {i: low if g == high else g for i, g in group.items()}
    return set(group.values())


def test_stages_on_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before, frames = docs.columns, docs.count(), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), f"test-{name}")
        frames[name] = docs
        if name != "packing":
            assert docs.columns == columns and docs.count() <= before
            before = docs.count()
    kept = {r.doc_id for r in quality.quality(spark.read.parquet(f"{SF}/documents.parquet")).filter("kept").collect()}
    assert {r.doc_id for r in frames["quality"].collect()} == kept
    first = brute_first({r.doc_id: r.text for r in frames["toxicity"].collect()})
    assert {r.doc_id for r in frames["near_duplicates"].collect()} == first
    assert {r.doc_id for r in frames["packing"].collect()} == first
    assert corpus_pipeline.run(spark, SF).count() == frames["packing"].count()


def test_stages_on_odd_and_no_rows(spark):
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    clashing = odd.withColumns({name: F.lit("own") for name in CLASHES})
    for docs in (odd, odd.limit(0), clashing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert name == "packing" or out.columns == docs.columns
            rows = out.collect()
            assert len(rows) <= 4 * docs.count() + 2_000
            assert name == "packing" or all(r[c] == "own" for r in rows for c in docs.columns[2:])
