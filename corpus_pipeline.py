"""Documents through quality rules, toxicity, near-duplicate removal, pseudonyms and packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written to the shared
folder and read again as the next one's ``docs``. All but the last keep the columns of ``docs``.
An empty table gives an empty result at every stage; null texts are rejected by the first one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.packing import packed
from threadloom.llm.pseudonyms import pseudonymised
from threadloom.llm.quality import keep_good
from threadloom.llm.simhash import SIMILAR_RADIUS, first_of_group
from threadloom.llm.toxicity import train, without_toxic
from threadloom.session import prepare, stored
from threadloom.tables import table

# For checks and tests; a real run sets a key of its own.
PSEUDONYM_KEY = b"corpus pipeline"

# Near copies: five-word shingles, of which two texts share at least four fifths.
SHINGLE, SIMILARITY = 5, 0.8


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    prepare(spark)
    return keep_good(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under one half, by a model of the labelled ones among them."""
    prepare(spark)
    return without_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id."""
    prepare(spark)
    return first_of_group(docs, SIMILAR_RADIUS, SHINGLE, SIMILARITY)


def pseudonym_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values replaced in the texts; lengths stay as they are."""
    prepare(spark)
    return docs.withColumn("text", pseudonymised(F.col("text"), PSEUDONYM_KEY)["text"])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence."""
    prepare(spark)
    return packed(docs)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("pseudonyms", pseudonym_stage),
    ("packing", packing_stage),
]

# The stages learn weights, hash texts by XXH64 and use a keyed permutation, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
