"""A keyword index that is kept up to date: immutable segments, tombstones, merges by size.

Each ``upsert`` writes one segment with the postings of its documents. A document that an older segment has too, or
that ``delete`` names, gets a tombstone there; nothing is rewritten. ``merge`` puts segments of about the same size
together once there are FAN of them, without the dead postings, so that there are few segments and each posting is
rewritten a logarithmic number of times. It also puts those together, however few, that lost a share DEAD of their
documents: at most four live documents are rewritten for each dead one. A small table ``log`` names the live segments and
their sums per version; a version counts once it is there in full.

A document is counted in the task that reads its text and shuffled once, as one row, to the task of its range. A segment
keeps these rows beside its postings, so that a merge moves a row per document, too.

Documents of a segment are dealt into ranges of about RANGE_DOCS documents of similar length. A block is a term's postings in
one range, with the largest frequency and the least length in it. These bound what any document of the range can
score, without reading a posting. ``search`` scores the ranges with the highest bounds first, takes the k-th score
found as the threshold, and reads the postings of only those ranges whose bound reaches it. The result is that of a
scan over the live documents: document frequencies, their number and mean length are exact after deletes.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.bm25 import (
    B, K1, NO_ID, alone_and_repeated, blocks_topk, idf, query_terms, saturation, token_counts, tokens, weight_rows, whole_groups)
from threadloom.operators.ranking import top_k
from threadloom.session import sent, stored

FAN = 4
DEAD = 0.2
RANGE_DOCS = 64
BUCKET_POSTINGS = 2_000_000
ROUNDING = 2e-6  # scores are compared after rounding to six places

LOG = "v int, sid string, buckets int, docs long, length long, dead_docs long, dead_length long, graves array<string>"
RECORD = "doc_id long, len long, terms string, tfs array<int>"  # distinct terms, parted by spaces, and their counts
TABLES = {"docs": "doc_id long, len long, range long", "records": RECORD,
          "blocks": "term string, range long, n long, max_tf long, min_len long, "
                    "docs array<struct<doc_id: long, tf: long, len: long>>, bucket int"}
BLOCK = ["term", "range", "n", "max_tf", "min_len"]


def length_class(length: Column) -> Column:
    """Lengths that differ by about a tenth share a class."""
    return F.floor(F.log(length + 1.0) * 10).cast("long")


def doc_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of the documents ``doc_id, toks``, each doc_id once."""
    for batch in batches:
        words, rows, cols, tf, lens = token_counts(batch)
        at = pa.array(np.searchsorted(rows, np.arange(len(batch) + 1)).astype(np.int32))
        terms = pc.binary_join(pa.ListArray.from_arrays(at, words.take(pa.array(cols))), " ")
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(lens), terms, pa.ListArray.from_arrays(at, pa.array(tf.astype(np.int32)))],
            names=[f.split()[0] for f in RECORD.split(", ")])


def gathered(counted: DataFrame) -> DataFrame:
    """Records of rows ``doc_id, len, term, tf``, a null term for an empty document."""
    pair = F.when(F.col("term").isNotNull(), F.struct("term", F.col("tf").cast("int").alias("tf")))
    return counted.groupBy("doc_id", "len").agg(F.collect_list(pair).alias("d")).select(
        "doc_id", "len", F.array_join("d.term", " ").alias("terms"), F.col("d.tf").alias("tfs"))


def range_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of records ``range, doc_id, len, terms, tfs``, in order of their ranges."""
    for table in whole_groups(batches):
        ranges, doc_ids, lens, terms, tfs = (c.combine_chunks() for c in table.columns)
        n = pc.list_value_length(tfs).to_numpy()
        words = pc.split_pattern(terms.filter(pa.array(n > 0)), " ").flatten().dictionary_encode()
        if not len(words):
            continue
        row, tf = np.repeat(np.arange(len(n)), n), tfs.flatten().to_numpy().astype(np.int64)
        code, place = words.indices.to_numpy(), ranges.to_numpy()[row]
        ids, length = pc.fill_null(doc_ids, NO_ID).to_numpy()[row], lens.to_numpy()[row]
        order = np.lexsort((length, tf, ids, code, place))
        row, tf, code, place, length = row[order], tf[order], code[order], place[order], length[order]
        first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (place[1:] != place[:-1])]))
        edges = np.append(first, len(row))
        docs = pa.StructArray.from_arrays([doc_ids.take(pa.array(row)), pa.array(tf), pa.array(length)], ["doc_id", "tf", "len"])
        yield pa.RecordBatch.from_arrays(
            [words.dictionary.take(pa.array(code[first])), pa.array(place[first]), pa.array(np.diff(edges)),
             pa.array(np.maximum.reduceat(tf, first)), pa.array(np.minimum.reduceat(length, first)),
             pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), docs)], names=[*BLOCK, "docs"])


class KeywordSegments:
    """The index below ``path``; doc_ids are unique and not null."""

    def __init__(self, spark: SparkSession, path: str, range_docs: int = RANGE_DOCS, fan: int = FAN):
        self.spark, self.path, self.range_docs, self.fan = spark, path, range_docs, fan

    # the log: a row per live segment

    def _log(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(LOG).json(f"{self.path}/log")
        except AnalysisException as error:  # no version yet
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def live(self) -> list:
        """The segments of the newest version."""
        log = self._log()
        if log is None:
            return []
        newest = log.agg(F.max("v")).first()[0]
        return sorted(log.filter((F.col("v") == newest) & F.col("sid").isNotNull()).collect(), key=lambda r: r.sid)

    def _commit(self, rows: list[dict]) -> None:
        log = self._log()
        version = 1 if log is None else log.agg(F.max("v")).first()[0] + 1
        fields = LOG.split(", ", 1)[1]
        rows = rows or [dict.fromkeys(f.split()[0] for f in fields.split(", "))]
        self.spark.createDataFrame([tuple(r.values()) for r in rows], fields).coalesce(1).write.json(f"{self.path}/log/v={version}")

    # changes

    def upsert(self, docs: DataFrame) -> None:
        """Adds ``docs(doc_id, text)``; each replaces the document of its id. The texts are split once."""
        split = lambda rows: rows.select("doc_id", tokens(F.coalesce("text", F.lit(""))).alias("toks"))
        alone, again = alone_and_repeated(docs)
        records = split(alone).mapInArrow(doc_records, RECORD)
        if again is not None:
            records = records.unionByName(gathered(
                split(again).select("doc_id", F.size("toks").cast("long").alias("len"), F.explode_outer("toks").alias("term"))
                .groupBy("doc_id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))))
        before = self.live()
        new = self._segment(records)
        rows = self._buried(before, self.spark.read.parquet(f"{self.path}/segments/{new['sid']}/docs").select("doc_id"))
        self._commit(rows + ([new] if new["docs"] else []))

    def delete(self, ids: DataFrame) -> None:
        """Removes the documents ``ids(doc_id)``."""
        before = self.live()
        self._commit(self._buried(before, ids.select("doc_id").distinct()))

    def _segment(self, records: DataFrame) -> dict:
        """Writes records as a segment."""
        sid = uuid.uuid4().hex
        place = f"{self.path}/segments/{sid}"
        records = stored(records, f"{place}/records")
        classes = records.groupBy(length_class(F.col("len")).alias("class")).agg(F.count(F.lit(1)).alias("n"))
        parts = classes.select("class", F.ceil(F.col("n") / self.range_docs).alias("parts"))  # a row per tenth of length
        number = F.shiftleft(F.col("class"), 40).bitwiseOR(F.pmod(F.xxhash64("doc_id"), F.col("parts")))
        placed = records.withColumn("class", length_class(F.col("len"))).join(F.broadcast(parts), "class").withColumn(
            "range", number).drop("class", "parts")
        postings = records.agg(F.coalesce(F.sum(F.size("tfs")), F.lit(0))).first()[0]
        buckets = max(1, -(-postings // BUCKET_POSTINGS))
        blocks = (placed.select("range", "doc_id", "len", "terms", "tfs").repartition("range").sortWithinPartitions("range")
                  .mapInArrow(range_blocks, TABLES["blocks"].rsplit(", ", 1)[0]))
        (blocks.withColumn("bucket", bucket_of(F.lit(buckets))).sortWithinPartitions("bucket", "term", "range")
         .write.partitionBy("bucket").parquet(f"{place}/blocks"))
        placed.select("doc_id", "len", "range").write.parquet(f"{place}/docs")
        count, length = self.spark.read.schema(TABLES["docs"]).parquet(f"{place}/docs").agg(
            F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
        return dict(sid=sid, buckets=buckets, docs=count, length=length, dead_docs=0, dead_length=0, graves=[])

    def _all(self, segments: list, what: str) -> DataFrame:
        """One table of all segments, with their ``sid``."""
        return reduce(DataFrame.unionByName, [
            self.spark.read.schema(TABLES[what]).parquet(f"{self.path}/segments/{s.sid}/{what}").withColumn("sid", F.lit(s.sid))
            for s in segments])

    def dead(self, segments: list) -> DataFrame | None:
        """``sid, range, doc_id, len`` of what tombstones name."""
        some = [s for s in segments if s.graves]
        return reduce(DataFrame.unionByName, [
            self.spark.read.schema(TABLES["docs"]).parquet(*[f"{self.path}/tombstones/{g}" for g in s.graves]).withColumn(
                "sid", F.lit(s.sid)) for s in some]) if some else None

    def _buried(self, segments: list, ids: DataFrame) -> list[dict]:
        """Writes tombstones for the documents in the segments and gives the new rows of the log."""
        rows = {s.sid: {k: v for k, v in s.asDict().items() if k != "v"} for s in segments}
        if segments:
            found = self._all(segments, "docs").join(ids, "doc_id", "left_semi")
            gone = self.dead(segments)
            if gone is not None:
                found = found.join(gone.select("sid", "doc_id"), ["sid", "doc_id"], "left_anti")
            found = stored(found, "index-tombstones")
            for sid, count, length in found.groupBy("sid").agg(F.count(F.lit(1)), F.sum("len")).collect():
                grave = f"{sid}-{uuid.uuid4().hex}"  # counts once the log names it
                found.filter(F.col("sid") == sid).drop("sid").write.parquet(f"{self.path}/tombstones/{grave}")
                rows[sid] |= {"dead_docs": rows[sid]["dead_docs"] + count, "dead_length": rows[sid]["dead_length"] + length,
                              "graves": [*rows[sid]["graves"], grave]}
        return [r for r in rows.values() if r["docs"] > r["dead_docs"]]

    def merge(self) -> bool:
        """Puts FAN or more segments of one size together, if there are, smallest first; else those that lost a share DEAD of
        their documents. False if there are neither."""
        before, tiers = self.live(), {}
        for s in before:
            tiers.setdefault(int(math.log(max(1, s.docs - s.dead_docs), self.fan)), []).append(s)
        some = next((some for _, some in sorted(tiers.items()) if len(some) >= self.fan),
                    [s for s in before if s.dead_docs >= DEAD * s.docs])
        if not some:
            return False
        new, gone = self._segment(self._live_records(some)), {s.sid for s in some}
        self._commit([{k: v for k, v in s.asDict().items() if k != "v"} for s in before if s.sid not in gone] + [new])
        return True

    def _live_records(self, segments: list) -> DataFrame:
        records, gone = self._all(segments, "records"), self.dead(segments)
        if gone is not None:
            records = records.join(sent(gone.select("sid", "doc_id")), ["sid", "doc_id"], "left_anti")
        return records.drop("sid")

    def _without_dead(self, blocks: DataFrame, segments: list) -> DataFrame:
        """``blocks`` with live postings only."""
        gone = self.dead(segments)
        if gone is None:
            return blocks
        return blocks.join(self._graves(gone), ["sid", "range"], "left").withColumn("docs", self._living()).drop("gone")

    @staticmethod
    def _graves(gone: DataFrame) -> DataFrame:
        """The dead documents of each range: at most a range each."""
        return gone.groupBy("sid", "range").agg(F.collect_set("doc_id").alias("gone"))

    @staticmethod
    def _living() -> Column:
        return F.filter("docs", lambda d: ~F.coalesce(F.array_contains("gone", d["doc_id"]), F.lit(False)))

    # search

    def search(self, queries: DataFrame, k: int = 50, k1: float = K1, b: float = B) -> DataFrame:
        """``query_id, doc_id, score, rank`` of ``queries(query_id, query_text)``."""
        segments = self.live()
        if not segments:
            kind = queries.schema["query_id"].dataType.simpleString()
            return top_k(self.spark.createDataFrame([], f"query_id {kind}, doc_id long, score double"), k)
        parts, reads, few = self._chosen(segments, queries, k, k1, b)
        return self._best(segments, parts, reads, few, k, k1, b)

    def chosen(self, segments: list, queries: DataFrame, k: int = 50, k1: float = K1, b: float = B) -> tuple[DataFrame, DataFrame]:
        """Weighted matches ``query_id, term, sid, bucket, range, n, w``, and the ranges ``query_id, sid, range`` to read for
        each query."""
        return self._chosen(segments, queries, k, k1, b)[:2]

    def _chosen(self, segments: list, queries: DataFrame, k: int, k1: float, b: float) -> tuple[DataFrame, DataFrame, pd.DataFrame | None]:
        """The same, and the weights ``query_id, term, w`` if they are few."""
        alive, mean = sum(s.docs - s.dead_docs for s in segments), self.mean_length(segments)
        terms = query_terms(queries, tokens(F.col("query_text")))
        places = F.explode(F.array(*[F.struct(F.lit(s.sid).alias("sid"), F.lit(s.buckets).alias("buckets")) for s in segments]))
        sought = terms.select("term").distinct().withColumn("p", places).select("term", "p.*").select(
            "term", "sid", bucket_of(F.col("buckets")).alias("bucket"))
        sought = stored(sought, "index-terms")
        # bounds alone: the postings are not read
        matched = stored(self._all(segments, "blocks").select("sid", "bucket", *BLOCK).join(
            sent(sought), ["sid", "bucket", "term"]), "index-matches")
        df = matched.groupBy("term").agg(F.sum("n").alias("df"))
        gone = self.dead(segments)
        if gone is not None:  # what tombstones take from the frequencies
            touched = matched.join(gone.select("sid", "range").distinct(), ["sid", "range"], "left_semi").select(
                "sid", "bucket", "term", "range")
            lost = (self._all(segments, "blocks").select("sid", "bucket", "term", "range", "docs")
                    .join(touched, ["sid", "bucket", "term", "range"], "left_semi")
                    .select("sid", "term", F.explode("docs.doc_id").alias("doc_id"))
                    .join(gone.select("sid", "doc_id"), ["sid", "doc_id"], "left_semi")
                    .groupBy("term").agg(F.count(F.lit(1)).alias("lost")))
            df = df.join(lost, "term", "left").select("term", (F.col("df") - F.coalesce("lost", F.lit(0))).alias("df")).filter("df > 0")
        weights = terms.join(df, "term").select("query_id", "term", (F.col("qtf") * idf(F.lit(float(alive)), F.col("df"))).alias("w"))
        weights = stored(weights, "index-weights")
        few = weight_rows(weights)
        parts = stored(matched.join(weights, "term"), "index-parts")
        bound = F.col("w") * saturation(F.col("max_tf"), F.col("min_len"), F.lit(mean), k1, b)
        bounds = parts.groupBy("query_id", "sid", "range").agg(F.sum(bound).alias("bound"))
        bounds = stored(bounds.withColumn("score", F.col("bound")).withColumn("doc_id", F.struct("sid", "range")), "index-bounds")
        first = top_k(bounds, k).select("query_id", "sid", "range")  # each is likely to hold one of the best
        best = self._best(segments, parts, first, few, k, k1, b)
        threshold = best.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("threshold"))
        reads = bounds.join(threshold, "query_id", "left").filter(
            F.col("threshold").isNull() | (F.col("bound") + ROUNDING >= F.col("threshold")))
        return parts, stored(reads.select("query_id", "sid", "range"), "index-reads"), few

    @staticmethod
    def mean_length(segments: list) -> float:
        return sum(s.length - s.dead_length for s in segments) / max(1, sum(s.docs - s.dead_docs for s in segments))

    def _best(self, segments: list, parts: DataFrame, reads: DataFrame, few: pd.DataFrame | None, k: int, k1: float,
              b: float) -> DataFrame:
        """Top k of the live documents of the ranges, each with all of its query's terms. With few terms a range is read
        once for all queries: what it adds to a query that did not choose it stays below the threshold."""
        if few is None:
            return top_k(self._scored(segments, parts, reads, k1, b), k)
        ranges = reads.select("sid", "range").distinct()
        gone = self.dead(segments)
        if gone is None:
            gone = self.spark.createDataFrame([], "sid string, range long, doc_id long")
        ranges = stored(ranges.join(self._graves(gone), ["sid", "range"], "left"), "index-ranges")
        sought = self.spark.createDataFrame([(t,) for t in few["term"].unique()], "term string")
        buckets = F.array(*[F.struct(F.lit(s.sid).alias("sid"), F.lit(s.buckets).alias("buckets")) for s in segments])
        sought = sought.withColumn("p", F.explode(buckets)).select("p.sid", bucket_of(F.col("p.buckets")).alias("bucket"), "term")
        blocks = (self._all(segments, "blocks").select("sid", "bucket", "term", "range", "docs")
                  .join(F.broadcast(sought), ["sid", "bucket", "term"], "left_semi")
                  .join(sent(ranges), ["sid", "range"]).withColumn("docs", self._living()))
        return blocks_topk(blocks.select(
            F.xxhash64("sid", "range").alias("group"), "term", F.col("docs.doc_id").alias("doc_ids"), F.col("docs.len").alias("lens"),
            F.col("docs.tf").alias("tfs")), few, parts.schema["query_id"].dataType.simpleString(), self.mean_length(segments), k, k1, b)

    def _scored(self, segments: list, parts: DataFrame, reads: DataFrame, k1: float, b: float) -> DataFrame:
        """Scores of all live documents of the ranges, each with all of its query's terms."""
        wanted = parts.join(reads, ["query_id", "sid", "range"], "left_semi").select("query_id", "sid", "bucket", "term", "range", "w")
        blocks = self._all(segments, "blocks").select("sid", "bucket", "term", "range", "docs").join(
            wanted.select("sid", "bucket", "term", "range").distinct(), ["sid", "bucket", "term", "range"])
        rows = self._without_dead(blocks, segments).join(wanted, ["sid", "bucket", "term", "range"]).select(
            "query_id", "w", F.explode("docs").alias("d"))
        part = F.col("w") * saturation(F.col("d.tf"), F.col("d.len"), F.lit(self.mean_length(segments)), k1, b)
        return rows.groupBy("query_id", F.col("d.doc_id").alias("doc_id")).agg(F.round(F.sum(part), 6).alias("score"))


def bucket_of(buckets: Column) -> Column:
    return F.pmod(F.xxhash64("term"), buckets).cast("int")
