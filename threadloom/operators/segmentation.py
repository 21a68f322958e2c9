"""Cutting long sequences of parts into chunks of bounded size, with joins only.

Where a chunk ends depends on where it began, so the parts cannot be cut by looking at each alone. But each
part knows where the next chunk would begin if one began with it: that follows from running lengths, by one
ordered look-up. The chunks are what is reached from the first part over these links, and links followed twice
as far in each round reach them all in a logarithmic number of joins. Look-ups work in buckets along the
sequence, so a long sequence is no single task.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators.ordering import previous, running_sum
from threadloom.session import cut_lineage, sent, stored

BUCKET_CHARS = 1 << 16
BUCKET_PARTS = 1 << 12
PIECES = re.compile(r"[.!?\n]*[^.!?\n]+[.!?\n]*|[.!?\n]+")
WORDS = re.compile("[a-z0-9]+")


def offsets(parts: DataFrame, key: str) -> DataFrame:
    """``parts(key, n, text, …)`` with ``lead`` and ``upto``: where a part begins and ends, parts joined by a space."""
    sized = parts.withColumn("_size", F.length("text").cast("long") + 1)
    summed = running_sum(sized, [key], [F.col("n")], F.floor(F.col("n") / BUCKET_PARTS), F.col("_size"), "upto")
    return summed.withColumn("upto", F.col("upto") - 1).withColumn("lead", F.col("upto") - F.col("_size") + 1).drop("_size")


def _asof(asks: DataFrame, events: DataFrame, key: str, reach: int, last: bool) -> DataFrame:
    """``asks(key, n, at)`` with ``found``: the ``n`` of the event with the largest ``at`` up to theirs (the least from
    theirs on, without ``last``). Events further than ``reach`` away may be missed."""
    bucket = lambda c: F.floor(c / BUCKET_CHARS).cast("long")
    shift = reach if last else -reach
    places = F.array_distinct(F.array(bucket(F.col("at")), bucket(F.col("at") + shift)))
    both = asks.select(key, "n", "at", bucket(F.col("at")).alias("b"), F.lit(1).alias("ask")).unionByName(
        events.select(key, "n", "at", F.explode(places).alias("b"), F.lit(0).alias("ask")))
    at = F.col("at") if last else -F.col("at")
    order = Window.partitionBy(key, "b").orderBy(at, "ask", "n" if last else F.desc("n")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("found", F.last(F.when(F.col("ask") == 0, F.col("n")), True).over(order))
    return seen.filter("ask = 1").select(key, "n", "found")


def followed(links: DataFrame, key: str, steps: int) -> DataFrame:
    """``key, n`` of what is reached from each key's first ``n`` over ``links(key, n, next)``, in at most ``steps`` steps."""
    links = cut_lineage(links)
    reached = links.groupBy(key).agg(F.min("n").alias("n"))
    for _ in range(max(1, steps.bit_length())):
        ahead = reached.join(links, [key, "n"]).filter("next IS NOT NULL").select(key, F.col("next").alias("n"))
        reached = cut_lineage(reached.unionByName(ahead).distinct())
        onward = links.select(key, F.col("n").alias("next"), F.col("next").alias("after"))
        links = cut_lineage(links.filter("next IS NOT NULL").join(onward, [key, "next"], "left").select(
            key, "n", F.col("after").alias("next")))
    return reached


def packed(parts: DataFrame, key: str, most: int, least: int = 0, breaks: Column | None = None) -> DataFrame:
    """``parts(key, n, text, …)`` with ``chunk_no``, from 0: a chunk takes parts as long as it stays within ``most``
    characters, a longer part stands alone. With ``breaks`` a part for which it holds also begins a chunk, if the chunk
    before has ``least`` characters by then."""
    rows = cut_lineage(offsets(parts, key))
    ends = rows.select(key, "n", F.col("upto").alias("at"))
    fits = _asof(rows.select(key, "n", (F.col("lead") + most).alias("at")), ends, key, most + 1, True)
    links = fits.select(key, "n", (F.greatest(F.coalesce("found", F.col("n")), F.col("n")) + 1).alias("next"))
    if breaks is not None:
        begins = rows.filter(breaks).select(key, "n", (F.col("lead") - 1).alias("at"))
        alike = _asof(rows.select(key, "n", (F.col("lead") + least).alias("at")), begins, key, most + 1, False)
        links = links.join(alike, [key, "n"]).select(key, "n", F.least("next", F.when(F.col("found") > F.col("n"), F.col("found"))).alias("next"))
    final = rows.groupBy(key).agg(F.max("n").alias("final"), F.max("upto").alias("chars"))
    chars, count = final.agg(F.max("chars"), F.max("final")).first()
    # two chunks in a row hold more than ``most`` or ``least`` characters
    steps = min(int(count or 0) + 1, 2 * int(chars or 0) // max(1, min(most, least or most)) + 2)
    links = links.join(final.select(key, "final"), key).select(key, "n", F.when(F.col("next") <= F.col("final"), F.col("next")).alias("next"))
    starts = followed(links, key, steps).withColumn("_start", F.lit(1))
    flagged = rows.join(starts, [key, "n"], "left").withColumn("_start", F.coalesce("_start", F.lit(0)))
    numbered = running_sum(flagged, [key], [F.col("n")], F.floor(F.col("n") / BUCKET_PARTS), F.col("_start"), "chunk_no")
    return numbered.withColumn("chunk_no", (F.col("chunk_no") - 1).cast("int")).drop("_start", "lead", "upto")


def joined_text() -> Column:
    """Text of a chunk, to aggregate rows ``n, text`` with."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "text"))), lambda p: p["text"]), " ")


def split_parts(df: DataFrame, key: str, order: list[str], parts: Column, keep: list[str]) -> DataFrame:
    """A row per element of the array ``parts`` with ``n``, its place in the whole sequence of its key."""
    exploded = df.select(key, *order, *keep, F.posexplode(parts).alias("_part", "text"))
    counts = df.select(key, *order, F.size(parts).cast("long").alias("_count"))
    before = running_sum(counts, [key], [F.col(c) for c in order], F.floor(F.col(order[0]) / BUCKET_PARTS), F.col("_count"), "_upto")
    before = before.select(key, *order, (F.col("_upto") - F.col("_count")).alias("_before"))
    return exploded.join(before, [key, *order]).withColumn("n", F.col("_before") + F.col("_part")).drop("_before", "_part")


SPACE = r"[\s\x1c-\x1f]"


def sentence_parts(text: Column) -> Column:
    """Sentences of a text: parted at white space after a full stop, question or exclamation mark."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?U)^{SPACE}+|{SPACE}+$", "")
    return F.filter(F.split(trimmed, rf"(?U)(?<=[.!?]){SPACE}+"), lambda s: s != "")


def sentence_chunks(cues: DataFrame, least: int = 300, most: int = 500) -> DataFrame:
    """Cues ``video_id, pos, start_time, text`` packed into blocks of whole sentences, up to ``most`` characters; a
    last block below ``least`` joins the one before. The first block begins with the first cue."""
    parts = split_parts(cues, "video_id", ["pos"], sentence_parts(F.col("text")), ["start_time"])
    rows = packed(parts, "video_id", most)
    blocks = rows.groupBy("video_id", "chunk_no").agg(joined_text().alias("text"), F.min("n").alias("n"))
    tail = blocks.groupBy("video_id").agg(F.max("chunk_no").alias("final"), F.max_by(F.length("text"), "chunk_no").alias("size"))
    place = F.when((F.col("chunk_no") == F.col("final")) & (F.col("final") > 0) & (F.col("size") < least), F.col("final") - 1)
    merged = blocks.join(tail, "video_id").withColumn("i", F.coalesce(place, F.col("chunk_no")))
    merged = merged.groupBy("video_id", "i").agg(joined_text().alias("text"), F.min("n").alias("n"))
    first = cues.groupBy("video_id").agg(F.min_by("start_time", "pos").alias("first_time"))
    times = rows.select("video_id", "n", "start_time")
    return merged.join(times, ["video_id", "n"]).join(first, "video_id").select(
        "video_id", "i", F.when(F.col("i") == 0, F.col("first_time")).otherwise(F.col("start_time")).alias("start_time"), "text")


def word_overlap(a: Column, b: Column) -> Column:
    """Cosine of two sets of words; null where one is empty."""
    product = F.size(a).cast("double") * F.size(b)
    return F.when(product > 0, F.size(F.array_intersect(a, b)) / F.sqrt(F.greatest(product, F.lit(1.0))))


def semantic_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: float = 0.7, least: int = 100,
                    most: int = 1000) -> DataFrame:
    """``key, chunk_no, chunk``: a text's sentences in chunks of ``least`` to ``most`` characters. A sentence that is less
    like the one before than ``limit`` begins a chunk as soon as the open one has ``least`` characters; any does when it
    would take the open one over ``most``. Likeness is the cosine of the sentences' sets of words. Sentences over
    ``most`` are cut; a text's last chunk may be shorter. A key's only text is cut in the task that reads it; rows that
    share a key, or have none, are taken as one sequence by joins."""
    docs = docs.select(key, text)
    shared = stored(docs.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).filter((F.col("_rows") > 1) | F.col(key).isNull()).select(key), "shared-keys")
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, chunk_no int, chunk string"

    def cut_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [chunked(t or "", limit, least, most) for t in batch.column(1).to_pylist()]
            rows = pa.array([row for row, chunks in enumerate(cut) for _ in chunks], type=pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), pa.array([n for chunks in cut for n in range(len(chunks))], type=pa.int32()),
                 pa.array([c for chunks in cut for c in chunks], type=pa.string())], [key, "chunk_no", "chunk"])

    if shared.isEmpty():
        return docs.mapInArrow(cut_alone, schema)
    mark, same = sent(shared.withColumnRenamed(key, "_key")), F.col(key).eqNullSafe(F.col("_key"))
    alone = docs.join(mark, same, "left_anti").mapInArrow(cut_alone, schema)
    return alone.unionByName(_chunks_by_joins(docs.join(mark, same, "left_semi"), key, text, limit, least, most))


def chunked(text: str, limit: float, least: int, most: int) -> list[str]:
    """The chunks of one text."""
    clean = [p for p in (p.strip(" \t\n\r") for p in PIECES.findall(text)) if p]
    parts = [p[k:k + most] for p in clean for k in range(0, len(p), most)]
    chunks, size, before = [], 0, set()
    for part in parts:
        words = set(WORDS.findall(part.lower()))
        product = len(before) * len(words)
        unlike = product == 0 or len(before & words) / math.sqrt(product) < limit
        if not chunks or size + 1 + len(part) > most or (unlike and size >= least):
            chunks.append([part])
            size = len(part)
        else:
            chunks[-1].append(part)
            size += 1 + len(part)
        before = words
    return [" ".join(c) for c in chunks]


def _chunks_by_joins(docs: DataFrame, key: str, text: str, limit: float, least: int, most: int) -> DataFrame:
    pieces = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"[.!?\n]*[^.!?\n]+[.!?\n]*|[.!?\n]+"), F.lit(0))
    clean = F.filter(F.transform(pieces, lambda p: F.btrim(p, F.lit(" \t\n\r"))), lambda p: p != "")
    cut = F.flatten(F.transform(clean, lambda p: F.transform(
        F.sequence(F.lit(0), F.floor((F.length(p) - 1) / most).cast("int")), lambda k: F.substring(p, k * most + 1, F.lit(most)))))
    parts = docs.select(key, F.posexplode(cut).alias("n", "text")).withColumn("n", F.col("n").cast("long"))
    worded = parts.withColumn("_words", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))))
    seen = previous(worded, [key], F.col("n"), F.floor(F.col("n") / BUCKET_PARTS), {"_before": "_words"})
    unlike = F.coalesce(word_overlap(F.col("_before"), F.col("_words")), F.lit(0.0)) < limit
    rows = packed(seen.withColumn("_unlike", unlike & (F.col("n") > 0)).drop("_words", "_before"), key, most, least, F.col("_unlike"))
    return rows.groupBy(key, "chunk_no").agg(joined_text().alias("chunk"))
