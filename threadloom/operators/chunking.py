"""Cutting texts and transcripts into chunks."""

from __future__ import annotations

from collections.abc import Iterator
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import word_count
from threadloom.operators.ordering import running_sum
from threadloom.operators.segmentation import sentence_chunks as sentences  # noqa: F401

# Separators of the recursive splitter, coarse to fine.
SEPARATORS = ("\n\n", "\n", " ", "")


def _pieces(text: str, size: int, level: int = 0) -> Iterator[list[str]]:
    """Runs of pieces shorter than ``size``; a separator stays in front of its piece."""
    while level < len(SEPARATORS) - 1 and SEPARATORS[level] not in text:
        level += 1
    sep = SEPARATORS[level]
    if sep:
        head, *tail = text.split(sep)
        parts = [p for p in [head, *(sep + t for t in tail)] if p]
    else:
        parts = list(text)
    run: list[str] = []
    for part in parts:
        if len(part) < size:
            run.append(part)
            continue
        if run:
            yield run
            run = []
        if sep:
            yield from _pieces(part, size, level + 1)
        else:
            yield [part]
    if run:
        yield run


def _packed(run: list[str], size: int, overlap: int) -> Iterator[str]:
    """Pieces joined up to ``size``; each chunk starts with the tail of the one before."""
    first, total = 0, 0
    for at, piece in enumerate(run):
        if total + len(piece) > size and at > first:
            yield "".join(run[first:at])
            while total > overlap or (total + len(piece) > size and total > 0):
                total -= len(run[first])
                first += 1
        total += len(piece)
    if first < len(run):
        yield "".join(run[first:])


def split_text(text: str, size: int, overlap: int) -> list[tuple[int, str]]:
    """(start, chunk) of one text. The start is that of the stripped chunk."""
    found, at, length = [], 0, 0
    for run in _pieces(text, size):
        for raw in _packed(run, size, overlap):
            chunk = raw.strip()
            if chunk:
                at = text.find(chunk, max(0, at + length - overlap))
                length = len(chunk)
                found.append((at, chunk))
    return found


def recursive(df: DataFrame, key: str, text: str = "text", size: int | str = 1000,
              overlap: int = 200) -> DataFrame:
    """Recursive split by paragraphs, lines, words and characters.

    ``size`` may name a column. Gives ``key, chunk_no, start_index, chunk``.
    """
    sizes = F.col(size) if isinstance(size, str) else F.lit(size)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, no, at, chunk)
                    for k, body, n in zip(batch["key"], batch["text"], batch["size"])
                    for no, (at, chunk) in enumerate(split_text(body or "", int(n), min(overlap, int(n) - 1)))]
            yield pd.DataFrame(rows, columns=["key", "chunk_no", "start_index", "chunk"])

    kind = df.schema[key].dataType.simpleString()
    return (
        df.select(F.col(key).alias("key"), F.col(text).alias("text"), sizes.alias("size"))
        .mapInPandas(cut, f"key {kind}, chunk_no int, start_index int, chunk string")
        .withColumnRenamed("key", key))


def fixed_stride(df: DataFrame, key: str, text: str = "text", size: int = 1000,
                 overlap: int = 200, keep: tuple[str, ...] = ()) -> DataFrame:
    """Windows of ``size`` characters every ``size - overlap``; the last one ends the text."""
    step = size - overlap
    length = F.length(text)
    last = F.greatest(F.ceil((length - overlap) / step) - 1, F.lit(0)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
        i.alias("chunk_no"), (i * step).alias("start_index"),
        F.substring(F.col(text), i * step + 1, F.lit(size)).alias("chunk")))
    return df.filter(length > 0).select(key, *keep, F.inline(pieces))


def window_size(text: Column, base: int = 512, factor: float = 1.5, least: int = 100,
                most: int = 1000) -> Column:
    """Chunk size for a text: larger where its words are long."""
    mean = F.length(text) / F.greatest(word_count(text), F.lit(1))
    return F.least(F.greatest(F.when(mean > 6.0, F.lit(int(base * factor))).otherwise(base), F.lit(least)),
                   F.lit(most)).cast("int")


def cues(df: DataFrame, size: int = 900, overlap: int = 200) -> DataFrame:
    """Transcript cues ``video_id, pos, start_time, end_time, text`` to overlapping chunks.

    With running lengths, a chunk starts at the first cue and again wherever more than
    ``size - overlap`` characters lie since the last start. It ends with the first cue that takes it
    over ``size``, but after the end of the chunk before; the first that none takes over ends with the
    last cue and closes the list.
    A transcript is bounded by the length of its video, so one is one row.
    """
    sized = running_sum(df.withColumn("_n", F.length("text")), ["video_id"], [F.col("pos")],
                        F.floor(F.col("pos") / 1000), F.col("_n"), "_upto")
    rows = sized.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct(
        "pos", (F.col("_upto") - F.col("_n")).alias("lead"), F.col("_upto").alias("upto"),
        "start_time", "end_time", "text"))).alias("c"))
    last = F.size("c") - 1
    cue = lambda i: F.get("c", i)
    place = F.transform("c", lambda _, i: i)

    def started(found: Column, i: Column) -> Column:
        fresh = cue(i)["lead"] - cue(F.element_at(found, -1))["lead"] > size - overlap
        return F.when(fresh, F.array_append(found, i)).otherwise(found)

    def ended(state: Column, s: Column) -> Column:
        after = F.coalesce(F.try_element_at(state["ends"], F.lit(-1)), F.lit(-1)) + 1
        over = F.get(F.filter("at", lambda i: (i >= s) & (cue(i)["upto"] - cue(s)["lead"] > size)), 0)
        here = F.greatest(over, F.when(over.isNotNull(), after))
        open_ = here.isNull() | (here > last)  # the cues run out before the chunk is full
        return F.when(state["done"], state).otherwise(F.struct(
            F.array_append(state["ends"], F.when(open_, last).otherwise(here)).alias("ends"), open_.alias("done")))

    none = F.struct(F.array().cast("array<int>").alias("ends"), F.lit(False).alias("done"))
    whole = (
        rows.withColumn("at", place)
        .withColumn("starts", F.aggregate("at", F.array(F.lit(0)), started))
        .withColumn("ends", F.aggregate("starts", none, ended)["ends"])
    )
    return whole.select("video_id", F.posexplode(F.arrays_zip(F.slice("starts", F.lit(1), F.size("ends")), "ends")).alias("i", "w"), "c").select(
        "video_id", "i", cue(F.col("w")["0"])["start_time"].alias("start_time"), cue(F.col("w.ends"))["end_time"].alias("end_time"),
        F.array_join(F.transform(F.slice("c", F.col("w")["0"] + 1, F.col("w.ends") - F.col("w")["0"] + 1), lambda x: x["text"]), " ").alias("text"))
