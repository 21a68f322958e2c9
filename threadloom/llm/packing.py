"""Hierarchical packing of token ids into sequences of several context sizes.

A document is routed by its length to the smallest tier (a power of two up to the window) that
holds it; one longer than the window first gives whole windows. Tiers are packed from the longest
down: each window takes a document of its own tier, then the longest document of shorter tiers that
fits its gap, again and again, and at last a piece cut from a shorter document fills what is left.
What remains when the documents of a shard run out is cut at powers of two, which need no padding.
Sequences are then dealt to step groups so that each group trains on about as many tokens.

A shard is what one task reads in a row, up to SHARD_TOKENS; nothing is shuffled. Shards do not
depend on each other, so a lost task is simply run again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from threadloom.llm.common import lean
from threadloom.llm.wordpieces import VOCABULARY, Pieces

WINDOW = 4096
SMALLEST_TIER = 256
SHARD_TOKENS = 2_000_000
STEP_TOKENS = 64 * WINDOW
END_ID = 2

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, tier int, step_group long")


class Pool:
    """Unpacked pieces by length, with the longest one up to any length at hand.

    One bit per length says whether there are pieces, so the search is a bit scan.
    """

    def __init__(self):
        self.held: dict[int, list[tuple[int, int]]] = {}
        self.bits = 0

    def put(self, length: int, doc: int, start: int) -> None:
        if length > 0:
            self.held.setdefault(length, []).append((doc, start))
            self.bits |= 1 << length

    def take(self, most: int) -> tuple[int, int, int] | None:
        """(length, doc, start) of a longest piece of at most ``most`` ids."""
        length = (self.bits & ((1 << (most + 1)) - 1)).bit_length() - 1
        if length < 1:
            return None
        doc, start = self.held[length].pop()
        if not self.held[length]:
            self.bits ^= 1 << length
        return length, doc, start


def tiers(window: int = WINDOW, smallest: int = SMALLEST_TIER) -> list[int]:
    sizes = []
    while window >= smallest:
        sizes.append(window)
        window //= 2
    return sizes


def pack(lengths: list[int], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length). Every id is in exactly one piece; no sequence is padded:
    each has a length that is a power of two."""
    pool, sequences = Pool(), []
    for doc, total in enumerate(lengths):
        whole = total - total % window
        sequences.extend([(doc, at, window)] for at in range(0, whole, window))
        pool.put(total - whole, doc, whole)
    sizes = tiers(window)
    for tier in sizes:
        floor = tier // 2 if tier != sizes[-1] else 0
        while pool.bits.bit_length() - 1 > floor:  # a document of this tier is left
            gap, sequence = tier, []
            while gap and (piece := pool.take(gap)):
                length, doc, start = piece
                sequence.append((doc, start, length))
                gap -= length
            if gap and (piece := pool.take(window)):  # every other one is longer: cut
                length, doc, start = piece
                sequence.append((doc, start, gap))
                pool.put(length - gap, doc, start + gap)
                gap = 0
            if not gap:
                sequences.append(sequence)
                continue
            sequences.extend(cut_at_powers(sequence))  # the documents have run out
    return sequences


def cut_at_powers(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """The pieces, in order, as sequences whose lengths are the powers of two that make up their total."""
    left = sum(length for _, _, length in pieces)
    queue = list(reversed(pieces))
    while left:
        size = 1 << (left.bit_length() - 1)
        left -= size
        sequence = []
        while size:
            doc, start, length = queue.pop()
            part = min(size, length)
            sequence.append((doc, start, part))
            size -= part
            if part < length:
                queue.append((doc, start + part, length - part))
        yield sequence


def step_groups(sizes: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """Group of each sequence: longest first, dealt there and back over the groups, so that the
    groups' totals differ by less than a window or so."""
    n = max(1, round(sum(sizes) / step_tokens))
    groups = [0] * len(sizes)
    for k, at in enumerate(sorted(range(len(sizes)), key=lambda i: -sizes[i])):
        turn, place = divmod(k, n)
        groups[at] = place if turn % 2 == 0 else n - 1 - place
    return groups


def packed(docs: DataFrame, window: int = WINDOW, path: str = VOCABULARY) -> DataFrame:
    """One row per piece of the documents ``(doc_id, text)``.

    Null or empty text: the end id alone. A null doc_id stays null. Repeated rows are packed each.
    ``sequence_id`` holds the task in its upper bits and counts within it.
    """
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, task = Pieces(path), TaskContext.get().partitionId()
        number = group = 0

        def shard(names: list, ids: list[bytes]) -> pa.RecordBatch:
            nonlocal number, group
            sequences = pack([len(x) // 4 for x in ids], window)
            groups = step_groups([sum(p[2] for p in s) for s in sequences])
            rows: list[tuple] = []
            for sequence, step in zip(sequences, groups):
                size = sum(p[2] for p in sequence)
                offset = 0
                for doc, start, length in sequence:
                    part = memoryview(ids[doc])[4 * start : 4 * (start + length)]
                    rows.append((names[doc], start, length, zlib.crc32(part), len(ids[doc]) // 4,
                                 task << 40 | number, offset, size, task << 40 | group + step))
                    offset += length
                number += 1
            group += max(groups, default=-1) + 1
            columns = zip(*rows) if rows else [[]] * 9
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), pa.int32() if k == 7 else pa.int64()) for k, c in enumerate(columns)],
                names=[f.split()[0] for f in SCHEMA.split(", ")])

        end = END_ID.to_bytes(4, "little")
        names, ids, held = [], [], 0
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), pieces.batch(batch.column(1))):
                names.append(name)
                ids.append(value + end)
                held += len(value) // 4 + 1
                if held >= SHARD_TOKENS:
                    yield shard(names, ids)
                    names, ids, held = [], [], 0
        if names:
            yield shard(names, ids)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
