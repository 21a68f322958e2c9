"""Byte-level BPE: texts to ids by a file of ranks, and ids back to bytes.

Each match of the split pattern is merged by itself. Matches not seen lately are put into padded
numpy matrices by length, where every row merges its leftmost pair of least rank in each round
(:mod:`threadloom.llm.bpe`); pair ranks come from a hash table. A match that is itself a token is
that token, as in the library of that file format.

Defined results: a null or empty text has no ids; repeated rows are encoded each; an empty table
gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.bpe import PairTable, merge_all
from threadloom.llm.common import Memo, byte_lengths, slices
from threadloom.llm.wordpieces import GROUP_BYTES, plain

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

# Fixed value: the split pattern for texts of ASCII and accented Latin letters, where it needs no
# character properties.
PLAIN_PATTERN = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+")


@lru_cache(maxsize=1)
def any_pattern():
    """The split pattern for all texts. White space is the Unicode property, which leaves out the
    separators U+001C to U+001F that the pattern module's own class has."""
    import regex

    return regex.compile(public_tokenizers.PATTERN.replace(r"[^\s\p", r"[^\p{White_Space}\p")
                         .replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


@lru_cache(maxsize=2)
def ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class ByteBpe:
    def __init__(self, path: str = RANKS):
        self.ranks = ranks(path)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        pairs = [(self.ranks[token[:k]], self.ranks[token[k:]], rank)
                 for token, rank in self.ranks.items() for k in range(1, len(token))
                 if token[:k] in self.ranks and token[k:] in self.ranks]
        left, right, rank = (np.array(c, np.int32) for c in zip(*pairs))
        self.table = PairTable(left, right, rank, rank)
        self.first = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.memo = Memo(self._parts)

    def _parts(self, parts: list[str]) -> list[bytes]:
        raw = [p.encode("utf-8") for p in parts]
        known = [self.ranks.get(p) for p in raw]
        rest = [p for p, rank in zip(raw, known) if rank is None]
        merged = iter(())
        if rest:
            lengths = np.fromiter(map(len, rest), np.int64, len(rest))
            ids, sizes = merge_all(self.first[np.frombuffer(b"".join(rest), np.uint8)], lengths, self.table)
            flat, ends = ids.astype("<i4").tobytes(), np.cumsum(sizes) * 4
            merged = (flat[e - 4 * n : e] for e, n in zip(ends.tolist(), sizes.tolist()))
        return [next(merged) if rank is None else rank.to_bytes(4, "little") for rank in known]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        split = [(PLAIN_PATTERN if plain(t) else any_pattern()).findall(t) for t in texts]
        self.memo.learn(set().union(*split))
        return [b"".join(map(self.memo.__getitem__, parts)) for parts in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<i4").tolist()))


def round_trip(text: Column, path: str = RANKS) -> Column:
    """Struct of ``ids`` and of ``decoded``, the bytes that these ids stand for."""
    @F.arrow_udf("struct<ids: array<int>, decoded: binary>")
    def encode_and_decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = ByteBpe(path)
        for batch in batches:
            packed: list[bytes] = []
            for lo, hi in slices(byte_lengths(batch), GROUP_BYTES):
                packed.extend(bpe.encode([t or "" for t in batch.slice(lo, hi - lo).to_pylist()]))
            offsets = np.zeros(len(packed) + 1, np.int32)
            np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))
            decoded = pa.array(map(bpe.decode, packed), pa.binary())
            yield pa.StructArray.from_arrays([ids, decoded], names=["ids", "decoded"])

    return encode_and_decode(text)


def decode(ids: Column, path: str = RANKS) -> Column:
    """Bytes that an array of ids stands for; null ids give no bytes."""
    @F.arrow_udf("binary")
    def decode_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = ByteBpe(path)
        for batch in batches:
            yield pa.array((b"".join(bpe.tokens[i] for i in row.as_py() or []) for row in batch), pa.binary())

    return decode_ids(ids)


def encoded(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id, ids and decoded of every document."""
    return docs.select("doc_id", round_trip(F.col("text"), path).alias("both")).select("doc_id", "both.*")
