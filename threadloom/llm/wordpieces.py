"""Token counts and ids of the word BPE vocabulary, with a shortcut for whole tokens.

Offline, every vocabulary string that closes a word is given to the tokenizer by itself; those that
come back as that one id are proven whole tokens. A text is split into pre-tokens; a pre-token that
is a proven whole token counts at once, and only the rest goes through the merges of the library.

White space parts words for the vocabulary's rules as well, so each word is looked at by itself. For words of ASCII
and accented Latin letters the normaliser only lowers letters; a word with any other character is given to the
library, so that its own rules hold, and so is a whole text with a special token's string or a separator control
character (which does not part words there) in it.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.bpe import PairTable, merge_all
from threadloom.llm.common import Memo, byte_lengths, lean, slices

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
WORD_END = "</w>"

# The pre-token pattern of the vocabulary, for the characters of PLAIN in lower case.
PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
PART = re.compile(PRE_TOKEN.pattern + "|\n")  # of many words, one a line
PLAIN = bytes([*range(0x09, 0x0E), *range(0x20, 0x7F), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])

CONTROL = re.compile("[\x1c-\x1f]")

# Texts are taken together up to this many bytes, so that words are merged many at a time.
GROUP_BYTES = 1 << 21


@lru_cache(maxsize=4)
def library(path: str = VOCABULARY):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def special_strings(path: str = VOCABULARY) -> tuple[str, ...]:
    return tuple(t.content for t in library(path).get_added_tokens_decoder().values())


def encode(texts: list[str], path: str = VOCABULARY) -> list[list[int]]:
    return [e.ids for e in library(path).encode_batch_fast(texts, add_special_tokens=False)]


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: itself if printable, else the next free one from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def plain(text: str) -> bool:
    """Only characters of PLAIN, in which white space is what splits words."""
    if text.isascii() and text.isprintable():
        return True
    try:
        return not text.encode("latin-1").translate(None, PLAIN)
    except UnicodeEncodeError:
        return False


@lru_cache(maxsize=4)
def whole_tokens(path: str = VOCABULARY) -> dict[str, int]:
    """Pre-tokens proven to encode alone as one token, with its id."""
    letters, words = byte_letters(), {}
    for piece, number in library(path).get_vocab(with_added_tokens=False).items():
        if piece.endswith(WORD_END):
            try:
                word = bytes(letters[c] for c in piece[: -len(WORD_END)]).decode("utf-8")
            except (KeyError, UnicodeDecodeError):
                continue
            if word == word.lower() and PRE_TOKEN.fullmatch(word) and plain(word):
                words[word] = number
    proofs = encode(list(words), path)
    return {w: n for (w, n), ids in zip(words.items(), proofs) if ids == [n]}


class Rules(NamedTuple):
    """What the vocabulary says of bytes, pairs and whole tokens; read once per worker."""

    table: PairTable
    inner: np.ndarray
    last: np.ndarray
    whole: dict[str, int]


@lru_cache(maxsize=4)
def rules(path: str = VOCABULARY) -> Rules:
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocab = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    number = lambda names: np.array([vocab[n] for n in names], np.int32)
    table = PairTable(number(a for a, _ in pairs), number(b for _, b in pairs),
                      np.arange(len(pairs), dtype=np.int32), number(a + b for a, b in pairs))
    letter = {b: c for c, b in byte_letters().items()}
    return Rules(table, number(letter[b] for b in range(256)), number(letter[b] + WORD_END for b in range(256)), whole_tokens(path))


class Pieces:
    """Ids of texts. White space parts words, and no token crosses it, so what was learned of a
    word holds in every text; a bounded number of words is kept."""

    def __init__(self, path: str = VOCABULARY, pack: bool = True):
        self.path, self.pack = path, pack
        self.table, self.inner, self.last, self.whole = rules(path)
        self.memo = Memo(self._words)

    def _merged(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.frombuffer("\n".join([*parts, ""]).encode(), np.uint8)
        inside = flat != 10  # no part has a line end
        ends = np.flatnonzero(~inside)
        lengths = np.diff(ends, prepend=-1) - 1
        symbols = self.inner[flat]
        symbols[ends - 1] = self.last[flat[ends - 1]]
        return merge_all(symbols[inside], lengths, self.table)

    def _words(self, words: list[str]) -> list:
        """Value of each word: its packed ids, or their number."""
        if not words:
            return []
        lines = "\n".join([*words, ""])
        if not plain(lines):
            odd = [w for w in words if not plain(w)]
            other = dict(zip(odd, (np.array(ids, "<u4").tobytes() if self.pack else len(ids) for ids in encode(odd, self.path))))
            rest = iter(self._words([w for w in words if w not in other]))
            return [other[w] if w in other else next(rest) for w in words]
        found = PART.findall(lines)
        number = {p: k for k, p in enumerate(dict.fromkeys(found))}
        parts = list(number)
        # a part has one id, at its own place, if it is a whole token; a line end has none; the rest is merged
        ids, first = np.array([self.whole.get(p, -1) for p in parts], np.int64), np.arange(len(parts))
        sizes, line = np.ones(len(parts), np.int64), number["\n"]
        sizes[line] = 0
        rest = np.flatnonzero((ids < 0) & (sizes > 0))
        if len(rest):
            merged, sizes[rest] = self._merged([parts[k] for k in rest.tolist()])
            first[rest] = len(parts) + np.cumsum(sizes[rest]) - sizes[rest]
            ids = np.concatenate([ids, merged])
        order = np.fromiter(map(number.__getitem__, found), np.int64, len(found))
        counts = sizes[order]
        ends = np.cumsum(counts)
        bounds = ends[order == line]
        if not self.pack:
            return np.diff(bounds, prepend=0).tolist()
        places = np.arange(ends[-1]) + np.repeat(first[order] - ends + counts, counts)
        raw = ids[places].astype("<u4").tobytes()
        return [raw[a:b] for a, b in pairwise([0, *(4 * bounds).tolist()])]

    def _split(self, text: str) -> list[str] | None:
        """Words of a text, plain ones in lower case; nothing where white space does not say what they are."""
        if plain(text):
            return text.lower().split()
        return None if CONTROL.search(text) else [w.lower() if plain(w) else w for w in text.split()]

    def of(self, texts: list[str]) -> list:
        """Per text: its ids as little-endian unsigned 32-bit numbers, or, without ``pack``, their number."""
        special = special_strings(self.path)
        words = [self._split(t) if not any(s in t for s in special) else None for t in texts]
        self.memo.learn(set().union(*[w for w in words if w is not None]))
        join = b"".join if self.pack else sum
        out = []
        for text, parts in zip(texts, words):
            if parts is not None:
                out.append(join(map(self.memo.__getitem__, parts)))
            else:  # the library's own rules
                ids = encode([text], self.path)[0]
                out.append(np.array(ids, "<u4").tobytes() if self.pack else len(ids))
        return out

    def batch(self, column: pa.Array) -> Iterator:
        """Values of a column of texts, taken in groups of bounded size; null is empty."""
        for lo, hi in slices(byte_lengths(column), GROUP_BYTES):
            yield from self.of([t or "" for t in column.slice(lo, hi - lo).to_pylist()])


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """Tokens of each text as the library counts them; 0 for a null or empty text."""
    @F.arrow_udf("long")
    @lean
    def count_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = Pieces(path, pack=False)
        for batch in batches:
            yield pa.array(pieces.batch(batch), pa.int64())

    return count_tokens(text)


def token_counts(docs: DataFrame, limit: int = 2048, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document.

    Null text: empty, 0 tokens. Repeated rows are counted each; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", "text").select(
        "doc_id", F.octet_length(text).cast("long").alias("n_bytes"),
        token_count(text, path).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
