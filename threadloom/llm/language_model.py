"""Language-model scores by a weighted backoff automaton of smoothed word pairs.

States are histories: the empty one, and one per word seen in training (the start of a text is the
state of the end token before it). A pair seen in training is an arc from its first word's state,
weighted with its smoothed log-probability, to its second word's state. Every state has a failure
arc to the empty state; its weight is what smoothing leaves for words not seen there. The empty
state has an arc for every known word and one for all unknown words together:

    P(w)     = c(w) / (N + V + 1), unknown words together (V + 1) / (N + V + 1)
    P(w | h) = (c(h w) + MU * P(w)) / (c(h) + MU), so the failure arc weighs MU / (c(h) + MU)

The automaton grows with the corpus, so it is never in one place. Documents are dealt into blocks of
bounded text by a hash. A block asks for the counts of the distinct words and pairs it holds, and
gives its own training counts along; the requests are dealt by key, summed, and answered in the
order in which they were asked. With the answers a block builds the part of the automaton its texts
can reach and runs through each text once from left to right. Words are told apart by 64-bit hashes.

Defined results: a null or empty text is the end token alone; without training rows every word is
unknown and has probability 1; repeated rows count as often as they stand in the table.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import held_out, utf8

FOLDS = 10
MU = 100.0
ALPHA = 0.1
BLOCK_BYTES = 8 << 20
BUCKET_KEYS = 2_000_000
WORD_BYTES = 6  # of text per token, to guess the number of keys
END = 0
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))

REQUEST = "block long, kind int, bucket long, keys binary, counts binary"
REPLY = "block long, kind int, bucket long, counts binary, n long, v long"
SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
          "base_score double, score double")


class Block:
    """Words and pairs of the texts of one block."""

    def __init__(self, rows: pa.Table):
        words: dict[bytes, int] = defaultdict()
        words.default_factory = words.__len__
        words[b" "]  # the end token; no word holds a space  # noqa: B018
        parts = []
        for text in utf8(rows.column("text").combine_chunks()):
            found = text.lower().split()
            ids = np.empty(len(found) + 1, np.int32)
            ids[:-1] = np.fromiter(map(words.__getitem__, found), np.int32, len(found))
            ids[-1] = END
            parts.append(ids)
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.tokens = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        self.train = np.repeat(~rows.column("held_out").to_numpy(), self.lengths)
        hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.starts] = END
        self.before = before
        pair = (hashes[before] * MIX[0]) ^ ((hashes[self.tokens] + MIX[1]) * MIX[1])
        pair = (pair ^ (pair >> np.uint64(31))) * MIX[0]
        order = np.argsort(hashes, kind="stable")  # keys are asked for in order
        self.word_keys, place = hashes[order], np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.word_at = place[self.tokens]
        self.before_at = place[before]
        self.pair_keys, self.pair_at = np.unique(pair, return_inverse=True)

    def keys(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct keys, and at each token the place of its key."""
        return (self.word_keys, self.word_at) if kind == 1 else (self.pair_keys, self.pair_at)


def packed(counts: np.ndarray) -> bytes:
    """A byte per count; those of 255 and more follow in full, in order."""
    counts = counts.astype(np.int64)
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<i8").tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(data, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<i8", offset=n)
    return counts


def cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where the buckets, by the upper bits of sorted keys, begin and end."""
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.r_[np.searchsorted(keys, edges, "left"), len(keys)]


def ask(bits: int):
    """Requests of a block: per bucket its keys and how often its training texts hold them."""
    def request(rows: pa.Table) -> pa.Table:
        name, block, out = rows.column("block")[0].as_py(), Block(rows), []
        for kind in (1, 2):
            keys, at = block.keys(kind)
            counts = np.bincount(at[block.train], minlength=len(keys))
            edge = cuts(keys, bits)
            for bucket in np.flatnonzero(np.diff(edge)).tolist():
                lo, hi = edge[bucket], edge[bucket + 1]
                out.append((name, kind, bucket, keys[lo:hi].tobytes(), packed(counts[lo:hi])))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                        names=[f.split()[0] for f in REQUEST.split(", ")])

    return request


def tally(rows: pa.Table) -> pa.Table:
    """Answers of a bucket: the whole corpus's count of each key, per asking block in its order; and,
    for words, under block -1 the bucket's part of N and V."""
    kind, bucket = rows.column("kind")[0].as_py(), rows.column("bucket")[0].as_py()
    asked = [np.frombuffer(k, np.uint64) for k in rows.column("keys").to_pylist()]
    keys = np.concatenate(asked)
    counts = np.concatenate([unpacked(c, len(a)) for c, a in zip(rows.column("counts").to_pylist(), asked)])
    order = np.argsort(keys, kind="stable")
    new = np.r_[True, keys[order][1:] != keys[order][:-1]]
    sums = np.add.reduceat(counts[order], np.flatnonzero(new))
    totals = np.empty(len(keys), np.int64)
    totals[order] = sums[np.cumsum(new) - 1]
    ends = np.cumsum([len(a) for a in asked])
    out = [(b, kind, bucket, packed(t), 0, 0)
           for b, t in zip(rows.column("block").to_pylist(), np.split(totals, ends[:-1]))]
    if kind == 1:
        out.append((-1, kind, bucket, b"", int(sums.sum()), int((sums > 0).sum())))
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[f.split()[0] for f in REPLY.split(", ")])


def sums_of(batches):
    """The rows of block -1 alone."""
    for batch in batches:
        yield batch.filter(pa.compute.equal(batch.column("block"), -1)).select(["n", "v"])


class Automaton:
    """The part of the automaton that a block's texts reach."""

    def __init__(self, block: Block, words: np.ndarray, pairs: np.ndarray, n: int, v: int, mu: float):
        self.block, self.words, self.pairs = block, words, pairs
        root = np.where(words > 0, words, v + 1) / (n + v + 1)  # arcs of the empty state
        self.root = np.log10(root)
        self.failure = np.log10(mu / (words + mu))  # of each word's state
        first = np.zeros(len(pairs), np.int64)
        first[block.pair_at] = np.arange(len(block.pair_at))
        self.arc = np.log10((pairs + mu * root[block.word_at[first]]) / (words[block.before_at[first]] + mu))

    def weights(self) -> np.ndarray:
        """Log-probability at each token. The state before it is the one of the token before; where that
        state has no arc for the token, the failure arc leads to the empty state, which has one."""
        b = self.block
        known = self.pairs[b.pair_at] > 0
        return np.where(known, self.arc[b.pair_at], self.failure[b.before_at] + self.root[b.word_at])


def score(mu: float):
    """Scores of a block's documents with the answers to its requests."""
    def scored(rows: pa.Table, replies: pa.Table) -> pa.Table:
        names = [f.split()[0] for f in SCORES.split(", ")]
        if not len(rows):
            return pa.table({k: pa.array([], t) for k, t in zip(names, (
                pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))})
        block, counts = Block(rows), {}
        n, v = replies.column("all_n")[0].as_py(), replies.column("all_v")[0].as_py()
        for kind in (1, 2):
            mine = replies.filter(pa.compute.equal(replies.column("kind"), kind)).sort_by("bucket")
            counts[kind] = np.concatenate([
                unpacked(c, m) for c, m in
                zip(mine.column("counts").to_pylist(), bucket_sizes(block.keys(kind)[0], mine))]).astype(float)
        words = counts[1][block.word_at]
        base = np.log10((words + ALPHA) / (n + ALPHA * (v + 1)))
        weights = Automaton(block, counts[1], counts[2], n, v, mu).weights()
        add = lambda x: np.add.reduceat(x, block.starts)
        return pa.table([
            rows.column("doc_id"), rows.column("held_out"), pa.array(block.lengths),
            pa.array(add((words > 0).astype(np.int64))), pa.array(np.full(len(rows), n, np.int64)),
            pa.array(add(base)), pa.array(add(weights))], names=names)

    return scored


def bucket_sizes(keys: np.ndarray, replies: pa.Table) -> list[int]:
    """Keys of this block in each bucket that answered."""
    bits = replies.column("bits")[0].as_py()
    return np.diff(cuts(keys, bits))[replies.column("bucket").to_numpy()].tolist()


def scores(docs: DataFrame, mu: float = MU, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    size = docs.select(F.coalesce(F.sum(F.octet_length("text") + WORD_BYTES), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, math.ceil(size / block_bytes))
    bits = max(1, math.ceil(math.log2(max(2, size / WORD_BYTES / BUCKET_KEYS))))
    dealt = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
        held_out(F.col("doc_id"), FOLDS).alias("held_out"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"),
    ).repartition(blocks, "block")
    replies = (dealt.groupBy("block").applyInArrow(ask(bits), REQUEST)
               .groupBy("kind", "bucket").applyInArrow(tally, REPLY).repartition(blocks, "block"))
    # one row; both uses of ``replies`` read the same shuffle
    total = replies.mapInArrow(sums_of, "n long, v long").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v"))
    answers = replies.select("*", total.select("n").scalar().alias("all_n"), total.select("v").scalar().alias("all_v"),
                             F.lit(bits).alias("bits"))
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score(mu), SCORES)
