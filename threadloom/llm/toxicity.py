"""Toxic spans by a linear-chain conditional random field over words, and document scores from them.

Training (on a bounded sample of labelled rows, see SAMPLE_PER_CLASS and SAMPLE_CHARS):
labels are per document, so tokens are labelled first. A small set of words, prefixes and suffixes that
explains the toxic documents is chosen by likelihood ratio, corrected for the number of candidates;
a token is labelled toxic if it carries one of them in a toxic document.
The field has two tags, clean and toxic; its weights for words, prefixes and suffixes and its
transitions are fitted by gradient steps, whose expectations come from forward-backward.

Scoring: forward-backward gives each word's marginal probability of the toxic tag. A logistic
function of the largest marginal and of the expected number of toxic words is the document's score;
runs of words over one half are the offending spans, with offsets in the text.

Defined results: a null or empty text has no words and gets the score of a document without
evidence. Labels that are neither 0 nor 1 are left out. With no toxic or no clean training row there is
nothing to learn, and every score is the share of toxic rows (0 without labels). Repeated rows are scored each.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import Memo, byte_lengths, fresh, held_out, lean, slices
from threadloom.session import cut_lineage

FOLDS = 5
# Bounds of the training sample: rows of each class, and characters of a row that is taken.
SAMPLE_PER_CLASS = 1_500
SAMPLE_CHARS = 8_000
COVER = 8
SEQUENCE = 32
SEQUENCES = 16_000
EPOCHS = 50
BLOCK = 64
GROUP_BYTES = 1 << 21

WORD = re.compile(r"\S+")
EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def features(word: str) -> list[str]:
    """Features of a lower-case word without the signs around it."""
    core = EDGES.sub("", word)
    if not core:
        return []
    return ["=" + core] + [f"{n}<{core[:n]}" for n in (3, 4, 5) if len(core) > n] + (
        [f"3>{core[-3:]}"] if len(core) > 3 else [])


def _apply(m: tuple, r: np.ndarray) -> np.ndarray:
    a, b, c, d = m
    return np.clip((a * r + b) / (c * r + d), 1e-30, 1e30)


def scan(m: tuple, first: np.ndarray, count: np.ndarray, start: float) -> np.ndarray:
    """Ratios r_t = (a_t r + b_t) / (c_t r + d_t) along each document, r before its first word = start.

    The four arrays have one row per block of words; document k has the ``count[k]`` blocks from
    ``first[k]``. Blocks are first reduced to one map each, all at once; then documents advance block by block.
    """
    blocks, width = m[0].shape
    total = [np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)]
    for t in range(width):
        a, b, c, d = (x[:, t] for x in m)
        pa_, pb, pc, pd = total
        total = [a * pa_ + b * pc, a * pb + b * pd, c * pa_ + d * pc, c * pb + d * pd]
        scale = np.maximum(np.maximum(total[0], total[1]), np.maximum(total[2], total[3]))
        total = [x / scale for x in total]
    entry = np.full(blocks, start)
    order = np.argsort(-count, kind="stable")
    ratio, steps = np.full(len(first), start), count[order]
    for k in range(int(count.max(initial=0))):
        live = order[: np.searchsorted(-steps, -k, side="left")]
        at = first[live] + k
        entry[at] = ratio[live]
        ratio[live] = _apply(tuple(x[at] for x in total), ratio[live])
    out = np.empty((blocks, width))
    for t in range(width):
        entry = _apply(tuple(x[:, t] for x in m), entry)
        out[:, t] = entry
    return out


@dataclass
class Field:
    """Weights of the toxic tag by feature; the clean tag's are zero. ``trans[i, j]``: tag i to tag j."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -5.0
    start: float = 0.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    calibration: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def emission(self, word: str) -> float:
        return self.bias + sum([self.weights.get(f, 0.0) for f in features(word)])

    def emissions(self, words: list[str]) -> list[float]:
        return [self.emission(w) for w in words]

    def marginals(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of the toxic tag at every word of every document, from the words' scores."""
        lengths = np.array([len(s) for s in scores], np.int64)
        count = -(-lengths // BLOCK)
        first = np.cumsum(count) - count
        n = int(count.sum())
        if not n:
            return [np.zeros(0) for _ in scores]
        flat = np.concatenate(scores)
        place = np.repeat(first * BLOCK - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(flat))
        odds = np.zeros(n * BLOCK)
        odds[place] = np.exp(np.clip(flat, -30, 30))
        real = np.zeros(n * BLOCK, bool)
        real[place] = True
        e, real = odds.reshape(n, BLOCK), real.reshape(n, BLOCK)
        (oo, ot), (to, tt) = np.exp(self.trans)
        mat = lambda a, b, c, d: tuple(np.where(real, x, y) for x, y in zip((a, b, c, d), (1.0, 0.0, 0.0, 1.0)))
        # r: odds of toxic given the words so far. At the first word the odds are e * exp(start),
        # so the value before it solves (r tt + ot) / (r to + oo) = exp(start); folded into e instead.
        begin = (tt + ot) / (to + oo)
        head = first[lengths > 0]
        e_forward = e.copy()
        e_forward[head, 0] *= np.exp(self.start) / begin
        forward = scan(mat(e_forward * tt, e_forward * ot, to, oo), first, count, 1.0)
        # b: the same from the words after; the map at word t takes b_t to b_(t-1)
        back = mat(tt * e, to, ot * e, oo)
        flip = tuple(x[::-1, ::-1] for x in back)
        after = scan(flip, n - first - count, count, 1.0)[::-1, ::-1].reshape(-1)
        # after[t] is b_(t-1): shift by one inside each document
        b = np.ones(n * BLOCK)
        b[:-1] = after[1:]
        ends = (first + count) * BLOCK - 1
        b[ends[count > 0]] = 1.0
        o = forward.reshape(-1) * b
        flat_m = (o / (1 + o))[place]
        return np.split(flat_m, np.cumsum(lengths)[:-1])

    def evidence(self, marginals: list[np.ndarray]) -> np.ndarray:
        """Per document: log odds of its largest marginal, and log of the expected number of toxic words."""
        top = np.array([m.max(initial=0.0) for m in marginals])
        total = np.array([m[m > 0.05].sum() for m in marginals])
        top = np.clip(top, 1e-4, 1 - 1e-4)
        return np.stack([np.log(top / (1 - top)), np.log(total + 0.05)], axis=1)

    def score(self, marginals: list[np.ndarray]) -> np.ndarray:
        a, b, c = self.calibration
        x = self.evidence(marginals)
        return 1 / (1 + np.exp(-(a + x[:, 0] * b + x[:, 1] * c)))


def find_evidence(docs: list[np.ndarray], toxic: np.ndarray, size: int) -> np.ndarray:
    """Features that explain the toxic documents: again and again the one whose documents, among the
    toxic ones still open and all clean ones, are toxic most significantly.

    ``docs`` holds each document's distinct features, numbers below ``size``. A document is closed by
    COVER features, so that words which merely stand in many copies of a toxic document cannot all be
    taken, while documents with several toxic words show them all.
    """
    hits, false = np.zeros(size), np.zeros(size)
    for row, label in zip(docs, toxic):
        (hits if label else false)[row] += 1
    candidates = hits >= 3
    left, clean = int(toxic.sum()), int((~toxic).sum())
    chosen, open_ = [], np.where(toxic, COVER, 0)
    limit = 2 * np.log(max(2, int(candidates.sum()))) + 6

    def part(k, row, column):
        return np.where(k > 0, k * np.log(np.maximum(k, 1e-9) * (left + clean) / np.maximum(row * column, 1e-9)), 0.0)

    while left and size:
        with_, without = hits + false, left + clean - hits - false
        ratio = 2 * (part(hits, with_, left) + part(false, with_, clean)
                     + part(left - hits, without, left) + part(clean - false, without, clean))
        ratio[~candidates | ((hits / left) < 8 * (false + 0.5) / max(1, clean))] = 0.0
        ratio[chosen] = 0.0
        best = int(ratio.argmax())
        if ratio[best] <= limit:
            break
        chosen.append(best)
        for k in np.flatnonzero(open_):
            at = np.searchsorted(docs[k], best)
            if at < len(docs[k]) and docs[k][at] == best:
                open_[k] -= 1
                if open_[k] == 0:
                    hits[docs[k]] -= 1
                    left -= 1
    return np.array(chosen, np.int64)


def _forward_backward(e: np.ndarray, mask: np.ndarray, trans: np.ndarray, start: float):
    """Tag marginals (n, T) and summed pair marginals (2, 2) of padded sequences; e: toxic log odds."""
    n, width = e.shape
    psi = np.stack([np.ones_like(e), np.exp(np.clip(e, -30, 30))], axis=2)
    move = np.exp(trans)
    alpha, beta = np.empty((n, width, 2)), np.ones((n, width, 2))
    a = psi[:, 0] * np.array([1.0, np.exp(start)])
    alpha[:, 0] = a / a.sum(1, keepdims=True)
    for t in range(1, width):
        a = (alpha[:, t - 1] @ move) * psi[:, t]
        alpha[:, t] = np.where(mask[:, t, None], a / a.sum(1, keepdims=True), alpha[:, t - 1])
    pairs = np.zeros((2, 2))
    for t in range(width - 2, -1, -1):
        nxt = psi[:, t + 1] * beta[:, t + 1]
        joint = alpha[:, t, :, None] * move[None] * nxt[:, None, :]
        joint /= joint.sum((1, 2), keepdims=True)
        pairs += joint[mask[:, t + 1]].sum(0)
        b = nxt @ move.T
        beta[:, t] = np.where(mask[:, t + 1, None], b / b.sum(1, keepdims=True), 1.0)
    m = alpha * beta
    return m[:, :, 1] / m.sum(2), pairs


def fit(texts: list[str], toxic: np.ndarray) -> Field:
    model = Field()
    toxic = np.asarray(toxic, bool)
    if not toxic.any() or toxic.all():
        share = min(max(float(toxic.mean()) if len(toxic) else 0.0, 1e-9), 1 - 1e-9)
        model.calibration = (float(np.log(share / (1 - share))), 0.0, 0.0)
        return model
    first = {text: k for k, text in reversed(list(enumerate(texts)))}  # copies teach nothing new
    texts, toxic = list(first), toxic[list(first.values())]
    vocabulary, names = defaultdict(), defaultdict()
    vocabulary.default_factory, names.default_factory = vocabulary.__len__, names.__len__
    docs = [np.array([vocabulary[w] for w in text.lower().split()], np.int64) for text in texts]
    parts = [[names[f] for f in features(w)] for w in vocabulary]  # numbers of each word's features
    ends = np.cumsum([0, *map(len, parts)])
    flat = np.array([f for part in parts for f in part], np.int64)
    del parts

    def features_of(words: np.ndarray) -> np.ndarray:
        """Features of all these words, one word after the other."""
        count = ends[words + 1] - ends[words]
        return flat[np.repeat(ends[words + 1] - np.cumsum(count), count) + np.arange(count.sum())]

    evidence = find_evidence([np.unique(features_of(np.unique(d))) for d in docs], toxic, len(names))
    owner = np.repeat(np.arange(len(vocabulary)), np.diff(ends))
    marked = np.zeros(len(vocabulary), bool)
    marked[owner[np.isin(flat, evidence)]] = True

    # labelled sequences: all that hold a toxic token, then others in turn over the documents
    hot, cold = [], []
    for words, label in zip(docs, toxic):
        for at in range(0, len(words), SEQUENCE):
            part = words[at : at + SEQUENCE]
            (hot if label and marked[part].any() else cold).append((part, bool(label)))
    rng = np.random.default_rng(7)
    hot = [hot[k] for k in rng.permutation(len(hot))[: SEQUENCES // 2]]
    chosen = hot + [cold[k] for k in rng.permutation(len(cold))[: SEQUENCES - len(hot)]]
    n = len(chosen)
    mask, y = np.zeros((n, SEQUENCE), bool), np.zeros((n, SEQUENCE))
    for k, (part, label) in enumerate(chosen):
        mask[k, : len(part)], y[k, : len(part)] = True, label & marked[part]
    words = np.concatenate([part for part, _ in chosen])
    cell = np.repeat(np.flatnonzero(mask.reshape(-1)), ends[words + 1] - ends[words])
    feat = features_of(words)
    seen = np.bincount(feat, minlength=len(names)) >= 3
    number = np.cumsum(seen) - 1
    cell, feat = cell[seen[feat]], number[feat[seen[feat]]]
    index = [f for f, used in zip(names, seen) if used]
    pair_seen = np.zeros((2, 2))
    yi = y.astype(int)
    np.add.at(pair_seen, (yi[:, :-1][mask[:, 1:]], yi[:, 1:][mask[:, 1:]]), 1)

    # Adagrad on the regularised log likelihood, one step per epoch over all sequences
    w, b, s, trans = np.zeros(len(index)), -4.0, 0.0, np.zeros((2, 2))
    total = mask.sum()
    sums = [np.full(len(index), 1e-8), 1e-8, 1e-8, np.full((2, 2), 1e-8)]
    for _ in range(EPOCHS):
        e = np.bincount(cell, w[feat], n * SEQUENCE).reshape(n, SEQUENCE) + b
        p, pairs = _forward_backward(e, mask, trans, s)
        gap = np.where(mask, p - y, 0.0)
        grads = [np.bincount(feat, gap.reshape(-1)[cell], len(index)) / total + 1e-7 * w, gap.sum() / total,
                 gap[:, 0].sum() / total, (pairs - pair_seen) / total]
        sums = [q + g * g for q, g in zip(sums, grads)]
        w, b, s, trans = (x - 0.5 * g / np.sqrt(q) for x, g, q in zip((w, b, s, trans), grads, sums))
    model.weights = {f: float(w[k]) for k, f in enumerate(index) if abs(w[k]) > 0.05}
    model.bias, model.start, model.trans = float(b), float(s), trans

    scores = np.array(model.emissions(list(vocabulary)))
    x = np.concatenate([model.evidence(model.marginals([scores[d] for d in docs[at : at + 500]]))
                        for at in range(0, len(docs), 500)])
    x1 = np.column_stack([np.ones(len(x)), x])
    theta = np.zeros(3)
    ridge = np.diag([1e-3, 1e-1, 1e-1])
    for _ in range(30):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x1 @ theta, -30, 30)))
        h = (x1 * (p * (1 - p))[:, None]).T @ x1 + ridge
        theta -= np.linalg.solve(h, x1.T @ (p - toxic) + ridge @ theta)
    model.calibration = tuple(theta.tolist())
    return model


def train(docs: DataFrame, labels: DataFrame) -> Field:
    """Fits on training rows of both classes, at most SAMPLE_PER_CLASS each, in the order of a hash.

    The sample is bounded by these parameters and goes to the driver; scoring covers all rows.
    """
    fold = labels.filter(~held_out(F.col("doc_id"), FOLDS) & F.col("doc_id").isNotNull()).filter(
        F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # only rows that can be learnt from take up places
    there = docs.filter(F.length("text") <= SAMPLE_CHARS).select("doc_id").distinct().join(fold, "doc_id")
    there = cut_lineage(there)
    chosen = reduce(DataFrame.unionByName, [
        there.filter(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_PER_CLASS)
        for value in (0, 1)])
    rows = (docs.select("doc_id", "text").filter(F.length("text") <= SAMPLE_CHARS)
            .join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
            .toArrow().to_pylist())
    rows.sort(key=lambda r: r["doc_id"])
    return fit([r["text"] or "" for r in rows], np.array([r["toxic"] == 1 for r in rows], bool))


def spans(text: str, marginals: np.ndarray) -> list[dict]:
    """Runs of words over one half: start and end offset and the largest marginal."""
    if not (marginals > 0.5).any():
        return []
    places, out = [m.span() for m in WORD.finditer(text)], []
    for k in np.flatnonzero(marginals > 0.5).tolist():
        if out and out[-1]["last"] == k - 1:
            out[-1].update(end=places[k][1], last=k, probability=max(out[-1]["probability"], float(marginals[k])))
        else:
            out.append({"start": places[k][0], "end": places[k][1], "last": k, "probability": float(marginals[k])})
    return [{k: v for k, v in s.items() if k != "last"} for s in out]


def toxicity(text: Column, model: Field) -> Column:
    """Struct of ``score`` and ``spans``. ``model`` is as large as its training sample allows."""
    @F.arrow_udf("struct<score: double, spans: array<struct<start: int, end: int, probability: double>>>")
    @lean
    def score_toxicity(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo = Memo(model.emissions)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))
        for batch in batches:
            scores, found = [], []
            for lo, hi in slices(byte_lengths(batch), GROUP_BYTES):
                texts = [t or "" for t in batch.slice(lo, hi - lo).to_pylist()]
                words = [t.lower().split() for t in texts]
                memo.learn(set().union(*words))
                marginals = model.marginals([np.fromiter(map(memo.__getitem__, w), float, len(w)) for w in words])
                scores.extend(model.score(marginals).tolist())
                found.extend(map(spans, texts, marginals))
            yield pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(found, kind)], names=["score", "spans"])

    return score_toxicity(text)


def toxic_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and spans of every document."""
    model = train(docs, labels)
    return (docs.select("doc_id", toxicity(F.col("text"), model).alias("t"))
            .select("doc_id", held_out(F.col("doc_id"), FOLDS).alias("held_out"), F.col("t.score").alias("score"),
                    (F.col("t.score") >= 0.5).cast("int").alias("predicted"), F.col("t.spans").alias("spans")))


def without_toxic(docs: DataFrame, model: Field) -> DataFrame:
    """Documents scored under one half, with the columns they came with."""
    score = fresh(docs, "toxic_score")
    kept = docs.withColumn(score, toxicity(F.col("text"), model)["score"]).filter(F.col(score) < 0.5)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
