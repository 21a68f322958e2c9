"""Byte-pair merges for many words at once, in padded numpy matrices.

Words go into buckets of similar length, one row each, padded at the right. In each round every row
merges its leftmost pair of least rank: pair ranks come from a hash table, the row closes up over
the merged place, and rows without a mergeable pair leave the matrix.
"""

from __future__ import annotations

import heapq

import numpy as np

# Rows longer than this many symbols are merged one by one, by a queue; the result is the same.
WIDEST = 128
CELLS = 1 << 19
NONE = np.iinfo(np.int32).max


class PairTable:
    """(left, right) -> (rank, merged id), as an open-addressing hash table in arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        self.bits = max(4, int(len(keys)).bit_length() + 2)
        size = 1 << self.bits
        self.keys = np.full(size, np.uint64(2**64 - 1))
        self.rank = np.full(size, NONE, np.int32)
        self.merged = np.zeros(size, np.int32)
        self.small = dict(zip(keys.tolist(), zip(rank.tolist(), merged.tolist())))
        slot, waiting, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(waiting):  # in each step the first key that wants a free place gets it
            self.probes += 1
            free = self.rank[slot[waiting]] == NONE
            _, first = np.unique(slot[waiting[free]], return_index=True)
            placed = waiting[free][first]
            self.keys[slot[placed]], self.rank[slot[placed]] = keys[placed], rank[placed]
            self.merged[slot[placed]] = merged[placed]
            waiting = np.setdiff1d(waiting, placed)
            slot[waiting] = (slot[waiting] + 1) % size

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slot of each pair; a slot of rank NONE where the pair is not in the table."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = self._slot(keys)
        open_ = np.flatnonzero((self.keys[slot] != keys) & (self.rank[slot] != NONE))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            open_ = open_[(self.keys[slot[open_]] != keys[open_]) & (self.rank[slot[open_]] != NONE)]
        slot[open_] = self.empty()
        return slot

    def empty(self) -> int:
        return int(np.flatnonzero(self.rank == NONE)[0])


def merge_queue(symbols: list[int], table: PairTable) -> list[int]:
    """The same merges for one long row: a queue of pairs by rank and place over a linked list."""
    after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
    queue: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < len(symbols):
            found = table.small.get(symbols[i] << 32 | symbols[after[i]])
            if found:
                heapq.heappush(queue, (found[0], i, symbols[i], symbols[after[i]]))

    for i in range(len(symbols)):
        offer(i)
    while queue:
        _, i, left, right = heapq.heappop(queue)
        j = after[i]
        if symbols[i] != left or j >= len(symbols) or symbols[j] != right:
            continue  # one of the two has been merged meanwhile
        symbols[i], symbols[j] = table.small[left << 32 | right][1], -1
        after[i] = after[j]
        if after[j] < len(symbols):
            before[after[j]] = i
        offer(i)
        offer(before[i])
    return [s for s in symbols if s >= 0]


def merge_matrix(rows: np.ndarray, table: PairTable) -> np.ndarray:
    """Merged rows of a matrix padded with -1, padded likewise."""
    done = np.full(rows.shape, -1, np.int32)
    at = np.arange(len(rows))
    rows = rows.copy()
    pair = (rows[:, :-1] >= 0) & (rows[:, 1:] >= 0)
    slots = np.full(pair.shape, table.empty(), np.int64)
    slots[pair] = table.find(rows[:, :-1][pair], rows[:, 1:][pair])
    ranks = table.rank[slots]
    while len(rows):
        if not rows.shape[1] > 1:
            done[at, : rows.shape[1]] = rows
            break
        place = ranks.argmin(1)
        every = np.arange(len(rows))
        live = ranks[every, place] != NONE
        if not live.all():
            done[at[~live], : rows.shape[1]] = rows[~live]
            rows, ranks, slots, at, place = rows[live], ranks[live], slots[live], at[live], place[live]
            every = np.arange(len(rows))
            if not len(rows):
                break
        rows[every, place] = table.merged[slots[every, place]]
        # close up: drop the symbol after the merged one, and its pair
        width = rows.shape[1]
        keep = np.arange(width)[None, :] != (place + 1)[:, None]
        rows = rows[keep].reshape(-1, width - 1)
        keep = np.arange(width - 1)[None, :] != place[:, None]
        ranks, slots = ranks[keep].reshape(-1, width - 2), slots[keep].reshape(-1, width - 2)
        for shift in (-1, 0):  # the pairs that now hold the merged symbol
            p = place + shift
            ok = np.flatnonzero((p >= 0) & (p < width - 2))
            ok = ok[rows[ok, np.minimum(p[ok] + 1, width - 2)] >= 0]
            found = table.find(rows[ok, p[ok]], rows[ok, p[ok] + 1])
            slots[ok, p[ok]], ranks[ok, p[ok]] = found, table.rank[found]
            if shift == 0:  # a pair whose right half is padding is no pair
                gone = np.flatnonzero((p < width - 2))
                gone = gone[rows[gone, p[gone] + 1] < 0]
                ranks[gone, p[gone]] = NONE
    return done


def merge_all(symbols: np.ndarray, lengths: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one after the other, and the number of ids of each.

    ``symbols`` holds the first symbols of all words, one word after the other.
    """
    ends = np.cumsum(lengths)
    starts = ends - lengths
    sizes = lengths.copy()
    out = np.array(symbols, np.int32)  # a word's ids stand from its start on
    order = np.argsort(lengths, kind="stable")
    edges = np.searchsorted(lengths[order], [1, 2, 5, 8, 12, 16, 24, 32, 64, WIDEST], side="right")
    for lo, hi in zip(edges[:-1], edges[1:]):
        if lo == hi:
            continue
        width = int(lengths[order[hi - 1]])
        step, columns = max(1, CELLS // width), np.arange(width)[None, :]
        for start in range(lo, hi, step):
            some = order[start : min(hi, start + step)]
            places = starts[some][:, None] + columns
            inside = columns < lengths[some][:, None]
            rows = np.where(inside, symbols[np.minimum(places, len(symbols) - 1)], -1).astype(np.int32)
            merged = merge_matrix(rows, table)
            kept = merged >= 0
            out[places[kept]] = merged[kept]
            sizes[some] = kept.sum(1)
    for k in order[edges[-1] :].tolist():
        ids = merge_queue(symbols[starts[k] : ends[k]].tolist(), table)
        out[starts[k] : starts[k] + len(ids)] = ids
        sizes[k] = len(ids)
    within = np.arange(len(out)) - np.repeat(starts, lengths)
    return out[within < np.repeat(sizes, lengths)], sizes
