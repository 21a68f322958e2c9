"""Vector codes from codebooks that Lloyd rounds fit over cover trees.

A vector's components become whole numbers, it is cut into parts, and each part is coded as the
nearest entry of its codebook. Rows are taken in blocks where they lie; for each block and part a
cover tree is built once and written. A node of a tree is a point with a ball around it that holds the
node's points; its children's balls are smaller by SHRINK. The points of a node stand together, and
sums along that order give the sum of any node's points at once.

In a round, an entry that is nearer to a node's point than any other by more than the ball's diameter
is, by the triangle inequality, nearest to all the node's points: they are assigned as one, with their sum.
Only the other nodes descend, to points that are compared by themselves at last; all distances are whole
numbers, and exact. A task sums up its blocks, sums are added by entry, and the new codebook (ENTRIES
entries, whatever the table) goes out with the next round.

Defined results: vectors that are null or hold null or non-finite components are left out; vectors of
another length have codebooks of their own; a length that PARTS does not divide is cut as evenly as
possible; a null vec_id counts as the largest, and rows of one vec_id are in the order of their vectors;
with fewer rows than ENTRIES a codebook is as short. Components beyond LARGEST in size count as LARGEST,
and a sum of errors beyond 64 bits is null. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.session import stored

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
SHRINK = 0.7
BLOCK_ROWS = 2048
SMALL = 8
LARGEST = 10 ** 27
EXACT = 1 << 52  # up to here all whole numbers are exact as doubles
MARGIN = 1e-6


def whole_numbers(values: np.ndarray, plain: bool) -> np.ndarray:
    """Components as whole numbers: doubles if all sums of squares are exact in them, else objects."""
    scaled = np.floor(values.astype(float) * SCALE)
    if plain:
        return scaled
    return np.array([[max(-LARGEST, min(LARGEST, int(x))) for x in row] for row in np.clip(scaled, -1e30, 1e30)],
                    object).reshape(scaled.shape)


def distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all entries, exact."""
    if points.dtype == object:
        return np.array([[sum((p - e) ** 2) for e in entries] for p in points], object).reshape(len(points), len(entries))
    return (points * points).sum(1)[:, None] + (entries * entries).sum(1)[None, :] - 2 * (points @ entries.T)


def lengths(differences: np.ndarray) -> np.ndarray:
    return np.sqrt((differences.astype(float) ** 2).sum(1))


class CoverTree:
    """Nodes of a cover tree, level after level: ``radius``, the range ``lo`` to ``hi`` of their points in
    ``order``, of which the first is their own point, and the range ``first`` to ``last`` of their children."""

    NAMES = ("order", "radius", "lo", "hi", "first", "last")

    def __init__(self, order, radius, lo, hi, first, last):
        self.order, self.radius, self.lo, self.hi, self.first, self.last = order, radius, lo, hi, first, last

    @classmethod
    def build(cls, points: np.ndarray) -> CoverTree:
        points = points.astype(float)
        n = len(points)
        order = np.zeros(n, np.int32)
        # of this level's nodes: own point, place in the order; and the other points with their node, by node
        center, lo = np.zeros(min(n, 1), np.int64), np.zeros(min(n, 1), np.int64)
        rest, owner = np.arange(1, n), np.zeros(max(n - 1, 0), np.int64)
        radius, los, his, firsts, counts = [], [], [], [], []
        done = 0
        while len(center):
            order[lo] = center
            size = np.bincount(owner, minlength=len(center))
            away = lengths(points[rest] - points[center[owner]])
            ball = np.zeros(len(center))
            np.maximum.at(ball, owner, away)
            done += len(center)
            radius.append(ball)
            los.append(lo)
            his.append(lo + 1 + size)
            split = ball[owner] > 0
            same = owner[~split]  # a ball without extent is not parted: equal points, in any order
            order[lo[same] + 1 + np.arange(len(same)) - np.searchsorted(same, same)] = rest[~split]
            rest, owner, away = rest[split], owner[split], away[split]
            parents = np.unique(owner)
            # the first child is the node's own point again; then come the points that no ball holds yet
            child_of, child = [parents], [center[parents]]
            at = np.searchsorted(parents, owner)
            limit = np.where(size + 1 <= SMALL, -1.0, ball * SHRINK)
            held = np.where(away <= limit[owner], at, -1)
            number = len(parents)
            while len(left := np.flatnonzero(held < 0)):
                new = left[np.r_[True, owner[left][1:] != owner[left][:-1]]]
                index = np.searchsorted(owner[new], owner[left])
                near = lengths(points[rest[left]] - points[rest[new]][index]) <= np.maximum(limit[owner[left]], 0)
                near[np.searchsorted(left, new)] = True
                held[left[near]] = number + index[near]
                child_of.append(owner[new])
                child.append(rest[new])
                number += len(new)
            child_of, child = np.concatenate(child_of), np.concatenate(child)
            by = np.argsort(child_of, kind="stable")
            rank = np.empty(len(by), np.int64)
            rank[by] = np.arange(len(by))
            child_of, child, held = child_of[by], child[by], rank[held]
            own = rest == child[held]
            rest, owner = rest[~own], held[~own]
            by = np.argsort(owner, kind="stable")
            rest, owner = rest[by], owner[by]
            many = np.bincount(child_of, minlength=len(center))
            start = np.cumsum(many) - many
            firsts.append(np.where(many > 0, done + start, 0))
            counts.append(many)
            sizes = 1 + np.bincount(owner, minlength=len(child))
            ahead = np.cumsum(sizes) - sizes
            lo = lo[child_of] + ahead - ahead[start[child_of]] if len(child) else np.zeros(0, np.int64)
            center = child
        cat = lambda parts, kind: np.concatenate([np.zeros(0), *parts]).astype(kind)
        first = cat(firsts, np.int32)
        return cls(order, cat(radius, float), cat(los, np.int32), cat(his, np.int32), first, first + cat(counts, np.int32))

    def packed(self) -> dict[str, bytes]:
        return {name: getattr(self, name).tobytes() for name in self.NAMES}

    @classmethod
    def unpacked(cls, row: dict) -> CoverTree:
        return cls(*[np.frombuffer(row[name], float if name == "radius" else np.int32) for name in cls.NAMES])

    def assign(self, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes whose points have one nearest entry, and that entry (ties go to the lower one). Every
        point is in exactly one of the nodes."""
        nearest = np.full(len(points), -1)
        apart = np.zeros(len(points))
        nodes, entry = [], []
        front = np.arange(min(len(self.lo), 1))
        while len(front):
            own = self.order[self.lo[front]]
            new = own[nearest[own] < 0]
            if len(new):
                far = distances(points[new], entries)
                nearest[new] = far.argmin(1)
                roots = np.sqrt(far.astype(float))
                two = np.partition(roots, 1, axis=1)[:, :2] if len(entries) > 1 else np.c_[roots, np.full(len(new), np.inf)]
                # what is left of the distance between the two after all that rounding may take
                apart[new] = two[:, 1] - two[:, 0] - MARGIN * (1 + np.minimum(two[:, 1], two[:, 0] * 2 + 1))
            whole = (self.radius[front] == 0) | (2 * self.radius[front] * (1 + MARGIN) < apart[own])
            nodes.append(front[whole])
            entry.append(nearest[own[whole]])
            down = front[~whole]
            count = self.last[down] - self.first[down]
            front = np.repeat(self.last[down] - np.cumsum(count), count) + np.arange(count.sum())
        return np.concatenate([np.zeros(0, np.int64), *nodes]), np.concatenate([np.zeros(0, np.int64), *entry])


def edges(dims: int) -> list[int]:
    return [k * dims // PARTS for k in range(PARTS + 1)]


def planted(vectors: DataFrame, dims: int, plain: bool, names: list[str]) -> DataFrame:
    """Blocks of the rows ``(*names, vector)``: the names' values, the points and a tree per part."""
    cuts = edges(dims)
    kept = vectors.select(*names, F.col("vector").cast("array<double>").alias("vector"))
    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    tree = ", ".join(f"`{name}`: binary" for name in CoverTree.NAMES)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            flat = rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            values = whole_numbers(flat.reshape(len(rows), dims), plain)
            trees = [CoverTree.build(values[:, a:b]).packed() for a, b in zip(cuts[:-1], cuts[1:])]
            own = pa.StructArray.from_arrays([rows.column(name).combine_chunks() for name in names], names=names)
            raw = values.astype("<f8").tobytes() if plain else ",".join(map(str, values.ravel())).encode()
            return pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays([0, len(rows)], own), pa.array([raw], pa.binary()),
                 pa.array([trees], pa.list_(pa.struct([(name, pa.binary()) for name in CoverTree.NAMES])))],
                names=["rows", "points", "trees"])

        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += len(batch)
            while count >= BLOCK_ROWS:
                rows = pa.Table.from_batches(held)
                yield block(rows.slice(0, BLOCK_ROWS))
                held, count = rows.slice(BLOCK_ROWS).to_batches(), count - BLOCK_ROWS
        if count:
            yield block(pa.Table.from_batches(held))

    return kept.mapInArrow(blocks, f"rows: array<struct<{fields}>>, points: binary, trees: array<struct<{tree}>>")


def opened(batch: pa.RecordBatch, dims: int, plain: bool) -> Iterator[tuple[int, np.ndarray, list[CoverTree]]]:
    """Per row of ``batch(points, trees)``: its number, the points and the trees."""
    for k, (raw, trees) in enumerate(zip(batch.column("points"), batch.column("trees"))):
        if plain:
            values = np.frombuffer(raw.as_py(), "<f8")
        else:
            values = np.array([int(x) for x in raw.as_py().decode().split(",") if x], object)
        trees = [CoverTree.unpacked(t) for t in trees.as_py()]
        yield k, values.reshape(len(trees[0].order), dims), trees


def sums(blocks: DataFrame, dims: int, plain: bool, books: list[np.ndarray]) -> DataFrame:
    """part, entry, n and the sums of the points assigned to it, added up over all blocks."""
    cuts = edges(dims)
    width = max(b - a for a, b in zip(cuts[:-1], cuts[1:]))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((len(b), width), np.int64 if plain else object) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for _, values, trees in opened(batch, dims, plain):
                for part, (tree, book) in enumerate(zip(trees, books)):
                    points = values[:, cuts[part] : cuts[part + 1]]
                    nodes, entry = tree.assign(points, book)
                    upto = np.zeros((len(points) + 1, points.shape[1]), totals[part].dtype)
                    np.cumsum(points[tree.order].astype(upto.dtype), axis=0, out=upto[1:])
                    np.add.at(totals[part][:, : points.shape[1]], entry, upto[tree.hi[nodes]] - upto[tree.lo[nodes]])
                    np.add.at(counts[part], entry, tree.hi[nodes] - tree.lo[nodes])
        for part, (total, count) in enumerate(zip(totals, counts)):
            some = np.flatnonzero(count)
            if len(some):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array(count[some]),
                     pa.array([[Decimal(int(x)) for x in row] for row in total[some]], pa.list_(pa.decimal128(38, 0)))],
                    names=["part", "entry", "n", "sums"])

    found = blocks.select("points", "trees").mapInArrow(partial, "part int, entry int, n long, sums array<decimal(38,0)>")
    return found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(
        *[F.sum(F.get("sums", F.lit(k))) for k in range(width)]).alias("sums"))


def coded(blocks: DataFrame, dims: int, plain: bool, books: list[np.ndarray]) -> DataFrame:
    """The names of every row, its code and its error."""
    cuts, fields = edges(dims), blocks.schema["rows"].dataType.elementType.fields

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, values, trees in opened(batch, dims, plain):
                code, error = np.zeros((len(values), PARTS), np.uint8), np.zeros(len(values), object)
                for part, (tree, book) in enumerate(zip(trees, books)):
                    points = values[:, cuts[part] : cuts[part + 1]]
                    nodes, entry = tree.assign(points, book)
                    chosen, by = np.zeros(len(points), np.int64), np.argsort(tree.lo[nodes])
                    chosen[tree.order] = np.repeat(entry[by], (tree.hi - tree.lo)[nodes[by]])
                    code[:, part] = chosen
                    away = ((points - book[chosen]) ** 2).sum(1)
                    error += np.array([int(x) for x in away], object)
                rows = batch.column("rows").slice(k, 1).flatten()
                yield pa.RecordBatch.from_arrays(
                    [*rows.flatten(), pa.array([c.tobytes().hex() for c in code], pa.string()),
                     pa.array([int(e) if e < 2 ** 63 else None for e in error], pa.int64())],
                    names=[*[f.name for f in fields], "code", "error"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return blocks.select("rows", "points", "trees").mapInArrow(codes, f"{kinds}, code string, error long")


def fitted(blocks: DataFrame, dims: int, plain: bool, books: list[np.ndarray], rounds: int) -> list[np.ndarray]:
    """Codebooks after the rounds: each entry the mean of its points, rounded down; unused entries stay."""
    cuts = edges(dims)
    for _ in range(rounds):
        books = [book.copy() for book in books]
        for row in sums(blocks, dims, plain, books).collect():  # PARTS * ENTRIES rows at most
            width = cuts[row.part + 1] - cuts[row.part]
            books[row.part][row.entry] = [int(x) // row.n for x in row["sums"][:width]]
    return books


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def with_totals(rows: DataFrame) -> DataFrame:
    """``rows(label, error)`` with ``label_error``, the sum over equal labels. The labels that hold a
    hundredth of the rows or more, a hundred at most, are sent to all tasks; the others meet by label."""
    same = F.struct("label")  # a null label equals another
    totals = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("error").cast("decimal(38,0)")).try_cast(
        "long").alias("label_error"), F.max(F.col("error").isNull()).alias("open"))
    totals = stored(totals.withColumn("label_error", F.when(~F.col("open"), F.col("label_error"))).drop("open"), "codes-labels")
    count = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = F.col("n") * 100 >= count
    rows, totals = rows.withColumn("key", same), totals.withColumn("key", same).drop("label")
    common = F.broadcast(totals.filter(often).drop("n"))
    return rows.join(common, "key").unionByName(
        rows.join(common, "key", "left_anti").join(totals.filter(~often).drop("n"), "key")).drop("key")


def codes(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of all usable ``vectors(vec_id, label, vector)``."""
    kept = vectors.select("vec_id", "label", "vector").filter(usable(F.col("vector")))
    sizes = kept.groupBy(F.size("vector").alias("dims")).agg(F.max(F.greatest(
        F.abs(F.array_min("vector")), F.abs(F.array_max("vector")))).cast("double").alias("most")).collect()
    parts = []
    for dims, most in sizes:
        plain = 8 * dims * (SCALE * (most or 0) + 1) ** 2 < EXACT
        some, cuts = kept.filter(F.size("vector") == dims), edges(dims)
        first = some.orderBy(F.asc_nulls_last("vec_id"), F.asc("vector")).limit(entries).collect()
        start = whole_numbers(np.array([r["vector"] for r in first], float).reshape(len(first), dims), plain)
        blocks = stored(planted(some, dims, plain, ["vec_id", "label"]), "codes-blocks")
        books = fitted(blocks, dims, plain, [start[:, a:b] for a, b in zip(cuts[:-1], cuts[1:])], rounds)
        text = ",".join(str(int(x)) for book in books for entry in book for x in entry)
        parts.append(coded(blocks, dims, plain, books).withColumn(
            "codebooks_sha256", F.lit(hashlib.sha256(text.encode()).hexdigest())))
    if not parts:
        return kept.limit(0).select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                                    F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    rows = stored(reduce(DataFrame.unionByName, parts), "codes-rows")
    return with_totals(rows).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
