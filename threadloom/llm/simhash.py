"""SimHash fingerprints, linked by BK-trees, and the components of the links.

Fingerprints within ``RADIUS`` bits agree on at least one of ``RADIUS + 1`` blocks of bits, so a
shard holds the distinct fingerprints with one value of one block. Each shard's fingerprints form a
BK-tree: a node's children are keyed by their Hamming distance to it, and a search follows only
edges whose key differs from the distance at the node by at most the radius. A shard of more than
SHARD_NODES fingerprints is dealt into several trees, each of which goes to every part of the
shard's queries, so that no task holds an unbounded shard. A task merges what it links and passes
on one edge per fingerprint, not all pairs.

With a ``similarity`` the links are exact: two texts are linked if their sets of shingles have at
least that Jaccard similarity. 64 bits cannot tell that by themselves (at 0.8 the fingerprints of the
sets differ in 10 bits on average, and 2 bits lose nearly all such pairs), so the shards come from
several further fingerprints, BANDS groups of BAND_ROWS least hashes, of which two texts of similarity
s share one with probability ``1 - (1 - s^BAND_ROWS)^BANDS`` (0.8: all but 3 of 100 million); in a
shard the BK-tree's radius has to reach the similarity. What is found so is a candidate only. The
candidates' whole sets are then compared, and only true links count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import byte_lengths, fresh, lean, slices, utf8
from threadloom.llm.components import components
from threadloom.session import cut_lineage

SHINGLE = 3
SEED = 42
BITS = 64
RADIUS = 2
SHARD_NODES = 4096
BANDS, BAND_ROWS = 24, 3
SIMILAR_RADIUS = 24  # reached by sets of similarity 0.8 but for about one pair in a million
SIMILAR_SHARD_NODES = 1024  # most pairs of such a shard may lie within the radius
PART_TEXTS, PART_SHINGLES = 1024, 1 << 20
BATCH_ROWS = 1 << 16
VISITS = 1 << 21
TREE, BOTH, QUERY = 0, 1, 2

BIT_TABLE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
FACTORS, SUMMANDS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * BAND_ROWS, 1), np.uint64)
FACTORS |= np.uint64(1)


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """Hashes of the text's word shingles in order; a text of fewer words is one shingle.

    ``bytes`` methods lower A-Z alone and part words at space and tab to carriage return alone.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, ">u8")
    shingles = zip(*[words[k:] for k in range(size)]) if len(words) >= size else [words]
    return np.frombuffer(b"".join([xxhash.xxh64_digest(b" ".join(s), SEED) for s in shingles]), ">u8")


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes; zero without hashes."""
    if not len(hashes):
        return 0
    hashes = hashes.astype(">u8", copy=False).view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(hashes[:, k], minlength=256) @ BIT_TABLE for k in range(8)])
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    return majority(shingle_hashes(text, size))


def fingerprints(text: Column, size: int = SHINGLE) -> Column:
    """Fingerprint as a signed 64-bit number; a null text has no words."""
    @F.arrow_udf("long")
    @lean
    def text_fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array((fingerprint(text, size) for text in utf8(batch)), pa.int64())

    return text_fingerprints(text)


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """The distinct hashes of the text's shingles, sorted."""
    return np.unique(shingle_hashes(text, size).astype(np.uint64))


def set_id(hashes: np.ndarray) -> int:
    """One number per set of shingles; zero for the empty one."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - (1 << 63) if len(hashes) else 0


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A number per band, from the least hashes in its BAND_ROWS orders; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full((BANDS * BAND_ROWS, 1), (1 << 64) - 1, np.uint64)
    for lo in range(0, len(hashes), 4096):
        mixed = hashes[None, lo : lo + 4096] * FACTORS + SUMMANDS
        least = np.minimum(least, mixed.min(axis=1, keepdims=True))
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, BAND_ROWS).T:
        keys = (keys ^ row) * FACTORS[0, 0]
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def set_ids(text: Column, size: int) -> Column:
    @F.arrow_udf("long")
    @lean
    def text_sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array((set_id(shingle_set(text, size)) for text in utf8(batch)), pa.int64())

    return text_sets(text)


def sets(text: Column, size: int) -> Column:
    """The sorted hashes of the set of shingles, 8 bytes each."""
    @F.arrow_udf("binary")
    @lean
    def text_hashes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array((shingle_set(text, size).tobytes() for text in utf8(batch)), pa.binary())

    return text_hashes(text)


def signatures(text: Column, size: int) -> Column:
    """Of the set of shingles: its number ``fp``, fingerprint ``print``, size ``n`` and ``bands``."""
    @F.arrow_udf("struct<fp: long, print: long, n: long, bands: array<long>>")
    @lean
    def text_signatures(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            hashes = [shingle_set(text, size) for text in utf8(batch)]
            yield pa.StructArray.from_arrays(
                [pa.array(map(set_id, hashes), pa.int64()), pa.array(map(majority, hashes), pa.int64()),
                 pa.array(map(len, hashes), pa.int64()), pa.array(map(band_keys, hashes), pa.list_(pa.int64()))],
                names=["fp", "print", "n", "bands"])

    return text_signatures(text)


class Forest:
    """One BK-tree per group of ``fps``; items of a group stand together, its first is the root.

    Built for all groups at once, level by level: of the items that reach the same edge, the first
    becomes the child and the others go on from it.
    """

    def __init__(self, group: np.ndarray, fps: np.ndarray):
        self.fps = fps
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.array([], np.int64)
        self.root = dict(zip(group[first].tolist(), first.tolist()))
        left = np.setdiff1d(np.arange(len(group)), first)
        at = np.repeat(first, np.diff(np.r_[first, len(group)]))[left] if len(left) else left
        keys, children = [], []
        while len(left):
            edge = at * (BITS + 1) + np.bitwise_count(fps[left] ^ fps[at]).astype(np.int64)
            edges, firsts, back = np.unique(edge, return_index=True, return_inverse=True)
            keys.append(edges)
            children.append(left[firsts])
            rest = np.ones(len(left), bool)
            rest[firsts] = False
            left, at = left[rest], left[firsts][back][rest]
        order = np.argsort(np.concatenate(keys), kind="stable") if keys else []
        self.keys = np.concatenate(keys)[order] if keys else np.array([], np.int64)
        self.children = np.concatenate(children)[order] if keys else np.array([], np.int64)

    def within(self, fps: np.ndarray, roots: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) index pairs within the radius; query k starts at node ``roots[k]``."""
        query, node = np.arange(len(fps)), roots
        while len(query):
            distance = np.bitwise_count(fps[query] ^ self.fps[node]).astype(np.int64)
            hit = distance <= radius
            if hit.any():
                yield query[hit], node[hit]
            base = node * (BITS + 1)
            lo = np.searchsorted(self.keys, base + np.maximum(distance - radius, 0), "left")
            hi = np.searchsorted(self.keys, base + np.minimum(distance + radius, BITS), "right")
            count = hi - lo
            query = np.repeat(query, count)
            node = self.children[np.repeat(hi - np.cumsum(count), count) + np.arange(count.sum())]


def merged(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index connected to each of ``n`` items by the links ``a[k] - b[k]``."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def whole_cells(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows in tables that end where a cell ``(key, i, j)`` ends, the first three columns in order."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += len(batch)
        if count < most:
            continue
        rows = pa.Table.from_batches(held)
        last = [rows.column(k)[-1].as_py() for k in range(3)]
        same = np.logical_and.reduce([rows.column(k).to_numpy() == last[k] for k in range(3)])
        whole = len(rows) - int(same.sum())  # the last cell may go on
        if whole:
            yield rows.slice(0, whole)
            rows = rows.slice(whole)
        held, count = rows.to_batches(), len(rows)
    if count:
        yield pa.Table.from_batches(held)


def cell_starts(rows: pa.Table) -> np.ndarray:
    key, i, j = (rows.column(k).to_numpy() for k in range(3))
    return np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]


def link_cells(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Edges inside cells ``(key, i, j)``, whose rows ``(key, i, j, fp, role)`` come in order. A sixth
    column has the fingerprints, where ``fp`` is another number."""
    def linked(rows: pa.Table) -> pa.RecordBatch:
        fp, role = rows.column(3).to_numpy(), rows.column(4).to_numpy()
        cell = np.cumsum(cell_starts(rows))
        fps = rows.column(rows.num_columns - 1).to_numpy().view(np.uint64) if rows.num_columns > 5 else fp.view(np.uint64)
        names, item = np.unique(fp.view(np.uint64), return_inverse=True)
        tree, asks = np.flatnonzero(role <= BOTH), np.flatnonzero(role >= BOTH)
        forest = Forest(cell[tree], fps[tree])
        asks = asks[np.isin(cell[asks], cell[tree])]
        sizes = np.bincount(cell[tree], minlength=cell[-1] + 1)
        links = [np.zeros((2, 0), np.int64)]
        for lo, hi in slices(sizes[cell[asks]], VISITS):
            some = asks[lo:hi]
            roots = np.array([forest.root[c] for c in cell[some].tolist()])
            for query, node in forest.within(fps[some], roots, radius):
                pair = np.stack([item[some[query]], item[tree[node]]])
                links.append(pair[:, pair[0] != pair[1]])
        a, b = np.concatenate(links, axis=1)
        root = merged(len(names), a, b)
        moved = np.flatnonzero(root != np.arange(len(names)))
        return pa.RecordBatch.from_arrays([pa.array(names[moved].view(np.int64)),
                                           pa.array(names[root[moved]].view(np.int64))], names=["a", "b"])

    for rows in whole_cells(batches, BATCH_ROWS):
        yield linked(rows)


def similar_pairs(sets: list[np.ndarray], similarity: float) -> Iterator[tuple[int, int]]:
    """Pairs that connect non-empty ``sets`` as all pairs of at least the similarity would: each set is
    held against those that nothing has reached yet."""
    sizes = np.array([len(s) for s in sets])
    names, ids = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(ids, np.cumsum(sizes)[:-1])
    mask = np.zeros(len(names), bool)
    left, reached = np.arange(len(sets)), []
    while len(left):
        if not reached:
            reached.append(int(left[0]))
            left, ids = left[1:], ids[len(own[left[0]]) :]
            continue
        at = reached.pop()
        mask[own[at]] = True
        shared = np.add.reduceat(mask[ids].astype(np.int64), np.r_[0, np.cumsum(sizes[left])[:-1]])
        mask[own[at]] = False
        hit = shared >= similarity * (sizes[left] + sizes[at] - shared) - 1e-9
        if hit.any():
            for other in left[hit].tolist():
                yield at, other
                reached.append(other)
            ids = ids[np.repeat(~hit, sizes[left])]
            left = left[~hit]


def compare_cells(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Edges of at least the similarity inside cells ``(key, i, j)``, whose rows ``(key, i, j, fp, hashes)``
    come in order."""
    for rows in whole_cells(batches, 1):
        fp, hashes = rows.column(3).to_numpy(), rows.column(4)
        first = np.flatnonzero(cell_starts(rows))
        a, b = [], []
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(rows)]):
            some = [np.frombuffer(hashes[k].as_py(), np.uint64) for k in range(lo, hi)]
            for x, y in similar_pairs(some, similarity):
                a.append(fp[lo + x])
                b.append(fp[lo + y])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def block_keys(fp: Column, radius: int) -> Column:
    """One number per block of bits: the block's index above bit 40, its value below. Without a radius
    the whole fingerprint is the only block."""
    edges = [round(k * BITS / (radius + 1)) for k in range(radius + 2)]
    return F.array(*[
        F.shiftrightunsigned(F.shiftleft(fp, BITS - hi), BITS - (hi - lo)).bitwiseOR(
            F.shiftleft(F.lit(k).cast("long"), 40)) if radius else fp
        for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:]))])


def links_of_keys(keys: DataFrame, radius: int, shard_nodes: int) -> DataFrame:
    """Edges ``(a, b)`` inside the shards of ``keys(fp, key)``, each shard the distinct numbers with one key;
    a column ``print`` has the fingerprints, where ``fp`` is another number."""
    shards = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "key", F.ceil(F.col("n") / shard_nodes).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    cells = (
        keys.join(shards, "key").withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp",
                F.when(F.col("own") < F.col("other"), TREE).when(F.col("own") == F.col("other"), BOTH)
                .otherwise(QUERY).alias("role"), *[c for c in keys.columns if c == "print"])
    )
    return (cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
            .mapInArrow(lean(lambda batches: link_cells(batches, radius)), "a long, b long"))


def near_links(nodes: DataFrame, radius: int = RADIUS, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """Edges ``(a, b)`` that connect the distinct ``nodes(fp)`` as all pairs within the radius would."""
    keys = nodes.select("fp", F.explode(block_keys(F.col("fp"), radius)).alias("key"))
    return links_of_keys(keys, radius, shard_nodes)


def similar_links(docs: DataFrame, nodes: DataFrame, size: int, radius: int, similarity: float,
                  part_texts: int = PART_TEXTS, part_shingles: int = PART_SHINGLES,
                  shard_nodes: int = SIMILAR_SHARD_NODES) -> DataFrame:
    """Edges ``(a, b)`` that connect the sets of ``nodes(fp, print, n, bands)``, taken from the texts of
    ``docs``, as all pairs of at least the similarity would.

    Sets that candidate links connect are compared with each other; a group of many sets is dealt into
    parts, of which every two meet in a cell.
    """
    keys = nodes.select("fp", F.explode("bands").alias("key"), "print")
    found = components(links_of_keys(keys, radius, shard_nodes))
    members = found.select(F.col("node").alias("fp"), "root").unionByName(
        found.select(F.col("root").alias("fp"), "root").distinct()).join(nodes.select("fp", "n"), "fp")
    parts = members.groupBy("root").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / part_texts), F.ceil(F.sum("n") / part_shingles)).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    members = cut_lineage(members.join(parts, "root").select("fp", "root", "parts", own.alias("own")))
    texts = docs.select(set_ids(F.col("text"), size).alias("fp"), "text").join(
        members.select("fp"), "fp", "left_semi").groupBy("fp").agg(F.first("text").alias("text"))
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: (k != F.col("own")) | (F.col("parts") == 1))
    cells = (texts.select("fp", sets(F.col("text"), size).alias("hashes")).join(members, "fp")
             .withColumn("other", F.explode(others))
             .select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "hashes"))
    return (cells.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
            .mapInArrow(lean(lambda batches: compare_cells(batches, similarity)), "a long, b long"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, size: int = SHINGLE,
                    similarity: float | None = None) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id reachable), and the root fingerprint of the component.

    Texts are linked if their fingerprints of ``size`` words lie within ``radius`` bits; with a
    ``similarity``, if their sets of shingles have it, and ``fp`` and ``root`` are numbers of sets.

    A null or blank text has fingerprint zero and is linked like any other. A null doc_id is never
    the least; a component of null ids alone has a null component_id. Repeated rows give a row each.
    """
    if similarity is None:
        marked = cut_lineage(docs.select("doc_id", fingerprints(F.col("text"), size).alias("fp")))
        nodes = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
        links = near_links(nodes.select("fp"), radius)
    else:
        signed = cut_lineage(docs.select("doc_id", signatures(F.col("text"), size).alias("s")).select("doc_id", "s.*"))
        marked = signed.select("doc_id", "fp")
        nodes = cut_lineage(signed.groupBy("fp").agg(
            F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("print", "n", "bands")]))
        links = similar_links(docs, nodes, size, radius, similarity)
        nodes = nodes.select("fp", "least")
    links = components(links).withColumnRenamed("node", "fp")
    rooted = nodes.join(links, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = cut_lineage(rooted.select("fp", "root").join(least, "root"))
    return marked.join(classes, "fp").select("doc_id", "fp", "root", "component_id")


def first_of_group(docs: DataFrame, radius: int = RADIUS, size: int = SHINGLE,
                   similarity: float | None = None) -> DataFrame:
    """``docs``, with one document of each component: the one with the least doc_id."""
    classes = cut_lineage(near_duplicates(docs.select("doc_id", "text"), radius, size, similarity))
    kept = classes.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # ids that stand for one row: a join by id alone. Repeated or null ids: by fingerprint, then one row.
    counts = classes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    single = kept.join(counts.filter("n = 1 AND doc_id IS NOT NULL"), "doc_id", "left_semi").select("doc_id")
    repeated = counts.filter("n > 1 OR doc_id IS NULL").select("doc_id")
    names = docs.columns
    plain = docs.join(single, "doc_id", "left_semi")
    if repeated.isEmpty():
        return plain.select(*[F.col(f"`{c}`") for c in names])
    root, number, name = (fresh(docs, f"group_{part}") for part in ("root", "number", "name"))
    roots = kept.join(repeated, kept.doc_id.eqNullSafe(repeated.doc_id), "left_semi").groupBy("fp").agg(
        F.first("root").alias(root)).withColumnRenamed("fp", number)
    rest = docs.join(repeated, docs.doc_id.eqNullSafe(repeated.doc_id), "left_semi").withColumn(
        number, (fingerprints if similarity is None else set_ids)(F.col("text"), size)).join(roots, number)
    marked = rest.join(kept.select(F.col("doc_id").alias(name), F.col("fp").alias(number)).distinct(),
                       number).filter(F.col("doc_id").eqNullSafe(F.col(name))).drop(name)
    one = marked.dropDuplicates([root])
    return plain.select(*[F.col(f"`{c}`") for c in names]).unionByName(one.select(*[F.col(f"`{c}`") for c in names]))
