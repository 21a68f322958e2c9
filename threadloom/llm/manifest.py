"""Merkle manifest of a dataset, with a membership proof for every row, by pointer jumping.

Each row is a leaf. The leaves of a source, by doc_id, form a tree whose runs of three consecutive
nodes have one parent; the roots of the sources, by name, form one more tree of the same kind.

A node first holds the segment of one step: its siblings on the way to its parent. Then the nodes
are joined with themselves: the segment to the ancestor at distance d, followed by that ancestor's
own segment, reaches twice as far. A tree of height h takes log2(h) joins until every leaf holds
the whole way to its root. Only nodes at levels that are multiples of the distance go on.

Nothing depends on how many rows a source has: leaves are numbered in ranges, runs are hashed in
blocks of BLOCK consecutive nodes, five levels at a time, and an ancestor meets its descendants in
blocks too, so that neither a large source nor the way to a root puts many rows into one task.

Defined results: nulls are ``-``, so a null differs from any value; a null source is a source of its
own, before all others, and a null doc_id stands before all others; rows of the same doc_id are in
the order of their leaves, and equal rows are leaves of their own; a null doc_id's remainder is that
of an empty text. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import remainder
from threadloom.operators.ordering import row_number
from threadloom.session import stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RUN = 3
LEVELS = 5
BLOCK = RUN ** LEVELS
POWERS = [RUN ** k for k in range(40)]  # all that a 64-bit number holds


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(*values: Column) -> Column:
    """Digest of the values, each with its length in bytes, so that no two rows read alike."""
    def part(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return digest(F.concat(*map(part, values)))


def power(exponent: Column) -> Column:
    return F.element_at(F.array(*[F.lit(p).cast("long") for p in POWERS]), exponent.cast("int") + 1)


def height(n: Column) -> Column:
    """Levels above the leaves of a tree of ``n`` leaves."""
    return F.size(F.filter(F.array(*[F.lit(p).cast("long") for p in POWERS]), lambda p: p < n))


def up(position: Column, levels: int) -> Column:
    """Position of the ancestor so many levels above."""
    return F.call_function("div", position, F.lit(RUN ** levels).cast("long"))


def below(n: Column, level: Column) -> Column:
    """Nodes of a level of a tree of ``n`` leaves."""
    return F.call_function("div", n + power(level) - 1, power(level))


def parents(nodes: Column) -> Column:
    """Digests of the runs of an array of digests."""
    return F.transform(
        F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / RUN).cast("int")),
        lambda k: digest(F.array_join(F.slice(nodes, k * RUN + 1, F.lit(RUN)), "")))


def step(nodes: Column, at: Column) -> Column:
    """Siblings of one node of an array: how many stand before it, as a byte, and their digests."""
    turn = at % RUN
    before = F.slice(nodes, at - turn + 1, turn)
    after = F.slice(nodes, at + 2, RUN - 1 - turn)
    return F.unhex(F.concat(F.lit("0"), turn.cast("string"), F.array_join(before, ""), F.array_join(after, "")))


def siblings(steps: Column) -> Column:
    """Hex text of all digests of a way, from the leaf up, left to right."""
    return F.aggregate(steps, F.lit(""), lambda text, s: F.concat(text, F.lower(F.hex(F.substring(s, F.lit(2), F.length(s))))))


def folded(start: Column, steps: Column) -> Column:
    """The root that follows from a leaf's digest and its way."""
    def climb(node: Column, s: Column) -> Column:
        before = F.ascii(F.substring(s, F.lit(1), F.lit(1)).cast("string")) * 32
        text = lambda x: F.lower(F.hex(x))
        return digest(F.concat(text(F.substring(s, F.lit(2), before)), node,
                               text(F.substring(s, before + 2, F.length(s)))))

    return F.aggregate(steps, start, climb)


def ranged(df: DataFrame, name: str, *order: str) -> DataFrame:
    """``df`` in ranges of the order, written, with the number of the range as ``bucket``. Rows that are
    equal in it may stand in several ranges."""
    spread = df.withColumn("turn", F.monotonically_increasing_id()).repartitionByRange(*order, "turn")
    return stored(spread.drop("turn").withColumn("bucket", F.spark_partition_id()), name)


def placed(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``leaves(key, doc_id, digest, …)`` with their place ``pos`` among those of their key; and the
    trees: ``key``, its number ``tree`` in their order and its ``n`` leaves."""
    rows = ranged(leaves, "manifest-leaves", "key", "doc_id", "digest")
    order = [F.asc_nulls_first("doc_id"), F.asc("digest")]
    rows = row_number(rows, ["key"], order, F.col("bucket"), "pos").withColumn("pos", F.col("pos") - 1).drop("bucket")
    trees = ranged(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "manifest-trees", "key")
    trees = row_number(trees, [], [F.asc("key")], F.col("bucket"), "tree")
    return rows, stored(trees.select("key", "n", (F.col("tree") - 1).alias("tree")), "manifest-numbers")


def blocks(trees: DataFrame) -> DataFrame:
    """A row per block of BLOCK leaves of each tree."""
    last = up(F.col("n") - 1, LEVELS)
    return trees.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last)))


def gathered(rows: DataFrame, *payload: str) -> DataFrame:
    """Nodes ``(tree, n, pos, digest)`` by block, in order, as ``members``."""
    member = F.struct("pos", "digest", *payload)
    return rows.groupBy("tree", up(F.col("pos"), LEVELS).alias("block")).agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(member)).alias("members"))


def hashed(level: int, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From ``rows(tree, n, block, members)``, each the consecutive nodes of one block at a level: the
    nodes of LEVELS levels from there on, those that go on above, and the roots of trees that end here."""
    rows = rows.withColumn("h", height(F.col("n"))).withColumn("a0", F.transform("members", lambda m: m["digest"]))
    for k in range(LEVELS):
        rows = rows.withColumn(f"a{k + 1}", F.when(F.col("h") > level + k, parents(F.col(f"a{k}"))))
    rows = stored(rows, "manifest-blocks")

    def members(k: int) -> Column:
        nodes, inner = F.col(f"a{k}"), F.col("h") > level + k
        row = F.get("members", F.lit(0)) if k else None
        return F.when(inner | F.lit(level + k == 0), F.transform(nodes, lambda _, at: F.struct(
            F.lit(level + k).alias("level"), (F.col("block") * RUN ** (LEVELS - k) + at).alias("pos"),
            F.when(inner, step(nodes, at)).alias("step"),
            (F.when(F.lit(False), row) if k else F.get("members", at)).alias("row"))))

    nodes = rows.select("tree", "n", "h", F.explode(F.flatten(F.array_compact(F.array(*map(members, range(LEVELS)))))).alias("m"))
    above = rows.filter(F.col("h") > level + LEVELS).select(
        "tree", "n", F.col("block").alias("pos"), F.get(f"a{LEVELS}", F.lit(0)).alias("digest"))
    ends = (F.col("h") <= level + LEVELS) & ((F.col("h") > level) | F.lit(level == 0))
    top = F.element_at(F.array(*[F.col(f"a{k}") for k in range(LEVELS + 1)]), F.col("h") - level + 1)
    roots = rows.filter(ends).select("tree", "n", F.get(top, F.lit(0)).alias("digest"))
    return nodes.select("tree", "n", "h", "m.*"), above, roots


def grown(leaves: DataFrame, highest: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of the trees whose leaves are the members of ``leaves``, each leaf with its member as
    ``row``; and the trees' roots. No tree is higher than ``highest``."""
    nodes, above, roots = hashed(0, leaves)
    for level in range(LEVELS, highest, LEVELS):
        some, above, ended = hashed(level, gathered(above))
        nodes = nodes.unionByName(some.withColumn("row", F.lit(None).cast(nodes.schema["row"].dataType)))
        roots = roots.unionByName(ended)
    return nodes, roots


def jumped(nodes: DataFrame, highest: int) -> DataFrame:
    """The leaves with all ``steps`` to the root of their tree."""
    nodes = nodes.withColumn("steps", F.array_compact(F.array("step"))).drop("step")
    distance = 1
    while distance < highest:
        first = F.col("pos") * RUN ** distance
        last = F.least(first + RUN ** distance, below(F.col("n"), F.col("level") - distance)) - 1
        ancestors = nodes.filter(F.col("level") % (2 * distance) == distance).select(
            "tree", (F.col("level") - distance).alias("level"), F.col("pos").alias("ancestor"),
            F.explode(F.sequence(up(first, LEVELS), up(last, LEVELS))).alias("block"), F.col("steps").alias("more"))
        lower, short = nodes.filter(F.col("level") % (2 * distance) == 0), F.col("level") + distance < F.col("h")
        longer = lower.filter(short).withColumn("ancestor", up(F.col("pos"), distance)).withColumn(
            "block", up(F.col("pos"), LEVELS)).join(ancestors, ["tree", "level", "ancestor", "block"])
        nodes = lower.filter(~short).unionByName(
            longer.withColumn("steps", F.concat("steps", "more")).select(*nodes.columns))
        distance *= 2
        if distance < highest:
            nodes = stored(nodes, "manifest-steps")
    return nodes.filter("level = 0")


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root and ``steps`` of every document; and ``other``, the leaf of the
    document as it is looked at, where it was tampered with: a document whose id's crc32 is even has
    lost the line feeds of its text."""
    fields = [F.col(name) for name in FIELDS]
    stripped = [*fields[:-1], F.replace(F.col("text"), F.lit("\n"), F.lit(""))]
    key = F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0"))  # null first
    leaves, trees = placed(docs.select(
        key.alias("key"), "doc_id", leaf(*fields).alias("digest"),
        F.when(remainder(F.col("doc_id"), 2) == 0, leaf(*stripped)).alias("other")))
    count, largest = trees.agg(F.count(F.lit(1)), F.max("n")).first()
    highest = [next(k for k, p in enumerate(POWERS) if p >= (n or 0)) for n in (largest, count)]

    member = F.struct("pos", "digest", "doc_id", "other")
    leaves = leaves.groupBy("key", up(F.col("pos"), LEVELS).alias("block")).agg(
        F.sort_array(F.collect_list(member)).alias("members"))
    nodes, subroots = grown(leaves.join(blocks(trees), ["key", "block"]).drop("key"), highest[0])
    ways = jumped(nodes, highest[0])

    tops = subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(count).cast("long").alias("n"),
                           F.col("tree").alias("pos"), "digest", F.col("n").alias("leaves"))
    nodes, root = grown(gathered(tops, "leaves"), highest[1])
    root = root.first()
    tops = blocks(jumped(nodes, highest[1]).select(
        F.col("pos").alias("tree"), F.col("row.leaves").alias("n"), F.col("row.digest").alias("subroot"),
        F.col("steps").alias("more"))).drop("n")
    return ways.withColumn("block", up(F.col("pos"), LEVELS)).join(tops, ["tree", "block"]).select(
        "row.doc_id", F.col("row.digest").alias("leaf"), "subroot",
        F.lit(root["digest"] if root else None).cast("string").alias("root"),
        F.concat("steps", "more").alias("steps"), "row.other")


def verified(docs: DataFrame) -> DataFrame:
    """Every document's proof, and whether it holds for the document as it is looked at."""
    root = folded(F.coalesce("other", "leaf"), F.col("steps"))
    return manifest(docs).select(
        "doc_id", "leaf", "subroot", "root", digest(siblings(F.col("steps"))).alias("proof_sha256"),
        root.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
