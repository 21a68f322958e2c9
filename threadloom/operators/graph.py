"""Scoring over the reply graph. Edges: ``src, dst, kind``."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom import fixed_values as fv
from threadloom.operators.dense import Best, cosine
from threadloom.operators.ranking import ranked, top_k
from threadloom.session import BROADCAST_LIMIT_BYTES, cut_lineage, sent, stored

EDGE_BYTES = 16  # of one edge in a task that walks: two places and a chance


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, as often as it is there; an edge is read once."""
    others = [c for c in edges.columns if c not in ("src", "dst")]
    ways = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.select(F.explode(ways).alias("way"), *others).select("way.*", *others)


def leaving(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that begin at ``nodes(doc_id)``, which are few: the others are dropped where they are read, before any
    grouping."""
    return edges.join(sent(nodes.select(F.col("doc_id").alias("src")).distinct()), "src", "left_semi")


def neighbour_blend(candidates: DataFrame, edges: DataFrame, queries: DataFrame,
                    vectors: DataFrame, own: float = 0.6, near: float = 0.4) -> DataFrame:
    """0.6 · similarity of a candidate + 0.4 · mean similarity of its neighbours.

    Only candidates' neighbours are scored. Without neighbours the mean is 0.
    """
    candidates = cut_lineage(candidates)
    links = stored(leaving(both_ways(edges.select("src", "dst")), candidates).distinct(), "graph-links")
    near_pairs = candidates.select("query_id", "doc_id").join(
        links, F.col("doc_id") == F.col("src")).select("query_id", "doc_id", "dst")
    near_vectors = vectors.select(F.col("doc_id").alias("dst"), F.col("vec").alias("vec_b")).join(
        sent(links.select("dst").distinct()), "dst", "left_semi")
    scored = (
        near_pairs.join(near_vectors, "dst")
        .join(queries.select("query_id", F.col("query_vec").alias("vec_a")), "query_id")
        .groupBy("query_id", "doc_id").agg(F.avg(cosine(F.col("vec_a"), F.col("vec_b"))).alias("mean")))
    blended = F.round(own * F.col("score") + near * F.coalesce("mean", F.lit(0.0)), 6)
    return ranked(candidates.select("query_id", "doc_id", "score")
                  .join(scored, ["query_id", "doc_id"], "left")
                  .select("query_id", "doc_id", blended.alias("score")), "query_id")


def with_priors(edges: DataFrame) -> DataFrame:
    prior = F.lit(None).cast("double")
    for kind, value in reversed(fv.EDGE_PRIORS):
        prior = F.when(F.col("kind") == kind, value).otherwise(prior)
    return edges.withColumn("prior", prior)


def hop_expand(seeds: DataFrame, edges: DataFrame, hops: int = 2, decay: float = fv.HOP_DECAY,
               k: int = 50) -> DataFrame:
    """The k nodes per query with the best score over all paths of at most ``hops`` edges from a seed.

    Scores shrink along a path, so a node outside the best k so far leads to none of the best k and
    goes no further. After each hop a node keeps its best score only.
    """
    ways = both_ways(with_priors(edges).select("src", "dst", "prior"))
    best = cut_lineage(top_k(seeds.select("query_id", "doc_id", "score", F.lit(0).alias("hop")), k))
    for hop in range(1, hops + 1):
        front = best.filter(F.col("hop") == hop - 1)
        links = leaving(ways, front).groupBy("src", "dst").agg(F.max("prior").alias("prior"))
        reached = (
            front.join(links, F.col("doc_id") == F.col("src"))
            .select("query_id", F.col("dst").alias("doc_id"), (F.col("score") * decay * F.col("prior")).alias("score"),
                    F.lit(hop).alias("hop")))
        both = best.drop("rank").unionByName(reached).groupBy("query_id", "doc_id").agg(
            F.max(F.struct("score", -F.col("hop"))).alias("b"))
        best = cut_lineage(top_k(both.select("query_id", "doc_id", "b.score", (-F.col("b.col2")).alias("hop")), k))
    return ranked(best.select("query_id", "doc_id", F.round("score", 6).alias("score")), "query_id")


def _home(seeds: DataFrame) -> DataFrame:
    """Chances of each start ``query_id, doc_id, home``."""
    total = seeds.groupBy("query_id").agg(F.sum("score").alias("total"))
    return seeds.join(total, "query_id").select("query_id", "doc_id", (F.col("score") / F.col("total")).alias("home"))


def _best_prior(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.max("prior").alias("prior"))


def _steps(edges: DataFrame) -> DataFrame:
    """Chances of each step ``src, dst, p``."""
    links = stored(_best_prior(edges), "graph-links")
    out = links.groupBy("src").agg(F.sum("prior").alias("out"))
    return stored(links.join(out, "src").select("src", "dst", (F.col("prior") / F.col("out")).alias("p")), "graph-steps")


def reachable(starts: DataFrame, edges: DataFrame, hops: int, limit: int) -> DataFrame | None:
    """``src, dst, prior`` of all edges that leave a node at most ``hops - 1`` edges from ``starts(doc_id)``, each node looked
    up once. None if there are more than ``limit`` of them, or one without a prior."""
    front, parts, count = stored(starts.select("doc_id").distinct(), "graph-nodes"), [], 0
    seen = front
    for _ in range(hops):
        links = stored(_best_prior(leaving(edges, front)), "graph-links")
        n, known = links.agg(F.count(F.lit(1)), F.count("prior")).first()
        if n == 0:
            break
        count += n
        if known < n or count > limit:
            return None
        parts.append(links)
        new = links.select(F.col("dst").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
        front = stored(new.join(sent(seen), "doc_id", "left_anti"), "graph-nodes")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return reduce(DataFrame.unionByName, parts) if parts else edges.select("src", "dst", "prior").limit(0)


def _walked(home: DataFrame, links: DataFrame, walk: Callable, k: int) -> DataFrame:
    """The k best nodes per query by ``walk(home, src, dst, p)``, which gives the mass of each node and which of them were
    reached. The links that can be reached go to every task; a task walks for one query after the other."""
    kind = home.schema["doc_id"].dataType.simpleString()
    spark, table = home.sparkSession, links.toArrow()
    ends = pa.chunked_array([*table["src"].chunks, *table["dst"].chunks], type=table["src"].type)
    nodes = pc.unique(ends).sort() if len(ends) else pa.array([], type=ends.type)
    place = lambda c: pc.index_in(c, value_set=nodes).to_numpy().astype(np.int32)
    src, dst, prior = place(table["src"]), place(table["dst"]), table["prior"].to_numpy()
    p = prior / np.bincount(src, weights=prior, minlength=len(nodes))[src] if len(src) else prior
    shared = spark.sparkContext.broadcast((nodes, src, dst, p))

    def best_of(query: pa.Table) -> pa.Table:
        nodes, src, dst, p = shared.value
        ids, home = query["doc_id"].combine_chunks(), query["home"].to_numpy()
        alone = pc.unique(ids.filter(pc.invert(pc.is_in(ids, value_set=nodes))))  # without an edge
        names = pa.concat_arrays([nodes.cast(alone.type), alone])
        at = pc.index_in(ids, value_set=names).to_numpy()
        mass, reached = walk(at, home, src, dst, p, len(names))
        place = np.flatnonzero(reached)
        by_id = pc.sort_indices(names, null_placement="at_start")
        order = np.empty(len(names), dtype=np.int64)  # ties go to the lower id
        order[by_id.to_numpy()] = np.arange(len(names))
        best = Best(1, k, None)
        best.offer(0, order[place], np.round(mass[place], 6))
        first, scores = best.kept[0]
        return pa.table({"query_id": pa.repeat(query["query_id"][0], len(first)), "doc_id": names.take(by_id.take(pa.array(first))),
                         "score": scores})

    spread = home.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "query_id")
    return spread.groupBy("query_id").applyInArrow(
        best_of, f"query_id {home.schema['query_id'].dataType.simpleString()}, doc_id {kind}, score double")


def _ranked_walk(seeds: DataFrame, edges: DataFrame, rounds: int, k: int, walk: Callable,
                 by_joins: Callable[[DataFrame, DataFrame], DataFrame], limit: int) -> DataFrame:
    """Top k per query: by walks inside tasks if the edges that seeds lead to are within ``limit`` bytes, else by joins."""
    home, priors = cut_lineage(_home(seeds)), with_priors(edges).select("src", "dst", "prior")
    plain = home.filter("home IS NULL OR NOT home > 0").isEmpty()
    links = reachable(home, priors, rounds, limit // EDGE_BYTES) if plain else None
    if links is None:
        return top_k(by_joins(home, _steps(priors)), k)
    return top_k(_walked(home, links, walk, k), k)


def pushed_pagerank(seeds: DataFrame, edges: DataFrame, bound: float = 0.05, restart: float = 0.15, k: int = 50,
                    rounds: int = 200, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Personalised PageRank by local pushes: the k best nodes per query.

    A node's residual is the mass that has reached it and not gone on yet. In a round, nodes with a residual over a
    limit keep the restart's share as their score and pass on the rest; sinks pass it to the query's seeds. Nodes
    below the limit wait, so the frontier stays near the seeds however large the graph is. A query is done when its
    residuals sum up to at most ``bound``: no score is short of the full one by more, nor are all of them together.
    The limit follows from what is left: a tenth of the mean residual of the query's nodes, so each round passes on nine
    tenths of it at least.
    """
    def walk(at: np.ndarray, start: np.ndarray, src: np.ndarray, dst: np.ndarray, p: np.ndarray,
             n: int) -> tuple[np.ndarray, np.ndarray]:
        home = np.bincount(at, weights=start, minlength=n)
        left, mass, held, rows = home.copy(), np.zeros(n), home > 0, len(at)
        has_out = np.bincount(src, minlength=n) > 0
        for _ in range(rounds):
            total = left.sum()
            if not total > bound:
                break
            go = (left > 0) & (left >= 0.1 * total / rows)
            passed = np.where(go, left, 0.0)
            mass += restart * passed
            onward = (1 - restart) * passed
            reached = np.bincount(dst, weights=onward[src] * p, minlength=n)
            left = np.where(go, 0.0, left) + reached + home * onward[~has_out].sum()
            held |= reached > 0
            rows = held.sum()
        return mass, held

    def by_joins(home: DataFrame, step: DataFrame) -> DataFrame:
        has_out = step.select(F.col("src").alias("doc_id")).distinct()
        held = home.select("query_id", "doc_id", F.lit(0.0).alias("mass"), F.col("home").alias("left"))
        for _ in range(rounds):
            state = held.groupBy("query_id").agg(F.sum("left").alias("total"), F.avg("left").alias("mean"))
            open_ = state.filter(F.col("total") > bound)
            if open_.isEmpty():
                break
            ready = held.join(open_, "query_id", "left").withColumn(
                "go", F.coalesce((F.col("total") > bound) & (F.col("left") > 0) & (F.col("left") >= 0.1 * F.col("mean")), F.lit(False)))
            pushed = ready.filter("go").select("query_id", "doc_id", ((1 - restart) * F.col("left")).alias("left"))
            kept = ready.select("query_id", "doc_id", F.when(F.col("go"), F.col("mass") + restart * F.col("left")).otherwise(
                F.col("mass")).alias("mass"), F.when(F.col("go"), 0.0).otherwise(F.col("left")).alias("left"))
            onward = pushed.join(step, pushed["doc_id"] == step["src"]).select(
                "query_id", F.col("dst").alias("doc_id"), (F.col("left") * F.col("p")).alias("left"))
            sunk = pushed.join(has_out, "doc_id", "left_anti").groupBy("query_id").agg(F.sum("left").alias("sunk"))
            back = home.join(sunk, "query_id").select("query_id", "doc_id", (F.col("home") * F.col("sunk")).alias("left"))
            moved = onward.unionByName(back).withColumn("mass", F.lit(0.0)).select("query_id", "doc_id", "mass", "left")
            held = cut_lineage(kept.unionByName(moved).groupBy("query_id", "doc_id").agg(
                F.sum("mass").alias("mass"), F.sum("left").alias("left")))
        return held.select("query_id", "doc_id", F.round("mass", 6).alias("score"))

    return _ranked_walk(seeds, edges, rounds, k, walk, by_joins, limit)


def personalised_pagerank(seeds: DataFrame, edges: DataFrame, iterations: int = 20,
                          restart: float = 0.15, k: int = 50, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """The k nodes per query with most personalised PageRank, restarting at its seeds; sinks return
    to them too."""
    def walk(at: np.ndarray, start: np.ndarray, src: np.ndarray, dst: np.ndarray, p: np.ndarray,
             n: int) -> tuple[np.ndarray, np.ndarray]:
        home = np.bincount(at, weights=start, minlength=n)
        mass = home
        for _ in range(iterations):
            moved = np.bincount(dst, weights=mass[src] * p, minlength=n)
            mass = (1 - restart) * moved + home * (restart + (1 - restart) * (1 - moved.sum()))
        return mass, (mass > 0) | (home > 0)

    def by_joins(home: DataFrame, step: DataFrame) -> DataFrame:
        rank = home.withColumnRenamed("home", "mass")
        for _ in range(iterations):
            # read twice below, so the plan would double in each round
            moved = stored(rank.join(step, rank["doc_id"] == step["src"])
                           .groupBy("query_id", F.col("dst").alias("doc_id"))
                           .agg(F.sum(F.col("mass") * F.col("p")).alias("mass")), "graph-moved")
            kept = moved.groupBy("query_id").agg(F.sum("mass").alias("kept"))
            lost = home.join(kept, "query_id", "left").select(
                "query_id", "doc_id",
                (F.col("home") * (restart + (1 - restart) * (1 - F.coalesce("kept", F.lit(0.0))))).alias("mass"))
            rank = (moved.withColumn("mass", F.col("mass") * (1 - restart)).unionByName(lost)
                    .groupBy("query_id", "doc_id").agg(F.sum("mass").alias("mass")))
        return rank.select("query_id", "doc_id", F.round("mass", 6).alias("score"))

    return _ranked_walk(seeds, edges, iterations, k, walk, by_joins, limit)


def reply_context(messages: DataFrame) -> DataFrame:
    """Per message: number of children, number of ancestors, and the topmost one (itself without any).

    Each round doubles how far every message looks up, so a thread of depth n takes log2(n) rounds
    of one join. A parent that is no message ends the chain. Messages in a circle of parents have no
    top; they keep the last one seen when all others have ended.
    """
    children = (messages.filter(F.col("parent_id") != "").groupBy(F.col("parent_id").alias("msg_id"))
                .agg(F.count(F.lit(1)).alias("children")))
    known = messages.select(F.col("msg_id").alias("up")).distinct()
    links = cut_lineage(messages.select("msg_id", F.col("parent_id").alias("up")).join(known, "up")
                        .groupBy("msg_id").agg(F.min("up").alias("up")).withColumn("steps", F.lit(1).cast("long")))
    rounds = max(1, links.count()).bit_length()
    for _ in range(rounds):
        further = links.select(F.col("msg_id").alias("up"), F.col("up").alias("above"), F.col("steps").alias("more"))
        jumped = cut_lineage(links.join(further, "up", "left"))
        links = jumped.select("msg_id", F.coalesce("above", "up").alias("up"),
                              (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
        if jumped.filter("above IS NOT NULL").isEmpty():
            break
    top = links.select("msg_id", F.col("up").alias("top"), F.col("steps").alias("ancestors"))
    return (messages.select("msg_id", "parent_id", "thread_id")
            .join(children, "msg_id", "left").join(top, "msg_id", "left")
            .select("msg_id", "parent_id", "thread_id", F.coalesce("children", F.lit(0)).alias("children"),
                    F.coalesce("ancestors", F.lit(0)).alias("ancestors"), F.coalesce("top", "msg_id").alias("top")))
