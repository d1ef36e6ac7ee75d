"""Communities by local moving and label propagation.

Both are synchronous and distributed by default; the sequential modes visit
vertices in one fixed order and run in one task.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.algo.graph import closed_wedges, dense_order, oriented, simple, vertices
from graphloom.scratch import cut, loop_partitions, materialise


def _supported(edges: DataFrame) -> DataFrame:
    """``v``, ``o``, ``w`` in both directions; ``w`` is 1 plus the common neighbours, counted from oriented triangles."""
    both = materialise(simple(edges), "both")
    closed = closed_wedges(materialise(oriented(both), "oriented"))
    sides = closed.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("a").alias("x"), F.col("c").alias("y")), F.struct(F.col("b").alias("x"), F.col("c").alias("y")))).alias("s"))
    common = sides.groupBy("s.x", "s.y").agg(F.count("*").alias("n")).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "n")
    return both.join(common, (F.least("v", "o") == F.col("x")) & (F.greatest("v", "o") == F.col("y")), "left").select("v", "o", (1 + F.coalesce("n", F.lit(0))).alias("w"))


def lpa(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """Synchronous label propagation; a neighbour weighs 1 plus the common neighbours, ties go to the least label."""
    links = materialise(_supported(edges), "links")
    with loop_partitions(edges.sparkSession, links.count()) as parts:
        links = links.repartition(parts, "o").persist()
        state = cut(vertices(edges).select("v", F.col("v").alias("l")))
        for _ in range(rounds):
            votes = links.join(state.select(F.col("v").alias("o"), "l"), "o").groupBy("v", "l").agg(F.sum("w").alias("w"))
            best = votes.groupBy("v").agg(F.max_by("l", F.struct("w", -F.col("l"))).alias("new"))
            state = cut(state.join(best, "v", "left").select("v", F.coalesce("new", "l").alias("l"), (F.col("new") != F.col("l")).alias("moved")))
            if state.where("moved").isEmpty():
                break
            state = state.drop("moved")
        links.unpersist()
    return state.select(F.col("v").alias("vertex_id"), F.col("l").alias("community_id"))


def louvain(edges: DataFrame, rounds: int = 10, seed: int = 5) -> DataFrame:
    """One level of modularity moving on the simple undirected graph.

    In each round a seeded half of the vertices moves, so that neighbours do
    not swap for ever; ties go to the least community.
    """
    with loop_partitions(edges.sparkSession, 2 * edges.count()) as parts:
        return _moved(edges, rounds, seed, parts)


def _moved(edges: DataFrame, rounds: int, seed: int, parts: int) -> DataFrame:
    both = materialise(simple(edges), "both").repartition(parts, "o").persist()
    m2 = both.count()
    nodes = vertices(edges).join(both.groupBy("v").agg(F.count("*").alias("k")), "v", "left").select("v", F.coalesce("k", F.lit(0)).alias("k"))
    state = cut(nodes.select("v", "k", F.col("v").alias("c")))
    quiet = 0
    for i in range(2 * rounds):
        total = state.groupBy("c").agg(F.sum("k").alias("tot"))
        around = both.join(state.select(F.col("v").alias("o"), "c"), "o").groupBy("v", "c").agg(F.count("*").alias("k_in"))
        own = state.select("v", "c", F.lit(0).cast("bigint").alias("k_in"))
        offers = around.unionByName(own).groupBy("v", "c").agg(F.sum("k_in").alias("k_in"))
        offers = offers.join(state.select("v", "k", F.col("c").alias("mine")), "v").join(total, "c")
        gain = F.col("k_in") - (F.col("tot") - F.when(F.col("c") == F.col("mine"), F.col("k")).otherwise(0)) * F.col("k") / F.lit(float(max(m2, 1)))
        best = offers.groupBy("v").agg(F.max_by("c", F.struct(F.round(gain, 9), F.col("c") == F.col("mine"), -F.col("c"))).alias("new"))
        turn = F.pmod(F.xxhash64("v", F.lit(seed + i // 2)) + i, F.lit(2)) == 0
        state = cut(state.join(best, "v").select("v", "k", F.when(turn, F.col("new")).otherwise(F.col("c")).alias("c"), (turn & (F.col("new") != F.col("c"))).alias("moved")))
        quiet = quiet + 1 if state.where("moved").isEmpty() else 0
        if quiet == 2:
            break
        state = state.drop("moved")
    both.unpersist()
    return state.select(F.col("v").alias("vertex_id"), F.col("c").alias("community_id"))


def _in_order(edges: DataFrame, pass_over, schema: str) -> DataFrame:
    """Run a sequential pass over the whole graph in one task, vertices numbered by first appearance.

    The order in which vertices are visited decides the result, so there is
    nothing to distribute; the graph must fit one task.
    """
    order = dense_order(edges)
    a, b = order.select(F.col("v").alias("src"), F.col("i").alias("a")), order.select(F.col("v").alias("dst"), F.col("i").alias("b"))
    pairs = edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").select(F.lit(0).alias("one"), "src", "dst", "a", "b")

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(max(pdf["a"].max(), pdf["b"].max())) + 1
        ids = np.empty(n, np.int64)
        ids[pdf["a"]], ids[pdf["b"]] = pdf["src"], pdf["dst"]
        around: list[set[int]] = [set() for _ in range(n)]
        for x, y in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            if x != y:
                around[x].add(y)
                around[y].add(x)
        return pd.DataFrame({"vertex_id": ids, "community_id": pass_over(ids.tolist(), [sorted(s) for s in around])})

    return pairs.groupBy("one").applyInPandas(whole, schema)


def lpa_sequential(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """Label propagation that visits vertices one by one and uses new labels at once; in one task."""
    def spread(ids: list[int], around: list[list[int]]) -> list[int]:
        label = list(ids)
        sets = [set(x) for x in around]
        for _ in range(rounds):
            moved = False
            for u, near in enumerate(around):
                votes: Counter[int] = Counter()
                for v in near:
                    votes[label[v]] += 1 + len(sets[u] & sets[v])
                if votes:
                    best = min(votes, key=lambda c: (-votes[c], c))
                    moved |= best != label[u]
                    label[u] = best
            if not moved:
                break
        return label

    return _in_order(edges, spread, "vertex_id bigint, community_id bigint")


def louvain_sequential(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """One level of modularity moving, vertex by vertex; a community is called by the number of a vertex; in one task."""
    def settle(_: list[int], around: list[list[int]]) -> list[int]:
        home = list(range(len(around)))
        degree = [len(x) for x in around]
        weight = [float(d) for d in degree]
        both = float(sum(degree))
        for _round in range(rounds if both else 0):
            moved = False
            for u, near in enumerate(around):
                if not near:
                    continue
                shared = Counter(home[v] for v in near)
                weight[home[u]] -= degree[u]
                gain = lambda c: shared[c] - weight[c] * degree[u] / both  # noqa: E731, B023
                best, top = home[u], gain(home[u])
                for c in shared:
                    g = gain(c)
                    if c != home[u] and (g > top + 1e-12 or (abs(g - top) <= 1e-12 and c < best)):
                        best, top = c, g
                weight[best] += degree[u]
                moved |= best != home[u]
                home[u] = best
            if not moved:
                break
        return home

    return _in_order(edges, settle, "vertex_id bigint, community_id bigint")


def modularity(edges: DataFrame, communities: DataFrame) -> float:
    """Modularity of a division of the simple undirected graph."""
    both = simple(edges)
    c = communities.select(F.col("vertex_id").alias("v"), "community_id")
    m2 = both.count()
    if not m2:
        return 0.0
    inside = both.join(c, "v").join(c.select(F.col("v").alias("o"), F.col("community_id").alias("other")), "o").where("community_id = other").count()
    tot = both.join(c, "v").groupBy("community_id").agg(F.count("*").alias("d")).agg(F.sum((F.col("d") / m2) ** 2)).first()[0]
    return inside / m2 - tot
