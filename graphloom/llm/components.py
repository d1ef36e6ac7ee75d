"""Groups of records that pairwise matches link directly or indirectly.

Low-diameter decomposition: every vertex draws an exponentially distributed
shift, starts a cluster at ``ceiling - shift`` unless an earlier cluster has
reached it, and clusters grow one hop per unit of time.  Their radius is
O(log n / beta) whatever the diameter of the graph.  Clusters contract to
super-vertices, the edges between clusters go to the next level, and when none
is left the assignments of all levels are composed.

A vertex with very many matches is first split into several, each with a part
of the matches and one match to the vertex itself; this leaves the groups as
they are and bounds the rows of one key.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.scratch import cut, loop_partitions, materialise

HUB = 20_000  # matches of one vertex beyond which it is split
_STEPS = 3  # hops between two checks for the end of growth


def split_hubs(both: DataFrame, hub: int) -> tuple[DataFrame, int | None]:
    """Edges ``v``, ``o`` (both directions) with hubs split, and the least id of the vertices added.

    ``hub`` is raised where needed so that fewer than 100,000 vertices are hubs.
    """
    n, least, greatest = both.agg(F.count("*"), F.min("v"), F.max("v")).first()
    hub = max(hub, (n or 0) // 100_000)
    degrees = both.groupBy("v").agg(F.count("*").alias("d")).where(F.col("d") > hub)
    hubs = sorted((r["v"], r["d"]) for r in degrees.collect())  # at most n / hub rows
    if not hubs:
        return both, None
    parts = [max(2, math.isqrt(d - 1) + 1 if d > hub * hub else -(-d // hub)) for _, d in hubs]
    if greatest + sum(parts) >= 1 << 63:
        return both, None
    base, rows = greatest + 1, []
    for (v, _), m in zip(hubs, parts):
        rows.append((v, base, m))
        base += m
    spark = both.sparkSession
    table = F.broadcast(spark.createDataFrame(rows, "h bigint, base bigint, m int"))  # at most 100,000 rows
    side = lambda own, other: F.coalesce(F.col("base") + F.pmod(F.xxhash64(other), F.col("m")), F.col(own))
    half = both.where("v <= o")
    for own, other in (("v", "o0"), ("o", "v0")):
        if own == "v":
            half = half.withColumns({"v0": F.col("v"), "o0": F.col("o")})
        half = half.join(table, F.col(f"{own}0") == F.col("h"), "left").withColumn(own, side(own, other)).drop("h", "base", "m")
    arms = spark.createDataFrame(rows, "h bigint, base bigint, m int").select(F.col("h").alias("v"), F.explode(F.sequence(F.col("base"), F.col("base") + F.col("m") - 1)).alias("o"))
    half = half.select("v", "o").unionByName(arms)
    return half.unionByName(half.where("v <> o").select(F.col("o").alias("v"), F.col("v").alias("o"))), greatest + 1


def _start(v: Column, seed: int, beta: float, ceiling: float) -> Column:
    """Start time of a vertex; the shift is a seeded exponential draw, at most ``ceiling``."""
    u = (F.shiftrightunsigned(F.xxhash64(v, F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return F.lit(ceiling) - F.least(-F.log(u) / F.lit(beta), F.lit(ceiling))


def _grow(edges: DataFrame, seed: int, beta: float, ceiling: float) -> DataFrame:
    """``v``, ``c``: the cluster centre that reaches each vertex of ``edges`` first.

    ``edges`` (``v``, ``o``, ``w``) is symmetric with one loop of length 0 at
    every vertex, so one join and one aggregation make a hop: the loop carries
    a vertex's own state, and the fastest offer is combined before the shuffle.
    Beside its own state a vertex is sent only what moved in the hop before.
    """
    arrival = F.struct(_start(F.col("v"), seed, beta, ceiling).alias("t"), F.col("v").alias("c"))
    state = edges.where("w = 0").select("v", arrival.alias("s"), F.lit(True).alias("moved"))
    while True:
        for _ in range(_STEPS):
            reached = edges.join(state.withColumnRenamed("v", "o"), "o").where("w = 0 or moved")
            offer = F.struct((F.col("s.t") + F.col("w")).alias("t"), F.col("s.c").alias("c"))
            best = reached.groupBy("v").agg(F.min(offer).alias("s"), F.max(F.when(F.col("w") == 0, F.col("s"))).alias("own"))
            state = best.select("v", "s", (F.col("s") < F.col("own")).alias("moved"))
        state = cut(state)
        if state.where("moved").isEmpty():
            return state.select("v", F.col("s.c").alias("c"))


def group_ids(pairs: DataFrame, a: str, b: str, beta: float = 0.3, seed: int = 7, max_levels: int = 60, hub: int = HUB) -> DataFrame:
    """``vid`` and ``group_id``, the smallest vid of the group, for every end of a pair.

    Pairs with a null end are left out, repeated pairs and direction do not
    matter, a vertex matched only with itself is a group of its own, other
    columns are ignored, and no pairs give no rows.  A vertex with more than
    ``hub`` matches is split, so no key has more rows than that (or than the
    square root of its matches).
    """
    spark = pairs.sparkSession
    ends = pairs.select(F.col(a).cast("bigint").alias("v"), F.col(b).cast("bigint").alias("o")).dropna()
    both = ends.select("v", "o").unionByName(ends.select(F.col("o").alias("v"), F.col("v").alias("o"))).distinct()
    both = materialise(both, "matches")
    edges, added = split_hubs(both, hub)
    edges = edges.where("v <> o") if added is None else materialise(edges.where("v <> o"), "split")
    levels: list[DataFrame] = []
    for level in range(max_levels):
        n = edges.count()
        if not n:
            break
        with loop_partitions(spark, 2 * n) as parts:
            loops = edges.select("v").distinct().select("v", F.col("v").alias("o"), F.lit(0.0).alias("w"))
            hops = edges.select("v", "o", F.lit(1.0).alias("w")).unionByName(loops).repartition(parts, "o").persist(StorageLevel.MEMORY_AND_DISK)
            ceiling = float(max(2, math.ceil(2 * math.log(n + 2) / beta)))  # a draw exceeds it with a chance of about 1/n^2
            assigned = _grow(hops, seed + level, beta, ceiling)
            levels.append(assigned)
            half = edges.where("v < o")
            left = half.join(assigned, "v").select(F.col("c").alias("x"), "o")
            right = left.join(assigned.withColumnsRenamed({"v": "o", "c": "y"}), "o").where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
            between = right.distinct()
            edges = materialise(between.select(F.col("x").alias("v"), F.col("y").alias("o")).unionByName(between.select(F.col("y").alias("v"), F.col("x").alias("o"))), "contracted")
            hops.unpersist()
    else:
        raise RuntimeError("the decomposition did not end")
    # compose from the top: every level maps its vertices to centres, which are vertices of the next
    root: DataFrame | None = None
    for assigned in reversed(levels):
        if root is None:
            root = assigned.select("v", F.col("c").alias("r"))
        else:
            up = root.withColumnsRenamed({"v": "c"})
            root = assigned.join(up, "c", "left").select("v", F.coalesce("r", "c").alias("r"))
    alone = both.where("v = o").select("v", F.col("v").alias("r"))
    if root is None:
        members = alone
    else:
        members = root.unionByName(alone.join(root, "v", "left_anti"))
    members = materialise(members if added is None else members.where(F.col("v") < added), "members")
    least = members.groupBy("r").agg(F.min("v").alias("group_id"))
    return members.join(least, "r").select(F.col("v").alias("vid"), "group_id")
