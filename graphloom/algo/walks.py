"""Vertex embeddings from biased second-order random walks.

All walks advance together: a step joins the ends of the walks with the
adjacency, weighs each next vertex by where it lies as seen from the vertex
before (back 1/p, beside 1, farther 1/q), and draws one by the smallest
exponential variate, which one aggregation finds.  Draws are hashes of seed,
walk and step, so a lost task draws the same again.

Embeddings start as seeded unit vectors.  In every pass a vertex is pulled
towards the mean of the vertices seen within ``window`` steps of it, weighted
by how often, and scaled to length 1 again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.algo.graph import vertices
from graphloom.scratch import cut, materialise

WINDOW = 3


def _uniform(*parts: Column | int) -> Column:
    """A draw from (0, 1) that depends on its arguments only."""
    return (F.shiftrightunsigned(F.xxhash64(*(F.lit(p) if isinstance(p, int) else p for p in parts)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def walks(edges: DataFrame, length: int = 10, per_vertex: int = 10, p: float = 1.0, q: float = 1.0, seed: int = 11) -> DataFrame:
    """``walk``, ``step``, ``v``: ``per_vertex`` walks from every vertex along out-edges; a walk ends where there are none."""
    back, far = (1 / x if x > 0 else 1.0 for x in (p, q))
    links = materialise(edges.select("src", "dst").distinct(), "links")
    spread = F.explode(F.sequence(F.lit(0), F.lit(per_vertex - 1)))
    state = vertices(edges).select("v", spread.alias("k")).select(F.xxhash64("v", "k").alias("h"), F.struct("v", "k").alias("walk"), F.lit(None).cast("bigint").alias("before"), "v")
    state = cut(state)
    out = [state.select("walk", F.lit(0).alias("step"), "v")]
    known = links.select(F.col("src").alias("before"), F.col("dst").alias("next"), F.lit(True).alias("beside"))
    for step in range(1, length):
        ahead = state.join(links.select(F.col("src").alias("v"), F.col("dst").alias("next")), "v")
        if (back, far) != (1.0, 1.0):
            ahead = ahead.join(known, ["before", "next"], "left")
            weight = F.when(F.col("before").isNull(), 1.0).when(F.col("next") == F.col("before"), back).when(F.col("beside"), 1.0).otherwise(far)
        else:
            weight = F.lit(1.0)
        draw = -F.log(_uniform(F.col("h"), F.col("next"), step, seed)) / weight
        state = cut(ahead.groupBy("walk", "h", "v").agg(F.min_by("next", F.struct(draw, F.col("next"))).alias("next")).select("h", "walk", F.col("v").alias("before"), F.col("next").alias("v")))
        if state.isEmpty():
            break
        out.append(state.select("walk", F.lit(step).alias("step"), "v"))
    rows = out[0]
    for o in out[1:]:
        rows = rows.unionByName(o)
    return rows


def node2vec(edges: DataFrame, dimensions: int = 64, length: int = 10, per_vertex: int = 10, p: float = 1.0, q: float = 1.0, passes: int = 3, rate: float = 0.5, seed: int = 11) -> DataFrame:
    """``vertex_id`` and ``embedding``, an array of ``dimensions`` numbers of length 1, for every vertex."""
    if min(dimensions, length, per_vertex) < 1:
        return edges.sparkSession.createDataFrame([], "vertex_id bigint, embedding array<double>")
    seen = walks(edges, length, per_vertex, p, q, seed)
    path = seen.groupBy("walk").agg(F.transform(F.sort_array(F.collect_list(F.struct("step", "v"))), lambda x: x["v"]).alias("path"))  # at most ``length`` values
    spots = path.select("path", F.posexplode("path").alias("i", "v"))
    near = spots.select("v", F.explode(F.slice("path", F.greatest(F.col("i") + 1 - WINDOW, F.lit(1)), F.least(F.col("i"), F.lit(WINDOW)) + 1 + WINDOW)).alias("o")).where("v <> o")
    pairs = materialise(near.groupBy("v", "o").agg(F.count("*").cast("double").alias("n")), "pairs")
    length_of = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, y: s + y * y))
    unit = lambda x: F.transform(x, lambda y: y / F.greatest(length_of(x), F.lit(1e-12)))
    start = F.transform(F.sequence(F.lit(1), F.lit(dimensions)), lambda i: 2 * _uniform(F.col("v"), i, seed) - 1)
    state = cut(vertices(edges).select("v", start.alias("e")).select("v", unit(F.col("e")).alias("e")))
    for _ in range(passes):
        pulled = pairs.join(state.withColumnRenamed("v", "o"), "o")
        sums = pulled.groupBy("v").agg(F.array(*(F.sum(F.col("e")[i] * F.col("n")) for i in range(dimensions))).alias("pull"))
        mixed = F.zip_with("e", unit(F.col("pull")), lambda a, b: (1 - rate) * a + rate * b)
        state = cut(state.join(sums, "v", "left").select("v", F.when(F.col("pull").isNull(), F.col("e")).otherwise(mixed).alias("e")).select("v", unit(F.col("e")).alias("e")))
    return state.select(F.col("v").alias("vertex_id"), F.col("e").alias("embedding"))
