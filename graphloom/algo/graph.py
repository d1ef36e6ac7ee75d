"""Graph algorithms on edge frames ``src``, ``dst`` (parallel edges are repeated rows).

All are distributed loops: state is keyed by vertex, one join and one
aggregation make a round, and every few rounds the lineage is cut by a
reliable checkpoint.  Vertices are the ends of edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.algo import cores, paths
from graphloom.operators.reach import distances
from graphloom.scratch import cut, loop_partitions, materialise

PEELS = 4  # layers of lone vertices taken off between two colourings
UNREACHABLE = 4294967295  # fixed value: the distance of what cannot be reached


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("v")).unionByName(edges.select(F.col("dst").alias("v"))).distinct()


def simple(edges: DataFrame) -> DataFrame:
    """Undirected simple adjacency ``v``, ``o`` in both directions, without loops."""
    pair = edges.where("src <> dst").select(F.least("src", "dst").alias("v"), F.greatest("src", "dst").alias("o")).distinct()
    return pair.unionByName(pair.select(F.col("o").alias("v"), F.col("v").alias("o")))


def degree(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("v"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("dst").alias("v"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    out = ends.groupBy("v").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return out.select(F.col("v").alias("vertex_id"), "in_degree", "out_degree", (F.col("in_degree") + F.col("out_degree")).alias("total_degree"))


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 20, tolerance: float = 1e-6) -> DataFrame:
    """Ranks that sum to 1; what vertices without out-edges hold is spread evenly.

    A round is one join and one aggregation.  The state carries each vertex's
    share of ``1 / n`` apart from a factor common to all: ranks are kept as
    ``x + base`` with one ``base`` per round, so what is lost at vertices
    without out-edges is known from the sums of the round before.
    """
    edges = materialise(edges.select("src", "dst"), "edges")
    out = edges.groupBy("src").agg(F.count("*").alias("d"))
    nodes = vertices(edges).join(out.withColumnRenamed("src", "v"), "v", "left").select("v", F.col("d").isNull().alias("dangling"))
    nodes = materialise(nodes, "nodes")
    n, n_dangling = nodes.agg(F.count("*"), F.sum(F.col("dangling").cast("long"))).first()
    if not n:
        return edges.sparkSession.createDataFrame([], "vertex_id bigint, score double")
    spark = edges.sparkSession
    # parallel edges become one weighted link, with a loop of weight 0 that carries the vertex itself
    links = edges.groupBy("src", "dst").agg(F.count("*").alias("m")).join(out, "src").select("src", "dst", (F.col("m") / F.col("d")).alias("w"))
    own = nodes.select(F.col("v").alias("src"), F.col("v").alias("dst"), F.lit(0.0).alias("w"))
    with loop_partitions(spark, links.count() + n) as parts:
        links = links.unionByName(own).repartition(parts, "src").persist()
        state = nodes.select("v", "dangling", F.lit(1.0 / n).alias("r"), F.lit(0.0).alias("was")).repartition(parts, "v")
        lost = n_dangling / n
        for i in range(rounds):
            base = (1 - damping) / n + damping * lost / n
            sent = links.join(state.withColumnRenamed("v", "src"), "src")
            loop = (F.col("src") == F.col("dst")) & (F.col("w") == 0)
            state = sent.groupBy(F.col("dst").alias("v")).agg(
                F.max(F.when(loop, F.col("dangling"))).alias("dangling"), (F.lit(base) + damping * F.sum(F.col("w") * F.col("r"))).alias("r"),
                F.max(F.when(loop, F.col("r"))).alias("was"),
            )
            # one pass gives the mass lost in the next round and the change of this one
            state = state.persist()
            lost, moved = state.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("r"))), F.lit(0.0)), F.sum(F.abs(F.col("r") - F.col("was")))).first()
            last = i == rounds - 1 or (tolerance > 0 and moved < tolerance)
            if last or i % 5 == 4:
                kept, state = state, cut(state)
                kept.unpersist()
            if last:
                break
        links.unpersist()
    return state.select(F.col("v").alias("vertex_id"), F.col("r").alias("score"))


def wcc(edges: DataFrame) -> DataFrame:
    """Weakly connected components; the id is the least vertex.

    Rounds of stars, so their number is logarithmic even on long paths: every
    vertex links its greater neighbours to the least vertex around it, then its
    lesser ones; what is left in the end are stars about the least vertices.
    """
    edges = materialise(edges.select("src", "dst"), "edges")
    nodes = vertices(edges)
    spark = edges.sparkSession
    pairs = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    with loop_partitions(spark, 2 * pairs.count()):
        pairs = cut(pairs.distinct())
        before = None
        while True:
            # greater neighbours to the least vertex around
            both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
            around = both.groupBy("u").agg(F.min("v").alias("m"))
            large = both.where("v > u").join(around, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
            # lesser neighbours, and the vertex itself, to the least of them
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
            pairs = cut(small)
            now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if now == before:
                break
            before = now
        found = cut(nodes.join(pairs, F.col("u") == nodes["v"], "left").select(nodes["v"].alias("vertex_id"), F.coalesce(pairs["v"], nodes["v"]).alias("component_id")))
    return found


def scc(edges: DataFrame) -> DataFrame:
    """Strongly connected components by forward and backward colouring; the id is the least vertex.

    In each round the least vertex that reaches a vertex is its colour; those
    that reach the colour back inside it are one component.
    """
    with loop_partitions(edges.sparkSession, 2 * edges.count()):
        return _strong(edges)


def _strong(edges: DataFrame) -> DataFrame:
    left = materialise(edges.where("src <> dst").select("src", "dst").distinct(), "edges")
    rest = materialise(vertices(edges), "vertices")
    spark = edges.sparkSession
    done: list[DataFrame] = []

    def spread(hops: DataFrame, state: DataFrame) -> DataFrame:
        """Least value of ``c`` over all that reach ``v`` by ``a`` to ``b``."""
        while True:
            offers = hops.join(state.select(F.col("v").alias("a"), "c"), "a").groupBy(F.col("b").alias("v")).agg(F.min("c").alias("m"))
            state = cut(state.select("v", "c").join(offers, "v", "left").select("v", F.least("c", "m").alias("c"), (F.col("m") < F.col("c")).alias("moved")))
            if state.where("moved").isEmpty():
                return state.select("v", "c")

    while True:
        # a vertex without an edge in and one out is a component of its own; colouring does what is left after a few layers
        for _ in range(PEELS):
            ends = left.select(F.col("src").alias("v")).distinct().join(left.select(F.col("dst").alias("v")).distinct(), "v")
            lone = materialise(rest.join(ends, "v", "left_anti"), "lone")
            if lone.isEmpty():
                break
            done.append(lone.select("v", F.col("v").alias("c")))
            rest = materialise(rest.join(lone, "v", "left_anti"), "rest")
            keep = rest.select("v")
            left = materialise(left.join(keep.withColumnRenamed("v", "src"), "src", "left_semi").join(keep.withColumnRenamed("v", "dst"), "dst", "left_semi"), "left")
        if rest.isEmpty():
            break
        colour = spread(left.select(F.col("src").alias("a"), F.col("dst").alias("b")), rest.select("v", F.col("v").alias("c")))
        inside = left.join(colour.select(F.col("v").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("v").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd")
        inside = materialise(inside.select("src", "dst"), "inside")
        # backward from each colour's own vertex
        big = F.lit(None).cast("bigint")
        marks = colour.select("v", F.when(F.col("v") == F.col("c"), F.col("c")).otherwise(big).alias("c"))
        hops = inside.select(F.col("dst").alias("a"), F.col("src").alias("b"))
        frontier = marks.where("c is not null")
        seen = frontier
        while True:
            step = frontier.join(hops, F.col("v") == F.col("a")).select(F.col("b").alias("v"), "c").distinct()
            frontier = cut(step.join(seen.select("v"), "v", "left_anti"))
            if frontier.isEmpty():
                break
            seen = cut(seen.unionByName(frontier))
        found = materialise(seen, "component")
        done.append(found.select("v", "c"))
        rest = materialise(rest.join(found, "v", "left_anti"), "rest")
        left = materialise(inside.join(found.select(F.col("v").alias("src")), "src", "left_anti").join(found.select(F.col("v").alias("dst")), "dst", "left_anti"), "left")
    if not done:
        return spark.createDataFrame([], "vertex_id bigint, component_id bigint")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    least = out.groupBy("c").agg(F.min("v").alias("component_id"))
    return cut(out.join(least, "c").select(F.col("v").alias("vertex_id"), "component_id"))


def kcore(edges: DataFrame) -> DataFrame:
    """Coreness as the fixed point of the h-index of the neighbours' values.

    Where the values of all vertices fit in a task they are sent to all; else
    they are joined, and neighbours are counted per vertex and value before
    they are ordered, so a hub is as many rows as its neighbours have values.
    """
    both = materialise(simple(edges), "both")
    nodes = vertices(edges)
    spark = edges.sparkSession
    if dict(both.dtypes)["v"] in ("bigint", "int") and both.agg(F.count_distinct("v")).first()[0] <= cores.VERTICES:
        return nodes.join(cores.coreness(both), "v", "left").select(F.col("v").alias("vertex_id"), F.coalesce("h", F.lit(0)).cast("bigint").alias("coreness"))
    falling = Window.partitionBy("v").orderBy(F.desc("h"))
    with loop_partitions(spark, both.count()) as parts:
        both = both.repartition(parts, "o").persist()
        state = cut(nodes.join(both.groupBy("v").agg(F.count("*").alias("h")), "v", "left").select("v", F.coalesce("h", F.lit(0)).alias("h")))
        while True:
            around = both.join(state.select(F.col("v").alias("o"), "h"), "o").groupBy("v", "h").agg(F.count("*").alias("n"))
            ranked = around.withColumn("i", F.sum("n").over(falling)).groupBy("v").agg(F.max(F.least("h", "i")).alias("new"))
            new = F.coalesce("new", F.lit(0))
            state = cut(state.join(ranked, "v", "left").select("v", F.least(F.col("h"), new).alias("h"), (new < F.col("h")).alias("moved")))
            if state.where("moved").isEmpty():
                both.unpersist()
                return state.select(F.col("v").alias("vertex_id"), F.col("h").alias("coreness"))
            state = state.drop("moved")


def oriented(both: DataFrame) -> DataFrame:
    """``v``, ``o`` from lower to higher degree (ties by id), with the degree ``e`` of ``o``: no vertex has many out-edges."""
    deg = both.groupBy("v").agg(F.count("*").alias("d"))
    tagged = both.join(deg, "v").join(deg.select(F.col("v").alias("o"), F.col("d").alias("e")), "o")
    return tagged.where(F.struct("d", "v") < F.struct("e", "o")).select("v", "o", "e")


def closed_wedges(up: DataFrame) -> DataFrame:
    """``a``, ``b``, ``c`` of every triangle, once, from oriented edges."""
    ac = up.select(F.col("v").alias("a"), F.col("o").alias("c"), F.col("e").alias("ce"))
    wedge = up.select(F.col("v").alias("a"), F.col("o").alias("b"), F.col("e").alias("be")).join(ac, "a").where(F.struct("be", "b") < F.struct("ce", "c"))
    return wedge.join(up.select(F.col("v").alias("b"), F.col("o").alias("c")), ["b", "c"]).select("a", "b", "c")


def triangles(edges: DataFrame) -> DataFrame:
    """Triangles and local clustering; edges are oriented from lower to higher degree, so hubs stay short."""
    both = materialise(simple(edges), "both")
    deg = both.groupBy("v").agg(F.count("*").alias("d"))
    closed = closed_wedges(materialise(oriented(both), "oriented"))
    corners = closed.select(F.explode(F.array("a", "b", "c")).alias("v")).groupBy("v").agg(F.count("*").alias("t"))
    out = vertices(edges).join(deg, "v", "left").join(corners, "v", "left")
    t, d = F.coalesce("t", F.lit(0)), F.coalesce("d", F.lit(0))
    return out.select(F.col("v").alias("vertex_id"), t.alias("triangles"), F.when(d > 1, 2.0 * t / (d * (d - 1))).otherwise(0.0).alias("clustering_coefficient"))


def sssp(edges: DataFrame, source: int = 1, most: int = 1 << 20) -> DataFrame:
    """Hops from ``source``; what it does not reach is at ``UNREACHABLE``."""
    start = edges.sparkSession.createDataFrame([(source,)], "start bigint")
    found = distances(start, edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), most).select(F.col("end").alias("v"), "depth")
    return vertices(edges).join(found, "v", "left").select(F.col("v").alias("vertex_id"), F.coalesce(F.col("depth").cast("bigint"), F.lit(UNREACHABLE)).alias("distance"))


def similarity(edges: DataFrame, a: int = 1, b: int = 2) -> DataFrame:
    """Jaccard and cosine of the sets of out-neighbours of two vertices."""
    out = edges.where(F.col("src").isin(a, b)).select("src", "dst").distinct()
    flags = out.groupBy("dst").agg(F.max((F.col("src") == a).cast("int")).alias("x"), F.max((F.col("src") == b).cast("int")).alias("y"))
    n = flags.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in (("na", F.col("x")), ("nb", F.col("y")), ("both", F.col("x") * F.col("y")))))
    union = F.col("na") + F.col("nb") - F.col("both")
    return n.select(
        F.lit(a).cast("bigint").alias("node1"), F.lit(b).cast("bigint").alias("node2"), F.when(union == 0, 1.0).otherwise(F.col("both") / union).alias("jaccard"),
        F.when((F.col("na") == 0) | (F.col("nb") == 0), 0.0).otherwise(F.col("both") / F.sqrt(F.col("na") * F.col("nb"))).alias("cosine"), F.col("both").alias("common_neighbors"),
    )


def numbered(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` with ``n`` from 1 in the order of the columns ``by``, each range of which is sorted and numbered on its own."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = materialise(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn(" p", F.spark_partition_id()).withColumn(" i", F.monotonically_increasing_id() - F.spark_partition_id().cast("long") * (1 << 33)), "numbered")
    counts = {r[" p"]: r["n"] for r in spread.groupBy(" p").agg(F.count("*").alias("n")).collect()}  # one row a partition
    at, before = [], 0
    for p in sorted(counts):
        at.append((p, before))
        before += counts[p]
    return spread.join(F.broadcast(spark.createDataFrame(at, "` p` int, ` before` bigint")), " p").withColumn("n", F.col(" i") + F.col(" before") + 1).drop(" p", " i", " before")


def dense_order(edges: DataFrame) -> DataFrame:
    """``v`` and ``i``: vertices by first appearance in the edges sorted by source, then type, rank and target."""
    extra = [c for c in ("type", "rank") if c in edges.columns]
    # a source first appears in its own first edge unless it was a target before
    spots = numbered(edges.select("src", *extra, "dst"), "src", *extra, "dst")
    seen = spots.select(F.explode(F.array(F.struct((F.col("n") * 2).alias("p"), F.col("src").alias("v")), F.struct((F.col("n") * 2 + 1).alias("p"), F.col("dst").alias("v")))).alias("x"))
    return numbered(seen.groupBy("x.v").agg(F.min("x.p").alias("p")), "p").select("v", (F.col("n") - 1).alias("i"))


def _sources(edges: DataFrame, pivots: int | None) -> tuple[DataFrame, int, int | None]:
    """All vertices, or ``pivots`` of them evenly spaced in dense order; the number of vertices and of pivots used."""
    nodes = vertices(edges)
    n = nodes.count()
    if pivots is None or n <= pivots:
        return nodes.select(F.col("v").alias("start")), n, None
    at = [i * n // pivots for i in range(pivots)]
    return dense_order(edges).where(F.col("i").isin(at)).select(F.col("v").alias("start")), n, pivots


def closeness(edges: DataFrame, pivots: int | None = None) -> DataFrame:
    """Harmonic closeness over outgoing paths; with ``pivots`` an estimate from the paths to so many vertices."""
    starts, n, used = _sources(edges, pivots)
    hops = materialise(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct(), "hops")
    if paths.fits(hops):
        near = paths.total(hops, starts, paths.nearness)
    else:
        walk = hops if used is None else hops.select(F.col("b").alias("a"), F.col("a").alias("b"))
        found = distances(starts, walk, n).where("depth > 0")
        near = found.groupBy(F.col("start" if used is None else "end").alias("v")).agg(F.sum(1.0 / F.col("depth")).alias("s"))
    by = max(n - 1, 1) if used is None else used
    return vertices(edges).join(near, "v", "left").select(F.col("v").alias("vertex_id"), (F.coalesce("s", F.lit(0.0)) / by).alias("closeness"))


def betweenness(edges: DataFrame, normalized: bool = True, pivots: int | None = None) -> DataFrame:
    """Shortest-path betweenness of directed edges; parallel edges multiply paths; estimated from ``pivots`` as in ``closeness``.

    Path counts are gathered level by level from every source, then the
    dependencies are summed back from the farthest level: by blocks of sources
    in tasks that hold all edges, or by joins where the edges are too many.
    """
    starts, n, used = _sources(edges, pivots)
    scale = 1.0 if used is None else n / used
    hops = materialise(edges.groupBy(F.col("src").alias("a"), F.col("dst").alias("b")).agg(F.count("*").cast("double").alias("m")), "hops")
    total = paths.total(hops, starts, paths.dependency) if paths.fits(hops) else _dependencies(hops, starts)
    by = (n - 1) * (n - 2) if normalized and n > 2 else 1
    return vertices(edges).join(total, "v", "left").select(F.col("v").alias("vertex_id"), (F.coalesce("s", F.lit(0.0)) * scale / by).alias("betweenness"))


def _dependencies(hops: DataFrame, starts: DataFrame) -> DataFrame:
    """``v``, ``s`` by joins over all pairs."""
    levels = [cut(starts.select("start", F.col("start").alias("v"), F.lit(1.0).alias("sigma")))]
    seen = levels[0].select("start", "v")
    while True:
        step = levels[-1].join(hops, F.col("v") == F.col("a")).select("start", F.col("b").alias("v"), (F.col("sigma") * F.col("m")).alias("sigma"))
        new = cut(step.join(seen, ["start", "v"], "left_anti").groupBy("start", "v").agg(F.sum("sigma").alias("sigma")))
        if new.isEmpty():
            break
        levels.append(new)
        seen = seen.unionByName(new.select("start", "v"))
    delta = levels[-1].withColumn("delta", F.lit(0.0))
    parts = []
    for upper in reversed(levels[:-1]):
        below = delta.select("start", F.col("v").alias("b"), ((1.0 + F.col("delta")) / F.col("sigma")).alias("share"))
        given = upper.join(hops, F.col("v") == F.col("a")).join(below, ["start", "b"]).groupBy("start", "v").agg(F.sum(F.col("m") * F.col("share")).alias("g"))
        delta = cut(upper.join(given, ["start", "v"], "left").select("start", "v", "sigma", (F.col("sigma") * F.coalesce("g", F.lit(0.0))).alias("delta")))
        parts.append(delta.where("v <> start").select("v", "delta"))
    if not parts:
        return starts.select(F.col("start").alias("v"), F.lit(0.0).alias("s"))
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    return total.groupBy("v").agg(F.sum("delta").alias("s"))
