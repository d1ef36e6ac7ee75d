"""Variable-length expansion: who can be reached from each start."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.scratch import cut, materialise

_EDGE = ["_src", "_type", "_rank", "_dst"]


def distances(starts: DataFrame, walk: DataFrame, most: int) -> DataFrame:
    """``start``, ``end``, ``depth`` of everything within ``most`` hops, the start itself at depth 0.

    ``walk`` has ``a`` and ``b`` in walking direction.  Breadth first: each
    round expands only what the round before found, and ends when nothing is new.
    """
    hops = materialise(walk.select("a", "b").distinct(), "hops")  # read in every round
    seen = starts.select("start", F.col("start").alias("end"), F.lit(0).alias("depth"))
    frontier = seen
    for depth in range(1, most + 1):
        step = frontier.join(hops, F.col("end") == F.col("a")).select("start", F.col("b").alias("end")).distinct()
        frontier = cut(step.join(seen.select("start", "end"), ["start", "end"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def reachable(starts: DataFrame, walk: DataFrame, least: int, most: int, with_edge: bool) -> DataFrame:
    """Distinct ``start``, ``end`` within ``most`` hops, the start left out; with the last edges on request."""
    found = distances(starts, walk, most if not with_edge else most - 1)
    if not with_edge:
        return found.where("end <> start").select("start", "end")
    last = found.select("start", F.col("end").alias("via")).join(walk, F.col("via") == F.col("a"))
    return last.where("b <> start").select("start", F.col("b").alias("end"), *_EDGE).distinct()


def trails(starts: DataFrame, walk: DataFrame, least: int, most: int, with_edge: bool) -> DataFrame:
    """Distinct ends of walks of ``least`` to ``most`` hops that use no edge twice; the start is left out."""
    key = F.concat_ws("\x1f", *_EDGE)
    steps = materialise(walk.withColumn("key", key), "steps")
    rows = starts.select("start", F.col("start").alias("end"), F.array().cast("array<string>").alias("used"))
    found = None
    cols = ["start", "end", *(_EDGE if with_edge else [])]
    for depth in range(1, most + 1):
        rows = (
            rows.select("start", "end", "used").join(steps, F.col("end") == F.col("a")).where(~F.array_contains("used", F.col("key")))
            .select("start", F.col("b").alias("end"), F.array_append("used", F.col("key")).alias("used"), *_EDGE)
        )
        rows = cut(rows)
        if rows.isEmpty():
            break
        if depth >= least:
            ends = rows.where("end <> start").select(*cols).distinct()
            found = ends if found is None else found.unionByName(ends)
    if found is None:
        schema = "start bigint, end bigint" + (", _src bigint, _type string, _rank bigint, _dst bigint" if with_edge else "")
        return starts.sparkSession.createDataFrame([], schema)
    return found.distinct()
