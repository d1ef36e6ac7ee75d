"""Mixing sources to target shares of the total size.

Capped water-filling: sources whose share asks for more than their records
times the greatest number of repeats are clamped there, and what they lack goes
to the others in proportion to their weights, until nothing exceeds its cap.
A source then takes every record ``floor(epochs)`` times and a seeded part of
its records once more.
"""

from __future__ import annotations

from collections.abc import Mapping
from math import floor, isfinite

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.scratch import materialise

MAX_SOURCES = 10_000
_FINE = 4096


def water_fill(weights: Mapping[str, float], caps: Mapping[str, float], total: float) -> dict[str, float]:
    """Sizes per source that sum to ``total``, or to all caps if those are less.

    Sources whose weight or cap is not positive get nothing.
    """
    out = dict.fromkeys(weights, 0.0)
    open_ = {s for s in weights if weights[s] > 0 and caps.get(s, 0) > 0}
    left = float(total)
    while open_ and left > 0:
        sum_w = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / sum_w > caps[s]}
        if not over:
            for s in open_:
                out[s] = left * weights[s] / sum_w
            break
        for s in over:
            out[s] = float(caps[s])
        left -= sum(caps[s] for s in over)
        open_ -= over
    return out


def mix(items: DataFrame, weights: DataFrame, total: int | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """``(selection, report)`` for items ``id``, ``source``, ``size`` and weights ``source``, ``target_share``, ``max_repeats``.

    ``selection`` has one row per record used: ``id``, ``source``, ``size``,
    ``repeats``.  ``report`` has one row per weighted source: its target and
    actual share, what it has and what the mix takes, epochs and records.
    ``total`` is the size wanted, by default the size of all records of the
    weighted sources.  Records of other sources or of none are not in the mix;
    a null, negative or NaN share or repeat counts as 0; of repeated sources in
    ``weights`` the one with the greatest share counts; records of size null or
    0 are never used.  Ids are unique; other columns are ignored.

    A fractional repetition takes the records with the smallest seeded hashes.
    Where to cut is found from sums per hash cell, refined once into 4096 * 4096
    cells, so it is within the records of one such cell of the share asked for
    (about one record in sources of up to some 10 million), and no source is
    sorted or gathered in one task.
    """
    rows = weights.select("source", F.col("target_share").cast("double"), F.col("max_repeats").cast("double")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources have weights")
    fine = lambda x: x if x is not None and isfinite(x) and x > 0 else 0.0
    share: dict[str, float] = {}
    repeats: dict[str, float] = {}
    for r in rows:
        if r["source"] is not None and (r["source"] not in share or fine(r["target_share"]) > share[r["source"]]):
            share[r["source"]], repeats[r["source"]] = fine(r["target_share"]), floor(fine(r["max_repeats"]))
    spark = items.sparkSession
    names = spark.createDataFrame([(s,) for s in share], "source string")
    h = F.xxhash64("id", F.lit(seed))
    cells = F.pmod(h, F.lit(_FINE)).cast("int").alias("h1"), F.pmod(F.shiftright(h, 20), F.lit(_FINE)).cast("int").alias("h2")
    items = materialise(items.select("id", "source", "size"), "sizes")  # sizes are computed once
    used = items.join(F.broadcast(names), "source", "left_semi").where("size > 0").select("id", "source", F.col("size").cast("bigint").alias("size"), *cells)
    used = materialise(used, "mix")
    sums = materialise(used.groupBy("source", "h1").agg(F.sum("size").alias("s"), F.count("*").alias("n")), "cells")  # at most 4096 rows a source
    have = {r["source"]: (r["s"], r["n"]) for r in sums.groupBy("source").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()}
    size_of = {s: have.get(s, (0, 0))[0] for s in share}
    wanted = sum(size_of.values()) if total is None else max(0, total)
    alloc = water_fill(share, {s: repeats[s] * size_of[s] for s in share}, wanted)
    plan = []
    for s in share:
        epochs = alloc[s] / size_of[s] if size_of[s] else 0.0
        whole = min(floor(epochs + 1e-12), int(repeats[s]))
        plan.append((s, share[s], int(repeats[s]), size_of[s], have.get(s, (0, 0))[1], whole, max(0.0, alloc[s] - whole * size_of[s]), epochs))
    schema = "source string, target_share double, max_repeats int, size_available bigint, n_available bigint, whole int, extra double, epochs double"
    plan_df = F.broadcast(spark.createDataFrame(plan, schema))
    ask = plan_df.select("source", "whole", "extra")
    # first cut: the cell in which the running sum reaches the extra size
    run = Window.partitionBy("source").orderBy("h1")
    at = sums.join(ask, "source").withColumn("upto", F.sum("s").over(run)).where((F.col("upto") > F.col("extra")) & (F.col("upto") - F.col("s") <= F.col("extra")))
    cut = at.select("source", F.col("h1").alias("c1"), (F.col("extra") - F.col("upto") + F.col("s")).alias("rest"))
    # second cut: inside that cell, where the sum is nearest to the rest
    inner = used.join(F.broadcast(cut), (used["source"] == cut["source"]) & (F.col("h1") == F.col("c1"))).select(used["source"], "h2", "size", "rest")
    inner = inner.groupBy("source", "h2", "rest").agg(F.sum("size").alias("s"))
    inner = inner.withColumn("upto", F.sum("s").over(Window.partitionBy("source").orderBy("h2")))
    near = inner.where(F.abs(F.col("upto") - F.col("rest")) < F.abs(F.col("upto") - F.col("s") - F.col("rest")))
    fine_cut = near.groupBy("source").agg(F.max("h2").alias("c2"))
    cuts = materialise(cut.join(fine_cut, "source", "left").select("source", "c1", F.coalesce("c2", F.lit(-1)).alias("c2")), "cuts")
    lookup = F.broadcast(ask.join(cuts, "source", "left"))  # one row a source
    once_more = (F.col("extra") > 0) & (F.col("c1").isNull() | (F.col("h1") < F.col("c1")) | ((F.col("h1") == F.col("c1")) & (F.col("h2") <= F.col("c2"))))
    selection = used.join(lookup, "source").select("id", "source", "size", (F.col("whole") + once_more.cast("int")).alias("repeats")).where("repeats > 0")
    taken = selection.groupBy("source").agg(F.sum(F.col("size") * F.col("repeats")).alias("size_mixed"), F.count("*").alias("n_used"), F.max("repeats").alias("most_repeats"))
    taken = taken.withColumn("all_mixed", F.sum("size_mixed").over(Window.partitionBy(F.lit(1))))  # one row a source
    report = plan_df.join(taken, "source", "left").select(
        "source", "target_share", F.round(F.coalesce(F.col("size_mixed") / F.col("all_mixed"), F.lit(0.0)), 6).alias("actual_share"), "size_available",
        F.coalesce("size_mixed", F.lit(0)).alias("size_mixed"), "n_available", F.coalesce("n_used", F.lit(0)).alias("n_used"), "max_repeats", F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        F.round("epochs", 6).alias("epochs"),
    )
    return selection, report
