"""All pairs of records whose value sets overlap above a Jaccard threshold.

Records are routed to parts by the rarest values of their set (prefix
filtering: two sets that reach the threshold share a value among the first
``n - ceil(t n) + 1`` of either, in one common order of values).  A part holds
inverted lists over its records; every record probes them for the records that
occur on at least T lists: a heap merges the short lists, skipping ahead, and
the longest lists are only binary-searched for the candidates found.

Sets that are equal form one class and are joined once.  A value that routes
more than ``block`` records is split: its records are cut into blocks by the
size of their sets, and only blocks of sizes that can reach the threshold are
paired, so no part grows with the frequency of a value.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.scratch import materialise

_PART = "part bigint, side int, rid bigint, items array<bigint>"


def occurrences(lists: list[list[int]], low: int, t: int) -> list[tuple[int, int]]:
    """Positions >= ``low`` on at least ``t`` of the sorted ``lists``, with their number of lists.

    The ``t - 1`` longest lists at most are searched, the rest are merged by a
    heap; entries that cannot reach the rest of ``t`` are skipped.
    """
    lists = sorted((x for x in lists if x and x[-1] >= low), key=len)
    if len(lists) < t:
        return []
    n_long = 0
    if t > 1 and len(lists[-1]) > 8:
        n_long = min(t - 1, max(1, int(t / (1 + 0.1 * np.log2(len(lists[-1])))) - 1))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    need = t - n_long
    at = [bisect_left(x, low) for x in short]
    heap = [(x[i], k) for k, (x, i) in enumerate(zip(short, at)) if i < len(x)]
    heapq.heapify(heap)
    found = []
    while len(heap) >= need:
        top = heap[0][0]
        popped = []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= need:
            n = len(popped)
            for x in long:
                j = bisect_left(x, top)
                n += j < len(x) and x[j] == top
            if n >= t:
                found.append((top, n))
            for k in popped:
                at[k] += 1
                if at[k] < len(short[k]):
                    heapq.heappush(heap, (short[k][at[k]], k))
        else:  # skip: nothing before the need-th head can occur often enough
            while heap and len(popped) < need - 1:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                break
            goal = heap[0][0]
            for k in popped:
                at[k] = bisect_left(short[k], goal, at[k])
                if at[k] < len(short[k]):
                    heapq.heappush(heap, (short[k][at[k]], k))
    return found


def join_part(rids: list[int], sides: list[int], items: list[list[int]], num: int, den: int) -> list[tuple[int, int, int]]:
    """All pairs of one part with ``den * shared >= num * union``, as (rid, rid, shared).

    Side 0 marks a part in which every pair counts; in a part of two blocks
    only pairs of side 1 with side 2 do.
    """
    order = sorted(range(len(rids)), key=lambda i: (len(items[i]), rids[i]))
    sizes: list[int] = []
    # one index per side, so that a block is never probed with itself in vain
    index: dict[int, dict[int, list[int]]] = {}
    out = []
    for pos, i in enumerate(order):
        own, n, side = items[i], len(items[i]), sides[i]
        t = -(-num * n // den)
        low = bisect_left(sizes, t)
        lists_of = index.get({0: 0, 1: 2, 2: 1}[side], {})
        if lists_of:
            lists = [x for v in own if (x := lists_of.get(v)) is not None]
            for other, shared in occurrences(lists, low, max(1, t)):
                j = order[other]
                if den * shared >= num * (n + len(items[j]) - shared):
                    out.append((min(rids[i], rids[j]), max(rids[i], rids[j]), shared))
        mine = index.setdefault(side, {})
        for v in own:
            mine.setdefault(v, []).append(pos)
        sizes.append(n)
    return out


def _join_parts(batches: Iterator[pd.DataFrame], num: int, den: int) -> Iterator[pd.DataFrame]:
    """Parts come sorted; the rows of one part may span batches."""
    held: list[pd.DataFrame] = []
    current = None

    def solve() -> pd.DataFrame:
        pdf = pd.concat(held) if len(held) > 1 else held[0]
        pairs = join_part(pdf["rid"].tolist(), pdf["side"].tolist(), [x.tolist() for x in pdf["items"]], num, den)
        return pd.DataFrame(sorted(set(pairs)), columns=["a", "b", "shared"], dtype="int64")

    for batch in batches:
        parts = batch["part"].to_numpy()
        cuts = np.flatnonzero(parts[1:] != parts[:-1]) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(parts)]):
            if hi == lo:
                continue
            if held and parts[lo] != current:
                yield solve()
                held.clear()
            current = parts[lo]
            held.append(batch.iloc[lo:hi])
    if held:
        yield solve()


def _bands(n: Column, threshold: float) -> Column:
    """Bands of set sizes: sizes that can reach the threshold are at most one band apart."""
    return F.floor(F.log(n.cast("double")) / float(-np.log(threshold)) + 1e-9).cast("int")


def value_sets(df: DataFrame, record: str, value: str, threshold: float | None = None) -> DataFrame:
    """``rid`` and ``items``, the values of each record from the rarest to the most frequent (ties by value).

    Rows with a null record or value are left out; repeated rows count once.
    With a ``threshold`` the records are left out whose sizes no other record
    can match at that threshold or a higher one.  Values are numbered by a
    64-bit column, so ``value`` is an integer.
    """
    pairs = df.select(F.col(record).cast("bigint").alias("rid"), F.col(value).cast("bigint").alias("v")).dropna().distinct()
    pairs = materialise(pairs, "sets")
    rows = pairs.join(pairs.groupBy("v").agg(F.count("*").alias("f")), "v")
    if threshold is not None and 0 < threshold < 1:
        sizes = materialise(pairs.groupBy("rid").agg(F.count("*").alias("n")).withColumn("band", _bands(F.col("n"), threshold)), "sizes")
        bands = sizes.groupBy("band").agg(F.count("*").alias("m"))  # sizes are below 2**63: at most 44 / -ln(threshold) rows
        near = bands.select(F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), "m")
        live = near.groupBy("band").agg(F.sum("m").alias("m")).where("m > 1")
        rows = rows.join(sizes.join(live, "band", "left_anti").select("rid"), "rid", "left_anti")
    return rows.groupBy("rid").agg(F.transform(F.sort_array(F.collect_list(F.struct("f", "v"))), lambda x: x["v"]).alias("items"))


def similar_sets(df: DataFrame, record: str, value: str, threshold: float = 0.7, block: int = 2000) -> tuple[DataFrame, DataFrame]:
    """``(members, links)`` as from ``similar_classes``, for rows of records and values; one threshold for all steps."""
    return similar_classes(value_sets(df, record, value, threshold), threshold, block)


def similar_classes(sets: DataFrame, threshold: float = 0.7, block: int = 2000, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(members, links)`` of records ``rid``, ``items``.

    ``members`` has one row per record: ``rid`` and ``rep``, the smallest
    record of the class of equal sets.  ``links`` are the pairs of different
    sets that reach the threshold: ``a`` < ``b`` (representatives), ``shared``.
    ``threshold`` is above 0 and at most 1, where only equal sets are similar.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    spark = sets.sparkSession
    ratio = Fraction(str(threshold))
    num, den = ratio.numerator, ratio.denominator
    sets = materialise(sets, "records")
    classes = sets.groupBy("items").agg(F.min("rid").alias("rep"))
    members = sets.join(classes, "items").select("rid", "rep")
    if threshold == 1:
        return members, spark.createDataFrame([], "a bigint, b bigint, shared bigint")
    n = F.size("items")
    prefix = F.slice("items", 1, n - F.ceil(n * num / den).cast("int") + 1)
    classes = materialise(classes.withColumns({"prefix": prefix, "band": _bands(n, threshold)}), "classes")
    routed = materialise(classes.select(F.col("rep").alias("rid"), "band", F.explode("prefix").alias("v")), "routed")
    load = routed.groupBy("v", "band").agg(F.count("*").alias("mb"))
    load = load.withColumn("m", F.sum("mb").over(Window.partitionBy("v"))).where("m > 1")  # at most one row a band
    load = load.withColumn("blocks", F.when(F.col("m") > block, F.ceil(F.col("mb") / block).cast("int")))
    near = load.where("blocks is not null").select("v", F.explode(F.array(F.col("band") - 1, F.col("band") + 1)).alias("band"), F.col("blocks").alias("beside"), F.col("band").alias("from"))
    beside = near.groupBy("v", "band").agg(F.max(F.when(F.col("from") < F.col("band"), F.col("beside"))).alias("below"), F.max(F.when(F.col("from") > F.col("band"), F.col("beside"))).alias("above"))
    load = materialise(load.join(beside, ["v", "band"], "left"), "load")
    rows = routed.join(load, ["v", "band"])
    # parts hold about as many routed records as a block, whatever the size of the table
    total = load.where("blocks is null").agg(F.sum("mb")).first()[0] or 0
    n_parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(total / block))
    cool = rows.where("blocks is null").select("rid", F.pmod(F.xxhash64("v"), F.lit(n_parts)).alias("part"), F.lit(0).alias("side"))
    h = F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int")
    across = lambda n, band, mine: F.when(F.col(n).isNotNull(), F.transform(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1), lambda o: F.struct(
        F.col("band").alias("low") if mine == 1 else (F.col("band") - 1).alias("low"), F.lit(True).alias("two"), (h if mine == 1 else o).alias("i"), (o if mine == 1 else h).alias("j"), F.lit(mine).alias("side")))).otherwise(F.array())
    inside = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(
        F.col("band").alias("low"), F.lit(False).alias("two"), F.least(h, o).alias("i"), F.greatest(h, o).alias("j"), F.when(h == o, 0).when(h < o, 1).otherwise(2).alias("side")))
    split = (
        rows.where("blocks is not null")
        .select("rid", "v", F.explode(F.concat(inside, across("above", "above", 1), across("below", "below", 2))).alias("p"))
        .select("rid", F.xxhash64("v", "p.low", "p.two", "p.i", "p.j").alias("part"), F.col("p.side").alias("side"))
    )
    # the set travels once per part, however many of its values lead there
    routes = cool.distinct().unionByName(split)
    placed = routes.join(classes.select(F.col("rep").alias("rid"), "items"), "rid").select("part", "side", "rid", "items")
    found = (
        placed.repartition("part").sortWithinPartitions("part")
        .mapInPandas(lambda it: _join_parts(it, num, den), "a bigint, b bigint, shared bigint")
    )
    return members, found.distinct()


def similar_pairs(members: DataFrame, links: DataFrame, block: int = 1000) -> DataFrame:
    """All pairs of records, ``a`` < ``b``: links between classes and equal sets, written out.

    The members of a class are cut into blocks of about ``block``, and blocks
    are joined with blocks, so a large class is spread over many keys.
    """
    members = materialise(members, "members")
    blocks = members.groupBy("rep").agg(F.ceil(F.count("*") / block).cast("int").alias("n")).where("n > 1")
    cut = members.join(blocks, "rep", "left").select("rid", "rep", F.coalesce("n", F.lit(1)).alias("n"))
    cut = materialise(cut.select("rid", "rep", "n", F.pmod(F.xxhash64("rid"), F.col("n")).cast("int").alias("i")), "blocks")
    count = cut.where("n > 1").select("rep", "n").distinct()
    left, right = cut.select(F.col("rid").alias("x"), F.col("rep").alias("a"), "i"), cut.select(F.col("rid").alias("y"), F.col("rep").alias("b"), F.col("i").alias("j"))
    wide = links.select("a", "b").join(count.select(F.col("rep").alias("a"), F.col("n").alias("na")), "a", "left").join(count.select(F.col("rep").alias("b"), F.col("n").alias("nb")), "b", "left")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    wide = wide.withColumn("i", each("na")).withColumn("j", each("nb")).select("a", "b", "i", "j")
    across = wide.join(left, ["a", "i"]).join(right, ["b", "j"]).select("x", "y")
    several = members.groupBy("rep").agg(F.count("*").alias("m")).where("m > 1").join(count, "rep", "left").select(F.col("rep").alias("a"), F.coalesce("n", F.lit(1)).alias("n"))
    same = several.withColumn("i", each("n")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("a", F.col("a").alias("b"), "i", "j")
    within = same.join(left, ["a", "i"]).join(right, ["b", "j"]).where("x < y").select("x", "y")
    pairs = across.unionByName(within)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def min_overlap(n: int, m: int, threshold: float) -> int:
    """The overlap that sets of sizes ``n`` and ``m`` need."""
    t = Fraction(str(threshold))
    return ceil(t * (n + m) / (1 + t))
