"""Filling containers of a fixed capacity with items of varying size.

Best fit by decreasing size with conflicts.  Open containers are ordered by
what is left in them and carry a bitmap of the sources and one of the duplicate
clusters they hold.  The search for an item starts at the tightest container it
fits into and goes on through its successors until a compatible one is found.

Items are spread over shards of a bounded number by a hash of their id, so a
cluster or source that holds a large part of the items is spread as well.  The
items of containers that a shard leaves open are packed together once more.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator, Sequence
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.scratch import materialise

_OUT = "id bigint, piece int, size bigint, shard bigint, bin bigint, fill bigint"


def best_fit(
    sizes: Sequence[int], sources: Sequence[str | None], clusters: Sequence[Sequence], capacity: int, conflicts: Sequence[tuple[str | None, str | None]] = ()
) -> tuple[list[int], list[int]]:
    """The container of each item, and how much each container holds.

    No size exceeds ``capacity``.  Two items that name a common cluster, or
    whose sources are a pair of ``conflicts``, never share a container.
    """
    source_bit: dict[str | None, int] = {}
    for s in sources:
        source_bit.setdefault(s, 1 << len(source_bit))
    against: Counter[int] = Counter()
    for a, b in conflicts:
        if a in source_bit and b in source_bit:
            against[source_bit[a]] |= source_bit[b]
            against[source_bit[b]] |= source_bit[a]
    often = Counter(c for own in clusters for c in set(own))
    cluster_bit = {c: 1 << i for i, c in enumerate(c for c, n in often.items() if n > 1)}  # a lone item conflicts with nothing
    masks = [0] * len(sizes)
    for i, own in enumerate(clusters):
        for c in own:
            masks[i] |= cluster_bit.get(c, 0)
    left_of: list[int] = []
    held_sources: list[int] = []
    held_clusters: list[int] = []
    by_left: dict[int, list[int]] = {}
    open_lefts: list[int] = []
    home = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size, mask, bit = sizes[i], masks[i], source_bit[sources[i]]
        bad = against[bit]
        chosen = -1
        for k in range(bisect_left(open_lefts, size), len(open_lefts)):
            left = open_lefts[k]
            bins = by_left[left]
            for j in range(len(bins) - 1, -1, -1):
                b = bins[j]
                if not (held_clusters[b] & mask or held_sources[b] & bad):
                    chosen = b
                    del bins[j]
                    if not bins:
                        del by_left[left], open_lefts[k]
                    break
            if chosen >= 0:
                break
        if chosen < 0:
            chosen = len(left_of)
            left_of.append(capacity)
            held_sources.append(0)
            held_clusters.append(0)
        left_of[chosen] -= size
        held_sources[chosen] |= bit
        held_clusters[chosen] |= mask
        left = left_of[chosen]
        if left:
            if left not in by_left:
                by_left[left] = []
                insort(open_lefts, left)
            by_left[left].append(chosen)
        home[i] = chosen
    return home, [capacity - x for x in left_of]


def _pack_shards(batches: Iterator[pd.DataFrame], capacity: int, conflicts: Sequence[tuple]) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    current = None

    def solve() -> pd.DataFrame:
        pdf = pd.concat(held) if len(held) > 1 else held[0]
        pdf = pdf.sort_values(["id", "piece"], kind="stable")  # ties of size are broken by id
        sources = [None if s is None or s != s else s for s in pdf["source"]]
        home, fill = best_fit(pdf["size"].tolist(), sources, [list(c) for c in pdf["clusters"]], capacity, conflicts)
        return pd.DataFrame({"id": pdf["id"].to_numpy(), "piece": pdf["piece"].to_numpy(), "size": pdf["size"].to_numpy(), "shard": current, "bin": home, "fill": [fill[h] for h in home]})

    for batch in batches:
        shards = batch["shard"].to_numpy()
        cuts = np.flatnonzero(shards[1:] != shards[:-1]) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(shards)]):
            if hi == lo:
                continue
            if held and shards[lo] != current:
                yield solve()
                held.clear()
            current = int(shards[lo])
            held.append(batch.iloc[lo:hi])
    if held:
        yield solve()


def pack(items: DataFrame, capacity: int, conflicts: Sequence[tuple[str | None, str | None]] = (), shard_items: int = 10_000, keep_fill: float = 0.98) -> DataFrame:
    """``id``, ``piece``, ``size``, ``container`` for items ``id``, ``size``, ``source``, ``clusters``.

    An item larger than ``capacity`` is split into full containers and a rest
    that is packed like an item; no other item is split.  ``clusters`` is an
    array of longs: items that share one never share a container, but pieces of
    one item may.  Items of size null or 0 need no container and have a null
    one.  Ids are unique; other columns are ignored.  No items give no rows.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    items = items.select("id", F.greatest(F.coalesce(F.col("size"), F.lit(0)), F.lit(0)).cast("bigint").alias("size"), "source", F.coalesce("clusters", F.array().cast("array<bigint>")).alias("clusters"))
    items = materialise(items, "items")
    whole = F.floor(F.col("size") / capacity).cast("int")
    full = (
        items.where(F.col("size") >= capacity)
        .select("id", F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece"))
        .select("id", "piece", F.lit(capacity).cast("bigint").alias("size"), F.concat_ws("-", F.lit("f"), "id", "piece").alias("container"))
    )
    none = items.where("size = 0").select("id", F.lit(0).alias("piece"), "size", F.lit(None).cast("string").alias("container"))
    rest = items.select("id", whole.alias("piece"), (F.col("size") % capacity).alias("size"), "source", "clusters").where("size > 0")

    def round_of(rows: DataFrame, n: int, salt: int) -> tuple[DataFrame, int]:
        shards = max(1, ceil(n / shard_items))
        placed = rows.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(shards)))
        placed = placed.repartition("shard").sortWithinPartitions("shard")
        return placed.mapInPandas(lambda it: _pack_shards(it, capacity, tuple(conflicts)), _OUT), shards

    def named(rows: DataFrame, salt: int) -> DataFrame:
        return rows.select("id", "piece", "size", F.concat_ws("-", F.lit(f"r{salt}"), "shard", "bin").alias("container"))

    first, shards = round_of(rest, rest.count(), 1)
    first = materialise(first, "packed")
    if shards == 1:
        packed = named(first, 1)
    else:
        closed = F.col("fill") >= int(keep_fill * capacity)
        again = rest.join(first.where(~closed).select("id"), "id", "left_semi")
        second, _ = round_of(again, again.count(), 2)
        packed = named(first.where(closed), 1).unionByName(named(second, 2))
    return packed.unionByName(full).unionByName(none)


def containers(packed: DataFrame, capacity: int) -> DataFrame:
    """Containers, tokens in them, the mean fill, and the least number that any packing needs."""
    used = packed.where("container is not null")
    total = used.groupBy("container").agg(F.sum("size").alias("held"))
    return total.agg(
        F.count("*").alias("n_containers"), F.sum("held").alias("n_tokens"), F.max("held").alias("most"),
        F.round(F.sum("held") / (F.count("*") * capacity), 6).alias("fill"), F.ceil(F.sum("held") / capacity).alias("lower_bound"),
    )
