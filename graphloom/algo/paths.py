"""Shortest paths from many vertices of a graph that fits in every task.

The edges are sent to all tasks as arrays; a task walks breadth first from a
block of vertices at a time and keeps one sum per vertex, so neither pairs of
vertices nor rounds go through the shuffle.  Nothing is left out: every vertex
asked for is walked from, to the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.scratch import materialise

EDGES = 4_000_000  # different edges that are sent to the tasks: about 60 MB
ROUNDS = 4  # tasks per core, for balance
WORDS = 1 << 23  # words of 64 vertices that a block of bits takes at most
VISITS = 1 << 23  # edges and vertices, by vertex walked from, that a block of counts takes at most


def fits(hops: DataFrame) -> bool:
    """Whether edges ``a``, ``b`` are few enough, and their ends whole numbers."""
    return all(t in ("bigint", "int", "smallint", "tinyint") for c, t in hops.dtypes if c in ("a", "b")) and hops.count() <= EDGES


class Rows:
    """Different edges by their first end: those of ``i`` are ``other[at[i] : at[i + 1]]``, ``times`` each."""

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray, times: np.ndarray | None):
        order = np.argsort(a, kind="stable")
        self.n, self.first, self.other = n, a[order].astype(np.int32), b[order].astype(np.int32)
        self.at = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))]).astype(np.int64)
        self.times = None if times is None or (times == 1).all() else times[order]


def nearness(rows: Rows, ends: np.ndarray) -> np.ndarray:
    """By vertex the sum of ``1 / d`` over the ``ends`` that it reaches by ``d`` > 0 edges; a bit stands for an end."""
    out = np.zeros(rows.n)
    if not len(rows.other):
        return out
    words = -(-len(ends) // 64)
    seen = np.zeros((rows.n, words), np.uint64)
    i = np.arange(len(ends))
    np.bitwise_or.at(seen, (ends, i // 64), np.uint64(1) << (i % 64).astype(np.uint64))
    front, there, depth = seen[ends], ends, 0
    slot = np.full(rows.n, -1, np.int32)  # of a vertex in ``front``
    if len(set(there.tolist())) < len(there):
        there = np.unique(there)
        front = seen[there]
    while len(there):
        depth += 1
        slot[there] = np.arange(len(there), dtype=np.int32)
        at = slot[rows.other]
        live = np.flatnonzero(at >= 0)
        slot[there] = -1
        if not len(live):
            break
        who = rows.first[live]
        starts = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        who = who[starts]
        new = np.bitwise_or.reduceat(front[at[live]], starts, axis=0) & ~seen[who]
        n = np.bitwise_count(new).sum(axis=1, dtype=np.int64)
        some = n > 0
        there, front = who[some], new[some]
        seen[there] |= front
        out[there] += n[some] / depth
    return out


def dependency(rows: Rows, sources: np.ndarray) -> np.ndarray:
    """By vertex the sum over ``sources`` of the parts of their shortest paths to others that go through it."""
    base = np.arange(len(sources), dtype=np.int64) * rows.n
    v, sigma = sources.astype(np.int64), np.ones(len(sources))
    seen = np.zeros(len(sources) * rows.n, bool)
    seen[base + v] = True
    mark = np.empty(len(seen), np.int32)
    levels, links = [(v, sigma)], []
    while True:
        begin, many = rows.at[v], rows.at[v + 1] - rows.at[v]
        pos = np.repeat(np.arange(len(v), dtype=np.int32), many)
        e = np.arange(len(pos)) + (begin - np.cumsum(many) + many)[pos]
        to = rows.other[e]
        spot = base[pos] + to
        new = np.flatnonzero(~seen[spot])
        if not len(new):
            break
        pos, to, spot = pos[new], to[new], spot[new]
        times = None if rows.times is None else rows.times[e[new]]
        # one of the edges to a spot stands for it
        own = np.arange(len(spot), dtype=np.int32)
        mark[spot] = own
        by = mark[spot]
        first = by == own
        back = (np.cumsum(first, dtype=np.int32) - 1)[by]
        given = sigma[pos] if times is None else sigma[pos] * times
        sigma = np.bincount(back, given)
        seen[spot[first]] = True
        v, base = to[first].astype(np.int64), base[pos[first]]
        levels.append((v, sigma))
        links.append((pos, back, times))
    at, parts = [], []
    delta = np.zeros(len(v))
    for k in range(len(links) - 1, 0, -1):  # the sources themselves get nothing
        pos, back, times = links.pop()
        share = ((1.0 + delta) / sigma)[back]
        v, sigma = levels[k]
        delta = sigma * np.bincount(pos, share if times is None else share * times, len(v))
        at.append(v)
        parts.append(delta)
    return np.bincount(np.concatenate(at), np.concatenate(parts), rows.n) if at else np.zeros(rows.n)


def total(hops: DataFrame, starts: DataFrame, kernel: Callable[[Rows, np.ndarray], np.ndarray]) -> DataFrame:
    """``v``, ``s``: what the kernel finds from all ``starts``, by vertex; ``hops`` are different edges ``a``, ``b``, with ``m`` if they count."""
    spark = hops.sparkSession
    table = hops.where("a is not null and b is not null").toArrow()
    a, b = (table[c].to_numpy().astype(np.int64) for c in ("a", "b"))
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    ends = ends.reshape(-1)
    rows = Rows(len(ids), ends[: len(a)], ends[len(a) :], table["m"].to_numpy() if "m" in table.column_names else None)
    wanted = starts.where("start is not null").toArrow()["start"].to_numpy().astype(np.int64)
    wanted = np.searchsorted(ids, wanted[np.isin(wanted, ids)]).astype(np.int64)
    wanted.sort()
    context = spark.sparkContext
    parts = context.defaultParallelism * ROUNDS
    if kernel is nearness:
        block = 64 * max(1, min(16, WORDS // (3 * len(ids) + len(a) + 1), -(-len(wanted) // (64 * parts))))
    else:
        block = max(1, min(VISITS // (len(ids) + len(a) + 1), -(-len(wanted) // parts)))
    blocks = -(-len(wanted) // block)
    sent = context.broadcast((ids, rows, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, wanted = sent.value
        sums = np.zeros(rows.n)
        for batch in batches:
            for i in batch.column(0).to_pylist():
                sums += kernel(rows, wanted[i * block : (i + 1) * block])
        some = np.flatnonzero(sums)
        for i in range(0, len(some), 100_000):
            at = some[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(sums[at])], ["v", "x"])

    found = spark.range(0, blocks, 1, max(1, min(blocks, parts))).mapInArrow(run, "v bigint, x double")
    found = materialise(found.groupBy("v").agg(F.sum("x").alias("s")), "sums")
    sent.unpersist()
    return found
