"""Coreness with one value per vertex in every task and the edges spread over them.

Neighbours are packed by vertex into rows of arrays.  In a round each task
lowers the values of its own vertices, all of whose neighbours it has, until
they hold among themselves, and reports what fell; values are sent anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.scratch import materialise

VERTICES = 10_000_000  # vertices whose values are sent to all tasks: 120 MB with their ids
LINKS = 2_000_000  # neighbours packed into one row, more only for a vertex that has more


def _pack(batches: Iterator[pa.RecordBatch], ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of ``v``, ``o`` sorted by ``v`` as rows of packed vertices, numbers of neighbours and neighbours, by place in ``ids``."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def row(v: np.ndarray, o: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        many = np.diff(np.append(first, len(v))).astype(np.int32)
        packed = (v[first], many, o)
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in packed], ["v", "n", "o"])

    for batch in batches:
        v, o = (np.searchsorted(ids, batch.column(i).to_numpy(zero_copy_only=False)).astype(np.int32) for i in (0, 1))
        held.append((v, o))
        n += len(v)
        if n < LINKS:
            continue
        v, o = (np.concatenate(x) for x in zip(*held))
        last = int(np.searchsorted(v, v[-1]))  # the last vertex may go on
        if last:
            yield row(v[:last], o[:last])
        held, n = [(v[last:], o[last:])], len(v) - last
    if n:
        yield row(*(np.concatenate(x) for x in zip(*held)))


def _lowered(own: np.ndarray, many: np.ndarray, other: np.ndarray, now: np.ndarray, was: np.ndarray | None) -> None:
    """Lower ``now`` of the vertices ``own`` to the h-index of their neighbours, until none falls. ``was``: values that they last held against."""
    of = np.repeat(np.arange(len(own), dtype=np.int32), many)
    at = np.cumsum(many, dtype=np.int64) - many
    around = None if was is None else was[other]
    while True:
        values, mine = now[other], now[own][of]
        if around is None:
            touched = np.arange(len(own))
        else:
            # only a neighbour that falls below the vertex can lower it
            touched = np.unique(of[(around >= mine) & (values < mine)])
        if not len(touched):
            return
        n = many[touched].astype(np.int64)
        group = np.repeat(np.arange(len(touched)), n)
        start = np.cumsum(n) - n
        e = np.arange(len(group)) + (at[touched] - start)[group]
        least, most = values[e], now[own[touched]].astype(np.int64)
        least = np.minimum(least, most[group])
        span = int(most.max()) + 1
        ordered = np.sort(group * span + (span - 1 - least))  # by vertex, values falling
        falling = span - 1 - (ordered - group * span)
        new = np.maximum.reduceat(np.minimum(falling, np.arange(len(group)) - start[group] + 1), start)
        around = values
        fell = new < most
        if not fell.any():
            return
        now[own[touched[fell]]] = new[fell]


def coreness(both: DataFrame) -> DataFrame:
    """``v``, ``h`` of all vertices of a simple adjacency ``v``, ``o`` in both directions."""
    spark = both.sparkSession
    context = spark.sparkContext
    degrees = both.groupBy("v").agg(F.count("*").alias("d")).toArrow()
    ids, now = degrees["v"].to_numpy().astype(np.int64), degrees["d"].to_numpy().astype(np.int32)
    del degrees
    order = np.argsort(ids, kind="stable")
    ids, now = ids[order], now[order]
    if not len(ids):
        return both.select("v", F.lit(0).cast("bigint").alias("h")).limit(0)
    names = context.broadcast(ids)
    parts = max(1, ceil(int(now.sum(dtype=np.int64)) / LINKS))
    spread = both.select(F.col("v").cast("bigint"), F.col("o").cast("bigint")).repartition(parts, "v").sortWithinPartitions("v")
    packed = materialise(spread.mapInArrow(lambda it: _pack(it, names.value), "v binary, n binary, o binary"), "packed")
    was = None
    while True:
        sent = context.broadcast((now, was))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            now, was = sent.value
            mine = now.copy()
            for batch in batches:
                for k in range(batch.num_rows):
                    own, many, other = (np.frombuffer(batch.column(c)[k].as_buffer(), np.int32) for c in range(3))
                    _lowered(own, many, other, mine, was)
            at = np.flatnonzero(mine != now).astype(np.int32)
            for i in range(0, len(at), 1_000_000):
                some = at[i : i + 1_000_000]
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(mine[some])], ["i", "h"])

        fell = packed.mapInArrow(run, "i int, h int").toArrow()
        sent.unpersist()
        if not fell.num_rows:
            break
        was, now = now, now.copy()
        now[fell["i"].to_numpy()] = fell["h"].to_numpy()
    last = context.broadcast(now)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, now = names.value, last.value
        for batch in batches:
            for i in batch.column(0).to_pylist():
                at = slice(i * 100_000, (i + 1) * 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(now[at].astype(np.int64))], ["v", "h"])

    pieces = ceil(len(ids) / 100_000)
    out = materialise(spark.range(0, pieces, 1, min(pieces, context.defaultParallelism)).mapInArrow(told, "v bigint, h bigint"), "cores")
    names.unpersist()
    last.unpersist()
    return out
