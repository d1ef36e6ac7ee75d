"""Per-key results when a few keys hold most rows.

Rows are range partitioned on ``(key, identity, position)`` with bounds from
sampled quantiles.  The bounds fall inside heavy keys and even inside long runs
of one identity, so all partitions get a like number of rows.  Each partition
is sorted and reduced to one partial state per key.  Only a partition's first
and last run can go on in a neighbour; those boundary states are stitched.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _partials(batches: Iterator[pa.RecordBatch], n_keys: int, n_ids: int) -> Iterator[pa.RecordBatch]:
    """Partial states of one sorted partition; at most one open run is held."""
    part = TaskContext.get().partitionId()
    names = [f"k{i}" for i in range(n_keys)]
    keep = n_keys + n_ids
    last: list | None = None  # the identity of the row before
    first_id: list | None = None
    open_key: list | None = None
    rows = runs = 0

    def emit(keys: list, row_counts, run_counts, side: int | None = None, identity: list | None = None) -> pa.RecordBatch:
        n = len(row_counts)
        cols = [pa.array(k, pa.int64()) for k in keys]
        cols += [pa.array(row_counts, pa.int64()), pa.array(run_counts, pa.int64())]
        if side is None:
            cols += [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64()))]
        else:
            cols += [pa.array([part], pa.int32()), pa.array([side], pa.int32()), pa.array([identity], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(cols, [*names, "rows", "runs", "part", "side", "id"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(i).to_numpy(zero_copy_only=False), dtype=np.int64) for i in range(keep)]
        n = batch.num_rows
        new_key, new_id = np.zeros(n, bool), np.zeros(n, bool)
        for i, c in enumerate(cols):
            step = np.empty(n, bool)
            step[0] = last is None or c[0] != last[i]
            np.not_equal(c[1:], c[:-1], out=step[1:])
            new_id |= step
            if i < n_keys:
                new_key |= step
        if first_id is None:
            first_id = [int(c[0]) for c in cols]
            yield emit([[k] for k in first_id[:n_keys]], [0], [0], 0, first_id)
        starts = np.flatnonzero(new_key)
        id_sums = np.concatenate([[0], np.cumsum(new_id)])
        head = starts[0] if len(starts) else n
        rows += int(head)
        runs += int(id_sums[head])
        if len(starts):
            ends = np.append(starts[1:], n)
            counts, distinct = ends - starts, id_sums[ends] - id_sums[starts]
            if open_key is not None:
                yield emit([np.array([k]) for k in open_key], [rows], [runs])
            if len(starts) > 1:
                yield emit([c[starts[:-1]] for c in cols[:n_keys]], counts[:-1], distinct[:-1])
            open_key = [int(c[starts[-1]]) for c in cols[:n_keys]]
            rows, runs = int(counts[-1]), int(distinct[-1])
        last = [int(c[-1]) for c in cols]
    if open_key is not None:
        yield emit([[k] for k in open_key], [rows], [runs], 1, last)


def key_counts(df: DataFrame, keys: Sequence[str], identity: Sequence[str] = (), partitions: int | None = None, nullable: Sequence[str] = ()) -> DataFrame:
    """``keys``, ``n_rows`` and ``n_distinct`` identities per key.

    ``keys`` and ``identity`` are integer columns of ``df``; other columns are
    ignored.  Rows with a null key or a null in ``identity`` are left out; in
    the columns of ``identity`` that are ``nullable``, null is a value like others.
    Repeated rows count in ``n_rows`` and not in ``n_distinct``.  An empty
    input gives no rows.  A key may hold any part of the input: its rows are
    spread over as many partitions as its share asks for.
    """
    keys, identity = list(keys), list(identity)
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = [F.coalesce(F.col(c).cast("bigint"), F.lit(0)) if c in nullable and i >= len(keys) else F.col(c).cast("bigint") for i, c in enumerate([*keys, *identity])]
    if nulls := [F.col(c).isNull().cast("bigint") * (1 << i) for i, c in enumerate(identity) if c in nullable]:
        ids.append(sum(nulls[1:], nulls[0]))  # tells nulls from zeros
    rows = df.select(*(c.alias(f"k{i}") for i, c in enumerate(ids))).dropna()
    order = [f"k{i}" for i in range(len(ids))]
    # the position splits runs of equal identities; it is fixed by file split and row, also on a retry
    spread = rows.withColumn("pos", F.monotonically_increasing_id()).repartitionByRange(n, *order, "pos")
    schema = T.StructType(
        [T.StructField(f"k{i}", T.LongType()) for i in range(len(keys))]
        + [T.StructField("rows", T.LongType()), T.StructField("runs", T.LongType()), T.StructField("part", T.IntegerType())]
        + [T.StructField("side", T.IntegerType()), T.StructField("id", T.ArrayType(T.LongType()))]
    )
    n_keys, n_ids = len(keys), len(ids) - len(keys)
    partial = spread.sortWithinPartitions(*order).mapInArrow(lambda it: _partials(it, n_keys, n_ids), schema)
    # a run that goes on over a boundary was counted on both sides; a key has at most two boundary rows per partition
    boundary = F.when(F.col("part").isNotNull(), F.struct("part", "side", "id"))
    states = partial.groupBy(*order[:n_keys]).agg(
        F.sum("rows").alias("n_rows"), F.sum("runs").alias("runs"), F.sort_array(F.collect_list(boundary)).alias("b")
    )
    seams = F.expr("size(filter(b, (x, i) -> i > 0 and x.side = 0 and b[i - 1].side = 1 and x.id = b[i - 1].id))")
    names = [F.col(f"k{i}").alias(c) for i, c in enumerate(keys)]
    return states.select(*names, "n_rows", (F.col("runs") - F.when(F.size("b") > 1, seams).otherwise(0)).alias("n_distinct"))
