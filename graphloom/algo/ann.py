"""The index behind CREATE VECTOR INDEX: vectors in cells of similar direction.

Cells are fitted on a bounded sample; every vector is put into the cell of the
nearest centre and stored in the folder of its cell.  A search reads the folders
of the ``probes`` nearest centres and ranks what it finds by the true vectors.
With as many probes as cells it is exact.  The index belongs to a version of the
graph and is built again by the first search after a change.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.algo import vector
from graphloom.scratch import scratch_path
from graphloom.store import GraphStore

SAMPLE = 20_000
CELLS = 1024
PROBES = 16


@dataclass
class VectorIndex:
    version: int
    size: int
    centres: np.ndarray
    path: str
    rows: DataFrame  # _id, vector, cell


def _directions(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]


def build(rows: DataFrame, key: str, prop: str, size: int, version: int = 0) -> VectorIndex:
    """Index the vectors of ``size`` numbers; others are not found by a search of that size."""
    spark = rows.sparkSession
    fits = rows.where(F.size(prop) == size).select(F.col(key).alias("_id"), F.col(prop).cast("array<float>").alias("vector")).where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x)))
    drawn = fits.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE).select("vector").toPandas()["vector"]
    x = _directions(np.stack(drawn.to_numpy()).astype(np.float32)) if len(drawn) else np.zeros((1, size), np.float32)
    rng = np.random.default_rng(1)
    centres = x[rng.permutation(len(x))[: max(1, min(CELLS, ceil(sqrt(len(x)))))]].copy()
    for _ in range(8):
        own = (x @ centres.T).argmax(1)
        for c in range(len(centres)):
            if (own == c).any():
                centres[c] = x[own == c].mean(0)
        centres = _directions(centres)
    shared = spark.sparkContext.broadcast(centres)  # at most CELLS vectors

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                cell = (_directions(np.stack(b["vector"].to_numpy()).astype(np.float32)) @ shared.value.T).argmax(1)
                yield b.assign(cell=cell.astype(np.int32))

    path = scratch_path(spark, "vectors")
    fits.mapInPandas(placed, "_id bigint, vector array<float>, cell int").write.partitionBy("cell").parquet(path)
    return VectorIndex(version, size, centres, path, spark.read.schema("_id bigint, vector array<float>, cell int").parquet(path))


def probe(index: VectorIndex, query: Sequence[float], k: int, metric: str = "cosine", probes: int = PROBES) -> DataFrame:
    """``node``, ``similarity`` of the best in the cells nearest to the query."""
    q = np.asarray(query, np.float32)
    near = np.argsort(-(index.centres @ q), kind="stable")[:probes]
    return vector.search(index.rows.where(F.col("cell").isin([int(c) for c in near])), "_id", "vector", query, k, metric)


def search(store: GraphStore, label: str, prop: str, query: Sequence[float], k: int, metric: str, probes: int) -> DataFrame:
    """Search the index of a property, which is built or renewed when needed."""
    key = (label, prop, len(query))
    index = store.vector_indexes.get(key)
    if index is None or index.version != store.version:
        index = store.vector_indexes[key] = build(store.vertices(label), "_id", prop, len(query), store.version)
    return probe(index, query, k, metric, probes)
