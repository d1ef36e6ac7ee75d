"""Top-k vector search by a query vector."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def score(vector: Column, query: Sequence[float], metric: str = "cosine") -> Column:
    """Similarity, larger is better: cosine (0 for a zero vector), inner product, or 1/(1+distance); unknown names mean cosine."""
    q = F.array(*(F.lit(float(x)) for x in query))
    metric = metric.lower()
    if metric in ("dot", "dot_product"):
        return _dot(vector, q)
    if metric in ("l2", "euclidean"):
        square = F.aggregate(F.zip_with(vector, q, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
        return 1.0 / (1.0 + F.sqrt(square))
    norms = F.sqrt(_dot(vector, vector)) * sum(float(x) ** 2 for x in query) ** 0.5
    return F.when(norms == 0, 0.0).otherwise(_dot(vector, q) / norms)


def search(rows: DataFrame, key: str, vector: str, query: Sequence[float], k: int = 10, metric: str = "cosine") -> DataFrame:
    """``node``, ``similarity`` of the ``k`` best; vectors of another size are skipped, ties go to the least key."""
    fits = rows.where(F.size(vector) == len(query))
    return fits.select(F.col(key).alias("node"), score(F.col(vector), query, metric).alias("similarity")).orderBy(F.desc("similarity"), "node").limit(k)
