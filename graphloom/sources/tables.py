"""Readers for table folders, edge lists and graph snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder`` (a file or a folder of files)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def edge_list(spark: SparkSession, path: str, sep: str = "\t", comment: str = "#") -> DataFrame:
    """A text edge list: two id columns, comment lines skipped.

    Lines whose first two fields are not integers are left out; an empty file
    gives an empty frame with columns ``src`` and ``dst``.
    """
    raw = spark.read.csv(path, sep=sep, comment=comment, schema="src string, dst string")
    ids = raw.select(*(F.expr(f"try_cast({c} as bigint)").alias(c) for c in ("src", "dst")))
    return ids.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
