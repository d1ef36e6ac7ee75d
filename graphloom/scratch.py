"""Shared scratch space and lineage cuts.

Everything an executor may have to read again is written to the folder the
cluster names in ``spark.checkpoint.dir``; a folder of our own is only made
when that setting is absent and all executors run on this machine.

What is written stays until ``release`` is called, since results are lazy and
read it; the end of the process releases what is left.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from math import ceil

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not base:
        current = context._jsc.sc().getCheckpointDir()
        base = current.get() if current.isDefined() else None
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("executors need a shared folder: set spark.checkpoint.dir")
        base = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/graphloom-{name}-{uuid.uuid4().hex[:12]}"
    _made[path] = spark
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, pattern: str) -> list[str]:
    """The paths of the shared file system that match a glob pattern."""
    where = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return [s.getPath().toString() for s in found or []]


def release() -> int:
    """Delete the scratch folders of this process; results that read them are gone."""
    n = 0
    while _made:
        path, spark = _made.popitem()
        try:
            delete(spark, path)
            n += 1
        except Exception:  # noqa: BLE001 - the session may be gone
            pass
    return n


atexit.register(release)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    Unlike ``checkpoint()`` the copy is columnar, so later passes prune
    columns and push filters; the partitioning is not kept.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_ROWS = 200_000  # rows of state or edges per partition of a loop


@contextmanager
def loop_partitions(spark: SparkSession, rows: int) -> Iterator[int]:
    """Shuffle into as many partitions as ``rows`` ask for, at most those of the session.

    Rounds of a loop join frames that are partitioned alike, so the adaptive
    planner, which would coalesce each of them differently, is off inside.
    """
    wanted = {"spark.sql.shuffle.partitions": str(max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(rows / _ROWS)))), "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield int(wanted["spark.sql.shuffle.partitions"])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint; keeps the hash partitioning for the next join."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
