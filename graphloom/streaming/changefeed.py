"""Current state of a table from a feed of inserts, updates and deletes.

A streaming aggregation keeps one state row per key: the sequence of the last
accepted change, its tombstone flag and its payload.  The state is the maximum
of ``(sequence, tombstone, payload)``, so a change is accepted only when it is
newer, repeated deliveries are no-ops, and the order of arrival is irrelevant.
The maximum is combined on the map side before the shuffle, so a key or a
source that holds a large part of the feed costs one row per input task.

Every micro-batch upserts the touched keys into ``batch=<id>``, overwriting
that folder: replaying a batch after a failure writes the same rows again.  A
folder counts once its success marker is there, so a reader needs no list of
batches and sees the same after a restart.  From time to time the folders are
merged into ``base=<id>``, which replaces all batches up to that one.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.scratch import delete, exists, scratch_path

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_INHERITED = ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.files.maxPartitionBytes")


class ChangeFeed:
    """Keyed, idempotent application of a change feed.

    ``keys`` identify a row; ``sequence`` columns order the changes of a key
    (the first one is required, nulls in the others sort lowest); ``tombstone``
    is true for deletions (null is false); ``payload`` columns are carried.
    A change with a null in ``required`` or in the first sequence column
    changes nothing.  Other columns of the feed are ignored, whatever they are
    called.  Changes that agree in the whole sequence are ordered by tombstone
    and payload, so the result does not depend on arrival.  Null keys form
    keys like any other value.  An empty feed gives an empty state.
    """

    def __init__(self, keys: Sequence[str], sequence: Sequence[str], tombstone: str, payload: Sequence[str] = (), required: Sequence[str] = ()):
        self.keys, self.sequence = list(keys), list(sequence)
        self.tombstone, self.payload = tombstone, list(payload)
        self.required = list(dict.fromkeys([self.sequence[0], *required]))

    def _newest(self, changes: DataFrame) -> DataFrame:
        """One row per key: the accepted state of these changes."""
        for c in self.required:
            changes = changes.where(F.col(c).isNotNull())
        state = F.struct(
            *self.sequence,
            F.coalesce(F.col(self.tombstone), F.lit(False)).alias(self.tombstone),
            *self.payload,
        )
        return changes.groupBy(*self.keys).agg(F.max(state).alias("_state"))

    def run(self, spark: SparkSession, path: str, schema: T.StructType, output: str, checkpoint: str, files_per_batch: int | None = None, merge_after: int = 8) -> list[int]:
        """Apply the feed files of ``path`` to the batch-versioned ``output``.

        Restarting with the same ``checkpoint`` goes on where the last run
        ended.  When ``merge_after`` batches lie beside the base they are merged
        into a new one.  Returns the ids of the batches written by this run.
        """
        session = spark.newSession()  # the state store is set without touching the caller's session
        for name in _INHERITED:
            value = spark.conf.get(name, None)
            if value is not None:
                session.conf.set(name, value)
        session.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
        session.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
        written: list[int] = []

        def upsert(batch: DataFrame, batch_id: int) -> None:
            batch.select(*self.keys, "_state.*").write.mode("overwrite").parquet(f"{output}/batch={batch_id}")
            written.append(batch_id)
            if len(self._committed(batch.sparkSession, output)[1]) >= merge_after:
                self.merge(batch.sparkSession, output, schema)

        reader = session.readStream.schema(schema)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        query = (
            self._newest(reader.parquet(f"{path[:-1]}[{path[-1]}]"))  # as a glob, a single file is allowed too
            .writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(upsert)
            .start()
        )
        query.awaitTermination()
        return written

    @staticmethod
    def _committed(spark: SparkSession, output: str) -> tuple[int | None, list[int]]:
        """The last complete base and the complete batches after it."""
        def ids(kind: str) -> list[int]:
            return sorted(int(p.split("/")[-2].split("=")[1]) for p in exists(spark, f"{output}/{kind}=*/_SUCCESS"))

        base = ids("base")
        last = base[-1] if base else None
        return last, [b for b in ids("batch") if last is None or b > last]

    def _state(self, spark: SparkSession, output: str, schema: T.StructType) -> DataFrame:
        """The last accepted change of every key, deletions included."""
        used = [*self.keys, *self.sequence, self.tombstone, *self.payload]
        kept = T.StructType([T.StructField(c, schema[c].dataType) for c in used])
        base, batches = self._committed(spark, output)
        paths = [f"{output}/base={base}"] * (base is not None) + [f"{output}/batch={b}" for b in batches]
        if not paths:
            return spark.createDataFrame([], kept)
        upserts = spark.read.schema(kept).parquet(*paths)
        # within a folder each key occurs once
        return self._newest(upserts).select(*self.keys, "_state.*") if len(paths) > 1 else upserts

    def merge(self, spark: SparkSession, output: str, schema: T.StructType) -> None:
        """Write all folders as one base, then delete what it replaces; running it again does no harm."""
        old, batches = self._committed(spark, output)
        if not batches:
            return
        self._state(spark, output, schema).write.mode("overwrite").parquet(f"{output}/base={batches[-1]}")
        for gone in [f"base={old}"] * (old is not None) + [f"batch={b}" for b in batches]:
            delete(spark, f"{output}/{gone}")

    def current(self, spark: SparkSession, output: str, schema: T.StructType) -> DataFrame:
        """All live rows of a batch-versioned output: keys, sequence, payload."""
        return self._state(spark, output, schema).where(~F.col(self.tombstone)).drop(self.tombstone)


def replay(spark: SparkSession, path: str, feed: ChangeFeed, files_per_batch: int | None = None) -> DataFrame:
    """Run ``feed`` over all files below ``path`` and return the live rows."""
    schema = spark.read.parquet(path).schema
    home = scratch_path(spark, "feed")
    feed.run(spark, path, schema, os.path.join(home, "upserts"), os.path.join(home, "state"), files_per_batch)
    return feed.current(spark, os.path.join(home, "upserts"), schema)


def arriving(changes: DataFrame, feed: ChangeFeed, at: str, batches: int) -> tuple[str, int]:
    """Write a table of changes as a feed in which they come in the order of ``at``; returns its folder and the files of a batch.

    The files hold ranges of ``at`` (sampled quantiles) and only the columns
    the feed uses.  Reading so many files at a time makes ``batches``
    micro-batches, each of which meets the state that the earlier ones left.
    """
    spark = changes.sparkSession
    used = list(dict.fromkeys([*feed.keys, *feed.sequence, feed.tombstone, *feed.payload, *feed.required]))
    per_batch = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // batches))
    path = scratch_path(spark, "arriving")
    # the position spreads changes of one moment
    rows = changes.select(*used, F.col(at).alias(" at"), F.monotonically_increasing_id().alias(" pos"))
    rows.repartitionByRange(per_batch * batches, " at", " pos").select(*used).write.parquet(path)
    return path, per_batch
