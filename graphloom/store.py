"""Versioned vertex and edge tables of one graph.

Every label and edge type has a base frame and a list of changes, each with a
commit version: upserts and tombstones.  Reading merges them; ``compact``
writes the merged rows as the new base.  A superseded base stays for reads of
older versions until ``forget`` drops it.  Edges are identified by source,
type, rank and target, vertices by id.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.catalog import Catalog, declared_type
from graphloom.errors import ExecutionError
from graphloom.scratch import materialise, scratch_path

MANY_CHANGES = 16  # a table with more changes is compacted before it is read


@dataclass
class _Table:
    base: DataFrame
    changes: list[tuple[int, DataFrame]] = field(default_factory=list)  # with column _deleted
    since: int = 0  # the version of the base
    past: _Table | None = None  # the table as it was before ``since``


class GraphStore:
    """The data of one graph space."""

    def __init__(self, spark: SparkSession, name: str = "default"):
        self.spark, self.name = spark, name
        self.catalog = Catalog()
        self.version = 0
        self._tables: dict[tuple[str, str], _Table] = {}
        self.vector_indexes: dict = {}

    # definition

    def define(self, kind: str, name: str, properties: tuple) -> None:
        entity = self.catalog.define(kind, name, properties)
        self._tables[kind, entity.name] = _Table(self.spark.createDataFrame([], self.catalog.schema(kind, name)), since=self.version)

    def register(self, kind: str, name: str, rows: DataFrame, properties: dict[str, str]) -> None:
        """Take a frame with the key columns (``_id`` or ``_src``, ``_dst`` and at choice ``_rank``) as the base of a new table."""
        entity = self.catalog.define(kind, name, tuple(properties.items()))
        self._tables[kind, entity.name] = _Table(self._fitted(kind, entity.name, rows), since=self.version)

    def drop(self, kind: str, name: str) -> None:
        entity = self.catalog.drop(kind, name)
        del self._tables[kind, entity.name]

    def alter(self, kind: str, name: str, add: tuple, drop: tuple) -> None:
        entity = self.catalog.find(kind, name)
        merged = self.read(kind, name)
        for p, t in add:
            if p in entity.properties:
                raise ExecutionError(f"{name}.{p} already exists")
            entity.properties[p] = t
        for p in drop:
            if p not in entity.properties:
                raise ExecutionError(f"{name}.{p} does not exist")
            del entity.properties[p]
            entity.indexes.pop(p, None)
        self.version += 1
        self._tables[kind, entity.name] = _Table(self._fitted(kind, entity.name, merged.drop(*drop)), since=self.version, past=self._tables[kind, entity.name])

    # reading

    @staticmethod
    def key(kind: str) -> list[str]:
        return ["_id"] if kind == "vertex" else ["_src", "_rank", "_dst"]

    def read(self, kind: str, name: str, version: int | None = None) -> DataFrame:
        """The rows visible at a commit version (the last one by default), with the columns of that time.

        A version before the table was made, or one that ``forget`` dropped, is an error.
        """
        name = self.catalog.find(kind, name).name
        table = self._tables[kind, name]
        if version is None:
            if len(table.changes) > MANY_CHANGES:
                table = self._compact(kind, name)
            return self._merged(kind, table)
        while table is not None and table.since > version:
            table = table.past
        if table is None:
            raise ExecutionError(f"{name} cannot be read at version {version}")
        return self._merged(kind, _Table(table.base, [(v, df) for v, df in table.changes if v <= version]))

    def _merged(self, kind: str, table: _Table) -> DataFrame:
        if not table.changes:
            return table.base
        key = self.key(kind)
        cols = [c for c in table.base.columns if c not in key]
        changes = None
        for v, df in table.changes:
            df = df.withColumn("_version", F.lit(v))
            changes = df if changes is None else changes.unionByName(df)
        latest = changes.groupBy(*key).agg(F.max_by(F.struct("_deleted", *cols), "_version").alias("s"))
        live = latest.where(~F.col("s._deleted")).select(*key, *(F.col("s")[c].alias(c) for c in cols))
        return table.base.join(latest.select(*key), key, "left_anti").unionByName(live)

    def forget(self, before: int) -> int:
        """Drop what only reads of versions older than ``before`` need; returns the number of bases dropped."""
        n = 0
        for table in self._tables.values():
            while table is not None and table.since > before:
                table = table.past
            while table is not None and table.past is not None:
                table.past, n = table.past.past, n + 1
        return n

    def vertices(self, label: str) -> DataFrame:
        return self.read("vertex", label)

    def edges(self, kind: str) -> DataFrame:
        return self.read("edge", kind)

    def all_edges(self, kinds: list[str] | None = None) -> DataFrame:
        """``_src``, ``_type``, ``_rank``, ``_dst`` of the given types, or of all."""
        frames = [self.edges(k).select("_src", F.lit(k).alias("_type"), "_rank", "_dst") for k in (kinds if kinds is not None else self.catalog.types)]
        if not frames:
            return self.spark.createDataFrame([], "_src bigint, _type string, _rank bigint, _dst bigint")
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    # writing

    def _fitted(self, kind: str, name: str, rows: DataFrame, order: Sequence[str] = ()) -> DataFrame:
        """Exactly the columns of the table, cast to their types; absent ones are null.  ``order`` columns come along as `` o0`` and so on."""
        schema = self.catalog.schema(kind, name)
        cols = []
        for f in schema.fields:
            if f.name in rows.columns:
                value = F.col(f"`{f.name}`").cast(f.dataType)
            elif f.name == "_rank":
                value = F.lit(0).cast("bigint")
            else:
                value = F.lit(None).cast(f.dataType)
            cols.append(value.alias(f.name))
        cols += [F.col(f"`{c}`").alias(f" o{i}") for i, c in enumerate(order)]
        return rows.select(*cols)

    def _commit(self, kind: str, name: str, rows: DataFrame, deleted: bool) -> int:
        self.version += 1
        name = self.catalog.find(kind, name).name
        # written before it is applied: the rows may have been read from the same table
        rows = materialise(self._fitted(kind, name, rows).withColumn("_deleted", F.lit(deleted)), "change")
        self._tables[kind, name].changes.append((self.version, rows))
        return rows.count()

    def upsert(self, kind: str, name: str, rows: DataFrame, order: Sequence[str] = ()) -> int:
        """Replace or add whole rows by key.

        Of rows that share a key the last in ``order`` remains (columns of
        ``rows``, nulls first), and of rows equal in that the greatest by value.
        """
        key = self.key(kind)
        fitted = self._fitted(kind, name, rows, order)
        rest = [c for c in fitted.columns if c not in key]
        last = fitted.groupBy(*key).agg(F.max(F.struct(*(f" o{i}" for i in range(len(order))), *(c for c in rest if not c.startswith(" o")))).alias("s")) if rest else fitted.distinct()
        return self._commit(kind, name, last.select(*key, "s.*") if rest else last, False)

    def delete(self, kind: str, name: str, keys: DataFrame) -> int:
        key = self.key(kind)
        return self._commit(kind, name, keys.select(*key).distinct(), True)

    def merge(self, label: str, rows: DataFrame) -> int:
        """Upsert that keeps the properties ``rows`` does not name."""
        given = [c for c in rows.columns if c != "_id"]
        old = self.vertices(label)
        rest = [c for c in old.columns if c not in (*given, "_id")]
        return self.upsert("vertex", label, rows.join(old.select("_id", *rest), "_id", "left"))

    def _compact(self, kind: str, name: str) -> _Table:
        table = self._tables[kind, name]
        if not table.changes:
            return table
        merged = self._merged(kind, table)
        indexed = sorted(self.catalog.find(kind, name).indexes)
        if indexed and kind == "vertex":  # sorted files let equality filters skip row groups
            merged = merged.sortWithinPartitions(indexed[0])
        self._tables[kind, name] = _Table(materialise(merged, "base"), since=table.changes[-1][0], past=table)
        return self._tables[kind, name]

    def compact(self) -> int:
        """Merge the changes of all tables into their bases; returns the number of tables rewritten."""
        pending = [k for k, t in self._tables.items() if t.changes]
        for kind, name in pending:
            self._compact(kind, name)
        return len(pending)

    def snapshot(self, path: str | None = None) -> str:
        """Write all tables as compressed Parquet, and the catalog beside them, below ``path``/v=<version>."""
        self.compact()
        root = f"{path or scratch_path(self.spark, 'snapshot')}/v={self.version}"
        for kind, name in self._tables:
            self.read(kind, name).write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/{kind}/{name}")
        text = json.dumps({"version": self.version, "name": self.name, **self.catalog.described()})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/catalog")
        return root

    def restore(self, root: str) -> None:
        """Become the graph of a snapshot: its catalog, tables and version; a new process needs nothing else."""
        known = json.loads(self.spark.read.text(f"{root}/catalog", wholetext=True).first()[0])
        self.catalog = Catalog.from_description(known)
        self.version = int(known["version"])
        self._tables, self.vector_indexes = {}, {}
        for kind, entities in (("vertex", self.catalog.labels), ("edge", self.catalog.types)):
            for name in entities:
                schema: T.StructType = self.catalog.schema(kind, name)
                self._tables[kind, name] = _Table(self.spark.read.schema(schema).parquet(f"{root}/{kind}/{name}"), since=self.version)

    def ingest(self, rows: DataFrame, name: str | None = None, order: Sequence[str] = ()) -> int:
        """Add a batch of any source: edges if it has ``src`` and ``dst``, else vertices by ``id`` or ``_id``.

        Without a name the batch goes to the only table of its kind; if there
        is none, one named VERTEX or EDGE is made from the batch's columns.
        ``order`` decides between rows of one key, as in ``upsert``.
        """
        lower = {c.lower().lstrip("_"): c for c in rows.columns}
        kind = "edge" if {"src", "dst"} <= lower.keys() else "vertex"
        known = self.catalog.types if kind == "edge" else self.catalog.labels
        keys = ("src", "dst", "rank") if kind == "edge" else ("id",)
        for k in keys:
            if k in lower:
                rows = rows.withColumnRenamed(lower[k], f"_{k}")
        if kind == "vertex" and "_id" not in rows.columns:
            raise ExecutionError("a batch of vertices needs an id")
        if name is None:
            if len(known) > 1:
                raise ExecutionError("the batch names no table and there is more than one")
            name = next(iter(known), None) or kind.upper()
        if not known:
            declared = {c: declared_type(t) for c, t in rows.dtypes if c not in self.key(kind)}
            self.define(kind, name, tuple((c, t) for c, t in declared.items() if t))
        return self.upsert(kind, name, rows, order)

    def ingest_stream(self, stream: DataFrame, checkpoint: str, name: str | None = None, order: Sequence[str] = ()):
        """Feed a streaming frame into the store, one commit per micro-batch; returns the running query.

        Upserts are idempotent, so a micro-batch that is replayed changes nothing.
        """
        def take(batch: DataFrame, _: int) -> None:
            if not batch.isEmpty():
                self.ingest(batch, name, order)

        return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(take).start()

    def statistics(self) -> dict:
        """Totals, counts per label and type, average and greatest out-degree."""
        labels = {n: self.vertices(n).count() for n in self.catalog.labels}
        edges = self.all_edges()
        per_type = {r["_type"]: r["n"] for r in edges.groupBy("_type").agg(F.count("*").alias("n")).collect()}
        degree = edges.groupBy("_src").agg(F.count("*").alias("d")).agg(F.max("d").alias("m")).first()["m"] or 0
        n_vertices, n_edges = sum(labels.values()), sum(per_type.values())
        return {
            "total_vertices": n_vertices, "total_edges": n_edges, "vertices_per_label": labels,
            "edges_per_type": {t: per_type.get(t, 0) for t in self.catalog.types},
            "avg_degree": n_edges / n_vertices if n_vertices else 0.0, "max_degree": degree,
        }
