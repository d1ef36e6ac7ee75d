"""Statements in, DataFrames out."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from time import perf_counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.algo.registry import run_procedure
from graphloom.errors import ExecutionError, GraphError, SchemaError
from graphloom.language import syntax as S
from graphloom.language.lexer import split_statements
from graphloom.language.parser import parse
from graphloom.plans.compiler import Bound, Compiler, Rows, col
from graphloom.plans.explain import steps, tree
from graphloom.scratch import materialise
from graphloom.store import GraphStore


class GraphSession:
    """Named graphs and the statements run on them; a graph ``default`` always exists."""

    def __init__(self, spark: SparkSession, store: GraphStore | None = None):
        self.spark = spark
        self.graphs: dict[str, GraphStore] = {"default": store or GraphStore(spark)}
        self.active = "default"
        self.functions: dict[str, Callable] = {}
        self.procedures: dict[str, Callable] = {}

    @property
    def store(self) -> GraphStore:
        return self.graphs[self.active]

    def register_function(self, name: str, function: Callable) -> None:
        """A scalar function of columns for use in queries."""
        self.functions[name.lower()] = function

    def register_procedure(self, name: str, procedure: Callable) -> None:
        """A procedure ``(store, arguments) -> DataFrame`` for CALL."""
        self.procedures[name.lower()] = procedure

    # entry points

    def query(self, text: str, graph: str | None = None) -> DataFrame:
        """Run one statement; statements without rows return ``message`` and ``rows_affected``."""
        before = self.active
        if graph is not None:
            self.active = self._graph(graph)
        try:
            return self._run(parse(text))
        finally:
            if graph is not None:
                self.active = before

    def script(self, text: str) -> list[DataFrame]:
        """All statements of a script, up to the first error."""
        return [self.query(s) for s in split_statements(text)]

    def batch(self, statements: list[str]) -> list[DataFrame | GraphError]:
        """Every statement, errors in the place of results."""
        out: list[DataFrame | GraphError] = []
        for s in statements:
            try:
                out.append(self.query(s))
            except GraphError as x:
                out.append(x)
        return out

    def execute(self, text: str, graph: str | None = None) -> dict:
        """One statement as plain values: status, columns, rows, counts and microseconds; errors are reported, not raised."""
        began = perf_counter()
        took = lambda: int((perf_counter() - began) * 1e6)
        try:
            df = self.query(text, graph)
            rows = [list(r) for r in df.collect()]
        except GraphError as x:
            return {"status": "error", "error": str(x), "elapsed_us": took()}
        changed = sum(r[1] for r in rows) if df.columns == ["message", "rows_affected"] else 0
        return {"status": "ok", "columns": df.columns, "rows": rows, "num_rows": len(rows), "rows_affected": changed, "elapsed_us": took()}

    def json(self, text: str, graph: str | None = None) -> str:
        return json.dumps(self.execute(text, graph), default=str)

    def export(self, path: str) -> None:
        """Write the graph as a statement script: definitions, then one INSERT per row, as text files below ``path``."""
        c = self.store.catalog
        literal = lambda col, t: F.when(col.isNull(), F.lit("NULL")).otherwise(
            F.concat(F.lit("'"), F.regexp_replace(F.regexp_replace(col.cast("string"), "\\\\", "\\\\\\\\"), "'", "\\\\'"), F.lit("'")) if t in ("STRING", "VARCHAR", "TEXT", "DATE", "TIMESTAMP")
            else F.to_json(col) if t.startswith("VECTOR") else col.cast("string"))
        lines = []
        for kind, word, entities in (("vertex", "VERTEX", c.labels), ("edge", "EDGE", c.types)):
            for e in entities.values():
                lines.append(f"CREATE {word} {e.name} (" + ", ".join(f"{p} {t}" for p, t in e.properties.items()) + ");")
        script = self.spark.createDataFrame([(t,) for t in lines], "value string").coalesce(1)
        script.write.mode("overwrite").text(f"{path}/1-definitions")
        for kind, word, entities in (("vertex", "VERTEX", c.labels), ("edge", "EDGE", c.types)):
            for e in entities.values():
                values = [literal(F.col(f"`{p}`"), t) for p, t in e.properties.items()]
                df = self.store.read(kind, e.name)
                if kind == "vertex":
                    head = f"INSERT VERTEX {e.name} (" + ", ".join(["id", *e.properties]) + ") VALUES ("
                    text = F.concat(F.lit(head), F.concat_ws(", ", F.col("_id").cast("string"), *values), F.lit(");"))
                else:
                    head = f"INSERT EDGE {e.name} (" + ", ".join(e.properties) + ") VALUES ("
                    text = F.concat(F.lit(head), F.concat_ws(", ", *(F.col(k).cast("string") for k in ("_src", "_dst", "_rank"))), F.lit(")"), *([F.lit(": ("), F.concat_ws(", ", *values), F.lit(")")] if values else []), F.lit(";"))
                df.select(text.alias("value")).write.mode("overwrite").text(f"{path}/{2 if kind == 'vertex' else 3}-{e.name}")

    def explain(self, text: str) -> str:
        return tree(parse(text), self.store.catalog)

    def compact(self) -> int:
        return self.store.compact()

    def snapshot(self, path: str | None = None) -> str:
        return self.store.snapshot(path)

    def stats(self) -> dict:
        return self.store.statistics()

    def schema(self) -> dict:
        """Labels and edge types with properties, indexes and counts."""
        c = self.store.catalog
        shown = lambda kind, e: {"name": e.name, "id": e.number, "properties": dict(e.properties), "indexes": sorted(e.indexes), "count": self.store.read(kind, e.name).count()}
        return {"vertices": [shown("vertex", e) for e in c.labels.values()], "edges": [shown("edge", e) for e in c.types.values()]}

    # statements

    def _status(self, message: str, n: int = 0) -> DataFrame:
        return self.spark.createDataFrame([(message, n)], "message string, rows_affected bigint")

    def _graph(self, name: str) -> str:
        name = name.lower()
        if name not in self.graphs:
            raise SchemaError(f"unknown graph {name}")
        return name

    def _run(self, s) -> DataFrame:
        store = self.store
        if isinstance(s, S.Query):
            return self._query(s)
        if isinstance(s, S.Procedure):
            return run_procedure(store, s, self.procedures)
        if isinstance(s, S.Explain):
            rows = steps(s.statement, store.catalog)
            return self.spark.createDataFrame(rows, "step int, operator string, details string, cost double")
        if isinstance(s, S.Define):
            store.define(s.kind, s.name, s.properties)
            return self._status(f"created {s.kind} {s.name}")
        if isinstance(s, S.Alter):
            store.alter(s.kind, s.name, s.add, s.drop)
            return self._status(f"altered {s.kind} {s.name}")
        if isinstance(s, S.IndexOn):
            return self._index(s)
        if isinstance(s, S.Drop):
            return self._drop(s)
        if isinstance(s, S.CreateGraph):
            name = s.name.lower()
            if name in self.graphs and not s.lenient:
                raise SchemaError(f"graph {name} already exists")
            self.graphs.setdefault(name, GraphStore(self.spark, name))
            return self._status(f"created graph {name}")
        if isinstance(s, S.UseGraph):
            self.active = self._graph(s.name)
            return self._status(f"using graph {self.active}")
        if isinstance(s, S.Show):
            return self._show(s.what)
        if isinstance(s, S.Analyze):
            return self._analyze()
        if isinstance(s, S.Maintain):
            if s.what == "compact":
                return self._status("compacted", store.compact())
            return self.spark.createDataFrame([(store.snapshot(), store.version)], "snapshot string, version bigint")
        if isinstance(s, S.PutVertices):
            return self._put_vertices(s)
        if isinstance(s, S.PutEdges):
            return self._put_edges(s)
        if isinstance(s, S.DeleteEdge):
            edges = store.edges(s.type).where((F.col("_src") == s.source) & (F.col("_dst") == s.target))
            if s.rank is not None:
                edges = edges.where(F.col("_rank") == s.rank)
            return self._status("deleted edges", store.delete("edge", s.type, edges))
        raise ExecutionError(f"cannot run {type(s).__name__}")

    def _index(self, s: S.IndexOn) -> DataFrame:
        e = self.store.catalog.find("vertex", s.label)
        if s.prop not in e.properties:
            raise SchemaError(f"{e.name} has no property {s.prop}")
        if s.drop:
            if e.indexes.pop(s.prop, None) is None:
                raise SchemaError(f"{e.name}.{s.prop} has no index")
            return self._status(f"dropped the index on {e.name}.{s.prop}")
        e.indexes[s.prop] = s.vector
        return self._status(f"created an index on {e.name}.{s.prop}")

    def _drop(self, s: S.Drop) -> DataFrame:
        if s.kind != "graph":
            self.store.drop(s.kind, s.name)
            return self._status(f"dropped {s.kind} {s.name}")
        name = s.name.lower()
        if name == "default":
            raise SchemaError("the graph default cannot be dropped")
        if name not in self.graphs and not s.lenient:
            raise SchemaError(f"unknown graph {name}")
        self.graphs.pop(name, None)
        if self.active == name:
            self.active = "default"
        return self._status(f"dropped graph {name}")

    def _show(self, what: str) -> DataFrame:
        c = self.store.catalog
        props = lambda e: ", ".join(f"{p} {t}" for p, t in e.properties.items())
        marks = lambda e: ", ".join(sorted(e.indexes))
        if what in ("schema", "indexes"):
            rows = [(k, e.name, e.number, props(e), marks(e)) for k, m in (("vertex", c.labels), ("edge", c.types)) for e in m.values() if what == "schema" or e.indexes]
            return self.spark.createDataFrame(rows, "entity_type string, name string, id int, properties string, indexes string")
        if what == "vertices":
            return self.spark.createDataFrame([(e.name, e.number, props(e), marks(e)) for e in c.labels.values()], "label string, label_id int, properties string, indexes string")
        if what == "edges":
            return self.spark.createDataFrame([(e.name, e.number, props(e)) for e in c.types.values()], "edge_type string, edge_id int, properties string")
        rows = []
        for name, g in self.graphs.items():
            stats = g.statistics()
            rows.append((name, name == self.active, len(g.catalog.labels), len(g.catalog.types), stats["total_vertices"], stats["total_edges"]))
        return self.spark.createDataFrame(rows, "graph_name string, active boolean, vertex_labels int, edge_types int, total_vertices bigint, total_edges bigint")

    def _analyze(self) -> DataFrame:
        s = self.store.statistics()
        row = (s["total_vertices"], s["total_edges"], s["vertices_per_label"], s["edges_per_type"], float(s["avg_degree"]), s["max_degree"])
        return self.spark.createDataFrame([row], "total_vertices bigint, total_edges bigint, vertices_per_label map<string,bigint>, edges_per_type map<string,bigint>, avg_degree double, max_degree bigint")

    def _literals(self, columns: list[str], rows: list[tuple], types: dict) -> DataFrame:
        """Literal rows as text or numbers; the store casts them to the declared types."""
        def plain(v, t: str):
            if v is None or t.startswith("array"):
                return None if v is None else [float(x) for x in v]
            if t == "bigint" and isinstance(v, float) and v != int(v):
                raise ExecutionError(f"{v} is no integer")
            return {"bigint": int, "double": float, "boolean": bool}.get(t, str)(v)

        names = [types[c].simpleString() for c in columns]
        kinds = [n if n in ("bigint", "double", "boolean") or n.startswith("array") else "string" for n in names]
        data = [tuple(plain(v, t) for v, t in zip(r, kinds)) for r in rows]
        return self.spark.createDataFrame(data, ", ".join(f"`{c}` {k}" for c, k in zip(columns, kinds)))

    def _put_vertices(self, s: S.PutVertices) -> DataFrame:
        e = self.store.catalog.find("vertex", s.label)
        columns = ["_id" if c.lower() in ("id", "_id") and c not in e.properties else c for c in s.columns]
        types = {f.name: f.dataType for f in self.store.catalog.schema("vertex", e.name).fields}
        if unknown := [c for c in columns if c not in types]:
            raise SchemaError(f"{e.name} has no property {unknown[0]}")
        if "_id" not in columns:
            if not s.merge:
                raise ExecutionError("a vertex needs an id")
            return self._merge_by_properties(e.name, columns, s.rows, types)
        at = columns.index("_id")
        last = {r[at]: r for r in s.rows}  # of rows with one id the last counts
        if None in last:
            raise ExecutionError("a vertex needs an id")
        rows = self._literals(columns, list(last.values()), types)
        n = self.store.merge(e.name, rows) if s.merge else self.store.upsert("vertex", e.name, rows)
        return self._status("merged vertices" if s.merge else "inserted vertices", n)

    def _merge_by_properties(self, label: str, columns: list[str], rows: tuple, types: dict) -> DataFrame:
        """Add the rows that no vertex matches in the named properties; new ids follow the greatest one of all labels."""
        rows = tuple(dict.fromkeys(rows))
        given = self._literals([" at", *columns], [(i, *r) for i, r in enumerate(rows)], {" at": T.LongType(), **types})
        given = given.select(" at", *(F.col(f"`{c}`").cast(types[c]).alias(f" {c}") for c in columns))
        have = self.store.vertices(label).select(*columns)
        same = reduce(lambda a, b: a & b, (F.col(f"`{c}`").eqNullSafe(F.col(f"` {c}`")) for c in columns))
        new = sorted(r[0] for r in given.join(have, same, "left_anti").select(" at").collect())  # at most the rows of the statement
        if not new:
            return self._status("merged vertices", 0)
        tops = [self.store.vertices(n).agg(F.max("_id").alias("m")) for n in self.store.catalog.labels]
        top = reduce(DataFrame.unionByName, tops).agg(F.max("m")).first()[0] or 0
        made = [(top + 1 + k, *rows[i]) for k, i in enumerate(new)]
        return self._status("merged vertices", self.store.upsert("vertex", label, self._literals(["_id", *columns], made, types)))

    def _put_edges(self, s: S.PutEdges) -> DataFrame:
        e = self.store.catalog.find("edge", s.type)
        types = {f.name: f.dataType for f in self.store.catalog.schema("edge", e.name).fields}
        if unknown := [c for c in s.columns if c not in types]:
            raise SchemaError(f"{e.name} has no property {unknown[0]}")
        last = {(a, rank, b): (a, rank, b, *(values or (None,) * len(s.columns))) for a, b, rank, values in s.rows}
        rows = self._literals(["_src", "_rank", "_dst", *s.columns], list(last.values()), types)
        return self._status("inserted edges", self.store.upsert("edge", e.name, rows))

    # queries

    def _query(self, q: S.Query) -> DataFrame:
        compiler = Compiler(self.store, self.functions)
        rows: Rows | None = None
        changed = 0
        for clause in q.clauses:
            if isinstance(clause, S.Match):
                rows = compiler.match(rows, clause)
            elif isinstance(clause, S.Projection):
                if rows is None:
                    rows = Rows(self.spark.range(1).select(), {})
                rows = compiler.project(rows, clause)
                if clause.final:
                    return rows.df
            else:
                if rows is None:
                    raise ExecutionError("an update needs matched rows")
                rows = Rows(materialise(rows.df, "matched"), rows.scope)
                changed += self._mutate(compiler, rows, clause)
        if changed or any(not isinstance(c, (S.Match, S.Projection)) for c in q.clauses):
            return self._status("updated", changed)
        return self._status("matched", rows.df.count())

    def _mutate(self, compiler: Compiler, rows: Rows, clause) -> int:
        store = self.store
        if isinstance(clause, S.LinkVertices):
            for v in (clause.source, clause.target):
                if v not in rows.scope or rows.scope[v].kind != "node":
                    raise ExecutionError(f"{v} is no bound vertex")
            ends = {"_src": col(f"{clause.source}$_id"), "_dst": col(f"{clause.target}$_id"), "_rank": F.lit(0)}
            new = rows.df.select(*(c.cast("bigint").alias(n) for n, c in ends.items()), *(compiler.value(e, rows.scope).alias(p) for p, e in clause.props))
            if clause.merge:
                new = new.join(store.edges(clause.type).select("_src", "_rank", "_dst"), ["_src", "_rank", "_dst"], "left_anti")
            return store.upsert("edge", clause.type, new)
        total = 0
        names = [v for v, _, _ in clause.items] if isinstance(clause, S.SetProperties) else list(clause.names)
        for var in dict.fromkeys(names):
            bound: Bound | None = rows.scope.get(var)
            if bound is None or bound.kind == "value":
                raise ExecutionError(f"{var} is no bound vertex or edge")
            kind, tag = ("vertex", "_label") if bound.kind == "node" else ("edge", "_type")
            key = GraphStore.key(kind)
            tables = [r[0] for r in rows.df.select(col(f"{var}${tag}")).distinct().collect()]  # names of the catalog
            for name in tables:
                mine = rows.df.where(col(f"{var}${tag}") == name)
                keys = [col(f"{var}${k}").alias(k) for k in key]
                if isinstance(clause, S.Delete):
                    ids = mine.select(*keys).distinct()
                    if kind == "vertex" and clause.detach:
                        for t in store.catalog.types:
                            edges = store.edges(t)
                            touched = edges.join(ids.withColumnRenamed("_id", "_src"), "_src", "left_semi").unionByName(edges.join(ids.withColumnRenamed("_id", "_dst"), "_dst", "left_semi"))
                            if not touched.isEmpty():
                                store.delete("edge", t, touched)
                    total += store.delete(kind, name, ids)
                else:
                    sets = {p: e for v, p, e in clause.items if v == var}
                    known = store.catalog.find(kind, name).properties
                    if missing := [p for p in sets if p not in known]:
                        raise SchemaError(f"{name} has no property {missing[0]}")
                    new = mine.select(*keys, *(compiler.value(e, rows.scope).alias(p) for p, e in sets.items()))
                    new = new.groupBy(*key).agg(F.max(F.struct(*sets)).alias(" s")).select(*key, "` s`.*")  # a row matched often is set once
                    rest = store.read(kind, name).drop(*sets)
                    total += store.upsert(kind, name, rest.join(new, key))
        return total
