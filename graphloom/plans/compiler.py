"""From clauses to DataFrames.

A bound vertex or edge ``a`` owns the columns ``a$_id``, ``a$name`` and so on;
a value ``x`` is the column ``$x``.  Patterns become equi joins, so Catalyst
prunes columns, pushes filters into the scans and picks the join methods.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.errors import ExecutionError
from graphloom.language import syntax as S
from graphloom.operators.reach import reachable, trails
from graphloom.store import GraphStore

AGGREGATES = {"count", "sum", "avg", "min", "max"}
_NODE = ("_id", "_label")
_EDGE = ("_src", "_type", "_rank", "_dst")


@dataclass
class Bound:
    kind: str  # node, edge, value
    props: dict[str, T.DataType] = field(default_factory=dict)


@dataclass
class Rows:
    """Rows of bindings."""

    df: DataFrame
    scope: dict[str, Bound]


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def about(df: DataFrame) -> float:
    """Rows of a frame of ids by the planner's statistics, without a job; only for comparing frames."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return max(1.0, float(str(size)) / (8 * (len(df.columns) + 1)))


def contains_aggregate(e) -> bool:
    if isinstance(e, S.Call):
        return e.name in AGGREGATES or any(map(contains_aggregate, e.args))
    if isinstance(e, S.Binary):
        return contains_aggregate(e.left) or contains_aggregate(e.right)
    if isinstance(e, S.Unary):
        return contains_aggregate(e.value)
    return isinstance(e, S.ListOf) and any(map(contains_aggregate, e.items))


def column_name(item: S.Item, i: int) -> str:
    if item.alias:
        return item.alias
    e = item.value
    if isinstance(e, S.Property):
        return f"{e.owner}.{e.name}"
    if isinstance(e, S.Name):
        return e.name
    if isinstance(e, S.Literal):
        return str(e.value)
    if isinstance(e, S.Call):
        return f"{e.name}(*)" if e.star else f"{e.name}(...)"
    return f"col_{i}"


class Compiler:
    def __init__(self, store: GraphStore, functions: dict | None = None):
        self.store = store
        self.functions = functions or {}
        self.fresh = 0

    def hidden(self, prefix: str) -> str:
        self.fresh += 1
        return f" {prefix}{self.fresh}"

    # expressions

    def value(self, e, scope: dict[str, Bound], groups: dict | None = None) -> Column:
        """The column of an expression; ``groups`` maps already computed expressions to columns."""
        if groups is not None and e in groups:
            return col(groups[e])
        if isinstance(e, S.Literal):
            return F.lit(e.value)
        if isinstance(e, S.ListOf):
            return F.array(*(self.value(x, scope, groups) for x in e.items))
        if isinstance(e, S.Name):
            if e.name not in scope:
                raise ExecutionError(f"{e.name} is not bound")
            return col(f"${e.name}") if scope[e.name].kind == "value" else self.entity(e.name, scope[e.name])
        if isinstance(e, S.Property):
            return self.prop(e, scope)
        if isinstance(e, S.Unary):
            v = self.value(e.value, scope, groups)
            return {"not": lambda: ~v, "-": lambda: -v, "is null": v.isNull, "is not null": v.isNotNull}[e.op]()
        if isinstance(e, S.Binary):
            return self.binary(e, scope, groups)
        if isinstance(e, S.Call):
            return self.call(e, scope, groups)
        raise ExecutionError(f"cannot evaluate {e}")

    def prop(self, e: S.Property, scope: dict[str, Bound]) -> Column:
        if e.owner not in scope:
            raise ExecutionError(f"{e.owner} is not bound")
        bound = scope[e.owner]
        if bound.kind == "value":
            raise ExecutionError(f"{e.owner} is a value and has no properties")
        if e.name in bound.props:
            return col(f"{e.owner}${e.name}")
        pseudo = "_" + e.name.lstrip("_")
        if pseudo in (_NODE if bound.kind == "node" else _EDGE):
            return col(f"{e.owner}${pseudo}")
        return F.lit(None).cast("string")

    def entity(self, name: str, bound: Bound) -> Column:
        """A whole vertex or edge as JSON text."""
        props = F.struct(*(col(f"{name}${p}").alias(p) for p in bound.props)) if bound.props else F.create_map().cast("map<string,string>")
        keys = {"id": "_id", "label": "_label"} if bound.kind == "node" else {"src": "_src", "dst": "_dst", "rank": "_rank"}
        return F.to_json(F.struct(*(col(f"{name}${c}").alias(k) for k, c in keys.items()), props.alias("properties")), {"ignoreNullFields": "false"})

    def binary(self, e: S.Binary, scope, groups) -> Column:
        a = self.value(e.left, scope, groups)
        if e.op == "in":
            if isinstance(e.right, S.ListOf):
                return a.isin(*(self.value(x, scope, groups) for x in e.right.items)) if e.right.items else F.lit(False)
            return F.array_contains(self.value(e.right, scope, groups), a)
        b = self.value(e.right, scope, groups)
        if e.op == "+" and (self.is_text(e.left, scope) or self.is_text(e.right, scope)):
            return F.concat(a.cast("string"), b.cast("string"))
        return {
            "=": lambda: a == b, "<>": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b,
            "and": lambda: a & b, "or": lambda: a | b, "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: a % b,
        }[e.op]()

    def is_text(self, e, scope: dict[str, Bound]) -> bool:
        if isinstance(e, S.Literal):
            return isinstance(e.value, str)
        if isinstance(e, S.Property):
            bound = scope.get(e.owner)
            return bound is not None and (isinstance(bound.props.get(e.name), T.StringType) or e.name.lstrip("_") in ("label", "type"))
        if isinstance(e, S.Binary):
            return e.op == "+" and (self.is_text(e.left, scope) or self.is_text(e.right, scope))
        return isinstance(e, S.Name) and e.name in scope and isinstance(scope[e.name].props.get("$"), T.StringType)

    def call(self, e: S.Call, scope, groups) -> Column:
        if e.name in AGGREGATES:
            return self.aggregate(e, scope)
        args = [self.value(a, scope, groups) for a in e.args if not isinstance(a, S.Name)]
        first = e.args[0].name if e.args and isinstance(e.args[0], S.Name) else None
        node = first is not None and first in scope and scope[first].kind == "node"
        if e.name in ("id", "_id") and len(e.args) == 1:
            return col(f"{first}$_id") if node else self.value(e.args[0], scope, groups)
        if e.name == "label" and node:
            return col(f"{first}$_label")
        if e.name == "labels" and node:
            return F.array(col(f"{first}$_label"))
        if e.name in self.functions:
            return self.functions[e.name](*(self.value(a, scope, groups) for a in e.args))
        del args
        raise ExecutionError(f"function {e.name} is not implemented")

    def aggregate(self, e: S.Call, scope) -> Column:
        if e.star:
            return F.count(F.lit(1))
        if len(e.args) != 1:
            raise ExecutionError(f"{e.name} takes one argument")
        arg = e.args[0]
        if isinstance(arg, S.Name) and arg.name in scope and scope[arg.name].kind != "value":
            v = col(f"{arg.name}$_id") if scope[arg.name].kind == "node" else F.struct(*(col(f"{arg.name}${c}") for c in _EDGE))
        else:
            v = self.value(arg, scope)
        if e.name == "count":
            return F.count_distinct(v) if e.distinct else F.count(v)
        if e.distinct and e.name in ("sum", "avg"):
            return F.coalesce(F.sum_distinct(v), F.lit(0)) if e.name == "sum" else F.expr(f"avg(distinct {self.sql(v)})")
        return {"sum": lambda: F.coalesce(F.sum(v), F.lit(0)), "avg": lambda: F.avg(v), "min": lambda: F.min(v), "max": lambda: F.max(v)}[e.name]()

    @staticmethod
    def sql(v: Column) -> str:
        return v._jc.toString()  # a plain column reference prints as its name

    # patterns

    def scan(self, var: str, label: str | None) -> Rows:
        """All vertices of a label, or of every label."""
        labels = [self.store.catalog.find("vertex", label).name] if label else list(self.store.catalog.labels)
        if not labels:
            raise ExecutionError("the graph has no labels")
        frames, props = [], {}
        for n in labels:
            df = self.store.vertices(n).withColumn("_label", F.lit(n))
            props.update({f.name: f.dataType for f in df.schema.fields if f.name not in _NODE})
            frames.append(df)
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
        return Rows(df.select(*(col(c).alias(f"{var}${c}") for c in (*_NODE, *props))), {var: Bound("node", props)})

    def edge_frame(self, var: str, types: tuple, direction: str) -> tuple[DataFrame, Bound]:
        """Edges under the prefix of ``var``, with ``<var>$ from`` and ``<var>$ to`` in walking direction."""
        names = [self.store.catalog.find("edge", t).name for t in types] or list(self.store.catalog.types)
        if not names:
            raise ExecutionError("the graph has no edge types")
        frames, props = [], {}
        for n in names:
            df = self.store.edges(n).withColumn("_type", F.lit(n))
            props.update({f.name: f.dataType for f in df.schema.fields if f.name not in _EDGE})
            frames.append(df)
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
        df = df.select(*(col(c).alias(f"{var}${c}") for c in (*_EDGE, *props)))
        a, b = col(f"{var}$_src"), col(f"{var}$_dst")
        forward = df.withColumns({f"{var}$ from": a, f"{var}$ to": b})
        backward = df.withColumns({f"{var}$ from": b, f"{var}$ to": a})
        if direction == "out":
            return forward, Bound("edge", props)
        if direction == "in":
            return backward, Bound("edge", props)
        return forward.unionByName(backward.where(a != b)), Bound("edge", props)

    def filtered(self, rows: Rows, var: str, props: tuple) -> Rows:
        df = rows.df
        for key, e in props:
            df = df.where(self.prop(S.Property(var, key), rows.scope) == self.value(e, rows.scope))
        return Rows(df, rows.scope)

    def node(self, rows: Rows | None, pattern: S.NodePattern) -> tuple[Rows, str]:
        """Bind the start of a path: a bound variable goes on, a new one multiplies."""
        var = pattern.var or self.hidden("n")
        if rows is not None and var in rows.scope:
            out = rows
            if pattern.label:
                out = Rows(rows.df.where(col(f"{var}$_label") == self.store.catalog.find("vertex", pattern.label).name), rows.scope)
        else:
            found = self.scan(var, pattern.label)
            found = self.filtered(found, var, tuple(p for p in pattern.props if isinstance(p[1], S.Literal)))
            # equality in WHERE turns the product into a join in Catalyst
            out = found if rows is None else Rows(rows.df.crossJoin(found.df), {**rows.scope, **found.scope})
        return self.filtered(out, var, pattern.props), var

    def hop(self, rows: Rows, at: str, edge: S.EdgePattern, target: S.NodePattern) -> tuple[Rows, str]:
        var, to = edge.var or self.hidden("e"), target.var or self.hidden("n")
        known = to in rows.scope
        rows = self.walk(rows, at, var, to, edge) if edge.hops is not None else self.step(rows, at, var, edge, to if known else None)
        if not known:
            return self.arrive(rows, to, target), to
        df = rows.df.where(col(f"{to}$_id") == col(" to"))
        if target.label:
            df = df.where(col(f"{to}$_label") == self.store.catalog.find("vertex", target.label).name)
        return self.filtered(Rows(df.drop(" to"), rows.scope), to, target.props), to

    def step(self, rows: Rows, at: str, var: str, edge: S.EdgePattern, known: str | None) -> Rows:
        """One edge on from ``at``, to ``known`` if that is bound; the column `` to`` is where it leads."""
        edges, bound = self.edge_frame(var, edge.types, edge.direction)
        on = col(f"{at}$_id") == col(f"{var}$ from")
        if known:
            on = on & (col(f"{known}$_id") == col(f"{var}$ to"))
        rows = self.filtered(Rows(rows.df.join(edges, on), {**rows.scope, var: bound}), var, edge.props)
        return Rows(rows.df.withColumn(" to", col(f"{var}$ to")).drop(f"{var}$ from", f"{var}$ to"), rows.scope)

    def arrive(self, rows: Rows, to: str, target: S.NodePattern) -> Rows:
        """Bind the vertex in the column `` to``."""
        found = self.scan(to, target.label)
        found = self.filtered(found, to, tuple(p for p in target.props if isinstance(p[1], S.Literal)))
        df = rows.df.join(found.df, col(" to") == col(f"{to}$_id")).drop(" to")
        return self.filtered(Rows(df, {**rows.scope, **found.scope}), to, target.props)

    def cycle(self, path: S.Path, where) -> Rows | None:
        """A path back to its own start, as two arcs between two of its nodes that are joined on both.

        Walked from the start, all ways round are held until the last edge
        closes a few of them.  The two nodes are those for which the arcs hold
        least by the sizes of the tables.  None for any other path.
        """
        n, start = len(path.edges), path.nodes[0].var
        if n < 3 or start is None or path.nodes[-1].var != start or any(e.hops is not None for e in path.edges):
            return None
        if not all(isinstance(v, S.Literal) for x in (*path.nodes, *path.edges) for _, v in x.props):
            return None
        nodes = [replace(x, var=x.var or self.hidden("n")) for x in path.nodes[:n]]
        edges = [replace(x, var=x.var or self.hidden("e")) for x in path.edges]
        order = [x.var for pair in zip(nodes, edges) for x in pair]
        if len(set(order)) < 2 * n:
            return None
        weight = [about(self.scan(x.var, x.label).df.select(col(f"{x.var}$_id"))) for x in nodes]
        links = [about(self.edge_frame(x.var, x.types, x.direction)[0].select(col(f"{x.var}$ from"), col(f"{x.var}$ to"))) for x in edges]
        share = [self.share(x, where, w) for x, w in zip(nodes, weight)]

        def held(at: int, to: int) -> float:
            """Rows of all steps of the arc from ``at`` to ``to``, as if ends were independent."""
            rows = total = links[at]
            for k in range(at + 1, to):
                rows *= share[k % n] * links[k % n] / weight[k % n]
                total += rows
            return total

        # the start and the last node are the ends of plain walking, which is kept when nothing holds less
        i, j = min([(0, n - 1), *((i, j) for i in range(n) for j in range(i + 1, n))], key=lambda x: held(*x) * share[x[0]] + held(x[1], x[0] + n))
        rows, at = self.node(None, nodes[i])
        for k in range(i, j):
            rows, at = self.hop(rows, at, edges[k], nodes[k + 1])
        first = edges[j]
        frame, bound = self.edge_frame(first.var, first.types, first.direction)
        other = self.filtered(Rows(frame.withColumnsRenamed({f"{first.var}$ from": " from", f"{first.var}$ to": " to"}), {first.var: bound}), first.var, first.props)
        for k in range(j + 1, i + n):
            to = nodes[k % n]
            other = self.step(self.arrive(other, to.var, to), to.var, edges[k % n].var, edges[k % n], None)
        df = rows.df.join(other.df, (col(f"{at}$_id") == col(" from")) & (col(f"{nodes[i].var}$_id") == col(" to"))).drop(" from", " to")
        if path.nodes[n].label:
            df = df.where(col(f"{start}$_label") == self.store.catalog.find("vertex", path.nodes[n].label).name)
        both = {**rows.scope, **other.scope}
        return self.filtered(Rows(df, {x: both[x] for x in order}), start, path.nodes[n].props)

    @staticmethod
    def share(node: S.NodePattern, where, rows: float) -> float:
        """About what part of a node's vertices its properties and WHERE leave."""
        if any(k in ("id", "_id") for k, _ in node.props):
            return 1 / rows
        left = 0.01 if node.props else 1.0
        open_ = [where]
        while open_:
            e = open_.pop()
            if isinstance(e, S.Binary) and e.op == "and":
                open_ += [e.left, e.right]
            elif isinstance(e, S.Binary) and e.op == "=":
                for x, y in ((e.left, e.right), (e.right, e.left)):
                    if isinstance(y, S.Literal) and (isinstance(x, S.Call) and x.name in ("id", "_id") and x.args == (S.Name(node.var),) or isinstance(x, S.Property) and x.owner == node.var):
                        left = min(left, 1 / rows if isinstance(x, S.Call) or x.name in ("id", "_id") else 0.01)
        return left

    def walk(self, rows: Rows, at: str, var: str, to: str, edge: S.EdgePattern) -> Rows:
        """Variable length: distinct end points, or end points and last edges if the edge is named."""
        least, most = edge.hops
        names = [self.store.catalog.find("edge", t).name for t in edge.types] or None
        edges = self.store.all_edges(names)
        if edge.props:
            frame, bound = self.edge_frame(var, edge.types, "out")
            frame = self.filtered(Rows(frame, {var: bound}), var, edge.props).df
            edges = frame.select(*(col(f"{var}${c}").alias(c) for c in _EDGE))
        walk = edges.select(F.col("_src").alias("a"), F.col("_dst").alias("b"), *_EDGE)
        back = edges.select(F.col("_dst").alias("a"), F.col("_src").alias("b"), *_EDGE)
        walk = {"out": walk, "in": back, "both": walk.unionByName(back.where("a <> b"))}[edge.direction]
        starts = rows.df.select(col(f"{at}$_id").alias("start")).distinct()
        found = (reachable if least <= 1 else trails)(starts, walk, least, most, edge.var is not None)
        df = rows.df.join(found.withColumnRenamed("start", " start"), col(f"{at}$_id") == col(" start")).drop(" start").withColumnRenamed("end", " to")
        scope = dict(rows.scope)
        if edge.var is not None:
            for c in _EDGE:
                df = df.withColumnRenamed(c, f"{var}${c}")
            scope[var] = Bound("edge")
        return Rows(df, scope)

    def match(self, rows: Rows | None, clause: S.Match) -> Rows:
        for path in clause.paths:
            if rows is None and (rows := self.cycle(path, clause.where)) is not None:
                continue
            rows, at = self.node(rows, path.nodes[0])
            for edge, target in zip(path.edges, path.nodes[1:]):
                rows, at = self.hop(rows, at, edge, target)
        if clause.where is not None:
            rows = Rows(rows.df.where(self.value(clause.where, rows.scope)), rows.scope)
        return rows

    # projections

    def project(self, rows: Rows, clause: S.Projection) -> Rows:
        """WITH keeps bindings, RETURN gives plain columns; both sort, skip and limit at the end."""
        items = clause.items
        if len(items) == 1 and items[0].value == S.Name("*"):
            items = tuple(S.Item(S.Name(n)) for n in rows.scope if not n.startswith(" "))
        names = [column_name(x, i) for i, x in enumerate(items)]
        grouped = any(contains_aggregate(x.value) for x in items)
        scope, df, keep = rows.scope, rows.df, []  # keep: (column before, name after)
        new_scope: dict[str, Bound] = {}
        entities: list[str] = []
        done: dict = {}
        if grouped:
            keys, measures = {}, {}
            carried = []
            for x in items:
                if contains_aggregate(x.value):
                    for a in self.aggregates(x.value):
                        measures.setdefault(a, self.hidden("m"))
                elif isinstance(x.value, S.Name) and x.value.name in scope and scope[x.value.name].kind != "value" and not clause.final:
                    carried += self.columns_of(x.value.name, scope)
                else:
                    keys.setdefault(x.value, self.hidden("k"))
            for k in clause.order:
                for a in self.aggregates(k.value):
                    measures.setdefault(a, self.hidden("m"))
            by = [self.value(e, scope).alias(n) for e, n in keys.items()] + [col(c) for c in carried]
            df = df.groupBy(*by).agg(*(self.aggregate(a, scope).alias(n) for a, n in measures.items()))
            done = {**keys, **measures}
        for x, name in zip(items, names):
            plain = isinstance(x.value, S.Name) and x.value.name in scope and scope[x.value.name].kind != "value"
            if plain and not clause.final:
                entities.append(x.value.name)
                new_scope[x.alias or x.value.name] = scope[x.value.name]
                keep += [(col(c), c if not x.alias else f"{x.alias}${c.split('$', 1)[1]}") for c in self.columns_of(x.value.name, scope)]
            else:
                out = name if clause.final else f"${name}"
                keep.append((self.value(x.value, scope, done or None), out))
                new_scope[name] = Bound("value", {"$": T.StringType()} if self.is_text(x.value, scope) else {})
        # sort keys: an output column by name or by the same expression, else computed beside the outputs
        sort: list[tuple[str, bool]] = []
        by_name = {n: (n if clause.final else f"${n}") for n in names}
        by_expr = {x.value: by_name[n] for x, n in zip(items, names)}
        for key in clause.order:
            if key.value in by_expr:
                sort.append((by_expr[key.value], key.descending))
            elif isinstance(key.value, S.Name) and key.value.name in by_name:
                sort.append((by_name[key.value.name], key.descending))
            elif clause.distinct:
                raise ExecutionError("after DISTINCT only returned values can be sorted by")
            else:
                extra = self.hidden("o")
                aliases = {S.Name(n): v for n, v in by_name.items() if n not in scope}
                done_or_alias = done
                if any(S.Name(a.name) == x for x in aliases for a in self.names_in(key.value)):
                    value_of = {x.alias: x.value for x in items if x.alias}
                    resolved = self.replace(key.value, value_of)
                    keep.append((self.value(resolved, scope, done_or_alias or None), extra))
                else:
                    keep.append((self.value(key.value, scope, done_or_alias or None), extra))
                sort.append((extra, key.descending))
        df = df.select(*(c.alias(n) for c, n in keep))
        out_names = [n for _, n in keep if not n.startswith(" o")]
        if clause.distinct:
            df = df.distinct()
        if clause.where is not None:
            df = df.where(self.value(clause.where, new_scope))
        if sort:
            df = df.orderBy(*(col(n).desc() if d else col(n).asc() for n, d in sort))
        if clause.skip:
            df = df.offset(clause.skip)
        if clause.limit is not None:
            df = df.limit(clause.limit)
        return Rows(df.select(*map(col, out_names)), new_scope)

    def columns_of(self, var: str, scope: dict[str, Bound]) -> list[str]:
        b = scope[var]
        have = _NODE if b.kind == "node" else _EDGE
        return [f"{var}${c}" for c in (*have, *b.props)]

    def aggregates(self, e) -> list[S.Call]:
        if isinstance(e, S.Call):
            return [e] if e.name in AGGREGATES else [a for x in e.args for a in self.aggregates(x)]
        parts = (e.left, e.right) if isinstance(e, S.Binary) else (e.value,) if isinstance(e, S.Unary) else e.items if isinstance(e, S.ListOf) else ()
        return [a for x in parts for a in self.aggregates(x)]

    def names_in(self, e) -> list[S.Name]:
        if isinstance(e, S.Name):
            return [e]
        parts = (e.left, e.right) if isinstance(e, S.Binary) else (e.value,) if isinstance(e, S.Unary) else e.args if isinstance(e, S.Call) else ()
        return [n for x in parts for n in self.names_in(x)]

    def replace(self, e, by: dict):
        if isinstance(e, S.Name):
            return by.get(e.name, e)
        if isinstance(e, S.Binary):
            return S.Binary(e.op, self.replace(e.left, by), self.replace(e.right, by))
        if isinstance(e, S.Unary):
            return S.Unary(e.op, self.replace(e.value, by))
        if isinstance(e, S.Call):
            return S.Call(e.name, tuple(self.replace(a, by) for a in e.args), e.distinct, e.star)
        return e
