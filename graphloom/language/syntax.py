"""The syntax tree: immutable dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Property:
    owner: str
    name: str


@dataclass(frozen=True)
class Unary:
    op: str  # not, -, is null, is not null
    value: Any


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class ListOf:
    items: tuple


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    distinct: bool = False
    star: bool = False


@dataclass(frozen=True)
class NodePattern:
    var: str | None
    label: str | None
    props: tuple = ()  # (name, expression) pairs


@dataclass(frozen=True)
class EdgePattern:
    var: str | None
    types: tuple
    props: tuple = ()
    direction: str = "out"  # out, in, both
    hops: tuple | None = None  # (least, most)


@dataclass(frozen=True)
class Path:
    nodes: tuple
    edges: tuple


@dataclass(frozen=True)
class Item:
    value: Any
    alias: str | None = None


@dataclass(frozen=True)
class SortKey:
    value: Any
    descending: bool = False


@dataclass(frozen=True)
class Match:
    paths: tuple
    where: Any = None


@dataclass(frozen=True)
class Projection:
    """WITH or RETURN."""

    items: tuple
    distinct: bool = False
    where: Any = None
    order: tuple = ()
    skip: int | None = None
    limit: int | None = None
    final: bool = False


@dataclass(frozen=True)
class SetProperties:
    items: tuple  # (variable, property, expression)


@dataclass(frozen=True)
class Delete:
    names: tuple
    detach: bool = False


@dataclass(frozen=True)
class LinkVertices:
    """CREATE or MERGE of an edge between bound vertices."""

    source: str
    var: str | None
    type: str
    props: tuple
    target: str
    merge: bool = False


@dataclass(frozen=True)
class Query:
    clauses: tuple


@dataclass(frozen=True)
class Procedure:
    name: str
    named: tuple = ()
    positional: tuple = ()
    yields: tuple = ()


@dataclass(frozen=True)
class Define:
    kind: str  # vertex, edge
    name: str
    properties: tuple  # (name, type) pairs


@dataclass(frozen=True)
class Alter:
    kind: str
    name: str
    add: tuple = ()
    drop: tuple = ()


@dataclass(frozen=True)
class Drop:
    kind: str  # vertex, edge, graph
    name: str
    lenient: bool = False


@dataclass(frozen=True)
class IndexOn:
    label: str
    prop: str
    vector: bool = False
    drop: bool = False


@dataclass(frozen=True)
class CreateGraph:
    name: str
    lenient: bool = False


@dataclass(frozen=True)
class UseGraph:
    name: str


@dataclass(frozen=True)
class Show:
    what: str  # schema, vertices, edges, indexes, graphs


@dataclass(frozen=True)
class Analyze:
    pass


@dataclass(frozen=True)
class Explain:
    statement: Any


@dataclass(frozen=True)
class PutVertices:
    """INSERT or MERGE of vertices."""

    label: str
    columns: tuple
    rows: tuple
    merge: bool = False


@dataclass(frozen=True)
class PutEdges:
    type: str
    columns: tuple
    rows: tuple = field(default=())  # (source, target, rank, values)


@dataclass(frozen=True)
class DeleteEdge:
    type: str
    source: int
    target: int
    rank: int | None = None


@dataclass(frozen=True)
class Maintain:
    """``compact`` or ``snapshot``."""

    what: str
