"""Labels, edge types and indexes of one graph."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

from graphloom.errors import SchemaError

# The declarable types and their synonyms.
_TYPES = {
    "INT": T.LongType(), "INT64": T.LongType(), "BIGINT": T.LongType(), "INTEGER": T.LongType(),
    "FLOAT": T.DoubleType(), "FLOAT64": T.DoubleType(), "DOUBLE": T.DoubleType(),
    "STRING": T.StringType(), "VARCHAR": T.StringType(), "TEXT": T.StringType(),
    "BOOL": T.BooleanType(), "BOOLEAN": T.BooleanType(), "DATE": T.DateType(), "TIMESTAMP": T.TimestampNTZType(),
}
DEFAULT_DIMENSION = 128


def spark_type(declared: str) -> T.DataType:
    """The Spark type of a declared type; anything else is an error."""
    if m := re.fullmatch(r"VECTOR(?:\((\d+)\))?", declared):
        return T.ArrayType(T.FloatType())
    if declared not in _TYPES:
        raise SchemaError(f"unknown type {declared}")
    return _TYPES[declared]


def declared_type(simple: str) -> str | None:
    """The declared type of a Spark type, None if there is none."""
    if simple in ("array<float>", "array<double>"):
        return "VECTOR"
    if simple in ("int", "smallint", "tinyint"):
        return "INT64"
    names = {"bigint": "INT64", "double": "FLOAT64", "float": "FLOAT64", "string": "STRING", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP"}
    return names.get(simple)


@dataclass
class Entity:
    """A vertex label or an edge type."""

    name: str
    number: int
    properties: dict[str, str]  # name to declared type, in order
    indexes: dict[str, bool] = field(default_factory=dict)  # property to "is a vector index"

    def property_types(self) -> dict[str, T.DataType]:
        return {p: spark_type(t) for p, t in self.properties.items()}

    def dimension(self, prop: str) -> int:
        m = re.fullmatch(r"VECTOR(?:\((\d+)\))?", self.properties.get(prop, ""))
        if not m:
            raise SchemaError(f"{self.name}.{prop} is no vector")
        return int(m[1] or DEFAULT_DIMENSION)


VERTEX_KEY = {"_id": T.LongType()}
EDGE_KEY = {"_src": T.LongType(), "_rank": T.LongType(), "_dst": T.LongType()}


@dataclass
class Catalog:
    """Names are matched exactly, then without case and one trailing ``s``.  Numbers are not used again."""

    labels: dict[str, Entity] = field(default_factory=dict)
    types: dict[str, Entity] = field(default_factory=dict)
    next_label: int = 1
    next_type: int = 1

    def _of(self, kind: str) -> dict[str, Entity]:
        return self.labels if kind == "vertex" else self.types

    def find(self, kind: str, name: str) -> Entity:
        known = self._of(kind)
        if name in known:
            return known[name]
        plain = lambda x: x.lower().removesuffix("s")
        close = [e for n, e in known.items() if n.lower() == name.lower()] or [e for n, e in known.items() if plain(n) == plain(name)]
        if len(close) != 1:
            raise SchemaError(f"unknown {'label' if kind == 'vertex' else 'edge type'} {name}")
        return close[0]

    def define(self, kind: str, name: str, properties: tuple) -> Entity:
        known = self._of(kind)
        if any(n.lower() == name.lower() for n in known):
            raise SchemaError(f"{name} already exists")
        props = dict(properties)
        if len(props) != len(properties):
            raise SchemaError(f"{name} declares a property twice")
        for t in props.values():
            spark_type(t)
        number = self.next_label if kind == "vertex" else self.next_type
        if kind == "vertex":
            self.next_label += 1
        else:
            self.next_type += 1
        known[name] = Entity(name, number, props)
        return known[name]

    def described(self) -> dict:
        """Plain values from which ``from_description`` makes the same catalog."""
        plain = lambda m: [{"name": e.name, "number": e.number, "properties": list(e.properties.items()), "indexes": e.indexes} for e in m.values()]
        return {"labels": plain(self.labels), "types": plain(self.types), "next_label": self.next_label, "next_type": self.next_type}

    @staticmethod
    def from_description(known: dict) -> Catalog:
        made = lambda rows: {r["name"]: Entity(r["name"], r["number"], dict(map(tuple, r["properties"])), dict(r["indexes"])) for r in rows}
        return Catalog(made(known["labels"]), made(known["types"]), known["next_label"], known["next_type"])

    def drop(self, kind: str, name: str) -> Entity:
        found = self.find(kind, name)
        return self._of(kind).pop(found.name)

    def schema(self, kind: str, name: str) -> T.StructType:
        """Key columns, then the declared properties."""
        entity = self.find(kind, name)
        key = VERTEX_KEY if kind == "vertex" else EDGE_KEY
        return T.StructType([T.StructField(c, t) for c, t in {**key, **entity.property_types()}.items()])
