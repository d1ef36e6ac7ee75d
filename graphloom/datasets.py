"""The test tables as a property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.algo.graph import numbered
from graphloom.session import GraphSession
from graphloom.sources.tables import table
from graphloom.store import GraphStore

STEP = 1_000_000_000_000  # ids are ordinal * STEP + key
_DECLARED = {"bigint": "INT64", "int": "INT64", "double": "FLOAT64", "string": "STRING", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "array<float>": "VECTOR(64)"}
_VERTICES = {  # label: ordinal, table, key
    "Region": (1, "region", "r_regionkey"), "Nation": (2, "nation", "n_nationkey"), "Customer": (3, "customer", "c_custkey"), "Supplier": (4, "supplier", "s_suppkey"),
    "Part": (5, "part", "p_partkey"), "Order": (6, "orders", "o_orderkey"), "User": (7, "events", "user_id"), "Embedding": (8, "embeddings", "vec_id"),
}
_EDGES = {  # type: source label, target label, table, source key, target key
    "IN_REGION": ("Nation", "Region", "nation", "n_nationkey", "n_regionkey"), "LIVES_IN": ("Customer", "Nation", "customer", "c_custkey", "c_nationkey"),
    "BASED_IN": ("Supplier", "Nation", "supplier", "s_suppkey", "s_nationkey"), "PLACED": ("Customer", "Order", "orders", "o_custkey", "o_orderkey"),
}


def _vid(label: str, key: str):
    return F.lit(_VERTICES[label][0]) * F.lit(STEP) + F.col(key)


def _types(df: DataFrame) -> dict[str, str]:
    return {c: _DECLARED[t] for c, t in df.dtypes if not c.startswith("_") and t in _DECLARED}


def tpch_graph(spark: SparkSession, folder: str) -> GraphSession:
    """Customers, orders, parts and the rest, linked by their keys."""
    store = GraphStore(spark)
    for label, (_, name, key) in _VERTICES.items():
        df = table(spark, folder, name)
        if label == "User":
            df = df.select(key).distinct()
        store.register("vertex", label, df.withColumn("_id", _vid(label, key)), _types(df))
    for kind, (a, b, name, x, y) in _EDGES.items():
        df = table(spark, folder, name).select(_vid(a, x).alias("_src"), _vid(b, y).alias("_dst"))
        store.register("edge", kind, df, {})
    lines = table(spark, folder, "lineitem")
    rank = F.row_number().over(Window.partitionBy("l_orderkey", "l_partkey").orderBy("l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")) - 1
    contains = lines.withColumns({"_src": _vid("Order", "l_orderkey"), "_dst": _vid("Part", "l_partkey"), "_rank": rank.cast("bigint")})
    store.register("edge", "CONTAINS", contains, _types(lines))
    supplies = lines.groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    store.register("edge", "SUPPLIES", supplies.withColumns({"_src": _vid("Supplier", "l_suppkey"), "_dst": _vid("Part", "l_partkey")}), {"n": "INT64"})
    return GraphSession(spark, store)


def part_next(spark: SparkSession, folder: str) -> DataFrame:
    """Parts that follow each other in an order: sparse and deep."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, folder, "lineitem").where("l_quantity >= 44").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return rows.where("dst is not null and src <> dst").distinct()


def user_next(spark: SparkSession, folder: str) -> DataFrame:
    """Users whose purchases follow each other: dense."""
    spots = numbered(table(spark, folder, "events").where("event_type = 'purchase'").select("user_id", "ts", "event_id"), "ts", "event_id")
    after = spots.select(F.col("user_id").alias("dst"), (F.col("n") - 1).alias("n"))
    rows = spots.select(F.col("user_id").alias("src"), "n").join(after, "n").select("src", "dst")
    return rows.where("dst is not null and src <> dst").distinct()


def entity_graph(spark: SparkSession, folder: str) -> DataFrame:
    """All edges of ``edge_ids`` with two ends, as ``src``, ``dst``."""
    return table(spark, folder, "edge_ids").where("src is not null and dst is not null").select("src", "dst")


def chain_graph(spark: SparkSession, folder: str) -> GraphSession:
    """Customers of one nation and segment in the order of their balance."""
    w = Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_acctbal", "c_custkey")
    customers = table(spark, folder, "customer")
    rows = customers.select(F.col("c_custkey").alias("_src"), F.lead("c_custkey").over(w).alias("_dst")).where("_dst is not null")
    store = GraphStore(spark)
    store.register("vertex", "Customer", customers.withColumn("_id", F.col("c_custkey")), _types(customers))
    store.register("edge", "NEXT", rows, {})
    return GraphSession(spark, store)


def ring_graph(spark: SparkSession, folder: str) -> GraphSession:
    """Suppliers, each linked to the ones at twice and three times its key around a ring: branches and cycles."""
    suppliers = table(spark, folder, "supplier")
    n = suppliers.count()
    ends = suppliers.where(F.col("s_suppkey").between(1, n - 1)).select(F.col("s_suppkey").alias("_src"), F.explode(F.array(F.lit(2), F.lit(3))).alias("m"))
    ends = ends.select("_src", ((F.col("_src") * F.col("m")) % n).alias("_dst")).where("_dst > 0 and _src <> _dst").distinct()
    store = GraphStore(spark)
    store.register("vertex", "Supplier", suppliers.withColumn("_id", F.col("s_suppkey")), _types(suppliers))
    store.register("edge", "TO", ends, {})
    return GraphSession(spark, store)
