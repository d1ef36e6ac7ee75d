"""Procedures for CALL."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.algo import ann, communities, graph, vector, walks
from graphloom.errors import ExecutionError
from graphloom.language import syntax as S
from graphloom.store import GraphStore

Arguments = dict[str, Any]


def _one(a: Arguments, default: Any, *names: str) -> Any:
    return next((a[n] for n in names if n in a), default)


def _edges(store: GraphStore, a: Arguments) -> DataFrame:
    kind = _one(a, None, "edge_type", "type", "relationship")
    kinds = [store.catalog.find("edge", kind).name] if kind else None
    return store.all_edges(kinds).select(F.col("_src").alias("src"), F.col("_type").alias("type"), F.col("_rank").alias("rank"), F.col("_dst").alias("dst"))


def _search(store: GraphStore, a: Arguments) -> DataFrame:
    label = store.catalog.find("vertex", _one(a, "Document", "label")).name
    query = _one(a, None, "query", "embedding")
    if not query:
        raise ExecutionError("the search needs a query vector")
    prop, k, metric = _one(a, "embedding", "property"), int(_one(a, 10, "k", "top_k", "topk")), str(_one(a, "cosine", "metric"))
    if store.catalog.find("vertex", label).indexes.get(prop) and bool(_one(a, False, "approximate")):
        found = ann.search(store, label, prop, query, k, metric, int(_one(a, ann.PROBES, "probes")))
    else:
        found = vector.search(store.vertices(label), "_id", prop, query, k, metric)
    # documented names of the same columns
    return found.select("node", "similarity", F.col("node").alias("vertex_id"), F.col("similarity").alias("score"))


def _pivots(a: Arguments) -> int | None:
    """The number of pivots asked for by ``sample``; all vertices without it or with ``exact``."""
    wanted = _one(a, None, "sample", "pivots")
    return None if wanted is None or bool(_one(a, False, "exact")) else int(wanted)


def _moving(a: Arguments, together: Callable, in_order: Callable) -> Callable:
    mode = str(_one(a, "synchronous", "mode")).lower()
    if mode not in ("synchronous", "sequential"):
        raise ExecutionError(f"unknown mode {mode}")
    return in_order if mode == "sequential" else together


_GRAPH: dict[str, tuple[Callable[[DataFrame, Arguments], DataFrame], tuple[str, ...]]] = {
    "algo.pagerank": (lambda e, a: graph.pagerank(e, float(_one(a, 0.85, "damping", "damping_factor")), int(_one(a, 20, "max_iter", "iterations")), float(_one(a, 1e-6, "tolerance"))), ("damping", "max_iter", "tolerance")),
    "algo.wcc": (lambda e, a: graph.wcc(e), ()),
    "algo.scc": (lambda e, a: graph.scc(e), ()),
    "algo.louvain": (lambda e, a: _moving(a, communities.louvain, communities.louvain_sequential)(e, int(_one(a, 10, "max_iter", "iterations"))), ("max_iter",)),
    "algo.lpa": (lambda e, a: _moving(a, communities.lpa, communities.lpa_sequential)(e, int(_one(a, 10, "max_iter", "iterations"))), ("max_iter",)),
    "algo.node2vec": (lambda e, a: walks.node2vec(e, int(_one(a, 64, "dimensions", "dim")), int(_one(a, 10, "walk_length")), int(_one(a, 10, "num_walks", "walks_per_vertex")), float(_one(a, 1.0, "p")), float(_one(a, 1.0, "q"))), ("dimensions", "walk_length", "num_walks", "p", "q")),
    "algo.kcore": (lambda e, a: graph.kcore(e), ()),
    "algo.trianglecount": (lambda e, a: graph.triangles(e), ()),
    "algo.betweenness": (lambda e, a: graph.betweenness(e, bool(_one(a, True, "normalized")), _pivots(a)), ("normalized", "exact")),
    "algo.closeness": (lambda e, a: graph.closeness(e, _pivots(a)), ("exact",)),
    "algo.degree": (lambda e, a: graph.degree(e), ()),
    "algo.sssp": (lambda e, a: graph.sssp(e, int(_one(a, 1, "source"))), ("source",)),
    "algo.similarity": (lambda e, a: graph.similarity(e, int(_one(a, 1, "node1")), int(_one(a, 2, "node2"))), ("node1", "node2")),
}
_ALIASES = {"algo.triangles": "algo.trianglecount", "algo.labelpropagation": "algo.lpa", "algo.bfs": "algo.sssp", "algo.jaccard": "algo.similarity", "vector.search": "vector.similaritysearch"}
_SEARCH_ORDER = ("label", "property", "query", "k", "metric")


def run_procedure(store: GraphStore, call: S.Procedure, own: dict[str, Callable]) -> DataFrame:
    """Run a procedure, then filter by label, project what YIELD names, and limit."""
    name = _ALIASES.get(call.name.lower(), call.name.lower())
    order = _SEARCH_ORDER if name == "vector.similaritysearch" else _GRAPH[name][1] if name in _GRAPH else ()
    if len(call.positional) > len(order) and name not in own:
        raise ExecutionError(f"{call.name} takes {len(order)} positional arguments")
    args = dict(zip(order, call.positional)) | {k.lower(): v for k, v in call.named}
    if name in own:
        out, shown = own[name](store, args), None
    elif name == "vector.similaritysearch":
        out, shown = _search(store, args), ["node", "similarity"]
    elif name in _GRAPH:
        out, shown = _GRAPH[name][0](_edges(store, args), args), None
        if (label := args.get("label")) and "vertex_id" in out.columns:
            members = store.vertices(store.catalog.find("vertex", label).name).select(F.col("_id").alias("vertex_id"))
            out = out.join(members, "vertex_id", "left_semi")
        if "vertex_id" in out.columns:
            out = out.orderBy("vertex_id")
    else:
        raise ExecutionError(f"unknown procedure {call.name}")
    if call.yields:
        if missing := [y for y, _ in call.yields if y not in out.columns]:
            raise ExecutionError(f"{call.name} does not yield {missing[0]}")
        out = out.select(*(F.col(y).alias(a) for y, a in call.yields))
    elif shown:
        out = out.select(*shown)
    return out.limit(int(args["limit"])) if "limit" in args else out
