import random

import pytest

from graphloom import queries_graph
from graphloom.algo import communities, graph, walks
from graphloom.errors import ExecutionError
from graphloom.session import GraphSession

# golden values of a 4-vertex graph, computed independently
FOUR = [(1, 2), (2, 3), (3, 1), (3, 4)]
ISLANDS = [(10, 20), (20, 30), (30, 10), (30, 40), (40, 50), (50, 40), (20, 50), (60, 70), (60, 80), (70, 80), (80, 90)]


def _graph(spark, edges):
    g = GraphSession(spark)
    g.script("CREATE VERTEX Node (name STRING); CREATE EDGE REL ()")
    ids = sorted({v for e in edges for v in e})
    g.query("INSERT VERTEX Node (id, name) VALUES " + ", ".join(f"({v}, 'n')" for v in ids))
    g.query("INSERT EDGE REL () VALUES " + ", ".join(f"({a}, {b})" for a, b in edges))
    return g


@pytest.fixture(scope="module")
def four(spark):
    return _graph(spark, FOUR)


@pytest.mark.parametrize(
    ("call", "column", "want"),
    [
        ("algo.pageRank()", "score", [0.213752, 0.264618, 0.307878, 0.213752]),
        ("algo.degree()", "total_degree", [2, 2, 3, 1]),
        ("algo.triangles()", "clustering_coefficient", [1, 1, 0.333333, 0]),
        ("algo.sssp(1)", "distance", [0, 1, 2, 3]),
        ("algo.closeness()", "closeness", [0.611111, 0.666667, 0.833333, 0]),
        ("algo.betweenness(false)", "betweenness", [1, 2, 3, 0]),
        ("algo.kCore()", "coreness", [2, 2, 2, 1]),
        ("algo.wcc()", "component_id", [1, 1, 1, 1]),
        ("algo.scc()", "component_id", [1, 1, 1, 4]),
    ],
)
def test_four_vertices(four, call, column, want):
    got = [r[column] for r in four.query(f"CALL {call}").orderBy("vertex_id").collect()]
    assert got == pytest.approx(want, abs=1e-5)


def _hops(edges, start):
    """Distance and number of shortest paths from ``start``."""
    far, paths, layer = {start: 0}, {start: 1}, [start]
    while layer:
        found = {}
        for u in layer:
            for a, b in edges:
                if a == u and b not in far:
                    found[b] = found.get(b, 0) + paths[u]
        far |= dict.fromkeys(found, far[layer[0]] + 1)
        paths |= found
        layer = list(found)
    return far, paths


def _brute(edges):
    nodes = sorted({v for e in edges for v in e})
    reach = {v: _hops(edges, v) for v in nodes}
    undirected = {frozenset(e) for e in edges if e[0] != e[1]}
    ring = [(a, b) for e in undirected for a, b in (tuple(e), tuple(e)[::-1])]
    core, left = {}, set(nodes)
    for k in range(len(nodes)):
        while weak := {v for v in left if sum(a == v and b in left for a, b in ring) <= k}:
            core |= dict.fromkeys(weak, k)
            left -= weak
    between = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        for t in nodes:
            for v in nodes:
                if len({s, t, v}) == 3 and t in reach[s][0] and v in reach[s][0] and t in reach[v][0] and reach[s][0][v] + reach[v][0][t] == reach[s][0][t]:
                    between[v] += reach[s][1][v] * reach[v][1][t] / reach[s][1][t]
    return {
        "wcc": {v: min(_hops(ring, v)[0]) for v in nodes}, "scc": {v: min(u for u in nodes if u in reach[v][0] and v in reach[u][0]) for v in nodes},
        "kcore": core, "betweenness": between, "closeness": {v: sum(1 / d for d in reach[v][0].values() if d) / max(len(nodes) - 1, 1) for v in nodes},
        "sssp": {v: reach[nodes[0]][0].get(v, 4294967295) for v in nodes},
    }


def test_components_and_centralities_equal_brute_force(spark):
    r = random.Random(3)
    sparse = [(r.randrange(40), r.randrange(40)) for _ in range(45)]
    path = [(i, i + 1) for i in range(100, 130)] + [(i + 1, i) for i in range(140, 160)]
    for edges in (ISLANDS, sparse, path):
        df = spark.createDataFrame(edges + edges[:3], "src bigint, dst bigint")
        want = _brute(edges)
        values = lambda found: {x[0]: x[1] for x in found.collect()}
        assert values(graph.wcc(df)) == want["wcc"]
        assert values(graph.kcore(df)) == want["kcore"]
        once = df.distinct()
        if edges is not path:
            assert values(graph.sssp(df, min(v for e in edges for v in e))) == want["sssp"]
            assert values(graph.closeness(once)) == pytest.approx(want["closeness"])
            assert values(graph.scc(df)) == want["scc"]
            assert values(graph.betweenness(once, False)) == pytest.approx(want["betweenness"])


def test_a_long_path_is_one_weak_component_and_many_strong_ones(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(60)], "src bigint, dst bigint")
    assert {x[1] for x in graph.wcc(df).collect()} == {0}
    assert all(x[0] == x[1] for x in graph.scc(df.where("src < 12")).collect())


def test_pagerank_equals_power_iteration(spark):
    edges = ISLANDS + [(10, 20), (90, 90)]
    nodes = sorted({v for e in edges for v in e})
    n, rank = len(nodes), dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(7):
        lost = sum(x for v, x in rank.items() if all(a != v for a, _ in edges))
        rank = {v: 0.15 / n + 0.85 * lost / n + 0.85 * sum(rank[a] / sum(c == a for c, _ in edges) for a, b in edges if b == v) for v in nodes}
    got = {x[0]: x[1] for x in graph.pagerank(spark.createDataFrame(edges, "src bigint, dst bigint"), 0.85, 7, 0.0).collect()}
    assert got == pytest.approx(rank) and sum(got.values()) == pytest.approx(1)


def test_similarity_and_communities_by_call(spark):
    g = _graph(spark, ISLANDS)
    by = lambda call, c: {r["vertex_id"]: r[c] for r in g.query(f"CALL {call}").collect()}
    row = g.query("CALL algo.similarity(10, 60)").first()
    assert (row["jaccard"], row["cosine"], row["common_neighbors"]) == (0, 0, 0)
    row = g.query("CALL algo.similarity(20, 40)").first()
    assert row["jaccard"] == pytest.approx(1 / 2) and row["cosine"] == pytest.approx(1 / 2**0.5)
    for call in ("algo.louvain()", "algo.lpa()", "algo.louvain({mode: 'sequential'})", "algo.lpa({mode: 'sequential'})"):
        found = by(call, "community_id")
        assert set(found) == {v for e in ISLANDS for v in e} and not {found[v] for v in (10, 20, 30, 40, 50)} & {found[v] for v in (60, 70, 80, 90)}
    assert g.query("CALL algo.degree() YIELD vertex_id AS v, in_degree").columns == ["v", "in_degree"]
    with pytest.raises(ExecutionError):
        g.query("CALL algo.lpa({mode: 'none'})")


def test_sequential_passes_visit_in_order(spark):
    """Two triangles and a bridge: the sequential passes settle on one community each."""
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 4)], "src bigint, dst bigint")
    for found in (communities.lpa_sequential(edges), communities.louvain_sequential(edges), communities.louvain(edges)):
        label = {x[0]: x[1] for x in found.collect()}
        assert label[1] == label[2] == label[3] != label[4] == label[5] == label[6]
        assert communities.modularity(edges, found) == pytest.approx(6 / 7 - 2 * (7 / 14) ** 2)
    assert communities.lpa(edges.limit(0)).count() == communities.lpa_sequential(edges.limit(0)).count() == 0


def test_numbering_and_dense_order(spark):
    r = random.Random(4)
    data = [(r.randrange(50), r.randrange(50), i) for i in range(300)]
    df = spark.createDataFrame(data, "src bigint, dst bigint, rank int").repartition(7)
    assert [(x.src, x.dst, x["rank"]) for x in graph.numbered(df, "src", "dst", "rank").orderBy("n").collect()] == sorted(data)
    seen = list(dict.fromkeys(v for a, b, _ in sorted(data, key=lambda x: (x[0], x[2], x[1])) for v in (a, b)))
    assert [x["v"] for x in graph.dense_order(df).orderBy("i").collect()] == seen


def test_pivots_estimate_only_when_asked_for(spark):
    edges = spark.createDataFrame([(i, (i * 7 + j) % 40) for i in range(40) for j in (1, 3, 8)], "src bigint, dst bigint").where("src <> dst")
    score = lambda found: [x[1] for x in found.orderBy("vertex_id").collect()]
    whole = score(graph.closeness(edges))
    assert score(graph.closeness(edges, 40)) == whole
    some = score(graph.closeness(edges, 20))
    assert some != pytest.approx(whole, abs=1e-5) and some == pytest.approx(whole, rel=0.5)
    assert sum(score(graph.betweenness(edges, True, 20))) == pytest.approx(sum(score(graph.betweenness(edges))), rel=0.3)


def test_walks_and_embeddings(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 2_000_000), (2_000_000, 7_000_000), (9, 9)], "src bigint, dst bigint")
    links = {tuple(x) for x in edges.collect()}
    rows_ = walks.walks(edges, 6, 4, 0.5, 2.0).collect()
    paths = {}
    for x in sorted(rows_, key=lambda x: x["step"]):
        paths.setdefault(tuple(x["walk"]), []).append(x["v"])
    assert len(paths) == 6 * 4 and all((a, b) in links for p in paths.values() for a, b in zip(p, p[1:]))
    assert max(map(len, paths.values())) == 6 and paths[7_000_000, 0] == [7_000_000]
    found = walks.node2vec(edges, 8, 6, 4)
    vectors = {x[0]: x[1] for x in found.collect()}
    assert set(vectors) == {1, 2, 3, 9, 2_000_000, 7_000_000} and all(len(v) == 8 and sum(y * y for y in v) == pytest.approx(1) for v in vectors.values())
    assert all(x[1] == pytest.approx(vectors[x[0]]) for x in walks.node2vec(edges.repartition(3), 8, 6, 4).collect())
    assert walks.node2vec(edges.limit(0)).count() == walks.node2vec(edges, 0).count() == 0
    # a second-order walk with a great p seldom turns back
    ring = spark.createDataFrame([(i, (i + d) % 30) for i in range(30) for d in (1, 29)], "src bigint, dst bigint")
    turns = lambda p: sum(a == c for w in _paths(walks.walks(ring, 8, 5, p, 1.0)) for a, c in zip(w, w[2:]))
    assert turns(50.0) * 5 < turns(1.0)
    g = _graph(spark, ISLANDS)
    assert g.query("CALL algo.node2vec({dim: 4, walk_length: 3, num_walks: 2}) YIELD vertex_id, embedding").count() == 9


def _paths(rows_):
    out = {}
    for x in sorted(rows_.collect(), key=lambda x: x["step"]):
        out.setdefault(tuple(x["walk"]), []).append(x["v"])
    return out.values()


def test_vector_index(spark):
    r = random.Random(6)
    g = GraphSession(spark)
    g.script("CREATE VERTEX Item (vec VECTOR(8)); CREATE VECTOR INDEX ON :Item(vec)")
    data = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(600)] + [(700, [1.0]), (701, None)]
    g.store.ingest(spark.createDataFrame(data, "id bigint, vec array<double>"), "Item")
    hits = 0
    for q in range(0, 600, 60):
        call = f"CALL vector.search({{label: 'Item', property: 'vec', query: {data[q][1]}, k: 5"
        exact = [x["node"] for x in g.query(call + "})").collect()]
        assert [x["node"] for x in g.query(call + ", approximate: true, probes: 1024})").collect()] == exact
        hits += len(set(exact) & {x["node"] for x in g.query(call + ", approximate: true, probes: 8})").collect()})
    assert hits >= 0.9 * 50
    g.query("INSERT VERTEX Item (id, vec) VALUES (900, [9, 9, 9, 9, 9, 9, 9, 9])")  # the index follows the graph
    assert g.query("CALL vector.search({label: 'Item', property: 'vec', query: [1, 1, 1, 1, 1, 1, 1, 1], k: 1, approximate: true})").first()["node"] == 900


@pytest.mark.parametrize(("query", "operator"), [("lpa_sync", "lpa"), ("louvain", "louvain")])
def test_communities_run_the_default_rounds(monkeypatch, query, operator):
    monkeypatch.setattr(queries_graph, "part_next", lambda *_: None)
    default = getattr(communities, operator).__defaults__[0]
    monkeypatch.setattr(communities, operator, lambda edges, rounds=default: rounds)
    assert queries_graph.QUERIES[query](None, "") == default == 10


def test_vector_search(spark):
    g = GraphSession(spark)
    g.script("CREATE VERTEX Item (name STRING, vec VECTOR(3)); INSERT VERTEX Item (id, name, vec) VALUES (1, 'A', [1, 0, 0]), (2, 'B', [0, 1, 0]), (3, 'C', [0.9, 0.1, 0]), (4, 'D', [0, 0, 0]), (5, 'E', [1])")
    found = g.query("CALL vector.similaritySearch('Item', 'vec', [1, 0, 0], 2)").collect()
    assert [r["node"] for r in found] == [1, 3] and found[0]["similarity"] == pytest.approx(1)
    assert g.query("CALL vector.search({label: 'Item', property: 'vec', query: [1, 0, 0], k: 9, metric: 'l2'}) YIELD vertex_id, score").count() == 4


def _jobs(spark, name, made):
    """The rows of ``made()``, and how many jobs it took."""
    spark.sparkContext.setJobGroup(name, name)
    got = {x[0]: x[1] for x in made().collect()}
    spark.sparkContext.setJobGroup("", "")
    return got, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_closeness_of_a_deep_graph_takes_few_jobs(spark):
    n = 70  # more vertices than bits of a word
    edges = [(i, i + 1) for i in range(n - 1)]
    got, jobs = _jobs(spark, "closeness", lambda: graph.closeness(spark.createDataFrame([*edges, (5, 5)], "src bigint, dst bigint")))
    assert got == pytest.approx({v: sum(1 / d for d in range(1, n - v)) / (n - 1) for v in range(n)})
    assert jobs < 40
    empty = spark.createDataFrame([], "src bigint, dst bigint")
    assert graph.closeness(empty).collect() == graph.betweenness(empty).collect() == []


def test_betweenness_of_a_deep_graph_takes_few_jobs(spark, monkeypatch):
    n = 40
    df = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "src bigint, dst bigint")
    got, jobs = _jobs(spark, "betweenness", lambda: graph.betweenness(df, False))
    assert got == pytest.approx({v: v * (n - 1 - v) for v in range(n)})
    assert jobs < 40
    r = random.Random(11)
    many = spark.createDataFrame([(r.randrange(9), r.randrange(9)) for _ in range(30)], "src bigint, dst bigint")  # with parallel edges
    score = lambda made: {x[0]: x[1] for x in made.collect()}
    sent = score(graph.betweenness(many)), score(graph.closeness(many))
    monkeypatch.setattr(graph.paths, "EDGES", 0)  # by joins
    assert sent == (pytest.approx(score(graph.betweenness(many))), pytest.approx(score(graph.closeness(many))))


def test_coreness_of_a_deep_graph_takes_few_jobs(spark, monkeypatch):
    n = 50
    df = spark.createDataFrame([(i, i + 1) for i in range(n - 1)] + [(100, 100)], "src bigint, dst bigint")
    got, jobs = _jobs(spark, "kcore", lambda: graph.kcore(df))
    assert got == {**dict.fromkeys(range(n), 1), 100: 0}
    assert jobs < 30
    r = random.Random(5)
    edges = [(r.randrange(30), r.randrange(30)) for _ in range(120)]
    some = spark.createDataFrame(edges, "src bigint, dst bigint")
    score = lambda made: {x[0]: x[1] for x in made.collect()}
    monkeypatch.setattr(graph.cores, "LINKS", 40)  # several tasks
    assert score(graph.kcore(some)) == _brute(edges)["kcore"]
    monkeypatch.setattr(graph.cores, "VERTICES", 0)  # by joins
    assert score(graph.kcore(some)) == _brute(edges)["kcore"]
    assert graph.kcore(some.where("src > 99")).collect() == []
