import json

import pytest

from graphloom.__main__ import main
from graphloom.errors import ExecutionError, ParseError, SchemaError
from graphloom.language import syntax as S
from graphloom.language.lexer import split_statements
from graphloom.language.parser import parse
from graphloom.session import GraphSession
from graphloom.sources.tables import edge_list
from graphloom.store import GraphStore
from tests.conftest import rows

DEPOT = """
CREATE VERTEX Depot (city STRING, bays INT64, heated BOOLEAN); -- places goods are kept at
CREATE EDGE SENDS (tons FLOAT64);
INSERT VERTEX Depot (id, city, bays, heated) VALUES (11, 'Oslo', 40, true), (12, 'Riga; east', 15, false), (13, 'Turku', 65, true);
INSERT EDGE SENDS (tons) VALUES (11, 12): (0.5), 12 -> 13: (1.5), (11, 13): (2.5);
"""


@pytest.fixture
def g(spark):
    session = GraphSession(spark)
    session.script(DEPOT)
    return session


def test_script_splitting_and_comments():
    assert split_statements("RETURN ';' AS a; // x;\nRETURN 2 /* ; */;;# end") == ["RETURN ';' AS a", "// x;\nRETURN 2 /* ; */"]


def test_parse_shapes():
    q = parse("MATCH (a)-->(b)<-[r:X|Y*2..3]-(c), (d) WHERE NOT a.x IN [1, -2] RETURN DISTINCT a.x AS y ORDER BY y DESC SKIP 1 LIMIT 2")
    match, ret = q.clauses
    assert [e.direction for e in match.paths[0].edges] == ["out", "in"] and match.paths[0].edges[1].hops == (2, 3) and len(match.paths) == 2
    assert ret.distinct and ret.skip == 1 and ret.limit == 2 and ret.order[0].descending
    assert parse("CALL algo.sssp({source: 3}) YIELD vertex_id AS v").named == (("source", 3),)
    assert isinstance(parse("EXPLAIN MATCH (n) RETURN n").statement, S.Query)


@pytest.mark.parametrize("text", ["MATCH (a RETURN a", "RETURN", "MATCH (a) RETURN a garbage garbage", "INSERT VERTEX L (id) VALUES (1, 2)", "SELECT 1", "RETURN 'x"])
def test_parse_errors(text):
    with pytest.raises(ParseError):
        parse(text)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("MATCH (a:Depot) WHERE a.bays > 28 RETURN a.city", [("Oslo",), ("Turku",)]),
        ("MATCH (a:Depot)-[r:SENDS]->(b) WHERE r.tons > 1 RETURN a.id AS a, b.id AS b", [(11, 13), (12, 13)]),
        ("MATCH (a)-[:SENDS]->(b)-[:SENDS]->(c) RETURN a.city, c.city", [("Oslo", "Turku")]),
        ("MATCH (a:Depot)-[:SENDS*1..2]->(b) RETURN a.id AS a, b.id AS b", [(11, 12), (11, 13), (12, 13)]),
        ("MATCH (a)-[:SENDS*2]->(b) RETURN b.id AS b", [(13,)]),
        ("MATCH (a)-[k:SENDS*1..2]->(b) WHERE a.id = 11 RETURN k.src AS s, b.id AS b", [(11, 12), (11, 13), (12, 13)]),
        ("MATCH (a)-[:SENDS]-(b) WHERE a.id = 12 RETURN b.id AS b", [(11,), (13,)]),
        ("MATCH (a:Depot)-[:SENDS]->(b) WITH a, count(*) AS n WHERE n > 1 RETURN a.city, n", [("Oslo", 2)]),
        ("MATCH (a:Depot) RETURN count(*) AS n, sum(a.bays) + 1 AS s, avg(a.bays) AS m", [(3, 121, 40.0)]),
        ("MATCH (a:Depot) WHERE a.bays > 99 RETURN count(*) AS n, sum(a.bays) AS s", [(0, 0)]),
        ("MATCH (a:Depot) WHERE a.city = NULL RETURN a.id", []),
        ("MATCH (a:Depot) RETURN a.city + '!' AS x ORDER BY a.bays LIMIT 1", [("Riga; east!",)]),
        ("MATCH (a:Depot), (b:Depot) WHERE a.id < b.id AND a.heated RETURN a.id AS a, b.id AS b", [(11, 12), (11, 13)]),
        ("MATCH (a:Depots) RETURN count(a) AS n", [(3,)]),
        ("MATCH (a:Depot) RETURN labels(a) AS l, a.nothing AS x LIMIT 1", [(["Depot"], None)]),
        ("MATCH (a:Depot) WHERE a.bays <> 40 RETURN a.bays", [(15,), (65,)]),
        ("MATCH (a:Depot)-[r:SENDS]->(b {id: 13}) WITH DISTINCT b.city AS c RETURN c", [("Turku",)]),
        ("MATCH (a:Depot)-[r:SENDS]->(b) WITH a.heated AS h, b.id AS b RETURN DISTINCT h, b", [(False, 13), (True, 12), (True, 13)]),
    ],
)
def test_queries(g, text, want):
    assert rows(g.query(text)) == sorted(want, key=repr)


def test_column_names(g):
    names = lambda text: g.query(text).columns
    assert names("MATCH (a:Depot) RETURN a.city, count(*), max(a.bays), a.bays + 1, 7, a.bays b") == ["a.city", "count(*)", "max(...)", "col_3", "7", "b"]
    assert names("MATCH (a:Depot) RETURN a") == ["a"]


def test_whole_entities_are_json(g):
    assert json.loads(g.query("MATCH (a:Depot {id: 12}) RETURN a").first()[0]) == {"id": 12, "label": "Depot", "properties": {"city": "Riga; east", "bays": 15, "heated": False}}
    assert json.loads(g.query("MATCH (a {id: 12})-[r]->(b) RETURN r").first()[0]) == {"src": 12, "dst": 13, "rank": 0, "properties": {"tons": 1.5}}


def test_trails_use_no_edge_twice(spark):
    g = GraphSession(spark)
    g.script("CREATE VERTEX N (); CREATE EDGE E (); INSERT VERTEX N (id) VALUES (1), (2), (3), (4); INSERT EDGE E () VALUES (1, 2), (2, 1), (2, 3), (3, 2), (3, 4)")
    ends = lambda text: rows(g.query(text))
    assert ends("MATCH (a)-[:E*2]->(b) WHERE a.id = 1 RETURN b.id AS b") == [(3,)]
    assert ends("MATCH (a)-[:E*3]->(b) WHERE a.id = 1 RETURN b.id AS b") == [(2,), (4,)]  # 1-2-1-2 would use an edge twice, 1-2-3-2 does not
    assert ends("MATCH (a)-[:E*4..5]->(b) WHERE a.id = 1 RETURN b.id AS b") == []
    assert ends("MATCH (a)-[:E*..3]->(b) WHERE a.id = 1 RETURN b.id AS b") == [(2,), (3,), (4,)]


def test_updates(g):
    g.script("""MATCH (a:Depot) WHERE a.id = 12 SET a.bays = a.bays + 10; MATCH (a:Depot {id: 13}) DETACH DELETE a;
    MERGE (p:Depot {city: 'Vaasa'}); MERGE (p:Depot {city: 'Vaasa'}); MERGE VERTEX Depot (id, bays) VALUES (11, 41)""")
    assert rows(g.query("MATCH (a:Depot) RETURN a.city, a.bays")) == [("Oslo", 41), ("Riga; east", 25), ("Vaasa", None)]
    assert rows(g.query("MATCH (a)-[r]->(b) RETURN a.id, b.id")) == [(11, 12)]
    g.query("MATCH (a:Depot), (b:Depot) WHERE a.city = 'Vaasa' AND b.id = 11 CREATE (a)-[:SENDS {tons: 3.0}]->(b)")
    g.query("MATCH (a:Depot), (b:Depot) WHERE a.city = 'Vaasa' AND b.id = 11 MERGE (a)-[:SENDS]->(b)")
    assert rows(g.query("MATCH (a)-[r:SENDS]->(b) RETURN r.tons")) == [(0.5,), (3.0,)]
    assert g.query("compact;").first()["rows_affected"] == 2
    g.query("DELETE EDGE SENDS FROM 11 TO 12")
    assert g.query("MATCH (a)-[r]->(b) RETURN a").count() == 1
    g.script("INSERT EDGE SENDS FROM 11 TO 12 RANK 3, FROM 11 TO 12; DELETE EDGE SENDS FROM 11 TO 12 RANK 3")
    assert rows(g.query("MATCH (a {id: 11})-[r]->(b) RETURN r.rank AS k")) == [(0,)]
    made = g.store.version
    g.query("MERGE VERTEX Depot (city, bays) VALUES ('Oslo', 41), ('Pori', 5), ('Pori', 5), ('Kemi', NULL)")
    assert rows(g.query("MATCH (a:Depot) WHERE a.id > 13 RETURN a.city")) == [("Kemi",), ("Pori",)] and g.store.version == made + 1


def test_old_versions_stay_readable(spark):
    store = GraphStore(spark)
    store.define("vertex", "V", (("x", "INT64"),))
    put = lambda i, x: store.upsert("vertex", "V", spark.createDataFrame([(i, x)], "_id bigint, x int"))
    for i in range(1, 19):
        put(i, i)
    assert store.read("vertex", "V").count() == 18  # compacts by itself
    put(1, 100)
    assert [store.read("vertex", "V", v).count() for v in (0, 1, 17, 18, 19)] == [0, 1, 17, 18, 18]
    assert store.read("vertex", "V", 18).where("_id = 1").first()["x"] == 1 and store.read("vertex", "V").where("_id = 1").first()["x"] == 100
    store.alter("vertex", "V", (("y", "STRING"),), ("x",))
    assert store.read("vertex", "V").columns == ["_id", "y"] and store.read("vertex", "V", 19).columns == ["_id", "x"]
    assert store.forget(20) > 0
    with pytest.raises(ExecutionError):
        store.read("vertex", "V", 3)
    assert store.read("vertex", "V").count() == 18


def test_the_last_of_rows_with_one_key_wins(spark):
    store = GraphStore(spark)
    store.define("vertex", "V", (("x", "INT64"),))
    data = [(1, 5, 3), (1, 9, 1), (1, 7, 2), (2, 4, None), (2, 3, None)]
    for parts in (1, 5):
        store.upsert("vertex", "V", spark.createDataFrame(data, "_id bigint, x bigint, t int").repartition(parts), ["t"])
        assert rows(store.read("vertex", "V")) == [(1, 5), (2, 4)]


def test_ingest_infers_the_kind(spark, tmp_path):
    store = GraphStore(spark)
    store.ingest(spark.createDataFrame([(1, "a", 1.5), (2, "b", None)], "id int, name string, w float"))
    store.ingest(spark.createDataFrame([(1, 2, 7), (2, 1, 0)], "SRC int, dst int, since int"))
    assert list(store.catalog.labels) == ["VERTEX"] and rows(store.edges("EDGE")) == [(1, 0, 2, 7), (2, 0, 1, 0)]
    assert rows(store.vertices("VERTEX")) == [(1, "a", 1.5), (2, "b", None)]
    with pytest.raises(ExecutionError):
        store.ingest(spark.createDataFrame([("a",)], "name string"))
    store.define("vertex", "Other", ())
    with pytest.raises(ExecutionError):
        store.ingest(spark.createDataFrame([(1,)], "id int"))
    schema = "src bigint, dst bigint, since bigint, at int"
    for i, data in enumerate([[(5, 6, 1, 1), (5, 6, 2, 2)], [(5, 6, 3, 3), (6, 5, 1, 1)]]):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        store.ingest_stream(stream, str(tmp_path / "state"), "EDGE", ["at"]).awaitTermination()
        assert store.edges("EDGE").where("_src = 5").first()["since"] == i + 2
    assert store.edges("EDGE").count() == 4


def test_edge_list_files(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# a comment\n1\t2\nx\t3\n4\t5\n")
    assert rows(edge_list(spark, str(tmp_path / "e.txt"))) == [(1, 2), (4, 5)]


def test_functions_batches_and_results(g):
    g.register_function("Twice", lambda x: x * 2)
    assert rows(g.query("MATCH (a:Depot) RETURN twice(a.bays) AS t")) == [(130,), (30,), (80,)]
    out = g.batch(["MATCH (a:Depot) RETURN a.id", "MATCH (a:No) RETURN a", "SHOW GRAPHS"])
    assert out[0].count() == 3 and isinstance(out[1], SchemaError) and out[2].first()["graph_name"] == "default"
    done = json.loads(g.json("MATCH (a:Depot) WHERE a.id = 11 RETURN a.city AS c, a.heated AS h"))
    assert (done["status"], done["columns"], done["rows"], done["num_rows"]) == ("ok", ["c", "h"], [["Oslo", True]], 1)
    assert g.execute("INSERT VERTEX Depot (id, city) VALUES (20, 'X'), (21, 'Y')")["rows_affected"] == 2
    assert g.execute("nonsense")["status"] == "error"
    assert g.stats()["total_vertices"] == 5 and g.schema()["edges"][0]["count"] == 3


def test_export_and_import(g, spark, tmp_path):
    g.query("INSERT VERTEX Depot (id, city, bays) VALUES (30, 'It\\'s', NULL)")
    g.export(str(tmp_path / "out"))
    text = "\n".join(p.read_text() for d in sorted((tmp_path / "out").iterdir()) for p in sorted(d.glob("part-*")))
    other = GraphSession(spark)
    other.script(text)
    for q in ("MATCH (a:Depot) RETURN a", "MATCH (a)-[r]->(b) RETURN r"):
        assert rows(other.query(q)) == rows(g.query(q))


def test_command_line(spark, tmp_path, capsys):
    script = tmp_path / "x.txt"
    script.write_text("CREATE VERTEX V (x INT64);\nINSERT VERTEX V (id, x)\n VALUES (1, 2); // two lines\nMATCH (v:V) RETURN v.x AS x; bad;")
    assert main(["-f", str(script)]) == 1
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert [x["status"] for x in lines] == ["ok", "ok", "ok", "error"] and lines[2]["rows"] == [[2]]


def test_catalog_graphs_and_errors(g, spark, tmp_path):
    g.script("ALTER VERTEX Depot ADD (mail STRING); CREATE INDEX ON :Depot(mail); CREATE GRAPH other; USE other; CREATE VERTEX X ()")
    assert g.active == "other" and g.query("SHOW TAGS").first()["label"] == "X"
    g.query("DROP GRAPH other")
    assert g.active == "default"
    assert "IndexScan" in g.explain("MATCH (a:Depot) WHERE a.mail = 'x' RETURN a") and "Filter" not in g.explain("MATCH (a:Depot) WHERE a.mail = 'x' RETURN a")
    assert [r.operator for r in g.query("EXPLAIN MATCH (a)-[:SENDS*2..3]->(b) RETURN count(*) AS n").collect()] == ["ScanVertices", "VarLengthExpand", "Aggregate", "Project"]
    assert g.query("SHOW SCHEMA").count() == 2 and g.query("SHOW INDEXES").first()["indexes"] == "mail"
    assert rows(g.query("SHOW EDGE TYPES")) == rows(g.query("SHOW EDGES")) == [("SENDS", 1, "tons FLOAT64")]
    assert g.query("SHOW VERTEX LABELS").first()["label"] == "Depot"
    g.script("CREATE INDEX ON Depot(city); DROP INDEX ON Depot(mail); ALTER EDGE SENDS ADD (via STRING); ALTER VERTEX Depot DROP (mail)")
    assert g.query("MATCH (a)-[r]->(b) RETURN r.via AS v").first()["v"] is None and g.query("SHOW INDEXES").first()["indexes"] == "city"
    for text, error in (("CREATE VERTEX Depot ()", SchemaError), ("MATCH (a:Nope) RETURN a", SchemaError), ("MATCH (a) RETURN b", ExecutionError), ("CALL algo.nope()", ExecutionError), ("DROP GRAPH default", SchemaError), ("MATCH (a) RETURN foo(a)", ExecutionError)):
        with pytest.raises(error):
            g.query(text)
    root = g.snapshot(str(tmp_path))
    before = rows(g.query("MATCH (a)-[r]->(b) RETURN a.city, r.tons"))
    fresh = GraphSession(spark)  # knows nothing of the graph
    fresh.store.restore(root)
    assert rows(fresh.query("MATCH (a)-[r]->(b) RETURN a.city, r.tons")) == before and fresh.query("SHOW INDEXES").count() == 1
    assert fresh.query("backup").first()["version"] == g.store.version
    g.script("DROP EDGE SENDS; DROP VERTEX Depot")
    assert g.query("SHOW SCHEMA").count() == 0


def test_a_cycle_is_joined_from_two_arcs(spark):
    n = 300
    g = GraphSession(spark)
    g.script("CREATE VERTEX Hub (name STRING); CREATE VERTEX Leaf (name STRING); CREATE VERTEX Item (name STRING); CREATE EDGE AT (); CREATE EDGE OFFERS (); CREATE EDGE WANTS ()")
    ids = lambda kind, of: g.query(f"INSERT VERTEX {kind} (id, name) VALUES " + ", ".join(f"({i}, 'x')" for i in of))
    ids("Hub", [1])
    ids("Leaf", range(10, 10 + n))
    ids("Item", range(1000, 1000 + n))
    link = lambda kind, pairs: g.query(f"INSERT EDGE {kind} () VALUES " + ", ".join(f"({a}, {b})" for a, b in pairs))
    link("AT", [(10 + i, 1) for i in range(n)])
    link("OFFERS", [(10 + i, 1000 + i) for i in range(n)])
    link("WANTS", [(10 + i, 1000 + (i + 1) % n) for i in range(n)])
    text = "MATCH (a:Leaf)-[:AT]->(h:Hub)<-[x:AT]-(b:Leaf)-[:OFFERS]->(i:Item)<-[:WANTS]-(a{label}) {where}RETURN id(a) AS a, id(b) AS b, id(i) AS i, x.src AS x"
    for label, where, want in (
        ("", "", [(10 + i, 10 + (i + 1) % n, 1000 + (i + 1) % n, 10 + (i + 1) % n) for i in range(n)]),
        ("", "WHERE id(a) = 15 ", [(15, 16, 1006, 16)]), (":Item", "", []),
    ):
        found = g.query(text.format(label=label, where=where))
        assert sorted(map(tuple, found.collect())) == sorted(want)
    top = g.query(text.format(label="", where=""))._jdf.queryExecution().optimizedPlan()
    while top.nodeName() != "Join":
        top = top.children().apply(0)
    assert "$_id" in top.children().apply(1).toString(), "all pairs of leaves at a hub are made before the cycle closes"
    shown = g.query("MATCH (a:Leaf)-[e:AT]->(h:Hub)<-[:AT]-(b:Leaf)-[:OFFERS]->(i:Item)<-[:WANTS]-(a) RETURN * LIMIT 1").columns
    assert [c.split("$")[0].split(".")[0] for c in shown] == ["a", "e", "h", "b", "i"]
