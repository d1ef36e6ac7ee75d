"""Queries in the graph language and graph algorithms, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.algo import ann, communities, graph, vector, walks
from graphloom.datasets import chain_graph, entity_graph, part_next, ring_graph, tpch_graph, user_next
from graphloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
STEP = 1_000_000_000_000


def _text(name: str, statement: str, sql: str | None, build=tpch_graph) -> None:
    QUERIES[name] = lambda spark, sf: build(spark, sf).query(statement)
    if sql:
        SQL[name] = sql


_text("scan_label", "MATCH (n:Nation) RETURN n.n_nationkey AS k, n.n_name AS name", "select n_nationkey as k, n_name as name from nation")
_text("point_id", f"MATCH (c:Customer) WHERE id(c) = {3 * STEP + 7} RETURN c.c_name AS name", "select c_name as name from customer where c_custkey = 7")
_text("index_eq", "MATCH (c:Customer) WHERE c.c_mktsegment = 'BUILDING' RETURN c.c_custkey AS k", "select c_custkey as k from customer where c_mktsegment = 'BUILDING'")
_text("inline_map", "MATCH (c:Customer {c_mktsegment: 'BUILDING'})-[:LIVES_IN]->(n:Nation {n_nationkey: 3}) RETURN c.c_custkey AS k", "select c_custkey as k from customer where c_mktsegment = 'BUILDING' and c_nationkey = 3")
_text("filter_and_or", "MATCH (p:Part) WHERE (p.p_size < 10 OR p.p_size >= 45) AND NOT p.p_size = 5 RETURN p.p_partkey AS k, p.p_size - 1 AS s", "select p_partkey as k, p_size - 1 as s from part where (p_size < 10 or p_size >= 45) and not p_size = 5")
_text("hop1", "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 100000 RETURN c.c_mktsegment AS seg, count(*) AS n, max(o.o_totalprice) AS top",
      "select c_mktsegment as seg, count(*) as n, max(o_totalprice) as top from customer join orders on o_custkey = c_custkey where o_totalprice > 100000 group by c_mktsegment")
_text("hop2", "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN r.r_name AS region, count(*) AS n",
      "select r_name as region, count(*) as n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name")
_text("hop3", "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:LIVES_IN]-(c:Customer)-[:PLACED]->(o:Order) RETURN r.r_name AS region, count(o) AS n, min(o.o_totalprice) AS low",
      "select r_name as region, count(*) as n, min(o_totalprice) as low from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey group by r_name")
_text("edge_props", "MATCH (o:Order)-[l:CONTAINS]->(p:Part) WHERE l.l_quantity > 45 RETURN p.p_brand AS brand, count(l) AS n, max(l.rank) AS r",
      """select p_brand as brand, count(*) as n, max(r) as r from (select *, row_number() over (partition by l_orderkey, l_partkey
order by l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 as r from lineitem)
join part on p_partkey = l_partkey join orders on o_orderkey = l_orderkey where l_quantity > 45 group by p_brand""")
_text("any_edge", "MATCH (c:Customer)-[e]->(x) RETURN e.type AS kind, label(x) AS target, count(*) AS n",
      "select 'PLACED' as kind, 'Order' as target, (select count(*) from orders) as n union all select 'LIVES_IN', 'Nation', (select count(*) from customer)")
_text("cross_match", "MATCH (a:Region), (b:Nation) WHERE a.r_regionkey = b.n_regionkey AND b.n_nationkey < 9 RETURN a.r_name AS r, b.n_name AS n", "select r_name as r, n_name as n from region, nation where r_regionkey = n_regionkey and n_nationkey < 9")
_text("cycle3", "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation)<-[:BASED_IN]-(s:Supplier)-[:SUPPLIES]->(p:Part)<-[:CONTAINS]-(o:Order)<-[:PLACED]-(c) RETURN n.n_name AS nation, count(*) AS k",
      """select n_name as nation, count(*) as k from customer join nation on c_nationkey = n_nationkey join supplier on s_nationkey = n_nationkey
join (select distinct l_suppkey, l_partkey from lineitem) sp on sp.l_suppkey = s_suppkey join orders on o_custkey = c_custkey
join lineitem l on l.l_orderkey = o_orderkey and l.l_partkey = sp.l_partkey group by n_name""")
_text("global_agg", "MATCH (o:Order) RETURN count(*) AS n, min(o.o_totalprice) AS lo, max(o.o_totalprice) AS hi", "select count(*) as n, min(o_totalprice) as lo, max(o_totalprice) as hi from orders")
_text("agg_empty", "MATCH (o:Order) WHERE o.o_totalprice < 0 RETURN count(*) AS n, sum(o.o_orderkey) AS s", "select 0 as n, 0 as s")
_text("with_having", "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(*) AS n WHERE n > 15 RETURN c.c_custkey AS k, n", "select o_custkey as k, count(*) as n from orders group by o_custkey having count(*) > 15")
_text("with_match", "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(*) AS n WHERE n > 15 MATCH (c)-[:LIVES_IN]->(x:Nation) RETURN x.n_name AS nation, sum(n) AS n",
      "select n_name as nation, sum(n) as n from (select o_custkey, count(*) as n from orders group by 1 having count(*) > 15) join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey group by 1")
_text("with_topn", "MATCH (p:Part) WITH p.p_partkey AS k, p.p_retailprice AS v ORDER BY v DESC, k LIMIT 20 RETURN k, v", "select p_partkey as k, p_retailprice as v from part order by v desc, k limit 20")
_text("distinct_rows", "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) RETURN DISTINCT n.n_name AS nation, c.c_mktsegment AS seg", "select distinct n_name as nation, c_mktsegment as seg from customer join nation on c_nationkey = n_nationkey")
_text("order_skip_limit", "MATCH (o:Order) RETURN o.o_orderkey AS k, o.o_totalprice AS v ORDER BY v DESC, k SKIP 5 LIMIT 10", "select o_orderkey as k, o_totalprice as v from orders order by v desc, k limit 10 offset 5")
_text("entity_json", "MATCH (r:Region) RETURN r", "select cast(to_json({'id': 1000000000000 + r_regionkey, 'label': 'Region', 'properties': {'r_regionkey': r_regionkey, 'r_name': r_name}}) as varchar) as r from region")
_text("edge_json", "MATCH (n:Nation)-[e:IN_REGION]->(r:Region) RETURN e AS e", "select cast(to_json({'src': 2000000000000 + n_nationkey, 'dst': 1000000000000 + n_regionkey, 'rank': 0, 'properties': {}}) as varchar) as e from nation")
_text("in_edge", "MATCH (o:Order)<-[:PLACED]-(c:Customer) WHERE c.c_mktsegment = 'BUILDING' RETURN o.o_orderstatus AS st, count(*) AS n",
      "select o_orderstatus as st, count(*) as n from orders join customer on c_custkey = o_custkey where c_mktsegment = 'BUILDING' group by 1")
_text("group_agg", "MATCH (p:Part) RETURN p.p_brand AS brand, count(*) AS n, sum(p.p_size) AS s, avg(p.p_size) AS m, min(p.p_retailprice) AS lo, max(p.p_retailprice) AS hi, count(DISTINCT p.p_type) AS types",
      "select p_brand as brand, count(*) as n, sum(p_size) as s, avg(p_size) as m, min(p_retailprice) as lo, max(p_retailprice) as hi, count(distinct p_type) as types from part group by 1")
_text("common_neighbors", "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation)<-[:BASED_IN]-(s:Supplier) WHERE c.c_acctbal > 9000 AND s.s_acctbal > 5000 RETURN c.c_custkey AS c, s.s_suppkey AS s, n.n_name AS shared",
      "select c_custkey as c, s_suppkey as s, n_name as shared from customer join nation on n_nationkey = c_nationkey join supplier on s_nationkey = n_nationkey where c_acctbal > 9000 and s_acctbal > 5000")
_text("with_distinct", "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) WITH DISTINCT n, c.c_mktsegment AS seg RETURN n.n_name AS nation, count(seg) AS n", "select n_name as nation, count(distinct c_mktsegment) as n from customer join nation on n_nationkey = c_nationkey group by 1")
_text("concat_plus", "MATCH (c:Customer) WHERE c.c_nationkey <> 3 RETURN c.c_name + '/' + c.c_mktsegment AS t, c.c_custkey + 1 AS k", "select c_name || '/' || c_mktsegment as t, c_custkey + 1 as k from customer where c_nationkey <> 3")
_CHAIN = "c as (select c_custkey as a, lead(c_custkey) over (partition by c_nationkey, c_mktsegment order by c_acctbal, c_custkey) as b from customer), e as (select a, b from c where b is not null)"
_text("varlen_1_3", "MATCH (a:Customer)-[:NEXT*1..3]->(b:Customer) RETURN a.c_custkey AS a, b.c_custkey AS b",
      f"with recursive {_CHAIN}, r(a, b, d) as (select a, b, 1 from e union select r.a, e.b, d + 1 from r join e on r.b = e.a where d < 3) select distinct a, b from r where a <> b", chain_graph)
_text("varlen_2_2", "MATCH (a:Customer)-[:NEXT*2]->(b:Customer) RETURN a.c_custkey AS a, b.c_custkey AS b", f"with {_CHAIN} select distinct x.a, y.b from e x join e y on x.b = y.a where x.a <> y.b", chain_graph)
_text("varlen_edge", "MATCH (a:Customer)-[e:NEXT*1..2]->(b:Customer) RETURN a.c_custkey AS a, b.c_custkey AS b, e.src AS via",
      f"with {_CHAIN} select distinct a, b, a as via from e where a <> b union select x.a, y.b, y.a from e x join e y on x.b = y.a where x.a <> y.b", chain_graph)
_RING = "n as (select count(*) as n from supplier), e as (select distinct s_suppkey as a, (s_suppkey * m) % n.n as b from supplier, n, (values (2), (3)) t(m) where s_suppkey between 1 and n.n - 1 and s_suppkey <> (s_suppkey * m) % n.n and (s_suppkey * m) % n.n > 0)"
_text("varlen_trail", "MATCH (a:Supplier)-[:TO*2..3]->(b:Supplier) RETURN a.s_suppkey AS a, b.s_suppkey AS b",
      f"""with {_RING}, two as (select x.a, x.b as m, y.b from e x join e y on x.b = y.a where not (x.a = y.a and x.b = y.b)),
three as (select t.a, z.b from two t join e z on t.b = z.a where not (z.a = t.a and z.b = t.m) and not (z.a = t.m and z.b = t.b))
select distinct a, b from (select a, b from two union all select a, b from three) where a <> b""", ring_graph)
_text("varlen_cycle", "MATCH (a:Supplier)-[:TO*1..3]->(b:Supplier) RETURN a.s_suppkey AS a, b.s_suppkey AS b",
      f"with recursive {_RING}, r(a, b, d) as (select a, b, 1 from e union select r.a, e.b, d + 1 from r join e on r.b = e.a where d < 3) select distinct a, b from r where a <> b", ring_graph)


def _add(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


_PARTS = """e as (select distinct a as src, b as dst from (select l_partkey a, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) b
  from lineitem where l_quantity >= 44) where b is not null and a <> b),
n as (select src as v from e union select dst from e), u as (select src as v, dst as o from e union select dst, src from e)"""
_USERS = """e as (select distinct a as src, b as dst from (select user_id a, lead(user_id) over (order by ts, event_id) b from events where event_type = 'purchase') where b is not null and a <> b),
n as (select src as v from e union select dst from e)"""


@_add("degree", f"""with {_PARTS} select v as vertex_id, (select count(*) from e where dst = v) as in_degree, (select count(*) from e where src = v) as out_degree,
(select count(*) from e where dst = v) + (select count(*) from e where src = v) as total_degree from n""")
def degree(spark, sf):
    return graph.degree(part_next(spark, sf))


@_add("triangles_lcc", f"""with {_PARTS}, d as (select v, count(*) as d from u group by v),
t as (select x.v, count(*) / 2 as t from u x join u y on x.v = y.v and x.o <> y.o join u z on z.v = x.o and z.o = y.o group by x.v)
select n.v as vertex_id, cast(coalesce(t, 0) as bigint) as triangles, case when d > 1 then round(2.0 * coalesce(t, 0) / (d * (d - 1)), 6) else 0.0 end as clustering_coefficient
from n left join d on d.v = n.v left join t on t.v = n.v""")
def triangles_lcc(spark, sf):
    return graph.triangles(part_next(spark, sf)).withColumn("clustering_coefficient", F.round("clustering_coefficient", 6))


_RANKS = ", ".join(
    f"""r{i} as (select n.v, 0.15 / c.n + 0.85 * coalesce(s.x, 0) + 0.85 * l.x / c.n as r from n cross join c
cross join (select coalesce(sum(r), 0) as x from r{i - 1} where v not in (select src from e)) l
left join (select e.dst as v, sum(r.r / o.d) as x from e join r{i - 1} r on r.v = e.src join o on o.src = e.src group by e.dst) s on s.v = n.v)"""
    for i in range(1, 11)
)


@_add("pagerank_10", f"with {_PARTS}, c as (select count(*) as n from n), o as (select src, count(*) as d from e group by src), r0 as (select v, 1.0 / c.n as r from n, c), {_RANKS} select v as vertex_id, round(r, 9) as score from r10")
def pagerank_10(spark, sf):
    return graph.pagerank(part_next(spark, sf), 0.85, 10, 0.0).withColumn("score", F.round("score", 9))


@_add("wcc", f"with recursive {_PARTS}, r(v, l) as (select v, v from n union select u.o, r.l from r join u on u.v = r.v where r.l < u.o) select v as vertex_id, min(l) as component_id from r group by v")
def wcc(spark, sf):
    return graph.wcc(part_next(spark, sf))


@_add("scc", f"with recursive {_PARTS}, r(a, b) as (select v, v from n union select r.a, e.dst from r join e on e.src = r.b) select x.a as vertex_id, min(x.b) as component_id from r x join r y on x.a = y.b and x.b = y.a group by x.a")
def scc(spark, sf):
    return graph.scc(part_next(spark, sf))


@_add("sssp", f"with recursive {_USERS}, r(v, d) as (select 1, 0 union select e.dst, d + 1 from r join e on e.src = r.v where d < 12) select n.v as vertex_id, coalesce(min(d), 4294967295) as distance from n left join r on r.v = n.v group by n.v")
def sssp(spark, sf):
    return graph.sssp(user_next(spark, sf), 1)


@_add("closeness", f"""with recursive {_USERS}, r(s, v, d) as (select v, v, 0 from n union select r.s, e.dst, d + 1 from r join e on e.src = r.v where d < 6),
m as (select s, v, min(d) as d from r group by s, v) select n.v as vertex_id, round(coalesce(sum(1.0 / m.d), 0) / ((select count(*) from n) - 1), 6) as closeness from n left join m on m.s = n.v and m.d > 0 group by n.v""")
def closeness(spark, sf):
    return graph.closeness(user_next(spark, sf)).withColumn("closeness", F.round("closeness", 6))


_PATHS = ", ".join(f"""p{i} as materialized (select p.s, e.dst as v, {i} as d, sum(p.paths) as paths from p{i - 1} p join e on e.src = p.v
  join m on m.s = p.s and m.v = e.dst and m.d = {i} group by p.s, e.dst)""" for i in range(1, 7))


@_add("betweenness", f"""with recursive {_USERS}, r(s, v, d) as (select v, v, 0 from n union select r.s, e.dst, d + 1 from r join e on e.src = r.v where d < 6),
m as materialized (select s, v, min(d) as d from r group by s, v), p0 as (select v as s, v, 0 as d, cast(1 as double) as paths from n), {_PATHS},
p as materialized ({" union all ".join(f"select s, v, d, paths from p{i}" for i in range(7))}),
x as (select a.v, sum(a.paths * b.paths / t.paths) as c from p a join p b on b.s = a.v join p t on t.s = a.s and t.v = b.v and t.d = a.d + b.d where a.d > 0 and b.d > 0 group by a.v)
select n.v as vertex_id, round(coalesce(x.c, 0) / (((select count(*) from n) - 1) * ((select count(*) from n) - 2)), 6) as betweenness from n left join x on x.v = n.v""")
def betweenness(spark, sf):
    return graph.betweenness(user_next(spark, sf)).withColumn("betweenness", F.round("betweenness", 6))


_CORES = ", ".join(f"""h{i} as materialized (select n.v, coalesce(least(b.h, (select max(least(x.h, x.i)) from (select y.h, row_number() over (order by y.h desc) as i
  from u join h{i - 1} y on y.v = u.o where u.v = n.v) x)), 0) as h from n left join h{i - 1} b on b.v = n.v)""" for i in range(1, 9))


@_add("kcore", f"with {_PARTS}, h0 as (select n.v, (select count(*) from u where u.v = n.v) as h from n), {_CORES} select v as vertex_id, cast(h as bigint) as coreness from h8")
def kcore(spark, sf):
    return graph.kcore(part_next(spark, sf))


@_add("similarity", f"""with {_USERS}, a as (select dst from e where src = 1), b as (select dst from e where src = 2), c as (select count(*) as k from a semi join b using (dst))
select cast(1 as bigint) as node1, cast(2 as bigint) as node2, round(k / ((select count(*) from a) + (select count(*) from b) - k), 6) as jaccard,
round(k / sqrt((select count(*) from a) * (select count(*) from b)), 6) as cosine, k as common_neighbors from c""")
def similarity(spark, sf):
    return graph.similarity(user_next(spark, sf), 1, 2).withColumns({c: F.round(c, 6) for c in ("jaccard", "cosine")})


_VOTES = ", ".join(f"""l{i} as materialized (select a.v, coalesce(b.l, a.l) as l from l{i - 1} a left join (
  select v, l from (select w.v, x.l, row_number() over (partition by w.v order by sum(w.w) desc, x.l) as rn from w join l{i - 1} x on x.v = w.o group by w.v, x.l) where rn = 1) b on b.v = a.v)""" for i in range(1, 11))


@_add("lpa_sync", f"""with {_PARTS}, w as materialized (select u.v, u.o, 1 + (select count(*) from u x join u y on x.o = y.o where x.v = u.v and y.v = u.o) as w from u),
l0 as (select v, v as l from n), {_VOTES} select v as vertex_id, l as community_id from l10""")
def lpa_sync(spark, sf):
    return communities.lpa(part_next(spark, sf))


@_add("lpa_sequential")
def lpa_sequential(spark, sf):
    return communities.lpa_sequential(part_next(spark, sf))


@_add("louvain_sequential")
def louvain_sequential(spark, sf):
    return communities.louvain_sequential(part_next(spark, sf))


@_add("louvain_gain", "select true as better_than_labels, true as positive")
def louvain_gain(spark, sf):
    """Whether moving by modularity beats the division into single vertices and the one by labels."""
    edges = part_next(spark, sf)
    q, labels = (communities.modularity(edges, x) for x in (communities.louvain(edges), communities.lpa(edges)))
    return spark.createDataFrame([(q >= labels - 0.05, q > 0.3)], "better_than_labels boolean, positive boolean")


@_add("node2vec_norms", f"with {_PARTS} select v as vertex_id, 16 as dimensions, 1.0 as norm from n")
def node2vec_norms(spark, sf):
    """The size and length of the embedding of every vertex."""
    found = walks.node2vec(part_next(spark, sf), 16, 8, 4)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    return found.select("vertex_id", F.size("embedding").alias("dimensions"), F.round(norm, 6).alias("norm"))


_EDGES = """e as (select src, dst from edge_ids where src is not null and dst is not null), n as (select src as v from e union select dst from e),
u as (select distinct src as v, dst as o from e where src <> dst union select distinct dst, src from e where src <> dst)"""


@_add("degree_all", f"""with {_EDGES}, i as (select dst as v, count(*) as k from e group by 1), o as (select src as v, count(*) as k from e group by 1)
select n.v as vertex_id, coalesce(i.k, 0) as in_degree, coalesce(o.k, 0) as out_degree, coalesce(i.k, 0) + coalesce(o.k, 0) as total_degree from n left join i on i.v = n.v left join o on o.v = n.v""")
def degree_all(spark, sf):
    return graph.degree(entity_graph(spark, sf))


@_add("triangles_all", f"""with {_EDGES}, d as (select v, count(*) as d from u group by v), up as (select u.v, u.o, b.d as e from u join d a on a.v = u.v join d b on b.v = u.o where (a.d, u.v) < (b.d, u.o)),
c as (select x.v as a, x.o as b, y.o as c from up x join up y on x.v = y.v and (x.e, x.o) < (y.e, y.o) join up z on z.v = x.o and z.o = y.o),
t as (select v, count(*) as t from (select a as v from c union all select b from c union all select c from c) group by v)
select n.v as vertex_id, coalesce(t, 0) as triangles, case when d > 1 then round(2.0 * coalesce(t, 0) / (d * (d - 1)), 6) else 0.0 end as clustering_coefficient from n left join d on d.v = n.v left join t on t.v = n.v""")
def triangles_all(spark, sf):
    return graph.triangles(entity_graph(spark, sf)).withColumn("clustering_coefficient", F.round("clustering_coefficient", 6))


@_add("wcc_all", f"with recursive {_EDGES}, r(v, l) as (select v, v from n union select u.o, r.l from r join u on u.v = r.v where r.l < u.o) select v as vertex_id, min(l) as component_id from r group by v")
def wcc_all(spark, sf):
    return graph.wcc(entity_graph(spark, sf))


@_add("pagerank_all")
def pagerank_all(spark, sf):
    return graph.pagerank(entity_graph(spark, sf), 0.85, 10, 0.0).withColumn("score", F.round("score", 9))


@_add("kcore_all")
def kcore_all(spark, sf):
    return graph.kcore(entity_graph(spark, sf))


@_add("louvain")
def louvain(spark, sf):
    return communities.louvain(part_next(spark, sf))


def _vector_query(metric: str, sql: str) -> None:
    def run(spark, sf):
        rows = table(spark, sf, "embeddings")
        query = rows.where("vec_id = 0").first()["embedding"]
        return vector.search(rows, "vec_id", "embedding", query, 10, metric).select("node", F.round("similarity", 6).alias("similarity"))

    QUERIES[f"vec_{metric}"] = run
    SQL[f"vec_{metric}"] = f"""with q as (select cast(embedding as double[]) as q from embeddings where vec_id = 0)
select vec_id as node, round({sql}, 6) as similarity from embeddings, q order by {sql} desc, vec_id limit 10"""


@_add("graph_stats", f"with {_CHAIN}, o as (select a, count(*) as n from e group by a) select (select count(*) from customer) as total_vertices, count(*) as total_edges, round(count(*) / (select count(*) from customer), 6) as avg_degree, (select max(n) from o) as max_degree from e")
def graph_stats(spark, sf):
    return chain_graph(spark, sf).query("ANALYZE GRAPH").select("total_vertices", "total_edges", F.round("avg_degree", 6).alias("avg_degree"), "max_degree")


_vector_query("cosine", "list_cosine_similarity(cast(embedding as double[]), q)")
_vector_query("dot", "list_inner_product(cast(embedding as double[]), q)")
_vector_query("l2", "1 / (1 + list_distance(cast(embedding as double[]), q))")


@_add("insert_merge_delete", """select n_nationkey as k, case when n_nationkey = 3 then 'THREE' else n_name end as name from nation where n_nationkey <> 5
union all select 100, 'HUNDRED'""")
def insert_merge_delete(spark, sf):
    g = tpch_graph(spark, sf)
    g.script(f"""INSERT VERTEX Nation (id, n_nationkey, n_name) VALUES ({2 * STEP + 100}, 100, 'HUNDRED');
    MERGE VERTEX Nation (id, n_name) VALUES ({2 * STEP + 3}, 'THREE'); MATCH (n:Nation) WHERE n.n_nationkey = 5 DETACH DELETE n""")
    return g.query("MATCH (n:Nation) RETURN n.n_nationkey AS k, n.n_name AS name")


@_add("create_edge", "select r_name as region, count(*) as n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1")
def create_edge(spark, sf):
    g = tpch_graph(spark, sf)
    g.script("CREATE EDGE HOME (via STRING); MATCH (c:Customer)-[:LIVES_IN]->(n:Nation)-[:IN_REGION]->(r:Region) CREATE (c)-[:HOME {via: n.n_name}]->(r)")
    return g.query("MATCH (c:Customer)-[h:HOME]->(r:Region) RETURN r.r_name AS region, count(h.via) AS n")


@_add("set_prop", "select c_mktsegment as seg, count(*) as n, sum(case when c_nationkey = 1 then 1 else c_custkey end) as s from customer group by 1")
def set_prop(spark, sf):
    g = tpch_graph(spark, sf)
    g.query("MATCH (c:Customer) WHERE c.c_nationkey = 1 SET c.c_custkey = 1")
    return g.query("MATCH (c:Customer) RETURN c.c_mktsegment AS seg, count(*) AS n, sum(c.c_custkey) AS s")


@_add("detach_delete", "select n_name as nation, count(*) as n from customer join nation on n_nationkey = c_nationkey where n_nationkey <> 5 group by 1")
def detach_delete(spark, sf):
    g = tpch_graph(spark, sf)
    g.query("MATCH (n:Nation) WHERE n.n_nationkey = 5 DETACH DELETE n")
    # edges to the deleted vertex would show as more rows of the second pattern than of the first
    g.script("CREATE EDGE COPY (); MATCH (c:Customer)-[:LIVES_IN]->(n) CREATE (c)-[:COPY]->(n)")
    return g.query("MATCH (c:Customer)-[:COPY]->(n:Nation) RETURN n.n_name AS nation, count(*) AS n")


@_add("alter_add_drop", "select s_suppkey as k, case when s_nationkey = 1 then 'one' end as note from supplier")
def alter_add_drop(spark, sf):
    g = tpch_graph(spark, sf)
    g.script("ALTER VERTEX Supplier ADD (note STRING); MATCH (s:Supplier) WHERE s.s_nationkey = 1 SET s.note = 'one'; ALTER VERTEX Supplier DROP (s_acctbal)")
    return g.query("MATCH (s:Supplier) RETURN s.s_suppkey AS k, s.note AS note")


@_add("versioned_read", "select s_suppkey as k, s_name as name from supplier")
def versioned_read(spark, sf):
    """The rows of a table as they were before later changes and a compaction."""
    g = tpch_graph(spark, sf)
    before = g.store.version
    g.script("MATCH (s:Supplier) WHERE s.s_nationkey = 1 SET s.s_name = 'x'; compact; MATCH (s:Supplier) WHERE s.s_nationkey = 2 DELETE s")
    return g.store.read("vertex", "Supplier", before).select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))


@_add("ann_exact", """with q as (select cast(embedding as double[]) as q from embeddings where vec_id = 0)
select vec_id as node, round(list_cosine_similarity(cast(embedding as double[]), q), 6) as similarity from embeddings, q order by list_cosine_similarity(cast(embedding as double[]), q) desc, vec_id limit 10""")
def ann_exact(spark, sf):
    """Search by the vector index with all cells."""
    rows = table(spark, sf, "embeddings")
    query = rows.where("vec_id = 0").first()["embedding"]
    return ann.probe(ann.build(rows, "vec_id", "embedding", len(query)), query, 10, probes=ann.CELLS).select("node", F.round("similarity", 6).alias("similarity"))
