"""Queries of the general data-processing operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.heavykeys import key_counts
from graphloom.operators.orphans import OrphanLedger, parents, references
from graphloom.scratch import materialise
from graphloom.sources.tables import table
from graphloom.streaming.changefeed import ChangeFeed, arriving, replay

VERTEX, LABEL = 1, 2
EDGE_ID = ["src", "edge_type", "edge_rank", "dst"]


BATCHES = 4  # in which the change feed and the references come


def _replayed(spark: SparkSession, sf: str, payload: list[str]) -> DataFrame:
    feed = ChangeFeed(EDGE_ID, ["version", "batch_pos"], "is_deleted", payload, required=["dst"])
    path, files = arriving(table(spark, sf, "mvcc_edges"), feed, "arrived_at", BATCHES)
    return replay(spark, path, feed, files)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Live edges after all changes of ``mvcc_edges``, applied in micro-batches as they arrive."""
    return _replayed(spark, sf, []).select(*EDGE_ID, "version")


def p1_state(spark: SparkSession, sf: str) -> DataFrame:
    """Live edges with their payload, summed up per source and type."""
    return _replayed(spark, sf, ["weight"]).groupBy("src", "edge_type").agg(
        F.count("*").alias("n_edges"), F.max("version").alias("last_version"), F.round(F.sum("weight"), 4).alias("weight")
    )


def _ledger(spark: SparkSession, sf: str, batches: int = BATCHES) -> OrphanLedger:
    """Both edge ends and the labels of vertices, in ``batches`` slices of the time of ingestion."""
    edges, vertices, labels = table(spark, sf, "edge_ids"), table(spark, sf, "vertices"), table(spark, sf, "vertex_schema")
    span = F.min("ingested_at").alias("a"), F.max("ingested_at").alias("b")
    lo, hi = edges.agg(*span).unionByName(vertices.agg(*span)).agg(F.min("a"), F.max("b")).first()
    ledger = OrphanLedger(spark)
    cuts = [lo + (hi - lo) * i / batches for i in range(1, batches)] if lo is not None else []
    for i in range(len(cuts) + 1):
        def part(df: DataFrame) -> DataFrame:
            at = F.col("ingested_at")
            if i > 0:
                df = df.where(at >= F.lit(cuts[i - 1]).cast("timestamp_ntz"))
            if i < len(cuts):
                before = at < F.lit(cuts[i]).cast("timestamp_ntz")
                df = df.where(before | at.isNull() if i == 0 else before)
            return df

        e, v = part(edges), part(vertices)
        refs = references(e, VERTEX, "edge_ids", "src", "edge_no", "created_at", "ingested_at")
        refs = refs.unionByName(references(e, VERTEX, "edge_ids", "dst", "edge_no", "created_at", "ingested_at"))
        refs = refs.unionByName(references(v, LABEL, "vertices", "label_id", "vid", "created_at", "ingested_at", versioned=True))
        came = parents(v, VERTEX, "vid", "created_at", "deleted_at", "ingested_at")
        if i == 0:
            came = came.unionByName(parents(labels, LABEL, "label_id", "registered_at", "dropped_at"))
        ledger.advance(refs, came)
    return ledger


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Orphan references of edges and vertices."""
    return _ledger(spark, sf).open().select("ref_table", "ref_field", "ref_period", "rec_key", "ref_key", "reason")


def p3_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Open orphans per table, field, period and reason after the last batch."""
    ledger = _ledger(spark, sf)
    return ledger.history().where(F.col("v") == ledger.epoch).drop("v")


def _degrees(spark: SparkSession, sf: str) -> DataFrame:
    return key_counts(table(spark, sf, "edge_ids"), ["src"], ["edge_type", "edge_rank", "dst"], nullable=["edge_type", "edge_rank"])


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sources with at least a thousandth of all distinct edges."""
    degrees = _degrees(spark, sf).select("src", F.col("n_distinct").alias("out_degree"))
    degrees = materialise(degrees, "degrees")
    total = degrees.agg(F.sum("out_degree").alias("total"))
    return degrees.crossJoin(F.broadcast(total)).where(1000 * F.col("out_degree") >= F.col("total")).select("src", "out_degree")


def p5_degrees(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and distinct edges of every source."""
    return _degrees(spark, sf).select("src", F.col("n_rows").alias("n_rows"), F.col("n_distinct").alias("out_degree"))


def p5_max_degree(spark: SparkSession, sf: str) -> DataFrame:
    """The reported and the true greatest out-degree of each load batch."""
    per_source = key_counts(table(spark, sf, "edge_ids"), ["batch_id", "src"])
    true = per_source.groupBy("batch_id").agg(F.max("n_rows").alias("true_max_degree"))
    said = table(spark, sf, "graph_statistics").select(F.col("batch_id").cast("bigint").alias("batch_id"), F.col("max_degree").alias("reported_max_degree")).distinct()
    return said.join(true, "batch_id", "left").select("batch_id", "reported_max_degree", "true_max_degree")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_state, p3_found, p3_counts, p5_found, p5_degrees, p5_max_degree)
}

_LIVE = """live as (
  select * from (
    select src, edge_type, edge_rank, dst, version, coalesce(is_deleted, false) as dead, weight,
      row_number() over (partition by src, edge_type, edge_rank, dst order by version desc, batch_pos desc nulls last,
        coalesce(is_deleted, false) desc, weight desc nulls last) as rn
    from mvcc_edges where version is not null and dst is not null)
  where rn = 1 and not dead)"""

_ORPHANS = """vert as (
  select * from (select *, row_number() over (partition by vid order by ingested_at desc) as rn from vertices) where rn = 1),
refs as (
  select distinct 'edge_ids' as ref_table, 'src' as ref_field, edge_no as rec_key, src as ref_key, created_at as ref_at from edge_ids where src is not null
  union all
  select distinct 'edge_ids', 'dst', edge_no, dst, created_at from edge_ids where dst is not null),
judged as (
  select r.*, case when v.vid is null then 'missing' when v.deleted_at <= r.ref_at then 'deleted' when v.created_at > r.ref_at then 'late' end as reason
  from refs r left join vert v on r.ref_key = v.vid
  union all
  select 'vertices', 'label_id', v.vid, v.label_id, v.created_at,
    case when l.label_id is null then 'missing' when l.dropped_at <= v.created_at then 'deleted' when l.registered_at > v.created_at then 'late' end
  from vert v left join vertex_schema l on v.label_id = l.label_id where v.label_id is not null),
orphans as (
  select distinct ref_table, ref_field, strftime(ref_at, '%Y-%m') as ref_period, rec_key, cast(ref_key as bigint) as ref_key, reason
  from judged where reason is not null)"""

SQL: dict[str, str] = {
    "p1_found": f"with {_LIVE} select src, edge_type, edge_rank, dst, version from live",
    "p1_state": f"with {_LIVE} select src, edge_type, count(*) as n_edges, max(version) as last_version, round(sum(weight), 4) as weight from live group by src, edge_type",
    "p3_found": f"with {_ORPHANS} select * from orphans",
    "p3_counts": f"with {_ORPHANS} select ref_table, ref_field, ref_period, reason, count(*) as n_open from orphans group by all",
    "p5_found": """with d as (
  select src, count(*) as out_degree from (
    select distinct src, edge_type, edge_rank, dst from edge_ids where src is not null and dst is not null) group by src)
select src, out_degree from d where 1000 * out_degree >= (select sum(out_degree) from d)""",
    "p5_degrees": """select src, count(*) as n_rows, count(distinct (edge_type, edge_rank, dst)) as out_degree
from edge_ids where src is not null and dst is not null group by src""",
    "p5_max_degree": """select cast(s.batch_id as bigint) as batch_id, s.max_degree as reported_max_degree, t.true_max_degree
from (select distinct batch_id, max_degree from graph_statistics) s
left join (select batch_id, max(n) as true_max_degree from (
  select batch_id, src, count(*) as n from edge_ids where src is not null group by batch_id, src) group by batch_id) t on s.batch_id = t.batch_id""",
}
