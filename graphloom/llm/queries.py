"""Queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.components import group_ids
from graphloom.llm.mixing import mix
from graphloom.llm.packing import containers, pack
from graphloom.llm.setjoin import similar_pairs, similar_sets
from graphloom.llm.spans import shared_chars, shared_spans
from graphloom.llm.tokens import count_tokens
from graphloom.llm.vectors import nearest, recall, usable_vectors
from graphloom.scratch import materialise
from graphloom.sources.tables import table


def _tagged(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return similar_sets(table(spark, sf, "edge_ids").where("edge_type = 3"), "src", "dst", 0.7)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sources whose sets of tags overlap by 0.7 or more."""
    pairs = similar_pairs(*_tagged(spark, sf))
    return pairs.select(F.col("a").alias("src_a"), F.col("b").alias("src_b"))


def p2_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Links between classes of equal tag sets, with both class sizes."""
    members, links = _tagged(spark, sf)
    size = members.groupBy("rep").agg(F.count("*").alias("n"))
    a, b = size.withColumnsRenamed({"rep": "a", "n": "n_a"}), size.withColumnsRenamed({"rep": "b", "n": "n_b"})
    return links.join(a, "a").join(b, "b").select(F.col("a").alias("rep_a"), F.col("b").alias("rep_b"), "shared", "n_a", "n_b")


def p4_top5(spark: SparkSession, sf: str) -> DataFrame:
    """The five most similar other nodes of every usable vector, found in the 32 nearest cells."""
    return nearest(usable_vectors(table(spark, sf, "hnsw_nodes")), k=5, probes=32)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of cosine 0.9 or more of which one is among the five nearest of the other."""
    pairs = nearest(usable_vectors(table(spark, sf, "hnsw_nodes")), k=5, least=0.9)
    return pairs.select(F.least("vid", "other").alias("vid_a"), F.greatest("vid", "other").alias("vid_b")).distinct()


def p4_recall(spark: SparkSession, sf: str) -> DataFrame:
    """How much of the true five nearest, and of those of cosine 0.9 or more, the two searches find; every vid divisible by 20 against all."""
    usable = materialise(usable_vectors(table(spark, sf, "hnsw_nodes")), "usable")
    asked = usable.where("vid % 20 = 0")
    top = recall(usable, nearest(usable, k=5, probes=32), asked, 5).withColumn("search", F.lit("top5"))
    close = recall(usable, nearest(usable, k=5, least=0.9), asked, 5, 0.9).withColumn("search", F.lit("found"))
    return top.unionByName(close).select("search", "n_queries", "n_true", "n_found", "recall")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """The group of every vertex in SAME_AS edges."""
    return group_ids(table(spark, sf, "edge_ids").where("edge_type = 4"), "src", "dst")


def p6_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of matched vertices by size."""
    groups = p6_found(spark, sf).groupBy("group_id").agg(F.count("*").alias("size"))
    return groups.groupBy("size").agg(F.count("*").alias("n_groups"))


CAPACITY = "medium"


def _sized(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their source (trimmed, lower case), size in tokens, and duplicate clusters: copies and families."""
    docs = table(spark, sf, "documents")
    clusters = F.array_compact(F.array(F.xxhash64("text"), F.xxhash64(F.lit("family"), F.when(F.col("family_id").isNotNull(), F.col("family_id")))))
    clusters = F.when(F.col("family_id").isNull(), F.slice(clusters, 1, 1)).otherwise(clusters)
    return docs.select(
        F.col("doc_id").alias("id"), F.lower(F.trim("source")).alias("source"), clusters.alias("clusters"), count_tokens(F.col("text")).alias("size")
    )


def _capacity(spark: SparkSession, sf: str) -> int:
    return table(spark, sf, "containers").where(F.col("container_kind") == CAPACITY).first()["capacity_tokens"]


def p7_pack(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in containers of 2048 tokens, copies and family members apart."""
    return pack(_sized(spark, sf), _capacity(spark, sf)).select(F.col("id").alias("doc_id"), F.col("piece").alias("piece_no"), F.col("size").alias("n_tokens"), "container")


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    """How well the containers of ``p7_pack`` are filled."""
    capacity = _capacity(spark, sf)
    return containers(pack(_sized(spark, sf), capacity), capacity)


def _by_characters(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as in ``_sized``, but sized in characters, which SQL can count too."""
    docs = table(spark, sf, "documents")
    clusters = F.when(F.col("family_id").isNotNull(), F.array("family_id"))
    return docs.select(F.col("doc_id").alias("id"), F.lower(F.trim("source")).alias("source"), clusters.alias("clusters"), F.length("text").cast("bigint").alias("size"))


PATENT_CAPACITY = 20_000


def p7_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What every packing must keep, counted on one by characters: all is packed once, nothing overfull, split or clashing without need.

    The two sources with the most documents are kept apart, so the source
    conflicts decide as well.
    """
    items = materialise(_by_characters(spark, sf), "sized")
    top = [r["source"] for r in items.groupBy("source").agg(F.count("*").alias("n")).where("source is not null").orderBy(F.desc("n"), "source").limit(2).collect()]
    packed = materialise(pack(items, PATENT_CAPACITY, [tuple(top)] if len(top) == 2 else []), "packed")
    held = packed.where("container is not null")
    full = held.groupBy("container").agg(F.sum("size").alias("s")).where(F.col("s") > PATENT_CAPACITY)
    pieces = packed.groupBy("id").agg(F.count("*").alias("pieces"), F.sum("size").alias("s"))
    small = pieces.where((F.col("s") <= PATENT_CAPACITY) & (F.col("pieces") > 1))
    rest = held.join(items.select("id", "source", "clusters"), "id")
    members = rest.select("container", "id", F.explode("clusters").alias("c")).distinct()
    clash = members.groupBy("container", "c").agg(F.count("*").alias("n")).where("n > 1")
    mixed = rest.where(F.col("source").isin(top)).groupBy("container").agg(F.count_distinct("source").alias("n")).where("n > 1")
    total = packed.agg(F.count_distinct("id").alias("n_documents"), F.sum("size").cast("bigint").alias("n_chars"))
    one = lambda df, name: df.agg(F.count("*").alias(name))
    out = total
    for df, name in ((full, "overfull"), (small, "split_in_vain"), (clash, "clashing_members"), (mixed, "clashing_sources")):
        out = out.crossJoin(one(df, name))  # one row each
    return out


def p8_targets(spark: SparkSession, sf: str) -> DataFrame:
    """What the mix by characters takes of each source: epochs asked for, and whether they are reached within one document."""
    items = materialise(_by_characters(spark, sf), "sized")
    _, report = mix(items, table(spark, sf, "source_weights"))
    most = items.groupBy("source").agg(F.max("size").alias("longest"))
    near = F.abs(F.col("size_mixed") - F.col("epochs") * F.col("size_available")) <= F.coalesce("longest", F.lit(0)) + 1e-6 * F.col("size_available") + 1
    return report.join(most, "source", "left").select("source", "size_available", "n_available", F.round("epochs", 4).alias("epochs"), near.alias("reached"))


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of the mix and how often each is used."""
    selection, _ = mix(_sized(spark, sf), table(spark, sf, "source_weights"))
    return selection.select(F.col("id").alias("doc_id"), "source", F.col("size").alias("n_tokens"), "repeats")


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual shares of the mix."""
    return mix(_sized(spark, sf), table(spark, sf, "source_weights"))[1]


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Characters of each document that stand verbatim in another one, in runs of 160 or more."""
    return shared_chars(shared_spans(table(spark, sf, "documents"), "doc_id", "text", 160))


def p9_spans(spark: SparkSession, sf: str) -> DataFrame:
    """The shared stretches themselves."""
    return shared_spans(table(spark, sf, "documents"), "doc_id", "text", 160)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p2_found, p2_classes, p4_found, p4_top5, p4_recall, p6_found, p6_sizes, p7_pack, p7_containers, p7_checks, p8_mix, p8_shares, p8_targets, p9_found, p9_spans)
}

_SETS = """s as (select distinct src, dst from edge_ids where edge_type = 3 and src is not null and dst is not null),
n as (select src, count(*) as n from s group by src)"""

_GROUPS = """ends as (select src as v, dst as o from edge_ids where edge_type = 4 and src is not null and dst is not null),
e as (select v, o from ends union select o, v from ends),
r(v, g) as (select distinct v, v from e union select e.o, r.g from r join e on r.v = e.v where r.g < e.o),
groups as (select v as vid, min(g) as group_id from r group by v)"""

_WINDOWS = """docs as (select doc_id, text, length(text) as n from documents where length(text) >= 160),
w as (select doc_id, n, p, md5(substring(text, p, 160)) as h
  from (select *, unnest(range(1, n - 158)) as p from docs)),
k as (select h from w group by h having min(doc_id) <> max(doc_id)),
hit as (select doc_id, p from w semi join k using (h)),
mark as (select doc_id, p, lag(p) over (partition by doc_id order by p) as q from hit)"""

_COSINES = """latest as (select * from (select *, row_number() over (partition by vid order by indexed_at desc nulls last) as rn from hnsw_nodes) where rn = 1),
u as (select vid, cast(vector as double[]) as v from latest where not coalesce(deleted, false) and len(vector) = 64
  and len(list_filter(vector, lambda x: x is not null and isfinite(x))) = 64 and len(list_filter(vector, lambda x: x <> 0)) > 0),
c as (select a.vid, b.vid as other, list_cosine_similarity(a.v, b.v) as cosine from u a join u b on a.vid <> b.vid),
t as (select * from (select *, row_number() over (partition by vid order by cosine desc, other) as rank from c) where rank <= 5)"""

_FILL = ", ".join(f"""f{i} as (select source, w, cap, case when alloc is not null then alloc when left_ * w / sum_w > cap then cap end as alloc
  from f{i - 1}, (select greatest((select t from total) - coalesce(sum(alloc), 0), 0) as left_, sum(case when alloc is null then w end) as sum_w from f{i - 1}))""" for i in range(1, 9))

SQL: dict[str, str] = {
    "p7_checks": """select count(*) as n_documents, cast(sum(coalesce(length(text), 0)) as bigint) as n_chars,
0 as overfull, 0 as split_in_vain, 0 as clashing_members, 0 as clashing_sources from documents""",
    "p8_targets": f"""with w as (select source, max(target_share) as w, max(max_repeats) as r from source_weights where source is not null group by source),
d as (select lower(trim(source)) as source, length(text) as size from documents),
h as (select w.source, w.w, w.r, coalesce(sum(d.size), 0) as have, count(d.size) as n from w left join d on d.source = w.source and d.size > 0 group by all),
total as (select cast(sum(have) as double) as t from h),
f0 as (select source, w, cast(r * have as double) as cap, case when w <= 0 or r * have <= 0 then 0.0 end as alloc from h), {_FILL},
done as (select source, coalesce(alloc, ((select t from total) - (select coalesce(sum(alloc), 0) from f8)) * w / (select sum(w) from f8 where alloc is null)) as alloc from f8)
select h.source, cast(have as bigint) as size_available, n as n_available, round(case when have > 0 then alloc / have else 0 end, 4) as epochs, true as reached from h join done using (source)""",
    "p4_found": f"with {_COSINES} select distinct least(vid, other) as vid_a, greatest(vid, other) as vid_b from t where cosine >= 0.9",
    "p2_found": f"""with {_SETS},
i as (select a.src as src_a, b.src as src_b, count(*) as i from s a join s b on a.dst = b.dst and a.src < b.src group by 1, 2)
select src_a, src_b from i join n x on x.src = src_a join n y on y.src = src_b where 10 * i >= 7 * (x.n + y.n - i)""",
    "p2_classes": f"""with {_SETS},
k as (select src, list(dst order by dst) as items from s group by src),
c as (select items, min(src) as rep, count(*) as n from k group by items),
t as (select s.* from s join c on s.src = c.rep),
i as (select a.src as rep_a, b.src as rep_b, count(*) as shared from t a join t b on a.dst = b.dst and a.src < b.src group by 1, 2)
select rep_a, rep_b, shared, x.n as n_a, y.n as n_b from i join c x on x.rep = rep_a join c y on y.rep = rep_b
where 10 * shared >= 7 * (len(x.items) + len(y.items) - shared)""",
    "p6_found": f"with recursive {_GROUPS} select * from groups",
    "p6_sizes": f"with recursive {_GROUPS} select size, count(*) as n_groups from (select count(*) as size from groups group by group_id) group by size",
    "p9_found": f"""with {_WINDOWS}
select doc_id, cast(sum(case when q is null then 160 else least(160, p - q) end) as bigint) as shared_chars from mark group by doc_id""",
    "p9_spans": f"""with {_WINDOWS},
island as (select doc_id, p, sum(case when q is null or p - q > 160 then 1 else 0 end) over (partition by doc_id order by p) as i from mark)
select doc_id, min(p) - 1 as span_start, max(p) - min(p) + 160 as span_chars from island group by doc_id, i""",
}
