import random
from collections import defaultdict
from datetime import datetime

from pyspark.sql import functions as F

from graphloom.operators.heavykeys import key_counts
from graphloom.operators.orphans import OrphanLedger, parents, references
from graphloom.queries_data import p5_degrees, p5_found
from graphloom.streaming.changefeed import ChangeFeed, arriving, replay
from tests.conftest import rows

FEED = "src bigint, dst bigint, version bigint, pos int, dead boolean, weight double, _state string, batch string"


def _feed(seed, n=400):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        v = r.choice([None, *range(30)])
        out.append((r.choice([None, 1, 1, 1, 2, 3]), r.choice([None, 5, 6]), v, r.randrange(3), r.choice([None, True, False]), r.choice([None, float("nan"), 1.5]), "x", "y"))
    return out + out[: n // 4]


def test_change_feed_equals_last_change_in_any_order_and_batching(spark, tmp_path):
    changes = _feed(1)
    best = {}
    for src, dst, v, pos, dead, w, *_ in changes:
        if v is None or dst is None:
            continue
        key = (v, pos, bool(dead))
        if (src, dst) not in best or key > best[src, dst]:
            best[src, dst] = key
    want = sorted(((s, d, k[0]) for (s, d), k in best.items() if not k[2]), key=repr)
    feed = ChangeFeed(["src", "dst"], ["version", "pos"], "dead", ["weight"], required=["dst"])
    for files in (None, 1):
        random.Random(2).shuffle(changes)
        path = str(tmp_path / f"feed{files}")
        spark.createDataFrame(changes, FEED).repartition(3).write.parquet(path)
        got = replay(spark, path, feed, files)
        assert rows(got.select("src", "dst", "version")) == want


def test_change_feed_goes_on_where_it_ended(spark, tmp_path):
    path, out, state = (str(tmp_path / x) for x in ("feed", "out", "state"))
    feed = ChangeFeed(["src"], ["version"], "dead", required=[])
    schema = spark.createDataFrame([], FEED).schema
    spark.createDataFrame([(1, 1, 5, 0, False, None, "", ""), (2, 1, 1, 0, False, None, "", "")], FEED).write.parquet(path)
    done = feed.run(spark, path, schema, out, state)
    spark.createDataFrame([(1, 1, 4, 0, True, None, "", ""), (2, 1, 2, 0, True, None, "", "")], FEED).write.mode("append").parquet(path)
    done += feed.run(spark, path, schema, out, state)
    assert len(done) == 2 and rows(feed.current(spark, out, schema)) == [(1, 5)]  # the late deletion is older, the other newer
    for version, dead in ((6, True), (7, False), (8, True), (7, True)):
        spark.createDataFrame([(1, 1, version, 0, dead, None, "", "")], FEED).write.mode("append").parquet(path)
        feed.run(spark, path, schema, out, state, merge_after=3)
        again = ChangeFeed(["src"], ["version"], "dead", required=[])  # a reader that knows nothing of earlier runs
        assert rows(again.current(spark, out, schema)) == ([] if dead else [(1, version)])
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["base=5"]
    feed.merge(spark, out, schema)
    assert rows(feed.current(spark, out, schema)) == []


def test_a_table_of_changes_comes_in_batches(spark, tmp_path):
    changes = spark.createDataFrame(_feed(4), FEED).withColumn("arrived", F.rand(1))
    feed = ChangeFeed(["src", "dst"], ["version", "pos"], "dead", ["weight"], required=["dst"])
    path, files = arriving(changes, feed, "arrived", 4)
    changes.select("src", "dst", "version", "pos", "dead", "weight").write.parquet(str(tmp_path / "whole"))
    out = [str(tmp_path / x) for x in ("out", "state")]
    assert len(feed.run(spark, path, spark.read.parquet(path).schema, *out, files)) == 4
    assert repr(rows(feed.current(spark, out[0], spark.read.parquet(path).schema))) == repr(rows(replay(spark, str(tmp_path / "whole"), feed)))


def test_change_feed_empty(spark, tmp_path):
    path = str(tmp_path / "feed")
    spark.createDataFrame([], FEED).write.parquet(path)
    assert replay(spark, path, ChangeFeed(["src"], ["version"], "dead")).count() == 0


def test_heavy_keys_equal_a_plain_count(spark):
    r = random.Random(3)
    data = [(7 if r.random() < 0.4 else r.randrange(40), 9 if r.random() < 0.5 else r.randrange(6), r.randrange(3)) for _ in range(5000)]
    data += [(None, 1, 1), (1, None, 1), (50, 1, 1)] + [(60, 1, 1)] * 1500
    df = spark.createDataFrame(data, "k bigint, a int, b bigint").withColumn("pos", F.lit("clash"))
    n, ids = defaultdict(int), defaultdict(set)
    for k, a, b in data:
        if None not in (k, a, b):
            n[k] += 1
            ids[k].add((a, b))
    want = sorted((k, n[k], len(ids[k])) for k in n)
    for parts in (1, 4, 13):
        assert rows(key_counts(df.repartition(5), ["k"], ["a", "b"], parts)) == sorted(want, key=repr)
    assert key_counts(df.limit(0), ["k"]).count() == 0


def test_edges_without_type_or_rank_count_in_the_degree(spark, tmp_path):
    r = random.Random(5)
    data = [(r.choice([None, 1, 1, 2]), r.choice([None, 0, 1]), r.choice([None, 0, 3]), r.choice([None, 8, 9])) for _ in range(600)]
    spark.createDataFrame(data, "src bigint, edge_type int, edge_rank bigint, dst bigint").write.parquet(str(tmp_path / "edge_ids.parquet"))
    whole = [d for d in data if None not in (d[0], d[3])]
    degrees = {s: len({d for d in whole if d[0] == s}) for s in (1, 2)}
    assert rows(p5_degrees(spark, str(tmp_path))) == [(s, sum(d[0] == s for d in whole), degrees[s]) for s in (1, 2)]
    assert rows(p5_found(spark, str(tmp_path))) == sorted(degrees.items())


def _t(day):
    return None if day is None else datetime(2024, 1, day)


def _brute_orphans(refs, parents_):
    """Orphans of (record, key, at) by the last (seen, born, gone) of each parent key."""
    last = {}
    for key, born, gone, seen in parents_:
        if key is not None and (key not in last or (seen, born or 0, gone or 0) > last[key]):
            last[key] = (seen, born or 0, gone or 0)
    out = set()
    for no, key, at in refs:
        if key is None:
            continue
        if key not in last:
            out.add((no, key, "missing"))
        elif last[key][2] and last[key][2] <= at:
            out.add((no, key, "deleted"))
        elif last[key][1] > at:
            out.add((no, key, "late"))
    return out


def test_orphans_equal_brute_force_after_every_batch(spark):
    r = random.Random(8)
    ledger = OrphanLedger(spark, buckets=4, merge_after=2)
    refs, parents_ = [], []
    vert = "vid bigint, born timestamp_ntz, gone timestamp_ntz, seen timestamp_ntz"
    for batch in range(5):
        new_refs = [(no, r.choice([None, 1, 1, 1, *range(2, 30)]), r.randrange(1, 28)) for no in range(batch * 40, batch * 40 + 40)]
        new_refs += refs[:10]  # delivered again
        came = [(r.choice([None, *range(1, 40)]), r.randrange(1, 28), r.choice([None, None, r.randrange(1, 28)]), r.randrange(1, 28)) for _ in range(15 if batch != 3 else 0)]
        refs, parents_ = refs + new_refs, parents_ + came
        ledger.advance(
            references(spark.createDataFrame([(a, b, _t(c)) for a, b, c in new_refs], "no bigint, dst bigint, at timestamp_ntz"), 1, "e", "dst", "no", "at"),
            parents(spark.createDataFrame([(a, _t(b), _t(c), _t(d)) for a, b, c, d in came], vert), 1, "vid", "born", "gone", "seen"),
        )
        want = _brute_orphans(refs, parents_)
        assert {(x.rec_key, x.ref_key, x.reason) for x in ledger.open().collect()} == want
        assert ledger.history().where(F.col("v") == batch + 1).agg(F.coalesce(F.sum("n_open"), F.lit(0))).first()[0] == len(want)


def test_the_last_state_of_a_record_decides(spark):
    ledger = OrphanLedger(spark)
    labels = parents(spark.createDataFrame([(7, _t(1), None)], "id bigint, born timestamp_ntz, gone timestamp_ntz"), 2, "id", "born", "gone")
    none = spark.createDataFrame([], "id bigint, born timestamp_ntz, gone timestamp_ntz")
    state = lambda *r: references(spark.createDataFrame([(a, b, _t(5), _t(c)) for a, b, c in r], "vid bigint, label bigint, at timestamp_ntz, seen timestamp_ntz"), 2, "v", "label", "vid", "at", "seen", True)
    ledger.advance(state((1, 9, 2), (2, 7, 2), (3, 9, 4)), labels)
    ledger.advance(state((1, 7, 3), (2, 8, 1), (3, None, 5)), parents(none, 2, "id", "born", "gone"))
    assert ledger.open().count() == 0
    ledger.advance(state((1, 9, 9)), parents(none, 2, "id", "born", "gone"))
    assert [(x.rec_key, x.reason) for x in ledger.open().collect()] == [(1, "missing")]


def test_orphans_arrive_resolve_and_reopen(spark):
    vert = "vid bigint, born timestamp_ntz, gone timestamp_ntz, seen timestamp_ntz, kind string"
    refs = "no bigint, dst bigint, at timestamp_ntz, seen timestamp_ntz, reason string"
    def v(*r):
        return parents(spark.createDataFrame([(a, _t(b), _t(c), _t(d), "z") for a, b, c, d in r], vert), 1, "vid", "born", "gone", "seen")

    def e(*r):
        return references(spark.createDataFrame([(a, b, _t(c), _t(d), "z") for a, b, c, d in r], refs), 1, "e", "dst", "no", "at", "seen")

    ledger = OrphanLedger(spark)
    ledger.advance(e((1, 10, 5, 5), (1, 10, 5, 6), (2, 11, 5, 5), (3, None, 5, 5), (4, 12, None, 5)), v((10, 1, None, 1), (None, 1, None, 1)))
    assert [(r.rec_key, r.reason) for r in ledger.open().orderBy("rec_key").collect()] == [(2, "missing"), (4, "missing")]
    ledger.advance(e(), v((11, 1, None, 7), (12, 1, None, 7)))  # arriving parents resolve
    assert ledger.open().count() == 0
    ledger.advance(e((5, 11, 2, 8)), v((11, 3, None, 8), (10, 1, 4, 9)))  # a new state moves the birth, a deletion reopens
    assert sorted((r.rec_key, r.reason) for r in ledger.open().collect()) == [(1, "deleted"), (5, "late")]
    ledger.advance(e(), v((10, 1, None, 2)))  # an older state that comes late changes nothing
    assert sorted((r.rec_key, r.reason) for r in ledger.open().collect()) == [(1, "deleted"), (5, "late")]
    last = ledger.history().where(F.col("v") == 4)
    assert last.agg(F.sum("n_open")).first()[0] == 2
