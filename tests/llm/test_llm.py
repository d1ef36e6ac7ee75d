import random
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import spans
from graphloom.llm.components import group_ids, split_hubs
from graphloom.llm.mixing import mix, water_fill
from graphloom.llm.packing import best_fit, containers, pack
from graphloom.llm.setjoin import join_part, occurrences, similar_classes, similar_pairs, similar_sets, value_sets
from graphloom.llm.spans import shared_chars, shared_spans
from graphloom.llm.tokens import count_tokens
from graphloom.llm.vectors import encode, fit, nearest, recall, usable_vectors
from tests.conftest import rows


def test_occurrences_equal_counting():
    r = random.Random(1)
    for _ in range(300):
        lists = [sorted(r.sample(range(60), r.randrange(0, 40))) for _ in range(r.randrange(1, 9))]
        t, low = r.randrange(1, 6), r.randrange(0, 20)
        counts = defaultdict(int)
        for x in lists:
            for v in x:
                counts[v] += v >= low
        assert occurrences(lists, low, t) == sorted((v, n) for v, n in counts.items() if n >= t)


def test_two_sided_part_joins_across_only():
    found = join_part([1, 2, 3], [1, 1, 2], [[1, 2, 3], [1, 2, 3], [1, 2, 3]], 7, 10)
    assert sorted(found) == [(1, 3, 3), (2, 3, 3)]


@pytest.mark.parametrize(("block", "threshold"), [(3, 0.7), (2000, 0.7), (4, 0.5), (2000, 0.5), (3, 0.95), (2000, 1.0)])
def test_set_join_equals_brute_force(spark, block, threshold):
    r = random.Random(4)
    sets = {i: set(r.sample(range(25), r.randrange(1, 9))) for i in range(120)}
    sets |= {200 + i: set(sets[i % 7]) for i in range(30)} | {300: set(range(400)), 301: {7001, 7002}, 302: {7001, 7002, 7003, 7004}}
    sets |= {400 + i: {1, 2, 3, 4, 5, 100 + i} for i in range(20)}
    data = [(a, v, "x") for a, s in sets.items() for v in s] * 2 + [(None, 1, "x"), (1, None, "x"), (999, None, "x")]
    df = spark.createDataFrame(data, "src bigint, dst bigint, items string")
    least = int(threshold * 100)
    want = sorted((a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]))
    for small in (3, 1000):
        pairs = similar_pairs(*similar_sets(df, "src", "dst", threshold, block), small)
        assert sorted(map(tuple, pairs.collect())) == want
    assert similar_pairs(*similar_sets(df.limit(0), "src", "dst", threshold)).count() == 0


def test_sets_are_whole_without_a_threshold(spark):
    df = spark.createDataFrame([(1, v) for v in (1, 2)] + [(2, v) for v in (1, 2, 3, 4)], "src bigint, dst bigint")
    assert value_sets(df, "src", "dst").count() == 2
    assert rows(similar_classes(value_sets(df, "src", "dst"), 0.5)[1]) == [(1, 2, 2)]


def test_groups_equal_union_find(spark):
    r = random.Random(5)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(500, 500)]
    pairs += [(900, 901 + i) for i in range(50)] + pairs[:20]
    root = {v: v for p in pairs for v in p}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(a, b, 1) for a, b in pairs] + [(None, 3, 1), (4000, None, 1)], "src bigint, dst bigint, v int")
    for hub in (20_000, 5):
        assert sorted(map(tuple, group_ids(df, "src", "dst", hub=hub).collect())) == sorted((v, find(v)) for v in root)
    assert group_ids(df.limit(0), "src", "dst").count() == 0


def test_hubs_are_split(spark):
    pairs = [(7, i) for i in range(100, 700)] + [(i, 7) for i in range(700, 1000)] + [(7, 7), (5, 6)]
    both = spark.createDataFrame(pairs, "v bigint, o bigint")
    both = both.unionByName(both.select(F.col("o").alias("v"), F.col("v").alias("o"))).distinct()
    edges, added = split_hubs(both, 50)
    degree = {r["v"]: r["n"] for r in edges.groupBy("v").agg(F.count("*").alias("n")).collect()}
    assert added == 1000 and max(degree.values()) < 120 and sum(degree.values()) >= 2 * 900
    assert set(map(tuple, group_ids(spark.createDataFrame(pairs, "v bigint, o bigint"), "v", "o", hub=50).collect())) == {(i, 7) for i in (7, *range(100, 1000))} | {(5, 5), (6, 5)}


def test_vectors_reach_the_recall(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 64))
    x = np.concatenate([centres[i % 12] + 0.4 * rng.normal(size=64) for i in range(900)]).reshape(-1, 64)
    x = np.concatenate([x, np.tile(x[:1], (300, 1))])  # a group of copies
    data = [(i, v.tolist(), False, i, 1.0) for i, v in enumerate(x)]
    data += [(0, x[5].tolist(), False, -1, 0.0), (2000, [0.0] * 64, False, 0, 0.0), (2001, [float("nan")] * 64, False, 0, 0.0), (2002, [1.0] * 63, False, 0, 0.0), (2003, None, False, 0, None), (2004, x[3].tolist(), True, 0, 0.0), (None, x[3].tolist(), False, 0, 0.0)]
    nodes = spark.createDataFrame(data, "vid bigint, vector array<float>, deleted boolean, indexed_at bigint, norm double")
    got = nearest(usable_vectors(nodes), k=5, unit=200).toPandas()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    fifth = np.sort(s, axis=1)[:, -5]
    good = sum(s[a, b] >= fifth[a] - 1e-6 for a, b in zip(got.vid, got.other))
    assert set(got.vid) == set(range(len(x))) and good >= 0.9 * 5 * len(x)
    assert nearest(usable_vectors(nodes.limit(0))).count() == 0


@pytest.mark.parametrize("noise", [0.3, 1e-3])
def test_vectors_are_exact_inside_a_dense_group(spark, noise):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(2400, 64))
    x[::3] = x[0] + noise * rng.normal(size=(800, 64))  # a third are near copies
    x[1:60:3] = x[1]  # twenty equal vectors
    x[4] = x[1] * 2
    x = x.astype(np.float32)
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vid bigint, vector array<float>")
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    top = np.lexsort((np.tile(np.arange(len(x)), (len(x), 1)), -s.round(13)), axis=1)[:, :5]
    want = {(a, b) for a in range(len(x)) for b in top[a].tolist()}
    for unit, coarse in ((8192, 4096), (200, 4096), (300, 2)):
        got = nearest(nodes, k=5, unit=unit, max_coarse=coarse, cell_size=64, probes=4, exact=True).toPandas()
        assert len(got) == 5 * len(x) and set(zip(got.vid, got.other)) == want
    # few cells are visited, but dense groups are searched through
    got = nearest(nodes, k=5, least=0.9, cell_size=64, probes=4, dense=0.9).toPandas()
    assert set(zip(got.vid, got.other)) == {(a, b) for a, b in want if s[a, b] >= 0.9}


def test_recall_is_measured_against_brute_force(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(40, 64))[np.arange(1500) % 40] + 0.5 * rng.normal(size=(1500, 64))
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vid bigint, vector array<float>")
    asked = nodes.where("vid % 20 = 0")
    row = recall(nodes, nearest(nodes, k=5, exact=True), asked, block=30).first()
    assert (row["n_queries"], row["n_true"], row["n_found"]) == (75, 375, 375)
    assert recall(nodes, nearest(nodes, k=5, max_coarse=4, cell_size=64), asked).first()["recall"] >= 0.9
    assert recall(nodes, nearest(nodes, k=5), asked.limit(0)).first()["n_queries"] == 0


def test_beam_encoding_is_no_worse_than_greedy():
    x = np.random.default_rng(7).normal(size=(500, 16)).astype(np.float32)
    books = fit(x, 8, levels=3, codewords=16)
    errors = [float(((x - encode(x, books, beam)[2]) ** 2).sum()) for beam in (1, 8)]
    assert errors[1] <= errors[0]


def test_best_fit_keeps_capacity_and_conflicts():
    r = random.Random(8)
    sizes = [r.randrange(1, 100) for _ in range(500)]
    clusters = [[r.randrange(80)] for _ in sizes]
    sources = [r.choice("abc") for _ in sizes]
    home, fill = best_fit(sizes, sources, clusters, 100, [("a", "b")])
    bins = defaultdict(list)
    for i, b in enumerate(home):
        bins[b].append(i)
    for b, own in bins.items():
        assert sum(sizes[i] for i in own) == fill[b] <= 100
        assert len({clusters[i][0] for i in own}) == len(own) and not {"a", "b"} <= {sources[i] for i in own}


def test_packing_is_whole(spark):
    r = random.Random(9)
    data = [(i, r.choice([None, 0, 5, 30, 70, 99, 100, 101, 350]), r.choice([None, "s"]), [1] if i % 3 == 0 else [i], "x") for i in range(600)]
    items = spark.createDataFrame(data, "id bigint, size bigint, source string, clusters array<bigint>, container string")
    for shard in (100, 10_000):
        packed = pack(items, 100, shard_items=shard)
        got = packed.collect()
        total = defaultdict(int)
        bins = defaultdict(list)
        for p in got:
            total[p["id"]] += p["size"]
            if p["container"]:
                bins[p["container"]].append(p)
        assert total == {d[0]: d[1] or 0 for d in data}
        assert all(sum(p["size"] for p in b) <= 100 for b in bins.values())
        assert all(len({p["id"] for p in b if p["id"] % 3 == 0}) <= 1 for b in bins.values())
        pieces = defaultdict(int)
        for p in got:
            pieces[p["id"]] += 1
        assert all(n == 1 for i, n in pieces.items() if (data[i][1] or 0) <= 100)
    assert pack(items.limit(0), 100).count() == 0
    assert containers(pack(items, 100), 100).first()["most"] == 100


def test_water_filling():
    assert water_fill({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 10, "b": 100, "c": 100}, 100) == pytest.approx({"a": 10, "b": 54, "c": 36})
    assert water_fill({"a": 1.0, "b": 0.0}, {"a": 5, "b": 5}, 100) == {"a": 5, "b": 0}


def test_mix_reaches_the_shares(spark):
    r = random.Random(10)
    data = [(i, "big" if i % 3 else r.choice(["mid", "tiny", None, "other"]), r.randrange(0, 200), 1) for i in range(4000)]
    items = spark.createDataFrame(data, "id bigint, source string, size bigint, repeats int")
    weights = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.4, 4), ("tiny", 0.1, 2), ("none", 0.2, 3), (None, 0.3, 1), ("bad", None, None)], "source string, target_share double, max_repeats int")
    selection, report = mix(items, weights, total=150_000)
    out = {x["source"]: x for x in report.collect()}
    assert set(out) == {"big", "mid", "tiny", "none", "bad"} and out["none"]["size_mixed"] == 0
    mixed = sum(x["size_mixed"] for x in out.values())
    for s in ("big", "mid", "tiny"):
        cap = out[s]["max_repeats"] * out[s]["size_available"]
        assert out[s]["size_mixed"] == pytest.approx(min(cap, 150_000 * out[s]["target_share"]), abs=200) and out[s]["most_repeats"] <= out[s]["max_repeats"]
    assert selection.agg(F.sum(F.col("size") * F.col("repeats"))).first()[0] == mixed
    assert rows(selection) == rows(mix(items, weights, total=150_000)[0])
    assert mix(items.limit(0), weights)[0].count() == 0


def _brute(texts, n):
    seen = defaultdict(set)
    for i, t in texts:
        for p in range(len(t or "") - n + 1):
            seen[t[p : p + n]].add(i)
    out = {}
    for i, t in texts:
        marks = set()
        for p in range(len(t or "") - n + 1):
            if len(seen[t[p : p + n]]) > 1:
                marks |= set(range(p, p + n))
        if marks:
            out[i] = len(marks)
    return out


@pytest.mark.parametrize(("length", "heavy"), [(7, 300_000), (40, 300_000), (7, 2), (40, 30)])
def test_shared_spans_equal_brute_force(spark, length, heavy):
    r = random.Random(11)
    alphabet = "abcdé中😀 \n"
    base = ["".join(r.choice(alphabet) for _ in range(r.randrange(30, 300))) for _ in range(12)]
    texts = []
    for i in range(60):
        a, b = r.choice(base), r.choice(base)
        texts.append((i, a[r.randrange(len(a)) :] + "".join(r.choice(alphabet) for _ in range(20)) + b[: r.randrange(len(b))]))
    texts += [(100, None), (101, ""), (102, "a" * 500), (103, "short"), (104, base[0]), (105, base[0]), (106, base[0])]
    texts += [(107, base[1] * 200)]
    df = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id bigint, text string, a int")
    assert dict(map(tuple, shared_chars(shared_spans(df, "doc_id", "text", length, heavy)).collect())) == _brute(texts, length)
    assert shared_spans(df.limit(0), "doc_id", "text").count() == 0


def test_windows_of_one_hash_are_compared(spark):
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, word), (2, other), (3, word[:1000] + "x" + word)], "doc_id bigint, text string")
    assert rows(shared_spans(df, "doc_id", "text", 1024)) == [(1, 0, 1024), (3, 1001, 1024)]


def test_a_heavy_minimiser_is_spread_over_buckets(monkeypatch):
    r = random.Random(12)
    passage = "".join(r.choice("abcdefgh ") for _ in range(400))
    noise = lambda: "".join(r.choice("abcdefgh ") for _ in range(300))
    texts = [noise() + passage + noise() for _ in range(600)]
    batch = [pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])]

    class Lots:
        value = (spans._NONE, spans._NONE)

    def windows_per_key(lots):
        load = defaultdict(int)
        for _, _, part in spans._chunks(iter(batch), 160):
            joined, _, at, n, key, _ = spans._runs(part, 160, *lots)
            distinct = {(k, joined[a : a + m + 159]): m for k, a, m in zip(key.tolist(), at.tolist(), n.tolist())}
            for (k, _), m in distinct.items():
                load[k] += m
        return load

    def beyond(counts, least):
        table = pa.Table.from_batches(counts).group_by("v").aggregate([("n", "sum")]).to_pydict()
        return np.sort(np.array([v for v, n in zip(table["v"], table["n_sum"]) if n > least and v != -1], np.int64).view(np.uint64))

    class First:
        value = (beyond(spans._count(iter(batch), 160), 2000),)

    far = beyond(spans._count_steps(iter(batch), 160, First), 2000)
    loads = [max(windows_per_key(lots).values()) for lots in (Lots.value, First.value, (*First.value, far))]
    assert len(First.value[0]) and len(far) and loads[0] > 10_000 and loads[0] > loads[1] > 2000 >= loads[2]
    # a text that many records of one flush hold is reported there and sent once
    monkeypatch.setattr(spans, "_FLUSH", 1 << 40)
    whole = [pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64()), pa.array([texts[0]] * 1000)], ["doc_id", "text"])]
    packed = pa.Table.from_batches(spans._pack(iter(whole), 160, 4, Lots))
    assert packed.nbytes < 10_000


def test_passes_over_texts_work_in_arrays_that_fit_a_cache():
    r = random.Random(13)
    texts = ["".join(r.choices("abcdefgh ", k=2000)) for _ in range(800)]
    batch = [pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])]

    class Lots:
        value = (spans._NONE, spans._NONE)

    def most(step):
        list(step())  # tables are made once
        tracemalloc.start()
        list(step())
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return peak

    assert most(lambda: spans._count(iter(batch), 160)) < 8_000_000
    again = [pa.RecordBatch.from_arrays([pa.array(range(900, 900 + len(texts)), pa.int64()), batch[0].column(1)], ["doc_id", "text"])]
    packed = [b for part in (batch, again) for b in spans._pack(iter(part), 160, 1, Lots)]
    assert most(lambda: spans._buckets(iter(packed), 160)) < 60_000_000


def test_a_bucket_gets_few_records_of_a_task():
    r = random.Random(15)
    texts = ["".join(r.choices("abcdefgh ", k=40_000)) for _ in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])

    class Lots:
        value = (spans._NONE, spans._NONE)

    buckets = pa.Table.from_batches(spans._pack(iter([batch]), 160, 64, Lots))["bucket"].to_pylist()
    assert len(set(buckets)) == len(buckets) == 64


@pytest.mark.parametrize("length", [7, 160])
def test_windows_that_have_equals_are_grouped_across_blocks(length):
    r = random.Random(14)
    base = "".join(r.choices("abcdé中😀", k=3000))
    pieces = [base[a : a + r.randrange(length, 900)] for a in (r.randrange(2000) for _ in range(300))]
    counts = [len(p) - length + 1 for p in pieces]
    owner = np.repeat(np.arange(len(pieces)), counts)
    joined = "".join(pieces)
    at = np.arange(len(owner)) + owner * (length - 1)
    assert len(joined) > 2 << 15
    order, starts = spans._groups(spans._points(joined), at, owner, length)
    groups = defaultdict(list)
    for i, a in enumerate(at.tolist()):
        groups[joined[a : a + length]].append(i)
    assert sorted(sorted(g.tolist()) for g in np.split(order, starts[1:])) == sorted(g for g in groups.values() if len(g) > 1)


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|>")], "i int, t string")
    assert [r[1] for r in df.select("i", count_tokens(F.col("t"))).orderBy("i").collect()][:3] == [2, 0, 0]
