import random

import pytest
from pyspark.sql import functions as F

from linkloom.functions import geometry as G
from linkloom.operators import components as C
from linkloom.operators import graph as R
from linkloom.operators import ids as I
from linkloom.operators import sampling as S
from linkloom.operators import spatial_join as J
from linkloom.plans import spatial


def union_find(edges, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark, parts):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(i, i + 1) for i in range(300, 360)] + [(5, 5), (7, None)]
    nodes = list(range(400))
    want = union_find([e for e in edges if e[1] is not None], nodes)

    def run():
        e, v = spark.createDataFrame(edges, "u long, v long"), spark.createDataFrame([(n,) for n in nodes], "node_id long")
        return {r["node_id"]: r["component"] for r in C.label_components(v, e).collect()}

    for got in parts(run, (1, 7)):
        assert got == want


def test_no_edges(spark):
    v = spark.createDataFrame([(1,), (2,)], "node_id long")
    got = C.label_components(v, spark.createDataFrame([], "u long, v long"))
    assert sorted((r["node_id"], r["component"]) for r in got.collect()) == [(1, 1), (2, 2)]
    assert C.component_sizes(got).count() == 2


def test_three_anchors_give_three_pairs(spark):
    lines = spark.range(1).select(F.col("id").alias("line_id"), G.line(*((F.lit(float(x)), F.lit(0.0)) for x in (0, 1, 5))).alias("coords"))
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 0.0), (3, 5.0, 0.0), (4, 6.0, 0.0), (5, 3.0, 0.5)], "mh_id long, x double, y double")
    hits = J.points_on_lines(lines, points)
    assert sorted(r["mh_id"] for r in hits.collect()) == [1, 2, 3]
    assert sorted((r["src"], r["dst"]) for r in R.anchor_pairs(hits).collect()) == [(1, 2), (1, 3), (2, 3)]
    along = hits.join(points, "mh_id")
    assert sorted((r["src"], r["dst"]) for r in R.anchor_pairs(along, consecutive_by="x").collect()) == [(1, 2), (2, 3)]
    near = J.points_on_lines(lines, points, tolerance=0.6)
    assert sorted(r["mh_id"] for r in near.collect()) == [1, 2, 3, 5]


def test_spatial_joins_match_brute_force(spark, parts):
    rng = random.Random(2)
    segs = []
    for i in range(120):
        x, y = rng.randrange(30), rng.randrange(30)
        segs.append((i, x, y, x + rng.randrange(-3, 4), y + rng.randrange(-3, 4)))
    segs.append((120, 0, 0, 900, 0))  # a long one
    rows = [(i, [{"x": float(a), "y": float(b)}, {"x": float(c), "y": float(d)}]) for i, a, b, c, d in segs]
    points = [(k, float(k % 30), float(k // 30)) for k in range(900)]

    def o(ax, ay, bx, by, cx, cy):
        v = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
        return (v > 0) - (v < 0)

    def meet(p, q):
        _, a, b, c, d = p
        _, e, f, g, h = q
        boxes = min(a, c) <= max(e, g) and min(e, g) <= max(a, c) and min(b, d) <= max(f, h) and min(f, h) <= max(b, d)
        return boxes and o(a, b, c, d, e, f) * o(a, b, c, d, g, h) <= 0 and o(e, f, g, h, a, b) * o(e, f, g, h, c, d) <= 0

    want_pairs = {(p[0], q[0]) for p in segs for q in segs if p[0] != q[0] and meet(p, q)}
    want_hits = {(s[0], k) for s in segs for k, x, y in points if meet(s, (k, x, y, x, y))}
    lines = spark.createDataFrame(rows, "line_id long, coords array<struct<x:double,y:double>>")
    spots = spark.createDataFrame(points, "mh_id long, x double, y double")
    for got in parts(lambda: {tuple(r) for r in J.lines_meeting(lines).collect()}):
        assert got == want_pairs
    assert {tuple(r) for r in J.points_on_lines(lines, spots, cell=0.7).collect()} == want_hits


def test_layer_cleaning(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "id long, m string")
    b = spark.createDataFrame([(3, "o"), (3, "o")], "id long, owner string")
    both = R.union_layers(a, R.drop_duplicate_rows(b))
    assert both.count() == 3 and both.where("id = 3").first()["m"] is None
    assert R.drop_any_null(both).count() == 0  # a column that one layer lacks removes every row
    assert R.drop_any_null(a).count() == 1
    cat = spark.createDataFrame([(None, "U"), ("1", "U"), ("1", None)], "s string, u string").select(R.composite_category(F.col("s"), F.col("u")).alias("c"))
    assert [r["c"] for r in cat.collect()] == ["nanU", "1U", None]


def test_dense_ids_and_sums(spark, parts):
    rows = spark.createDataFrame([(i * 37 % 101,) for i in range(101)], "k long")

    def run():
        return [(r["k"], r["id"], r["s"]) for r in I.running(I.dense_id(rows, ["k"]), ["k"], {"s": F.col("k")}).orderBy("k").collect()]

    want = [(k, k, k * (k + 1) // 2) for k in range(101)]
    assert all(got == want for got in parts(run))
    assert I.dense_id(rows.limit(0), ["k"]).count() == 0


def test_relabel_and_membership(spark):
    edges = spark.createDataFrame([(10, 20), (20, 30), (40, 50)], "src long, dst long")
    mapping = spark.createDataFrame([(10, 0), (20, 1)], "old long, new long")
    got = I.relabel(I.relabel(edges, "src", mapping), "dst", mapping)
    assert sorted(((r["src"], r["dst"]) for r in got.collect()), key=str) == sorted([(0, 1), (1, None), (None, None)], key=str)
    ids = spark.createDataFrame([(10,), (20,), (10,)], "n long")
    assert {tuple(r) for r in R.either_end_in(edges, ids, "n").collect()} == {(10, 20), (20, 30)}
    assert R.both_ends_in(edges, ids, "n").count() == 1
    assert R.symmetric(edges).count() == 6
    assert R.without_self_loops(spark.createDataFrame([(1, 1), (1, 2)], "src long, dst long")).count() == 1


def test_ratio_split_of_eleven(spark, parts):
    comps = spark.createDataFrame([(i,) for i in range(11)], "component long")

    def run():
        rows = S.ratio_split(comps, seed=3).collect()
        return sorted((r["component"], r["split"]) for r in rows)

    got = parts(run)
    assert got[0] == got[1] == got[2]
    sizes = {s: sum(x == s for _, x in got[0]) for s in ("train", "val", "test")}
    assert sizes == {"train": 6, "val": 2, "test": 3}
    assert S.ratio_split(comps, seed=4).collect() != S.ratio_split(comps, seed=3).collect()
    assert S.ratio_split(comps.limit(0)).count() == 0


@pytest.mark.parametrize("n", [60, 8])  # sparse, and dense (the complement is enumerated)
def test_negative_edges(spark, n):
    rng = random.Random(n)
    pos = {(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(25)) if a != b}
    df = spark.createDataFrame(sorted(pos), "src long, dst long")
    got = [(r["src"], r["dst"]) for r in S.negative_edges(df, n, seed=1).collect()]
    both = pos | {(b, a) for a, b in pos}
    assert len(set(got)) == len(got) == min(len(pos), n * (n - 1) - len(both))
    assert not set(got) & both and all(a != b and 0 <= a < n and 0 <= b < n for a, b in got)
    one_way = {(r["src"], r["dst"]) for r in S.negative_edges(df, n, seed=1, directed=True).collect()}
    assert not one_way & pos


def test_batches_and_fan_out(spark, parts):
    edges = spark.createDataFrame([(i % 9, i % 5) for i in range(100)], "src long, dst long")
    b = S.mini_batches(edges, 30, ["src", "dst"])
    assert [r["count"] for r in b.groupBy("batch_id").count().orderBy("batch_id").collect()] == [30, 30, 30, 10]
    assert S.mini_batches(edges, 30, ["src", "dst"], seed=1, max_batches=2).count() == 60
    rel = edges.select(F.lit("link").alias("rel"), "src", "dst")
    seeds = spark.createDataFrame([(0, 1), (0, 2), (1, 3)], "batch_id long, node long")

    def run():
        return sorted(map(tuple, S.sample_neighbours(seeds, rel, (4, 2)).collect()))

    got = parts(run)
    assert got[0] == got[1] == got[2]
    for hop, k in ((1, 4), (2, 2)):
        seen = {}
        for batch, h, _, _, dst in got[0]:
            if h == hop:
                seen[batch, dst] = seen.get((batch, dst), 0) + 1
        assert seen and max(seen.values()) <= k


def test_split_statistics_with_an_empty_split(spark):
    nodes = spark.createDataFrame([(1, "train"), (2, "val")], "n long, split string")
    edges = spark.createDataFrame([(1, 2, "train")], "src long, dst long, split string")
    got = {r["split"]: (r["n_nodes"], r["n_edges"]) for r in R.split_statistics({"nodes": nodes, "edges": edges}).collect()}
    assert got == {"train": (1, 1), "val": (1, 0)}


@pytest.mark.parametrize("query", ["exported_lines", "supervised_edges", "split_labelled_edges", "split_graph_edges"])
def test_a_query_joins_lines_and_anchors_once(spark, tiny, monkeypatch, query):
    calls = []
    join = J.points_on_lines
    monkeypatch.setattr(J, "points_on_lines", lambda *a, **k: calls.append(1) or join(*a, **k))
    spatial.QUERIES[query][0](spark, tiny)
    assert len(calls) == 1
