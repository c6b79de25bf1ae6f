"""Matrix layers, merged vector states and joins with hubs, against numpy and plain joins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.functions import encode as E
from linkloom.operators import components as C
from linkloom.operators import link as L
from linkloom.operators import matrix as M
from linkloom.operators import propagate as N
from linkloom.operators import skew
from linkloom.plans import fixtures as X
from linkloom.plans import learning


def vectors(spark, x, keys=None):
    keys = range(len(x)) if keys is None else keys
    return spark.createDataFrame([(int(k), None if v is None else [None if e is None else float(e) for e in v]) for k, v in zip(keys, x)], "id long, h array<double>")


def nodes_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("\n")


def collected(df, name="h"):
    return {r["id"]: r[name] for r in df.collect()}


def test_wide_layers_over_all_anchors(spark, tiny):
    """96 to 256 to 256: as numpy has it, with a plan as long as that of width 4."""
    rng = np.random.default_rng(0)
    a = X.anchors(spark, tiny)
    e = a.select(F.col("mh_id").alias("id"), E.position_encoding(F.col("x"), F.col("y"), E.frequencies(16, 1.0, 100.0)).alias("e"))
    layers = [(rng.normal(size=(256, 96)) / 10, rng.normal(size=256), True), (rng.normal(size=(256, 256)) / 16, None, False)]
    got = collected(M.dense_stack(e, ["id"], "e", layers))
    x = collected(e, "e")
    ids = sorted(x)
    want = np.maximum(np.array([x[i] for i in ids]) @ layers[0][0].T + layers[0][1], 0) @ layers[1][0].T
    assert len(ids) == a.count() and np.abs(np.array([got[i] for i in ids]) - want).max() < 1e-9
    small = M.dense_stack(e, ["id"], "e", [(np.ones((4, 96)), None, True), (np.ones((4, 4)), None, False)])
    assert nodes_of(small) == nodes_of(M.dense_stack(e, ["id"], "e", layers))


def test_affine_equals_dense_layer(spark):
    rows = [[1.0, -2.0, 0.5], None, [1.0, None, 2.0], [1.0], [], [0.0, 0.0, 0.0], [-3.0, 1e6, 2.0]]
    w, b = [[1.0, 2.0, 3.0], [0.5, -1.0, 0.0], [0.0, 0.0, 0.0], [-1.0, 1.0, 1.0]], [0.1, 0.0, -0.1, 2.0]
    df = vectors(spark, rows)
    for relu in (True, False):
        got = collected(M.affine(df, ["id"], {"h": w}, "h", b, relu))
        want = collected(df.select("id", E.dense_layer(F.col("h"), w, b, relu).alias("h")))
        assert {k: v is None for k, v in got.items()} == {k: v is None for k, v in want.items()} == {0: False, 1: True, 2: True, 3: True, 4: True, 5: False, 6: False}
        assert all(got[k] == pytest.approx(want[k]) for k in (0, 5, 6))
    assert M.affine(df.limit(0), ["id"], {"h": w}).count() == 0


@pytest.mark.parametrize(("dims", "held"), [(4, 1 << 22), (4, 40), (512, 1 << 22)])
def test_sums_with_a_hub(spark, dims, held):
    """A third of all rows have one key; buffers of ten rows give the same as large ones."""
    rng = np.random.default_rng(1)
    keys = np.where(rng.random(900) < 1 / 3, 7, rng.integers(0, 50, 900))
    x = rng.normal(size=(900, dims))
    df = vectors(spark, [*x, None, [1.0]], [*keys, 7, 7]).repartition(6)
    got = collected(M.merged(df, "id", "h", dims, held=held), "v")
    assert set(got) == set(keys.tolist())
    assert all(np.allclose(got[k], x[keys == k].sum(0)) for k in got)
    means = collected(M.vector_means(df, "id", "h", dims), "v")
    assert all(np.allclose(means[k], x[keys == k].mean(0)) for k in means)


def test_plan_does_not_grow_with_width(spark):
    def plan(dims):
        e = spark.range(3).select(F.col("id").alias("src"), F.col("id").alias("dst"))
        v = spark.range(3).select("id", F.array_repeat(F.lit(1.0), dims).alias("h"))
        w = np.ones((dims, dims))
        return [nodes_of(df) for df in (N.hetero_sum([N.sage(v, e, w, w), N.gat(v, e, w, np.ones(dims), np.ones(dims))], dims),)]

    assert plan(4) == plan(512)


def test_softmax_with_a_hub(spark):
    rng = np.random.default_rng(2)
    keys = np.where(rng.random(600) < 1 / 3, 3, rng.integers(0, 40, 600))
    logit, x = rng.normal(size=600) * 300, rng.normal(size=(600, 3))
    df = spark.createDataFrame([(int(k), float(a), v.tolist()) for k, a, v in zip(keys, logit, x)], "id long, a double, h array<double>").repartition(5)
    got = collected(M.softmax_means(df, "id", "a", "h", 3), "v")
    for k in got:
        a = np.exp(logit[keys == k] - logit[keys == k].max())
        assert np.allclose(got[k], (a[:, None] * x[keys == k]).sum(0) / a.sum())


def test_attention_shuffles_vectors_by_target_once(spark):
    """No join of maxima, and one shuffle after the vectors are there."""
    v = vectors(spark, np.ones((5, 3)))
    e = spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long")
    plan = N.gat(v, e, np.ones((2, 3)), [1.0, 1.0], [1.0, 1.0])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and plan.count("Join") == 3


def test_hub_join_equals_join(spark):
    rng = np.random.default_rng(3)
    keys = np.where(rng.random(3000) < 1 / 3, 5, rng.integers(0, 200, 3000))
    rows = spark.createDataFrame([(int(k), i) for i, k in enumerate(keys)] + [(None, -1)], "u long, i long")
    other = spark.createDataFrame([(k, k * 2) for k in range(150)] + [(5, 99)], "u long, t long")
    want = sorted(map(tuple, rows.join(other, "u").select("u", "i", "t").collect()))
    assert skew.hubs(rows, "u", 100).collect()[0]["u"] == 5 and skew.hubs(rows, "u") is None
    met = skew.hub_join(rows, other, "u", least=50)
    assert sorted(map(tuple, met.select("u", "i", "t").collect())) == want
    # the hub's rows are dealt over several tasks
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        spread = skew.hub_join(rows, other, "u", least=50).where("u = 5").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[1])
    assert len(spread) > 1


def test_link_scores_at_a_hub(spark, monkeypatch):
    """A third of all edges end at one node: the scores are those of a plain join."""
    rng = np.random.default_rng(6)
    h = rng.normal(size=(40, 5))
    edges = [(int(a), 3 if rng.random() < 1 / 3 else int(b)) for a, b in rng.integers(0, 40, (900, 2))]
    e = spark.createDataFrame([(i, a, b, float(a % 2)) for i, (a, b) in enumerate(edges)], "edge long, src long, dst long, label double")
    monkeypatch.setattr(L, "hub_join", lambda *a, **k: skew.hub_join(*a, **(k | {"least": 60})))
    got = {r["edge"]: r["score"] for r in L.score_links(e, vectors(spark, h)).collect()}
    assert len(got) == 900 and all(got[i] == pytest.approx(h[a] @ h[b]) for i, (a, b) in enumerate(edges))


def test_forest_of_many_shapes(spark, parts):
    rng = np.random.default_rng(4)
    n = 2000
    path = rng.permutation(n)
    for u, v in ((path[1:], path[:-1]), (np.arange(1, n), np.zeros(n - 1, int)), (rng.integers(0, n, n // 2), rng.integers(0, n, n // 2))):
        root = C.least_roots(u, v, n)
        parent = list(range(n))

        def find(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for a, b in zip(u.tolist(), v.tolist()):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        assert [find(i) for i in range(n)] == root.tolist()
    names = spark.createDataFrame([("é", "b"), ("b", "zz"), ("q", "r"), (None, "a"), ("s", "s")], "u string, v string")
    assert {tuple(r) for r in C.components(names).collect()} == {("b", "b"), ("é", "b"), ("zz", "b"), ("q", "q"), ("r", "q")}


def test_components_through_hubs(spark, monkeypatch):
    """A star, a chain and pairs, with small buffers, so that rounds meet the hub in slices."""
    for name, value in (("FOREST", 50), ("FILE_ROWS", 100), ("HUB_EDGES", 10)):
        monkeypatch.setattr(C, name, value)
    monkeypatch.setattr(skew, "LEAST", 20)
    monkeypatch.setattr(C, "hub_join", lambda *a, **k: skew.hub_join(*a, **(k | {"least": 20})))
    edges = [(i, 5000) for i in range(1000, 1600)] + [(i, i + 1) for i in range(2000, 2300)] + [(i, i + 10_000) for i in range(100)]
    got = dict(map(tuple, C.components(spark.createDataFrame(edges, "u long, v long").repartition(8)).collect()))
    want = {5000: 1000} | {i: 1000 for i in range(1000, 1600)} | {i: 2000 for i in range(2000, 2301)} | {i: i for i in range(100)} | {i + 10_000: i for i in range(100)}
    assert got == want


def test_anchors_of_wide_layers_are_dealt_to_tasks(spark, tiny, monkeypatch):
    """A file of a few bytes is one task when read; each of its rows becomes 256."""
    monkeypatch.setattr(learning, "WIDE_ROWS", 20, raising=False)
    n = X.anchors(spark, tiny).count()
    out = learning.wide_layers(spark, tiny)
    assert out.rdd.getNumPartitions() == -(-n // 20) > 1 and out.count() == 256 * n
