import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.functions import encode as E
from linkloom.operators import experiments as P
from linkloom.operators import link as L
from linkloom.operators import metrics as M
from linkloom.operators import model as W
from linkloom.operators import propagate as N


def scored(spark, scores, labels):
    return spark.createDataFrame([(float(s), float(y)) for s, y in zip(scores, labels, strict=True)], "score double, label double")


def test_perfect_separation(spark):
    m = M.binary_metrics(scored(spark, (0.9, 0.8, 0.1, 0.2), (1, 1, 0, 0))).first()
    assert all(m[k] == 1.0 for k in M.METRICS)


def test_one_class_has_no_auc(spark):
    m = M.binary_metrics(scored(spark, (0.4, 0.6, 0.7), (1, 1, 1))).first()
    assert math.isnan(m["auc"]) and m["mcc"] == 0 and m["recall"] == pytest.approx(2 / 3)


def test_no_rows_are_an_error(spark):
    with pytest.raises(Exception, match="no scored rows"):
        M.binary_metrics(scored(spark, (), ())).collect()


def test_auc_with_ties(spark, parts):
    rng = np.random.default_rng(0)
    s, y = np.round(rng.random(300), 1), rng.integers(0, 2, 300)
    wins = (s[y == 1][:, None] > s[y == 0][None]).sum() + 0.5 * (s[y == 1][:, None] == s[y == 0][None]).sum()
    want = wins / (y == 1).sum() / (y == 0).sum()
    df = scored(spark, s, y)
    for got in parts(lambda: M.binary_metrics(df).first()["auc"]):
        assert got == pytest.approx(want, abs=1e-12)
    last = M.roc_points(df).orderBy("score").first()
    assert (last["fpr"], last["tpr"]) == (1, 1)


def test_metric_delta(spark):
    a, b = M.binary_metrics(scored(spark, (0.9, 0.1), (1, 0))), M.binary_metrics(scored(spark, (0.9, 0.8), (1, 0)))
    assert M.metric_delta(a, a).first()["passed"]
    r = M.metric_delta(a, b).first()
    assert not r["passed"] and r["delta"] == 1.0


def test_layer_stacks(spark):
    keys = [("plain", f"gnn.conv{i}.lin.weight") for i in range(1, 5)]
    keys += [("mixed", f"gnn.conv{i}.att_src") for i in (1, 4)] + [("mixed", f"gnn.conv{i}.lin.weight") for i in (2, 3, 5, 6)]
    keys += [("mixed", "gnn.lin1.weight"), ("mixed", "gnn.lin2.weight"), ("none", "other.weight")]
    got = {r["model"]: (r["layers"], r["skip"]) for r in P.layer_stacks(spark.createDataFrame(keys, "model string, key string")).collect()}
    assert got["plain"] == (["sage"] * 4, False)
    assert got["mixed"] == (["gat", "sage", "sage", "gat", "sage", "sage"], True)
    assert got["none"] == ([], False)


def test_model_names(spark):
    names = ["model1212_hiddensize_128_drop_02.pt", "modelskip_hiddensize_32_drop_00.pt", "checkpoint.pt", "odd.pt"]
    got = {r["name"]: r for r in P.hyper_parameters(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got[names[0]]["hidden"] == 128 and got[names[0]]["dropout"] == pytest.approx(0.2) and got[names[0]]["arch"] == "1212"
    assert "checkpoint.pt" not in got and not got["odd.pt"]["valid"] and got["odd.pt"]["hidden"] is None
    assert spark.range(1).select(P.model_name(F.lit("04"), F.lit(64), F.lit(6)).alias("n")).first()["n"] == "model04_hiddensize_64_drop_06.pt"
    assert spark.range(1).select(P.phase_of(F.lit("val")).alias("p")).first()["p"] == "Validation"
    assert {r["arch"]: r["layers"] for r in P.stack_table(spark).collect()}["22"] == ["gat", "gat", "sage", "sage"]


def test_early_stopping(spark):
    losses = {1: [1.0, 0.9, 0.8, 0.8, 0.8, 0.8], 2: [1.0, 2.0], 3: [0.5, 0.4995, 0.499]}
    log = spark.createDataFrame([(r, i + 1, x) for r, v in losses.items() for i, x in enumerate(v)], "run long, epoch long, loss double")
    got = {r["run"]: r for r in P.early_stopping(log, patience=3).collect()}
    assert (got[1]["best_epoch"], got[1]["stop_epoch"], got[1]["stopped"]) == (3, 6, True)
    assert (got[2]["best_epoch"], got[2]["stop_epoch"], got[2]["stopped"]) == (1, 2, False)
    assert got[3]["best_epoch"] == 3  # 0.499 gains 0.001 on 0.5; 0.4995 doesn't
    assert P.best_rows(log, P.early_stopping(log, patience=3)).count() == 3


def test_expected_metrics_and_coverage(spark):
    log = spark.createDataFrame([(1, 32, 0.2, "Testing", 0.9), (2, 32, 0.2, "Testing", 0.8), (3, 64, 0.0, "Testing", 0.7)], "row_no long, size int, dropout double, phase string, auc double")
    wanted = spark.createDataFrame([(32, 0.2 + 1e-14, "testing"), (32, 0.3, "testing")], "size int, dropout double, phase string")
    got = P.expected_metrics(wanted, log).collect()
    assert [(r["row_no"], r["auc"]) for r in got] == [(1, 0.9)]
    names = spark.createDataFrame([("model04_hiddensize_32_drop_02.pt",)], "name string")
    assert [tuple(r) for r in P.not_covered(log, names).collect()] == [(64, 0.0)]
    heat = P.heat_map(log, [0.0, 0.2]).orderBy("size").collect()
    assert heat[0]["d02"] == pytest.approx(80) and heat[1]["d00"] == pytest.approx(70) and heat[0]["d00"] is None


def test_encoding_matches_numpy(spark):
    freqs = [1 / (1000 * math.exp(k * math.log(10) / 15)) for k in range(16)]
    pts = np.random.default_rng(1).normal(size=(20, 2)) * 1e4
    df = spark.createDataFrame([tuple(map(float, p)) for p in pts], "x double, y double")
    got = np.array([r["e"] for r in df.select(E.position_encoding(F.col("x"), F.col("y"), E.frequencies()).alias("e")).collect()])
    axes = np.array([[math.cos(2 * math.pi * k / 3), math.sin(2 * math.pi * k / 3)] for k in range(3)])
    along = pts @ axes.T
    want = np.stack([g(along[:, k] * f) for f in freqs for k in range(3) for g in (np.sin, np.cos)], axis=1)
    assert got.shape == (20, 96) and np.abs(got - want).max() < 1e-9
    with pytest.raises(ValueError):
        E.frequencies(kind="other")
    r = spark.range(1).select(E.frequencies(1).alias("one"), E.frequencies(4, kind="random").alias("r")).first()
    assert r["one"] == [0.001] and all(0 <= v < 10_000 for v in r["r"])
    ffn = df.select(E.position_encoding(F.col("x"), F.col("y"), E.frequencies(), ffn=lambda c: F.slice(c, 1, 2)).alias("e")).first()
    assert len(ffn["e"]) == 2


def test_one_hot_and_bins(spark):
    df = spark.createDataFrame([("a",), (None,), ("z",)], "c string").select(E.one_hot(F.col("c"), ["a", "b"]).alias("v"))
    assert [r["v"] for r in df.collect()] == [[1, 0], [0, 0], [0, 0]]
    b = spark.createDataFrame([(v,) for v in (1.0, 2.0, 2.5, 5.0, None)], "v double").select(E.quantile_bin(F.col("v"), [2.0, 3.0]).alias("b"))
    assert [r["b"] for r in b.collect()] == [0, 0, 1, 2, None]


def _numpy_gat(h, edges, w, s, t, slope=0.2):
    z = h @ np.array(w).T
    out = np.zeros_like(z)
    for v in range(len(h)):
        src = [a for a, b in edges if b == v]
        if src:
            logit = np.array([z[a] @ s + z[v] @ t for a in src])
            logit = np.where(logit > 0, logit, slope * logit)
            a = np.exp(logit - logit.max())
            out[v] = (a[:, None] * z[src]).sum(0) / a.sum()
    return out


def test_propagation_matches_numpy(spark):
    rng = np.random.default_rng(2)
    h, edges = rng.normal(size=(12, 3)), sorted({(int(a), int(b)) for a, b in rng.integers(0, 11, (30, 2))})
    nodes = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(h)], "id long, h array<double>")
    e = spark.createDataFrame(edges, "src long, dst long")
    w1, ws, wr, skip = (rng.normal(size=s) for s in ((4, 3), (2, 4), (2, 4), (2, 4)))
    s, t = rng.normal(size=4), rng.normal(size=4)
    layers = [{"kind": "gat", "weight": w1.tolist(), "att_src": s.tolist(), "att_dst": t.tolist()}, {"kind": "sage", "w_neighbour": ws.tolist(), "w_self": wr.tolist()}]
    got = {r["id"]: r["h"] for r in N.propagate(nodes, {"r": e}, layers, skip={2: skip.tolist()}).collect()}
    x = np.maximum(_numpy_gat(h, edges, w1, s, t), 0)
    mean = np.array([x[[a for a, b in edges if b == v]].mean(0) if any(b == v for _, b in edges) else np.zeros(4) for v in range(12)])
    want = mean @ ws.T + x @ wr.T + x @ skip.T
    assert max(np.abs(np.array(got[v]) - want[v]).max() for v in range(12)) < 1e-9
    with pytest.raises(ValueError):
        N.propagate(nodes, {"r": e}, [{"kind": "gcn"}])


def test_link_model_matches_numpy(spark):
    """Two node types, three relations with weights of their own, a skip connection; node a3 and road b4 have no edge."""
    rng = np.random.default_rng(5)
    n, width = {"a": 4, "b": 5}, {"a": 2 + 1, "b": 2 + 2}
    xy = {t: rng.normal(size=(k, 2)) for t, k in n.items()}
    att = {t: rng.normal(size=(k, width[t] - 2)) for t, k in n.items()}
    edges = {("a", "link", "a"): [(0, 1), (1, 2), (2, 0)], ("a", "near", "b"): [(0, 0), (1, 0), (2, 3)], ("b", "back", "a"): [(0, 0), (0, 1), (3, 2), (1, 2)]}
    enc, bias = rng.normal(size=(2, 6)), rng.normal(size=2)
    first = {k: {"weight": rng.normal(size=(3, width[k[0]])), "weight_to": rng.normal(size=(3, width[k[2]])), "att_src": rng.normal(size=3), "att_dst": rng.normal(size=3)} for k in edges}
    second = {k: {"w_neighbour": rng.normal(size=(2, 3)), "w_self": rng.normal(size=(2, 3))} for k in edges}
    skip = {t: rng.normal(size=(3, w)) for t, w in width.items()}

    def plain(d):
        return {k: v.tolist() for k, v in d.items()}

    nodes = {
        t: spark.createDataFrame([(i, *map(float, xy[t][i]), list(map(float, att[t][i]))) for i in range(k)], "id long, x double, y double, attributes array<double>")
        for t, k in n.items()
    }
    tables = {k: spark.createDataFrame(v, "src long, dst long") for k, v in edges.items()}
    links = spark.createDataFrame([(0, 1), (2, 3), (3, 1)], "src long, dst long")
    got = W.link_model(
        nodes, tables, links, "a", {"weight": enc.tolist(), "bias": bias.tolist(), "freqs": E.frequencies(1, 1.0, 1.0)},
        [{"kind": "gat", "weights": {k: plain(v) for k, v in first.items()}}, {"kind": "sage", "weights": {k: plain(v) for k, v in second.items()}}], {1: plain(skip)},
    )
    got = {(r["src"], r["dst"]): r["score"] for r in got.collect()}

    mid = np.vstack(list(xy.values())).mean(0)
    axes = np.array([[math.cos(2 * math.pi * k / 3), math.sin(2 * math.pi * k / 3)] for k in range(3)])
    h = {}
    for t in n:
        along = (xy[t] - mid) @ axes.T
        place = np.stack([g(along[:, k]) for k in range(3) for g in (np.sin, np.cos)], axis=1)
        h[t] = np.hstack([np.maximum(place @ enc.T + bias, 0), att[t]])
    x = {t: h[t] @ skip[t].T for t in n}
    for (s, r, t), es in edges.items():
        w = first[s, r, t]
        zs, zt = h[s] @ w["weight"].T, h[t] @ w["weight_to"].T
        for v in range(n[t]):
            src = [a for a, b in es if b == v]
            if src:
                logit = np.array([zs[a] @ w["att_src"] + zt[v] @ w["att_dst"] for a in src])
                e = np.exp(np.where(logit > 0, logit, 0.2 * logit))
                x[t][v] += (e[:, None] * zs[src]).sum(0) / e.sum()
    x = {t: np.maximum(v, 0) for t, v in x.items()}
    y = np.zeros((n["a"], 2))
    for (s, r, t), es in edges.items():
        if t == "a":
            w = second[s, r, t]
            mean = np.array([x[s][[a for a, b in es if b == v]].mean(0) if any(b == v for _, b in es) else np.zeros(3) for v in range(n["a"])])
            y += mean @ w["w_neighbour"].T + x["a"] @ w["w_self"].T
    assert got.keys() == {(0, 1), (2, 3), (3, 1)}
    assert all(abs(s - y[a] @ y[b]) < 1e-9 for (a, b), s in got.items())


def test_centre_of_all_types_per_group(spark):
    a = spark.createDataFrame([("g", 1, 0.0, 0.0), ("k", 2, 5.0, 5.0)], "g string, id long, x double, y double")
    b = spark.createDataFrame([("g", 1, 4.0, 2.0)], "g string, id long, x double, y double")
    got = {r["id"]: (r["x"], r["y"]) for r in N.from_centre(a, ["g"], a.unionByName(b)).collect()}
    assert got == {1: (-2.0, -1.0), 2: (0.0, 0.0)}


def test_evaluate(spark):
    log = spark.createDataFrame([(1, 32, 0.2, "Testing", *[1.0] * 6), (2, 32, 0.2, "Testing", *[0.0] * 6)], "row_no long, size int, dropout double, phase string, " + ", ".join(f"{m} double" for m in M.METRICS))
    s = scored(spark, (0.9, 0.1), (1, 0))
    assert [(r["delta"], r["passed"]) for r in W.evaluate(s, log, 32, 0.2, "testing").collect()] == [(0.0, True)]
    assert W.evaluate(s, log, 64, 0.2, "testing").count() == 0
    with pytest.raises(Exception, match="no scored rows"):
        W.evaluate(scored(spark, (), ()), log, 32, 0.2, "testing").collect()


def test_links(spark):
    nodes = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, -1.0])], "id long, h array<double>")
    r = L.score_links(spark.createDataFrame([(1, 2, 1.0)], "src long, dst long, label double"), nodes).first()
    assert r["score"] == 1.0 and r["predicted"] == 1 and r["loss"] == pytest.approx(math.log1p(math.exp(-1)))
    rows = spark.createDataFrame([(1, [0.0, -5.0]), (2, [4.0, 4.0])], "id long, a array<double>")
    assert tuple(L.largest_cell(rows, "a", "id").first()) == (2, 0, 4.0)
    assert [(r["pos"], r["importance"]) for r in L.top_features(rows, "a", 1).collect()] == [(1, 9.0)]


def test_fitted_classifier_separates(spark):
    rng = np.random.default_rng(3)
    nodes = spark.createDataFrame([(i, list(map(float, (1 if i % 2 else -1) + 0.1 * rng.normal(size=2)))) for i in range(40)], "id long, h array<double>")
    e = spark.createDataFrame([(i, (i + k) % 40, float(k == 2), float(k)) for i in range(40) for k in (1, 2)], "src long, dst long, label double, dist double")
    f = L.link_features(e, nodes, extra=["dist"])
    assert len(f.first()["features"]) == 3
    for _, model, phases in L.sweep(f, f, f, [{"reg": 0.01}]):
        assert phases["Testing"].first()["auc"] == 1.0
        a = L.attributions(f, model).first()
        assert sum(a["attribution"]) == pytest.approx(float(model.coefficients.dot(a["features"])))


def test_epoch_loss(spark):
    b = spark.createDataFrame([(1, "t", 1.0, 1), (1, "t", 4.0, 2)], "epoch long, phase string, loss double, n long")
    assert M.epoch_loss(b).first()["loss"] == 3.0
