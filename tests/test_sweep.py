"""The sweep against numpy, and taken up again after a break."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.operators import metrics as M
from linkloom.operators import sweep as W
from linkloom.sources import tables as T


def data(spark, n=300, dims=4, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    y = (x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=n) > 0).astype(float)
    phase = [W.PHASES[0 if i % 10 < 6 else 1 if i % 10 < 8 else 2] for i in range(n)]
    df = spark.createDataFrame([(i, phase[i], float(y[i]), x[i].tolist()) for i in range(n)], "key long, phase string, label double, features array<double>")
    return df, x, y, np.array(phase)


def plain_fit(x, y, phase, size, dropout, seed=42, rate=0.05, max_epochs=100, patience=5, delta=0.001):
    layer, w = W.first_layer(size, x.shape[1], seed), np.zeros(size + 1)
    h = W.units(x, layer)
    t, v = phase == "Training", phase == "Validation"
    m = s = 0.0
    val, train, best, bad, kept = [], [], 0, 0, w
    for e in range(1, max_epochs + 1):
        g = h * W.hidden_by_dropout(np.arange(len(x)), size, dropout, seed, e) if dropout else h
        train.append(W.losses(g[t] @ w, y[t]).mean())
        val.append(W.losses(h[v] @ w, y[v]).mean())
        if not best or -val[-1] >= -val[best - 1] + delta:
            best, kept, bad = e, w, 0
        else:
            bad += 1
            if bad >= patience:
                break
        grad = g[t].T @ (1 / (1 + np.exp(-(g[t] @ w))) - y[t]) / t.sum()
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**e)) / (np.sqrt(s / (1 - 0.999**e)) + 1e-8)
    return kept, best, e, train, val, h


def test_fit_equals_numpy(spark, tmp_path):
    df, x, y, phase = data(spark)
    grid = spark.createDataFrame([(16, 0.25)], "size int, dropout double")
    how = {"rate": 0.2, "max_epochs": 12, "patience": 3}
    assert W.sweep(df.repartition(5), 4, grid, str(tmp_path / "log"), threshold=0.0, **how) == 1
    w, best, epochs, train, val, h = plain_fit(x, y, phase, 16, 0.25, **how)
    rows = {r["phase"]: r for r in T.read_log(spark, str(tmp_path / "log")).collect()}
    assert set(rows) == set(W.PHASES) and best > 1
    for name, r in rows.items():
        assert (r["size"], r["dropout"], r["epochs"]) == (16, 0.25, best if name == "Training" else epochs)
        assert r["training_loss"] == pytest.approx(train[best - 1]) and r["validation_loss"] == pytest.approx(val[best - 1])
        at = phase == name
        scored = spark.createDataFrame([(float(a), float(b)) for a, b in zip(h[at] @ w, y[at])], "score double, label double")
        want = M.binary_metrics(scored, 0.0).first()
        assert all(r[m] == pytest.approx(want[m]) for m in M.METRICS)
    assert rows["Testing"]["auc"] > 0.6


def test_broken_sweep_goes_on(spark, tmp_path, monkeypatch):
    df, *_ = data(spark, 100)
    grid = spark.createDataFrame([(s, d) for s, d in ((4, 0.0), (4, 0.1 + 0.2), (8, 0.0))], "size int, dropout double")
    how = {"max_epochs": 2}
    W.sweep(df, 4, grid, str(tmp_path / "whole"), **how)
    append, calls = T.append_log, []

    def breaks(rows, path):
        calls.append(path)
        if len(calls) == 3:
            raise KeyboardInterrupt
        append(rows, path)

    monkeypatch.setattr(T, "append_log", breaks)
    with pytest.raises(KeyboardInterrupt):
        W.sweep(df, 4, grid, str(tmp_path / "broken"), **how)
    assert T.read_log(spark, str(tmp_path / "broken")).count() == 6
    assert W.sweep(df, 4, grid, str(tmp_path / "broken"), **how) == 1
    assert W.sweep(df, 4, grid, str(tmp_path / "broken"), **how) == 0

    def rows(name):
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in T.read_log(spark, str(tmp_path / name)).collect())

    assert rows("broken") == rows("whole") and len(rows("whole")) == 9


def test_open_settings(spark):
    grid = spark.createDataFrame([(4, 0.3), (4, 0.3), (8, 0.3), (8, 0.0)], "size int, dropout double")
    done = spark.createDataFrame([(4, 0.1 + 0.2, p) for p in W.PHASES] + [(8, 0.0, "Training")], "size int, dropout double, phase string")
    got = {(r["size"], r["dropout"]): r["phases"] for r in W.open_settings(grid, done).collect()}
    assert got == {(8, 0.3): [], (8, 0.0): ["Training"]}


def test_nothing_to_fit(spark, tmp_path):
    df, *_ = data(spark, 30)
    grid = spark.createDataFrame([(4, 0.0)], "size int, dropout double")
    with pytest.raises(ValueError, match="needed"):
        W.sweep(df.where(F.col("phase") == "Testing"), 4, grid, str(tmp_path / "log"))


def test_an_epoch_sends_one_row_per_task_and_phase(spark):
    df, x, y, phase = data(spark, n=600)
    train = (F.col("phase") == "Training").cast("double")
    row = F.concat(F.array(F.col("key").cast("double"), "label", train), "features")
    rows = df.select("phase", row.alias("row")).unionByName(spark.createDataFrame([(None, [0.0] * 7), ("Training", None)], "phase string, row array<double>")).repartition(3)
    layer, w = W.first_layer(8, 4, 1), np.linspace(-1, 1, 9)
    got = W.epoch_states(rows, 4, layer, w, 0.25, 1, 2).collect()
    assert len(got) <= 3 * 3 and {r["phase"] for r in got} == set(W.PHASES)
    h, t = W.units(x, layer), phase == "Training"
    h[t] *= W.hidden_by_dropout(np.flatnonzero(t), 8, 0.25, 1, 2)
    for name in W.PHASES:
        at = phase == name
        state = np.sum([r["state"] for r in got if r["phase"] == name], axis=0)
        slope = (1 / (1 + np.exp(-(h[at] @ w))) - y[at]) * (name == "Training")
        assert np.allclose(state, np.r_[W.losses(h[at] @ w, y[at]).sum(), at.sum(), slope @ h[at]])
