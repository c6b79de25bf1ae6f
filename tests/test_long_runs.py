"""Early stopping over runs of any length, and samples of neighbours at a hub."""

import random

import pytest
from pyspark.sql import functions as F

from linkloom.operators import experiments as P
from linkloom.operators import sampling as S
from linkloom.operators import skew


def plain(losses, patience, delta):
    best = best_at = None
    bad = 0
    for i, x in enumerate(losses, 1):
        if best is None or -x >= -best + delta:
            best, best_at, bad = x, i, 0
        else:
            bad += 1
            if bad >= patience:
                return best_at, best, i, True
    return best_at, best, len(losses), False


@pytest.mark.parametrize(("patience", "delta"), [(5, 0.001), (1, 0.0), (40, 0.1), (3, 0.0)])
def test_early_stopping_equals_plain_loop(spark, parts, patience, delta):
    rng = random.Random(patience)
    runs = {r: [round(rng.uniform(0, 2) * 0.97**i, rng.choice((1, 3))) for i in range(rng.randrange(1, 120))] for r in range(30)}
    runs["long"] = [5 + rng.gauss(0, 0.05) - i / 5000 for i in range(9000)]
    runs["falling"] = [10 - i / 100 for i in range(500)]
    runs["flat"] = [1.0] * 300
    log = spark.createDataFrame([(str(r), i + 1, x) for r, v in runs.items() for i, x in enumerate(v)], "setting string, epoch long, loss double")
    log = log.unionByName(spark.createDataFrame([("3", 500, None), (None, 1, 2.0)], log.schema))
    want = {str(r): plain(v, patience, delta) for r, v in runs.items()}
    for got in parts(lambda: P.early_stopping(log, patience, delta, run="setting").collect()):
        assert {r["setting"]: (r["best_epoch"], r["best_loss"], r["stop_epoch"], r["stopped"]) for r in got} == want


def test_one_long_run_is_dealt_over_tasks(spark, parts):
    log = spark.range(200_000).select(F.lit(1).alias("run"), F.col("id").alias("epoch"), (F.lit(3.0) - F.sqrt("id") / 1000 + (F.xxhash64("id") % 1000) / 1e5).alias("loss"))
    rows = P.parted(log, ["run", "epoch", "loss"])
    dealt = [r["count"] for r in rows.groupBy("__part").count().collect()]
    assert len(dealt) >= 4 and max(dealt) < 100_000
    losses = [r["loss"] for r in log.orderBy("epoch").collect()]
    at, best, stop, stopped = plain(losses, 60, 0.0001)
    got = P.early_stopping(log, 60, 0.0001).first()
    assert (got["best_epoch"], got["best_loss"], got["stop_epoch"], got["stopped"]) == (at - 1, best, stop - 1, stopped)
    with pytest.raises(ValueError, match="delta"):
        P.early_stopping(log, 5, -0.1)


def test_sample_at_a_hub(spark, monkeypatch):
    """A third of all edges at one node: the same sample as by a plain sort, and tasks send k rows of a node at most."""
    rng = random.Random(1)
    edges = {("link", rng.randrange(3000), 7 if rng.random() < 1 / 3 else rng.randrange(400)) for _ in range(6000)}
    df = spark.createDataFrame(sorted(edges), "rel string, src long, dst long")
    seeds = spark.createDataFrame([(b, n) for b in (0, 1) for n in (7, 8, 9)], "batch_id long, node long")
    got = {tuple(r) for r in S.sample_neighbours(seeds, df, (5, 3)).collect()}
    monkeypatch.setattr(S, "hubs", lambda e, key: skew.hubs(e, key, 100))
    out = S.sample_neighbours(seeds, df, (5, 3))
    assert {tuple(r) for r in out.collect()} == got
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan and "__slice" in plan

    import hashlib

    def key(b, hop, src, dst):
        return hashlib.md5(f"{b}|{hop}|link|{src}|{dst}|42".encode()).hexdigest(), src

    want = set()
    for b in (0, 1):
        frontier = {7, 8, 9}
        for hop, k in ((1, 5), (2, 3)):
            taken = {(s, d) for d in frontier for s in sorted((s for _, s, e in edges if e == d), key=lambda s: key(b, hop, s, d))[:k]}
            want |= {(b, hop, "link", s, d) for s, d in taken}
            frontier = {s for s, _ in taken}
    assert got == want
