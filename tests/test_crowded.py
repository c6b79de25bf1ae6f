"""Spatial joins where one cell holds half of all segments, against brute force."""

import math
import random

from pyspark.sql import functions as F

from linkloom.operators import spatial_join as J
from linkloom.plans import fixtures as X


def meet(a, b):
    def o(p, q, r):
        return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

    def sign(v):
        return (v > 0) - (v < 0)

    (p, q), (r, s) = a, b
    boxes = all(min(p[i], q[i]) <= max(r[i], s[i]) and min(r[i], s[i]) <= max(p[i], q[i]) for i in (0, 1))
    return boxes and sign(o(p, q, r)) * sign(o(p, q, s)) <= 0 and sign(o(r, s, p)) * sign(o(r, s, q)) <= 0


def lines_of(spark, segs):
    return spark.createDataFrame([(i, [p, q]) for i, (p, q) in enumerate(segs)], "line_id long, coords array<struct<x:double,y:double>>")


def made(kind, n, at=64, seed=1):
    """Segments that crowd into the unit cell at (``at``, ``at``)."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        x, y = at + rng.randrange(1024) / 1024, at + rng.randrange(1024) / 1024
        if kind == "dense":
            out.append(((x, y), (x + rng.randrange(-8, 9) / 512, y + rng.randrange(-8, 9) / 512)))
        elif kind == "hatch":
            out.append(((x, float(at)), (x, at + 1.0)))
        elif kind == "star":
            out.append(((at + 0.5, at + 0.5), (x, y)))
        else:
            out.append(((at + 0.25, at + 0.25), (at + 0.75, at + 0.5)))
    return out


def apart(n):
    return [((float(10 * i), 5.0), (10.0 * i + 1, 6.0)) for i in range(n)]


def test_lines_meeting_in_crowded_cells(spark):
    """Half of all segments in four cells: short ones, parallels, a star, and equal ones."""
    segs = apart(800) + [s for i, kind in enumerate(("dense", "hatch", "star", "equal")) for s in made(kind, 200, 64 + 20 * i)]
    got = {tuple(r) for r in J.lines_meeting(lines_of(spark, segs), cell=1.0).collect()}
    want = {(i, j) for i in range(len(segs)) for j in range(len(segs)) if i != j and meet(segs[i], segs[j])}
    assert got == want


def test_work_per_leaf_is_bounded(spark):
    """Half of all segments in one cell, and as many again in parallels."""
    segs = J.explode_segments(lines_of(spark, apart(1000) + made("dense", 1000) + made("hatch", 1000, 90)))
    rows = J._cells(segs, 1.0).withColumn("side", F.lit(2))
    assert not J.leaves(rows, 1.0, pairs=10**9)[1]
    cut, crowded = J.leaves(rows, 1.0, pairs=144)
    per = cut.groupBy("cell").count().cache()
    assert crowded and per.agg(F.max("count")).first()[0] ** 2 <= 2 * 144  # equal places keep a leaf whole
    assert per.agg(F.sum("count")).first()[0] < 9 * 3000  # whole coordinates touch the cells on both sides


def test_points_in_a_crowded_cell(spark):
    rng = random.Random(3)
    segs = apart(400) + made("dense", 400)
    points = [(64 + rng.randrange(512) / 512, 64 + rng.randrange(512) / 512) for _ in range(700)] + [s[i] for s in segs[::3] for i in (0, 1)] + [(65.0, 65.0), (64.5, 64.5)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "mh_id long, x double, y double")

    def on(p, s, tolerance):
        (ax, ay), (bx, by) = s
        t = 0.0 if (ax, ay) == (bx, by) else max(0.0, min(1.0, ((p[0] - ax) * (bx - ax) + (p[1] - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
        d = ((p[0] - ax - t * (bx - ax)) ** 2 + (p[1] - ay - t * (by - ay)) ** 2) ** 0.5
        return d <= tolerance

    exact = {(i, j) for i, s in enumerate(segs) for j, p in enumerate(points) if meet(s, (p, p))}
    assert {tuple(r) for r in J.points_on_lines(lines_of(spark, segs), df, cell=1.0).collect()} == exact and len(exact) > 200
    near = {tuple(r) for r in J.points_on_lines(lines_of(spark, segs), df, cell=1.0, tolerance=0.01).collect()}
    assert near >= {(i, j) for i, s in enumerate(segs) for j, p in enumerate(points) if on(p, s, 0.0099)}


def test_spatial_joins_broadcast_no_side(spark, tiny):
    """Files of a few bytes explode into cells: neither side may pass through the driver."""
    lines, points = X.lines(spark, tiny), X.anchors(spark, tiny)
    for df in (J.lines_meeting(lines, cell=1.0), J.points_on_lines(lines, points, cell=1.0)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_cells_of_a_cut_segment_come_once(spark):
    rng = random.Random(5)
    segs = [tuple((rng.randrange(-400, 400) / 4, rng.randrange(-400, 400) / 4) for _ in range(2)) for _ in range(60)] + [((0.0, 0.0), (90.0, 0.0)), ((3.0, 80.0), (3.0, 3.0))]
    got = [tuple(r) for r in J._cells(J.explode_segments(lines_of(spark, segs)), 1.0).select("line_id", "cx", "cy").collect()]
    want = set()
    for i, (p, q) in enumerate(segs):
        cuts = max(1, math.ceil(max(abs(q[0] - p[0]), abs(q[1] - p[1])) / J.CELLS_PER_CUT))
        for k in range(cuts):
            a, b = (tuple(p[j] + (q[j] - p[j]) * n / cuts for j in (0, 1)) for n in (k, k + 1))
            x, y = (range(math.floor(min(a[j], b[j]) - 1e-9), math.floor(max(a[j], b[j]) + 1e-9) + 1) for j in (0, 1))
            want |= {(i, cx, cy) for cx in x for cy in y}
    assert len(got) == len(set(got)) and set(got) == want


def test_segments_of_short_and_empty_lines(spark):
    rows = [(1, [(0.0, 1.0), (2.0, 3.0), (4.0, 5.0)]), (2, [(7.0, 8.0)]), (3, []), (4, None), (5, [(1.0, 1.0), None])]
    df = spark.createDataFrame(rows, "line_id long, coords array<struct<x:double,y:double>>")
    got = {tuple(r) for r in J.explode_segments(df).collect()}
    assert got == {(1, 0.0, 1.0, 2.0, 3.0), (1, 2.0, 3.0, 4.0, 5.0), (2, 7.0, 8.0, 7.0, 8.0), (5, 1.0, 1.0, None, None)}
