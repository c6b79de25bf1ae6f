import math

import pytest
from pyspark.sql import functions as F

from linkloom.functions import geometry as G


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def pts(*xy):
    return G.line(*((F.lit(float(x)), F.lit(float(y))) for x, y in xy))


def test_bearing_and_bins(spark):
    def at(degrees):
        r = math.radians(degrees)
        return G.bearing(G.point(F.lit(0.0), F.lit(0.0)), G.point(F.lit(math.sin(r)), F.lit(math.cos(r))))

    for degrees, want in ((0, 0), (45, 45), (90, 90), (135, 135), (225, 45), (270, 90)):
        assert one(spark, at(degrees).alias("a"))["a"] == pytest.approx(want, abs=1e-9)
    for angle, want in ((0.0, 0), (14.9, 0), (15.0, 1), (44.9, 1), (45.0, 2), (164.9, 5), (165.0, 0)):
        assert one(spark, G.angle_bin(F.lit(angle)).alias("b"))["b"] == want


def test_closed_lines_and_boundaries(spark):
    r = one(
        spark, G.is_closed(pts((0, 0), (1, 1), (0, 0))).alias("closed"), G.is_closed(pts((0, 0), (1, 1))).alias("open"),
        G.boundary(F.array(pts((0, 0), (1, 0)), pts((1, 0), (2, 0)))).alias("two"), G.boundary(F.array(pts((0, 0), (1, 0), (0, 0)))).alias("none"),
        G.boundary(F.array(pts((0, 0), (1, 0)), pts((5, 5), (6, 6)))).alias("four"),
    )
    assert r["closed"] and not r["open"]
    assert [tuple(p) for p in r["two"]] == [(0, 0), (2, 0)]
    assert r["none"] == [] and len(r["four"]) == 4


def test_centroid_and_length(spark):
    r = one(spark, G.centroid(pts((0, 0), (4, 0), (4, 2))).alias("c"), G.length(pts((0, 0), (3, 4))).alias("l"), G.centroid(pts((2, 3), (2, 3))).alias("p"))
    assert r["l"] == 5 and tuple(r["p"]) == (2, 3)
    assert tuple(r["c"]) == pytest.approx(((4 * 2 + 2 * 4) / 6, (4 * 0 + 2 * 1) / 6))


def test_predicates(spark):
    def on(x, y):
        return G.point_on_segment(*(F.lit(float(v)) for v in (x, y, 0, 0, 4, 2)))

    def meet(a, b):
        return G.segments_meet(tuple(F.lit(float(v)) for v in a), tuple(F.lit(float(v)) for v in b))

    assert [one(spark, on(*p).alias("v"))["v"] for p in ((2, 1), (0, 0), (4, 2), (6, 3), (2, 2))] == [True, True, True, False, False]
    cases = {
        ((0, 0, 2, 2), (0, 2, 2, 0)): True, ((0, 0, 1, 1), (2, 2, 3, 3)): False, ((0, 0, 2, 2), (1, 1, 3, 3)): True,
        ((0, 0, 2, 0), (1, 0, 1, 5)): True, ((0, 0, 2, 0), (0, 1, 2, 1)): False, ((1, 1, 1, 1), (0, 0, 2, 2)): True, ((3, 1, 3, 1), (0, 0, 2, 2)): False,
    }
    for (a, b), want in cases.items():
        assert one(spark, meet(a, b).alias("v"))["v"] == want, (a, b)


def test_wkt_round_trip(spark):
    r = one(spark, G.from_wkt(G.to_wkt(pts((0.5, 1), (2, -3)))).alias("c"), G.from_wkt(F.lit("POINT (1 2)")).alias("p"), G.from_wkt(F.lit("POLYGON ((0 0))")).alias("no"))
    assert [tuple(p) for p in r["c"]] == [(0.5, 1), (2, -3)] and [tuple(p) for p in r["p"]] == [(1, 2)] and r["no"] is None


def test_projection(spark):
    grid = G.TransverseMercator(lon0=153.0)
    p = G.point(F.lit(153.0), F.lit(0.0))
    r = one(spark, grid.project(p).alias("m"), grid.unproject(grid.project(G.point(F.lit(151.2), F.lit(-33.9)))).alias("q"))
    assert tuple(r["m"]) == pytest.approx((500_000, 10_000_000), abs=1e-6)
    assert tuple(r["q"]) == pytest.approx((151.2, -33.9), abs=1e-9)
    # along the central meridian the northing is k0 times the meridian arc: 1 degree at the equator is 110574.4 m
    r = one(spark, grid.project(G.point(F.lit(153.0), F.lit(1.0))).alias("m"))
    assert r["m"]["y"] - 10_000_000 == pytest.approx(0.9996 * 110_574.4, abs=1)


def test_nulls_and_window(spark):
    null = F.lit(None).cast("array<struct<x:double,y:double>>")
    r = one(spark, G.centroid(null).alias("c"), G.rotation(null).alias("r"), G.overlaps_window(pts((0, 0), (2, 2)), 1, 1, 3, 3).alias("w"), G.overlaps_window(pts((0, 0), (0.5, 2)), 1, 1, 3, 3).alias("n"))
    assert r["c"] is None and r["r"] is None and r["w"] and not r["n"]
    assert one(spark, G.rotation(pts((0, 0), (-1, 0))).alias("r"))["r"] == 180


def test_projected_centroid_of_long_lines(spark):
    """Against the projection of every vertex; the plan does not grow with the vertices or the series."""
    import random

    grid, rng = G.TransverseMercator(lon0=153.0), random.Random(2)
    rows = [(i, [(153 + rng.uniform(-1, 1), -27 + rng.uniform(-1, 1)) for _ in range(n)]) for i, n in enumerate((1, 2, 3, 50, 400))]
    rows += [(10, [(153.5, -27.5)] * 3), (11, None), (12, [])]
    df = spark.createDataFrame(rows, "id long, coords array<struct<x:double,y:double>>")
    out = df.select("id", G.projected_centroid(F.col("coords"), grid).alias("c"))
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    got = {r["id"]: r["c"] for r in out.collect()}
    flat = df.select("id", F.posexplode("coords").alias("k", "p")).select("id", "k", grid.project(F.col("p")).alias("m"))
    plane = {}
    for r in sorted(flat.collect(), key=lambda r: r["k"]):
        plane.setdefault(r["id"], []).append((r["m"]["x"], r["m"]["y"]))
    for i, pts in plane.items():
        parts = [(math.dist(a, b), a, b) for a, b in zip(pts, pts[1:])]
        total = sum(n for n, _, _ in parts)
        want = pts[0] if not total else tuple(sum(n * (a[k] + b[k]) / 2 for n, a, b in parts) / total for k in (0, 1))
        back = spark.createDataFrame([(got[i]["x"], got[i]["y"])], "x double, y double").select(grid.project(F.struct("x", "y")).alias("m")).first()["m"]
        assert abs(back["x"] - want[0]) < 1e-3 and abs(back["y"] - want[1]) < 1e-3
    assert got[11]["x"] is None and got[12]["x"] is None
