"""Geometry as column expressions: points are struct<x,y>, lines array<struct<x,y>>.

Nothing here shuffles or leaves the JVM. Null geometries give null. Values that a formula uses several
times are bound by ``let``, so that expressions grow with the formula and not with its nesting.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import atan, atanh, radians, sin, sinh, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with the value computed once: an expression that is used n times isn't written n times."""
    return F.transform(F.array(value), body)[0]


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def line(*xy: tuple[Column, Column]) -> Column:
    return F.array(*(point(x, y) for x, y in xy))


def first_point(coords: Column) -> Column:
    return F.get(coords, F.lit(0))


def last_point(coords: Column) -> Column:
    return F.get(coords, F.size(coords) - 1)


def bearing(p: Column, q: Column) -> Column:
    """Undirected bearing in degrees in [0, 180), clockwise from north."""
    return F.degrees(F.pmod(F.atan2(q["x"] - p["x"], q["y"] - p["y"]), F.pi()))


def angle_bin(angle: Column) -> Column:
    """Six bins of 30 degrees; bin 0 is centred on north."""
    return F.when((angle < 15) | (angle >= 165), 0).otherwise((F.floor((angle - 15) / 30) + 1).cast("int"))


def is_closed(coords: Column) -> Column:
    """Whether the ends are one point; null for a line without points."""
    a, b = first_point(coords), last_point(coords)
    return (a["x"] == b["x"]) & (a["y"] == b["y"])


def boundary(parts: Column) -> Column:
    """Points of the boundary of a multi-part line: part ends that occur an odd number of times.

    In order of first occurrence; closed lines have none.
    """
    ends = F.flatten(F.transform(parts, lambda c: F.array(first_point(c), last_point(c))))
    odd = F.filter(ends, lambda p: F.size(F.filter(ends, lambda q: q == p)) % 2 == 1)
    return F.array_distinct(odd)


def rotation(coords: Column) -> Column:
    """Direction from the first to the last point in degrees in (-180, 180], counter-clockwise from east."""
    p, q = first_point(coords), last_point(coords)
    return F.degrees(F.atan2(q["y"] - p["y"], q["x"] - p["x"]))


def flatten_parts(parts: Column) -> Column:
    return F.flatten(parts)


def segments(coords: Column) -> Column:
    """Consecutive point pairs as array<struct<p,q>>."""
    n = F.size(coords)
    return F.when(n < 2, F.array().cast("array<struct<p:struct<x:double,y:double>,q:struct<x:double,y:double>>>")).otherwise(
        F.zip_with(F.slice(coords, 1, n - 1), F.slice(coords, 2, n - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    )


def segment_length(s: Column) -> Column:
    return F.hypot(s["q"]["x"] - s["p"]["x"], s["q"]["y"] - s["p"]["y"])


def length(coords: Column) -> Column:
    return F.aggregate(segments(coords), F.lit(0.0), lambda a, s: a + segment_length(s))


def centroid(coords: Column) -> Column:
    """Mean of the segment midpoints weighted by length; the first point of a line without length."""
    zero = F.struct(F.lit(0.0).alias("l"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def step(a: Column, s: Column) -> Column:
        return let(segment_length(s), lambda n: F.struct(
            (a["l"] + n).alias("l"), (a["x"] + n * (s["p"]["x"] + s["q"]["x"]) / 2).alias("x"), (a["y"] + n * (s["p"]["y"] + s["q"]["y"]) / 2).alias("y")
        ))

    def mean(line: Column) -> Column:
        total = F.aggregate(segments(line), zero, step)
        return let(total, lambda t: F.when(t["l"] > 0, point(t["x"] / t["l"], t["y"] / t["l"])).otherwise(first_point(line)))

    return let(coords, mean)


def swap_xy(p: Column) -> Column:
    return F.struct(p["y"].alias("y"), p["x"].alias("x"))


def bbox(coords: Column) -> tuple[Column, Column, Column, Column]:
    """(min x, min y, max x, max y)."""
    xs, ys = F.transform(coords, lambda p: p["x"]), F.transform(coords, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def overlaps_window(coords: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """Whether the bounding box of a line meets a window."""
    a, b, c, d = bbox(coords)
    return (a <= x1) & (c >= x0) & (b <= y1) & (d >= y0)


def orientation(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def point_on_segment(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column, tolerance: float = 0.0) -> Column:
    """Whether a point lies on a segment; ``tolerance`` is a distance, 0 is exact."""
    inside = (
        (px >= F.least(x1, x2) - tolerance) & (px <= F.greatest(x1, x2) + tolerance)
        & (py >= F.least(y1, y2) - tolerance) & (py <= F.greatest(y1, y2) + tolerance)
    )
    cross = F.abs(orientation(x1, y1, x2, y2, px, py))
    return inside & (cross == 0 if tolerance == 0 else cross <= tolerance * F.hypot(x2 - x1, y2 - y1))


def segments_meet(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Whether two segments (x1, y1, x2, y2) share a point."""
    d1, d2 = orientation(*a, b[0], b[1]), orientation(*a, b[2], b[3])
    d3, d4 = orientation(*b, a[0], a[1]), orientation(*b, a[2], a[3])
    boxes = (
        (F.least(a[0], a[2]) <= F.greatest(b[0], b[2])) & (F.least(b[0], b[2]) <= F.greatest(a[0], a[2]))
        & (F.least(a[1], a[3]) <= F.greatest(b[1], b[3])) & (F.least(b[1], b[3]) <= F.greatest(a[1], a[3]))
    )
    return boxes & (F.signum(d1) * F.signum(d2) <= 0) & (F.signum(d3) * F.signum(d4) <= 0)


def to_wkt(coords: Column) -> Column:
    body = F.array_join(F.transform(coords, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", ")
    return F.concat(F.lit("LINESTRING ("), body, F.lit(")"))


def from_wkt(text: Column) -> Column:
    """Coordinates of a POINT or LINESTRING text; other text gives null."""
    body = F.regexp_extract(text, r"^\s*(?:POINT|LINESTRING)\s*\(([^()]*)\)\s*$", 1)
    pairs = F.split(F.trim(body), r"\s*,\s*")
    out = F.transform(pairs, lambda s: point(F.split(s, r"\s+")[0], F.split(s, r"\s+")[1]))
    return F.when(body != "", out)


@dataclass(frozen=True)
class TransverseMercator:
    """Parameters of a transverse Mercator grid; degrees, metres."""

    lon0: float
    lat0: float = 0.0
    k0: float = 0.9996
    false_easting: float = 500_000.0
    false_northing: float = 10_000_000.0
    semi_major: float = 6_378_137.0
    inverse_flattening: float = 298.257222101

    @property
    def _n(self) -> float:
        f = 1 / self.inverse_flattening
        return f / (2 - f)

    @property
    def _radius(self) -> float:
        n = self._n
        return self.semi_major / (1 + n) * (1 + n**2 / 4 + n**4 / 64)

    def _forward_series(self) -> list[float]:
        n = self._n
        return [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]

    def _inverse_series(self) -> list[float]:
        n = self._n
        return [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]

    def _conformal(self, lat: Column) -> Column:
        """Tangent of the conformal latitude."""
        e = 2 * sqrt(self._n) / (1 + self._n)
        return let(F.sin(F.radians(lat)), lambda s: F.sinh(F.atanh(s) - e * F.atanh(e * s)))

    def _angles(self, lat: Column, lon: Column) -> Column:
        """struct<x, y> of xi and eta on the conformal sphere, radians."""
        both = F.struct(self._conformal(lat).alias("t"), (F.radians(lon) - radians(self.lon0)).alias("d"))
        return let(both, lambda v: F.struct(
            F.atan2(v["t"], F.cos(v["d"])).alias("x"), F.atanh(F.sin(v["d"]) / F.sqrt(1 + v["t"] * v["t"])).alias("y")
        ))

    def _meridian(self, z: Column, sign: int, series: list[float]) -> Column:
        """z + sign * sum of a_j sin(2 j z) for complex z = x + i y, by Clenshaw's recurrence.

        The sum is one fold over the coefficients from last to first, b_j = a_j + 2 cos(2 z) b_(j+1) - b_(j+2), and
        is b_1 sin(2 z); the expression has the same size however many terms the series has.
        """
        names = ("p", "q", "r", "s")  # b_(j+1) = p + i q, b_(j+2) = r + i s
        zero = F.struct(*(F.lit(0.0).alias(c) for c in names))
        trig = F.struct(
            z["x"].alias("x"), z["y"].alias("y"),
            (F.cos(2 * z["x"]) * F.cosh(2 * z["y"])).alias("cr"), (-F.sin(2 * z["x"]) * F.sinh(2 * z["y"])).alias("ci"),
            (F.sin(2 * z["x"]) * F.cosh(2 * z["y"])).alias("sr"), (F.cos(2 * z["x"]) * F.sinh(2 * z["y"])).alias("si"),
        )

        def summed(w: Column) -> Column:
            def step(b: Column, a: Column) -> Column:
                return F.struct(
                    (a + 2 * (w["cr"] * b["p"] - w["ci"] * b["q"]) - b["r"]).alias("p"), (2 * (w["cr"] * b["q"] + w["ci"] * b["p"]) - b["s"]).alias("q"),
                    b["p"].alias("r"), b["q"].alias("s"),
                )

            fold = F.aggregate(F.array(*(F.lit(float(a)) for a in reversed(series))), zero, step)
            return let(fold, lambda b: point(
                w["x"] + sign * (b["p"] * w["sr"] - b["q"] * w["si"]), w["y"] + sign * (b["p"] * w["si"] + b["q"] * w["sr"])
            ))

        return let(trig, summed)

    def _northing0(self) -> float:
        """xi of the origin."""
        e = 2 * sqrt(self._n) / (1 + self._n)
        s = sin(radians(self.lat0))
        xi = atan(sinh(atanh(s) - e * atanh(e * s)))
        return xi + sum(a * sin(2 * j * xi) for j, a in enumerate(self._forward_series(), 1))

    def project(self, p: Column) -> Column:
        """(lon, lat) in degrees as (easting, northing)."""
        scale, origin = self.k0 * self._radius, self._northing0()
        z = let(self._angles(p["y"], p["x"]), lambda v: self._meridian(v, 1, self._forward_series()))
        return let(z, lambda v: point(self.false_easting + scale * v["y"], self.false_northing + scale * (v["x"] - origin)))

    def unproject(self, p: Column) -> Column:
        """(easting, northing) as (lon, lat) in degrees."""
        scale, e = self.k0 * self._radius, 2 * sqrt(self._n) / (1 + self._n)
        z = point((p["y"] - self.false_northing) / scale + self._northing0(), (p["x"] - self.false_easting) / scale)
        chi = let(z, lambda v: self._meridian(v, -1, self._inverse_series()))

        def degrees(v: Column) -> Column:
            # back from the conformal latitude by fixed-point steps, a fold as well
            start = let(F.sin(v["x"]) / F.cosh(v["y"]), lambda s: F.struct(s.alias("s"), (s / F.sqrt(1 - s * s)).alias("t")))
            end = F.aggregate(
                F.sequence(F.lit(1), F.lit(4)), start, lambda a, _: F.struct(F.tanh(F.asinh(a["t"]) + e * F.atanh(e * a["s"])).alias("s"), a["t"].alias("t"))
            )
            return point(F.lit(self.lon0) + F.degrees(F.atan2(F.sinh(v["y"]), F.cos(v["x"]))), F.degrees(F.asin(end["s"])))

        return let(chi, degrees)

    def project_line(self, coords: Column) -> Column:
        return F.transform(coords, self.project)

    def unproject_line(self, coords: Column) -> Column:
        return F.transform(coords, self.unproject)


def projected_centroid(coords: Column, grid: TransverseMercator) -> Column:
    """Centroid taken in the projected plane, as (lon, lat); null without points."""
    return let(centroid(grid.project_line(coords)), grid.unproject)
