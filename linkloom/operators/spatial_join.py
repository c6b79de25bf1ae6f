"""Spatial joins by grid cells.

Segments go to the cells that their bounding boxes cover, points to theirs; an equi-join on the cell
brings candidates together and an exact predicate decides. Long segments are cut first,
so that they cover cells along their course and not the whole box.

A crowded cell is halved, across the axis that leaves fewer pairs, and its rows go to the halves
they touch; so on until a cell has at most ``PAIRS`` candidate pairs or halving gains nothing, as where all
segments cross in one point. Such a cell is met in slices (``skew``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import geometry as G
from linkloom.operators.components import checkpoint
from linkloom.operators.skew import hub_join, shuffled_join

CELLS_PER_CUT = 8
#: Candidate pairs in a cell that isn't halved any more, halvings at most, and the share of pairs that a halving must leave at most.
PAIRS, HALVINGS, GAIN = 64 * 64, 40, 0.9
CELL = ("ix", "iy", "lx", "ly")


def explode_segments(lines: DataFrame, line_id: str = "line_id", coords: str = "coords") -> DataFrame:
    """(line_id, x1, y1, x2, y2) of every segment; a line of one point is a segment without length."""
    n, i = F.size(coords), F.col("__i")
    out = lines.where(n > 0).select(F.col(line_id), F.col(coords).alias("__c"), F.explode(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0)))).alias("__i"))
    ends = ((1, F.get("__c", i)), (2, F.get("__c", F.least(i + 1, F.size("__c") - 1))))
    return out.select(line_id, *(p[c].alias(f"{c}{k}") for k, p in ends for c in ("x", "y")))


def cell_size(segs: DataFrame) -> float:
    """Median extent of the segments, at least a small positive number."""
    extent = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
    got = segs.agg(F.percentile_approx(extent, 0.5).alias("m"), F.max(extent).alias("top")).first()
    return float(got["m"] or got["top"] or 1.0)


def _cells(segs: DataFrame, cell: float) -> DataFrame:
    """One row per segment and cell covered by the boxes of its cuts, made row by row without a shuffle.

    The ranges are exploded one after the other, which is compiled, where nested arrays of cells aren't. A cut is half of ``CELLS_PER_CUT``
    cells long at least, so it shares cells only with the cut before it; those are left out.
    """
    reach = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
    cuts = F.greatest(F.ceil(reach / (cell * CELLS_PER_CUT)).cast("int"), F.lit(1))
    pad = cell * 1e-9  # rounding of a cut's ends

    def span(c: str, k: Column) -> tuple[Column, Column]:
        a, b = F.col(f"{c}1"), F.col(f"{c}2")
        p, q = a + (b - a) * k / F.col("cuts"), a + (b - a) * (k + 1) / F.col("cuts")
        return F.floor((F.least(p, q) - pad) / cell), F.floor((F.greatest(p, q) + pad) / cell)

    k = F.col("cut")
    out = segs.withColumn("cuts", cuts).withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    for c in ("x", "y"):
        out = out.withColumn(f"c{c}", F.explode(F.sequence(*span(c, k))))
    before = F.col("cx").between(*span("x", k - 1)) & F.col("cy").between(*span("y", k - 1))
    return out.where((k == 0) | ~before).select(*segs.columns, "cx", "cy")


def _touches(axis: str, half: int, cell: float, pad: Column) -> Column:
    """Whether the segment of a row meets one half, across an axis, of the cell of the row."""
    size = {c: F.lit(cell) / F.pow(F.lit(2.0), F.col(f"l{c}")) for c in ("x", "y")}
    low = {c: F.col(f"i{c}") * size[c] for c in ("x", "y")}
    size[axis] = size[axis] / 2
    low[axis] = low[axis] + half * size[axis]
    room = {c: size[c] / 2 + pad for c in ("x", "y")}
    middle = {c: low[c] + size[c] / 2 for c in ("x", "y")}
    near = F.lit(True)
    for c in ("x", "y"):
        near = near & (F.least(f"{c}1", f"{c}2") <= middle[c] + room[c]) & (F.greatest(f"{c}1", f"{c}2") >= middle[c] - room[c])
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    beside = F.abs(dx * (middle["y"] - F.col("y1")) - dy * (middle["x"] - F.col("x1")))
    return near & (beside <= F.abs(dx) * room["y"] + F.abs(dy) * room["x"])


def _candidates(inside: Column | None = None) -> Column:
    """Candidate pairs of a group of rows, or of those ``inside``: of sides 0 and 1, and of side 2 with itself."""

    def n(side: int) -> Column:
        here = F.col("side") == side
        return F.sum((here if inside is None else here & inside).cast("double"))

    return n(0) * n(1) + n(2) * n(2)


def leaves(rows: DataFrame, cell: float, tolerance: float = 0.0, pairs: int = PAIRS, halvings: int = HALVINGS) -> tuple[DataFrame, bool]:
    """Rows (side, x1, y1, x2, y2, cx, cy, others) with the hash ``cell`` of the leaf of each, and whether a cell was crowded.

    A row is repeated for each leaf it touches. Side 0 is compared with side 1, side 2 with itself. Points, of side 1, reach as far as ``tolerance``.
    """
    kept = [c for c in rows.columns if c not in ("cx", "cy")]
    open_ = rows.select(*kept, F.col("cx").alias("ix"), F.col("cy").alias("iy"), F.lit(0).alias("lx"), F.lit(0).alias("ly"))
    pad = F.lit(cell * 1e-9) + F.when(F.col("side") == 1, F.lit(tolerance)).otherwise(0.0)
    done: list[DataFrame] = []
    crowded = False
    for _ in range(halvings):
        full = open_.groupBy(*CELL).agg(_candidates().alias("n")).where(F.col("n") > pairs)
        if full.isEmpty():
            break
        crowded = True
        met = checkpoint(open_.join(full, list(CELL), "left"))
        done.append(met.where("n is null").select(*open_.columns))
        busy = met.where("n is not null")
        halves = {(c, h): _touches(c, h, cell, pad) for c in ("x", "y") for h in (0, 1)}
        gain = busy.groupBy(*CELL).agg(F.max("n").alias("m"), *((_candidates(halves[c, 0]) + _candidates(halves[c, 1])).alias(f"n{c}") for c in ("x", "y")))
        axis = F.when(F.least("nx", "ny") > F.col("m") * GAIN, None).when(F.col("nx") <= F.col("ny"), "x").otherwise("y")
        busy = checkpoint(busy.join(gain.select(*CELL, axis.alias("axis")), list(CELL)))
        done.append(busy.where("axis is null").select(*open_.columns))
        parts = [F.when((F.col("axis") == c) & halves[c, h], F.lit(h)) for c in ("x", "y") for h in (0, 1)]
        split = busy.where("axis is not null").withColumn("half", F.explode(F.filter(F.array(*parts), lambda v: v.isNotNull())))
        new = {f"i{c}": F.when(F.col("axis") == c, F.col(f"i{c}") * 2 + F.col("half")).otherwise(F.col(f"i{c}")) for c in ("x", "y")}
        new |= {f"l{c}": F.when(F.col("axis") == c, F.col(f"l{c}") + 1).otherwise(F.col(f"l{c}")) for c in ("x", "y")}
        open_ = checkpoint(split.withColumns(new).select(*open_.columns))
    out = open_
    for part in done:
        out = out.unionByName(part)
    return out.select(*kept, F.xxhash64(*CELL).alias("cell")), crowded


def points_on_lines(
    lines: DataFrame, points: DataFrame, cell: float | None = None, tolerance: float = 0.0,
    line_id: str = "line_id", point_id: str = "mh_id", coords: str = "coords",
) -> DataFrame:
    """Distinct (line_id, point_id) of points (columns x and y) that lie on a line."""
    segs = explode_segments(lines, line_id, coords)
    cell = cell or cell_size(segs)
    reach = 0 if tolerance == 0 else int(tolerance // cell) + 1
    spots = points.select(F.lit(1).alias("side"), F.col(point_id).alias("point"), *(F.col(c).alias(f"{c}{i}") for i in (1, 2) for c in ("x", "y")))
    for c in ("x", "y"):
        home = F.floor(F.col(f"{c}1") / cell)
        spots = spots.withColumn(f"c{c}", F.explode(F.sequence(home - reach, home + reach)) if reach else home)
    rows = _cells(segs, cell).withColumnRenamed(line_id, "line").withColumn("side", F.lit(0)).unionByName(spots, allowMissingColumns=True)
    rows, crowded = leaves(rows, cell, tolerance)
    join = hub_join if crowded else shuffled_join
    a = rows.where("side = 0").select("cell", "line", "x1", "y1", "x2", "y2")
    b = rows.where("side = 1").select("cell", "point", F.col("x1").alias("px"), F.col("y1").alias("py"))
    hit = G.point_on_segment(*(F.col(c) for c in ("px", "py", "x1", "y1", "x2", "y2")), tolerance)
    return join(a, b, "cell").where(hit).select(F.col("line").alias(line_id), F.col("point").alias(point_id)).distinct()


def lines_meeting(lines: DataFrame, cell: float | None = None, line_id: str = "line_id", coords: str = "coords") -> DataFrame:
    """Distinct (src, dst) of different lines that share a point, in both directions."""
    segs = explode_segments(lines, line_id, coords)
    cell = cell or cell_size(segs)
    rows, crowded = leaves(_cells(segs, cell).withColumn("side", F.lit(2)), cell)
    join = hub_join if crowded else shuffled_join
    ends = ("x1", "y1", "x2", "y2")
    a = rows.select("cell", F.col(line_id).alias("src"), *(F.col(c).alias(f"a_{c}") for c in ends))
    b = rows.select("cell", F.col(line_id).alias("dst"), *(F.col(c).alias(f"b_{c}") for c in ends))
    meet = G.segments_meet(tuple(F.col(f"a_{c}") for c in ends), tuple(F.col(f"b_{c}") for c in ends))
    one_way = join(a, b, "cell").where((F.col("src") < F.col("dst")) & meet).select("src", "dst").distinct()
    return one_way.unionByName(one_way.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
