"""Queries from layers to per-split graphs. Each entry is (query, SQL)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import encode as E
from linkloom.functions import geometry as G
from linkloom.operators import components as C
from linkloom.operators import graph as R
from linkloom.operators import ids as I
from linkloom.operators import sampling as S
from linkloom.operators import spatial_join as J
from linkloom.plans import fixtures as X
from linkloom.sources import tables as T

SEED = 42
FAN_OUT = (20, 10)


def line_anchor_join(spark: SparkSession, d: str) -> DataFrame:
    return J.points_on_lines(X.lines(spark, d), X.anchors(spark, d))


HITS = "hits AS (SELECT DISTINCT line_id, mh_id FROM lines JOIN anchors ON x BETWEEN least(x1, x2) AND greatest(x1, x2) AND y BETWEEN least(y1, y2) AND greatest(y1, y2))"


def line_pairs(spark: SparkSession, d: str) -> DataFrame:
    return R.anchor_pairs(line_anchor_join(spark, d))


def line_point_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.lines_with_points(line_anchor_join(spark, d))


PAIRS = "pairs AS (SELECT a.line_id, a.mh_id AS src, b.mh_id AS dst FROM hits a JOIN hits b ON a.line_id = b.line_id AND a.mh_id < b.mh_id)"


def _written_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The pairs for a query that reads them more than once: the spatial join behind them runs once."""
    return C.checkpoint(line_pairs(spark, d))


def _components(spark: SparkSession, d: str, pairs: DataFrame | None = None) -> DataFrame:
    edges = (line_pairs(spark, d) if pairs is None else pairs).select(F.col("src").alias("u"), F.col("dst").alias("v"))
    return C.label_components(X.anchors(spark, d).select("mh_id"), edges, "mh_id").select("mh_id", "component")


BASE = f"WITH RECURSIVE {X.ANCHORS}, {X.LINES}, {HITS}, {PAIRS}"
COMPONENTS = """both_ways AS (SELECT DISTINCT src, dst FROM pairs UNION SELECT DISTINCT dst, src FROM pairs),
reach(n, m) AS (SELECT mh_id, mh_id FROM anchors UNION SELECT e.dst, r.m FROM reach r JOIN both_ways e ON e.src = r.n AND r.m < e.dst),
comp AS (SELECT n AS mh_id, min(m) AS component FROM reach GROUP BY n)"""


def component_size_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Anchors and lines to pair edges, components, and how many components have each size."""
    return C.component_sizes(_components(spark, d)).groupBy("size").agg(F.count("*").alias("n_components"))


def component_order(spark: SparkSession, d: str) -> DataFrame:
    """Nodes laid out component by component, small components first."""
    labelled = _components(spark, d)
    return I.dense_id(labelled.join(C.component_sizes(labelled), "component"), ["size", "component", "mh_id"], "pos")


def _split(spark: SparkSession, d: str, pairs: DataFrame | None = None) -> DataFrame:
    labelled = C.checkpoint(_components(spark, d, pairs))
    return labelled.join(S.ratio_split(labelled, seed=SEED), "component").select("mh_id", "component", "split")


SPLIT = f"""ordered AS (SELECT component, row_number() OVER (ORDER BY md5(concat(component, '|', {SEED})), component) - 1 AS pos, count(*) OVER () AS n
  FROM (SELECT DISTINCT component FROM comp)),
split AS (SELECT mh_id, component, CASE WHEN pos < n * 6 // 10 THEN 'train' WHEN pos < n * 6 // 10 + n * 2 // 10 THEN 'val' ELSE 'test' END AS split
  FROM comp JOIN ordered USING (component))"""


def _near_pairs(spark: SparkSession, d: str) -> DataFrame:
    return X.near(spark, d).select(F.col("mh_id").alias("index_mh"), F.col("near_fid").alias("index_road"), "near_pos", "near_dist", "side")


def exported_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each split as WKT text."""
    pairs = _written_pairs(spark, d)
    at = _split(spark, d, pairs).select("mh_id", "split")
    hit = pairs.join(at.withColumnRenamed("mh_id", "src"), "src").select("line_id", "split").distinct()
    return X.lines(spark, d).join(hit, "line_id").select("line_id", "split", G.to_wkt(F.col("coords")).alias("wkt"))


def parsed_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines written as text, read back, and taken apart into vertices (y, x)."""
    text = X.lines(spark, d).select("line_id", G.to_wkt(F.col("coords")).alias("wkt"))
    points = text.select("line_id", F.posexplode(G.from_wkt(F.col("wkt"))).alias("pos", "p"))
    return points.select("line_id", "pos", G.swap_xy(F.col("p")).alias("s")).select("line_id", "pos", F.col("s.y").alias("y"), F.col("s.x").alias("x"))


def _two_layers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    o = X.read(spark, d, "orders").select(
        k.alias("line_id"), F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("material"), F.col("o_orderstatus").alias("seg"), "o_custkey"
    )
    one = o.where("seg = 'F'").select("line_id", "material", "seg")
    two = o.where("seg <> 'F'").select("line_id", "seg", F.col("o_custkey").alias("owner"))
    return one, R.drop_duplicate_rows(two.unionByName(two))


def line_layer_union(spark: SparkSession, d: str) -> DataFrame:
    return R.union_layers(*_two_layers(spark, d))


def null_free_lines(spark: SparkSession, d: str) -> DataFrame:
    return R.drop_any_null(X.lines(spark, d)).select("line_id", "material", "seg")


def anchors_with_near(spark: SparkSession, d: str) -> DataFrame:
    """Manholes with near fields, united with pumps, which lack them and are dropped as null."""
    c = X.read(spark, d, "customer")
    use = F.nullif(F.concat(F.lit("U"), (F.col("c_nationkey") % 7).cast("string")), F.lit("U3"))
    sub = F.when(F.col("c_custkey") % 11 != 0, F.col("c_mktsegment"))
    x, y = X._lattice("c_custkey")
    mh = c.select(F.col("c_custkey").alias("mh_id"), R.composite_category(sub, use).alias("category"), x.alias("x"), y.alias("y"))
    mh = mh.join(X.near(spark, d), "mh_id", "inner")
    sx, sy = X._lattice("s_suppkey")
    pumps = X.read(spark, d, "supplier").select((F.col("s_suppkey") + 10**9).alias("mh_id"), F.lit("PUMP").alias("category"), sx.alias("x"), sy.alias("y"))
    return R.drop_any_null(R.union_layers(mh, pumps)).select("mh_id", "category", "near_fid", "near_pos", X.r6(F.col("near_dist")).alias("near_dist"), "side")


def _roads(spark: SparkSession, d: str) -> DataFrame:
    """Roads near an anchor, open ones only, numbered in the order of fid."""
    used = R.rows_in(X.roads(spark, d), "fid", X.near(spark, d), "near_fid")
    return I.dense_id(used.where(~G.is_closed(F.col("coords"))), ["fid"], "road_id")


def _edges_of(df: DataFrame, column: str, q: int = 5) -> list[float]:
    """Inner quantile edges, linearly interpolated between ranks of a global order; equal ones are an error.

    The ranks come from range partitions, so no task holds the column; 2 q rows reach the driver.
    """
    ranked = I.dense_id(df.where(F.col(column).isNotNull()).select(column), [column], "rank")
    n = ranked.count()
    places = [(n - 1) * i / q for i in range(1, q)] if n else []
    wanted = sorted({r for p in places for r in (int(p), min(int(p) + 1, n - 1))})
    at = {r["rank"]: r[column] for r in ranked.where(F.col("rank").isin(wanted)).collect()} if wanted else {}
    got = [at[int(p)] + (at[min(int(p) + 1, n - 1)] - at[int(p)]) * (p - int(p)) for p in places]
    if len(set(got)) < len(got):
        raise ValueError(f"quantile edges of {column} repeat: {got}")
    return got


GRID = G.TransverseMercator(lon0=153.0)


def _degrees(coords: Column) -> Column:
    """Coordinates of the lattice as degrees around (153, -27)."""
    return F.transform(coords, lambda p: G.point(F.lit(152.5) + p["x"] / 50, F.lit(-27.9) + p["y"] / 500))


def road_features(spark: SparkSession, d: str) -> DataFrame:
    """Bearing, length bin, and the centroid in the projected plane as degrees."""
    roads = _roads(spark, d)
    angle = G.bearing(G.first_point(F.col("coords")), G.last_point(F.col("coords")))
    edges = _edges_of(roads, "shape_leng")
    roads = roads.withColumn("mid", G.projected_centroid(_degrees(F.col("coords")), GRID))
    mid = F.col("mid")
    return roads.select(
        "road_id", "fid", X.r6(angle).alias("angle"), G.angle_bin(angle).alias("angle_bin"),
        E.quantile_bin(F.col("shape_leng"), edges).alias("len_bin"),
        X.r6(mid["x"]).alias("x_coordinate"), X.r6(mid["y"]).alias("y_coordinate"),
    )


USED_ROADS = """used AS (SELECT *, row_number() OVER (ORDER BY fid) - 1 AS road_id FROM roads
  WHERE fid IN (SELECT near_fid FROM near_t) AND NOT (x1 = x2 AND y1 = y2))"""


def mh_road_edges(spark: SparkSession, d: str, numbers: DataFrame | None = None) -> DataFrame:
    near = X.near(spark, d).where("near_dist < 100")
    numbers = _roads(spark, d).select("road_id", "fid") if numbers is None else numbers
    edges = numbers.join(near.hint("merge"), F.col("fid") == F.col("near_fid"))
    return edges.select(
        F.col("mh_id").alias("index_mh"), F.col("road_id").alias("index_road"), "near_pos", "side",
        E.quantile_bin(F.col("near_dist"), _edges_of(edges, "near_dist")).alias("dist_bin"),
    )


def road_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Node features of roads, as (road_id, pos, value): coordinates, then one-hot bins of angle and length."""
    r = road_features(spark, d)
    x = F.concat(F.array("x_coordinate", "y_coordinate"), E.one_hot(F.col("angle_bin"), range(6)), E.one_hot(F.col("len_bin"), range(5)))
    return r.select("road_id", F.posexplode(x).alias("pos", "value"))


def near_edge_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Attributes of near edges, as (index_mh, index_road, pos, value): place, side, then the one-hot distance bin."""
    e = mh_road_edges(spark, d)
    x = F.concat(F.array(F.col("near_pos").cast("double"), F.col("side").cast("double")), E.one_hot(F.col("dist_bin"), range(5)))
    return e.select("index_mh", "index_road", F.posexplode(x).alias("pos", "value"))


def road_graph(spark: SparkSession, d: str) -> DataFrame:
    return R.without_self_loops(J.lines_meeting(X.roads(spark, d), line_id="fid"))


def _o(a: str, b: str, c: str) -> str:
    return f"((({b[0]}) - ({a[0]})) * (({c[1]}) - ({a[1]})) - (({b[1]}) - ({a[1]})) * (({c[0]}) - ({a[0]})))"


def _road_graph_select() -> str:
    a1, a2, b1, b2 = (("a.x1", "a.y1"), ("a.x2", "a.y2"), ("b.x1", "b.y1"), ("b.x2", "b.y2"))
    return f"""SELECT a.fid AS src, b.fid AS dst FROM roads a JOIN roads b ON a.fid <> b.fid
      AND least(a.x1, a.x2) <= greatest(b.x1, b.x2) AND least(b.x1, b.x2) <= greatest(a.x1, a.x2)
      AND least(a.y1, a.y2) <= greatest(b.y1, b.y2) AND least(b.y1, b.y2) <= greatest(a.y1, a.y2)
      AND sign({_o(a1, a2, b1)}) * sign({_o(a1, a2, b2)}) <= 0 AND sign({_o(b1, b2, a1)}) * sign({_o(b1, b2, a2)}) <= 0"""


def multipart_boundary(spark: SparkSession, d: str) -> DataFrame:
    """Boundary points of two-part lines: the ends that aren't shared."""
    x, y = X._lattice("o_custkey")
    k = F.col("o_orderkey")
    a, b = G.line((x, y), (x + 1, y)), G.line((x + 1, y), (x + k % 2, y + k % 3))
    out = X.read(spark, d, "orders").select(k.alias("line_id"), G.boundary(F.array(a, b)).alias("ends"))
    return out.select("line_id", F.size("ends").alias("n_ends"), F.try_element_at("ends", F.lit(1))["x"].alias("x1"), F.try_element_at("ends", F.lit(2))["y"].alias("y2"))


def road_rotation(spark: SparkSession, d: str) -> DataFrame:
    """Rotation of the roads that meet a window."""
    r = X.roads(spark, d).where(G.overlaps_window(F.col("coords"), 10.0, 5.0, 25.0, 30.0))
    return r.select("fid", X.r6(G.rotation(G.flatten_parts(F.array("coords")))).alias("rotation"))


def layer_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Near and interim tables and a split graph written, and read back by their schemas; the number and a digest of all rows of each."""
    at = f"{C.shared_folder(spark)}/layers-{uuid.uuid4().hex}"
    near = X.near(spark, d).withColumn("objectid", F.col("mh_id")).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in T.NEAR))
    near.write.parquet(f"{at}/near")
    anchors, roads, lines = X.anchors(spark, d), X.roads(spark, d), X.lines(spark, d)
    split = anchors.select("mh_id", F.when(S.draw(SEED, 10, "mh_id") < 6, "train").otherwise("test").alias("split"))
    T.write_interim(dict(zip(T.INTERIM, (anchors, roads, lines, T.read_near(spark, f"{at}/near"), _near_pairs(spark, d), split), strict=True)), f"{at}/interim")
    tables = T.read_interim(spark, f"{at}/interim")
    T.write_splits(tables["split"].join(tables["anchors"], "mh_id"), f"{at}/graph", ["train", "test"])
    def rows(df: DataFrame, name: str, *columns: Column) -> DataFrame:
        text = F.concat_ws("|", *(c.cast("string") for c in columns))
        digest = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
        return df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum(digest).alias("digest"))

    def whole(c: Column, by: int = 1) -> Column:
        return F.round(c * by).cast("long")

    end = F.element_at("coords", 2)
    counts = [
        rows(tables["anchors"], "anchors", F.col("mh_id"), whole(F.col("x")), whole(F.col("y")), F.col("subtypecd")),
        rows(tables["roads"], "roads", F.col("fid"), whole(F.col("shape_leng"), 100), F.col("cat"), whole(end["x"]), whole(end["y"])),
        rows(tables["lines"], "lines", F.col("line_id"), F.coalesce("material", F.lit("")), F.col("seg"), whole(end["x"], 16), whole(end["y"], 16)),
        rows(tables["near_edges"], "near_edges", F.col("mh_id"), F.col("near_fid"), whole(F.col("near_pos"), 1000), whole(F.col("near_dist"), 10_000), F.col("side")),
        *(rows(T.read_split(spark, f"{at}/graph", s), s, F.col("mh_id"), whole(F.col("x")), whole(F.col("y"))) for s in ("train", "test")),
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    out = C.checkpoint(out)
    C.remove(spark, at)
    return out


def projected_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Anchors, as degrees around (153, -27), in metres and back."""
    p = G.point(F.lit(152.5) + F.col("x") / 50, F.lit(-27.9) + F.col("y") / 500)
    a = X.anchors(spark, d).select("mh_id", p.alias("p")).withColumn("m", GRID.project(F.col("p"))).withColumn("q", GRID.unproject(F.col("m")))
    return a.select(
        "mh_id", F.round("m.x", 3).alias("easting"), F.round("m.y", 3).alias("northing"), F.round("q.x", 8).alias("lon"), F.round("q.y", 8).alias("lat")
    )


def _forward_sql(source: str) -> str:
    """CTEs from (lon, lat, others) to a table ``plane`` with easting and northing."""
    e = 2 * GRID._n**0.5 / (1 + GRID._n)
    scale = GRID.k0 * GRID._radius
    terms = list(enumerate(GRID._forward_series(), 1))
    xi = " + ".join(f"{a!r} * sin({2 * j} * xi) * ((exp({2 * j} * eta) + exp({-2 * j} * eta)) / 2)" for j, a in terms)
    eta = " + ".join(f"{a!r} * cos({2 * j} * xi) * ((exp({2 * j} * eta) - exp({-2 * j} * eta)) / 2)" for j, a in terms)
    return f"""s AS (SELECT *, 0.5 * ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) - {e!r} * 0.5 * ln((1 + {e!r} * sin(radians(lat))) / (1 - {e!r} * sin(radians(lat)))) AS psi,
        radians(lon - {GRID.lon0}) AS dl FROM {source}),
      t AS (SELECT *, (exp(psi) - exp(-psi)) / 2 AS t FROM s),
      u AS (SELECT *, atan2(t, cos(dl)) AS xi, 0.5 * ln((1 + sin(dl) / sqrt(1 + t * t)) / (1 - sin(dl) / sqrt(1 + t * t))) AS eta FROM t),
      plane AS (SELECT *, {GRID.false_easting} + {scale!r} * (eta + {eta}) AS easting, {GRID.false_northing} + {scale!r} * (xi + {xi}) AS northing FROM u)"""


def _inverse_sql(source: str) -> str:
    """CTEs from (easting, northing, others) to a table ``ground`` with lon and lat."""
    e = 2 * GRID._n**0.5 / (1 + GRID._n)
    scale = GRID.k0 * GRID._radius
    terms = list(enumerate(GRID._inverse_series(), 1))
    xi = " - ".join(f"{a!r} * sin({2 * j} * xi) * ((exp({2 * j} * eta) + exp({-2 * j} * eta)) / 2)" for j, a in terms)
    eta = " - ".join(f"{a!r} * cos({2 * j} * xi) * ((exp({2 * j} * eta) - exp({-2 * j} * eta)) / 2)" for j, a in terms)
    steps = "".join(
        f"r{i + 1} AS (SELECT *, tanh(asinh(tau) + {e!r} * atanh({e!r} * s{i})) AS s{i + 1} FROM r{i}), " for i in range(4)
    )
    return f"""i0 AS (SELECT *, (northing - {GRID.false_northing}) / {scale!r} AS xi, (easting - {GRID.false_easting}) / {scale!r} AS eta FROM {source}),
      i1 AS (SELECT * EXCLUDE (xi, eta), xi - {xi} AS xi, eta - {eta} AS eta FROM i0),
      r0 AS (SELECT *, sin(xi) / ((exp(eta) + exp(-eta)) / 2) AS s0, s0 / sqrt(1 - s0 * s0) AS tau FROM i1), {steps}
      ground AS (SELECT *, {GRID.lon0} + degrees(atan2((exp(eta) - exp(-eta)) / 2, cos(xi))) AS lon, degrees(asin(s4)) AS lat FROM r4)"""


def _projection_sql() -> str:
    return f"""WITH {X.ANCHORS}, p AS (SELECT mh_id, 152.5 + x / 50 AS lon, -27.9 + y / 500 AS lat FROM anchors), {_forward_sql("p")}
      SELECT mh_id, round(easting, 3) AS easting, round(northing, 3) AS northing, round(lon::DOUBLE, 8) AS lon, round(lat::DOUBLE, 8) AS lat FROM plane"""


def _hetero(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    pairs = _written_pairs(spark, d)
    nodes = C.checkpoint(_split(spark, d, pairs).select(F.col("mh_id").alias("node_id"), "split"))
    numbers = C.checkpoint(_roads(spark, d).select("road_id", "fid"))
    near = C.checkpoint(mh_road_edges(spark, d, numbers))
    rr = road_graph(spark, d).join(numbers.select(F.col("fid").alias("src"), F.col("road_id").alias("s")), "src")
    rr = rr.join(numbers.select(F.col("fid").alias("dst"), F.col("road_id").alias("t")), "dst").select(F.col("s").alias("src"), F.col("t").alias("dst"))
    parts = R.induced(nodes, pairs.select("src", "dst").distinct(), near, rr)
    mh = I.dense_id_within(nodes.withColumnRenamed("node_id", "old"), "split", ["old"], "new")
    road = I.dense_id_within(parts["roads"].withColumnRenamed("road_id", "old"), "split", ["old"], "new")
    return parts | {"mh_map": C.checkpoint(mh), "road_map": C.checkpoint(road)}


def split_node_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of every split's graph, numbered from 0 within split and type."""
    h = _hetero(spark, d)
    return h["mh_map"].select("split", F.lit("MH").alias("type"), "old", "new").unionByName(h["road_map"].select("split", F.lit("Road").alias("type"), "old", "new"))


def split_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of every split's graph with relabelled ends: pipes as stored, roads mirrored, near and its reverse."""
    h = _hetero(spark, d)

    def ends(df: DataFrame, rel: str, src: str, dst: str) -> DataFrame:
        df = df.select("split", "src", "dst")
        df = I.relabel(I.relabel(df, "src", h[src], on=["split"]), "dst", h[dst], on=["split"])
        return df.select("split", F.lit(rel).alias("rel"), "src", "dst")

    near = h["near"].select("split", F.col("index_mh").alias("src"), F.col("index_road").alias("dst"))
    out = ends(h["pipes"].select("split", "src", "dst"), "link", "mh_map", "mh_map")
    out = out.unionByName(ends(R.symmetric(h["road_road"].select("split", "src", "dst")), "road", "road_map", "road_map"))
    out = out.unionByName(ends(near, "near", "mh_map", "road_map"))
    return out.unionByName(ends(R.reversed_relation(near), "rev_near", "road_map", "mh_map"))


SPLITS = ("train", "val", "test")


def _labelled_by_split(h: dict[str, DataFrame]) -> DataFrame:
    """(split, src, dst, label) with the numbers of each split's graph: its pipes, and as many drawn non-edges."""
    pipes = I.relabel(I.relabel(h["pipes"].select("split", "src", "dst"), "src", h["mh_map"], on=["split"]), "dst", h["mh_map"], on=["split"])
    pipes = C.checkpoint(pipes.where("src is not null and dst is not null").distinct())
    size = {r["split"]: r["count"] for r in h["mh_map"].groupBy("split").count().collect()}  # a number per split
    out = None
    for name in SPLITS:
        own = pipes.where(F.col("split") == name).select("src", "dst")
        part = R.labelled_edges(own, S.negative_edges(own, size.get(name, 0), seed=SEED)).select(F.lit(name).alias("split"), "src", "dst", "label")
        out = part if out is None else out.unionByName(part)
    return out


def split_labelled_edges(spark: SparkSession, d: str) -> DataFrame:
    """Supervised edges of every split's graph."""
    return _labelled_by_split(_hetero(spark, d))


def split_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of both types, pipes and labelled edges of every split's graph."""
    h = _hetero(spark, d)
    return R.split_statistics({"mh": h["mh_map"], "road": h["road_map"], "pipes": h["pipes"], "labelled": _labelled_by_split(h)})


HETERO = f"""near_e AS (SELECT mh_id AS index_mh, road_id AS index_road FROM used JOIN near_t ON fid = near_fid WHERE near_dist < 100),
near_s AS (SELECT n.*, s.split FROM near_e n JOIN split s ON s.mh_id = n.index_mh),
road_s AS (SELECT DISTINCT index_road AS road_id, split FROM near_s),
mh_map AS (SELECT mh_id AS old, split, row_number() OVER (PARTITION BY split ORDER BY mh_id) - 1 AS new FROM split),
road_map AS (SELECT road_id AS old, split, row_number() OVER (PARTITION BY split ORDER BY road_id) - 1 AS new FROM road_s)"""
PIPES_SPLIT = "pe AS (SELECT DISTINCT p.src, p.dst, s.split FROM pairs p JOIN split s ON s.mh_id IN (p.src, p.dst))"
ROAD_GRAPH = f"rg AS ({_road_graph_select()})"
BASE_SPLIT = f"{BASE}, {X.NEAR}, {X.ROADS}, {COMPONENTS}, {SPLIT}, {USED_ROADS}"


def either_end_pipes(spark: SparkSession, d: str) -> DataFrame:
    """Pair edges with an end among the anchors of one market segment."""
    ids = X.anchors(spark, d).where("subtypecd = 'MACHINERY'")
    return R.either_end_in(line_pairs(spark, d), ids, "mh_id")


def segment_edges(spark: SparkSession, d: str) -> DataFrame:
    """Pair edges with both ends outside one market segment, and the lines they come from."""
    ids = X.anchors(spark, d).where("subtypecd <> 'BUILDING'")
    both = R.both_ends_in(line_pairs(spark, d), ids, "mh_id")
    return both.join(X.lines(spark, d).select("line_id", "seg"), "line_id")


def anchor_features(spark: SparkSession, d: str) -> DataFrame:
    """Coordinates and the one-hot category over the sorted vocabulary, as (mh_id, pos, value)."""
    a = X.anchors(spark, d).withColumn("subtypecd", F.nullif("subtypecd", F.lit("BUILDING")))
    vocabulary = a.agg(F.array_sort(F.collect_set("subtypecd")).alias("v")).first()["v"]  # categories, not rows
    x = F.concat(F.array("x", "y"), E.one_hot(F.col("subtypecd"), vocabulary))
    return a.select("mh_id", F.posexplode(x).alias("pos", "value"))


def _positive(spark: SparkSession, d: str) -> DataFrame:
    return C.checkpoint(line_pairs(spark, d).select("src", "dst").distinct())


def _negative(spark: SparkSession, d: str, positive: DataFrame) -> DataFrame:
    return S.negative_edges(positive, X.read(spark, d, "customer").count(), seed=SEED)


def negative_edges(spark: SparkSession, d: str) -> DataFrame:
    return _negative(spark, d, _positive(spark, d))


LABELLED_SPLIT = f"""ps AS (SELECT DISTINCT pe.split, a.new AS src, b.new AS dst FROM pe JOIN mh_map a ON a.old = pe.src AND a.split = pe.split JOIN mh_map b ON b.old = pe.dst AND b.split = pe.split),
size_s AS (SELECT split, (SELECT count(*) FROM ps WHERE ps.split = m.split) AS e, count(*) AS n FROM mh_map m GROUP BY split),
draws_s AS (SELECT split, i, {{s}} AS src, {{d}} AS dst FROM (SELECT split, n, unnest(range(2 * e)) AS i FROM size_s)),
fresh_s AS (SELECT split, src, dst, min(i) AS i FROM draws_s WHERE src <> dst GROUP BY ALL),
neg_s AS (SELECT split, row_number() OVER (PARTITION BY split ORDER BY i) AS k, src, dst FROM fresh_s f
  WHERE NOT EXISTS (SELECT 1 FROM ps p WHERE p.split = f.split AND ((p.src = f.src AND p.dst = f.dst) OR (p.src = f.dst AND p.dst = f.src)))),
labelled_s AS (SELECT split, src, dst, 1.0::DOUBLE AS label FROM ps UNION ALL SELECT split, src, dst, 0.0 FROM neg_s JOIN size_s USING (split) WHERE k <= e)"""


def _draw(kind: str, n: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', i, '{kind}', '{SEED}')), 1, 12))::BIGINT % {n}"


NEGATIVES = f"""pos AS (SELECT DISTINCT src, dst FROM pairs), size AS (SELECT (SELECT count(*) FROM pos) AS e, (SELECT count(*) FROM customer) AS n),
draws AS (SELECT i, {_draw('s', 'n')} AS src, {_draw('d', 'n')} AS dst FROM size, (SELECT unnest(range(2 * e)) AS i FROM size)),
fresh AS (SELECT src, dst, min(i) AS i FROM draws WHERE src <> dst GROUP BY src, dst),
neg AS (SELECT row_number() OVER (ORDER BY i) - 1 AS draw_id, src, dst FROM fresh f
  WHERE NOT EXISTS (SELECT 1 FROM pos p WHERE (p.src = f.src AND p.dst = f.dst) OR (p.src = f.dst AND p.dst = f.src)))"""


def supervised_edges(spark: SparkSession, d: str) -> DataFrame:
    positive = _positive(spark, d)
    return R.labelled_edges(positive, _negative(spark, d, positive))


def mini_batches(spark: SparkSession, d: str) -> DataFrame:
    """Shuffled batches of 128 pair edges."""
    return S.mini_batches(line_pairs(spark, d).select("src", "dst").distinct(), 128, ["src", "dst"], SEED)


def first_batches(spark: SparkSession, d: str) -> DataFrame:
    """The first ten of them, as a round of training with a limit takes."""
    return S.mini_batches(line_pairs(spark, d).select("src", "dst").distinct(), 128, ["src", "dst"], SEED, max_batches=10)


def sampled_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Two hops of at most 20 and 10 neighbours per relation around all vectors, in batches of three."""
    v = X.vectors(spark, d)
    seeds = v.select((F.col("id") % 3).alias("batch_id"), F.col("id").alias("node"))
    e = X.vector_edges(spark, d)
    rels = e.select(F.lit("link").alias("rel"), "src", "dst").unionByName(e.select(F.lit("rev").alias("rel"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    return S.sample_neighbours(seeds, rels, FAN_OUT, SEED)


def _hop_sql(hop: int, frontier: str) -> str:
    return f"""hop{hop} AS (SELECT batch_id, {hop} AS hop, rel, src, dst FROM (SELECT f.batch_id, r.*, row_number() OVER (PARTITION BY f.batch_id, rel, dst
      ORDER BY md5(concat_ws('|', f.batch_id, {hop}, rel, src, dst, '{SEED}')), src) AS k FROM {frontier} f JOIN rels r ON r.dst = f.node) WHERE k <= {FAN_OUT[hop - 1]})"""


SAMPLE_SQL = f"""WITH {X.VECTORS}, {X.VECTOR_EDGES}, rels AS (SELECT 'link' AS rel, src, dst FROM vedges UNION ALL SELECT 'rev', dst, src FROM vedges),
  f1 AS (SELECT DISTINCT id % 3 AS batch_id, id AS node FROM vectors), {_hop_sql(1, 'f1')},
  f2 AS (SELECT DISTINCT batch_id, src AS node FROM hop1), {_hop_sql(2, 'f2')} SELECT * FROM hop1 UNION ALL SELECT * FROM hop2"""

QBIN = "CASE WHEN {c} IS NULL THEN NULL ELSE " + " + ".join(f"({{c}} > q[{i}])::INT" for i in range(1, 5)) + " END"

def _round_trip_sql() -> str:
    def rows(name: str, source: str, *columns: str) -> str:
        return f"SELECT '{name}' AS name, count(*) AS n, sum(('0x' || substr(md5(concat_ws('|', {', '.join(columns)})), 1, 8))::BIGINT)::BIGINT AS digest FROM {source}"

    def whole(c: str, by: int = 1) -> str:
        return f"round({c} * {by})::BIGINT"

    parts = [
        rows("anchors", "anchors", "mh_id", whole("x"), whole("y"), "subtypecd"),
        rows("roads", "roads", "fid", whole("shape_leng", 100), "cat", whole("x2"), whole("y2")),
        rows("lines", "lines", "line_id", "coalesce(material, '')", "seg", whole("x2", 16), whole("y2", 16)),
        rows("near_edges", "near_t", "mh_id", "near_fid", whole("near_pos", 1000), whole("near_dist", 10_000), "side"),
        *(rows(s, f"(SELECT * FROM s WHERE train = {s == 'train'})", "mh_id", whole("x"), whole("y")) for s in ("train", "test")),
    ]
    return f"""WITH {X.ANCHORS}, {X.LINES}, {X.ROADS}, {X.NEAR},
      s AS (SELECT mh_id, x, y, ('0x' || substr(md5(concat_ws('|', mh_id, '{SEED}')), 1, 12))::BIGINT % 10 < 6 AS train FROM anchors) """ + " UNION ALL ".join(parts)


QUERIES = {
    "line_anchor_join": (line_anchor_join, f"{BASE} SELECT * FROM hits"),
    "line_point_counts": (line_point_counts, f"{BASE} SELECT line_id, count(*) AS n_points FROM hits GROUP BY 1 HAVING count(*) >= 2"),
    "line_pairs": (line_pairs, f"{BASE} SELECT * FROM pairs"),
    "graph_components": (_components, f"{BASE}, {COMPONENTS} SELECT * FROM comp"),
    "component_size_histogram": (
        component_size_histogram,
        f"{BASE}, {COMPONENTS} SELECT size, count(*) AS n_components FROM (SELECT count(*) AS size FROM comp GROUP BY component) GROUP BY size",
    ),
    "component_order": (
        component_order,
        f"{BASE}, {COMPONENTS}, sized AS (SELECT *, count(*) OVER (PARTITION BY component) AS size FROM comp) "
        "SELECT component, mh_id, size, row_number() OVER (ORDER BY size, component, mh_id) - 1 AS pos FROM sized",
    ),
    "component_split": (_split, f"{BASE}, {COMPONENTS}, {SPLIT} SELECT * FROM split"),
    "split_statistics": (
        split_statistics,
        f"""{BASE_SPLIT}, {HETERO}, {PIPES_SPLIT}, {LABELLED_SPLIT.format(s=_draw("s", "n"), d=_draw("d", "n"))},
        e AS (SELECT DISTINCT p.*, s.split FROM (SELECT DISTINCT src, dst FROM pairs) p JOIN split s ON s.mh_id IN (p.src, p.dst))
        SELECT split, count(*) AS n_mh, (SELECT count(*) FROM road_map r WHERE r.split = m.split) AS n_road, (SELECT count(*) FROM e WHERE e.split = m.split) AS n_pipes,
        (SELECT count(*) FROM labelled_s l WHERE l.split = m.split) AS n_labelled FROM mh_map m GROUP BY split""",
    ),
    "split_labelled_edges": (
        split_labelled_edges,
        f"""{BASE_SPLIT}, {HETERO}, {PIPES_SPLIT}, {LABELLED_SPLIT.format(s=_draw("s", "n"), d=_draw("d", "n"))} SELECT * FROM labelled_s""",
    ),
    "exported_lines": (
        exported_lines,
        f"""{BASE}, {COMPONENTS}, {SPLIT} SELECT DISTINCT line_id, split, 'LINESTRING (' || x1 || ' ' || y1 || ', ' || x2 || ' ' || y2 || ')' AS wkt
        FROM lines JOIN pairs USING (line_id) JOIN split ON mh_id = src""",
    ),
    "parsed_lines": (
        parsed_lines,
        f"WITH {X.ANCHORS}, {X.LINES} SELECT line_id, 0 AS pos, y1 AS y, x1 AS x FROM lines UNION ALL SELECT line_id, 1, y2, x2 FROM lines",
    ),
    "line_layer_union": (
        line_layer_union,
        """SELECT o_orderkey AS line_id, nullif(o_orderpriority, '5-LOW') AS material, o_orderstatus AS seg, NULL::BIGINT AS owner FROM orders WHERE o_orderstatus = 'F'
        UNION ALL SELECT o_orderkey, NULL, o_orderstatus, o_custkey FROM orders WHERE o_orderstatus <> 'F'""",
    ),
    "null_free_lines": (null_free_lines, f"WITH {X.LINES} SELECT line_id, material, seg FROM lines WHERE material IS NOT NULL AND seg IS NOT NULL"),
    "anchors_with_near": (
        anchors_with_near,
        f"""WITH {X.NEAR} SELECT mh_id, CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment ELSE 'nan' END || 'U' || (c_nationkey % 7) AS category, near_fid, near_pos,
        round(near_dist, 6) + 0.0 AS near_dist, side FROM customer JOIN near_t ON mh_id = c_custkey WHERE c_nationkey % 7 <> 3 AND c_mktsegment IS NOT NULL""",
    ),
    "road_features": (
        road_features,
        f"""WITH {X.NEAR}, {X.ROADS}, {USED_ROADS}, b AS (SELECT quantile_cont(shape_leng, [0.2, 0.4, 0.6, 0.8]) AS q FROM used),
        a AS (SELECT *, degrees(CASE WHEN atan2(x2 - x1, y2 - y1) < 0 THEN atan2(x2 - x1, y2 - y1) + pi() ELSE atan2(x2 - x1, y2 - y1) END) AS raw FROM used),
        c AS (SELECT *, CASE WHEN raw >= 180 THEN raw - 180 ELSE raw END AS angle FROM a),
        ends AS (SELECT road_id AS rid, 152.5 + x1 / 50 AS lon, -27.9 + y1 / 500 AS lat FROM used UNION ALL SELECT road_id, 152.5 + x2 / 50, -27.9 + y2 / 500 FROM used),
        {_forward_sql("ends")}, middle AS (SELECT rid, avg(easting) AS easting, avg(northing) AS northing FROM plane GROUP BY rid), {_inverse_sql("middle")}
        SELECT road_id, fid, round(angle, 6) + 0.0 AS angle, CASE WHEN angle < 15 OR angle >= 165 THEN 0 ELSE floor((angle - 15) / 30)::INT + 1 END AS angle_bin,
        {QBIN.format(c='shape_leng')} AS len_bin, round(lon, 6) + 0.0 AS x_coordinate, round(lat, 6) + 0.0 AS y_coordinate FROM c JOIN ground ON rid = road_id, b""",
    ),
    "mh_road_edges": (
        mh_road_edges,
        f"""WITH {X.NEAR}, {X.ROADS}, {USED_ROADS}, e AS (SELECT * FROM used JOIN near_t ON fid = near_fid WHERE near_dist < 100),
        b AS (SELECT quantile_cont(near_dist, [0.2, 0.4, 0.6, 0.8]) AS q FROM e)
        SELECT mh_id AS index_mh, road_id AS index_road, near_pos, side, {QBIN.format(c='near_dist')} AS dist_bin FROM e, b""",
    ),
    "road_graph": (road_graph, f"WITH {X.ROADS} {_road_graph_select()}"),
    "multipart_boundary": (
        multipart_boundary,
        """SELECT o_orderkey AS line_id, CASE WHEN ex = x AND ey = y THEN 0 ELSE 2 END AS n_ends,
        CASE WHEN ex = x AND ey = y THEN NULL ELSE x END AS x1, CASE WHEN ex = x AND ey = y THEN NULL ELSE ey END AS y2
        FROM (SELECT *, (o_custkey % 50)::DOUBLE AS x, (o_custkey // 50)::DOUBLE AS y, x + o_orderkey % 2 AS ex, y + o_orderkey % 3 AS ey FROM orders)""",
    ),
    "road_rotation": (
        road_rotation,
        f"""WITH {X.ROADS} SELECT fid, round(degrees(atan2(y2 - y1, x2 - x1)), 6) + 0.0 AS rotation FROM roads
        WHERE least(x1, x2) <= 25 AND greatest(x1, x2) >= 10 AND least(y1, y2) <= 30 AND greatest(y1, y2) >= 5""",
    ),
    "projected_anchors": (projected_anchors, _projection_sql()),
    "layer_round_trip": (layer_round_trip, _round_trip_sql()),
    "split_node_numbers": (
        split_node_numbers,
        f"{BASE_SPLIT}, {HETERO} SELECT split, 'MH' AS type, old, new FROM mh_map UNION ALL SELECT split, 'Road', old, new FROM road_map",
    ),
    "split_graph_edges": (
        split_graph_edges,
        f"""{BASE_SPLIT}, {HETERO}, {ROAD_GRAPH}, rr AS (SELECT a.road_id AS src, b.road_id AS dst FROM rg JOIN used a ON a.fid = src JOIN used b ON b.fid = dst),
        {PIPES_SPLIT}
        SELECT pe.split, 'link' AS rel, a.new AS src, b.new AS dst FROM pe LEFT JOIN mh_map a ON a.old = pe.src AND a.split = pe.split LEFT JOIN mh_map b ON b.old = pe.dst AND b.split = pe.split
        UNION ALL SELECT a.split, 'road', a.new, b.new FROM rr JOIN road_map a ON a.old = rr.src JOIN road_map b ON b.old = rr.dst AND a.split = b.split
        UNION ALL SELECT n.split, 'near', a.new, b.new FROM near_s n JOIN mh_map a ON a.old = index_mh AND a.split = n.split JOIN road_map b ON b.old = index_road AND b.split = n.split
        UNION ALL SELECT n.split, 'rev_near', b.new, a.new FROM near_s n JOIN mh_map a ON a.old = index_mh AND a.split = n.split JOIN road_map b ON b.old = index_road AND b.split = n.split""",
    ),
    "either_end_pipes": (
        either_end_pipes,
        f"{BASE}, chosen AS (SELECT mh_id FROM anchors WHERE subtypecd = 'MACHINERY') SELECT * FROM pairs WHERE src IN (SELECT mh_id FROM chosen) OR dst IN (SELECT mh_id FROM chosen)",
    ),
    "segment_edges": (segment_edges, f"{BASE}, chosen AS (SELECT mh_id FROM anchors WHERE subtypecd <> 'BUILDING') SELECT p.*, seg FROM pairs p JOIN lines USING (line_id) WHERE src IN (SELECT mh_id FROM chosen) AND dst IN (SELECT mh_id FROM chosen)"),
    "anchor_features": (
        anchor_features,
        f"""WITH {X.ANCHORS}, v AS (SELECT s, row_number() OVER (ORDER BY s) + 1 AS pos FROM (SELECT DISTINCT subtypecd AS s FROM anchors WHERE subtypecd <> 'BUILDING'))
        SELECT mh_id, 0 AS pos, x AS value FROM anchors UNION ALL SELECT mh_id, 1, y FROM anchors
        UNION ALL SELECT mh_id, pos::INT, (subtypecd = s)::INT::DOUBLE FROM anchors, v""",
    ),
    "negative_edges": (negative_edges, f"{BASE}, {NEGATIVES} SELECT draw_id, src, dst FROM neg, size WHERE draw_id < e"),
    "supervised_edges": (
        supervised_edges,
        f"{BASE}, {NEGATIVES} SELECT src, dst, 1.0::DOUBLE AS label FROM pos UNION ALL SELECT src, dst, 0.0 FROM neg, size WHERE draw_id < e",
    ),
    "mini_batches": (
        mini_batches,
        f"""{BASE}, b AS (SELECT src, dst, (row_number() OVER (ORDER BY md5(concat_ws('|', src, dst, '{SEED}')), src, dst) - 1) // 128 AS batch_id
        FROM (SELECT DISTINCT src, dst FROM pairs)) SELECT * FROM b""",
    ),
    "first_batches": (
        first_batches,
        f"""{BASE}, b AS (SELECT src, dst, (row_number() OVER (ORDER BY md5(concat_ws('|', src, dst, '{SEED}')), src, dst) - 1) // 128 AS batch_id
        FROM (SELECT DISTINCT src, dst FROM pairs)) SELECT * FROM b WHERE batch_id < 10""",
    ),
    "sampled_neighbours": (sampled_neighbours, SAMPLE_SQL),
}
QUERIES |= {
    "road_vectors": (
        road_vectors,
        f"""WITH f AS ({QUERIES["road_features"][1]}), c AS (SELECT road_id, unnest(list_concat([x_coordinate, y_coordinate],
        list_transform(range(6), lambda k: (angle_bin = k)::INT::DOUBLE), list_transform(range(5), lambda k: (len_bin = k)::INT::DOUBLE))) AS value, unnest(range(13)) AS pos FROM f)
        SELECT road_id, pos::INT AS pos, value FROM c""",
    ),
    "near_edge_vectors": (
        near_edge_vectors,
        f"""WITH f AS ({QUERIES["mh_road_edges"][1]}), c AS (SELECT index_mh, index_road, unnest(list_concat([near_pos::DOUBLE, side::DOUBLE],
        list_transform(range(5), lambda k: (dist_bin = k)::INT::DOUBLE))) AS value, unnest(range(7)) AS pos FROM f)
        SELECT index_mh, index_road, pos::INT AS pos, value FROM c""",
    ),
}
