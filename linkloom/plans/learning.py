"""Queries over encodings, message passing, link scores, metrics and experiment logs. Each entry is (query, SQL or None)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import encode as E
from linkloom.functions import geometry as G
from linkloom.operators import experiments as P
from linkloom.operators import link as L
from linkloom.operators import matrix as K
from linkloom.operators import metrics as M
from linkloom.operators import model as W
from linkloom.operators import propagate as N
from linkloom.operators import sampling as S
from linkloom.operators import sweep as V
from linkloom.operators.components import checkpoint, remove, shared_folder
from linkloom.plans import fixtures as X
from linkloom.plans import spatial
from linkloom.sources import files as B
from linkloom.sources import tables as T

SEED = 42


def _cells(df: DataFrame, key: str, vector, name: str = "value") -> DataFrame:
    return df.select(key, F.posexplode(vector).alias("pos", "v")).select(key, "pos", X.r6(F.col("v")).alias(name))


def position_encoding(spark: SparkSession, d: str) -> DataFrame:
    """Anchors less their centre, encoded at four frequencies."""
    a = N.from_centre(X.anchors(spark, d))
    return _cells(a, "mh_id", E.position_encoding(F.col("x"), F.col("y"), E.frequencies(4, 1.0, 100.0)))


def rectified_encoding(spark: SparkSession, d: str) -> DataFrame:
    """The same with a function applied after the encoding: ReLU, then a sum of its halves."""

    def after(e):
        half = F.size(e) / 2
        return F.concat(E.relu(e), F.array(E.dot(F.slice(e, 1, half.cast("int")), F.slice(e, half.cast("int") + 1, half.cast("int")))))

    a = N.from_centre(X.anchors(spark, d))
    return _cells(a, "mh_id", E.position_encoding(F.col("x"), F.col("y"), E.frequencies(4, 1.0, 100.0), ffn=after))


def _encoding_sql(after: bool = False) -> str:
    from math import cos, exp, log, pi, sin

    parts = []
    for k in range(4):
        f = 1.0 / (1.0 * exp(k * (log(100.0 / 1.0) / 3)))
        for axis in range(3):
            along = f"((x - cx) * {cos(2 * pi * axis / 3)!r} + (y - cy) * {sin(2 * pi * axis / 3)!r}) * {f!r}"
            parts += [f"sin({along})", f"cos({along})"]
    cells = ", ".join(f"{{'pos': {i}, 'v': {p}}}" for i, p in enumerate(parts))
    if after:
        cells = ", ".join(f"{{'pos': {i}, 'v': greatest({p}, 0)}}" for i, p in enumerate(parts))
        cells += f", {{'pos': {len(parts)}, 'v': " + " + ".join(f"{p} * {q}" for p, q in zip(parts[:12], parts[12:], strict=True)) + "}"
    return f"""WITH {X.ANCHORS}, c AS (SELECT avg(x) AS cx, avg(y) AS cy FROM anchors), e AS (SELECT mh_id, unnest([{cells}]) AS s FROM anchors, c)
      SELECT mh_id, s.pos AS pos, round(s.v, 6) + 0.0 AS value FROM e"""


def dense_layer(spark: SparkSession, d: str) -> DataFrame:
    """Vectors through a dense layer with ReLU, followed by their first two elements."""
    out = F.concat(E.dense_layer(F.col("h"), X.weights(4, 64), [0.1, 0.0, -0.1, 0.2]), F.slice("h", 1, 2))
    return _cells(X.vectors(spark, d), "id", out)


def _lin(i: int, rows: int, cols: int, h: str) -> str:
    return " + ".join(f"{w!r} * {h}[{j + 1}]" for j, w in enumerate(X.weights(rows, cols)[i]))


def _unnest(expressions: list[str]) -> str:
    return "unnest([" + ", ".join(f"{{'pos': {i}, 'v': {e}}}" for i, e in enumerate(expressions)) + "])"


DENSE_SQL = f"""WITH {X.VECTORS}, e AS (SELECT id, {_unnest([f"greatest({_lin(i, 4, 64, 'h')} + {b}, 0)" for i, b in enumerate((0.1, 0.0, -0.1, 0.2))] + ['h[1]', 'h[2]'])} AS s FROM vectors)
  SELECT id, s.pos AS pos, round(s.v, 6) + 0.0 AS value FROM e"""


#: Anchors of a task, each of which gives 256 rows.
WIDE_ROWS = 4_000


def wide_layers(spark: SparkSession, d: str) -> DataFrame:
    """The position encoding of every anchor (96 numbers) through two layers of 256."""
    a = K.spread(N.from_centre(X.anchors(spark, d)).select("mh_id", "x", "y"), WIDE_ROWS)
    e = a.select("mh_id", E.position_encoding(F.col("x"), F.col("y"), E.frequencies(16, 1.0, 100.0)).alias("e"))
    out = K.dense_stack(e, ["mh_id"], "e", [(X.weights(256, 96), [0.05] * 256, True), (X.weights(256, 256), None, False)])
    return _cells(out, "mh_id", F.col("h"))


def _weights_sql(rows: int, cols: int) -> str:
    return f"list_transform(range({rows}), lambda i: list_transform(range({cols}), lambda j: ((i * 7 + j * 3) % 11 - 5) / 10))"


def _wide_sql() -> str:
    from math import cos, exp, log, pi, sin

    axes = [(cos(2 * pi * k / 3), sin(2 * pi * k / 3)) for k in range(3)]
    freqs = [1.0 / exp(k * (log(100.0) / 15)) for k in range(16)]
    parts = ", ".join(f"{g}(((x - cx) * {a!r} + (y - cy) * {b!r}) * {f!r})" for f in freqs for a, b in axes for g in ("sin", "cos"))
    return f"""WITH {X.ANCHORS}, c AS (SELECT avg(x) AS cx, avg(y) AS cy FROM anchors), e AS MATERIALIZED (SELECT mh_id, [{parts}] AS e FROM anchors, c),
      w AS MATERIALIZED (SELECT {_weights_sql(256, 96)} AS w1, {_weights_sql(256, 256)} AS w2),
      h AS MATERIALIZED (SELECT mh_id, list_transform(w1, lambda r: greatest(list_dot_product(r, e) + 0.05, 0)) AS h FROM e, w),
      o AS MATERIALIZED (SELECT mh_id, list_transform(w2, lambda r: list_dot_product(r, h)) AS o FROM h, w)
      SELECT mh_id, unnest(range(256))::INT AS pos, round(unnest(o), 6) + 0.0 AS value FROM o"""


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    v = X.vectors(spark, d)
    e = X.vector_edges(spark, d).join(v.select(F.col("id").alias("src"), F.col("label").alias("l1")), "src")
    e = e.join(v.select(F.col("id").alias("dst"), F.col("label").alias("l2")), "dst")
    return e.select("src", "dst", F.coalesce((F.col("l1") == F.col("l2")).cast("double"), F.lit(0.0)).alias("label"))


LABELLED = """labelled AS (SELECT src, dst, coalesce((a.label = b.label)::INT::DOUBLE, 0) AS label, a.h AS ha, b.h AS hb
  FROM vedges JOIN vectors a ON a.id = src JOIN vectors b ON b.id = dst)"""


def link_scores(spark: SparkSession, d: str) -> DataFrame:
    out = L.score_links(_labelled(spark, d), X.vectors(spark, d), threshold=0.1)
    return out.select("src", "dst", "label", X.r6(F.col("score")).alias("score"), "predicted", X.r6(F.col("loss")).alias("loss"))


LINK_SQL = f"""WITH {X.VECTORS}, {X.VECTOR_EDGES}, {LABELLED}, s AS (SELECT *, list_dot_product(ha, hb) AS raw FROM labelled)
  SELECT src, dst, label, round(raw, 6) + 0.0 AS score, (raw > 0.1)::INT AS predicted,
    round(greatest(raw, 0) - raw * label + ln(1 + exp(-abs(raw))), 6) + 0.0 AS loss FROM s"""


def sage_layer(spark: SparkSession, d: str) -> DataFrame:
    """Neighbour means over two relations, summed."""
    v, e = X.vectors(spark, d).select("id", "h"), X.vector_edges(spark, d)
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    w = X.weights(4, 64)
    out = N.hetero_sum([N.sage(v, r, w, w) for r in (e, back)], 4)
    return _cells(out, "id", F.col("h"))


def _means(rel: str, src: str, dst: str) -> str:
    each = ", ".join(f"avg(h[{j + 1}])" for j in range(64))
    return f"{rel} AS (SELECT {dst} AS id, [{each}] AS m FROM vedges JOIN vectors ON id = {src} GROUP BY {dst})"


SAGE_SQL = f"""WITH {X.VECTORS}, {X.VECTOR_EDGES}, {_means('m1', 'src', 'dst')}, {_means('m2', 'dst', 'src')},
  e AS (SELECT v.id, {_unnest([f"coalesce({_lin(i, 4, 64, 'm1.m')}, 0) + coalesce({_lin(i, 4, 64, 'm2.m')}, 0) + 2 * ({_lin(i, 4, 64, 'v.h')})" for i in range(4)])} AS s
    FROM vectors v LEFT JOIN m1 ON m1.id = v.id LEFT JOIN m2 ON m2.id = v.id)
  SELECT id, s.pos AS pos, round(s.v, 6) + 0.0 AS value FROM e"""

ATT_SRC, ATT_DST = [0.5, -0.25, 0.75, 1.0], [0.25, 0.5, -0.5, 0.1]


def gat_layer(spark: SparkSession, d: str) -> DataFrame:
    out = N.gat(X.vectors(spark, d).select("id", "h"), X.vector_edges(spark, d), X.weights(4, 64), ATT_SRC, ATT_DST)
    return _cells(out, "id", F.col("h"))


def _mul(ws: list[float], z: str) -> str:
    return " + ".join(f"{w} * {z}[{i + 1}]" for i, w in enumerate(ws))


GAT_SQL = f"""WITH {X.VECTORS}, {X.VECTOR_EDGES}, z AS (SELECT id, [{", ".join(_lin(i, 4, 64, 'h') for i in range(4))}] AS z FROM vectors),
  raw AS (SELECT src, dst, a.z, ({_mul(ATT_SRC, 'a.z')}) + ({_mul(ATT_DST, 'b.z')}) AS r FROM vedges JOIN z a ON a.id = src JOIN z b ON b.id = dst),
  ex AS (SELECT dst, z, exp(CASE WHEN r > 0 THEN r ELSE 0.2 * r END) AS a FROM raw),
  s AS (SELECT dst AS id, [{", ".join(f'sum(a * z[{i + 1}]) / sum(a)' for i in range(4))}] AS h FROM ex GROUP BY dst),
  e AS (SELECT v.id, {_unnest([f'coalesce(s.h[{i + 1}], 0)' for i in range(4)])} AS s FROM vectors v LEFT JOIN s ON s.id = v.id)
  SELECT id, s.pos AS pos, round(s.v, 6) + 0.0 AS value FROM e"""


def propagated(spark: SparkSession, d: str) -> DataFrame:
    """A stack of three layers with a skip connection at the second."""
    v, e = X.vectors(spark, d).select("id", "h"), X.vector_edges(spark, d)
    layers = [
        {"kind": "gat", "weight": X.weights(8, 64), "att_src": [0.1] * 8, "att_dst": [-0.1] * 8},
        {"kind": "sage", "w_neighbour": X.weights(8, 8), "w_self": X.weights(8, 8)},
        {"kind": "sage", "w_neighbour": X.weights(4, 8), "w_self": X.weights(4, 8)},
    ]
    return _cells(N.propagate(v, {"link": e}, layers, skip={2: X.weights(8, 8)}), "id", F.col("h"))


def _propagated_sql() -> str:
    def vector(rows: int, cols: int, h: str) -> str:
        return "[" + ", ".join(f"({_lin(i, rows, cols, h)})" for i in range(rows)) + "]"

    def total(*parts: str) -> str:
        return "list_transform(range(len(" + parts[0] + ")), lambda i: " + " + ".join(f"({p})[i + 1]" for p in parts) + ")"

    means = {k: ", ".join(f"avg(h[{j + 1}])" for j in range(8)) for k in (1, 2)}
    none = "[" + ", ".join(["0.0"] * 8) + "]"
    relu = "list_transform({}, lambda v: greatest(v, 0))".format
    return f"""WITH {X.VECTORS}, {X.VECTOR_EDGES}, z AS MATERIALIZED (SELECT id, {vector(8, 64, "h")} AS z FROM vectors),
      raw AS (SELECT dst, a.z, 0.1 * list_sum(a.z) - 0.1 * list_sum(b.z) AS r FROM vedges JOIN z a ON a.id = src JOIN z b ON b.id = dst),
      ex AS (SELECT dst, z, exp(CASE WHEN r > 0 THEN r ELSE 0.2 * r END) AS a FROM raw),
      s AS (SELECT dst AS id, [{", ".join(f"sum(a * z[{i + 1}]) / sum(a)" for i in range(8))}] AS h FROM ex GROUP BY dst),
      h1 AS MATERIALIZED (SELECT v.id, {relu(f"coalesce(s.h, {none})")} AS h FROM vectors v LEFT JOIN s USING (id)),
      m1 AS (SELECT dst AS id, [{means[1]}] AS m FROM vedges JOIN h1 ON id = src GROUP BY dst),
      j1 AS (SELECT h1.id, h, coalesce(m, {none}) AS m FROM h1 LEFT JOIN m1 USING (id)),
      h2 AS MATERIALIZED (SELECT id, {relu(total(vector(8, 8, "m"), vector(8, 8, "h"), vector(8, 8, "h")))} AS h FROM j1),
      m2 AS (SELECT dst AS id, [{means[2]}] AS m FROM vedges JOIN h2 ON id = src GROUP BY dst),
      j2 AS (SELECT h2.id, h, coalesce(m, {none}) AS m FROM h2 LEFT JOIN m2 USING (id)),
      h3 AS (SELECT id, {total(vector(4, 8, "m"), vector(4, 8, "h"))} AS h FROM j2)
      SELECT id, unnest(range(4))::INT AS pos, round(unnest(h), 6) + 0.0 AS value FROM h3"""


#: Market segments, the categories of anchors.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def model_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the pair edges after the whole pass over anchors and roads."""
    mid = G.centroid(F.col("coords"))
    roads = X.roads(spark, d).select(F.col("fid").alias("id"), mid["x"].alias("x"), mid["y"].alias("y"), F.array(F.col("shape_leng").cast("double") / 1000).alias("attributes"))
    mh = X.anchors(spark, d).select(F.col("mh_id").alias("id"), "x", "y", E.one_hot(F.col("subtypecd"), SEGMENTS).alias("attributes"))
    near = X.near(spark, d).where("near_dist < 100").select(F.col("mh_id").alias("src"), F.col("near_fid").alias("dst"))
    pairs = checkpoint(spatial.line_pairs(spark, d).select("src", "dst").distinct())
    edges = {
        ("MH", "link", "MH"): pairs,
        ("MH", "near", "Road"): near,
        ("Road", "rev_near", "MH"): near.select(F.col("dst").alias("src"), F.col("src").alias("dst")),
    }
    width = {"MH": 4 + len(SEGMENTS), "Road": 4 + 1}
    w = X.weights
    first = {
        (s, r, t): {"weight": w(4, width[s]), "weight_to": w(4, width[t]), "att_src": ATT_SRC, "att_dst": ATT_DST} for s, r, t in edges
    }
    second = {k: {"w_neighbour": w(3 + i, 4)[i:], "w_self": w(3, 4)} for i, k in enumerate(edges)}
    out = W.link_model(
        {"MH": mh, "Road": roads}, edges, pairs, "MH", {"weight": w(4, 24), "freqs": E.frequencies(4, 1.0, 100.0)},
        [{"kind": "gat", "weights": first}, {"kind": "sage", "weights": second}], {1: {t: w(4, n) for t, n in width.items()}},
    )
    return out.select("src", "dst", X.r6(F.col("score")).alias("score"), "predicted")


def _model_sql() -> str:
    from math import cos, exp, log, pi, sin

    width = {"MH": 4 + len(SEGMENTS), "Road": 4 + 1}
    relations = (("link", "MH", "MH"), ("near", "MH", "Road"), ("rev", "Road", "MH"))

    def lin(rows: int, cols: int, h: str, skip: int = 0) -> str:
        return "[" + ", ".join(f"({_lin(i, rows, cols, h)})" for i in range(skip, rows)) + "]"

    def total(parts: list[str], size: int, relu: bool) -> str:
        each = [" + ".join(f"({p})[{i + 1}]" for p in parts) for i in range(size)]
        return "[" + ", ".join(f"greatest({e}, 0)" if relu else e for e in each) + "]"

    place = ", ".join(
        f"{g}(((x - cx) * {cos(2 * pi * k / 3)!r} + (y - cy) * {sin(2 * pi * k / 3)!r}) * {1.0 / exp(f * (log(100.0) / 3))!r})"
        for f in range(4) for k in range(3) for g in ("sin", "cos")
    )
    hot = ", ".join(f"(subtypecd = '{v}')::INT::DOUBLE" for v in SEGMENTS)
    none4, none3 = ("[" + ", ".join(["0.0"] * n) + "]" for n in (4, 4))
    steps, first, second = [], {"MH": [], "Road": []}, {"MH": [], "Road": []}
    for i, (rel, source, target) in enumerate(relations):
        steps.append(f"""z_{rel} AS (SELECT e.dst, {lin(4, width[source], 'a.h')} AS z, ({_mul(ATT_SRC, lin(4, width[source], 'a.h'))}) + ({_mul(ATT_DST, lin(4, width[target], 'b.h'))}) AS r
          FROM e_{rel} e JOIN h0_{source} a ON a.id = e.src JOIN h0_{target} b ON b.id = e.dst),
        g_{rel} AS (SELECT dst AS id, [{", ".join(f"sum(a * z[{k + 1}]) / sum(a)" for k in range(4))}] AS h FROM (SELECT dst, z, exp(CASE WHEN r > 0 THEN r ELSE 0.2 * r END) AS a FROM z_{rel}) GROUP BY dst)""")
        first[target].append(rel)
    for kind in width:
        joins = " ".join(f"LEFT JOIN g_{rel} ON g_{rel}.id = n.id" for rel in first[kind])
        parts = [f"coalesce(g_{rel}.h, {none4})" for rel in first[kind]] + [lin(4, width[kind], "n.h")]
        steps.append(f"h1_{kind} AS MATERIALIZED (SELECT n.id, {total(parts, 4, True)} AS h FROM h0_{kind} n {joins})")
    for i, (rel, source, target) in enumerate(relations):
        steps.append(f"m_{rel} AS (SELECT e.dst AS id, [{', '.join(f'avg(h[{k + 1}])' for k in range(4))}] AS m FROM e_{rel} e JOIN h1_{source} ON h1_{source}.id = e.src GROUP BY e.dst)")
        second[target].append((i, rel))
    joins = " ".join(f"LEFT JOIN m_{rel} ON m_{rel}.id = n.id" for _, rel in second["MH"])
    parts = [p for i, rel in second["MH"] for p in (lin(3 + i, 4, f"coalesce(m_{rel}.m, {none3})", i), lin(3, 4, "n.h"))]
    steps.append(f"h2 AS MATERIALIZED (SELECT n.id, {total(parts, 3, False)} AS h FROM h1_MH n {joins})")
    return f"""{spatial.BASE}, {X.NEAR}, {X.ROADS}, places AS (SELECT x, y FROM anchors UNION ALL SELECT (x1 + x2) / 2, (y1 + y2) / 2 FROM roads),
      c AS (SELECT avg(x) AS cx, avg(y) AS cy FROM places),
      raw_MH AS (SELECT mh_id AS id, x, y, [{hot}] AS attributes FROM anchors), raw_Road AS (SELECT fid AS id, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y, [shape_leng::DOUBLE / 1000] AS attributes FROM roads),
      {", ".join(f"p_{k} AS MATERIALIZED (SELECT id, [{place}] AS p, attributes FROM raw_{k}, c)" for k in width)},
      {", ".join(f"h0_{k} AS MATERIALIZED (SELECT id, list_concat([{', '.join(f'greatest({_lin(i, 4, 24, chr(112))}, 0)' for i in range(4))}], attributes) AS h FROM p_{k})" for k in width)},
      e_link AS MATERIALIZED (SELECT DISTINCT src, dst FROM pairs), e_near AS (SELECT mh_id AS src, near_fid AS dst FROM near_t WHERE near_dist < 100), e_rev AS (SELECT dst AS src, src AS dst FROM e_near),
      {", ".join(steps)}, s AS (SELECT src, dst, list_dot_product(a.h, b.h) AS raw FROM e_link JOIN h2 a ON a.id = src JOIN h2 b ON b.id = dst)
      SELECT src, dst, round(raw, 6) + 0.0 AS score, (raw > 0.5)::INT AS predicted FROM s"""


def split_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the scored rows beside two stored rows: one of the log, with six values of its own, and one noted to three digits, which passes."""
    scored = checkpoint(X.scored(spark, d))
    log = X.metric_log(spark, d)
    log = log.select("row_no", "size", "dropout", "phase", *((F.col("auc") * (1 - i / 20)).alias(m) for i, m in enumerate(M.METRICS)))
    noted = M.binary_metrics(scored, 0.1).select(
        F.lit(0).cast("long").alias("row_no"), F.lit(512).alias("size"), F.lit(0.5).alias("dropout"), F.lit("Testing").alias("phase"), *(F.round(m, 3).alias(m) for m in M.METRICS)
    )
    log = log.unionByName(noted)
    out = [W.evaluate(scored, log, size, dropout, phase, 0.1) for size, dropout, phase in ((64, 0.2, "training"), (512, 0.5, "testing"))]
    return _rounded(out[0].unionByName(out[1])).withColumn("delta", X.r6(F.col("delta")))


def _evaluation_sql() -> str:
    stored = ", ".join(f"v * (1 - {i} / 20) AS s_{m}" for i, m in enumerate(M.METRICS))
    noted = ", ".join(f"round({m}, 3)" for m in M.METRICS)
    delta = "greatest(" + ", ".join(f"abs({m} - s_{m})" for m in M.METRICS) + ")"
    return f"""WITH {X.SCORED}, {X.METRIC_LOG}, {_metrics_sql(0.1)},
      stored AS (SELECT 64 AS size, 0.2::DOUBLE AS dropout, 'training' AS phase, {stored}
        FROM (SELECT arg_min(auc, row_no) AS v FROM mlog WHERE size = 64 AND abs(dropout - 0.2) < 1e-12 AND phase = 'Training') WHERE v IS NOT NULL
        UNION ALL SELECT 512, 0.5, 'testing', {noted} FROM m)
      SELECT size, dropout, phase, {_ROUND}, round({delta}, 6) + 0.0 AS delta, {delta} <= 0.005 AS passed FROM m, stored"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*((X.r6(F.col(c)) if c in M.METRICS else F.col(c)).alias(c) for c in df.columns))


def binary_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.binary_metrics(X.scored(spark, d), 0.1))


def _metrics_sql(threshold: float, name: str = "m", source: str = "scored") -> str:
    return f"""{name}_c AS (SELECT count(*) FILTER (score > {threshold} AND label = 1) AS tp, count(*) FILTER (score > {threshold} AND label <> 1) AS fp,
      count(*) FILTER (score <= {threshold} AND label = 1) AS fn, count(*) FILTER (score <= {threshold} AND label <> 1) AS tn FROM {source}),
    {name}_r AS (SELECT label, (rank() OVER (ORDER BY score) + rank() OVER (ORDER BY score) + count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM {source}),
    {name} AS (SELECT (SELECT (sum(r) - count(*) * (count(*) + 1) / 2) FROM {name}_r WHERE label = 1) / ((tp + fn) * (fp + tn)) AS auc,
      coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
      (tp + tn) / (tp + fp + fn + tn) AS accuracy,
      coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc, tp, fp, fn, tn FROM {name}_c)"""


_ROUND = ", ".join(f"round({m}, 6) + 0.0 AS {m}" for m in M.METRICS)


def roc_curve(spark: SparkSession, d: str) -> DataFrame:
    return M.roc_points(X.scored(spark, d)).select("score", *(X.r6(F.col(c)).alias(c) for c in ("fpr", "tpr")))


ROC_SQL = f"""WITH {X.SCORED}, t AS (SELECT count(*) FILTER (label = 1) AS p, count(*) FILTER (label <> 1) AS n FROM scored),
  g AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM scored GROUP BY score)
  SELECT score, round(sum(neg) OVER w / n, 6) + 0.0 AS fpr, round(sum(pos) OVER w / p, 6) + 0.0 AS tpr FROM g, t WINDOW w AS (ORDER BY score DESC)"""


def metric_delta(spark: SparkSession, d: str) -> DataFrame:
    """Metrics at two thresholds compared within the tolerance."""
    s = checkpoint(X.scored(spark, d))
    out = M.metric_delta(M.binary_metrics(s, 0.1), M.binary_metrics(s, 0.12))
    return out.select(X.r6(F.col("delta")).alias("delta"), "passed")


DELTA = ", ".join(f"abs(a.{m} - b.{m})" for m in M.METRICS)


def epoch_loss(spark: SparkSession, d: str) -> DataFrame:
    rows = X.train_log(spark, d).withColumn("n", F.col("run") % 7 + 1)
    return M.epoch_loss(rows).select("epoch", "phase", F.round("loss", 10).alias("loss"))


def early_stopping(spark: SparkSession, d: str) -> DataFrame:
    return P.early_stopping(X.train_log(spark, d).select("run", "epoch", "loss"))


STOP = f"""RECURSIVE {X.TRAIN_LOG}, fold(run, epoch, best, best_epoch, bad, stop_epoch) AS (
  SELECT run, epoch, loss, epoch, 0, NULL::BIGINT FROM trainlog WHERE epoch = 1
  UNION ALL SELECT t.run, t.epoch, CASE WHEN -t.loss >= -f.best + 0.001 THEN t.loss ELSE f.best END, CASE WHEN -t.loss >= -f.best + 0.001 THEN t.epoch ELSE f.best_epoch END,
    CASE WHEN -t.loss >= -f.best + 0.001 THEN 0 ELSE f.bad + 1 END, CASE WHEN -t.loss >= -f.best + 0.001 THEN NULL WHEN f.bad + 1 >= 5 THEN t.epoch END
  FROM fold f JOIN trainlog t ON t.run = f.run AND t.epoch = f.epoch + 1 WHERE f.stop_epoch IS NULL),
stops AS (SELECT run, best_epoch, best AS best_loss, epoch AS stop_epoch, stop_epoch IS NOT NULL AS stopped FROM
  (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch DESC) AS k FROM fold) WHERE k = 1)"""


def best_epochs(spark: SparkSession, d: str) -> DataFrame:
    log = X.train_log(spark, d)
    return P.best_rows(log, P.early_stopping(log.select("run", "epoch", "loss"))).select("run", "epoch", "loss", "phase")


def result_heat_map(spark: SparkSession, d: str) -> DataFrame:
    out = P.heat_map(X.metric_log(spark, d).where("phase = 'Validation'"), [0.0, 0.2, 0.4, 0.6])
    return out.select("size", *(X.r6(F.col(c)).alias(c) for c in out.columns[1:]))


def expected_metrics(spark: SparkSession, d: str) -> DataFrame:
    log = X.metric_log(spark, d)
    wanted = log.select("size", (F.col("dropout") + 1e-14).alias("dropout"), F.upper("phase").alias("phase")).distinct()
    out = P.expected_metrics(wanted, log)
    return out.select("size", F.round("dropout", 6).alias("dropout"), "phase", "row_no", "auc")


def settings_without_model(spark: SparkSession, d: str) -> DataFrame:
    return P.not_covered(X.metric_log(spark, d), X.model_names(spark, d))


def model_hyper_parameters(spark: SparkSession, d: str) -> DataFrame:
    return P.hyper_parameters(X.model_names(spark, d))


def model_index(spark: SparkSession, d: str) -> DataFrame:
    """Settings of every stack, as text, with its layers."""
    out = P.checkpoint_index(X.model_names(spark, d)).join(F.broadcast(P.stack_table(spark)), "arch", "left")  # five rows
    text = F.transform("settings", lambda s: F.concat_ws(":", s["hidden"].cast("string"), F.format_string("%.1f", s["dropout"])))
    return out.select("arch", F.array_join(text, ",").alias("settings"), F.array_join("layers", "-").alias("layers"), "skip")


def layer_stacks(spark: SparkSession, d: str) -> DataFrame:
    return P.layer_stacks(X.parameter_keys(spark, d)).select("model", F.array_join("layers", "-").alias("layers"), "skip")


def parameter_grid(spark: SparkSession, d: str) -> DataFrame:
    log = X.metric_log(spark, d)
    return P.parameter_grid(log.select("size").distinct(), log.select("dropout").distinct())


def phase_counts(spark: SparkSession, d: str) -> DataFrame:
    """Phase of seeded splits of the anchors, with their number of anchors and of categories."""
    at = S.draw(SEED, 10, "mh_id")
    split = F.when(at < 6, "train").when(at < 8, "val").otherwise("test")
    a = X.anchors(spark, d).select(P.phase_of(split).alias("phase"), "subtypecd")
    return a.groupBy("phase").agg(F.count("*").alias("n"), F.countDistinct("subtypecd").alias("n_categories"))


def top_features(spark: SparkSession, d: str) -> DataFrame:
    return L.top_features(X.vectors(spark, d), "h").select("pos", X.r6(F.col("importance")).alias("importance"))


def largest_cell(spark: SparkSession, d: str) -> DataFrame:
    return L.largest_cell(X.vectors(spark, d), "h", "id")


def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """One feature column of the vectors, and the whole edge list of one of them."""
    v = X.vectors(spark, d).select("id", F.element_at("h", 9).alias("feature"))
    return X.vector_edges(spark, d).where("src = 17").join(v, F.col("dst") == F.col("id")).select("src", "dst", "feature")


def linear_attributions(spark: SparkSession, d: str) -> DataFrame:
    """Ten most important features of the fitted link classifier (model fitting: no SQL)."""
    f = checkpoint(L.link_features(_labelled(spark, d), X.vectors(spark, d)))
    return L.top_features(L.attributions(f, L.fit_links(f)), "attribution")


def classifier_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the link classifier per setting and phase (model fitting: no SQL)."""
    f = checkpoint(L.link_features(_labelled(spark, d), X.vectors(spark, d)).withColumn("part", S.draw(SEED, 10, "src", "dst")))
    train, val, test = f.where("part < 6"), f.where("part in (6, 7)"), f.where("part > 7")
    out = None
    for setting, _, phases in L.sweep(train, val, test, [{"reg": r} for r in (0.01, 0.1)]):
        for phase, m in phases.items():
            row = m.select(F.lit(setting["reg"]).alias("reg"), F.lit(phase).alias("phase"), *M.METRICS)
            out = row if out is None else out.unionByName(row)
    return out


def sweep_log(spark: SparkSession, d: str) -> DataFrame:
    """A sweep over two sizes on the products of the ends' vectors, begun with one of them and taken up with both (model fitting: no SQL)."""
    at = f"{shared_folder(spark)}/sweep-{uuid.uuid4().hex}"
    both = L.with_ends(_labelled(spark, d), X.vectors(spark, d).select("id", "h"))
    part = S.draw(SEED, 10, "src", "dst")
    phase = P.phase_of(F.when(part < 6, "train").when(part < 8, "val").otherwise("test"))
    rows = both.select(
        F.pmod(F.xxhash64("src", "dst"), F.lit(1 << 52)).alias("key"), phase.alias("phase"), "label",
        F.zip_with("a", "b", lambda x, y: x * y * 8).alias("features"),
    )
    rows = checkpoint(rows)
    grid = P.parameter_grid(spark.createDataFrame([(16,), (32,)], "size int"), spark.createDataFrame([(0.2,)], "dropout double"))
    for settings in (grid.where("size = 16"), grid):
        V.sweep(rows, 64, settings, at, threshold=0.0, seed=SEED)
    out = checkpoint(T.read_log(spark, at))
    remove(spark, at)
    return out


#: The given tables, by group.
TABLES = {
    "layers": ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"),
    "graph": ("events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"),
}


def file_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Name, size and SHA-256 of every file of every table, checked against a second reading (file bytes: no SQL)."""
    files = B.list_files(spark, {g: [f"{d}/{t}.parquet" for t in names] for g, names in TABLES.items()})
    digests = checkpoint(B.manifest(files).select("name", "path", "length", "sha256"))
    again = B.digests(files).select("path", F.col("sha256").alias("again"))
    return digests.join(again, "path").select("name", "length", "sha256", (F.col("sha256") == F.col("again")).alias("ok"))


def file_totals(spark: SparkSession, d: str) -> DataFrame:
    """Files and bytes of each group of tables (file sizes: no SQL)."""
    return B.file_totals(B.list_files(spark, {g: [f"{d}/{t}.parquet" for t in names] for g, names in TABLES.items()}))


def log_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Result rows appended to a log twice, and read back past the header of every file."""
    at = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    value, empty = F.col("auc"), F.lit(None).cast("double")
    rows = X.metric_log(spark, d).select(
        "size", "dropout", "phase", F.lit(10).alias("epochs"), empty.alias("training_loss"), value.alias("validation_loss"),
        *(value.alias(m) for m in ("auc", "f1", "precision", "recall", "accuracy", "mcc")),
    )
    for phase in ("Training", "Validation", "Testing"):
        T.append_log(rows.where(F.col("phase") == phase), at)
    out = checkpoint(T.read_log(spark, at).select("size", X.r6(F.col("dropout")).alias("dropout"), "phase", "epochs", X.r6(F.col("auc")).alias("auc"), X.r6(F.col("mcc")).alias("mcc")))
    remove(spark, at)
    return out


QUERIES = {
    "log_round_trip": (
        log_round_trip,
        f"WITH {X.METRIC_LOG} SELECT size, round(dropout, 6) + 0.0 AS dropout, phase, 10 AS epochs, round(auc, 6) + 0.0 AS auc, round(auc, 6) + 0.0 AS mcc FROM mlog",
    ),
    "position_encoding": (position_encoding, _encoding_sql()),
    "rectified_encoding": (rectified_encoding, _encoding_sql(after=True)),
    "dense_layer": (dense_layer, DENSE_SQL),
    "wide_layers": (wide_layers, _wide_sql()),
    "link_scores": (link_scores, LINK_SQL),
    "sage_layer": (sage_layer, SAGE_SQL),
    "gat_layer": (gat_layer, GAT_SQL),
    "propagated": (propagated, _propagated_sql()),
    "model_scores": (model_scores, _model_sql()),
    "split_evaluation": (split_evaluation, _evaluation_sql()),
    "binary_metrics": (binary_metrics, f"WITH {X.SCORED}, {_metrics_sql(0.1)} SELECT {_ROUND}, tp, fp, fn, tn FROM m"),
    "roc_curve": (roc_curve, ROC_SQL),
    "metric_delta": (
        metric_delta,
        f"WITH {X.SCORED}, {_metrics_sql(0.1, 'a')}, {_metrics_sql(0.12, 'b')} SELECT round(greatest({DELTA}), 6) + 0.0 AS delta, greatest({DELTA}) <= 0.005 AS passed FROM a, b",
    ),
    "epoch_loss": (
        epoch_loss,
        f"WITH {X.TRAIN_LOG} SELECT epoch, phase, round(sum(loss * (run % 7 + 1)) / sum(run % 7 + 1), 10) AS loss FROM trainlog GROUP BY epoch, phase",
    ),
    "early_stopping": (early_stopping, f"WITH {STOP} SELECT * FROM stops"),
    "best_epochs": (best_epochs, f"WITH {STOP} SELECT t.run, t.epoch, t.loss, t.phase FROM trainlog t JOIN stops s ON s.run = t.run AND s.best_epoch = t.epoch"),
    "result_heat_map": (
        result_heat_map,
        f"WITH {X.METRIC_LOG} SELECT size, " + ", ".join(f"round(min(auc * 100) FILTER (dropout = {i / 10}), 6) + 0.0 AS d{i:02d}" for i in (0, 2, 4, 6))
        + " FROM mlog WHERE phase = 'Validation' GROUP BY size",
    ),
    "expected_metrics": (
        expected_metrics,
        f"WITH {X.METRIC_LOG} SELECT size, round(dropout, 6) AS dropout, upper(phase) AS phase, min(row_no) AS row_no, arg_min(auc, row_no) AS auc FROM mlog GROUP BY ALL",
    ),
    "settings_without_model": (
        settings_without_model,
        f"""WITH {X.METRIC_LOG}, {X.MODEL_NAMES}, have AS (SELECT DISTINCT regexp_extract(name, '_hiddensize_(\\d+)_', 1)::INT AS size, regexp_extract(name, '_drop_(\\d+)', 1)::DOUBLE / 10 AS dropout
        FROM names WHERE name LIKE 'model%') SELECT DISTINCT size, dropout FROM mlog m WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.size = m.size AND h.dropout = m.dropout)""",
    ),
    "model_hyper_parameters": (
        model_hyper_parameters,
        f"""WITH {X.MODEL_NAMES} SELECT row_no, name, CASE WHEN v THEN regexp_extract(name, '^model(.*)_hiddensize_', 1) END AS arch,
        CASE WHEN v THEN regexp_extract(name, '_hiddensize_(\\d+)_', 1)::INT END AS hidden, CASE WHEN v THEN regexp_extract(name, '_drop_(\\d+)', 1)::DOUBLE / 10 END AS dropout, v AS valid
        FROM (SELECT *, name LIKE 'model%' AS v FROM names WHERE name <> 'checkpoint.pt')""",
    ),
    "model_index": (
        model_index,
        f"""WITH {X.MODEL_NAMES}, p AS (SELECT DISTINCT regexp_extract(name, '^model(.*)_hiddensize_', 1) AS arch, regexp_extract(name, '_hiddensize_(\\d+)_', 1)::INT AS hidden,
        regexp_extract(name, '_drop_(\\d+)', 1)::DOUBLE / 10 AS dropout FROM names WHERE name LIKE 'model%')
        SELECT arch, string_agg(hidden || ':' || printf('%.1f', dropout), ',' ORDER BY hidden, dropout) AS settings,
        CASE arch WHEN '04' THEN 'sage-sage-sage-sage' WHEN '22' THEN 'gat-gat-sage-sage' WHEN '1111' THEN 'gat-sage-gat-sage'
        WHEN '1212' THEN 'gat-sage-sage-gat-sage-sage' WHEN 'skip' THEN 'gat-sage-sage-gat-sage-sage' END AS layers, arch = 'skip' AS skip FROM p GROUP BY arch""",
    ),
    "layer_stacks": (
        layer_stacks,
        f"""WITH {X.PARAMETER_KEYS}, k AS (SELECT model, regexp_extract(key, '^gnn\\.conv(\\d+)\\.', 1) AS layer, bool_or(contains(key, '.att_src')) AS gat FROM keys GROUP BY ALL)
        SELECT m.model, coalesce(l.layers, '') AS layers, m.skip FROM (SELECT model, bool_or(key LIKE 'gnn.lin1.%') AS skip FROM keys GROUP BY model) m LEFT JOIN
        (SELECT model, string_agg(CASE WHEN gat THEN 'gat' ELSE 'sage' END, '-' ORDER BY layer::INT) AS layers FROM k WHERE layer <> '' GROUP BY model) l USING (model)""",
    ),
    "parameter_grid": (parameter_grid, f"WITH {X.METRIC_LOG} SELECT a.size, b.dropout FROM (SELECT DISTINCT size FROM mlog) a, (SELECT DISTINCT dropout FROM mlog) b"),
    "phase_counts": (
        phase_counts,
        f"""WITH {X.ANCHORS}, s AS (SELECT subtypecd, ('0x' || substr(md5(concat_ws('|', mh_id, '{SEED}')), 1, 12))::BIGINT % 10 AS k FROM anchors)
        SELECT CASE WHEN k < 6 THEN 'Training' WHEN k < 8 THEN 'Validation' ELSE 'Testing' END AS phase, count(*) AS n, count(DISTINCT subtypecd) AS n_categories FROM s GROUP BY 1""",
    ),
    "top_features": (
        top_features,
        f"""WITH {X.VECTORS}, c AS (SELECT unnest(h) AS v, unnest(range(len(h)))::INT AS pos FROM vectors)
        SELECT pos, round(sum(abs(v)), 6) + 0.0 AS importance FROM c GROUP BY pos ORDER BY sum(abs(v)) DESC, pos LIMIT 10""",
    ),
    "largest_cell": (
        largest_cell,
        f"WITH {X.VECTORS}, c AS (SELECT id, unnest(h) AS value, unnest(range(len(h)))::INT AS pos FROM vectors) SELECT id, pos, value FROM c ORDER BY value DESC, id, pos LIMIT 1",
    ),
    "point_lookup": (
        point_lookup,
        f"WITH {X.VECTORS}, {X.VECTOR_EDGES} SELECT src, dst, h[9] AS feature FROM vedges JOIN vectors ON id = dst WHERE src = 17",
    ),
    "linear_attributions": (linear_attributions, None),
    "classifier_metrics": (classifier_metrics, None),
    "sweep_log": (sweep_log, None),
    "file_manifest": (file_manifest, None),
    "file_totals": (file_totals, None),
}
