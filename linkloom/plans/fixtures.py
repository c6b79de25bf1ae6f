"""Layers, edges and logs derived from the given tables, each with the same rule in SQL.

Coordinates lie on an integer lattice of width 50, where plain double arithmetic is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import geometry as G

WIDTH = 50


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c: Column) -> Column:
    """Six digits, and no negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def _lattice(key: str) -> tuple[Column, Column]:
    return (F.col(key) % WIDTH).cast("double"), F.floor(F.col(key) / WIDTH).cast("double")


def anchors(spark: SparkSession, d: str) -> DataFrame:
    x, y = _lattice("c_custkey")
    return read(spark, d, "customer").select(F.col("c_custkey").alias("mh_id"), x.alias("x"), y.alias("y"), F.col("c_mktsegment").alias("subtypecd"))


ANCHORS = "anchors AS (SELECT c_custkey AS mh_id, (c_custkey % 50)::DOUBLE AS x, (c_custkey // 50)::DOUBLE AS y, c_mktsegment AS subtypecd FROM customer)"


def lines(spark: SparkSession, d: str) -> DataFrame:
    """One line per order. Tenths of them start on anchors, the others between: by the last digit of the
    key they are moved off the lattice, in sixteenths, which are exact."""
    x, y = _lattice("o_custkey")
    k = F.col("o_orderkey")
    off = k % 10 / 16
    j = F.floor(k / 10)
    dx = F.when(j % 2 == 0, 1.0).otherwise(0.0)
    dy = F.when(j % 2 == 0, 0.0).when(j % 6 == 3, 2.0).otherwise(1.0)
    return read(spark, d, "orders").select(
        k.alias("line_id"), G.line((x + off, y + off), (x + off + dx, y + off + dy)).alias("coords"),
        F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("material"), F.col("o_orderstatus").alias("seg"),
    )


LINES = """lines AS (SELECT o_orderkey AS line_id, (o_custkey % 50) + (o_orderkey % 10) / 16 AS x1, (o_custkey // 50) + (o_orderkey % 10) / 16 AS y1,
  x1 + CASE WHEN o_orderkey // 10 % 2 = 0 THEN 1 ELSE 0 END AS x2,
  y1 + CASE WHEN o_orderkey // 10 % 2 = 0 THEN 0 WHEN o_orderkey // 10 % 6 = 3 THEN 2 ELSE 1 END AS y2,
  nullif(o_orderpriority, '5-LOW') AS material, o_orderstatus AS seg FROM orders)"""


def near(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").agg(F.count("*").alias("p"))
    k = F.col("c_custkey")
    return read(spark, d, "customer").join(F.broadcast(p)).select(  # one row
        k.alias("mh_id"), (k % F.col("p") + 1).alias("near_fid"), ((k * 37 % 1000) / 1000).alias("near_pos"),
        (F.abs("c_acctbal") / 50).alias("near_dist"), (k % 2).cast("int").alias("side"),
    )


NEAR = """near_t AS (SELECT c_custkey AS mh_id, c_custkey % (SELECT count(*) FROM part) + 1 AS near_fid,
  (c_custkey * 37 % 1000) / 1000 AS near_pos, abs(c_acctbal) / 50 AS near_dist, (c_custkey % 2)::INT AS side FROM customer)"""


def roads(spark: SparkSession, d: str) -> DataFrame:
    x, y = _lattice("p_partkey")
    dx, dy = F.col("p_size") % 5 - 2, F.col("p_size") % 3 - 1
    return read(spark, d, "part").select(
        (F.col("p_partkey") + 1).alias("fid"), G.line((x, y), (x + dx, y + dy)).alias("coords"),
        F.col("p_retailprice").alias("shape_leng"), F.col("p_type").alias("cat"),
    )


ROADS = """roads AS (SELECT p_partkey + 1 AS fid, (p_partkey % 50)::DOUBLE AS x1, (p_partkey // 50)::DOUBLE AS y1,
  x1 + p_size % 5 - 2 AS x2, y1 + p_size % 3 - 1 AS y2, p_retailprice AS shape_leng, p_type AS cat FROM part)"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "n_chars")
    return read(spark, d, "labels").join(docs, "doc_id").select((F.col("n_chars") / 20000.0).alias("score"), F.col("quality").cast("double").alias("label"))


SCORED = "scored AS (SELECT n_chars / 20000.0::DOUBLE AS score, quality::DOUBLE AS label FROM labels JOIN documents USING (doc_id))"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("h"), "label")


VECTORS = "vectors AS (SELECT vec_id AS id, list_transform(embedding, lambda v: v::DOUBLE) AS h, label FROM embeddings)"


def vector_edges(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "embeddings").agg(F.count("*").alias("n"))
    v = read(spark, d, "embeddings").join(F.broadcast(n))  # one row
    i = F.col("vec_id")
    out = v.select(i.alias("src"), ((i * 7 + 3) % F.col("n")).alias("dst"))
    return out.unionByName(v.select(i.alias("src"), ((i + 1) % F.col("n")).alias("dst"))).distinct()


VECTOR_EDGES = """vedges AS (SELECT vec_id AS src, (vec_id * 7 + 3) % (SELECT count(*) FROM embeddings) AS dst FROM embeddings
  UNION SELECT vec_id, (vec_id + 1) % (SELECT count(*) FROM embeddings) FROM embeddings)"""


def train_log(spark: SparkSession, d: str) -> DataFrame:
    """Every event is an epoch of its user's run, in the order of the events."""
    from pyspark.sql import Window as W

    order = W.partitionBy("user_id").orderBy("event_id")
    return read(spark, d, "events").select(
        F.col("user_id").alias("run"), F.row_number().over(order).cast("long").alias("epoch"), F.col("value").alias("loss"), F.col("event_type").alias("phase")
    )


TRAIN_LOG = """trainlog AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS epoch, value AS loss, event_type AS phase FROM events)"""


def metric_log(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, d, "part").select(
        k.alias("row_no"), F.element_at(F.array(*map(F.lit, (32, 64, 128, 256))), (F.col("p_size") % 4 + 1).cast("int")).alias("size"),
        (k % 4 * 2 / 10).alias("dropout"), F.element_at(F.array(*map(F.lit, ("Training", "Validation", "Testing"))), (k % 3 + 1).cast("int")).alias("phase"),
        (F.col("p_retailprice") / 10000).alias("auc"),
    )


METRIC_LOG = """mlog AS (SELECT p_partkey AS row_no, [32, 64, 128, 256][p_size % 4 + 1] AS size, p_partkey % 4 * 2 / 10 AS dropout,
  ['Training', 'Validation', 'Testing'][p_partkey % 3 + 1] AS phase, p_retailprice / 10000 AS auc FROM part)"""


def model_names(spark: SparkSession, d: str) -> DataFrame:
    from linkloom.operators.experiments import model_name

    k = F.col("p_partkey")
    arch = F.element_at(F.array(*map(F.lit, ("04", "22", "1111", "1212", "skip"))), (k % 5 + 1).cast("int"))
    hidden = F.element_at(F.array(*map(F.lit, (32, 64, 128, 256))), (F.col("p_size") % 4 + 1).cast("int"))
    good = model_name(arch, hidden, k % 3 * 2)
    return read(spark, d, "part").select(k.alias("row_no"), F.when(k % 10 == 0, "checkpoint.pt").when(k % 10 == 9, F.concat(F.lit("old_"), good)).otherwise(good).alias("name"))


MODEL_NAMES = """good AS (SELECT p_partkey AS row_no, 'model' || ['04', '22', '1111', '1212', 'skip'][p_partkey % 5 + 1] || '_hiddensize_' ||
  [32, 64, 128, 256][p_size % 4 + 1] || '_drop_' || lpad((p_partkey % 3 * 2)::VARCHAR, 2, '0') || '.pt' AS g FROM part),
names AS (SELECT row_no, CASE WHEN row_no % 10 = 0 THEN 'checkpoint.pt' WHEN row_no % 10 = 9 THEN 'old_' || g ELSE g END AS name FROM good)"""


def parameter_keys(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    key = F.when(n == 7, "gnn.lin1.weight").otherwise(
        F.concat(F.lit("gnn.conv"), n.cast("string"), F.when((k + n) % 3 == 0, ".att_src").otherwise(".lin.weight"))
    )
    return read(spark, d, "lineitem").select(k.alias("model"), key.alias("key"))


PARAMETER_KEYS = """keys AS (SELECT l_orderkey AS model, CASE WHEN l_linenumber = 7 THEN 'gnn.lin1.weight' ELSE 'gnn.conv' || l_linenumber ||
  CASE WHEN (l_orderkey + l_linenumber) % 3 = 0 THEN '.att_src' ELSE '.lin.weight' END END AS key FROM lineitem)"""


def weights(rows: int, cols: int) -> list[list[float]]:
    """Small fixed weights."""
    return [[((i * 7 + j * 3) % 11 - 5) / 10 for j in range(cols)] for i in range(rows)]
