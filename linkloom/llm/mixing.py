"""Mixing sources to target weights [native]: capped water-filling, then seeded repetition.

Targets: with cap ``max_epochs * size`` and weight w per source, the feasible mix that
reshares excess by weight is ``min(cap, level * w)`` for one water level. Sorting the
sources by cap / w gives the level from prefix sums; that table has one row per source.

Repetition: a source's epochs are target / size. Every document is taken floor(epochs)
times; the fractional rest takes whole documents in a seeded order until their sizes
reach it. The order is by a 32-bit hash (of md5, so that SQL can repeat it); per (source, hash bucket) sums decide whole
buckets, and only the one bucket at the border is ordered row by row, so no window
holds more than about 1/4096 of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.llm.common import WORD, table
from linkloom.operators.components import checkpoint

WEIGHTS = (5.0, 2.0, 1.0)
BUCKETS = 4096
MAX_SOURCES_SENT = 20_000  # rows of a few numbers and a name; more are joined by shuffle


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, budget: Column | None = None, max_epochs: float = 3.0) -> DataFrame:
    """Add ``target`` to rows of (source, source_size, weight).

    ``budget`` is an aggregate over the rows, all sizes by default. A source of size 0 gets
    0. If the budget exceeds all caps, every target is its cap.
    """
    s = sources.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    everything = W.partitionBy().orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = W.partitionBy()
    s = (
        s.withColumn("budget", (budget if budget is not None else F.sum("source_size")).over(whole).cast("double"))
        .withColumn("cap_before", F.sum("cap").over(everything) - F.col("cap"))
        .withColumn("weight_left", F.sum("weight").over(whole) - F.sum("weight").over(everything) + F.col("weight"))
        # the level if this source were the first that is not capped
        .withColumn("level", (F.col("budget") - F.col("cap_before")) / F.col("weight_left"))
        .withColumn("free", F.col("cap") > F.col("level") * F.col("weight"))
        .withColumn("level", F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(whole)["level"])
    )
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return s.withColumn("target", F.greatest(target, F.lit(0.0))).select(*sources.columns, "target")


def source_targets(sizes: DataFrame, max_epochs: float = 3.0) -> DataFrame:
    """(source, source_size, target) where sources by code point, null last, weigh 5, 2, 1, repeating."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.partitionBy().orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int")))
    return water_fill(per, max_epochs=max_epochs).select("source", "source_size", "target")


def mix(docs: DataFrame, max_epochs: float = 3.0, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs and taken of every row.

    Null or empty texts have size 0, take 0 and are never copied once more. A null doc_id is drawn by the
    text instead. Repeated rows are separate documents; which of two equal rows is taken once more is
    arbitrary, the multiset of results is not. An empty table gives no rows. Texts may be of any length;
    other columns are ignored.
    """
    rows = docs.select(
        "doc_id",
        "source",
        n_words(F.col("text")).alias("size"),
        F.conv(F.substring(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.md5("text")), F.lit(str(seed)))), 1, 8), 16, 10).cast("long").alias("h"),
    ).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    per_bucket = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    per_bucket = checkpoint(per_bucket)  # a small table, used three times
    goals = source_targets(per_bucket.select("source", F.col("bucket_size").alias("size")), max_epochs)
    goals = (
        goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
        .withColumn("whole", F.floor("epochs"))
        .withColumn("rest", (F.col("epochs") - F.col("whole")) * F.col("source_size"))
    )
    # the border is the first bucket that doesn't fit whole
    ends = per_bucket.withColumn("before", F.sum("bucket_size").over(W.partitionBy("source").orderBy("bucket")) - F.col("bucket_size"))
    ends, goals = ends.alias("e"), goals.alias("g")
    border = (
        ends.join(goals, F.col("e.source").eqNullSafe(F.col("g.source")))
        .where("e.before + e.bucket_size > g.rest")
        .groupBy("e.source")
        .agg(F.min(F.struct("e.bucket", (F.col("g.rest") - F.col("e.before")).alias("room"))).alias("border"))
    ).alias("b")
    plan = checkpoint(
        goals.join(border, F.col("g.source").eqNullSafe(F.col("b.source")), "left")
        .select("g.*", F.coalesce("b.border.bucket", F.lit(BUCKETS)).alias("border"), "b.border.room")
    )
    rows, p = rows.alias("r"), plan.alias("p")
    same = F.col("r.source").eqNullSafe(F.col("p.source"))
    if plan.count() <= MAX_SOURCES_SENT:
        p = F.broadcast(p)
    else:  # many sources: spread a hot one by bucket
        p = p.withColumn("spread", F.explode(F.sequence(F.lit(0), F.lit(63))))
        same &= F.pmod("r.bucket", F.lit(64)) == F.col("spread")
    joined = rows.join(p, same).select("r.*", "p.source_size", "p.target", "p.epochs", "p.whole", "p.border", "p.room")
    sure = joined.where("bucket <> border").withColumn("extra", F.when(F.col("bucket") < F.col("border"), 1).otherwise(0))
    order = W.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    edge = joined.where("bucket = border").withColumn(
        # the document at the border counts if more than half of it fits
        "extra", F.when(F.sum("size").over(order) - F.col("size") / 2 <= F.col("room"), 1).otherwise(0)
    )
    # nothing is gained by one more copy of an empty document
    return sure.unionByName(edge).withColumn("extra", F.when(F.col("size") > 0, F.col("extra")).otherwise(0)).select(
        "doc_id", "source", "size", "source_size", "target", "epochs",
        ((F.col("whole") + F.col("extra")) * F.col("size")).cast("long").alias("taken"),
        (F.col("whole") + F.col("extra")).cast("long").alias("copies"),
    )


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


OP1_SQL = r"""
WITH rows_ AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(concat_ws('|', coalesce(doc_id::VARCHAR, md5(text)), '7')), 1, 8))::BIGINT AS h FROM documents),
per AS (SELECT source, h % 4096 AS bucket, sum(size)::BIGINT AS bucket_size FROM rows_ GROUP BY ALL),
weighed AS (
  SELECT source, source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
    source_size::DOUBLE * 3 AS cap, (sum(source_size) OVER ())::DOUBLE AS budget
  FROM (SELECT source, sum(bucket_size)::BIGINT AS source_size FROM per GROUP BY source)),
levels AS (
  SELECT *, (budget - (sum(cap) OVER o - cap)) / (sum(weight) OVER () - sum(weight) OVER o + weight) AS level
  FROM weighed WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
level AS (SELECT (SELECT level FROM levels WHERE cap > level * weight ORDER BY cap / weight, level LIMIT 1) AS level),
goals AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS epochs, floor(epochs) AS whole, (epochs - whole) * source_size AS rest
  FROM (SELECT source, source_size, greatest(CASE WHEN l.level IS NULL THEN cap ELSE least(cap, l.level * weight) END, 0) AS target FROM levels, level l)),
ends AS (SELECT *, (sum(bucket_size) OVER (PARTITION BY source ORDER BY bucket))::BIGINT - bucket_size AS before FROM per),
border AS (
  SELECT e.source, min(e.bucket) AS border, arg_min(rest - before, e.bucket) AS room
  FROM ends e JOIN goals g ON e.source IS NOT DISTINCT FROM g.source WHERE before + bucket_size > rest GROUP BY e.source),
placed AS (
  SELECT r.*, g.source_size, g.target, g.whole, coalesce(b.border, 4096) AS border, b.room, r.h % 4096 AS bucket,
    sum(size) OVER (PARTITION BY r.source, r.h % 4096 ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size / 2 AS middle
  FROM rows_ r JOIN goals g ON r.source IS NOT DISTINCT FROM g.source LEFT JOIN border b ON r.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies FROM (
  SELECT *, (whole + CASE WHEN size = 0 THEN 0 WHEN bucket < border THEN 1 WHEN bucket > border THEN 0 WHEN middle <= room THEN 1 ELSE 0 END)::BIGINT AS copies FROM placed)
"""
