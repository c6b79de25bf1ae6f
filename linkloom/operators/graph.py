"""Edges from line geometry, induced subgraphs, symmetric and labelled edge tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def union_layers(*layers: DataFrame) -> DataFrame:
    """All rows of layers whose columns may differ; missing ones are null."""
    out = layers[0]
    for layer in layers[1:]:
        out = out.unionByName(layer, allowMissingColumns=True)
    return out


def drop_duplicate_rows(df: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """One of each group of rows that are equal in every column but ``ignore``."""
    return df.dropDuplicates([c for c in df.columns if c not in ignore])


def drop_any_null(df: DataFrame) -> DataFrame:
    """Rows without a null in any column, structs and arrays included."""
    return df.na.drop("any")


def composite_category(first: Column, second: Column) -> Column:
    """Text of ``first`` (``nan`` if null) followed by ``second``; null where ``second`` is."""
    return F.concat(F.coalesce(first.cast("string"), F.lit("nan")), second)


def anchor_pairs(hits: DataFrame, line_id: str = "line_id", point_id: str = "mh_id", consecutive_by: str | None = None) -> DataFrame:
    """(line_id, src, dst), src < dst, of all pairs of points on one line.

    With ``consecutive_by`` (a position along the line) only neighbours along the line are paired.
    """
    if consecutive_by:
        after = F.lead(point_id).over(W.partitionBy(line_id).orderBy(consecutive_by, point_id))
        out = hits.withColumn("other", after).where("other is not null")
        return out.select(line_id, F.least(point_id, "other").alias("src"), F.greatest(point_id, "other").alias("dst"))
    a = hits.select(line_id, F.col(point_id).alias("src"))
    b = hits.select(line_id, F.col(point_id).alias("dst"))
    return a.join(b, line_id).where("src < dst").select(line_id, "src", "dst")


def lines_with_points(hits: DataFrame, at_least: int = 2, line_id: str = "line_id") -> DataFrame:
    """(line_id, n_points) of lines that hold ``at_least`` points."""
    return hits.groupBy(line_id).agg(F.count("*").alias("n_points")).where(F.col("n_points") >= at_least)


def without_self_loops(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    return edges.where(F.col(src) != F.col(dst))


def symmetric(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges of one node type in both directions, without repeats."""
    back = edges.select(*(F.col({src: dst, dst: src}.get(c, c)).alias(c) for c in edges.columns))
    return edges.unionByName(back).distinct()


def reversed_relation(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """The edges of a relation between two node types, turned round; attributes stay."""
    return edges.select(*(F.col({src: dst, dst: src}.get(c, c)).alias(c) for c in edges.columns))


def rows_in(df: DataFrame, column: str, ids: DataFrame, id_column: str) -> DataFrame:
    """Rows whose ``column`` is among ``ids`` (a semi join; rows aren't repeated). The ids don't pass through the driver."""
    return df.join(ids.select(F.col(id_column).alias(column)).hint("merge"), column, "left_semi").select(df.columns)


def both_ends_in(edges: DataFrame, ids: DataFrame, id_column: str, src: str = "src", dst: str = "dst") -> DataFrame:
    return rows_in(rows_in(edges, src, ids, id_column), dst, ids, id_column)


def either_end_in(edges: DataFrame, ids: DataFrame, id_column: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges with at least one end among ``ids``."""
    one = ids.select(F.col(id_column)).distinct()
    a = one.select(F.col(id_column).alias(src), F.lit(True).alias("__a"))
    b = one.select(F.col(id_column).alias(dst), F.lit(True).alias("__b"))
    return edges.join(a, src, "left").join(b, dst, "left").where("__a or __b").select(edges.columns)


def labelled_edges(positive: DataFrame, negative: DataFrame) -> DataFrame:
    """Union of (src, dst) tables with label 1.0 and 0.0."""
    return positive.select("src", "dst", F.lit(1.0).alias("label")).unionByName(negative.select("src", "dst", F.lit(0.0).alias("label")))


def split_statistics(tables: dict[str, DataFrame], split: str = "split") -> DataFrame:
    """One row per split with the number of rows of each table, as ``n_<name>``; 0 where a split has none."""
    out = None
    for name, df in tables.items():
        n = df.groupBy(split).agg(F.count("*").alias(f"n_{name}"))
        out = n if out is None else out.join(n, split, "full_outer")
    return out.na.fill(0)


def induced(
    nodes: DataFrame, mh_mh: DataFrame, near: DataFrame, road_road: DataFrame, split: str = "split"
) -> dict[str, DataFrame]:
    """Per-split heterogeneous subgraphs in one pass, before relabelling.

    ``nodes`` is (node_id, split); ``mh_mh`` (src, dst, ...) keeps edges with either end in a split;
    ``near`` (index_mh, index_road, ...) those of the split's nodes; roads are those near them and
    ``road_road`` (src, dst) those with both ends among them.
    """
    a = nodes.select(F.col("node_id").alias("src"), split)
    b = nodes.select(F.col("node_id").alias("dst"), split)
    pipes = mh_mh.join(a, "src").unionByName(mh_mh.join(b, "dst")).distinct()
    near_in = near.join(nodes.select(F.col("node_id").alias("index_mh"), split), "index_mh")
    roads = near_in.select(F.col("index_road").alias("road_id"), split).distinct()
    both = road_road.join(roads.withColumnRenamed("road_id", "src"), "src").join(roads.withColumnRenamed("road_id", "dst"), ["dst", split])
    return {"pipes": pipes, "near": near_in, "roads": roads, "road_road": both.select("src", "dst", split)}
