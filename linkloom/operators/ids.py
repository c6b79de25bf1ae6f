"""Row identity and running sums over a global order, without a single-partition window.

Rows are range-partitioned on the order, written once (so that both passes see the same
partitions), counted per partition, and the partitions' offsets - one row per partition -
are broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.operators.components import checkpoint


def parted(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """The rows dealt by ranges of the order and written, with the number of their range as ``__part``."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpoint(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))


def dense_id(df: DataFrame, order: Sequence[Column | str], name: str = "id", start: int = 0) -> DataFrame:
    """Number all rows from ``start`` in the given order, which should be total."""
    return running(df, order, {name: F.lit(1)}).withColumn(name, F.col(name) - 1 + start)


def running(df: DataFrame, order: Sequence[Column | str], sums: dict[str, Column]) -> DataFrame:
    """Add running sums, the row itself included, in the given order."""
    rows = parted(df.withColumns({f"__v_{k}": v for k, v in sums.items()}), order)
    per = rows.groupBy("__part").agg(*(F.sum(f"__v_{k}").alias(f"__t_{k}") for k in sums))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    per = per.select("__part", *(F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__o_{k}") for k in sums))
    inner = W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = rows.join(F.broadcast(per), "__part").withColumns({k: F.sum(f"__v_{k}").over(inner) + F.col(f"__o_{k}") for k in sums})
    return out.drop("__part", *(f"__v_{k}" for k in sums), *(f"__o_{k}" for k in sums))


def dense_id_within(df: DataFrame, group: str, order: Sequence[Column | str], name: str = "id") -> DataFrame:
    """Number rows from 0 inside each group of a few (splits): global numbers less the group's first."""
    out = dense_id(df, [group, *order], name)
    first = out.groupBy(group).agg(F.min(name).alias("__first"))
    return out.join(first, group).withColumn(name, F.col(name) - F.col("__first")).drop("__first")


def relabel(df: DataFrame, column: str, mapping: DataFrame, old: str = "old", new: str = "new", on: Sequence[str] = ()) -> DataFrame:
    """Replace ids by ``mapping``; ids without a row become null. ``on`` are further shared keys."""
    m = mapping.select(F.col(old).alias(column), F.col(new).alias("__new"), *on)
    return df.join(m, [column, *on], "left").withColumn(column, F.col("__new")).drop("__new")
