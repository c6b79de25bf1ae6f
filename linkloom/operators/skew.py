"""Equi-joins where one key may hold a third of all rows.

Adaptive execution splits a large join partition from a size in bytes on. Below it, or before a stage
that wants its rows dealt by the key, a hub still makes one long task. Here the hubs are found by
counting and met in slices: their rows are dealt by a hash, and their row of the other
side is repeated for each slice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key of fewer rows is no hub.
LEAST = 20_000


def hubs(rows: DataFrame, key: str, least: int = LEAST) -> DataFrame | None:
    """(key, slices) of keys with more than a quarter of a partition's even share of the rows; None without any.

    At most four times as many keys as there are shuffle partitions can be hubs, so the table may be broadcast.
    """
    spark = rows.sparkSession
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"))
    total, most = counts.agg(F.sum("__n"), F.max("__n")).first()
    limit = max(least, (total or 0) // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    if (most or 0) <= limit:
        return None
    found = counts.where(F.col("__n") > limit).select(key, F.ceil(F.col("__n") / limit).cast("int").alias("__slices"))
    return spark.createDataFrame(found.collect(), found.schema)


def shuffled_join(rows: DataFrame, other: DataFrame, on: str) -> DataFrame:
    """An inner join that deals both sides by the key.

    The planner knows a table read from files by their compressed bytes and takes no account of rows that explode: a side of a few
    megabytes by that estimate may be gigabytes as a broadcast, all of which pass through the driver.
    """
    return rows.join(other.hint("merge"), on)


def sliced_join(rows: DataFrame, other: DataFrame, on: str, found: DataFrame | None) -> DataFrame:
    """``rows`` joined with ``other`` on the column ``on``; the hubs ``found`` are met in slices. Rows may repeat on either side."""
    if found is None:
        return shuffled_join(rows, other, on)
    slices = F.coalesce("__slices", F.lit(1))
    a = rows.join(F.broadcast(found), on, "left").withColumn("__slice", F.pmod(F.xxhash64(*rows.columns), slices).cast("int")).drop("__slices")
    b = other.join(F.broadcast(found), on, "left").withColumn("__slice", F.explode(F.sequence(F.lit(0), slices - 1))).drop("__slices")
    return a.join(b.hint("merge"), [on, "__slice"]).drop("__slice")


def hub_join(rows: DataFrame, other: DataFrame, on: str, counted: DataFrame | None = None, least: int = LEAST) -> DataFrame:
    """``sliced_join`` with the hubs of ``rows``.

    ``counted`` is a table with the same counts per key that is cheaper to read, ``rows`` itself by default.
    """
    return sliced_join(rows, other, on, hubs(rows if counted is None else counted, on, least))
