"""Seeded splits and samples. Order comes from md5 of key and seed: the same on any partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.operators.components import checkpoint
from linkloom.operators.ids import dense_id
from linkloom.operators.skew import hubs, sliced_join


def seeded(seed: int, *keys: Column | str) -> Column:
    """Hex digest that orders rows at random."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", *(c.cast("string") for c in cols), F.lit(str(seed))))


def draw(seed: int, modulus: int, *keys: Column | str) -> Column:
    """A number in [0, modulus) from the first 48 bits of the digest."""
    return F.conv(F.substring(seeded(seed, *keys), 1, 12), 16, 10).cast("long") % modulus


def ratio_split(
    components: DataFrame, ratio: Sequence[int] = (6, 2, 2), names: Sequence[str] = ("train", "val", "test"), seed: int = 42
) -> DataFrame:
    """(component, split): distinct components in seeded order, cut by integer floors of ``ratio``.

    The remainder goes to the last part; parts of ratio 0 are empty.
    """
    ordered = dense_id(components.select("component").distinct(), [seeded(seed, "component"), "component"], "pos")
    n = ordered.count()
    total, end, split = sum(ratio), 0, F.lit(names[-1])
    bounds = []
    for r, name in list(zip(ratio, names, strict=True))[:-1]:
        end += n * r // total
        bounds.append((end, name))
    for end, name in reversed(bounds):
        split = F.when(F.col("pos") < end, F.lit(name)).otherwise(split)
    return ordered.select("component", split.alias("split"))


def negative_edges(
    positive: DataFrame, n_nodes: int, count: int | None = None, seed: int = 42, directed: bool = False, oversample: int = 2
) -> DataFrame:
    """(draw_id, src, dst): ``count`` (as many as positives) distinct non-edges among nodes 0..n_nodes-1.

    Ordered pairs without self-loops; with ``directed`` only the stored direction of a positive is
    excluded. Draws are taken by their number, and the round of draws grows until there are
    enough. A dense graph, where a quarter of the non-edges or more is wanted, numbers its complement in seeded order instead,
    which is another sample than draws would give. Fewer rows come back only if the complement is smaller.
    """
    spark = positive.sparkSession
    taken = positive.select("src", "dst")
    if not directed:
        taken = taken.unionByName(taken.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    taken = checkpoint(taken.where("src <> dst").distinct())  # read by every round of draws
    count = positive.count() if count is None else count
    pairs = n_nodes * (n_nodes - 1)
    free = pairs - taken.count()
    count = min(count, free)
    if count * 4 > free:  # dense: every pair by number
        every = spark.range(n_nodes * n_nodes).select((F.col("id") / n_nodes).cast("long").alias("src"), (F.col("id") % n_nodes).alias("dst"))
        left = every.where("src <> dst").join(taken, ["src", "dst"], "left_anti")
        return dense_id(left, [seeded(seed, "src", "dst"), "src", "dst"], "draw_id").where(F.col("draw_id") < count).select("draw_id", "src", "dst")
    while True:
        rows = spark.range(max(1, oversample * count)).select(
            "id", draw(seed, n_nodes, "id", F.lit("s")).alias("src"), draw(seed, n_nodes, "id", F.lit("d")).alias("dst")
        )
        rows = rows.where("src <> dst").groupBy("src", "dst").agg(F.min("id").alias("draw"))
        rows = dense_id(rows.join(taken, ["src", "dst"], "left_anti"), ["draw"], "draw_id")
        if rows.count() >= count:
            return rows.where(F.col("draw_id") < count).select("draw_id", "src", "dst")
        oversample *= 2


def mini_batches(edges: DataFrame, size: int, order: Sequence[str], seed: int | None = None, max_batches: int | None = None) -> DataFrame:
    """Add ``batch_id`` in the fixed order, or in a seeded one; the first ``max_batches`` if given."""
    by = [seeded(seed, *order), *order] if seed is not None else list(order)
    out = dense_id(edges, by, "__pos").withColumn("batch_id", F.floor(F.col("__pos") / size)).drop("__pos")
    return out if max_batches is None else out.where(F.col("batch_id") < max_batches)


def sample_neighbours(seeds: DataFrame, edges: DataFrame, fan_out: Sequence[int] = (20, 10), seed: int = 42) -> DataFrame:
    """(batch_id, hop, rel, src, dst) of edges into the frontier, at most k per node, hop and relation.

    ``seeds`` is (batch_id, node), ``edges`` (rel, src, dst). The next frontier is the sources of the
    sampled edges. Which edges stay is decided by a seeded hash: the k smallest, which merge. A node with a
    large share of all edges is met in slices, every task keeps the k smallest of a node that it has (a limit
    of the window's groups before the shuffle, for k up to ``spark.sql.optimizer.windowGroupLimitThreshold``), and only those meet.
    """
    found = hubs(edges, "dst")
    frontier = seeds.select("batch_id", F.col("node").alias("dst")).distinct()
    out = None
    for hop, k in enumerate(fan_out, 1):
        near = sliced_join(edges.select("rel", "src", "dst"), frontier, "dst", found).select("batch_id", F.lit(hop).alias("hop"), "rel", "src", "dst")
        order = W.partitionBy("batch_id", "rel", "dst").orderBy(seeded(seed, "batch_id", "hop", "rel", "src", "dst"), "src")
        near = near.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= k).drop("__rank")
        near = checkpoint(near) if hop < len(fan_out) else near  # read twice: as a result and as the next frontier
        out = near if out is None else out.unionByName(near)
        frontier = near.select("batch_id", F.col("src").alias("dst")).distinct()
    return out
