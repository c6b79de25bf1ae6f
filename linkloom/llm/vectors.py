"""Embedding near-dedup: subspace pigeonhole join.

Unit vectors of one label whose cosine is at least c have a squared distance of at most
2 - 2c. After a fixed random rotation the dimensions are cut into blocks; in one block at
least the squared distance is within the block's share of that budget (the pigeonhole).

1. Each block is range-joined on its own: a grid over the block's first coordinates, with
   cells as wide as the block's radius, brings every pair within the budget to one cell.
   Only the block's coordinates travel. Crowded cells are compared in slices. A task
   ties its candidates by spanning edges, never by all pairs.
2. Components of the ties are coarse clusters that hold every candidate pair of any block.
3. Pairs inside a cluster are verified exactly in double precision, in slices of whole
   vectors; counts of links and spanning edges come out.

Equal vectors are one class from the start.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import map_arrow, run_groups, table
from linkloom.llm.jaccard import forest
from linkloom.operators.components import checkpoint, components

COSINE = 0.93
BLOCKS = 4
GRID_DIMS = 2
SLICE = 512  # whole vectors
CELL_SLICE = 4096  # coordinates of one block


def rotation(dims: int, seed: int = 5) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def block_edges(dims: int, blocks: int) -> list[tuple[int, int]]:
    cut = np.linspace(0, dims, min(blocks, dims) + 1).astype(int)
    return list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))


def _as_matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length; the bytes are those of float64."""
    return np.stack([np.frombuffer(b, np.float64) for b in column.to_pylist()])


def _usable(rows: DataFrame) -> DataFrame:
    """(vec_id, label, dims, vector as float64 bytes) without null, zero or non-finite vectors; labels keep their type."""

    def run(batch: pa.RecordBatch) -> dict:
        column = batch.column(2)
        values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # -0.0 becomes 0.0
        size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(len(size)), size)
        odd, full = (np.bincount(owner, w, len(size)) for w in (~np.isfinite(values), values != 0))
        good = (odd == 0) & (full > 0) & batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        off = np.r_[0, np.cumsum(size[good]) * 8].astype(np.int32)
        v = pa.Array.from_buffers(pa.binary(), int(good.sum()), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(values[good[owner]].tobytes())])
        take = pa.array(np.flatnonzero(good))
        return {"vec_id": batch.column(0).take(take), "label": batch.column(1).take(take), "dims": size[good], "v": v}

    kind = rows.schema["label"].dataType.simpleString()
    return map_arrow(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding"), run, f"vec_id long, label {kind}, dims int, v binary")


def _cells(classes: DataFrame, cosine: float, blocks: int, grid_dims: int, width: int) -> DataFrame:
    """Rows (unit, cls, v, role) per block and cell: a class at home, and as a guest of half of the
    cells around, so that each pair of cells meets once.

    Roles are bits: 1 for a home row, 2 for one that home rows are compared with.
    """
    half = [s for s in itertools.product((-1, 0, 1), repeat=grid_dims) if s >= (0,) * grid_dims]

    def run(batch: pa.RecordBatch) -> dict:
        rows, cells, coords, home, share = [], [], [], [], []
        dims = batch.column(2).to_numpy(zero_copy_only=False)
        for d in np.unique(dims).tolist():
            at = np.flatnonzero(dims == d)
            x = _as_matrix(batch.column(3).take(pa.array(at)))
            x = x / np.abs(x).max(1, keepdims=True)  # keeps the norm of huge vectors finite
            x = x / np.linalg.norm(x, axis=1, keepdims=True) @ rotation(d)
            for k, (a, b) in enumerate(block_edges(d, blocks)):
                g = min(grid_dims, b - a)
                cell = np.zeros((len(at), grid_dims), np.int64)
                cell[:, :g] = np.floor(x[:, a : a + g] / np.sqrt(_budget(cosine, a, b, d)))
                data = np.ascontiguousarray(x[:, a:b], np.float32)
                packed = [r.tobytes() for r in data]
                for step in half:
                    if any(step[g:]):
                        continue
                    rows.append(at)
                    cells.append(np.c_[np.full((len(at), 2), (d, k)), cell + np.array(step)])
                    coords += packed
                    home.append(np.full(len(at), not any(step)))
                    share.append(np.full(len(at), _budget(cosine, a, b, d)))
        take = pa.array(np.concatenate(rows) if rows else np.zeros(0, int))
        flat = np.concatenate(cells).ravel() if cells else np.zeros(0, int)
        return {
            "label": batch.column(1).take(take), "cls": batch.column(0).take(take), "v": coords, "home": np.concatenate(home) if home else [],
            "cell": pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 2 + grid_dims, dtype=np.int32)), pa.array(flat)),
            "share": np.concatenate(share) if share else [],
        }

    schema = f"label {classes.schema['label'].dataType.simpleString()}, cls long, v binary, home boolean, cell array<long>, share double"
    rows = map_arrow(classes.select("vec_id", "label", "dims", "v"), run, schema).withColumn("cell", F.xxhash64("label", "cell"))
    sizes = rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("home").alias("lived")).where("lived and n > 1").select("cell", "n")
    rows = rows.join(sizes, "cell").withColumn("slices", F.ceil(F.col("n") / width).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("slices")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    same, keep = F.col("own") == F.col("other"), ("cls", "v", "share")
    first = rows.where("home").select(F.xxhash64("cell", "own", "other").alias("unit"), *keep, F.when(same, 3).otherwise(1).alias("role"))
    second = rows.where(~F.col("home") | ~same).select(F.xxhash64("cell", "other", "own").alias("unit"), *keep, F.lit(2).alias("role"))
    return first.unionByName(second)


def _budget(cosine: float, a: int, b: int, dims: int) -> float:
    """The block's share of the squared distance, with room for single precision."""
    return (2 - 2 * cosine) * (b - a) / dims * (1 + 1e-5) + 1e-5


def _ties(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Spanning edges (u, v) of the pairs within the block's budget."""
    for group in run_groups(batches, "unit"):
        ids, role = group.column("cls").to_numpy(), group.column("role").to_numpy()
        x = np.stack([np.frombuffer(b, np.float32) for b in group.column("v").to_pylist()])
        share = group.column("share")[0].as_py()
        home, all_ = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        square = (x * x).sum(1)
        found = []
        for at in range(0, len(home), rows):
            h = home[at : at + rows]
            i, j = np.nonzero(square[h][:, None] + square[all_][None, :] - 2 * x[h] @ x[all_].T <= share)
            i, j = h[i], all_[j]
            i, j = i[ids[i] != ids[j]], j[ids[i] != ids[j]]
            found += _span(i, j)
        if found:
            u, v = np.array(found).T
            yield pa.RecordBatch.from_arrays([pa.array(ids[u]), pa.array(ids[v])], names=["u", "v"])


def _span(i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the edges: at most one edge per vertex."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((max(a, b), min(a, b)))
    return out


def _verify(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """(cls, other, links): links of the classes in one pair of slices, and spanning edges."""
    names = ["cls", "other", "links"]
    for group in run_groups(batches, "unit"):
        side, within = group.column("side").to_numpy(), group.column("within")[0].as_py()
        ids, copies = group.column("cls").to_numpy(), group.column("copies").to_numpy()
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 0 if within else side == 1)
        if not len(a) or not len(b):
            continue
        x = _as_matrix(group.column("v").combine_chunks())
        x = x / np.abs(x).max(1, keepdims=True)
        norm = np.linalg.norm(x, axis=1)
        linked = x[a] @ x[b].T / (norm[a][:, None] * norm[b][None, :]) >= cosine
        full = np.zeros((len(ids), len(ids)), bool)
        full[np.ix_(a, b)] = linked
        full |= full.T
        np.fill_diagonal(full, False)
        links = full @ copies
        parent = forest(full)
        keep = np.flatnonzero(links)
        other = pa.array([int(ids[parent[i]]) if parent[i] != i else None for i in keep], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), other, pa.array(links[keep].astype(np.int64))], names=names)


def near_vectors(
    rows: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS, grid_dims: int = GRID_DIMS, width: int = SLICE
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors of equal, non-null labels of any type and of equal length are compared, long ones too. Null, empty, zero and
    non-finite vectors, and those of a null label, link with nothing. vec_id should be unique; rows
    that repeat a vec_id with the same vector count as copies. A pair at the bound is linked; ties change nothing. An empty table gives no rows; other
    columns are ignored.
    """
    usable = checkpoint(_usable(rows))
    classes = checkpoint(
        usable.groupBy("label", "dims", "v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    )
    units = _cells(classes, cosine, blocks, grid_dims, CELL_SLICE)
    units = units.repartition("unit").sortWithinPartitions("unit")
    coarse = components(units.mapInArrow(_ties, "u long, v long"))
    sizes = coarse.groupBy("component").agg(F.count("*").alias("m"))
    members = coarse.join(sizes, "component").withColumnRenamed("u", "vec_id").withColumn("slices", F.ceil(F.col("m") / width).cast("int"))
    members = members.withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("slices")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    pairs = classes.join(members, "vec_id").select(
        F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other")).alias("unit"), F.col("vec_id").alias("cls"), "v", "copies",
        (F.col("own") > F.col("other")).cast("int").alias("side"), (F.col("own") == F.col("other")).alias("within"),
    )
    pairs = pairs.repartition("unit").sortWithinPartitions("unit")
    found = checkpoint(pairs.mapInArrow(lambda batches: _verify(batches, cosine), "cls long, other long, links long"))
    joined = components(found.where("other is not null").select(F.col("cls").alias("u"), F.col("other").alias("v")))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    info = (
        classes.select("label", "dims", "v", F.col("vec_id").alias("cls"), "copies")
        .join(links, "cls", "left").join(joined.withColumnRenamed("u", "cls"), "cls", "left")
        .select("label", "dims", "v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "cls").alias("component_id"))
    )
    good = usable.join(info, ["label", "dims", "v"]).select("vec_id", "n_links", "component_id")
    bad = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").where(~_is_usable()).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return good.unionByName(bad).withColumn("kept", F.expr("vec_id <=> component_id"))


def _is_usable():
    finite = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return F.coalesce(F.col("label").isNotNull() & finite & F.exists("embedding", lambda e: e != 0), F.lit(False))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH RECURSIVE
doubles AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
usable AS MATERIALIZED (
  SELECT vec_id, label, v, sqrt(list_inner_product(v, v)) AS length FROM doubles
  WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS u, b.vec_id AS v FROM usable a JOIN usable b ON a.label = b.label AND len(a.v) = len(b.v)
  WHERE a.vec_id <> b.vec_id AND list_inner_product(a.v, b.v) / (a.length * b.length) >= 0.93),
reach AS (SELECT DISTINCT u, u AS w FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.w = l.u),
least AS (SELECT u, min(w) AS least FROM reach GROUP BY u),
linked AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(least, vec_id) AS component_id, coalesce(least, vec_id) = vec_id AS kept
FROM embeddings e LEFT JOIN least ON least.u = e.vec_id LEFT JOIN linked ON linked.u = e.vec_id
"""
