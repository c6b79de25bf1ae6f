"""Connected components by contraction, and lineage cuts.

Every task first replaces its edges by a spanning forest of stars, in buffers of ``FOREST`` edges, and again in
tasks of ``FILE_ROWS`` edges; on a small graph that is nearly all of the work. Then in each round every vertex goes to the least vertex of its neighbourhood, itself included, and the edges
are drawn between the places they went to, until none is left. The first round takes the order of the
vertices, which empties a star at once; later ones take a fresh hash order, so that a constant share of
the vertices goes each time whatever the graph (randomised contraction, Bögeholz et al., 2020). Edges and
vertices shrink from round to round, and the maps of the rounds are put together backwards.

A vertex that touches a third of all edges is met in three places: its least neighbour is combined before the
shuffle; the joins that move its edges meet it in slices (``skew``); and repeated edges are combined before their shuffle. Every table that is used twice is written
to the shared folder, so a lost executor costs one step at most, and the planner knows its true size.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators.skew import hub_join

FOREST = 400_000
FILE_ROWS = 50_000
#: Edges from which on a round looks for hubs: fewer are a short task on one key, too.
HUB_EDGES = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the context's own.

    Without either a local session gets a temporary folder; on a cluster that is an error, as each
    executor would write to its own disk.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoints-")
        sc.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder that the session names.

    The rows are kept on the executors' disks while they are written, as a checkpoint computes its plan twice
    otherwise; the planner sees their true size from then on.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    df = df.persist(StorageLevel.DISK_ONLY)
    out = df.select("*").coalesce(_files(df.count())).checkpoint()
    df.unpersist()
    return out


def _files(rows: int) -> int:
    """Files that so many rows are worth: small tables don't become hundreds of them."""
    return max(1, -(-rows // FILE_ROWS))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def least_roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least vertex of the component of each vertex 0..n-1, by hooking greater roots to smaller ones and pointer jumping."""
    parent = np.arange(n)
    while len(u):
        u, v = parent[u], parent[v]
        apart = u != v
        u, v = u[apart], v[apart]
        np.minimum.at(parent, np.maximum(u, v), np.minimum(u, v))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up
    return parent


def _numbered(columns: list[pa.Array]) -> tuple[pa.Array, list[np.ndarray]]:
    """Distinct values in order, and each column as places among them."""
    both = pa.concat_arrays(columns)
    if pa.types.is_integer(both.type):
        values, place = np.unique(both.to_numpy(zero_copy_only=False), return_inverse=True)
        values = pa.array(values, both.type)
    else:
        coded = both.dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        values, place = coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy()]
    ends = np.cumsum([0] + [len(c) for c in columns])
    return values, [place[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]


def _stars(edges: DataFrame) -> DataFrame:
    """Edges (u, v), v < u, with the same components: stars of the spanning forests of each task's buffers of ``FOREST`` edges.

    A buffer is solved with arrays, all its edges at a time; the stars of a full buffer stay in it while they are few.
    """
    edges = edges.where("u <> v").select("u", "v")

    def solved(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        values, (u, v) = _numbered([pa.concat_arrays([b.column(i) for b in held]) for i in (0, 1)])
        root = least_roots(u, v, len(values))
        leaf = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([values.take(pa.array(leaf)), values.take(pa.array(root[leaf]))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows > FOREST:
                held = [solved(held)]
                rows = held[0].num_rows
                if rows > FOREST // 2:
                    yield held[0]
                    held, rows = [], 0
        if rows:
            yield solved(held)

    return edges.mapInArrow(run, edges.schema)


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(u, component) for every vertex that has an edge; component is its least vertex.

    ``edges`` has columns u and v of one orderable type. Null ends, self-loops and repeated
    edges are ignored; no edges give no rows.
    """
    spark = edges.sparkSession
    folder = f"{shared_folder(spark)}/components-{uuid.uuid4().hex}"

    def stored(df: DataFrame, name: str) -> DataFrame:
        df = df.coalesce(_files(2 * rows)) if rows else df  # vertices are at most twice the edges
        return written(df, name)

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    rows = 0
    left = written(_stars(edges).distinct(), "edges")
    rows = left.count()
    if rows:  # tasks of FILE_ROWS edges, whatever the number of shuffle partitions
        left = written(_stars(left.coalesce(_files(rows))), "edges-0")
    first = rows = left.count() if rows else 0
    maps: list[DataFrame] = []  # (u, m): where the vertices of each round went
    while rows:
        if len(maps) == max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        if not maps:
            least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        else:
            seed = F.lit(len(maps))
            least = both.groupBy("u").agg(F.min(F.struct(F.xxhash64(seed, "v").alias("h"), F.col("v").alias("m"))).alias("s"))
            least = least.select("u", F.least("s", F.struct(F.xxhash64(seed, "u").alias("h"), F.col("u").alias("m")))["m"].alias("m"))
        at = stored(least, f"map-{len(maps)}")
        maps.append(at)
        if rows > HUB_EDGES:
            moved = hub_join(left, at, "u").select(F.col("m").alias("u"), "v")
            moved = hub_join(moved, at.withColumnRenamed("u", "v"), "v", counted=left)
        else:
            moved = left.join(at, "u").select(F.col("m").alias("u"), "v").join(at.withColumnRenamed("u", "v"), "v")
        moved = _stars(moved.select("u", F.col("m").alias("v"))).distinct()
        left = written(_stars(moved.coalesce(_files(rows))), f"edges-{len(maps)}")
        rows = left.count()
    rows = first
    if maps:
        found = maps.pop()
        for at in reversed(maps):  # a place that has no edge in later rounds is where it stays
            later = found.select(F.col("u").alias("m"), F.col("m").alias("n"))
            found = stored(at.join(later, "m", "left").select("u", F.coalesce("n", "m").alias("m")), f"found-{uuid.uuid4().hex}")
        names = stored(found.groupBy("m").agg(F.min("u").alias("component")), "names")
        out = found.join(names, "m").select("u", "component")
    else:
        out = left.select("u", F.col("v").alias("component"))
    out = checkpoint(out)
    remove(spark, folder)
    return out


def label_components(vertices: DataFrame, edges: DataFrame, vertex: str = "node_id") -> DataFrame:
    """Every vertex with its component; one without edges is a component of its own."""
    found = components(edges).withColumnRenamed("u", vertex)
    return vertices.join(found, vertex, "left").withColumn("component", F.coalesce("component", vertex))


def component_sizes(labelled: DataFrame) -> DataFrame:
    """(component, size), to be ordered by size."""
    return labelled.groupBy("component").agg(F.count("*").alias("size"))
