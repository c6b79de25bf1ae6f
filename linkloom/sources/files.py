"""Files as rows: listed by tasks level by level, digested in chunks, with checksum sidecars.

No list of names passes through the driver: a level's folders are a table, tasks list them, and the folders found
are the next level. Local paths and the stores that pyarrow opens (hdfs, s3, gs, abfs) are read by tasks; other schemes
are listed by Spark's own reader, which leaves out empty files.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators.components import checkpoint, remove, shared_folder

CHUNK = 4 << 20
#: Deeper folders are taken for a loop of links.
MAX_DEPTH = 100
SIDECAR = ".sha256"
OPENED = ("", "file", "hdfs", "s3", "s3a", "gs", "gcs", "abfs", "abfss")


def _scheme(path: str) -> str:
    head = path.split(":", 1)[0]
    return head if ":" in path and "/" not in head else ""


def _store(path: str) -> tuple[pafs.FileSystem, str, str]:
    """(file system, path in it, what stands before that path)."""
    if _scheme(path) in ("", "file"):
        inner = "/" + path.removeprefix("file:").lstrip("/") if _scheme(path) else path
        return pafs.LocalFileSystem(), inner, path[: len(path) - len(inner)] if path.endswith(inner) else ""
    fs, inner = pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return fs, inner, path[: path.rfind(inner)] if inner in path else ""


def _listed(batches: Iterator[pa.RecordBatch], rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """(group, path, length, folder) of what stands in each path; a path that doesn't exist has nothing, a file itself."""
    for batch in batches:
        for group, path in zip(batch["group"].to_pylist(), batch["path"].to_pylist(), strict=True):
            fs, inner, head = _store(path)
            info = fs.get_file_info(inner)
            if info.type == pafs.FileType.Directory:
                got = fs.get_file_info(pafs.FileSelector(inner, recursive=False))
            else:
                got = [info] if info.type == pafs.FileType.File else []
            for at in range(0, len(got), rows):
                part = got[at : at + rows]
                folder = [i.type == pafs.FileType.Directory for i in part]
                columns = [[group] * len(part), [head + i.path for i in part], [0 if d else i.size for i, d in zip(part, folder, strict=True)], folder]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.bool_()), strict=True)], names=["group", "path", "length", "folder"])


def list_files(spark: SparkSession, groups: Mapping[str, Iterable[str]], choose: Sequence[str] | None = None) -> DataFrame:
    """(group, path, length) of all files below each group's roots, empty ones too.

    ``.gitkeep`` and roots that don't exist are left out, as are groups that aren't chosen. A folder is listed by one task.
    """
    roots = [(g, r.rstrip("/") or "/") for g, each in groups.items() if choose is None or g in choose for r in each]
    own = [(g, r) for g, r in roots if _scheme(r) in OPENED]
    folder = f"{shared_folder(spark)}/listing-{uuid.uuid4().hex}"
    level = spark.createDataFrame(own, "group string, path string")
    schema = "group string, path string, length long, folder boolean"
    out, depth = spark.createDataFrame([], schema), 0
    while not level.isEmpty():
        if depth > MAX_DEPTH:
            raise ValueError(f"folders nested deeper than {MAX_DEPTH}: a loop of links?")
        found = level.repartition("group", "path").mapInArrow(_listed, schema)
        found.write.parquet(f"{folder}/{depth}")
        found = spark.read.schema(schema).parquet(f"{folder}/{depth}")
        out, level, depth = out.unionByName(found), found.where("folder").select("group", "path"), depth + 1
    for g, r in roots:
        if (g, r) not in own:
            out = out.unionByName(_by_reader(spark, g, r))
    out = checkpoint(out.where("not folder").where(~F.col("path").endswith("/.gitkeep")).select("group", "path", "length"))
    remove(spark, folder)
    return out


def _by_reader(spark: SparkSession, group: str, root: str) -> DataFrame:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "group string, path string, length long, folder boolean")
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return df.select(F.lit(group).alias("group"), "path", "length", F.lit(False).alias("folder"))


def file_totals(files: DataFrame) -> DataFrame:
    """(group, n_files, n_bytes)."""
    return files.groupBy("group").agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"))


def _digest(path: str, chunk: int = CHUNK) -> str | None:
    fs, inner, _ = _store(path)
    total = hashlib.sha256()
    try:
        with fs.open_input_stream(inner) as stream:
            while part := stream.read(chunk):
                total.update(part)
    except FileNotFoundError:
        return None
    return total.hexdigest()


def _each(files: DataFrame, fn, schema: str) -> DataFrame:
    """Rows of ``fn(path)``, a few files per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                row = fn(path)
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema([(n, pa.bool_() if isinstance(v, bool) else pa.string()) for n, v in row.items()]))

    return files.select("path").repartition("path").mapInArrow(run, schema)


def digests(files: DataFrame) -> DataFrame:
    """(path, sha256) of files of any size, read through in chunks by a task each; null for a file that has gone."""
    return _each(files, lambda path: {"path": path, "sha256": _digest(path)}, "path string, sha256 string")


def manifest(files: DataFrame) -> DataFrame:
    """(path, name, length, sha256)."""
    named = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    return named.join(digests(files), "path")


def verify(files: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, ok) for each name of (name, sha256): digests compared in any case; a file that is missing is not ok."""
    have = manifest(files).select("name", F.col("sha256").alias("got"))
    both = expected.select("name", "sha256").join(have, "name", "left")
    return both.select("name", F.coalesce(F.lower("sha256") == F.lower("got"), F.lit(False)).alias("ok"))


def _write_sidecar(path: str) -> dict:
    digest = _digest(path)
    if digest is None:
        raise FileNotFoundError(path)
    fs, inner, _ = _store(path)
    part = f"{inner}{SIDECAR}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(f"{digest}  {inner.rsplit('/', 1)[-1]}\n".encode())
    fs.move(part, inner + SIDECAR)  # in one step, so that a task that runs twice leaves one whole file
    return {"path": path, "sidecar": path + SIDECAR, "sha256": digest}


def write_sidecars(files: DataFrame) -> DataFrame:
    """Write ``<file>.sha256`` beside each file, in the form of checksum tools, and return (path, sidecar, sha256). Sidecars get none."""
    plain = files.where(~F.col("path").endswith(SIDECAR))
    return checkpoint(_each(plain, _write_sidecar, "path string, sidecar string, sha256 string"))


def _check_sidecar(path: str) -> dict:
    fs, inner, _ = _store(path)
    try:
        with fs.open_input_stream(inner + SIDECAR) as stream:
            wanted = stream.read().decode("utf-8", "replace").split()
    except FileNotFoundError:
        wanted = []
    return {"path": path, "ok": bool(wanted) and wanted[0].lower() == _digest(path)}


def verify_sidecars(files: DataFrame) -> DataFrame:
    """(path, ok) of each file but the sidecars: whether its digest is that of its sidecar, in any case; without a sidecar it isn't."""
    return _each(files.where(~F.col("path").endswith(SIDECAR)), _check_sidecar, "path string, ok boolean")
