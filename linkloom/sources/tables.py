"""Readers and writers of layers, interim tables, split graphs and experiment logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.functions import geometry as G

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
LINE = T.ArrayType(POINT)
NEAR = T.StructType(
    [
        T.StructField("mh_id", T.LongType()), T.StructField("objectid", T.LongType()), T.StructField("near_fid", T.LongType()),
        T.StructField("near_pos", T.DoubleType()), T.StructField("near_dist", T.DoubleType()), T.StructField("side", T.IntegerType()),
    ]
)
INTERIM = ("anchors", "roads", "lines", "near_edges", "road_edges", "split")
#: Columns of an experiment log, in file order.
LOG_COLUMNS = ("Model Size", "Dropout", "Phase", "Epochs", "Training Loss", "Validation Loss", "AUC", "F1", "Precision", "Recall", "Accuracy", "MCC")


def read_layer(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet", wkt: str | None = None) -> DataFrame:
    """A layer with the given schema; a WKT text column becomes ``coords``."""
    options = {"header": "true"} if fmt == "csv" else {}
    df = spark.read.schema(schema).format(fmt).options(**options).load(path)
    return df.withColumn("coords", G.from_wkt(F.col(wkt))).drop(wkt) if wkt else df


def read_near(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_layer(spark, path, NEAR, fmt)


def write_interim(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Write the six interim tables; an unknown or missing name is an error."""
    if set(tables) != set(INTERIM):
        raise ValueError(f"interim tables are {', '.join(INTERIM)}")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def read_interim(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in INTERIM}


def write_splits(df: DataFrame, folder: str, splits: Sequence[str] | None = None) -> None:
    """One folder per split; only ``splits`` if given."""
    out = df if splits is None else df.where(F.col("split").isin(*splits))
    out.write.mode("overwrite").partitionBy("split").parquet(folder)


def read_split(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """Rows of one split; the others' folders are not read."""
    return spark.read.parquet(folder).where(F.col("split") == split)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """An experiment log whose header may repeat: rows without a number as size are left out."""
    raw = spark.read.option("header", True).csv(path)
    kinds = {"Model Size": "int", "Phase": "string", "Epochs": "int"}
    cast = [F.expr(f"try_cast(`{c}` as {kinds.get(c, 'double')})").alias(c.lower().replace(" ", "_")) for c in LOG_COLUMNS]
    return raw.select(*cast).withColumnRenamed("model_size", "size").where("size is not null and dropout is not null")


def append_log(rows: DataFrame, path: str) -> None:
    """Append result rows (12 columns, any case) as CSV with a header in each file."""
    names = {c.lower().replace(" ", "_"): c for c in LOG_COLUMNS} | {"size": "Model Size"}
    out = rows.select(*(F.col(c).alias(names.get(c, c)) for c in rows.columns)).select(*LOG_COLUMNS)
    out.write.mode("append").option("header", True).csv(path)


def export_lines(lines: DataFrame, folder: str, srid: int = 4326) -> None:
    """Lines of each split as WKT text with the tag of their reference system."""
    out = lines.withColumns({"wkt": G.to_wkt(F.col("coords")), "srid": F.lit(srid)}).drop("coords")
    out.write.mode("overwrite").partitionBy("split").parquet(folder)
