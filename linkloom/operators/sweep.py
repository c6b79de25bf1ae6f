"""A sweep over sizes and dropouts that can be taken up again: losses per epoch, early stopping, rows of the result log.

The link model of a setting scores ``w . relu(R x) + b``: a fixed seeded layer of ``size`` units, of which training hides a
seeded share, and weights fitted by Adam on the mean logistic loss of all training rows. An epoch is one pass: tasks
add up losses, counts and the gradient of their rows as one vector per phase, which are merged before two rows
reach the driver. Three rows of a setting are appended as soon as it ends; a later start leaves out what the log has.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as KINDS

from linkloom.operators.components import checkpoint
from linkloom.operators.matrix import HELD, NUMBER, VECTOR, from_matrix, map_vectors, merged, to_matrix
from linkloom.operators.metrics import METRICS, binary_metrics
from linkloom.sources import tables as T

#: Phases of the log, in the order of their rows.
PHASES = ("Training", "Validation", "Testing")
_U = np.uint64


@dataclass
class Fit:
    """Weights (the last is the bias) of the best epoch, its number, the epochs run, and the losses of each epoch."""

    weights: np.ndarray
    best: int
    epochs: int
    train: list[float]
    val: list[float]


def first_layer(size: int, dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, size, dims]).standard_normal((size, dims)) / np.sqrt(dims)


def units(x: np.ndarray, layer: np.ndarray) -> np.ndarray:
    """Hidden values and a one for the bias."""
    return np.c_[np.maximum(x @ layer.T, 0.0), np.ones(len(x))]


def hidden_by_dropout(keys: np.ndarray, size: int, dropout: float, seed: int, epoch: int) -> np.ndarray:
    """0 for hidden units, and what makes up for them for the others: by a hash of row, unit, epoch and seed."""
    h = keys.astype(np.int64).view(_U)[:, None] * _U(0x9E3779B97F4A7C15) + (np.arange(size, dtype=_U) + _U(1)) * _U(0xBF58476D1CE4E5B9)
    h = h + _U((seed * 1_000_003 + epoch + 1) * 0x94D049BB133111EB & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> _U(shift))) * _U(factor)
    kept = (h >> _U(11)).astype(float) / 2.0**53 >= dropout
    return np.c_[kept / (1.0 - dropout), np.ones(len(keys))]


def losses(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0.0) - z * y + np.log1p(np.exp(-np.abs(z)))


def epoch_states(rows: DataFrame, dims: int, layer: np.ndarray, w: np.ndarray, dropout: float, seed: int, epoch: int) -> DataFrame:
    """(phase, state): one row per task and phase with the sum of losses, the rows, and (in training) the sum of gradients.

    A row's losses and gradient are summed where they are computed, and never leave the task.
    """
    schema = KINDS.StructType([KINDS.StructField("phase", KINDS.StringType()), KINDS.StructField("state", VECTOR)])
    sent = rows.sparkSession.sparkContext.broadcast((layer, w))
    at_once = max(1, HELD // max(dims + 3, len(w) + 2))

    def summed(data: np.ndarray) -> np.ndarray:
        layer, w = sent.value
        keys, label, train, h = data[:, 0], data[:, 1], data[:, 2] > 0, units(data[:, 3:], layer)
        if dropout > 0:
            h = np.where(train[:, None], h * hidden_by_dropout(keys, len(layer), dropout, seed, epoch), h)
        z = h @ w
        slope = np.where(train, 1 / (1 + np.exp(-z.clip(-500, 500))) - label, 0.0)
        return np.r_[losses(z, label).sum(), len(z), slope @ h]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                data, ok = to_matrix(part["row"], dims + 3)
                for phase in pc.unique(part["phase"]).drop_null().to_pylist():
                    here = ok & pc.fill_null(pc.equal(part["phase"], phase), False).to_numpy(zero_copy_only=False)
                    if here.any():
                        total[phase] = total.get(phase, 0.0) + summed(data[here])
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), from_matrix(np.array(list(total.values())))], names=schema.names)

    return rows.select("phase", "row").mapInArrow(run, schema)


def _epoch(rows: DataFrame, dims: int, layer: np.ndarray, w: np.ndarray, dropout: float, seed: int, epoch: int) -> dict[str, np.ndarray]:
    """Per phase: sum of losses, rows, and (in training) the sum of gradients."""
    out = epoch_states(rows, dims, layer, w, dropout, seed, epoch)
    return {r["phase"]: np.array(r["v"]) for r in merged(out, "phase", "state", len(w) + 2, partitions=2).collect()}  # two rows


def fit(
    rows: DataFrame, dims: int, size: int, dropout: float = 0.0, seed: int = 42, rate: float = 0.05, max_epochs: int = 100, patience: int = 5, delta: float = 0.001
) -> Fit:
    """Fit on ``rows`` (phase, row: key, label, whether it trains, features), stopping as ``early_stopping`` does.

    The losses of an epoch are those of the weights it began with; dropout is for training rows only. Without training rows
    or validation rows there is nothing to fit, which is an error.
    """
    layer, w = first_layer(size, dims, seed), np.zeros(size + 1)
    mean, square = np.zeros_like(w), np.zeros_like(w)
    out, bad = Fit(w, 0, 0, [], []), 0
    for epoch in range(1, max_epochs + 1):
        got = _epoch(rows, dims, layer, w, dropout, seed, epoch)
        if not {"Training", "Validation"} <= set(got):
            raise ValueError("rows of training and validation are needed")
        train, val = got["Training"], got["Validation"]
        out.train.append(train[0] / train[1])
        out.val.append(val[0] / val[1])
        out.epochs = epoch
        if not out.best or -out.val[-1] >= -out.val[out.best - 1] + delta:
            out.best, out.weights, bad = epoch, w, 0
        else:
            bad += 1
            if bad >= patience:
                break
        gradient = train[2:] / train[1]
        mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        w = w - rate * (mean / (1 - 0.9**epoch)) / (np.sqrt(square / (1 - 0.999**epoch)) + 1e-8)
    return out


def scores(rows: DataFrame, dims: int, layer: np.ndarray, w: np.ndarray) -> DataFrame:
    """(phase, score, label) of all rows, without dropout."""

    def step(params: tuple, x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return {"score": units(x["row"][:, 3:], params[0]) @ params[1]}

    return map_vectors(rows, ["phase", "label"], {"row": dims + 3}, {"score": NUMBER}, step, (layer, w)).select("phase", "score", "label")


def open_settings(grid: DataFrame, done: DataFrame) -> DataFrame:
    """(size, dropout, phases): the settings of the grid with phases that the log lacks, and those it has; dropouts within 1e-12 are one."""
    key = F.round(F.col("dropout") * 1e12).cast("long").alias("__d")
    have = done.groupBy("size", key).agg(F.collect_set("phase").alias("phases"))
    out = grid.select("size", "dropout", key).distinct().join(have, ["size", "__d"], "left").withColumn("phases", F.coalesce("phases", F.array().cast("array<string>")))
    return out.where(~F.forall(F.lit(list(PHASES)), lambda p: F.array_contains("phases", p))).select("size", "dropout", "phases")


def read_done(spark: SparkSession, path: str) -> DataFrame:
    """(size, dropout, phase) of the log's rows; none where no log is yet."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "size int, dropout double, phase string")
    return T.read_log(spark, path).select("size", "dropout", "phase")


def sweep(features: DataFrame, dims: int, grid: DataFrame, path: str, threshold: float = 0.5, seed: int = 42, **how) -> int:
    """Fit every setting of ``grid`` (size, dropout) that the log at ``path`` lacks, and append its rows; returns how many were fitted.

    ``features`` is (key long, below 2**53, phase, label, features array<double> of ``dims`` numbers). Rows are those of the log's twelve columns: the losses are those
    of the best epoch; ``epochs`` is the best epoch in the training row and the epochs run in the others. The three
    rows of a setting are one file, written when it ends, so a sweep that is broken off goes on with the setting it was in.
    """
    spark = features.sparkSession
    train = (F.col("phase") == PHASES[0]).cast("double")
    row = F.concat(F.array(F.col("key").cast("double"), F.col("label").cast("double"), train), F.col("features"))
    rows = checkpoint(features.select("phase", F.col("label").cast("double").alias("label"), row.alias("row")))
    learned = rows.where(F.col("phase") != PHASES[2]).select("phase", "row")
    todo = sorted(open_settings(grid, read_done(spark, path)).collect(), key=lambda r: (r["size"], r["dropout"]))  # a list of parameters
    for setting in todo:
        size, dropout = setting["size"], setting["dropout"]
        got = fit(learned, dims, size, dropout, seed, **how)
        scored = checkpoint(scores(rows, dims, first_layer(size, dims, seed), got.weights))
        out = None
        for phase in PHASES:
            if phase not in setting["phases"]:
                m = binary_metrics(scored.where(F.col("phase") == phase).select("score", "label"), threshold)
                at = (size, dropout, phase, got.best if phase == PHASES[0] else got.epochs, got.train[got.best - 1], got.val[got.best - 1])
                names = ("size", "dropout", "phase", "epochs", "training_loss", "validation_loss")
                line = m.select(*(F.lit(v).alias(n) for v, n in zip(at, names, strict=True)), *METRICS)
                out = line if out is None else out.unionByName(line)
        T.append_log(out.coalesce(1), path)
    return len(todo)
