"""Vectors of any width: matrix products per Arrow batch, and mergeable sums per key.

A column of array<double> is one matrix per batch, so a layer is one matrix product whatever its
width, and the plan has one node where literal weights would have thousands of expressions. Weights are
broadcast; they are a model's parameters and don't grow with the data.

Sums and softmax states are *merged*: every task first combines what it has of a key, in bounded memory, then
each key's partial states meet in one place. A key that a third of all rows share sends one
state per task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Numbers of a matrix in a task, about (32 MB).
HELD = 1 << 22
VECTOR, NUMBER = T.ArrayType(T.DoubleType()), T.DoubleType()


def to_matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows x dims, whether a row is a vector of that length without nulls); other rows are zeros."""
    n = len(column)
    size = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    ok = size == dims
    out = np.zeros((n, dims))
    if ok.any() and dims:
        values = (column if ok.all() else column.filter(pa.array(ok))).flatten()
        flat = values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
        out[ok] = flat
        if values.null_count:
            whole = values.is_valid().to_numpy(zero_copy_only=False).reshape(-1, dims).all(1)
            bad = np.flatnonzero(ok)[~whole]
            ok[bad], out[bad] = False, 0.0
    return out, ok


def from_matrix(x: np.ndarray, ok: np.ndarray | None = None) -> pa.Array:
    """A column of vectors; null where not ``ok``."""
    n, dims = x.shape
    ok = np.ones(n, bool) if ok is None else ok
    offsets = np.r_[0, np.cumsum(np.where(ok, dims, 0))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(x[ok], np.float64).ravel()), mask=None if ok.all() else pa.array(~ok))


def spread(df: DataFrame, rows: int) -> DataFrame:
    """The rows dealt out to tasks of about ``rows`` each: a file of few bytes is one task, whatever is to be done for each of its rows."""
    return df.repartition(max(1, -(-df.count() // rows)))


def map_vectors(
    df: DataFrame, keep: Sequence[str], inputs: Mapping[str, int], outputs: Mapping[str, T.DataType], fn: Callable[..., Mapping[str, np.ndarray]], params: object = None
) -> DataFrame:
    """Columns ``keep`` and new ones: ``fn(params, {input: matrix})`` gives a matrix per vector and an array per number.

    ``inputs`` tells the length of each vector column. A row with a null vector, a null element or a vector of
    another length has null outputs. ``params`` are broadcast.
    """
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(name, kind) for name, kind in outputs.items()])
    arrow = to_arrow_schema(schema)
    sent = df.sparkSession.sparkContext.broadcast(params)
    step = max(1, HELD // max(1, *inputs.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                got = {c: to_matrix(part[c], d) for c, d in inputs.items()}
                ok = np.logical_and.reduce([k for _, k in got.values()])
                out = fn(sent.value, {c: x for c, (x, _) in got.items()})
                made = [from_matrix(out[c], ok) if kind == VECTOR else pa.array(out[c], pa.float64(), mask=~ok) for c, kind in outputs.items()]
                yield pa.RecordBatch.from_arrays([part[c].cast(arrow.field(c).type) for c in keep] + made, names=schema.names)

    return df.select(*keep, *(c for c in inputs if c not in keep)).mapInArrow(run, schema)


def weights(w: Sequence[Sequence[float]] | np.ndarray) -> np.ndarray:
    return np.asarray(w, np.float64)


def affine(df: DataFrame, keep: Sequence[str], terms: Mapping[str, Sequence[Sequence[float]]], name: str = "h", bias: Sequence[float] | None = None, relu: bool = False) -> DataFrame:
    """``keep`` and the vector ``name``: the sum over ``terms`` of weight times column, plus ``bias``, cut at 0 with ``relu``."""
    ws = {c: weights(w) for c, w in terms.items()}

    def fn(params: tuple, x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        ws, bias = params
        out = sum(x[c] @ w.T for c, w in ws.items()) + (0.0 if bias is None else bias)
        return {name: np.maximum(out, 0.0) if relu else out}

    return map_vectors(df, keep, {c: w.shape[1] for c, w in ws.items()}, {name: VECTOR}, fn, (ws, None if bias is None else weights(bias)))


def dense_stack(df: DataFrame, keep: Sequence[str], vector: str, layers: Sequence[tuple], name: str = "h") -> DataFrame:
    """``keep`` and the vector after some layers (weight, bias or None, whether ReLU follows), all in one pass."""
    stack = [(weights(w), None if b is None else weights(b), relu) for w, b, relu in layers]

    def fn(stack: list[tuple], x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        h = x[vector]
        for w, b, relu in stack:
            h = h @ w.T + (0.0 if b is None else b)
            h = np.maximum(h, 0.0) if relu else h
        return {name: h}

    return map_vectors(df, keep, {vector: stack[0][0].shape[1]}, {name: VECTOR}, fn, stack)


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    return order, np.flatnonzero(np.r_[True, k[1:] != k[:-1]])


def merge_sums(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row per key: the sum of its rows."""
    order, cut = _groups(keys)
    return keys[order][cut], np.add.reduceat(x[order], cut, axis=0)


def merge_softmax(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row per key of states (greatest logit, sum of weights, weighted sum): weights are relative to the greatest logit."""
    order, cut = _groups(keys)
    x = x[order]
    top = np.maximum.reduceat(x[:, 0], cut)
    scale = np.exp(x[:, 0] - np.repeat(top, np.diff(np.r_[cut, len(x)])))
    return keys[order][cut], np.c_[top, np.add.reduceat(x[:, 1:] * scale[:, None], cut, axis=0)]


def merged(df: DataFrame, key: str, vector: str, dims: int, merge: Callable = merge_sums, name: str = "v", held: int = HELD, partitions: int | None = None) -> DataFrame:
    """(key, name): the states ``vector`` of each key merged into one. Rows with a null key or vector are left out.

    Tasks merge before and after the shuffle by key; afterwards keys come sorted, so only one open
    key is held. ``key`` is a number or text. ``partitions`` is for few keys.
    """
    schema = T.StructType([df.schema[key], T.StructField(name, VECTOR)])
    arrow = to_arrow_schema(schema)

    def batch_of(keys: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        step = max(1, HELD // max(dims, 1) // 4)
        for at in range(0, len(keys), step):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + step], arrow.field(0).type), from_matrix(x[at : at + step])], schema=arrow)

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x, ok = to_matrix(batch.column(1), dims)
        return batch.column(0).to_numpy(zero_copy_only=False)[ok], x[ok]

    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        for batch in batches:
            kept.append(read(batch))
            rows += len(kept[-1][0])
            if rows * dims > held:
                kept = [merge(*(np.concatenate(c) for c in zip(*kept, strict=True)))]
                rows = len(kept[0][0])
                if rows * dims > held // 2:
                    yield from batch_of(*kept[0])
                    kept, rows = [], 0
        if rows:
            yield from batch_of(*merge(*(np.concatenate(c) for c in zip(*kept, strict=True))))

    def after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: tuple[np.ndarray, np.ndarray] | None = None
        for batch in batches:
            keys, x = read(batch)
            if not len(keys):
                continue
            if open_ is not None:
                keys, x = np.r_[open_[0], keys], np.r_[open_[1], x]
            keys, x = merge(keys, x)
            yield from batch_of(keys[:-1], x[:-1])
            open_ = keys[-1:], x[-1:]
        if open_ is not None:
            yield from batch_of(*open_)

    rows = df.where(F.col(key).isNotNull()).select(key, F.col(vector).alias(name))
    dealt = rows.mapInArrow(before, schema)
    dealt = dealt.repartition(key) if partitions is None else dealt.repartition(partitions, key)
    return dealt.sortWithinPartitions(key).mapInArrow(after, schema)


def vector_sums(df: DataFrame, key: str, vector: str, dims: int, name: str = "v") -> DataFrame:
    """(key, name): element-wise sums of the vectors of each key."""
    return merged(df, key, vector, dims, merge_sums, name)


def vector_means(df: DataFrame, key: str, vector: str, dims: int, name: str = "v") -> DataFrame:
    """(key, name): element-wise means of the vectors of each key."""
    counted = df.select(key, F.concat(F.array(F.lit(1.0)), vector).alias("__s"))
    out = merged(counted, key, "__s", dims + 1, merge_sums, "__s")
    return out.select(key, F.transform(F.slice("__s", 2, dims), lambda v: v / F.col("__s")[0]).alias(name))


def softmax_means(df: DataFrame, key: str, logit: str, vector: str, dims: int, name: str = "v") -> DataFrame:
    """(key, name): means of the vectors of each key, weighted by the softmax of their logits, in one shuffle."""
    state = df.select(key, F.concat(F.array(F.col(logit).cast("double"), F.lit(1.0)), vector).alias("__s"))
    out = merged(state, key, "__s", dims + 2, merge_softmax, "__s")
    return out.select(key, F.transform(F.slice("__s", 3, dims), lambda v: v / F.col("__s")[1]).alias(name))
