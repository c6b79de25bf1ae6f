"""Helpers shared by the training-data operators.

A *word* is a maximal run of characters other than space and U+0009..U+000D, which is
what ``bytes.split()`` yields for UTF-8. Words are compared by a 64-bit hash; two
different words share one with probability 2**-64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 1 << 20
BATCH_ROWS = 1024
_U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_id(text: Column) -> Column:
    """16-byte digest of a text; a null counts as empty.

    Never null, so that joins add no filter and one shuffle by it can serve several.
    """
    return F.coalesce(F.unhex(F.md5(F.coalesce(text, F.lit("")))), F.lit(b""))


def in_training_fold(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 3 is not 1; a null id is never trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 != 1, F.lit(False))


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` where ``fn`` turns one record batch into a dict of columns (or None).

    As rows may hold long texts, the session's Arrow batches have at most ``BATCH_ROWS`` rows from then on.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    from pyspark.sql.types import StructType, _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    parsed = _parse_datatype_string(schema)
    assert isinstance(parsed, StructType)
    arrow = to_arrow_schema(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                if (out := fn(part)) is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``limit`` bytes; one long row stays whole."""
    n = batch.num_rows
    step = max(1, int(n * limit / max(batch.nbytes, 1)))
    for at in range(0, n, step):
        yield batch.slice(at, step)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column and the offsets of each; null is empty."""
    big = column.cast(pa.large_string() if pa.types.is_string(column.type) else column.type)
    big = big.fill_null("") if big.null_count else big
    _, off, data = big.buffers()
    off = np.frombuffer(off, np.int64)[big.offset : big.offset + len(big) + 1] if len(big) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.full(256, 0x20, np.uint8)
for _c in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _FOLD[_c] = _c
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


class Words:
    """Words of a column of texts: byte spans, 64-bit hashes, and the first word of each text."""

    def __init__(self, column: pa.Array, fold: bool = False):
        """``fold``: ASCII letters in lower case, other ASCII but digits as spaces."""
        self.raw, self.off = utf8(column)
        if fold:
            self.raw = _FOLD[self.raw]
        word = ~_SPACE[self.raw]
        edge = np.zeros(len(self.raw) + 1, bool)
        edge[self.off] = True
        before, after = np.r_[False, word[:-1]], np.r_[word[1:], False]
        self.start = np.flatnonzero(word & (~before | edge[:-1]))
        self.end = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, self.off)
        self._hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = hash_spans(self.raw, self.start, self.end)
        return self._hash


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (two xor-shift multiply rounds)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def hash_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, eight bytes of all spans at a time."""
    size = end - start
    out = mix(size.astype(_U))
    padded = np.r_[raw, np.zeros(8, np.uint8)]
    eight = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))
    left = np.flatnonzero((size > 0) & (size <= 4096))
    at = 0
    while len(left):
        n = np.minimum(size[left] - at, 8).astype(_U)
        got = eight[start[left] + at] & (~_U(0) >> (_U(64) - n * _U(8)))
        out[left] = mix(out[left] ^ got * _U(0x9E3779B97F4A7C15))
        at += 8
        left = left[size[left] > at]
    for i in np.flatnonzero(size > 4096):
        out[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


_BASE = _U(0x9E3779B97F4A7C15)


def ngram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words that start at each position, across text borders too."""
    if len(h) < k:
        return np.zeros(0, _U)
    out = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        out = out * _BASE + h[i : len(h) - k + 1 + i]
    return mix(out)


def run_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows of one key after the other, for batches that come sorted by ``key``."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(key))
        keys = col.to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        for a, b in zip(cut, np.r_[cut[1:], batch.num_rows], strict=True):
            now = keys[a]
            if kept and now != last:
                yield pa.Table.from_batches(kept)
                kept = []
            last = now
            kept.append(batch.slice(a, b - a))
    if kept:
        yield pa.Table.from_batches(kept)
