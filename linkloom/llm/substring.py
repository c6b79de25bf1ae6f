"""Substring dedup: words of windows that repeat, found with an FM-index per shard.

Equal windows of 35 words share their minimizer, the least hash among their 8-word
grams. So:

1. every distinct text is cut into runs of windows with one minimizer; counts per
   minimizer (combined before the shuffle) leave the runs whose minimizer repeats;
2. the text of those runs, each distinct piece once with its number of places, goes to
   the shard of its minimizer. Runs of a minimizer with more than ``HOT`` places are
   cut to single windows and go by the hash of the window, so no key gathers many pieces;
3. each shard builds an FM-index of its pieces and streams them against it; a window
   found twice, or in a piece of two places, is repeated;
4. the marks return to the texts, and covered words are left out.

Texts are handled once per distinct text (a copy makes every window repeated) and joined
back to the rows at the end, so groups of exact copies weigh nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import Words, map_arrow, mix, ngram_hash, table, text_id
from linkloom.llm.fm_index import FMIndex, repeated_windows

WIDTH = 35
GRAM = 8
HOT = 1000
SHARD_WORDS = 400_000
_U = np.uint64


def minimizer_runs(words: Words, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, first window, number of windows, minimizer, twice) of runs of up to width-gram+1 windows.

    Windows are counted from the text's first word. ``twice`` marks a run that holds its
    minimizer's gram more than once: two of its own windows may be equal.
    """
    span = width - gram + 1
    g = ngram_hash(words.hash, gram)
    none = np.zeros(0, np.int64)
    if len(g) < span:
        return none, none, none, none.astype(_U), none.astype(bool)
    low, reach = g, 1
    while reach * 2 <= span:
        low = np.minimum(low[: len(low) - reach], low[reach:])
        reach *= 2
    low = np.minimum(low[: len(g) - span + 1], low[span - reach : span - reach + len(g) - span + 1])
    count = np.diff(words.first) - width + 1  # windows per text
    has = np.flatnonzero(count > 0)
    if not len(has):
        return none, none, none, none.astype(_U), none.astype(bool)
    owner = np.repeat(has, count[has])
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(count[has]) - count[has], count[has])
    value = low[words.first[owner] + inside]
    new = np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])]
    at = np.flatnonzero(new)
    size = np.diff(np.r_[at, len(value)])
    if (size > span).any():  # text that repeats itself: cut long runs
        parts = -(-size // span)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        full = np.repeat(size, parts) - nth * span
        at = np.repeat(at, parts) + nth * span
        size = np.minimum(full, span)
    owner, inside, value = owner[at], inside[at], value[at]
    reach = np.arange(2 * span - 1)
    grams = (words.first[owner] + inside)[:, None] + reach
    same = (g[np.minimum(grams, len(g) - 1)] == value[:, None]) & (reach < (size + span - 1)[:, None])
    return owner, inside, size, value, same.sum(1) > 1


_B1, _B2 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)


class _Prefix:
    """128-bit hashes of word spans from prefix sums."""

    def __init__(self, h: np.ndarray):
        self.sums = []
        for base, x in ((_B1, h), (_B2, mix(h + _U(1)))):
            power = np.cumprod(np.r_[_U(1), np.full(len(h), base)])
            inverse = _U(pow(int(base), -1, 1 << 64))
            back = np.cumprod(np.r_[_U(1), np.full(len(h), inverse)])
            self.sums.append((np.r_[_U(0), np.cumsum(x * power[:-1])], back))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = (b - a).astype(_U)
        out = [mix((s[b] - s[a]) * back[a] + n) for s, back in self.sums]
        return np.stack(out, axis=1)


def _runs(texts: DataFrame, width: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict:
        text, at, n, value, twice = minimizer_runs(Words(batch.column(1)), width)
        return {
            "tid": batch.column(0).take(pa.array(text)), "at": at.astype(np.int32), "n": n.astype(np.int32),
            "value": value.view(np.int64), "places": 1 + twice,
        }

    return map_arrow(texts.select("tid", "text", "copies"), run, "tid binary, at int, n int, value long, places int")


def _cut(texts: DataFrame, width: int, with_text: bool) -> DataFrame:
    """Pieces of the runs: their text (once per batch), or where they stand."""

    def run(batch: pa.RecordBatch) -> dict | None:
        words = Words(batch.column(1))
        runs = batch.column(2)
        per = runs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = runs.flatten()
        if not len(flat):
            return None
        owner = np.repeat(np.arange(batch.num_rows), per)
        at, n = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        value, hot = flat.field(2).to_numpy(zero_copy_only=False), flat.field(3).to_numpy(zero_copy_only=False).astype(bool)
        # single windows of hot runs
        split = np.where(hot, n, 1)
        nth = np.arange(split.sum()) - np.repeat(np.cumsum(split) - split, split)
        owner, value, hot = (np.repeat(x, split) for x in (owner, value, hot))
        at, n = np.repeat(at, split) + nth, np.where(hot, 1, np.repeat(n, split))
        a = words.first[owner] + at
        b = a + n + width - 1
        key = _Prefix(words.hash).of(a, b)
        raw = np.ascontiguousarray(key).view("S16").ravel()
        if not with_text:
            return {"tid": batch.column(0).take(pa.array(owner)), "at": at.astype(np.int32), "piece": _binary(key)}
        copies = batch.column(3).to_numpy(zero_copy_only=False)[owner]
        _, first, which = np.unique(raw, return_index=True, return_inverse=True)
        places = np.bincount(which, copies).astype(np.int64)
        a, b = a[first], b[first]
        data = words.raw.tobytes()
        body = [data[i:j] for i, j in zip(words.start[a], words.end[b - 1], strict=True)]
        shard = np.where(hot, key[:, 0].view(np.int64), value)[first]
        return {"piece": _binary(key[first]), "shard": shard, "body": body, "places": places}

    schema = "piece binary, shard long, body binary, places long" if with_text else "tid binary, at int, piece binary"
    return map_arrow(texts.select("tid", "text", "runs", "copies"), run, schema)


def _binary(key: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(key).tobytes()
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(key), [None, pa.py_buffer(data)]).cast(pa.binary())


def match_shard(body: list[bytes], places: np.ndarray, width: int) -> np.ndarray:
    """Bit mask per piece of its windows that repeat, within the pieces of one shard."""
    words = Words(pa.array(body, pa.large_binary()).cast(pa.large_string()))
    size = np.diff(words.first)
    _, number = np.unique(words.hash, return_inverse=True)
    end = np.cumsum(size + 1) - 1
    text = np.zeros(int((size + 1).sum()), np.int64)
    inside = np.ones(len(text), bool)
    inside[end] = False
    text[inside] = number + 1
    begin = end - size
    alone = places == 1
    found = repeated_windows(FMIndex(text), text, begin[alone], end[alone], width)
    windows = size - width + 1
    mask = np.where(alone, 0, (1 << windows) - 1)
    at = np.flatnonzero(found)
    piece = np.searchsorted(begin, at, "right") - 1
    np.bitwise_or.at(mask, piece, 1 << (at - begin[piece]))
    return mask


def _match(pieces: DataFrame, width: int, shard_words: int) -> DataFrame:
    """(piece, mask): shards are whole keys that lie together, up to ``shard_words`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["piece", "mask"]

        def flush(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(rows)
            mask = match_shard(t.column("body").to_pylist(), t.column("places").to_numpy(), width)
            keep = np.flatnonzero(mask)
            return pa.RecordBatch.from_arrays([t.column("piece").combine_chunks().take(pa.array(keep)), pa.array(mask[keep])], names=names)

        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column(1).to_numpy(zero_copy_only=False)
            length = pa.compute.binary_length(batch.column(2)).to_numpy(zero_copy_only=False) // 6 + 1
            total = np.cumsum(length)
            cut = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])  # a shard may be ended at these rows
            a = 0
            for i in cut:
                spent = size + (total[i - 1] if i else 0) - (total[a - 1] if a else 0)
                if (i or shard[0] != last) and spent >= shard_words:
                    rows = [*held, batch.slice(a, i - a)] if i > a else held
                    yield flush(rows)
                    held, size, a = [], 0, int(i)
            held.append(batch.slice(a))
            size += int(total[-1] - (total[a - 1] if a else 0))
            last = shard[-1]
        if held:
            yield flush(held)

    parted = pieces.repartition("shard").sortWithinPartitions("shard")
    return parted.mapInArrow(run, "piece binary, mask long")


def _keep(texts: DataFrame, width: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict:
        n_words, n_removed, digest = [], [], []
        for text, copies, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            words = text.encode().split()
            n = len(words)
            gone = np.zeros(n + 1, np.int64)
            if copies > 1 and n >= width:
                gone[0], gone[n] = 1, -1
            elif marks:
                for m in marks:
                    at, mask = m["at"], m["mask"]
                    bits = np.array([i for i in range(mask.bit_length()) if mask >> i & 1]) + at
                    np.add.at(gone, bits, 1)
                    np.add.at(gone, bits + width, -1)
            gone = np.cumsum(gone[:n]) > 0
            kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words
            n_words.append(n)
            n_removed.append(n - len(kept))
            digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return {"tid": batch.column(0), "n_words": n_words, "n_removed": n_removed, "kept_sha256": digest}

    return map_arrow(texts, run, "tid binary, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, width: int = WIDTH, hot: int = HOT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row.

    A null text has no words; texts shorter than the window lose nothing. Repeated rows and
    copies count as other places, so all their windows go, and no place of a repeated window is spared, the first included.
    Texts and words of any length are read whole. An empty table gives no rows; other columns are ignored. ``width`` is 8 to 60.
    """
    rows = docs.select("doc_id", text_id(F.col("text")).alias("tid"), F.coalesce("text", F.lit("")).alias("text"))
    # every use keeps all three columns, so that the one shuffle of texts serves them all
    texts = rows.groupBy("tid").agg(F.max("text").alias("text"), F.count("*").alias("copies"))
    runs = _runs(rows.withColumn("copies", F.lit(1).cast("long")), width)  # copies count here as well, combined before the shuffle
    often = runs.groupBy("value").agg(F.sum("places").alias("c")).where("c > 1")
    chosen = (
        _runs(texts, width).join(often, "value")
        .groupBy("tid").agg(F.collect_list(F.struct("at", "n", "value", (F.col("c") > hot).alias("hot"))).alias("runs"))
    )
    chosen = texts.join(chosen, "tid")
    pieces = _cut(chosen, width, with_text=True).groupBy("piece").agg(
        F.first("shard").alias("shard"), F.first("body").alias("body"), F.sum("places").alias("places")
    )
    marks = _cut(chosen, width, with_text=False).join(_match(pieces.select("piece", "shard", "body", "places"), width, shard_words), "piece")
    marks = marks.groupBy("tid").agg(F.collect_list(F.struct("at", "mask")).alias("marks"))
    done = _keep(texts.join(marks, "tid", "left").select("tid", "text", "copies", "marks"), width)
    return rows.select("doc_id", "tid").join(done, "tid").select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
