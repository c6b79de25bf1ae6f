"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words are counted over all documents; words weigh by idf.
2. The TF-IDF rows of the benchmark passages get a randomised SVD, as joins and sums of
   (passage, word, weight) entries: only matrices of rank x rank reach the driver.
3. Windows of every document are projected to the latent space. Cosines are taken with the
   full length of the window, so words outside the benchmark's vocabulary count against it,
   and a window with too little weight inside the vocabulary needs no projection. A passage of
   more than two windows is searched for by overlapping parts of that length, as a window is a
   small share of a long passage.
4. Candidates above the cosine bound are checked by the longest common subsequence of words
   around the windows and by the words of the answer, the end of the passage, on whole passages.
   Windows of one passage whose surroundings overlap are compared together.

The benchmark is a stated query set. It is dealt in blocks of at most ``RANK`` passages or parts,
so that the latent space of a block holds all of its rows and the cosines are exact. As many
blocks as fit in ``MODEL_BYTES`` (one at least) are broadcast and run against all documents together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import Words, map_arrow, mix, ngram_hash, pieces, table
from linkloom.operators import ids as I
from linkloom.operators.components import checkpoint

WINDOW, STRIDE = 32, 16
PART = 2 * WINDOW  # parts begin every WINDOW words: each stretch of a window lies in one
DF_BITS = 16
SHORT = 5  # passages of fewer words are searched for as they stand
RANK = 256
COSINE = 0.25
LCS_SURE, LCS_WITH_ANSWER = 0.75, 0.5
ANSWER_SHARE, ANSWER_FOUND = 0.2, 0.6
LEAKS = "doc_id long, item_id long, cosine double, lcs double, answer double"
MODEL_BYTES = 48 << 20
_U = np.uint64


def document_frequency(docs: DataFrame, bits: int = DF_BITS) -> tuple[np.ndarray, int]:
    """(documents per word bucket, documents), over all rows; at most 2**bits sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for part in pieces(batch):
                words = Words(part.column(0), fold=True)
                owner = np.repeat(np.arange(part.num_rows), np.diff(words.first)).astype(np.int64)
                pair = np.unique(owner << bits | (words.hash >> _U(64 - bits)).astype(np.int64))
                total += np.bincount(pair & ((1 << bits) - 1), minlength=1 << bits)
                n += part.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[n, total[at]])], names=["bucket", "df"])

    rows = docs.select("text").mapInArrow(run, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(1 << bits)
    known = rows["bucket"] >= 0
    df[rows["bucket"][known]] = rows["df"][known]
    return df, int(rows["df"][~known].sum())


def idf(df: np.ndarray, n: int) -> np.ndarray:
    return np.log((n + 1.0) / (df + 0.5)).clip(0.05)


def _vectors(words: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Seeded random signs per word."""
    return (mix(words[:, None].view(_U) ^ mix(np.arange(1, width + 1, dtype=_U) * _U(seed * 2 + 1))) >> _U(63)).astype(float) * 2 - 1


def _summed(rows: DataFrame, by: str) -> DataFrame:
    """Sums of the vectors of each key, times their weight ``w``: in every task first, then by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                v = np.frombuffer(v) * w
                sums[k] = sums[k] + v if k in sums else v
        columns = [pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary()), pa.array(np.ones(len(sums)))]
        yield pa.RecordBatch.from_arrays(columns, names=[by, "v", "w"])

    schema = f"{by} long, v binary, w double"
    return rows.select(by, "v", "w").mapInArrow(run, schema).repartition(by).mapInArrow(run, schema).select(by, "v")


def _times(entries: DataFrame, vectors: DataFrame, on: str, by: str) -> DataFrame:
    """Product of the sparse matrix ``entries`` (item, word, w), or its transpose, with rows of vectors."""
    return _summed(entries.join(vectors, on), by)


def _gram(rows: DataFrame, width: int) -> np.ndarray:
    """Sum of outer products of the vectors: width x width numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                x = np.stack([np.frombuffer(v) for v in batch.column(0).to_pylist()])
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(width)), pa.array([r.tobytes() for r in total], pa.binary())], names=["i", "v"])

    out = np.zeros((width, width))
    for r in _summed(rows.select("v").mapInArrow(run, "i long, v binary").withColumn("w", F.lit(1.0)), "i").collect():
        out[r["i"]] = np.frombuffer(r["v"])
    return out


def _apply(rows: DataFrame, key: str, matrix: np.ndarray) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict:
        return {key: batch.column(0), "v": [(np.frombuffer(v) @ matrix).tobytes() for v in batch.column(1).to_pylist()]}

    return map_arrow(rows.select(key, "v"), run, f"{key} long, v binary")


def randomized_svd(entries: DataFrame, rank: int = RANK, power: int = 1, seed: int = 3) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Right vectors (word, v), projected rows (item, v) and singular values of (item, word, w).

    Randomised range finding with ``power`` power steps (Halko et al., 2011).
    """
    n = entries.select("item").distinct().count()
    width = min(n, rank) + 16  # more than the rows, so that none of a full space is lost

    def start(batch: pa.RecordBatch) -> dict:
        words = batch.column(0).to_numpy()
        return {"word": words, "v": [r.tobytes() for r in _vectors(words, width, seed)]}

    q = map_arrow(entries.select("word").distinct(), start, "word long, v binary")
    for _ in range(power + 1):
        z = checkpoint(_times(entries, _times(entries, q, "word", "item"), "item", "word"))
        value, vector = np.linalg.eigh(_gram(z, width))
        good = value > max(value.max(initial=0) * 1e-10, 1e-12)
        basis = np.where(good, 1 / np.sqrt(np.where(good, value, 1)), 0) * vector
        q = checkpoint(_apply(z, "word", basis))
    y = checkpoint(_times(entries, q, "word", "item"))
    value, vector = np.linalg.eigh(_gram(y, width))
    top = np.argsort(-value)[: max(1, min(rank, n))]
    turn = vector[:, top]
    return _apply(q, "word", turn), _apply(y, "item", turn), np.sqrt(value[top].clip(0))


def _lcs(pattern: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    full = (1 << size) - 1
    row = full
    for w in words:
        if m := pattern.get(w):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return size - row.bit_count()


def _pattern(words: list[int]) -> dict[int, int]:
    """Bit mask of the places of each word."""
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


class _Passage:
    """A benchmark passage and its answer, ready for comparison."""

    def __init__(self, words: np.ndarray):
        self.size = len(words)
        self.words, self.count = np.unique(words, return_counts=True)
        self.pattern = _pattern(words.tolist())
        tail = words[-max(1, round(self.size * ANSWER_SHARE)) :].tolist()
        self.tail, self.tail_size = _pattern(tail), len(tail)

    def found(self, region: np.ndarray) -> tuple[float, float] | None:
        """Best (share of the passage, share of its answer) that a stretch of the region, half as long
        again as the passage, holds in order; None if it is too little."""
        place = np.searchsorted(self.words, region).clip(max=len(self.words) - 1)
        at = np.flatnonzero(self.words[place] == region)  # other words change no subsequence
        least = LCS_WITH_ANSWER * self.size
        if np.minimum(np.bincount(place[at], minlength=len(self.words)), self.count).sum() < least:
            return None
        span, step = self.size + max(4, self.size // 2), max(2, self.size // 4)
        begin = np.arange(0, max(1, len(region) - span + step), step)
        lo, hi = np.searchsorted(at, begin), np.searchsorted(at, begin + span)
        words = region[at].tolist()
        best, seen = None, (0, 0)
        for i in np.flatnonzero(hi - lo >= least):
            if (a := int(lo[i]), b := int(hi[i])) == seen:
                continue
            seen, part = (a, b), words[a:b]
            share = _lcs(self.pattern, self.size, part) / self.size
            if share < LCS_WITH_ANSWER:
                continue
            answer = _lcs(self.tail, self.tail_size, part) / self.tail_size
            if share >= LCS_SURE or answer >= ANSWER_FOUND:
                best = max(best or (0.0, 0.0), (share, answer))
                if share == 1.0:
                    break
        return best


def _regions(start: np.ndarray, cosine: np.ndarray, size: int) -> list[list]:
    """[start, end, cosine] around the windows found, a passage's length to each side; those that overlap are one."""
    out: list[list] = []
    for at, c in zip(start.tolist(), cosine.tolist(), strict=True):
        begin, stop = at - size, at + WINDOW + size
        if out and begin <= out[-1][1]:
            out[-1][1:] = stop, max(out[-1][2], c)
        else:
            out.append([begin, stop, c])
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, rank: int = RANK) -> DataFrame:
    """One row per leaked pair: doc_id, item_id, cosine, lcs, answer (the best of its windows).

    Null and empty texts on either side leak nothing. A passage of fewer than 5 words is found where all
    its words stand side by side. Passages and texts may be of any length: long passages are searched for
    by parts and compared whole. Repeated rows give one pair. Ids may repeat or be null; pairs are
    by id, and of the windows of a pair the greatest values count, so ties change nothing. Empty tables give no
    rows; other columns are ignored.
    """
    df, n_docs = document_frequency(docs)
    weight = idf(df, n_docs)

    def entries(batch: pa.RecordBatch) -> dict:
        words = Words(batch.column(2), fold=True)
        size = np.diff(words.first)
        owner = np.repeat(np.arange(batch.num_rows), size)
        return {
            "item": batch.column(0).take(pa.array(owner)), "item_id": batch.column(1).take(pa.array(owner)),
            "at": np.arange(len(owner)) - np.repeat(words.first[:-1], size), "word": words.hash.view(np.int64),
            "w": weight[(words.hash >> _U(64 - DF_BITS)).astype(np.int64)],
        }

    items = benchmark.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text").where("text is not null").dropDuplicates()
    rows = checkpoint(map_arrow(items, entries, "item long, item_id long, at long, word long, w double"))
    sized = checkpoint(rows.join(rows.groupBy("item").agg(F.count("*").alias("size")), "item"))
    rows = sized.where(F.col("size") >= SHORT)
    last = F.greatest(F.lit(0), F.ceil((F.col("size") - PART) / WINDOW))
    first = F.greatest(F.lit(0), F.ceil((F.col("at") - PART + 1) / WINDOW))
    parts = rows.withColumn("k", F.explode(F.sequence(first, F.least(F.floor(F.col("at") / WINDOW), last))))
    numbers = I.dense_id(parts.select("item", "k").distinct(), ["item", "k"], "part")
    parts = checkpoint(parts.join(numbers, ["item", "k"]).select("part", "item", "word", "w", F.floor(F.col("part") / rank).alias("block")))
    out = _find_short(docs, sized.where(F.col("size") < SHORT))
    models: list[tuple] = []
    size = 0
    for b in range(numbers.count() and parts.agg(F.max("block")).first()[0] + 1):
        model = _model(rows, parts.where(F.col("block") == b), weight, rank)
        if models and size + model[1].nbytes > MODEL_BYTES:
            out, models, size = out.unionByName(_search(docs, models, weight, cosine)), [], 0
        models.append(model)
        size += model[1].nbytes
    if models:
        out = out.unionByName(_search(docs, models, weight, cosine))
    return out.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("lcs").alias("lcs"), F.max("answer").alias("answer"))


def _find_short(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs of documents and short passages, whose words must stand side by side."""
    texts: dict[tuple[int, int | None], list[int]] = {}
    for r in rows.orderBy("item", "at").collect():  # passages of the query set, of fewer than SHORT words each
        texts.setdefault((r["item"], r["item_id"]), []).append(r["word"])
    by_size: dict[int, tuple[np.ndarray, list]] = {}
    for n in sorted({len(t) for t in texts.values()}):
        found = sorted((int(ngram_hash(np.array(t, np.int64).view(_U), n)[0]), i) for (_, i), t in texts.items() if len(t) == n)
        by_size[n] = np.array([g for g, _ in found], _U), [i for _, i in found]
    if not by_size:
        return docs.sparkSession.createDataFrame([], LEAKS)

    def run(batch: pa.RecordBatch) -> dict | None:
        words = Words(batch.column(1), fold=True)
        pairs = set()
        for n, (known, ids) in by_size.items():
            grams = ngram_hash(words.hash, n)
            lo, hi = np.searchsorted(known, grams, "left"), np.searchsorted(known, grams, "right")
            for at in np.flatnonzero(hi > lo):
                doc = int(np.searchsorted(words.first, at, "right")) - 1
                if at + n <= words.first[doc + 1]:
                    pairs.update((doc, ids[k]) for k in range(lo[at], hi[at]))
        if not pairs:
            return None
        ones = np.ones(len(pairs))
        return {"doc_id": [batch.column(0)[d].as_py() for d, _ in pairs], "item_id": [i for _, i in pairs], "cosine": ones, "lcs": ones, "answer": ones}

    return map_arrow(docs.select("doc_id", "text"), run, LEAKS)


def _model(rows: DataFrame, parts: DataFrame, weight: np.ndarray, rank: int) -> tuple:
    """One block of at most ``rank`` parts: its words, what each adds to the latent cosine of each part (a last row
    of zeros stands for other words), the parts' passages, and the passages' ids and words."""
    entries = checkpoint(parts.groupBy(F.col("part").alias("item"), "word").agg(F.sum("w").alias("w")))
    right, projected, _ = randomized_svd(entries, rank)
    words = right.toPandas()
    latent = {r["item"]: np.frombuffer(r["v"]) for r in projected.collect()}
    texts: dict[int, list] = {}
    for r in rows.join(parts.select("item").distinct(), "item", "left_semi").orderBy("item", "at").collect():
        texts.setdefault(r["item"], [r["item_id"]]).append(r["word"])
    order = np.argsort(words["word"].to_numpy())
    number = {k: i for i, k in enumerate(texts)}
    owner = [(r["part"], number[r["item"]]) for r in parts.select("part", "item").distinct().orderBy("part").collect()]
    x = np.stack([latent[k] for k, _ in owner])
    x /= np.linalg.norm(x, axis=1, keepdims=True).clip(1e-12)
    vocabulary = words["word"].to_numpy()[order]
    right = np.stack([np.frombuffer(v) for v in words["v"]])[order] * weight[(vocabulary.view(_U) >> _U(64 - DF_BITS)).astype(np.int64)][:, None]
    score = np.vstack([right @ x.T, np.zeros((1, len(x)))]).astype(np.float32)
    return vocabulary, score, np.array([i for _, i in owner]), [t[0] for t in texts.values()], [np.array(t[1:], np.int64) for t in texts.values()]


def _search(docs: DataFrame, models: list[tuple], weight: np.ndarray, cosine: float) -> DataFrame:
    """Leaks of the passages of some blocks, in one pass over the documents."""
    sent = docs.sparkSession.sparkContext.broadcast((models, weight))  # MODEL_BYTES, or one block
    passages: dict[tuple[int, int], _Passage] = {}  # those that this task has met

    def run(batch: pa.RecordBatch) -> dict | None:
        models, weight = sent.value
        return search_batch(batch.column(0), Words(batch.column(1), fold=True), models, weight, cosine, passages)

    return map_arrow(docs.select("doc_id", "text"), run, LEAKS)


def _halves(score: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray, rows: int = 1024) -> np.ndarray:
    """Sums of the rows of ``score`` at ``place``, per stretch [first, last) of words."""
    out = np.zeros((len(first), score.shape[1]), np.float32)
    buffer = np.empty((rows, score.shape[1]), np.float32)
    reach = np.arange(STRIDE)
    for at in range(0, len(first), rows):
        total = out[at : at + rows]
        words = first[at : at + rows, None] + reach
        inside = words < last[at : at + rows, None]
        words = np.where(inside, place[np.minimum(words, len(place) - 1)], len(score) - 1)
        for i in np.flatnonzero(inside.any(0)):
            total += np.take(score, words[:, i], axis=0, out=buffer[: len(total)], mode="clip")
    return out


def search_batch(doc_id: pa.Array, words: Words, models: list[tuple], weight: np.ndarray, cosine: float, passages: dict) -> dict | None:
    """Leaks in some texts. Windows are pairs of halves of ``STRIDE`` words, so each word is projected once."""
    size, h = np.diff(words.first), words.hash.view(np.int64)
    if not len(h):
        return None
    # halves of each text, the last one maybe shorter; window k of a text is its halves k and k + 1
    n = -(-size // STRIDE)
    text = np.repeat(np.arange(len(n)), n)
    begin = words.first[text] + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    end = np.minimum(begin + STRIDE, words.first[text + 1])
    single = np.r_[True, text[1:] != text[:-1]] & np.r_[text[1:] != text[:-1], True]
    window = np.flatnonzero(np.r_[text[1:] == text[:-1], False] | single)
    second = np.where(single[window], window, window + 1)
    start, stop = begin[window], end[second]
    w = weight[(words.hash >> _U(64 - DF_BITS)).astype(np.int64)]
    mass = np.r_[0.0, np.cumsum(w * w)]
    length = np.sqrt(mass[stop] - mass[start])
    out: dict[str, list] = {"doc_id": [], "item_id": [], "cosine": [], "lcs": [], "answer": []}
    for block, (vocabulary, score, whole, ids, items) in enumerate(models):
        place = np.searchsorted(vocabulary, h).clip(max=len(vocabulary) - 1)
        place = np.where(vocabulary[place] == h, place, len(vocabulary))  # the last row is zero
        # no part gets more from a word than the word's greatest cell
        most = np.r_[0.0, np.cumsum(score.max(1)[place], dtype=np.float64)]
        hopeful = np.flatnonzero(most[stop] - most[start] >= cosine * length * (1 - 1e-6))
        row, column, cos = [], [], []
        for part in np.array_split(hopeful, len(hopeful) // 8000 + 1):
            halves = np.unique(np.r_[window[part], second[part]])
            got = _halves(score, place, begin[halves], end[halves])
            a, b = np.searchsorted(halves, window[part]), np.searchsorted(halves, second[part])
            value = (got[a] + np.where((a == b)[:, None], 0, got[b])) / length[part][:, None]
            i, j = np.nonzero(value >= cosine)
            row.append(part[i])
            column.append(whole[j])
            cos.append(value[i, j])
        row, column, cos = np.concatenate(row), np.concatenate(column), np.concatenate(cos)
        if not len(row):
            continue
        order = np.lexsort((row, column, text[window[row]]))
        row, column, cos = row[order], column[order], cos[order]
        owner = text[window[row]]
        cut = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (column[1:] != column[:-1])])
        for a, b in zip(cut, np.r_[cut[1:], len(row)], strict=True):
            doc, j = int(owner[a]), int(column[a])
            item = passages[block, j] = passages.get((block, j)) or _Passage(items[j])
            best, lo, hi = None, words.first[doc], words.first[doc + 1]
            for left, right, c in _regions(start[row[a:b]], cos[a:b], item.size):
                if got := item.found(h[max(lo, left) : min(hi, right)]):
                    best = max(best or (0.0, 0.0, 0.0), (*got, c))
            if best:
                out["doc_id"].append(doc_id[doc].as_py())
                for name, value in zip(("item_id", "lcs", "answer", "cosine"), (ids[j], *best), strict=True):
                    out[name].append(value)
    return out if out["doc_id"] else None


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
