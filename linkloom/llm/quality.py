"""Quality rules: fixed rules, then gradient-boosted trees over document statistics.

One pass over whole texts counts words, symbols, repeated lines and repeated five-word windows;
shares of these and of kinds of characters are the features. Trees are grown on histograms of a bounded
sample of labelled rows (``labels.quality``) with the logistic loss. Features named in ``FALLING``
may only lower the score: a split whose right side would score higher is not taken, and both
sides keep to the middle of their values from there on. All trees are flattened into arrays of nodes,
which are broadcast and walked for all rows and trees of a batch at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import Words, hash_spans, in_training_fold, map_arrow, mix, ngram_hash, table

#: Bound of the labelled rows that trees are grown on.
TRAIN_ROWS = 20_000
TREES, DEPTH, RATE, BINS = 60, 3, 0.15, 48
#: A leaf holds this much of the loss's second derivative at least.
LEAST_WEIGHT, L2 = 2.0, 1.0
KEEP = 0.5
WINDOW = 5
MIN_WORDS, MAX_REPEAT = 10, 20
FEATURES = (
    "log_words", "mean_word", "longest_word", "symbols_per_word", "dup_lines", "repeat_words", "upper", "digits", "points_per_word",
    "other_ascii", "not_ascii", "distinct_words", "top_word", "words_per_line",
)
#: Features whose growth never raises the score.
FALLING = ("symbols_per_word", "dup_lines", "repeat_words", "top_word")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_U = np.uint64

_KIND = np.full(256, 5, np.uint8)  # of bytes: 0 space, 1 upper, 2 lower, 3 digit, 4 point, 5 other, 6 not ASCII, 7 inside a character
for _k, _codes in enumerate((b" \t\n\x0b\x0c\r", range(0x41, 0x5B), range(0x61, 0x7B), range(0x30, 0x3A), b".,;:!?", (), range(0xC0, 0x100), range(0x80, 0xC0))):
    _KIND[list(_codes)] = _k
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1


def _distinct(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of (owner, hash) and where groups of equals begin in it."""
    key = mix(h ^ mix(owner.astype(_U) + _U(1)))
    order = np.argsort(key, kind="stable")
    key = key[order]
    return order, np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)


def statistics(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The counts ``COUNTS`` of each text, and a matrix of ``FEATURES``; a null text is empty."""
    words = Words(texts)
    raw, off, n = words.raw, words.off, len(texts)
    size = np.diff(words.first)
    owner = np.repeat(np.arange(n), size)

    def per_text(values: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(values)]
        return total[off[1:]] - total[off[:-1]]

    kinds = np.bincount(np.repeat(np.arange(n), np.diff(off)) * 8 + _KIND[raw], minlength=n * 8).reshape(n, 8)
    chars = kinds[:, 1:7].sum(1)

    # lines: from the start of a text or a line break to the next break or the end of the text
    breaks = np.flatnonzero(raw == 10)
    begin = np.unique(np.r_[off[:-1], breaks + 1])
    begin = begin[begin < len(raw)]
    whose = np.searchsorted(off, begin, "right") - 1
    end = np.minimum(np.r_[breaks, len(raw)][np.searchsorted(breaks, begin)], off[whose + 1])
    full = np.r_[0, np.cumsum(_KIND[raw] > 0)]
    worded = full[end] > full[begin]
    begin, end, whose = begin[worded], end[worded], whose[worded]
    lines = np.bincount(whose, minlength=n)
    order, first = _distinct(whose, hash_spans(raw, begin, end))
    dup = lines - np.bincount(whose[order[first]], minlength=n)

    # words inside a window of five that the text holds twice
    grams = ngram_hash(words.hash, WINDOW)
    at = np.flatnonzero(np.arange(len(grams)) + WINDOW <= words.first[owner[: len(grams)] + 1])
    order, first = _distinct(owner[at], grams[at])
    times = np.diff(np.r_[first, len(order)])
    repeated = at[order[np.repeat(times > 1, times)]]
    step = np.zeros(len(owner) + 1, np.int64)
    np.add.at(step, repeated, 1)
    np.add.at(step, repeated + WINDOW, -1)
    repeat = np.bincount(owner[np.cumsum(step)[:-1] > 0], minlength=n)

    order, first = _distinct(owner, words.hash)
    distinct = np.bincount(owner[order[first]], minlength=n)
    top, longest = np.zeros(n, np.int64), np.zeros(n, np.int64)
    np.maximum.at(top, owner[order[first]], np.diff(np.r_[first, len(order)]))
    np.maximum.at(longest, owner, words.end - words.start)
    symbols = per_text(_SYMBOL[raw])

    w, c = np.maximum(size, 1), np.maximum(chars, 1)
    x = np.stack([
        np.log1p(size), chars / w, np.log1p(longest), symbols / w, dup / np.maximum(lines, 1), repeat / w, kinds[:, 1] / c, kinds[:, 3] / c,
        kinds[:, 4] / w, kinds[:, 5] / c, kinds[:, 6] / c, distinct / w, top / w, np.log1p(size / np.maximum(lines, 1)),
    ], axis=1)
    return dict(zip(COUNTS, (size, chars, symbols, dup, repeat), strict=True)), x


@dataclass
class Trees:
    """Trees as arrays of nodes; a leaf is its own child. ``root`` has the first node of each tree."""

    root: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def raw_score(self, x: np.ndarray) -> np.ndarray:
        node = np.tile(self.root, (len(x), 1))
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.base + self.value[node].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw_score(x).clip(-500, 500)))


def _best_split(g: np.ndarray, h: np.ndarray, low: float, high: float, falling: np.ndarray) -> tuple[float, int, int] | None:
    """(gain, feature, last bin on the left) of the best split of a node, from sums per feature and bin."""
    gl, hl = np.cumsum(g, 1)[:, :-1], np.cumsum(h, 1)[:, :-1]
    gr, hr = g.sum(1, keepdims=True) - gl, h.sum(1, keepdims=True) - hl
    vl, vr = (np.clip(-a / (b + L2), low, high) for a, b in ((gl, hl), (gr, hr)))
    whole = np.clip(-g[0].sum() / (h[0].sum() + L2), low, high)

    def gained(v: np.ndarray | float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return -(a * v + (b + L2) * v * v / 2)

    gain = gained(vl, gl, hl) + gained(vr, gr, hr) - gained(whole, g[0].sum(), h[0].sum())
    gain = np.where((hl >= LEAST_WEIGHT) & (hr >= LEAST_WEIGHT) & ~(falling[:, None] & (vr > vl)), gain, -np.inf)
    best = np.unravel_index(np.argmax(gain), gain.shape)
    return (float(gain[best]), int(best[0]), int(best[1])) if gain[best] > 1e-9 else None


def grow(x: np.ndarray, y: np.ndarray, falling: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> Trees:
    """Boosted trees for the probability of ``y`` = 1. ``falling`` tells which columns of ``x`` may only lower it."""
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for column in x.T]
    place = np.stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T, strict=True)])  # features x rows
    share = y.mean().clip(1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    total = np.full(len(y), base)
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        roots.append(len(nodes))
        open_ = [(np.arange(len(y)), -np.inf, np.inf, len(nodes), 0)]
        nodes.append([])
        while open_:
            rows, low, high, me, level = open_.pop()
            sums = [np.stack([np.bincount(place[f, rows], v[rows], bins) for f in range(len(cuts))]) for v in (g, h)]
            split = _best_split(*sums, low, high, falling) if level < depth else None
            if split is None:
                value = float(np.clip(-g[rows].sum() / (h[rows].sum() + L2), low, high)) * rate
                nodes[me] = [0, np.inf, me, me, value]
                total[rows] += value
                continue
            _, f, b = split
            side = place[f, rows] <= b
            limits = [(low, high), (low, high)]
            if falling[f]:
                vl, vr = (np.clip(-g[r].sum() / (h[r].sum() + L2), low, high) for r in (rows[side], rows[~side]))
                middle = (vl + vr) / 2
                limits = [(max(low, middle), high), (low, min(high, middle))]
            nodes[me] = [f, float(cuts[f][b]), len(nodes), len(nodes) + 1, 0.0]
            for r, (lo, hi) in zip((rows[side], rows[~side]), limits, strict=True):
                open_.append((r, lo, hi, len(nodes), level + 1))
                nodes.append([])
    feature, threshold, left, right, value = (np.array(c) for c in zip(*nodes, strict=True))
    return Trees(np.array(roots), feature, threshold, left, right, value, base, depth)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> Trees | None:
    """Trees for ``labels.quality``, from at most about ``max_rows`` labels, chosen by a hash of doc_id, of the training fold.

    Null ids and labels teach nothing; rows of one doc_id and label count once, with the least features. Labels of
    one kind only, or none, give no trees.
    """
    known = labels.where("doc_id is not null and quality is not null").where(in_training_fold(F.col("doc_id")))
    known = known.select("doc_id", (F.col("quality") > 0).cast("int").alias("good")).distinct()
    n = known.count()
    if n > max_rows:
        known = known.where(F.pmod(F.xxhash64(F.lit(19), "doc_id"), F.lit(1 << 20)) < int(max_rows / n * (1 << 20)))

    def features(batch: pa.RecordBatch) -> dict:
        x = statistics(batch.column(2))[1]
        return {"doc_id": batch.column(0), "good": batch.column(1), "x": list(x)}

    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "good", "text")  # max_rows pairs of numbers
    rows = map_arrow(rows, features, "doc_id long, good int, x array<double>").groupBy("doc_id", "good").agg(F.min("x").alias("x"))
    got = rows.orderBy("doc_id", "good").toPandas()
    if got["good"].nunique() < 2:
        return None
    return grow(np.array(got["x"].tolist()), got["good"].to_numpy(float), np.isin(FEATURES, FALLING))


def judge(docs: DataFrame, trees: Trees | None, keep: float = KEEP) -> DataFrame:
    """doc_id, the counts, base_failed, score (of good quality) and kept of every row.

    A null, empty or blank text has no words and fails the fixed rules, as every text of fewer than 10 words does.
    Texts of any length are counted whole, one very long word too. A score equal to the bound is kept; without trees the
    score is 1. Repeated rows give repeated results, an empty table none; other columns are ignored, those named like a result too.
    """
    sent = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batch: pa.RecordBatch) -> dict:
        counts, x = statistics(batch.column(1))
        failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT * counts["n_words"])
        score = sent.value.score(x) if sent.value is not None else np.ones(len(x))
        return {"doc_id": batch.column(0), **counts, "base_failed": failed, "score": score, "kept": ~failed & (score >= keep)}

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, score double, kept boolean"
    return map_arrow(docs.select("doc_id", "text"), run, schema)


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))
