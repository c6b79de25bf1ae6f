"""Toxicity: weighted lexicon, Aho-Corasick matching, length-normalised score.

Folding (lower case, homoglyphs, digit substitutions inside words, two spaces between
words) is one look-up per code point in the batches. The lexicon is learned from labelled rows: word starts
and whole words whose share in toxic texts is far above that in clean ones. The automaton
takes the longest term at each word, so exception phrases - whole words and word pairs that
contain a term but stand mainly in clean training rows - win over the term and weigh nothing.
A logistic curve over the weight of the hits, in total and per word, gives the score.

The only bound is that on the labelled rows that are learned from; all terms and exceptions
that stand out in them are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import in_training_fold, map_arrow, pieces, table

TRAIN_ROWS = 6_000
LONGEST = 12
#: An exception stands in at least as many clean rows, and its lift is no more than this.
EXCEPTION_ROWS, EXCEPTION_LIFT = 4, 0.5
#: Look-alike characters and what they are read as.
HOMOGLYPHS = ("аеорсухіјѕԁһοαεικνρτυ@$€", "aeopcyxijsdhoaeikvptuase")
#: Digits read as letters when they stand among letters.
DIGITS = ("013457", "oieast")


@cache
def _table() -> np.ndarray:
    """What each code point is read as; 32 for all that are neither letters nor digits."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalnum():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    for a, b in zip(*HOMOGLYPHS, strict=True):
        out[ord(a)] = out[ord(a.upper()) if len(a.upper()) == 1 else ord(a)] = ord(b)
    return out


@cache
def _digits() -> np.ndarray:
    out = np.zeros(128, np.uint32)
    for a, b in zip(*DIGITS, strict=True):
        out[ord(a)] = ord(b)
    return out


def fold_texts(texts: list[str | None]) -> list[str]:
    """Lower case, look-alikes and digit substitutions undone, words parted by two spaces, with one at each end.

    A digit is read as a letter between two letters, or before three letters at the start of a word.
    A null text has no words.
    """
    code = _table()[np.frombuffer((" " + " ".join(t or "" for t in texts) + " ").encode("utf-32-le", "replace"), np.uint32)]
    digit = np.flatnonzero((code >= 48) & (code <= 57))
    digit = digit[_digits()[code[digit]] > 0]
    if len(digit):
        latin = np.r_[(code >= 97) & (code <= 122), [False] * 3]
        start = code[digit - 1] == 32
        yes = latin[digit + 1] & (latin[digit - 1] | (start & latin[digit + 2] & latin[digit + 3]))
        code[digit[yes]] = _digits()[code[digit[yes]]]
    edge = np.cumsum(np.array([1, *(len(t or "") + 1 for t in texts)])) - 1  # the space before each text
    blank = code == 32
    keep = ~blank | np.r_[True, ~blank[:-1]] | np.r_[~blank[1:], True]  # one or two spaces of each run
    keep[edge] = True
    # a single space between words is written twice
    twice = blank & np.r_[False, ~blank[:-1]] & np.r_[~blank[1:], False]
    twice[edge] = False
    times = keep.astype(np.int8) + twice
    place = np.r_[0, np.cumsum(times, dtype=np.int64)]
    text = np.repeat(code, times).tobytes().decode("utf-32-le", "replace")
    out = []
    for a, b in zip(place[edge[:-1]].tolist(), place[edge[1:]].tolist(), strict=True):
        out.append(" " + text[a:b].strip(" ") + " ")
    return out


def _terms(folded: str) -> set[str]:
    """Word starts of 3 to 12 letters and whole words, each after a space."""
    words = set(folded.split())
    out = {f" {w} " for w in words if len(w) > 2}
    for w in words:
        out.update(f" {w[:n]}" for n in range(3, min(len(w), LONGEST) + 1))
    return out


def _phrases(folded: str, kept: set[str]) -> set[tuple[str, str]]:
    """(phrase, its words that hold a kept term): whole words that are no terms themselves, and word pairs."""
    words = folded.split()
    holds = [f" {w} " in kept or any(f" {w[:n]}" in kept for n in range(3, min(len(w), LONGEST) + 1)) for w in words]
    out = {(f" {w} ", w) for w, h in zip(words, holds, strict=True) if h and f" {w} " not in kept}
    for a, b, x, y in zip(words, words[1:], holds, holds[1:], strict=False):
        if x or y:
            out.add((f" {a} {b} ", " ".join(w for w, h in ((a, x), (b, y)) if h)))
    return out


def _counted(rows: DataFrame, terms_of, names: list[str]) -> DataFrame:
    """In how many clean and toxic texts each term stands. ``rows`` is (text, y); a term may be a tuple of ``names``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1 << 20):
                seen: dict = {}
                for t, y in zip(fold_texts(part.column(0).to_pylist()), part.column(1).to_pylist(), strict=True):
                    for term in terms_of(t):
                        seen.setdefault(term, [0, 0])[y] += 1
                keys = [list(seen)] if len(names) == 1 else [[k[i] for k in seen] for i in range(len(names))]
                columns = [pa.array(k, pa.string()) for k in keys] + [pa.array([v[i] for v in seen.values()], pa.int64()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "clean", "toxic"])

    schema = ", ".join(f"{n} string" for n in names) + ", clean long, toxic long"
    return rows.mapInArrow(run, schema).groupBy(*names).agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def learn(rows: DataFrame, max_rows: int = TRAIN_ROWS, exceptions: tuple[str, ...] = ()) -> dict:
    """A model from rows (doc_id, text, toxic).

    Rows with a null text or label are left out; at most about ``max_rows`` rows, chosen by a
    hash of doc_id, are used. Without toxic or without clean rows every score is 0.
    ``exceptions`` are further phrases that weigh nothing.
    """
    rows = rows.where("text is not null and toxic is not null")
    n = rows.count()
    if n > max_rows:
        rows = rows.where(F.pmod(F.xxhash64(F.lit(13), "doc_id"), F.lit(1 << 20)) < int(max_rows / n * (1 << 20)))
    rows = rows.select("text", F.col("toxic").cast("int").alias("y"))
    totals = rows.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("*")).first()
    n_toxic, n_clean = totals[0], totals[1] - totals[0]
    if not n_toxic or not n_clean:
        return {"terms": {}, "curve": [0.0, 0.0, 0.0, 0.0]}
    lift = F.log((F.col("toxic") + 0.2) / (n_toxic + 1)) - F.log((F.col("clean") + 0.2) / (n_clean + 1))
    counted = _counted(rows, _terms, ["term"])
    top = sorted(r["term"] for r in counted.where((F.col("toxic") >= 4) & (lift > 1.0)).select("term").collect())  # terms of the sample
    model = {"terms": dict.fromkeys(top, 1.0), "curve": [0.0, 0.0, 0.0, 0.0]}
    if not top:
        return model
    kept = set(top)
    phrases = _counted(rows, lambda t: _phrases(t, kept), ["term", "holders"])
    mainly_clean = phrases.where((F.col("clean") >= EXCEPTION_ROWS) & (F.col("clean") > F.col("toxic")) & (lift <= EXCEPTION_LIFT))
    learned: dict[str, float] = {}
    # words first: a pair whose terms stand in such words adds nothing
    for r in sorted(mainly_clean.collect(), key=lambda r: (r["term"].count(" "), r["term"])):
        if r["term"].count(" ") == 2 or not all(f" {w} " in learned for w in r["holders"].split()):
            learned[r["term"]] = 0.0
    learned |= {e: 0.0 for e in map(fold_phrase, exceptions) if e.strip()}
    model["terms"] |= learned
    # what each term does as the longest match, in toxic and clean texts of the sample
    per = map_arrow(rows, _hits(model), "y int, words long, terms array<string>").collect()
    seen: dict[str, list[float]] = {t: [0.0, 0.0] for t in model["terms"]}
    words = [1.0, 1.0]
    for r in per:
        words[r["y"]] += r["words"]
        for t in r["terms"]:
            seen[t][r["y"]] += 1
    base = np.log(words[1] / words[0])
    model["terms"] = {t: max(0.0, float(np.log((a[1] + 0.1) / (a[0] + 0.1)) - base)) if sum(a) >= 2 else 0.0 for t, a in seen.items()}
    model["terms"] |= learned
    x = np.array([_features(r["words"], sum(model["terms"][t] for t in r["terms"])) for r in per])
    model["curve"] = _logistic(x, np.array([r["y"] for r in per], float)).tolist()
    return model


def fold_phrase(phrase: str) -> str:
    """A phrase as it is looked for: folded like a text, with one space around each word."""
    return f" {' '.join(fold_texts([phrase])[0].split())} "


def _features(words: float, weight: float) -> list[float]:
    """Weight of the hits in total and per word, both damped, and a constant."""
    return [1.0, np.log1p(weight), np.log1p(100.0 * weight / (words + 10.0)), np.log1p(words) / 10.0]


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 40, ridge: float = 1.0) -> np.ndarray:
    """Newton steps of a ridge logistic regression."""
    w = np.zeros(x.shape[1])
    penalty = np.eye(x.shape[1]) * ridge
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty @ w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, grad)
    return w


def _automaton(terms):
    import ahocorasick

    a = ahocorasick.Automaton()
    for t in terms:
        a.add_word(t, t)
    a.make_automaton()
    return a


def _matches(automaton, folded: str) -> list[str]:
    """Longest term at each word. A match may end with a space, so the text has two between words."""
    return [t for _, t in automaton.iter_long(folded)]


def _spaced(terms) -> dict[str, str]:
    """Terms as they stand in a text with two spaces between words: inner spaces are doubled, outer ones aren't."""
    return {t[0] + t[1:-1].replace(" ", "  ") + t[-1]: t for t in terms}


def _hits(model: dict):
    spaced = _spaced(model["terms"])
    automata: list = []

    def run(batch: pa.RecordBatch) -> dict:
        if not automata:
            automata.append(_automaton(spaced))
        texts = fold_texts(batch.column(0).to_pylist())
        return {"y": batch.column(1), "words": [len(t.split()) for t in texts], "terms": [[spaced[m] for m in _matches(automata[0], t)] for t in texts]}

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score and n_hits of every row.

    Null and empty texts get the score of no hits. Texts of any length are read whole. Equal texts get
    equal scores, so ties stay ties; repeated rows give repeated results; an empty table gives no rows;
    other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # terms of at most TRAIN_ROWS texts
    cache: dict = {}

    def run(batch: pa.RecordBatch) -> dict:
        model = sent.value
        if not cache:
            spaced = _spaced(model["terms"])
            cache["a"] = _automaton(spaced) if spaced else None
            cache["w"] = {s: model["terms"][t] for s, t in spaced.items()}
        texts = fold_texts(batch.column(1).to_pylist())
        weight, hits = np.zeros(len(texts)), np.zeros(len(texts), int)
        if cache["a"] is not None:
            for i, t in enumerate(texts):
                found = [cache["w"][m] for m in _matches(cache["a"], t)]
                weight[i], hits[i] = sum(found), sum(f > 0 for f in found)
        x = np.array([_features(t.count("  ") + 1 if t != "  " else 0, w) for t, w in zip(texts, weight, strict=True)])
        p = 1.0 / (1.0 + np.exp(-(x @ np.array(model["curve"])))) if any(model["curve"]) else np.zeros(len(texts))
        return {"doc_id": batch.column(0), "score": p, "n_hits": hits}

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, score double, n_hits long")


def fit(spark: SparkSession, sf_dir: str) -> dict:
    """The model of the training fold of ``labels``."""
    labels = table(spark, sf_dir, "labels").where(in_training_fold(F.col("doc_id"))).select("doc_id", "toxic")
    return learn(table(spark, sf_dir, "documents").select("doc_id", "text").join(labels, "doc_id"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return score(table(spark, sf_dir, "documents"), fit(spark, sf_dir)).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_hits"
    )
