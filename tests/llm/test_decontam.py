import random

import numpy as np
import pytest

from linkloom.llm import decontam
from tests.llm.util import empty, odd_docs, text


def passages(n=30):
    rng = random.Random(7)
    return [(i, text(rng, rng.randrange(12, 60))) for i in range(n)]


def test_plants_are_found_and_clean_texts_left(spark):
    rng = random.Random(8)
    items = passages()
    rows, want = [], set()
    for i in range(120):
        words = text(rng, rng.randrange(30, 300)).split()
        if i % 4 == 0:
            item, leak = items[i // 4 % len(items)]
            leak = leak.split()
            if i % 8 == 0:  # a paraphrase: some words replaced, the answer kept
                for k in range(0, int(len(leak) * 0.75), 4):
                    leak[k] = "other"
            at = rng.randrange(len(words))
            words[at:at] = [w.upper() + "," for w in leak] if i % 12 == 0 else leak
            want.add((i, item))
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontam.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want


def test_blocks_of_the_benchmark_agree(spark, monkeypatch):
    items = passages()
    rows = [(i, text(random.Random(1000 + i), 40) + " " + items[i][1]) for i in range(30)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, bench).collect()}
    monkeypatch.setattr(decontam, "MODEL_BYTES", 400_000)
    assert {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, bench).collect()} == whole == {(i, i) for i in range(30)}


def test_odd_rows(spark):
    items = passages(5)
    docs = odd_docs(spark, [(30, "so " + items[2][1], "en", "a"), (30, "so " + items[2][1], "en", "a"), (None, items[3][1], "en", "a")])
    bench = spark.createDataFrame([*items, (9, None), (None, ""), (10, "two words"), (11, "one TWO"), (12, "two one"), items[2], (None, items[3][1])], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, bench).collect()}
    assert got == {(30, 2), (None, 3), (None, None), (6, 11)}
    assert decontam.find_leaks(empty(docs), bench).count() == 0
    assert decontam.find_leaks(docs, bench.limit(0)).count() == 0


def test_svd_matches_numpy(spark):
    rng = np.random.default_rng(1)
    a = np.where(rng.random((12, 40)) < 0.3, rng.random((12, 40)), 0)
    rows = [(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))]
    right, y, s = decontam.randomized_svd(spark.createDataFrame(rows, "item long, word long, w double"), rank=12)
    assert s == pytest.approx(np.linalg.svd(a, compute_uv=False), rel=1e-6, abs=1e-6)
    v = {r["word"]: np.frombuffer(r["v"]) for r in right.collect()}
    for r in y.collect():
        assert sum(a[r["item"], w] * x for w, x in v.items()) == pytest.approx(np.frombuffer(r["v"]), abs=1e-6)


def test_subsequence_length():
    rng = random.Random(3)
    for _ in range(100):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 15))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        pattern = {}
        for i, x in enumerate(a):
            pattern[x] = pattern.get(x, 0) | 1 << i
        assert decontam._lcs(pattern, len(a), b) == table[-1][-1]


def test_recall_of_the_search_against_brute_force(spark, tiny):
    """Every pair that shares 60 % of a passage's 4-grams is found."""
    folder = tiny.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("text is not null")
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    import re

    def grams(t):
        w = re.findall(r"[a-z0-9\x80-\uffff]+", t.lower())
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)}

    items = {r["item_id"]: grams(r["text"]) for r in bench.collect()}
    want = {(r["doc_id"], i) for r in docs.collect() for g in [grams(r["text"])] for i, s in items.items() if s and len(s & g) >= 0.6 * len(s)}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, bench).collect()}
    assert want and len(want & got) >= 0.9 * len(want)


def test_large_benchmark_misses_no_leak(spark):
    """Over 1,000 passages, against a comparison of all pairs."""
    rng = random.Random(11)
    items = [(i, text(rng, rng.randrange(15, 60))) for i in range(1100)]
    rows = [(i, " ".join((text(rng, rng.randrange(30, 90)), items[i * 3][1], text(rng, 30)))) for i in range(360)]
    want = {(d, i) for d, t in rows for i, p in items if f" {p} " in f" {t} "}
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, bench).collect()}
    assert len(want) >= 360 and want == got


def test_long_passages(spark):
    """Verbatim and with every second word before the answer replaced."""
    rng = random.Random(12)
    items = [(i, text(rng, n)) for i, n in enumerate((40, 64, 65, 96, 97, 130, 300, 600, 1000, 1000, 1500, 3000, 20_000))]
    rows = []
    for i, p in items:
        words = p.split()
        for k in range(0, int(len(words) * 0.75), 2):
            words[k] = f"other{k}"
        rows += [(2 * i, " ".join((text(rng, 50), p, text(rng, 70)))), (2 * i + 1, " ".join((text(rng, 50), *words, text(rng, 70))))]
    rows.append((99, text(rng, 3000)))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["lcs"] for r in decontam.find_leaks(docs, bench).collect()}
    assert set(got) == {(2 * i + k, i) for i, _ in items for k in (0, 1)}
    assert all(got[2 * i, i] == 1 for i, _ in items)


def test_short_passages_must_stand_side_by_side(spark):
    items = [(1, "alpha"), (2, "alpha beta"), (3, "alpha beta gamma delta"), (4, "alpha beta gamma delta eps")]
    texts = [(1, "x alpha"), (2, "x beta alpha"), (3, "Alpha, beta; gamma delta"), (4, "delta"), (5, "beta"), (6, "alpha"), (7, "alpha beta gamma delta x eps")]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, bench).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (3, 2), (3, 3), (6, 1), (7, 1), (7, 2), (7, 3), (7, 4), (3, 4)}
