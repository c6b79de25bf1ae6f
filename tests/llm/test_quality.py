"""Counts against plain Python, trees against a plain walk, monotone features, held-out accuracy."""

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linkloom.llm import quality as Q
from tests.llm.util import empty, odd_docs

WORD = r"[^\x20\x09-\x0D]+"


def plain(text):
    text = text or ""
    words = re.findall(WORD, text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    where = {}
    for i in range(len(words) - 4):
        where.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + j for at in where.values() if len(at) > 1 for i in at for j in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def check(texts):
    got, x = Q.statistics(pa.array(texts, pa.string()))
    assert list(zip(*(got[c].tolist() for c in Q.COUNTS))) == [plain(t) for t in texts]
    assert x.shape == (len(texts), len(Q.FEATURES)) and np.isfinite(x).all()


@given(st.lists(st.one_of(st.none(), st.text("ab# \n\té\x85|", max_size=60)), max_size=6))
@settings(max_examples=300, deadline=None)
def test_counts(texts):
    check(texts)


def test_counts_of_tables(tiny):
    check(pd.read_parquet(f"{tiny}/documents.parquet")["text"].tolist())
    check(["", "\n", "a\n", "a\na", "a\n\na\n a", "x" * 9000 + " " + "x" * 9000, None, "a b c d e f a b c d e", "a a a a a a"])


def walk(t, x):
    total = t.base
    for at in t.root.tolist():
        while t.left[at] != at:
            at = int(t.left[at] if x[t.feature[at]] <= t.threshold[at] else t.right[at])
        total += t.value[at]
    return total


def made(n=3000, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.random((n, 4)).round(2)
    # rises and falls with column 0, with noise; column 1 counts at both ends
    y = (np.sin(9 * x[:, 0]) - 2 * (np.abs(x[:, 1] - 0.5) < 0.2) + rng.normal(0, 0.3, n) > -0.3).astype(float)
    return x, y


def test_flat_walk_equals_plain_walk():
    x, y = made()
    t = Q.grow(x, y, np.zeros(4, bool))
    assert np.allclose(t.raw_score(x[:200]), [walk(t, r) for r in x[:200]], atol=1e-12)
    assert ((t.score(x) > 0.5) == (y > 0.5)).mean() > 0.9


@pytest.mark.parametrize("falling", [[True, False, False, False], [True, True, True, True]])
def test_falling_features(falling):
    x, y = made()
    t = Q.grow(x, y, np.array(falling))
    grid = np.linspace(-0.1, 1.1, 200)
    for row in x[:40]:
        for f in np.flatnonzero(falling):
            many = np.tile(row, (len(grid), 1))
            many[:, f] = grid
            assert (np.diff(t.raw_score(many)) <= 1e-9).all()
    free = Q.grow(x, y, np.zeros(4, bool))
    many = np.tile(x[0], (200, 1))
    many[:, 0] = grid
    assert (np.diff(free.raw_score(many)) > 1e-9).any()  # the data alone would rise


def test_held_out(spark):
    folder = "/root/testdata/sf0.01"
    got = Q.op11_quality_rules(spark, folder).toPandas().set_index("doc_id")
    docs = pd.read_parquet(f"{folder}/documents.parquet").set_index("doc_id")
    labels = pd.read_parquet(f"{folder}/labels.parquet").set_index("doc_id")["quality"]
    assert len(got) == len(docs)
    base = pd.DataFrame([plain(t) for t in docs["text"]], docs.index, Q.COUNTS)
    assert (got.loc[docs.index, list(Q.COUNTS)] == base).all().all()
    failed = (base["n_words"] < 10) | (100 * base["n_repeat_words"] > 20 * base["n_words"])
    assert (got["base_failed"].loc[docs.index] == failed).all()
    assert not (got["kept"] & got["base_failed"]).any()
    held = [i for i in labels.index if zlib.crc32(str(i).encode()) % 3 == 1]
    right = (got.loc[held, "score"] >= Q.KEEP) == (labels[held] == 1)
    assert right.mean() > 0.97


def test_odd_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(1, 1, "q"), (1, 1, "q"), (2, 0, "q"), (None, 1, "q"), (4, None, "q"), (9, 0, "q")], "doc_id long, quality int, text string")
    rows = Q.judge(docs, Q.fit(docs, labels)).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert [by[9][c] for c in Q.COUNTS] == list(plain(next(r["text"] for r in docs.collect() if r["doc_id"] == 9)))
    assert by[8]["n_repeat_words"] == 3000 and by[8]["base_failed"] and not by[8]["kept"]
    assert by[3]["n_words"] == 0 and by[3]["base_failed"]
    assert Q.fit(docs, empty(labels)) is None and Q.fit(empty(docs), labels) is None
    assert all(r["kept"] == (not r["base_failed"]) and r["score"] == 1.0 for r in Q.judge(docs, None).collect())
    assert Q.judge(empty(docs), None).count() == 0
