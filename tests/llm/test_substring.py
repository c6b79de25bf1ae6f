import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from linkloom.llm import substring
from linkloom.llm.common import Words
from linkloom.llm.fm_index import FMIndex
from tests.llm.util import empty, odd_docs, text


def brute(rows, width):
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (doc, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((doc, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def shared_passages(n=60, seed=1):
    rng = random.Random(seed)
    passages = [text(rng, k) for k in (34, 35, 36, 60, 120)]
    rows = []
    for i in range(n):
        body = [text(rng, rng.randrange(0, 60))]
        for p in rng.sample(passages, rng.randrange(0, 4)):
            w = p.split()
            if rng.random() < 0.4:
                w[rng.randrange(len(w))] = "CHANGED"
            body += [" ".join(w), text(rng, rng.randrange(0, 30))]
        rows.append((i, rng.choice((" ", "\n", "\t")).join(body)))
    rows += [(n, rows[3][1]), (n + 1, rows[3][1]), (n + 2, "la " * 200), (n + 3, "la di " * 60)]
    return rows


@pytest.mark.parametrize("hot", [1000, 3])
def test_matches_brute_force(spark, hot):
    rows = shared_passages()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, substring.remove_repeats(df, hot=hot, shard_words=2000).collect()), key=str)
    assert got == brute(rows, substring.WIDTH)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, substring.remove_repeats(docs).collect()), key=str) == brute(rows, substring.WIDTH)
    assert substring.remove_repeats(empty(docs)).count() == 0


def test_index_counts():
    rng = np.random.default_rng(0)
    t = rng.integers(1, 5, 400)
    t[::41] = 0
    index = FMIndex(t)
    for size in (1, 2, 4):
        for i in range(0, 380, 7):
            p = t[i : i + size]
            if (p == 0).any():
                continue
            lo, hi = np.array([0]), np.array([index.size])
            for c in p[::-1]:
                lo, hi = index.extend(np.array([c]), lo, hi)
            assert hi[0] - lo[0] == sum((t[j : j + size] == p).all() for j in range(len(t) - size + 1))


def test_words_are_those_of_bytes_split():
    texts = ["a  bc\u00e9\u00a0d\x0b e", "", None, " x ", "tail", "\u2028z y"]
    w = Words(pa.array(texts))
    got = [bytes(w.raw[a:b]) for a, b in zip(w.start, w.end)]
    assert got == [x for t in texts for x in (t or "").encode().split()]
    assert np.diff(w.first).tolist() == [len((t or "").encode().split()) for t in texts]
    long = ["a" * 5000 + "b", "a" * 5000 + "c", "abcdefgh", "abcdefghi", "abcdefgh\x00"]
    assert len(set(Words(pa.array(long)).hash.tolist())) == 5
