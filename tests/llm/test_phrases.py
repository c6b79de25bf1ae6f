"""Phrase mining against plain counts, with proposals that miss and bit tables that are too small."""

import collections
import random
import re

import pyarrow as pa
import pytest

from linkloom.llm import phrases as P
from tests.llm.util import EXTRA, empty, odd_docs


def plain_counts(docs, longest=4):
    out = collections.Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            out[lang, ()] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    out[lang, tuple(w[i : i + k])] += 1
    return out


def plain(docs, least, top=2000):
    f = plain_counts(docs)
    found = {x: a for x, a in f.items() if len(x[1]) >= 2 and a >= least}
    rows = collections.defaultdict(list)
    for (lang, w), a in found.items():
        longer = [n for (g, v), n in found.items() if g == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if any(100 * n >= 80 * a for n in longer):
            continue
        score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        rows[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted(
        (lang, i, p.decode(), -a, l, r, f[lang, ()], -s) for lang, found in rows.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)
    )


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, None, *[None] * 12) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA)


def made(seed=1, n=300):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["É", "Ab", "aB", "x\u0085y", "it's"]
    stock = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(2, 7))) for _ in range(25)]
    out = []
    for _ in range(n):
        parts = [rng.choice(stock) if rng.random() < 0.5 else rng.choice(vocab) for _ in range(rng.randrange(1, 30))]
        out.append((rng.choice((" ", "  ", " \t", ", ", ".\n", " ")).join(parts), rng.choice(("en", "de", None))))
    return out


def as_rows(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize("how", [{}, {"sample": 0.02}, {"sample": 0.0}, {"sample": 1.0, "lowered": 1.0}, {"most_bits": 1 << 6}])
def test_equals_plain_counts(spark, how):
    rows = made()
    assert as_rows(P.collocations(docs_of(spark, rows), least=5, **how)) == plain(rows, 5)


def test_failures_bring_passes(spark):
    docs = docs_of(spark, made(4))
    want = {(k, n) for k, n in collections.Counter((len(w), n) for (_, w), n in plain_counts(made(4)).items() if w and n >= 5).items()}
    for sample, least_passes in ((1.0, 1), (0.0, 3)):
        found, passes = P.frequent_hashes(docs, 5, 4, sample=sample)
        assert passes >= least_passes and (sample < 1 or passes == 1)
        assert set(collections.Counter((r["k"], r["n"]) for r in found.where("k > 0").collect()).items()) == want
        assert found.select("k", "h").distinct().count() == found.count()


def test_top_and_ties(spark):
    rows = [(" , ".join(["b a"] * 6 + ["a b"] * 6 + ["é a"] * 6 + ["z z z z z z z z z z z"]), "en")] * 2
    assert as_rows(P.collocations(docs_of(spark, rows), least=5, top=2)) == plain(rows, 5, 2)


def test_small_buffers(spark, monkeypatch):
    p = P.Phrases(pa.array(["a b c a b", None, "", "a"]), pa.array(["x", None, "x", "y"]))
    counter = P._Counter(3)
    for k in (1, 1, 2):
        counter.add(p.hashes(k))
        counter.full()
    got = [(h, n) for hs, ns in counter.rows() for h, n in zip(hs.tolist(), ns.tolist())]
    assert sum(n for _, n in got) == 17 and len({h for h, _ in got}) == len(got)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = [(r["text"], r["lang"]) for r in docs.select("text", "lang").collect()]
    got = as_rows(P.collocations(docs, least=30))
    assert got == plain(rows, 30) and got
    assert P.collocations(empty(docs)).count() == 0
    assert P.collocations(docs_of(spark, [(None, None), ("", "en"), ("a", "en")])).count() == 0


def test_any_partitioning(spark, parts):
    rows = made(7, 120)
    got = parts(lambda: as_rows(P.collocations(docs_of(spark, rows).repartition(5), least=5)))
    assert got[0] == got[1] == got[2] == plain(rows, 5)
