import random

import pytest

from linkloom.llm import jaccard
from tests.llm.util import empty, odd_docs, text


def brute(rows, k=5, threshold=0.8):
    def shingles(t):
        w = (t or "").split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= threshold * len(a | b):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = find(i)
            least[r] = min(least.get(r, d), d)
    return sorted(((d, least.get(find(i), d), links[i]) for i, (d, _) in enumerate(rows)), key=str)


def edited(rng, t, n):
    w = t.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = "EDIT" + str(rng.random())
    return " ".join(w)


def rows_with_groups(seed=1, group=60):
    rng = random.Random(seed)
    base, other = text(rng, 150), text(rng, 80)
    rows = [(i, edited(rng, base, rng.randrange(0, 5))) for i in range(group)]
    rows += [(1000 + i, edited(rng, other, rng.randrange(0, 3))) for i in range(20)]
    rows += [(2000 + i, text(rng, 60)) for i in range(40)] + [(3000 + i, base) for i in range(5)]
    # the same start cut at many lengths: one chain of candidates, few links
    rows += [(4000 + i, " ".join(base.split()[: 20 + 3 * i])) for i in range(40)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [256, 7])
def test_matches_brute_force(spark, block):
    rows = rows_with_groups()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.near_duplicates(df, block=block).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got), key=str) == brute(rows)
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = jaccard.near_duplicates(docs).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got), key=str) == brute(rows)
    assert jaccard.near_duplicates(empty(docs)).count() == 0


def test_bands_reach_the_recall():
    for threshold in (0.6, 0.8, 0.95):
        bands, rows = jaccard.choose_bands(threshold, 0.999)
        assert bands * rows <= 256 and 1 - (1 - threshold**rows) ** bands >= 0.999
