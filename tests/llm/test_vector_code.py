"""Vector codes against whole-number brute force."""

import hashlib
import math
import random

import numpy as np
import pytest

from linkloom.llm import vector_code as V


def brute(rows, parts, entries, rounds, scale=256):
    """{row number: (code, error)} and the digest, all in Python's whole numbers."""
    kept = [(i, v) for i, _, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, len(r[1]), r[1]))
    length = len(kept[0][1])
    q = [[math.floor(x * scale) for x in v] for _, v in kept if len(v) == length]
    d = length // parts
    books = [[v[p * d : p * d + d] for v in q[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            got = {}
            for v in q:
                x = v[p * d : p * d + d]
                got.setdefault(nearest(x, books[p])[1], []).append(x)
            books[p] = [[sum(c) // len(got[j]) for c in zip(*got[j])] if j in got and d else e for j, e in enumerate(books[p])]
    codes = []
    for (i, _), v in zip([r for r in kept if len(r[1]) == length], q):
        best = [nearest(v[p * d : p * d + d], books[p]) for p in range(parts)]
        codes.append((i, "".join(f"{j:02x}" for _, j in best), sum(e for e, _ in best)))
    return codes, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2] or 0))


SCHEMA = "vec_id long, embedding array<double>, label string, code string, error long, q binary, size long"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, None, None, None, None) for i, label, v in rows], SCHEMA)


def make(rng, n, dims, spread):
    centres = [[rng.gauss(0, spread) for _ in range(dims)] for _ in range(9)]
    return [(i, rng.choice("ab"), [c + rng.gauss(0, spread / 5) for c in rng.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize(("n", "dims", "spread", "entries", "rounds"), [(400, 16, 0.2, 16, 3), (150, 8, 3.0, 64, 2), (30, 8, 1e9, 8, 2), (20, 4, 1e35, 5, 2)])
def test_equals_brute_force(spark, n, dims, spread, entries, rounds):
    rows = make(random.Random(n), n, dims, spread)
    out, model = V.encode(table(spark, rows), parts=4, entries=entries, rounds=rounds)
    want, digest = brute(rows, 4, entries, rounds)
    got = [(r["vec_id"], r["code"], r["error"]) for r in out.collect()]
    assert by_id(got) == by_id([(i, c, min(e, V.MAX_LONG)) for i, c, e in want])
    assert model.digest() == digest


def test_odd_rows(spark):
    """Nulls, odd numbers, other lengths, ties, repeats, clashing columns."""
    rng = random.Random(3)
    nan, inf = float("nan"), float("inf")
    tied = [(i, None, [float(rng.randrange(2)) for _ in range(8)]) for i in range(40)]
    rows = [
        *tied, (40, "a", None), (41, "a", [0.0] * 7 + [nan]), (42, "a", [inf] * 8), (43, "b", [None] + [0.0] * 7), (44, "b", [1.0] * 4), (45, "b", []),
        (46, "c", [-0.001] * 8), (46, "c", [-0.001] * 8), (None, "c", [0.5] * 8), (47, None, [5e-324] * 8), (-1, "a", [-0.0] * 8),
    ]
    out, model = V.encode(table(spark, rows), parts=4, entries=16)
    got = out.collect()
    assert {r["vec_id"] for r in got if r["code"] is None} == {44, 45}
    coded = [(r["vec_id"], r["code"], r["error"]) for r in got if r["code"] is not None]
    want, digest = brute([r for r in rows if r[0] not in (44, 45)], 4, 16, 2)
    assert by_id(coded) == by_id(want) and model.digest() == digest


def test_no_codes(spark):
    assert V.encode(table(spark, []), parts=4) [0].count() == 0
    out, model = V.encode(table(spark, [(1, "a", [1.0] * 6)]), parts=4)
    assert model is None and out.collect()[0]["code"] is None
    out, _ = V.encode(table(spark, [(1, "a", []), (2, "a", [])]), parts=4)
    assert {(r["code"], r["error"]) for r in out.collect()} == {("00000000", 0)}
    with pytest.raises(ValueError, match="256"):
        V.encode(table(spark, []), entries=300)


def test_bounds_spare_comparisons():
    """After moves of the entries, kept bounds give the same codes as whole comparisons, and most rows need few of them."""
    rng = np.random.default_rng(4)
    q = np.floor(rng.normal(0, 60, (3000, 4)))
    book = V.Codebook([[int(v) for v in r] for r in q[:64]])
    near, low, outer = V.assign(q, book, 16)
    size = np.full(len(q), 16)
    for step in (2, 5, 1, 30):
        new = V.Codebook([[v + int(rng.integers(-step, step + 1)) for v in r] for r in book.rows])
        size, near, low, outer, used = V.reassign(q, new, new.moved(book), size, near, low, outer, 8, 16)
        want = V.assign(q, new, 16)[0][:, 0]
        assert (near[:, 0] == want).all()
        exact = np.sqrt(((q[:, None] - new.x[None]) ** 2).sum(2))
        inside = np.arange(near.shape[1]) < size[:, None]
        assert (low[inside] <= np.take_along_axis(exact, near, 1)[inside]).all()
        others = exact.copy()
        np.put_along_axis(others, np.where(inside, near, near[:, :1]), np.inf, 1)
        assert (outer <= others.min(1)).all()
        if step < 6:
            assert (used == 0).mean() < 0.2 and (used == 1).mean() > 0.2
        book = new
    assert size.min() >= 8 and size.max() <= 16


def test_any_partitioning(spark, parts):
    rows = make(random.Random(8), 300, 16, 0.3)
    df = table(spark, rows)
    got = parts(lambda: sorted(map(tuple, V.encode(df.repartition(7), entries=16)[0].drop("label").collect())))
    assert got[0] == got[1] == got[2]
