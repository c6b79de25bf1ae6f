import numpy as np
import pytest

from linkloom.llm import vectors


def brute(rows, cosine):
    usable = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and label is not None for _, v, label in rows]
    links, comp = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if usable[i] and usable[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], np.float64), np.array(rows[j][1], np.float64)
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    comp[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((r[0], links[i], least[find(i)], least[find(i)] == r[0]) for i, r in enumerate(rows))


def clustered(seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for c in range(6):
        centre = rng.normal(size=16)
        for _ in range(40 if c == 0 else 8):
            out.append((centre + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.35, 0.5])).astype(np.float32).tolist())
    out += rng.normal(size=(60, 16)).astype(np.float32).tolist()
    rows = [(i * 3 % 997, v, i % 2) for i, v in enumerate(out)]
    rows += [(2000 + i, out[0], 0) for i in range(4)] + [(2010, (np.array(out[0]) * 2).tolist(), 0)]
    return rows


ODD = [
    (3000, None, 1), (3001, [], 1), (3002, [0.0] * 16, 1), (3003, [None] + [1.0] * 15, 1), (3004, [float("nan")] + [1.0] * 15, 1),
    (3005, [float("inf")] + [1.0] * 15, 1), (3006, [1.0] * 16, None), (3007, [1.0] * 16, 1), (3008, [1.0] * 4, 1), (3009, [2.0] * 16, 1), (3010, [1e30] * 16, 1),
]


@pytest.mark.parametrize("width", [512, 5])
def test_matches_brute_force(spark, width):
    rows = clustered() + ODD
    df = spark.createDataFrame([(i, v, k, None, None) for i, v, k in rows], "vec_id long, embedding array<float>, label int, cls string, copies string")
    got = sorted(map(tuple, vectors.near_vectors(df, width=width).collect()))
    assert got == brute(rows, vectors.COSINE)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_rotation_keeps_lengths():
    q = vectors.rotation(16)
    assert np.allclose(q @ q.T, np.eye(16))


def test_labels_of_any_type(spark):
    """Texts and fractions are labels as they are: only equal ones are compared."""
    for kind, labels in (("string", ["a", "a", "b", None]), ("double", [1.2, 1.2, 1.7, None])):
        rows = [(i, label, [1.0, 2.0, -0.0]) for i, label in enumerate(labels)] + [(9, labels[0], [1.0, 2.0, 1e-9])]
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(spark.createDataFrame(rows, f"vec_id long, label {kind}, embedding array<double>")).collect()}
        assert got == {0: (2, 0, True), 1: (2, 0, False), 2: (0, 2, True), 3: (0, 3, True), 9: (2, 0, False)}
