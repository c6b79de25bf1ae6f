import re

import pytest
from pyspark.sql import functions as F

from linkloom.llm import mixing
from tests.llm.util import empty, odd_docs


def water_fill(size, weight, epochs=3.0):
    """Rounds of resharing: clamp, hand the rest out by weight, repeat."""
    total = sum(size)
    target, free = [0.0] * len(size), set(range(len(size)))
    left = float(total)
    while free:
        w = sum(weight[i] for i in free)
        over = {i for i in free if left * weight[i] / w > epochs * size[i]}
        if not over:
            for i in free:
                target[i] = left * weight[i] / w
            break
        for i in over:
            target[i] = epochs * size[i]
            left -= target[i]
        free -= over
    return target


@pytest.mark.parametrize("size", [[100, 100, 100], [1, 100, 1000], [5, 5, 5, 5000], [0, 10, 20, 7, 300, 2], [50], [1, 1, 10_000, 1, 2]])
def test_targets_match_resharing(spark, size):
    names = [chr(97 + i) for i in range(len(size))]
    weight = [mixing.WEIGHTS[i % 3] for i in range(len(size))]
    df = spark.createDataFrame([(n, s) for n, s in zip(names, size)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert [got[n] for n in names] == pytest.approx(water_fill(size, weight))


def test_mix_of_a_skewed_table(spark, parts):
    rows = [(i, "w " * (1 + i * 7 % 40), "hot" if i % 3 else f"s{i % 11}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")

    def run():
        return sorted(map(tuple, mixing.mix(docs).collect()))

    got = parts(run)
    assert got[0] == got[1] == got[2] and len(got[0]) == 1500
    per = {}
    for _, source, size, source_size, target, _, taken, _ in got[0]:
        assert taken <= 3 * size and taken % max(size, 1) == 0
        t = per.setdefault(source, [0, target, source_size, 0])
        t[0] += taken
        t[3] = max(t[3], size)
    for taken, target, _, largest in per.values():
        assert abs(taken - target) <= largest
    assert sum(t[1] for t in per.values()) == pytest.approx(sum(t[2] for t in per.values()))


def test_odd_rows(spark):
    docs = odd_docs(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    want = sorted(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in docs.collect())
    assert sorted(r["size"] for r in got) == want
    assert all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert mixing.mix(empty(docs)).count() == 0
    blank = mixing.mix(docs.withColumn("text", F.lit(None).cast("string"))).collect()
    assert all(r["target"] == 0 and r["taken"] == 0 for r in blank)


def test_many_sources_are_joined_by_bucket(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (i % 9), f"s{i % 30}" if i % 4 else None) for i in range(400)], "doc_id long, text string, source string")
    small = sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    monkeypatch.setattr(mixing, "MAX_SOURCES_SENT", 3)
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=str) == small


def test_empty_documents_are_not_copied_once_more(spark):
    rows = [(i, "a", "" if i % 3 else "word " * (i + 1)) for i in range(60)] + [(100 + i, "b", "word " * 40) for i in range(60)]
    got = mixing.mix(spark.createDataFrame([*rows, *[(None, "b", f"null id {i}") for i in range(9)]], "doc_id long, source string, text string")).collect()
    assert all(r["copies"] == int(r["epochs"]) for r in got if not r["size"])
    assert all(r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in got)
