import hashlib

import pytest
from pyspark.sql import functions as F

from linkloom.functions import geometry as G
from linkloom.sources import files as B
from linkloom.sources import tables as T


def test_log_with_repeated_headers(spark, tmp_path):
    head = ",".join(T.LOG_COLUMNS)
    (tmp_path / "a.csv").write_text(f"{head}\n32,0.2,Testing,13,,0.3,0.92,0.8,0.8,0.8,0.8,0.7\n{head}\n64,0,Testing,10,,0.2,0.94,0.8,0.8,0.8,0.8,0.7\n")
    log = T.read_log(spark, str(tmp_path / "a.csv"))
    assert sorted((r["size"], r["auc"]) for r in log.collect()) == [(32, 0.92), (64, 0.94)]
    T.append_log(log, str(tmp_path / "out"))
    T.append_log(log, str(tmp_path / "out"))
    assert T.read_log(spark, str(tmp_path / "out")).count() == 4


def test_layer_from_text(spark, tmp_path):
    (tmp_path / "l.csv").write_text('id,geom\n1,"LINESTRING (0 0, 1 2)"\n2,\n')
    got = {r["id"]: r["coords"] for r in T.read_layer(spark, str(tmp_path / "l.csv"), "id long, geom string", "csv", wkt="geom").collect()}
    assert [tuple(p) for p in got[1]] == [(0, 0), (1, 2)] and got[2] is None


def test_near_and_interim(spark, tmp_path):
    near = spark.createDataFrame([(1, 1, 2, 0.5, 3.0, 1)], T.NEAR)
    near.write.parquet(str(tmp_path / "near"))
    assert T.read_near(spark, str(tmp_path / "near")).schema == T.NEAR
    with pytest.raises(ValueError):
        T.write_interim({"anchors": near}, str(tmp_path / "i"))
    T.write_interim(dict.fromkeys(T.INTERIM, near), str(tmp_path / "i"))
    assert {k: v.count() for k, v in T.read_interim(spark, str(tmp_path / "i")).items()} == dict.fromkeys(T.INTERIM, 1)


def test_splits_are_pruned(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "val"), (3, "test")], "id long, split string")
    T.write_splits(df, str(tmp_path / "s"), ["train", "val"])
    assert [r["id"] for r in T.read_split(spark, str(tmp_path / "s"), "val").collect()] == [2]
    plan = T.read_split(spark, str(tmp_path / "s"), "val")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    lines = df.withColumn("coords", G.line((F.lit(0.0), F.lit(0.0)), (F.lit(1.0), F.lit(1.0))))
    T.export_lines(lines, str(tmp_path / "x"))
    got = spark.read.parquet(str(tmp_path / "x")).first()
    assert got["wkt"] == "LINESTRING (0.0 0.0, 1.0 1.0)" and got["srid"] == 4326


def test_listing_and_digests(spark, tmp_path):
    (tmp_path / "a/deep/er").mkdir(parents=True)
    (tmp_path / "a/none").mkdir()
    (tmp_path / "a/x.bin").write_bytes(b"hello")
    (tmp_path / "a/.gitkeep").write_bytes(b"")
    (tmp_path / "a/deep/.gitkeep").write_bytes(b"")
    (tmp_path / "a/y.bin").write_bytes(b"")
    (tmp_path / "a/deep/er/z é.bin").write_bytes(b"abc" * 3_000_000)
    groups = {"one": [str(tmp_path / "a"), str(tmp_path / "missing")], "two": [f"file://{tmp_path}/a/x.bin", f"{tmp_path}/a/deep/"], "three": [str(tmp_path / "missing")]}
    files = B.list_files(spark, groups)
    assert sorted(tuple(r) for r in B.file_totals(files).collect()) == [("one", 3, 9_000_005), ("two", 2, 9_000_005)]
    assert B.list_files(spark, groups, choose=["three"]).count() == 0
    want = {"x.bin": hashlib.sha256(b"hello").hexdigest(), "y.bin": hashlib.sha256(b"").hexdigest(), "z é.bin": hashlib.sha256(b"abc" * 3_000_000).hexdigest()}
    one = files.where("group = 'one'")
    assert {r["name"]: r["sha256"] for r in B.manifest(one).collect()} == want
    assert {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in B.digests(files.where("group = 'two'")).collect()} == {k: want[k] for k in ("x.bin", "z é.bin")}
    expected = spark.createDataFrame([("x.bin", want["x.bin"].upper()), ("y.bin", "00"), ("q.bin", "00")], "name string, sha256 string")
    assert {r["name"]: r["ok"] for r in B.verify(one, expected).collect()} == {"x.bin": True, "y.bin": False, "q.bin": False}
    (tmp_path / "a/y.bin").unlink()
    assert {r["path"]: r["sha256"] for r in B.digests(one).collect()}[str(tmp_path / "a/y.bin")] is None


def test_sidecars(spark, tmp_path):
    for name in ("a.bin", "b.bin", "c.bin"):
        (tmp_path / name).write_bytes(name.encode() * 1000)
    files = B.list_files(spark, {"g": [str(tmp_path)]})
    assert B.write_sidecars(files).count() == 3 == B.write_sidecars(files).count()
    digest = hashlib.sha256(b"a.bin" * 1000).hexdigest()
    assert (tmp_path / "a.bin.sha256").read_text() == f"{digest}  a.bin\n"
    (tmp_path / "a.bin.sha256").write_text(digest.upper())
    (tmp_path / "b.bin").write_bytes(b"changed")
    (tmp_path / "c.bin.sha256").write_text("")
    (tmp_path / "d.bin").write_bytes(b"no sidecar")
    again = B.list_files(spark, {"g": [str(tmp_path)]})
    assert again.count() == 7  # no part of a sidecar is left
    got = {r["path"].rsplit("/", 1)[1]: r["ok"] for r in B.verify_sidecars(again).collect()}
    assert got == {"a.bin": True, "b.bin": False, "c.bin": False, "d.bin": False}


def test_many_files_and_loops(spark, tmp_path):
    for i in range(60):
        (tmp_path / f"{i % 7}/{i % 3}/{i}").mkdir(parents=True)
        for j in range(30):
            (tmp_path / f"{i % 7}/{i % 3}/{i}/{j}").write_bytes(b"x" * j)
    got = B.file_totals(B.list_files(spark, {"g": [str(tmp_path)]})).first()
    assert (got["n_files"], got["n_bytes"]) == (1800, 60 * sum(range(30)))
    (tmp_path / "loop").symlink_to(tmp_path, target_is_directory=True)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(B, "MAX_DEPTH", 6)
        with pytest.raises(ValueError, match="loop"):
            B.list_files(spark, {"g": [str(tmp_path)]})
