import json
import os

import pytest
from pyspark.sql import functions as F

from sonoloom.sources import readers, sinks


def put(tmp_path, name, text, mode="w"):
    p = tmp_path / name
    p.write_text(text, encoding="utf-8") if mode == "w" else p.write_bytes(text)
    return str(p)


def test_ids_stay_text(spark, tmp_path):
    p = put(tmp_path, "a.csv", '﻿id,x,y\n007,NA,1.5\n,"a ""b"", c",x\n')
    rows = readers.read_ids_csv(spark, p, ["id"], types={"y": "double"}).collect()
    assert [tuple(r) for r in rows] == [("007", "NA", 1.5), ("", 'a "b", c', None)]
    with pytest.raises(ValueError, match="lacks"):
        readers.read_ids_csv(spark, p, ["zz"])


def test_sniffed_separators(spark, tmp_path):
    for sep in ";,α":
        p = put(tmp_path, f"s{ord(sep)}.csv", f"a{sep}b\n1{sep}2\n")
        assert [tuple(r) for r in readers.read_sniffed_csv(spark, p).collect()] == [("1", "2")]


def test_headerless(spark, tmp_path):
    p = put(tmp_path, "m.txt", "/a b/c.avi 3.5\n/d.avi 0\n\n/e.avi\n")
    assert {tuple(r) for r in readers.read_headerless(spark, p).collect()} == {("/a b/c.avi", 3.5), ("/d.avi", 0.0), ("/e.avi", 0.0)}
    g = put(tmp_path, "g.txt", "/a /b 2\n/c::/d::1\n")
    assert {(tuple(r.views), r.label) for r in readers.read_groups(spark, g).collect()} == {(("/a", "/b"), 2.0), (("/c", "/d"), 1.0)}


def test_weights_and_split(spark, tmp_path):
    df = spark.createDataFrame([("a", "train"), ("a", "train"), ("b", "val")], "ds string, split string")
    assert sorted(r.weight for r in readers.dataset_weights(df, "ds", {"a": 1.0, "b": 3.0}).collect()) == [0.5, 0.5, 3.0]
    p = str(tmp_path / "t")
    df.write.partitionBy("split").parquet(p)
    assert readers.read_split(spark, p, "val").count() == 1
    with pytest.raises(ValueError, match="no rows"):
        readers.read_split(spark, p, "test")


def test_pinned_and_parsed_files(spark, tmp_path):
    put(tmp_path, "x.bin", b"12", "b")
    put(tmp_path, "y.bin", b"zz", "b")
    before = [tuple(r) for r in readers.pinned_files(spark, f"{tmp_path}/*.bin").select("path", "sha256").collect()]
    old = spark.createDataFrame(before, "path string, sha256 string")
    put(tmp_path, "x.bin", b"13", "b")
    put(tmp_path, "w.bin", b"123456789", "b")
    change = {(os.path.basename(r.path), r.change) for r in readers.changed_files(old, readers.pinned_files(spark, f"{tmp_path}/*.bin")).collect()}
    assert change == {("x.bin", "changed"), ("w.bin", "added")}
    rows = readers.parse_files(spark, f"{tmp_path}/*.bin", lambda _, c: [{"n": int(c)}], "path string, error string, n long").collect()
    assert sorted(r.n for r in rows if r.error is None) == [13, 123456789] and [r.error[:10] for r in rows if r.error] == ["ValueError"]
    assert readers.small_files(spark, str(tmp_path), 5).count() == 2


def test_shards_keys_and_checks(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "sr")], "k int, kind string").write.parquet(f"{tmp_path}/s/shard0")
    spark.createDataFrame([(3, None)], "k int, kind string").write.parquet(f"{tmp_path}/s/shard1")
    new = spark.createDataFrame([(9, "sr")], "k int, kind string")
    df = readers.read_shards(spark, f"{tmp_path}/s/*", new, "kind", "sr")
    assert {r.k for r in df.collect()} == {1, 3, 9} and readers.completeness(df, 6) == 0.5
    assert readers.keyed_rows(df, "k", [1, 9]).count() == 2
    with pytest.raises(ValueError, match="exactly one"):
        readers.keyed_rows(df, "k", [1, 4])
    assert readers.violations(df, {"kind": F.col("kind").isNotNull(), "small": F.col("k") < 5}) == {"kind": 1, "small": 1}
    with pytest.raises(ValueError, match="shards"):
        readers.refuse(df, {"kind": F.col("kind").isNotNull()}, "shards")
    roles = readers.role_columns(df, {"role": "kind"}, ("role",))
    assert roles.columns == ["role"]


def test_manifests_and_read_back(spark, tmp_path):
    rows = [("train", "/a b.avi", 1.0), ("train", "/c.avi", 2.0), ("val", "/d.avi", 0.0), (None, "/e.avi", 0.0)]
    df = spark.createDataFrame(rows, "split string, path string, label double")
    out = str(tmp_path / "m")
    info = sinks.write_split_manifests(df, out)
    assert {k: v["rows"] for k, v in info.items()} == {"train": 2, "val": 1}
    back = readers.read_headerless(spark, f"{out}/train")
    assert sinks.differs(back, df.where("split = 'train'").select("path", "label")) == (0, 0)
    assert sinks.read_marker(spark, out)["complete"] and sinks.read_marker(spark, out + "x") is None
    assert json.loads(open(out + ".info.json").read())["splits"]["val"]["rows"] == 1


def test_publish_append_merge(spark, tmp_path):
    df = spark.createDataFrame([(1, "p", [0.5, 1.0]), (2, "p", [2.0])], "k int, run string, v array<double>")
    out = str(tmp_path / "pub")
    sinks.publish(df, out, lambda d, p: d.write.parquet(p))
    assert spark.read.parquet(out).count() == 2 and not os.path.exists(out + ".partial")
    with pytest.raises(ValueError, match="exists"):
        sinks.publish(df, out, lambda d, p: d.write.parquet(p))
    a = str(tmp_path / "app")
    assert sinks.append_missing(df, a, "k") == 2 and sinks.append_missing(df.unionByName(df.withColumn("k", F.col("k") + 1)), a, "k") == 1
    assert sinks.merge_shards([df.limit(1), df.where("k = 2")], "k", "run", df).count() == 2
    with pytest.raises(ValueError, match="repeated"):
        sinks.merge_shards([df, df], "k", "run")
    assert sinks.content_digest(df) == sinks.content_digest(df.orderBy(F.col("k").desc())) != sinks.content_digest(df.limit(1))
    v = str(tmp_path / "vec")
    sinks.write_vectors(df, v, "k", "v", 2)
    assert sinks.broken_vectors(spark, v, "v").count() == 0
    with pytest.raises(ValueError, match="inside"):
        sinks.ensure_outside(str(tmp_path / "x"), str(tmp_path))
    assert sinks.markdown(df.select("k")).count("|") > 4
