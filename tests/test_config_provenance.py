import json
import time

import pytest
from pyspark.sql import functions as F

from sonoloom.operators import arrays, clauses, provenance, relational
from sonoloom.sources import config, sinks
from sonoloom.streaming import events


def test_config_and_checks(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"n": 5, "split": {"train": 0.7, "val": 0.3}, "extra": 1}))
    got = config.read_config(spark, f"file://{tmp_path}/c.json")
    checks = {"n": config.number(1, 10, whole=True), "split": config.shares(("train", "val")), "split.val": config.number(0, 0.2)}
    assert config.problems(got, checks, closed=True) == ["split.val: a number from 0 to 0.2, not 0.3", "extra: unknown name"]
    for bad in (True, 2.5, None, "4"):
        assert config.problems({"n": bad}, {"n": checks["n"]})
    with pytest.raises(ValueError, match="split.val"):
        config.require(got, checks)
    assert config.problems({"x": float("nan")}, {"x": config.number(0, 1)})
    assert config.merged_defaults({"n": 3, "m": 1}, '{"n": 4}', {"n": checks["n"]}) == {"n": 4, "m": 1}
    with pytest.raises(ValueError, match="unknown"):
        config.merged_defaults({"n": 3}, '{"k": 4}', {})
    (tmp_path / "c.yaml").write_text("n: 5\nsplit: {train: 0.5}\n")
    pytest.importorskip("yaml")
    assert config.read_config(spark, f"file://{tmp_path}/c.yaml") == {"n": 5, "split": {"train": 0.5}}


def test_salt(tmp_path, monkeypatch):
    f = tmp_path / "salt"
    f.write_text("0123456789abcdef\n")
    assert config.read_salt(str(f)) == "0123456789abcdef"
    with pytest.raises(ValueError):
        config.read_salt(str(f), inside=str(tmp_path))
    monkeypatch.setenv("SONOLOOM_SALT", "short")
    with pytest.raises(ValueError):
        config.read_salt()


def test_catalogue_and_fallback(spark):
    c = config.Catalogue(spark)
    c.add("one", lambda s, n: s.range(n), 3)
    assert c.read("one").count() == 3 and c.read("two", default="one").count() == 3 and c.views() == ["one"] and spark.table("one").count() == 3
    with pytest.raises(KeyError):
        c.read("two")
    with pytest.raises(ValueError):
        c.add("one", lambda s: s.range(1))
    assert config.first_that_reads([lambda: spark.read.parquet("/nowhere/x"), lambda: spark.range(2)]).count() == 2
    with pytest.raises(ValueError, match="no source"):
        config.first_that_reads([lambda: spark.read.parquet("/nowhere/x")])


def test_documents_to_rows(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    assert [r.a for r in config.read_json_documents(spark, f"{tmp_path}/d.jsonl").orderBy("a").collect()] == [1, 2]
    tree = [("k", [("root", '[{"name": "x", "below": "[{\\"name\\": \\"y\\"}]"}, {"name": "z"}]'), ("other", None)]), ("empty", None)]
    df = spark.createDataFrame(tree, "id string, nodes array<struct<name:string,below:string>>")
    got = {(r.place, r.parent, r.level, r.name) for r in config.nested_rows(df, "id", "nodes", "below", ["name"]).collect()}
    assert got == {("1", None, 0, "root"), ("2", None, 0, "other"), ("1.1", "1", 1, "x"), ("1.2", "1", 1, "z"), ("1.1.1", "1.1", 2, "y")}
    (tmp_path / "list.txt").write_text("n01_a.jpg\n\nn01_a.jpg\nn02_b.jpg\n")
    assert {tuple(r) for r in config.subset_list(spark, f"{tmp_path}/list.txt").collect()} == {("n01_a.jpg", "n01"), ("n02_b.jpg", "n02")}
    assert config.typed_table(spark, [], "a int, b array<string>").dtypes == [("a", "int"), ("b", "array<string>")]


def test_flat_and_nested_json(spark):
    texts = ['{"a": {"b": "1", "c": {"d": "x\\"y"}}, "e": "2"}', "{}", None, '{"l": [1, 2]}']
    df = spark.createDataFrame(list(enumerate(texts)), "id long, doc string")
    leaves = relational.flat_leaves(df, "id", "doc")
    got = {(r.id, r.path, r.leaf) for r in leaves.collect()}
    assert got == {(0, "a.b", "1"), (0, "a.c.d", 'x"y'), (0, "e", "2"), (2, "", None), (3, "l", "[1,2]")}
    back = clauses.nested_json(leaves.where("id = 0"), "id", "path", "leaf").first().document
    assert json.loads(back) == json.loads(texts[0])
    after = spark.createDataFrame([(0, '{"a": {"b": "9", "c": {"d": "x\\"y"}}}')], "id long, doc string")
    assert {tuple(r) for r in relational.nested_diff(df.where("id = 0"), after, "id", "doc").collect()} == {(0, "a.b", "1", "9"), (0, "e", "2", None)}
    assert relational.nested_diff(df.where("id = 0"), after, "id", "doc", ("a.b", "e")).count() == 0


def test_joins_that_refuse(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (None, "d")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (1, "y")], "k int, w string")
    with pytest.raises(ValueError, match="right side"):
        relational.validated_join(a, b, "k")
    assert relational.validated_join(a, b, "k", one="1:m").count() == 5
    assert relational.validated_join(a, b.limit(1), "k").count() == 4
    with pytest.raises(ValueError, match="no partner"):
        relational.validated_join(a, b.limit(1), "k", complete=True)
    sides = {r.side: r["count"] for r in relational.indicator_join(a, b.limit(1), "k").groupBy("side").count().collect()}
    assert sides == {"both": 1, "left_only": 3}


def one(x):
    """A docstring."""
    return x + 1  # a remark


def test_provenance(spark):
    a, b = {"x": {"y": 1, "z": [1]}, "w": 2}, {"x": {"y": 1, "z": [2]}, "v": 2}
    assert provenance.differences(a, b) == ["v", "w", "x.z"] and provenance.differences(a, b, ("x", "v", "w")) == []
    assert provenance.fingerprint({"a": 1, "b": 2}) == provenance.fingerprint({"b": 2, "a": 1})
    with pytest.raises(ValueError, match="x.z"):
        provenance.require_same(a, b, "the cache")
    first = provenance.code_record(one)
    assert list(first) == [f"{__name__}.one"] and len(first[f"{__name__}.one"]) == 64
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, t string")
    marker = {"digest": sinks.content_digest(df)}
    assert provenance.require_artifact(df.repartition(3), marker, "t").count() == 2
    for bad in (None, {"digest": "0"}):
        with pytest.raises(ValueError):
            provenance.require_artifact(df, bad, "t")
    edges = spark.createDataFrame([("c", "b", "1"), ("b", "a", "2"), ("a", "c", "3"), ("z", "y", "4")], "child string, parent string, digest string")
    start = spark.createDataFrame([("c",)], "node string")
    assert {tuple(r) for r in provenance.lineage(edges, start).collect()} == {("c", 0), ("b", 1), ("a", 2)}
    files = spark.createDataFrame([("b", "1"), ("a", "9"), ("c", "3")], "path string, digest string")
    assert {tuple(r) for r in provenance.broken_lineage(edges, files).collect()} == {("b", "a", "changed"), ("z", "y", "gone")}
    assert {(r.i, r.state) for r in provenance.recheck(df, df.where("i = 1").unionByName(df.where("i = 1"))).collect()} == {(2, "extra"), (1, "missing")}
    assert provenance.bound_allowed({"kind": "simple random", "size": 5}, 5, 9) and not provenance.bound_allowed({"kind": "stratified", "size": 5}, 5, 9)


def test_report_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, f"<{i}>", "ab"[i % 2]) for i in range(23)], "i int, t string, g string")
    assert sinks.markdown(df, 20).endswith("3 more rows are not shown.") and "more" not in sinks.markdown(df, 23)
    assert sinks.write_pages(df.repartition(5), f"{tmp_path}/pages", ["i"], 10) == 3
    pages = {r.page: r.value for r in spark.read.text(f"{tmp_path}/pages").collect()}
    assert sorted(pages) == [0, 1, 2] and "&lt;9&gt;" in pages[0] and "&lt;10&gt;" in pages[1] and pages[2].count("<tr>") == 4
    sinks.write_groups(df, f"{tmp_path}/groups", "g")
    assert spark.read.option("header", True).csv(f"{tmp_path}/groups").groupBy("g").count().count() == 2
    for _ in range(2):
        sinks.append_log(df.limit(1).withColumn("x", F.lit(None).cast("double")), f"{tmp_path}/log", {"i": "%05d", "x": "%.2f", "t": "%s"})
    assert [r.value for r in spark.read.text(f"{tmp_path}/log").collect()] == ["00000,,<0>"] * 2
    (tmp_path / "in.jsonl").write_text('{"a": 1,  "b": "x"}\n{"a": 2}\n')
    sinks.keep_json_lines(spark, f"{tmp_path}/in.jsonl", f"{tmp_path}/kept", F.col("a") == 1)
    assert [r.value for r in spark.read.text(f"{tmp_path}/kept").collect()] == ['{"a": 1,  "b": "x"}']
    info = sinks.write_split_manifests(spark.createDataFrame([("p", 1.0, "train"), ("q", 2.0, "val"), ("r", 0.0, None)], "path string, label double, split string"), f"{tmp_path}/m")
    assert {k: v["rows"] for k, v in info.items()} == {"train": 1, "val": 1} and spark.read.text(f"{tmp_path}/m/train").first()[0] == "p 1.0"


def test_deadline_and_streams(spark, tmp_path):
    timed = events.with_deadline(lambda x: time.sleep(x) or 1 / (x - 0.01), 0.2)
    assert timed(0.0)[0] == "done" and timed(1.0) == ("late", None) and timed(0.01)[0] == "failed"
    for k in range(2):
        spark.createDataFrame([(k, float(k), "t")], "user_id long, value double, secret string").write.parquet(f"{tmp_path}/in/f{k}.parquet")
    stream = spark.readStream.schema("user_id long, value double, secret string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    lines = events.metric_sink(stream, f"{tmp_path}/out", f"{tmp_path}/cp", hidden=("user_id",))
    assert sum(x["rows"] for x in lines) == 2 and sum(x["sum_value"] or 0 for x in lines) == 1.0 and "sum_user_id" not in lines[0]
    assert len(events.metric_sink(stream, f"{tmp_path}/out", f"{tmp_path}/cp", hidden=("user_id",))) == len(lines)


def test_arrays_on_edges(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, []), (3, None)], "i int, x array<string>")
    got = {r.i: r.y for r in df.select("i", arrays.repeated_blocks(F.col("x"), 2, 2).alias("y")).collect()}
    assert got[1] == ["a", "b", "a", "b", "c", "c"] and got[2] == []
    pairs = spark.createDataFrame([("g", 1, 0.0), ("g", 2, 5.0), ("g", 3, 10.1), ("h", 4, 0.0), (None, 5, 0.0), ("g", 6, None)], "g string, i int, at double")
    assert {(r.id_a, r.id_b) for r in arrays.near_pairs(pairs, "g", "i", "at", 5.0).collect()} == {(1, 2)}
