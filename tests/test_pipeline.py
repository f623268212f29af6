import pandas as pd
import pytest
from pyspark.sql import functions as F

from sonoloom.operators import arrays, clauses, comparison, pipeline
from sonoloom.streaming import events


def test_second_pass_isolates_bad_records(spark):
    df = spark.createDataFrame([(i, None if i == 4 else str(i) if i != 3 else "x") for i in range(7)], "i int, t string")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"v": [int(t) * 2 for t in pdf["t"]]}, index=pdf.index)

    got = {r.i: (r.status, r.v) for r in pipeline.second_pass(df, (F.col("i") > 1) & F.col("t").isNotNull(), run, "v long").collect()}
    assert got == {0: ("skipped", None), 1: ("skipped", None), 2: ("checked", 4), 3: ("failed", None), 4: ("skipped", None), 5: ("checked", 10), 6: ("checked", 12)}
    assert pipeline.second_pass(df.limit(0), F.lit(True), run, "v long").count() == 0


def test_monitored_passes(spark):
    rows = pipeline.monitored(spark.range(100).repartition(3), lambda it: (p[p["id"] % 2 == 0] for p in it)).collect()
    assert sum(r.rows_in for r in rows) == 100 and sum(r.rows_out for r in rows) == 50 and all(r.peak_mb > 1 and r.seconds >= 0 for r in rows)


def test_selection_ends_every_row_once(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 50)], "i int, x int")
    out = {r.i: (r.kept, r.reason) for r in pipeline.exhaustive_selection(df, [("known", F.col("x") > 0), ("small", F.col("x") < 10)]).collect()}
    assert out == {1: (True, None), 2: (False, "known"), 3: (False, "small")}


def test_rules_from_text():
    assert pipeline.overridden({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 9}, "d": None}) == {"a": {"b": 9, "c": 2}, "d": None}
    for bad in ({"z": 1}, {"a": {"z": 1}}):
        with pytest.raises(ValueError):
            pipeline.overridden({"a": {"b": 1}}, bad)
    assert pipeline.slots(["GE = 3", "Philips=1"], ["GE", "Philips"]) == {"GE": 3, "Philips": 1}
    for bad in (["GE"], ["GE=0"], ["X=1"], ["GE=1", "GE=2"], ["GE=-1"]):
        with pytest.raises(ValueError):
            pipeline.slots(bad, ["GE"])
    assert pipeline.selection_rule("ef/mae", {"mae": False}) == ("ef", "mae", False) and pipeline.selection_rule("loss", {"loss": False})[0] is None
    with pytest.raises(ValueError):
        pipeline.selection_rule("ef/zz", {"mae": False})


def test_collation_pads_to_the_batch(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, ["b", "c"]), (3, None), (4, [])], "i int, x array<string>")
    r = pipeline.collated(df, "i", "x", 4, "s").first()
    by = {k: (v, p) for k, v, p in zip(r["keys"], r.padded, r.present)}
    assert by == {1: (["a", None], [True, False]), 2: (["b", "c"], [True, True]), 3: ([None, None], [False, False]), 4: ([None, None], [False, False])}
    assert pipeline.collated(df.limit(0), "i", "x", 4, "s").count() == 0


def test_shard_stream_reads_each_shard_on_one_node(spark, tmp_path):
    for k in range(6):
        spark.createDataFrame([(k,)], "i int").coalesce(1).write.parquet(f"{tmp_path}/in/s{k}")
    (tmp_path / "in" / "bad.parquet").write_bytes(b"no parquet")
    seen = []
    for rank in range(2):
        q = events.shard_stream(spark, f"{tmp_path}/in", "i int", 2, rank).writeStream.format("memory").queryName(f"shards{rank}").trigger(availableNow=True).start()
        q.awaitTermination()
        seen += [r.i for r in spark.table(f"shards{rank}").collect()]
    assert sorted(seen) == list(range(6))


def test_keys_that_fall_silent(spark, tmp_path):
    schema = "user_id long, ts timestamp, value double"
    for k, rows in enumerate([[(1, "2024-01-01 00:00:00", 1.0), (2, "2024-01-01 00:05:00", 1.0)], [(2, "2024-01-02 00:00:00", 1.0)], [(3, "2024-01-09 00:00:00", 1.0)]]):
        df = spark.createDataFrame(rows, "user_id long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.parquet(f"{tmp_path}/in/f{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = events.quiet_keys(stream, "user_id", "1 hour").writeStream.format("memory").queryName("quiet").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.user_id for r in spark.table("quiet").collect()} >= {1, 2}


def test_comparison_edges(spark):
    df = spark.createDataFrame([(None, [1.0]), (3.0, None), (3.0, []), (3.0, [1.0, 4.0]), (3.0, [3.5])], "v double, s array<double>")
    assert [r.c for r in df.select(comparison.grade_check(F.col("v"), F.col("s")).alias("c")).collect()] == [None, None, None, "off by one", "consistent"]
    p = comparison.interval_pattern("EF", "%")
    texts = ["EF 55-60 %", "EF > 50 %", "EF about 40%", "EF ≤ 30,5 %", "EF between 40 and 50 %", "no", None, "EF 60-55 %"]
    got = [r.s for r in spark.createDataFrame([(t,) for t in texts], "t string").select(comparison.intervals(F.col("t"), p, 100.0).alias("s")).collect()]
    flat = [None if s is None else [tuple(x) for x in s] for s in got]
    assert flat == [
        [(55.0, 60.0, False, False, True)], [(50.0, 100.0, True, False, True)], [(40.0, 40.0, False, False, False)], [(0.0, 30.5, False, False, True)], [(40.0, 50.0, False, False, True)], [], None, [(55.0, 60.0, False, False, True)],
    ]
    v = spark.createDataFrame([(50.0, "EF > 50 %"), (50.1, "EF > 50 %"), (None, "EF 1 %"), (9.0, "no"), (None, None)], "v double, t string")
    assert [r.c for r in v.select(comparison.reconcile(comparison.intervals(F.col("t"), p, 100.0), F.col("v"), 0.0).alias("c")).collect()] == ["conflict", "agree", "stated", "appended", "none"]
    with pytest.raises(ValueError):
        comparison.encoded(F.lit("a"), {"a": 0, "b": 2}, "b")


def test_clause_edges(spark):
    df = spark.createDataFrame([("Wall thin. The rest is fine. The end", ), ("",), (None,)], "t string")
    from sonoloom.operators.textops import clauses as split

    got = [r.s for r in df.select(clauses.surgery(split(F.col("t")), "wall", "^the ").alias("s")).collect()]
    assert tuple(got[0]) == ("The end", 1, 1) and tuple(got[1]) == ("", 0, 0)
    assert [r.f for r in df.select(clauses.fold(F.lit("Événement d’Été")).alias("f")).collect()][0] == "evenement d'ete"
    boxes = spark.createDataFrame([("g", 1, 0.0, 2.0), ("g", 2, 1.0, 3.0), ("g", 3, 3.0, 4.0)], "g string, i int, lo double, hi double")
    assert {r.i: r.line for r in clauses.lines_of(boxes, ["g"], "lo", "hi", ["i"]).collect()} == {1: 1, 2: 1, 3: 2}
    assert arrays.straight(boxes, ["g"], "lo", "hi", 3, 0.1).first().n == 3
