import math
import random

from pyspark.sql import functions as F

from sonoloom.functions import ranks, skew
from sonoloom.operators import funnel, metrics, relational, retrieval, sampling, splits, targets, textops


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_unique_or_drop_and_conflicts(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("b", 1, "x"), ("b", 2, "x"), (None, 3, "x"), ("c", None, "x")], "k string, v int, z string")
    assert rows(relational.unique_or_drop(df, "k", ["v"])) == [("a", 1), ("c", None)]
    assert rows(relational.conflicting_keys(df, "k", ["v"])) == [("b", 2)]
    assert rows(relational.null_conflicts(df.where("k is not null"), "k", ["v"])) == [("a", 1), ("b", None), ("c", None)]
    assert relational.drop_repeated(df.unionByName(df.where("k is null")), "k").count() == 6
    assert relational.unique_or_drop(df.limit(0), "k", ["v"]).count() == 0


def test_links_and_diffs(spark):
    a = spark.createDataFrame([("s1", "1"), ("s2", None), ("s3", "9")], "s string, p string")
    b = spark.createDataFrame([("s1", "1"), ("s2", None), ("s3", "3")], "s string, q string")
    assert rows(relational.verified_link(a, b, "s", [("p", "q")]).select("s", "verified")) == [("s1", True), ("s2", False), ("s3", False)]
    c = spark.createDataFrame([("s1", "1"), ("s3", "8"), ("s4", None)], "s string, p string")
    assert rows(relational.full_diff(a, c, "s", ["p"])) == [("s2", "removed"), ("s3", "changed"), ("s4", "added")]
    d = relational.range_lookup(spark.createDataFrame([(0.0,), (1.0,), (5.0,), (None,)], "v double"), "v", [("lo", 0.0, 1.0), ("hi", 1.0, 5.0)], "bin")
    assert rows(d.select("bin")) == [("hi",), ("lo",), (None,), (None,)]


def test_interval_sweep_and_as_of_brute_force(spark):
    rng = random.Random(3)
    x = [(i, rng.choice("ab"), a := rng.randrange(30), a + rng.randrange(1, 6)) for i in range(80)]
    df = spark.createDataFrame(x, "id int, g string, lo int, hi int")
    got = {r.id: r.n_open for r in relational.overlapping_intervals(df, ["g"], "id", "lo", "hi").collect()}
    want = {i: n for i, g, lo, hi in x if (n := sum(g == h and (a, j) < (lo, i) and b > lo for j, h, a, b in x))}
    assert got == want
    left = spark.createDataFrame([(i, g, lo, "zz") for i, g, lo, _ in x], "id int, g string, at int, _v2 string")
    right = spark.createDataFrame([("a", 5, 50), ("a", 9, None), ("b", 12, 7)], "g string, at int, val int")
    out = {r.id: r.out for r in relational.as_of(left, right, "g", "at", "val", "out").collect()}
    assert out == {i: 50 if g == "a" and lo >= 5 else 7 if g == "b" and lo >= 12 else None for i, g, lo, _ in x}


def test_rules(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "a")], "v int, g string")
    rules = [("big", "v > 1"), ("a", "g = 'a'")]
    assert rows(df.select(funnel.reasons(rules))) == [("a",), ("a",), ("big",)]
    f = {(r.g, r.level): (r.n_all, r.n_big, r.n_a) for r in funnel.funnel(df, rules, ["g"]).collect()}
    assert f == {("a", 0): (2, 0, 0), ("b", 0): (1, 1, 0), (None, 1): (3, 1, 0)}
    assert rows(df.select(funnel.suppressed(F.lit(3)), funnel.suppressed(F.lit(5)), funnel.suppressed(F.lit(0))))[0] == ("<5", "5", "0")
    assert rows(df.select(funnel.decision(F.col("v") > 1, F.col("v").isNull()))) == [("exclude",), ("keep",), ("uncertain",)]


def test_ranks_and_sums_in_buckets(spark, monkeypatch):
    rng = random.Random(7)
    x = [(i, float(rng.randrange(40))) for i in range(500)]
    df = spark.createDataFrame(x, "id long, v double")
    monkeypatch.setattr(ranks, "BUCKET_ROWS", 50)
    got = {r.id: r.upto for r in ranks.running_sums(df, "v", ["id"], {"upto": "id"}).collect()}
    total, want = 0, {}
    for i, v in sorted(x, key=lambda r: (r[1], r[0])):
        total += i
        want[i] = total
    assert got == want
    r = ranks.rank_by_hash(df, F.pmod(F.col("id") * 2654435761, F.lit(4294967296)), ["id"])
    by = sorted(r.collect(), key=lambda y: (y.id * 2654435761 % 4294967296, y.id))
    assert [y["rank"] for y in by] == list(range(1, 501))


def test_splits_do_not_depend_on_order(spark):
    df = spark.range(200).select(F.concat(F.lit("p"), "id").alias("p"))
    a, b = rows(splits.exact_split(df, "p", "s")), rows(splits.exact_split(df.orderBy(F.rand(1)).repartition(7), "p", "s"))
    assert a == b and sum(x[2] == "train" for x in a) == 140 and sum(x[2] == "val" for x in a) == 20
    known = spark.createDataFrame([("p1", "test")], "p string, split string")
    got = {r.p: (r.split, r.origin) for r in splits.inherited_split(df, "p", known, "s").collect()}
    assert got["p1"] == ("test", "inherited") and got["p2"][1] == "hash"


def test_samples(spark):
    df = spark.createDataFrame([(i, "big" if i < 90 else "small") for i in range(93)], "id long, g string")
    s = sampling.stratified(df, ["g"], 5, "s", "id")
    assert rows(s.groupBy("g").agg(F.count("*"), F.round(F.avg("inclusion"), 6))) == [("big", 5, round(5 / 90, 6)), ("small", 3, 1.0)]
    assert rows(s.select("id")) == rows(sampling.stratified(df.repartition(9), ["g"], 5, "s", "id").select("id"))
    bag = sampling.round_robin(df, "g", "id", "id", 4, "s")
    assert bag.groupBy("g").count().where("count <> 4 and g = 'big'").count() == 0
    clips, mask = sampling.padded(F.array(F.lit("a"), F.lit("b")), 4)
    assert rows(df.limit(1).select(clips, mask)) == [(["a", "b", None, None], [1, 1, 0, 0])]


def test_metrics_brute_force(spark):
    rng = random.Random(11)
    x = [(bool(rng.randrange(2)), round(rng.random(), 1)) for _ in range(300)] + [(None, 0.5), (True, None)]
    df = spark.createDataFrame(x, "low boolean, s double")
    known = [(a, b) for a, b in x if a is not None and b is not None]
    pos, neg = [s for a, s in known if a], [s for a, s in known if not a]
    area = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert math.isclose(metrics.auroc(df, "low", "s").first().auroc, area)
    ap, last = 0.0, 0
    for cut in sorted({s for _, s in known}, reverse=True):
        tp, n = sum(p >= cut for p in pos), sum(s >= cut for _, s in known)
        ap, last = ap + (tp - last) / len(pos) * tp / n, tp
    assert math.isclose(metrics.average_precision(df, "low", "s").first().average_precision, ap)
    assert metrics.auroc(df.where("low"), "low", "s").first().auroc is None
    assert metrics.auroc(df.limit(0), "low", "s").first().auroc is None
    best = metrics.youden(df, "low", "s", 0.5).first()
    cuts = sorted({s for _, s in known})
    j = lambda t: sum(p > t for p in pos) / len(pos) + sum(n < t for n in neg) / len(neg) - 1
    assert math.isclose(best.youden_j, max(j((a + b) / 2) for a, b in zip(cuts, cuts[1:])))
    assert metrics.youden(df.where("low"), "low", "s", 0.5).count() == 0
    worse = spark.createDataFrame([(True, 1.0), (False, 2.0)], "low boolean, s double")
    assert [(r.threshold, r.youden_j) for r in metrics.youden(worse, "low", "s", 0.9).collect()] == [(0.0, 0.0)]
    worse = spark.createDataFrame([(True, 38.0), (True, 45.0), (False, 44.0), (False, 60.0)], "low boolean, p double").withColumn("s", -F.col("p"))
    assert metrics.youden(worse, "low", "s", -40.0).first().threshold == -41.0


def test_exact_interval_by_the_binomial_tail(spark):
    rows = [(k, n) for n in (1, 7, 60, 5000) for k in sorted({0, 1, n // 3, n - 1, n})] + [(None, 4), (1, None)]
    low, high = metrics.exact_interval(F.col("k"), F.col("n"), 0.9)
    tail = lambda k, n, p: math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    for r in spark.createDataFrame(rows, "k int, n int").select("k", "n", low.alias("low"), high.alias("high")).collect():
        if r.k is None or r.n is None:
            assert r.low is None and r.high is None
        elif r.n < 100:
            assert r.high == 1.0 if r.k == r.n else math.isclose(tail(r.k, r.n, r.high), 0.05, rel_tol=1e-6)
            assert r.low == 0.0 if r.k == 0 else math.isclose(1 - tail(r.k - 1, r.n, r.low), 0.05, rel_tol=1e-6)
        else:
            assert 0 <= r.low <= r.k / r.n <= r.high <= 1 and r.high - r.low < 0.03


def test_calibration_and_bounds(spark):
    rng = random.Random(13)
    x = []
    for _ in range(4000):
        z = rng.gauss(0, 1)
        x.append((rng.random() < 1 / (1 + math.exp(-(0.5 + 2 * z))), 1 / (1 + math.exp(-z))))
    a, b = metrics.calibration_line(spark.createDataFrame(x, "y boolean, p double"), "y", "p")
    assert abs(a - 0.5) < 0.15 and abs(b - 2) < 0.2
    a, b = metrics.calibration_line(spark.createDataFrame([(True, 0.9), (False, 0.1)], "y boolean, p double"), "y", "p")
    assert a is None and b is None
    assert metrics.calibration_line(spark.createDataFrame([], "y boolean, p double"), "y", "p") == (None, None)
    r = spark.createDataFrame([(0, 100), (3, 3), (0, 0)], "k int, n int").select(metrics.exact_upper(F.col("k"), F.col("n")).alias("u")).collect()
    assert math.isclose(r[0].u, 1 - 0.05 ** (1 / 100), rel_tol=1e-6) and r[1].u == 1.0 and r[2].u is None


def test_targets(spark):
    df = spark.createDataFrame([(10.0,), (55.0,), (None,)], "v double")
    assert rows(df.select(targets.indicator(F.col("v") > 20, F.col("v").isNotNull()))) == [(0.0,), (1.0,), (None,)]
    assert rows(df.select(targets.banded(F.col("v"), [10, 50]))) == [(1.0,), (2.0,), (None,)]
    t = spark.createDataFrame([("1.5",), ("NaN",), ("x",), (None,), ("inf",)], "t string").select(targets.finite(F.col("t")).alias("f"))
    assert [r.f for r in t.collect()] == [1.5, None, None, None, None]
    v = spark.createDataFrame([(5.0,), (6.0,), (0.05,), (5000.0,), (0.0,), (None,)], "v double")
    fixed = {r.v: (r.repaired, r.action) for r in targets.decimal_repair(v, "v", 2.0, 9.0).collect()}
    assert fixed[0.05][1] == "shifted" and math.isclose(fixed[0.05][0], 5.0) and fixed[0.0] == (None, "dropped") and fixed[None] == (None, "missing")


def test_retrieval_and_text(spark):
    v = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(30)] + [(99, None)], "vec_id long, v array<double>")
    q = v.where("vec_id in (3, 7, 99)").withColumnRenamed("vec_id", "query_id")
    got = {(r.query_id, r.place): r.vec_id for r in retrieval.nearest(q, v.repartition(5), 3, block=1).collect()}
    for i in (3, 7):
        best = sorted((j for j in range(30) if j != i), key=lambda j: (-round(math.cos(i - j), 9), j))[:3]
        assert [got[i, p] for p in (1, 2, 3)] == best
    assert rows(retrieval.mean_vector(v.where("v is not null").withColumn("g", F.lit(1)).where("vec_id < 1"), ["g"], "v"))[0][1] == [1.0, 0.0]
    t = spark.createDataFrame([("EF 3,5 cm. Ok; x // y\nz",), (None,)], "t string")
    assert rows(t.select(textops.clauses(F.col("t")))) == [(None,), (["EF 3,5 cm", "Ok", "x", "y", "z"],)]
    assert rows(t.select(textops.numbers(F.col("t")))) == [(None,), ([3.5],)]


def test_hot_keys_join(spark):
    left = spark.createDataFrame([("hot", i) for i in range(400)] + [(f"k{i}", i) for i in range(100)] + [(None, 1)], "k string, i int")
    right = spark.createDataFrame([("hot", "a"), ("k1", "b"), ("zz", "c")], "k string, v string")
    hot = skew.hot_keys(left, "k", 0.1)
    assert "hot" in hot and len(hot) <= 10
    out = skew.salted_join(left, right, "k", hot, F.col("i"), "left")
    assert out.count() == 501 and out.where("v = 'a'").count() == 400 and out.where("v = 'b'").count() == 1


def test_rolling_range_over_cells_brute_force(spark):
    rng = random.Random(21)
    data = [(i, "a" if rng.random() < 0.7 else "b", rng.randrange(2000), float(rng.randrange(9))) for i in range(400)]
    df = spark.createDataFrame(data + [(900, None, 5, 1.0), (901, "a", 7, None)], "i int, g string, us long, x double")
    got = {r.i: (r.n, r.top) for r in relational.rolling_range(df, "g", "us", 40, {"n": F.count("x"), "top": F.max("x")}, cell=100).collect()}
    for i, g, us, _ in data:
        near = [x for _, h, u, x in data if h == g and us - 40 <= u <= us]
        assert got[i] == (len(near), max(near)), i
    assert len(got) == 402 and got[900] == (1, 1.0)


def test_running_sums_over_many_buckets(spark, monkeypatch):
    from sonoloom.functions import ranks

    monkeypatch.setattr(ranks, "BUCKET_ROWS", 10)
    rng = random.Random(22)
    data = [(i, rng.choice([float(rng.randrange(-50, 50)), rng.random()]), rng.randrange(5)) for i in range(600)]
    got = {r.i: r.upto for r in ranks.running_sums(spark.createDataFrame(data, "i int, x double, v int"), "x", ["i"], {"upto": "v"}).collect()}
    total, want = 0, {}
    for i, _, v in sorted(data, key=lambda r: (r[1], r[0])):
        total += v
        want[i] = total
    assert got == want


def test_rank_by_hash_keeps_null_groups(spark):
    from sonoloom.functions import ranks
    from sonoloom.functions.hashing import hash_int

    df = spark.createDataFrame([(i, None if i % 3 == 0 else "ab"[i % 2]) for i in range(90)], "i int, g string")
    got = {}
    for r in ranks.rank_by_hash(df, hash_int("s", F.col("i")), ["i"], "k", ("g",)).collect():
        got.setdefault(r.g, []).append(r.k)
    assert {g: sorted(k) for g, k in got.items()} == {g: list(range(1, 31)) for g in (None, "a", "b")}
