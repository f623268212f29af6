import datetime as dt
import random

from sonoloom.operators.references import cohort_parents, cohort_references, orphan_counts, orphan_references

REF = "ref_table string, ref_field string, ref_row long, domain string, key string, at timestamp_ntz"
PARENT = "domain string, key string, registered_at timestamp_ntz, deleted_at timestamp_ntz"
T0 = dt.datetime(2024, 1, 1)


def day(n):
    return None if n is None else T0 + dt.timedelta(days=n)


def reasons(spark, refs, parents, **kw):
    r = spark.createDataFrame([("t", "f", i, "d", k, day(a)) for i, (k, a) in enumerate(refs)], REF)
    p = spark.createDataFrame([("d", k, day(a), day(b)) for k, a, b in parents], PARENT)
    return {x.ref_row: x.reason for x in orphan_references(r, p, **kw).collect()}


def test_reasons_and_boundaries(spark):
    parents = [("a", 1, None), ("b", 5, None), ("c", 1, 3), ("c", 1, 3), ("d", 1, 3), ("d", 4, None), ("e", None, 2)]
    refs = [("a", 1), ("a", 0), ("b", 2), ("c", 3), ("c", 2), ("d", 3), ("d", 4), ("x", 1), (None, 1), ("x", None), ("a", None), ("e", 0), ("e", 2)]
    assert reasons(spark, refs, parents) == {1: "late", 2: "late", 3: "deleted", 5: "deleted", 7: "missing", 9: "missing", 12: "deleted"}


def test_empty_tables(spark):
    assert reasons(spark, [("a", 1)], []) == {0: "missing"}
    assert reasons(spark, [], [("a", 1, None)]) == {}


def test_brute_force_with_hot_key(spark):
    rng = random.Random(5)
    parents = [(f"k{rng.randrange(40)}", a := rng.randrange(50), None if rng.random() < 0.5 else a + rng.randrange(20)) for _ in range(60)]
    refs = [("k0" if rng.random() < 0.4 else f"k{rng.randrange(50)}", rng.randrange(60)) for _ in range(600)]
    want = {}
    for i, (k, t) in enumerate(refs):
        own = [p for p in parents if p[0] == k]
        if not own:
            want[i] = "missing"
        elif not [p for p in own if p[1] <= t]:
            want[i] = "late"
        elif not [p for p in own if p[1] <= t and (p[2] is None or p[2] > t)]:
            want[i] = "deleted"
    assert reasons(spark, refs, parents, support=0.05) == want


def test_project_tables_with_clashing_columns(spark):
    m = spark.createDataFrame(
        [(1, " 'ABC' ", r"\v\\a\.\x.avi ", day(3), "zz"), (2, "N/A", "", day(3), "zz"), (3, "abd", "/v/a/X.avi", day(3), "zz")],
        "row_id long, study_id string, video_path string, ingested_at timestamp_ntz, reason string",
    )
    u = spark.createDataFrame([(7, '"K1"', day(1)), (8, "k2", day(1)), (9, None, day(1))], "upload_id long, study_key string, uploaded_at timestamp_ntz")
    s = spark.createDataFrame([("abc", "k1", day(0), None, "live")], "study_id string, study_key string, registered_at timestamp_ntz, deleted_at timestamp_ntz, side string")
    v = spark.createDataFrame([("/v/a/x.avi", day(0), None)], "video_path string, registered_at timestamp_ntz, deleted_at timestamp_ntz")
    out = orphan_references(cohort_references(m, u), cohort_parents(s, v))
    assert {(r.ref_field, r.ref_row) for r in out.collect()} == {("study_id", 3), ("video_path", 3), ("study_key", 8)}
    assert {(r.ref_table, r.month, r.n_orphans) for r in orphan_counts(out).where("ref_field = 'study_key'").collect()} == {("pilot_upload", "2024-01", 1)}
