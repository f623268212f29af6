"""Scans, id repair, funnels, links, audits, set operations and splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sonoloom.functions.hashing import hash_int, hash_int_sql, hash_unit_sql
from sonoloom.functions.ids import path_key, path_key_sql, study_key, study_key_sql
from sonoloom.operators import funnel, relational, splits
from sonoloom.plans.common import M, S, manifest, study_rows
from sonoloom.plans.registry import Registry

R = Registry()


@R.add("select row_id, site, n_frames, fps from build_manifests where avi_status = 'success' and n_frames >= 100")
def scan_pushdown(t):
    return t.build_manifests.where((F.col("avi_status") == "success") & (F.col("n_frames") >= 100)).select("row_id", "site", "n_frames", "fps")


@R.add(f"with {M} select row_id, patient, study, path from m")
def id_normalise(t):
    return manifest(t).select("row_id", "patient", "study", "path")


_RULES = [("status", "status = 'success'"), ("exam", "exam in ('ECHO TT DOPPLER', 'ECHO TT LIMITEE')"), ("label", "label > 0 and label <= 100"), ("year", "year >= 2020")]
_CUMULATIVE = ", ".join(f"count(*) filter ({' and '.join('(' + x + ')' for _, x in _RULES[: k + 1])}) as n_{name}" for k, (name, _) in enumerate(_RULES))


@R.add(f"with {M} select exam, view, grouping(exam, view)::bigint as level, count(*) as n_all, {_CUMULATIVE} from m group by grouping sets ((exam), (view), ())")
def cohort_funnel(t):
    return funnel.funnel(manifest(t), _RULES, ["exam", "view"])


_MISS = [("other_view", "view = 'OTHER'"), ("few_frames", "n_frames < 40"), ("slow", "fps < 30"), ("unread", "status <> 'success'")]
_REASONS = "nullif(concat_ws(';', " + ", ".join(f"case when {c} then '{n}' end" for n, c in _MISS) + "), '')"


@R.add(f"with {M} select row_id, {_REASONS} as reasons from m")
def rule_reasons(t):
    return manifest(t).select("row_id", funnel.reasons(_MISS).alias("reasons"))


@R.add(f"with {M}, r as (select {_REASONS} as reasons from m) select split_part(reasons, ';', 1) as reason, count(*) as n from r where reasons is not null group by 1")
def reason_histogram(t):
    r = manifest(t).select(funnel.reasons(_MISS).alias("reasons")).where("reasons is not null")
    return r.groupBy(funnel.first_reason(F.col("reasons")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@R.add(f"with {M}, r as (select {_REASONS} as reasons from m) select unnest(string_split(reasons, ';')) as reason, count(*) as n from r where reasons is not null group by 1")
def each_reason_histogram(t):
    r = manifest(t).select(F.explode(F.split(funnel.reasons(_MISS), ";")).alias("reason"))
    return r.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@R.add(f"with {M} select site, case when status <> 'success' or n_frames < 20 then 'exclude' when view = 'OTHER' or fps is null then 'uncertain' else 'keep' end as decision, count(*) as n from m group by 1, 2")
def decision_policy(t):
    d = funnel.decision((F.col("status") != "success") | (F.col("n_frames") < 20), (F.col("view") == "OTHER") | F.col("fps").isNull())
    return manifest(t).groupBy("site", d.alias("decision")).agg(F.count(F.lit(1)).alias("n"))


@R.add(f"""with {M}, g as (select study, count(*) as n_rows, list(distinct split_part(view, '_', 1)) as f from m where study is not null group by 1)
select study, n_rows, array_to_string(list_filter(['A4C', 'PLAX', 'PSAX'], lambda x: not list_contains(f, x)), '+') as missing,
  n_rows >= 4 and len(list_filter(['A4C', 'PLAX', 'PSAX'], lambda x: not list_contains(f, x))) = 0 as ok from g""")
def study_shortfall(t):
    m = manifest(t).where("study is not null").withColumn("family", F.split_part("view", F.lit("_"), F.lit(1)))
    return funnel.shortfall(m, "study", 4, "family", ["A4C", "PLAX", "PSAX"])


@R.add(f"""with {M}, d as (select distinct path, study, patient, view, n_frames from m where path is not null)
select (select count(*) from m) as n_before, (select count(*) from d) + (select count(*) from m where path is null) as n_after""")
def dedup_rows(t):
    m = manifest(t).select("path", "study", "patient", "view", "n_frames")
    after = relational.drop_repeated(m, "path").agg(F.count(F.lit(1)).alias("n_after"))
    return m.agg(F.count(F.lit(1)).alias("n_before")).join(after)


@R.add(f"""with {S}, d as (select distinct study, patient, day from s where study is not null)
select study, any_value(patient) as patient, any_value(day) as day from d group by study having count(*) = 1""")
def unique_or_drop(t):
    return relational.unique_or_drop(study_rows(t), "study", ["patient", "day"])


@R.add(f"with {M} select path, count(distinct (study, patient)) as n_versions from m where path is not null group by 1 having count(distinct (study, patient)) > 1")
def conflict_report(t):
    return relational.conflicting_keys(manifest(t), "path", ["study", "patient"])


@R.add(f"""with {S} select study, case when min(ef) = max(ef) then max(ef) end as ef, case when min(exam) = max(exam) then max(exam) end as exam,
  case when min(patient) = max(patient) then max(patient) end as patient from s where study is not null group by 1""")
def target_conflict_null(t):
    return relational.null_conflicts(study_rows(t).where("study is not null"), "study", ["ef", "exam", "patient"])


_LINK = f"""{M}, {S}, one as (select study, patient as s_patient, day from (select study, any_value(patient) as patient, any_value(day) as day, count(*) as n from (select distinct study, patient, day from s where study is not null) group by study) where n = 1)"""


@R.add(f"""with {_LINK} select m.site, coalesce(m.patient = one.s_patient and m.year = try_cast(substr(one.day, 1, 4) as int), false) as verified, count(*) as n
from m join one using (study) group by 1, 2""")
def link_verified(t):
    one = relational.unique_or_drop(study_rows(t), "study", ["patient", "day"]).select("study", F.col("patient").alias("s_patient"), F.substring("day", 1, 4).try_cast("int").alias("s_year"))
    linked = relational.verified_link(manifest(t), one, "study", [("patient", "s_patient"), ("year", "s_year")])
    return linked.groupBy("site", "verified").agg(F.count(F.lit(1)).alias("n"))


@R.add(f"""with {_LINK}, known as (select distinct study from s where study is not null)
select case when m.study is null then 'no_id' when known.study is null then 'no_study' when one.study is null then 'study_rows_differ' when m.patient is null then 'no_patient'
  when coalesce(m.patient = one.s_patient, false) then 'linked' else 'patient_differs' end as reason, count(*) as n
from m left join known on known.study = m.study left join one on one.study = m.study group by 1""")
def link_reasons(t):
    s = study_rows(t).where("study is not null")
    known = s.groupBy("study").agg(F.countDistinct(F.struct("patient", "day")).alias("versions"), F.max("patient").alias("s_patient"))
    j = manifest(t).join(known, "study", "left")
    reason = (
        F.when(F.col("study").isNull(), "no_id").when(F.col("versions").isNull(), "no_study").when(F.col("versions") > 1, "study_rows_differ")
        .when(F.col("patient").isNull(), "no_patient").when(relational.same(F.col("patient"), F.col("s_patient")), "linked").otherwise("patient_differs")
    )
    return j.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_V = f"v as (select distinct {path_key_sql('video_path')} as path from video_files)"


@R.add(f"with {M}, {_V} select row_id from m where path in (select path from v where path is not null)")
def semi_join_filter(t):
    v = t.video_files.select(path_key(F.col("video_path")).alias("path"))
    return manifest(t).join(v, "path", "left_semi").select("row_id")


@R.add(f"with {M}, {_V} select row_id from m where path is not null and path not in (select path from v where path is not null)")
def anti_join_filter(t):
    v = t.video_files.select(path_key(F.col("video_path")).alias("path"))
    return manifest(t).where("path is not null").join(v, "path", "left_anti").select("row_id")


@R.add("select o.o_orderkey, count(l.l_orderkey) as n_items, coalesce(round(sum(l.l_extendedprice), 2), 0) as total from orders o left join lineitem l on l.l_orderkey = o.o_orderkey group by 1")
def left_join_counts(t):
    items = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("s"))
    j = t.orders.select("o_orderkey").join(items, "o_orderkey", "left")
    return j.select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n_items"), F.coalesce("s", F.lit(0.0)).alias("total"))


@R.add(f"""with {S}, f as (select study, (list(ef order by registered_at, ef) filter (ef is not null))[1] as ef, (list(exam order by registered_at, exam) filter (exam is not null))[1] as exam from s where study is not null group by 1),
l as (select study, max(ef) as ef, max(exam) as exam from s where study is not null and deleted_at is null group by 1)
select coalesce(f.study, l.study) as study, case when f.study is null then 'added' when l.study is null then 'removed' else 'changed' end as change
from f full join l on f.study = l.study where f.study is null or l.study is null or f.ef is distinct from l.ef or f.exam is distinct from l.exam""", name="full_outer_diff")
def full_outer_diff(t):
    s = study_rows(t).where("study is not null")
    first = s.groupBy("study").agg(F.min_by("ef", F.when(F.col("ef").isNotNull(), F.struct("registered_at", "ef"))).alias("ef"), F.min_by("exam", F.when(F.col("exam").isNotNull(), F.struct("registered_at", "exam"))).alias("exam"))
    last = s.where("deleted_at is null").groupBy("study").agg(F.max("ef").alias("ef"), F.max("exam").alias("exam"))
    return relational.full_diff(first, last, "study", ["ef", "exam"])


_BINS = [("severe", 0.0, 30.0), ("moderate", 30.0, 40.0), ("mild", 40.0, 50.0), ("normal", 50.0, 101.0)]
_BINS_SQL = "(values " + ", ".join(f"('{n}', {a}, {b})" for n, a, b in _BINS) + ") b(grade, low, high)"


@R.add(f"with {M} select grade, count(*) as n, round(avg(label), 6) as mean_label from m left join {_BINS_SQL} on label >= low and label < high group by 1")
def range_bins_join(t):
    g = relational.range_lookup(manifest(t), "label", _BINS, "grade")
    return g.groupBy("grade").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("label"), 6).alias("mean_label"))


@R.add("""with x as (select source, manufacturer, still_row, spec_y0 as low, spec_y1 as high from radar_stills where spec_y0 < spec_y1)
select a.source, a.manufacturer, a.still_row, count(*) as n_open from x a join x b on a.source = b.source and a.manufacturer is not distinct from b.manufacturer
  and (b.low < a.low or (b.low = a.low and b.still_row < a.still_row)) and b.high > a.low group by all""")
def interval_overlap(t):
    x = t.radar_stills.where("spec_y0 < spec_y1")
    return relational.overlapping_intervals(x, ["source", "manufacturer"], "still_row", "spec_y0", "spec_y1")


@R.add(f"with {M} select patient, count(distinct split) as n_splits, array_to_string(list_sort(list(distinct split)), '+') as splits from m where patient is not null group by 1 having count(distinct split) > 1")
def leak_audit_patients(t):
    return relational.in_two_splits(manifest(t), "patient", "split")


@R.add(f"""with {M}, k as (select 'patient' as kind, patient as key, split from m union all select 'study', study, split from m union all select 'path', path, split from m),
g as (select kind, key, count(distinct split) as n from k where key is not null group by all) select kind, count(*) as n_keys, count(*) filter (n > 1) as n_leaks from g group by 1""")
def leak_audit(t):
    m = manifest(t)
    k = m.select(F.inline(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("key"), F.col("split")) for c in ("patient", "study", "path")])))
    g = k.where("key is not null").groupBy("kind", "key").agg(F.countDistinct("split").alias("n"))
    return g.groupBy("kind").agg(F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("n") > 1).alias("n_leaks"))


@R.add("""with e as (select event_id, user_id, ts from events where event_type = 'error'), p as (select user_id, ts, max(value) as value from events where event_type = 'purchase' group by all)
select e.event_id, p.value as last_purchase from e asof left join p on e.user_id = p.user_id and e.ts >= p.ts""")
def as_of_join(t):
    e = t.events
    left = e.where("event_type = 'error'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return relational.as_of(left, right, "user_id", "ts", "value", "last_purchase").select("event_id", "last_purchase")


@R.add(f"with {M} select exam, count(*) filter (status = 'success') as success, count(*) filter (status = 'partial') as partial, count(*) filter (status = 'failed') as failed from m group by 1")
def crosstab_status(t):
    return manifest(t).groupBy("exam").pivot("status", ["success", "partial", "failed"]).count().na.fill(0)


@R.add(f"with {M} select site, exam, case when count(*) between 1 and 4 then '<5' else count(*)::varchar end as shown from m where view = 'RVINF' group by 1, 2")
def small_cell_suppression(t):
    g = manifest(t).where("view = 'RVINF'").groupBy("site", "exam").agg(F.count(F.lit(1)).alias("n"))
    return g.select("site", "exam", funnel.suppressed(F.col("n")).alias("shown"))


_K = f"a as (select distinct study from m where study is not null), b as (select distinct study from s where study is not null), c as (select distinct {study_key_sql('study_id')} as study from column_review)"


def _study_sets(t):
    a = manifest(t).select("study").where("study is not null")
    b = study_rows(t).select("study").where("study is not null")
    return a, b, t.column_review.select(study_key(F.col("study_id")).alias("study")).where("study is not null")


@R.add(f"with {M}, {S}, {_K} select study from a intersect select study from c")
def set_intersect(t):
    a, _, c = _study_sets(t)
    return a.intersect(c)


@R.add(f"with {M}, {S}, {_K} select study from a except select study from b")
def set_except(t):
    a, b, _ = _study_sets(t)
    return a.subtract(b)


@R.add(f"with {M}, {S}, {_K}, u as (select 'manifest' as src, study from a union all select 'studies', study from b union all select 'review', study from c where study is not null) select n_sources, count(*) as n_studies from (select study, count(*) as n_sources from u group by 1) group by 1")
def set_union_ledger(t):
    u = None
    for d in _study_sets(t):
        d = d.distinct()
        u = d if u is None else u.unionByName(d)
    return u.groupBy("study").agg(F.count(F.lit(1)).alias("n_sources")).groupBy("n_sources").agg(F.count(F.lit(1)).alias("n_studies"))


@R.add(f"with {S} select study, ef, registered_at from (select *, row_number() over (partition by study order by registered_at desc, ef desc nulls last) as k from s where study is not null) where k = 1")
def latest_version(t):
    w = Window.partitionBy("study").orderBy(F.col("registered_at").desc(), F.col("ef").desc_nulls_last())
    return study_rows(t).where("study is not null").withColumn("k", F.row_number().over(w)).where("k = 1").select("study", "ef", "registered_at")


@R.add("select region.r_name, nation.n_name, count(*) as n, round(sum(c_acctbal), 2) as total, grouping(region.r_name, nation.n_name)::bigint as level from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (region.r_name, nation.n_name)")
def rollup_sites(t):
    j = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"), F.grouping_id().alias("level"))


# ---- splits ---------------------------------------------------------------------

_PATIENTS = f"{M}, k as (select distinct patient from m where patient is not null)"
_H = hash_int_sql("exact", "patient")


@R.add(f"""with {_PATIENTS}, r as (select patient, row_number() over (order by {_H}, patient) as rank, count(*) over () as n from k)
select patient, rank, case when rank <= round_even(n * 0.7, 0) then 'train' when rank <= round_even(n * 0.7, 0) + round_even(n * 0.1, 0) then 'val' else 'test' end as split from r""")
def split_exact(t):
    return splits.exact_split(manifest(t).select("patient").where("patient is not null").distinct(), "patient", "exact")


_HASHED = lambda seed: f"case when {hash_unit_sql(seed, 'patient')} < 0.7 then 'train' when {hash_unit_sql(seed, 'patient')} < 0.7 + 0.1 then 'val' else 'test' end"


@R.add(f"with {M} select row_id, {_HASHED('hashed')} as split from m where patient is not null")
def split_hash(t):
    return manifest(t).where("patient is not null").select("row_id", splits.hash_split(F.col("patient"), "hashed").alias("split"))


@R.add(f"""with {_PATIENTS}, old as (select patient, max(split) as split from m where patient is not null and split is not null and year < 2021 group by 1)
select k.patient, coalesce(old.split, {_HASHED('inherit').replace("'inherit', patient", "'inherit', k.patient")}) as split, case when old.split is null then 'hash' else 'inherited' end as origin
from k left join old on old.patient = k.patient""")
def split_inherited(t):
    m = manifest(t).where("patient is not null")
    old = m.where("split is not null and year < 2021").groupBy("patient").agg(F.max("split").alias("split"))
    return splits.inherited_split(m.select("patient").distinct(), "patient", old, "inherit")


@R.add(f"""with {M}, g as (select patient, max(ingested_at) as last_at, count(*) as n_rows from m where patient is not null group by 1),
c as (select *, (sum(n_rows) over (order by last_at, patient rows unbounded preceding))::bigint as upto, sum(n_rows) over () as n from g)
select patient, last_at, n_rows, upto, case when upto <= 0.7 * n then 'train' when upto <= 0.8 * n then 'val' else 'test' end as split from c""")
def split_temporal_volume(t):
    return splits.volume_split(manifest(t).where("patient is not null"), "patient", "ingested_at")


@R.add(f"""with {M}, e as (select patient, max((coalesce(year not in (2024, 2025), false))::int) as early from m where patient is not null and year is not null group by 1)
select row_id, case when year in (2024, 2025) and early = 0 then 'test_temporal' when year in (2024, 2025) then 'left_out' else {_HASHED('late')} end as split
from m join e using (patient) where year is not null""")
def split_temporal_holdout(t):
    m = manifest(t).where("patient is not null and year is not null").select("row_id", "patient", "year")
    return splits.temporal_holdout(m, "patient", F.col("year"), [2024, 2025], "late").select("row_id", "split")


@R.add(f"with {M} select coalesce(split, 'none') as split, count(*) as n_rows, count(distinct study) as n_studies, count(distinct patient) as n_patients, round(avg(label), 6) as mean_label, round(stddev_samp(label), 6) as sd_label, round(avg((label < 40)::int), 6) as share_low from m group by 1")
def split_report(t):
    return manifest(t).groupBy(F.coalesce("split", F.lit("none")).alias("split")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("study").alias("n_studies"), F.countDistinct("patient").alias("n_patients"), F.round(F.avg("label"), 6).alias("mean_label"),
        F.round(F.stddev_samp("label"), 6).alias("sd_label"), F.round(F.avg((F.col("label") < 40).cast("int")), 6).alias("share_low"),
    )


@R.add(f"with {M} select study from m where study is not null and status = 'success' group by study order by {hash_int_sql('pick', 'study')}, study limit 50")
def priority_cohort(t):
    ok = manifest(t).where("study is not null and status = 'success'").select("study").distinct()
    return ok.orderBy(hash_int("pick", F.col("study")), "study").limit(50)


QUERIES, SQL = R.queries, R.sql
