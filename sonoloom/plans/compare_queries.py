"""Comparison of sources, refusing joins, set predicates, nested differences, keyed digests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sonoloom.functions import keys
from sonoloom.functions.ids import patient_key, patient_key_sql, study_key, study_key_sql
from sonoloom.operators import comparison as C
from sonoloom.operators import relational
from sonoloom.plans.common import M, S, manifest, study_rows
from sonoloom.plans.registry import Registry

R = Registry()

# Names of the ejection fraction in the languages of the documents.
_NAMES = "ejection fraction|fraction d.éjection|auswurffraktion|fracci[oó]n de eyecci[oó]n"
_PATTERN = C.interval_pattern(_NAMES, "%")
_Q = _PATTERN.replace("'", "''")
_LIST = lambda words: ", ".join(f"'{w}'" for w in words)


def _intervals_sql(table: str, key: str, text: str, value: str = "null") -> str:
    """CTE ``iv`` with the statements of a text column, and a value ``v`` of the row."""
    groups = ", ".join(f"unnest(regexp_extract_all({text}, '{_Q}', {k})) as g{k}" for k in (1, 2, 3, 4))
    return f"""st as (select {key}, {value} as v, {groups} from {table}),
nm as (select *, lower(g2) as b, try_cast(replace(g3, ',', '.') as double) as x, try_cast(replace(nullif(g4, ''), ',', '.') as double) as y from st),
iv as (select {key}, v, case when b in ({_LIST(C.AT_MOST + C.BELOW)}) then 0.0 else least(x, coalesce(y, x)) end as low, case when b in ({_LIST(C.AT_LEAST + C.ABOVE)}) then 100.0 else greatest(x, coalesce(y, x)) end as high,
  b in ({_LIST(C.ABOVE)}) as low_open, b in ({_LIST(C.BELOW)}) as high_open, g1 = '' as certain from nm)"""


@R.add(f"with {_intervals_sql('documents', 'doc_id', 'text')} select doc_id, count(*) as n, round(min(low), 4) as low, round(max(high), 4) as high, count(*) filter (low_open or high_open) as n_open, count(*) filter (low < high) as n_ranges, count(*) filter (not certain) as n_hedged from iv group by 1")
def interval_facts(t):
    s = t.documents.select("doc_id", F.explode(C.intervals(F.col("text"), _PATTERN, 100.0)).alias("s")).select("doc_id", "s.*")
    return s.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min("low"), 4).alias("low"), F.round(F.max("high"), 4).alias("high"), F.count_if(F.col("low_open") | F.col("high_open")).alias("n_open"),
        F.count_if(F.col("low") < F.col("high")).alias("n_ranges"), F.count_if(~F.col("certain")).alias("n_hedged"),
    )


_EF_VALUE = """try_cast(coalesce(json_extract_string(report_context, '$."EF (%)"'), json_extract_string(report_context, '$."FE (%)"')) as double)"""


def _ef_value():
    m = F.from_json("report_context", "map<string,string>")
    return F.coalesce(F.try_element_at(m, F.lit("EF (%)")), F.try_element_at(m, F.lit("FE (%)"))).try_cast("double")


@R.add(f"""with {_intervals_sql('column_review', 'review_id', 'source_text', _EF_VALUE)},
j as (select review_id, count(*) as n, bool_or((v > low - 5 or (not low_open and v = low - 5)) and (v < high + 5 or (not high_open and v = high + 5))) as ok from iv group by 1),
c as (select case when j.n is null and {_EF_VALUE} is null then 'none' when j.n is null then 'appended' when {_EF_VALUE} is null then 'stated' when ok then 'agree' else 'conflict' end as outcome from column_review r left join j using (review_id))
select outcome, count(*) as n from c group by 1""")
def reconcile_interval(t):
    c = t.column_review.select(C.reconcile(C.intervals(F.col("source_text"), _PATTERN, 100.0), _ef_value(), 5.0).alias("outcome"))
    return c.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


# Fixed values of the example: item, limits.
_LIMITS = [("EF (%)", 52.0, 74.0), ("FE (%)", 52.0, 74.0), ("LA vol", 16.0, 68.0), ("OG vol", 16.0, 68.0)]


@R.add(f"""with l(item, low, high) as (values {', '.join(str(x) for x in _LIMITS)}),
e as (select review_id, item, low, high, try_cast(json_extract_string(report_context, '$."' || item || '"') as double) as v from column_review, l where list_contains(json_keys(report_context), item)),
c as (select item, case when v is null then null when v between low and high then 'consistent' when v between low - 4 and high + 4 then 'grey' else 'contradiction' end as status from e)
select item, status, count(*) as n from c group by all""")
def study_item_comparison(t):
    rows = t.column_review.select("review_id", F.transform_values(F.from_json("report_context", "map<string,string>"), lambda k, v: v.try_cast("double")).alias("m"))
    items = t.spark.createDataFrame(_LIMITS, "item string, low double, high double")
    return C.item_comparison(rows, items, "review_id", "item", "m", "low", "high", 4.0).groupBy("item", "status").agg(F.count(F.lit(1)).alias("n"))


@R.add(f"""with {S}, r as (select study_id, {study_key_sql('study_id')} as study, concept, source_text, {_EF_VALUE} as v from column_review),
g as (select r.*, x.ef from r left join (select study, max(ef) as ef from s where study is not null group by 1) x using (study)),
d as (select coalesce(v, ef) as value, case when v is not null then 'report' when ef is not null then 'table' end as source,
  case when v is null then null when v between 52 and 74 then 'consistent' when v between 48 and 78 then 'grey' else 'contradiction' end as a,
  case when ef is null then null when ef between 52 and 74 then 'consistent' when ef between 48 and 78 then 'grey' else 'contradiction' end as b from g)
select source, case when 'contradiction' in (a, b) then 'contradiction' when 'grey' in (a, b) then 'grey' when 'consistent' in (a, b) then 'consistent' end as worst,
  case when a is null and b is null then 'neither' when a is null then 'only_second' when b is null then 'only_first' when a = b then 'agree' else 'disagree' end as outcome, count(*) as n, round(avg(value), 4) as mean from d group by all""")
def worst_and_first_available(t):
    ef = study_rows(t).where("study is not null").groupBy("study").agg(F.max("ef").alias("ef"))
    g = t.column_review.select(study_key(F.col("study_id")).alias("study"), _ef_value().alias("v")).join(ef, "study", "left")
    got = g.select(
        C.first_available([("report", F.col("v")), ("table", F.col("ef"))]).alias("x"),
        C.limit_check(F.col("v"), 52.0, 74.0, 4.0).alias("a"), C.limit_check(F.col("ef"), 52.0, 74.0, 4.0).alias("b"),
    )
    a, b = F.col("a"), F.col("b")
    out = got.select("x.value", "x.source", C.worst_of([a, b], ("contradiction", "grey", "consistent")).alias("worst"), C.two_sources(a, b, a.isNull(), b.isNull()).alias("outcome"))
    return out.groupBy("source", "worst", "outcome").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@R.add("""with g as (select mapping_id, len(concepts) as v, [length(x) // 6 for x in concepts] as s from label_mappings),
d as (select list_min([abs(x - v) for x in s]) as d from g)
select case when d is null then null when d < 1 then 'consistent' when d = 1 then 'off by one' else 'contradiction' end as status, count(*) as n from d group by 1""")
def grade_compare(t):
    stated = F.transform("concepts", lambda x: F.floor(F.length(x) / 6))
    value = F.when(F.col("concepts").isNotNull(), F.size("concepts"))
    return t.label_mappings.select(C.grade_check(value, stated).alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@R.add("""with g as (select lower(trim(source_text)) as t, try_cast(replace(regexp_extract(lower(trim(source_text)), '^([0-9]+(?:[.,][0-9]+)?)', 1), ',', '.') as double) as x from column_review)
select case when contains(t, 'severe') or contains(t, 'sévère') then 4.0 when contains(t, 'trace') or contains(t, 'minim') then 0.5 when regexp_matches(t, '^[0-9]{1,4}[-/][0-9]{1,2}[-/][0-9]{1,4}') then null when x between 0 and 4 then x end as grade, count(*) as n from g group by 1""")
def text_grades(t):
    words = {"severe": 4.0, "sévère": 4.0, "trace": 0.5, "minim": 0.5}
    return t.column_review.select(C.text_grade(F.col("source_text"), words, 4.0).alias("grade")).groupBy("grade").agg(F.count(F.lit(1)).alias("n"))


@R.add("select case when fps * 2.54 between 60 and 200 then round(fps * 2.54, 4) end as scaled, count(*) as n from build_manifests group by 1")
def scaled_valid_range(t):
    return t.build_manifests.groupBy(F.round(C.scaled_in_range(F.col("fps"), 2.54, 60.0, 200.0), 4).alias("scaled")).agg(F.count(F.lit(1)).alias("n"))


@R.add("""with m as (select case when coalesce(avi_status <> 'valid' and n_frames > 0, false) then 'checked' else avi_status end as status, avi_status as header_status from build_manifests)
select header_status, status, count(*) as n from m group by all""")
def override_keeps_original(t):
    m = C.override(t.build_manifests.withColumnRenamed("avi_status", "status"), "status", "header_status", (F.col("status") != "valid") & (F.col("n_frames") > 0), F.lit("checked"))
    return m.groupBy("header_status", "status").agg(F.count(F.lit(1)).alias("n"))


_VIEWS = ("A2C", "A3C", "A4C", "PLAX", "PSAX", "OTHER")


@R.add(f"select case view_class {' '.join(f'when {v!r} then {k}' for k, v in enumerate(_VIEWS))} else {len(_VIEWS) - 1} end as view_id, count(*) as n from build_manifests group by 1")
def dictionary_encode(t):
    return t.build_manifests.groupBy(C.encoded(F.col("view_class"), {v: k for k, v in enumerate(_VIEWS)}, "OTHER").alias("view_id")).agg(F.count(F.lit(1)).alias("n"))


@R.add("""with mid as (select manufacturer, quantile_disc(img_cols, 0.5) as mid, count(img_cols) as n from radar_stills group by 1),
d as (select r.*, m.mid, m.n as size from radar_stills r left join mid m using (manufacturer)), v as (select manufacturer, quantile_disc(abs(img_cols - mid), 0.5) as dev from d group by 1)
select manufacturer, case when img_cols is null then 'unreadable' when size >= 20 and abs(img_cols - mid) > 3 * dev then 'far_from_group' end as left_out, count(*) as n from d left join v using (manufacturer) group by all""")
def robust_reference_filter(t):
    out = C.robust_outliers(t.radar_stills, "manufacturer", "img_cols", 3.0, 20)
    return out.groupBy("manufacturer", "left_out").agg(F.count(F.lit(1)).alias("n"))


@R.add("""with top as (select view_class from build_manifests where view_class is not null group by 1 order by count(*) desc, view_class limit 1)
select case when coalesce(n_frames < 20 and fps < 20, false) then 'frozen' when coalesce(view_class <> (from top), false) then 'other_view' when coalesce(label < 40, false) then 'low' else 'general' end as stratum, count(*) as n from build_manifests group by 1""")
def first_match_stratum(t):
    top = C.most_common(t.build_manifests, "view_class").first()
    rows = t.build_manifests.withColumn("top", F.lit(top[0] if top else None))
    rules = [("frozen", (F.col("n_frames") < 20) & (F.col("fps") < 20)), ("other_view", F.col("view_class") != F.col("top")), ("low", F.col("label") < 40)]
    return rows.groupBy(C.first_stratum(rules, "general").alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


@R.add("select coalesce(n_frames < 20, false) as short, coalesce(fps < 20, false) as slow, coalesce(label < 40, false) as low, count(*) as n from build_manifests group by all")
def multi_label_flags(t):
    yes = lambda c: F.coalesce(c, F.lit(False))
    return t.build_manifests.groupBy(yes(F.col("n_frames") < 20).alias("short"), yes(F.col("fps") < 20).alias("slow"), yes(F.col("label") < 40).alias("low")).agg(F.count(F.lit(1)).alias("n"))


# ---- joins that refuse, set predicates -------------------------------------------


@R.add(f"with {M}, p as (select study, count(*) as n_videos from m where study is not null group by 1), {S}, q as (select study, max(ef) as ef from s where study is not null group by 1) select study, n_videos, ef from p left join q using (study)")
def validated_left_join(t):
    a = manifest(t).where("study is not null").groupBy("study").agg(F.count(F.lit(1)).alias("n_videos"))
    b = study_rows(t).where("study is not null").groupBy("study").agg(F.max("ef").alias("ef"))
    return relational.validated_join(a, b, "study")


@R.add(f"with {M}, p as (select distinct study from m where study is not null), {S}, q as (select distinct study from s where study is not null) select case when p.study is null then 'right_only' when q.study is null then 'left_only' else 'both' end as side, count(*) as n from p full join q on p.study = q.study group by 1")
def indicator_counts(t):
    a = manifest(t).where("study is not null").select("study").distinct()
    b = study_rows(t).where("study is not null").select("study").distinct()
    return relational.indicator_join(a, b, "study").groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@R.add("""with a as (select distinct concept_id, w from (select concept_id, unnest(string_split(label_en, ' ')) as w from ontology)), b as (select distinct mapping_id, w from (select mapping_id, unnest(string_split(lower(trim(label)), ' ')) as w from label_mappings) where w <> '')
select mapping_id, concept_id, count(*) as n_shared from a join b using (w) group by all""")
def array_overlap(t):
    words = t.label_mappings.select("mapping_id", F.filter(F.split(F.lower(F.trim("label")), " "), lambda w: w != "").alias("words"))
    names = t.ontology.select("concept_id", F.split("label_en", " ").alias("names"))
    return relational.array_overlap_join(words, names, "mapping_id", "words", "concept_id", "names")


@R.add("""with g as (select study_id, list(distinct still_tag) filter (still_tag is not null) as tags from radar_stills where study_id is not null group by 1)
select coalesce(list_has_all(tags, ['MV_E_WAVE', 'TR_VMAX']), false) as supported, coalesce(list_has_any(tags, ['MV_E_WAVE', 'TR_VMAX']), false) as any_of, count(*) as n from g group by all""")
def tag_support(t):
    need = F.array(F.lit("MV_E_WAVE"), F.lit("TR_VMAX"))
    g = t.radar_stills.where("study_id is not null").groupBy("study_id").agg(F.collect_set("still_tag").alias("tags"))
    return g.groupBy(relational.holds_all(need, F.col("tags")).alias("supported"), F.arrays_overlap("tags", need).alias("any_of")).agg(F.count(F.lit(1)).alias("n"))


@R.add("""with e(view, structure) as (values ('A4C', 'left ventricle'), ('A4C', 'right ventricle'), ('PLAX', 'left ventricle'), ('PSAX', 'aortic valve')), c as (select concept_id, structure from ontology)
select r.review_id, e.view is not null as eligible from column_review r left join c on c.concept_id = r.concept left join e on e.view = r.view_class and e.structure = c.structure""")
def mapping_table_join(t):
    pairs = [("A4C", "left ventricle"), ("A4C", "right ventricle"), ("PLAX", "left ventricle"), ("PSAX", "aortic valve")]
    e = t.spark.createDataFrame(pairs, "view_class string, structure string").withColumn("hit", F.lit(True))
    c = t.ontology.select(F.col("concept_id").alias("concept"), "structure")
    return t.column_review.select("review_id", "concept", "view_class").join(c, "concept", "left").join(e, ["view_class", "structure"], "left").select("review_id", F.col("hit").isNotNull().alias("eligible"))


@R.add("select study_id, " + ", ".join(f"coalesce(bool_or(view_class = '{v}'), false) as {v}" for v in _VIEWS[:5]) + " from column_review group by 1")
def mapping_matrix(t):
    return relational.boolean_matrix(t.column_review, "study_id", "view_class", list(_VIEWS[:5]))


@R.add("""with x as (select review_id, report_context, reviewed_at, row_number() over (partition by study_id order by reviewed_at nulls first, review_id) as k, study_id from column_review where report_context is not null),
a as (select * from x where k = 1), b as (select * from x where k = 2),
fa as (select a.study_id as key, u.k as path, json_extract_string(a.report_context, '$."' || u.k || '"') as v from a, unnest(json_keys(a.report_context)) u(k)),
fb as (select b.study_id as key, u.k as path, json_extract_string(b.report_context, '$."' || u.k || '"') as v from b, unnest(json_keys(b.report_context)) u(k)),
kb as (select distinct key from fb), f as (select fa.* from fa join kb using (key))
select coalesce(f.path, fb.path) as path, count(*) as n from f full join fb on f.key = fb.key and f.path = fb.path where f.v is distinct from fb.v group by 1""")
def nested_map_diff(t):
    w = Window.partitionBy("study_id").orderBy(F.col("reviewed_at").asc_nulls_first(), "review_id")
    x = t.column_review.where("report_context is not null").select(F.col("study_id").alias("key"), "report_context", F.row_number().over(w).alias("k"))
    a, b = x.where("k = 1"), x.where("k = 2")
    d = relational.nested_diff(a.join(b.select("key"), "key", "left_semi"), b, "key", "report_context")
    return d.groupBy("path").agg(F.count(F.lit(1)).alias("n"))


# ---- keys ------------------------------------------------------------------------


@R.add(f"""with k as (select row_id, {patient_key_sql('patient_id')} as p, video_path as v from build_manifests)
select row_id, case when p is not null then {keys.hmac_sql("'row-key'", 'p')} end as person_key, case when v is not null then substr({keys.hmac_sql("'row-key'", 'v')}, 1, 16) end as clip_key from k""")
def hmac_keys(t):
    p = patient_key(F.col("patient_id"))
    return t.build_manifests.select("row_id", keys.hmac("row-key", p).alias("person_key"), F.substring(keys.hmac("row-key", F.col("video_path")), 1, 16).alias("clip_key"))


@R.add("select upload_id, regexp_replace(global_key, '^[a-z]+', 'test') as test_key from pilot_upload")
def key_reprefix(t):
    return t.pilot_upload.select("upload_id", keys.reprefixed(F.col("global_key"), "test").alias("test_key"))


@R.add("""select c_custkey, case when regexp_replace(upper(c_name), '[^A-Z]', '', 'g') <> '' and c_mktsegment <> '' then regexp_replace(upper(c_name), '[^A-Z]', '', 'g') || '|' || c_mktsegment end as entity from customer""")
def entity_keys(t):
    return t.customer.select("c_custkey", keys.entity_key(F.col("c_name"), F.col("c_mktsegment")).alias("entity"))


@R.add("select row_id, case when isnan(label) then null else label end as label, fps is null or isnan(fps) as no_fps from build_manifests")
def json_safe_rows(t):
    text = keys.json_row([F.col("row_id"), F.col("label"), F.col("fps")])
    back = t.build_manifests.select(F.from_json(text, "row_id long, label double, fps double").alias("x"))
    return back.select("x.row_id", "x.label", F.col("x.fps").isNull().alias("no_fps"))


QUERIES, SQL = R.queries, R.sql
