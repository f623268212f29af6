"""Selections, policies, samples, collation and report records over the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonoloom.functions.hashing import hash_int, hash_int_sql
from sonoloom.functions.ids import path_key, path_key_sql
from sonoloom.functions.ranks import rank_by_hash
from sonoloom.operators import pipeline
from sonoloom.operators.clauses import fold
from sonoloom.operators.textops import CLAUSE_END, clauses
from sonoloom.plans.common import M, manifest
from sonoloom.plans.registry import Registry

R = Registry()


@R.add(f"""with {M}, s as (select site, case when not coalesce(status = 'success', false) then 'status' when not coalesce(n_frames >= 20, false) then 'short' when not coalesce(label between 5 and 90, false) then 'label' when not coalesce(study is not null, false) then 'study' end as reason from m)
select site, reason, reason is null as kept, count(*) as n from s group by all""")
def exhaustive_selection(t):
    steps = [("status", F.col("status") == "success"), ("short", F.col("n_frames") >= 20), ("label", F.col("label").between(5, 90)), ("study", F.col("study").isNotNull())]
    return pipeline.exhaustive_selection(manifest(t), steps).groupBy("site", "reason", "kept").agg(F.count(F.lit(1)).alias("n"))


@R.add(f"""with {M}, r as (select site, label < 40 as truth, unnest(['strict', 'loose', 'either']) as policy, unnest([n_frames < 20 and fps < 20, n_frames < 40, n_frames < 20 or fps < 20]) as flag from m where label is not null)
select policy, site, count(*) as n, count(*) filter (coalesce(flag, false)) as n_flagged, count(*) filter (coalesce(flag, false) = truth) as n_right from r group by all""")
def policy_comparison(t):
    short, slow = F.col("n_frames") < 20, F.col("fps") < 20
    rules = {"strict": short & slow, "loose": F.col("n_frames") < 40, "either": short | slow}
    return pipeline.compared_policies(manifest(t).where("label is not null"), rules, F.col("label") < 40, ["site"])


@R.add(f"""with k as (select distinct {path_key_sql('video_path')} as path from build_manifests), d as (select path from k where path is not null order by {hash_int_sql('exists', 'path')}, path limit 500),
v as (select distinct {path_key_sql('video_path')} as path from video_files) select count(*) as n_checked, count(v.path) as n_found from d left join v on v.path = d.path""")
def existence_sample(t):
    return pipeline.existing_share(manifest(t), t.video_files.select(path_key(F.col("video_path")).alias("path")), "path", 500, "exists")


@R.add(f"""with r as (select row_id, round(label) as b, row_number() over (partition by round(label) order by {hash_int_sql('per-value', 'row_id')}, row_id) as k from build_manifests where label is not null) select b as value_bin, count(*) as n, min(row_id) as least from r where k <= 3 group by 1""")
def draws_per_value(t):
    d = pipeline.draws_per_value(t.build_manifests.select("row_id", "label"), F.col("label"), "row_id", 3, "per-value")
    return d.groupBy("value_bin").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("least"))


@R.add(f"""with r as (select still_row, manufacturer, row_number() over (partition by manufacturer order by {hash_int_sql('vendor', 'still_row')}, still_row) as k from radar_stills where split = 'train' and pixel_hash is not null and spec_x0 is not null) select still_row, manufacturer from r where k <= 25""")
def vendor_sample(t):
    clean = t.radar_stills.where("split = 'train' and pixel_hash is not null and spec_x0 is not null").select("still_row", "manufacturer")
    return rank_by_hash(clean, hash_int("vendor", F.col("still_row")), ["still_row"], "k", ("manufacturer",)).where("k <= 25").select("still_row", "manufacturer")


@R.add(f"""with r as (select eval_id, coalesce(study_ids, []) as v, (row_number() over (order by {hash_int_sql('collate', 'eval_id')}, eval_id) - 1) // 16 as batch from eval_sets)
select batch, count(*) as n, max(len(v)) as longest, (count(*) * max(len(v)) - sum(len(v)))::bigint as n_padding from r group by batch""")
def collate_batches(t):
    c = pipeline.collated(t.eval_sets, "eval_id", "study_ids", 16, "collate")
    absent = F.aggregate("present", F.lit(0).cast("long"), lambda a, p: a + F.size(F.filter(p, lambda x: ~x)))
    return c.select("batch", F.size("keys").cast("long").alias("n"), F.size(F.get("padded", F.lit(0))).cast("long").alias("longest"), absent.alias("n_padding"))


@R.add("""select still_type, manufacturer, count(*) as n, count(*) filter (img_cols >= 1000) as n_wide, count(*) filter (spec_x0 is null) as n_unmarked, count(*) filter (pixel_hash is null) as n_no_print from radar_stills group by all""")
def variant_detections(t):
    return t.radar_stills.groupBy("still_type", "manufacturer").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("img_cols") >= 1000).alias("n_wide"), F.count_if(F.col("spec_x0").isNull()).alias("n_unmarked"), F.count_if(F.col("pixel_hash").isNull()).alias("n_no_print")
    )


@R.add("""with a as (select lower(unnest(list_append(aliases, label_en))) as alias, concept_id, structure from ontology) select alias, count(distinct concept_id) as n_concepts, min(concept_id) as first, string_agg(distinct structure, '+' order by structure) as structures from a group by 1""")
def spec_inversion(t):
    a = t.ontology.select(F.explode(F.transform(F.array_append("aliases", F.col("label_en")), F.lower)).alias("alias"), "concept_id", "structure")
    return a.groupBy("alias").agg(F.countDistinct("concept_id").alias("n_concepts"), F.min("concept_id").alias("first"), F.array_join(F.array_sort(F.collect_set("structure")), "+").alias("structures"))


@R.add("""select still_type, case when spec_x0 is null or spec_x1 is null or spec_y0 is null or spec_y1 is null then 'missing' when spec_x0 >= spec_x1 or spec_y0 >= spec_y1 then 'empty' when spec_x0 < 0 or spec_x1 > img_cols or spec_y0 < 0 or spec_y1 > img_rows then 'outside' else 'valid' end as state, count(*) as n from radar_stills group by all""")
def interval_validation(t):
    x0, x1, y0, y1 = (F.col(f"spec_{c}") for c in ("x0", "x1", "y0", "y1"))
    state = (
        F.when(x0.isNull() | x1.isNull() | y0.isNull() | y1.isNull(), "missing").when((x0 >= x1) | (y0 >= y1), "empty")
        .when((x0 < 0) | (x1 > F.col("img_cols")) | (y0 < 0) | (y1 > F.col("img_rows")), "outside").otherwise("valid")
    )
    return t.radar_stills.groupBy("still_type", state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


_HEDGE, _NEGATED, _BOUND = "probabl|environ|approx|difficult|difficile", "absence|absent|sans |pas de|without", "[<>±]|au moins|at least"


@R.add(f"""with c as (select unnest([trim(x) for x in string_split_regex(source_text, '{CLAUSE_END}') if trim(x) <> '']) as c from column_review), f as (select lower(strip_accents(c)) as c from c)
select regexp_matches(c, '{_HEDGE}') as hedged, regexp_matches(c, '{_NEGATED}') as negated, regexp_matches(c, '{_BOUND}') as bounded, count(*) as n from f group by all""")
def qualifier_flags(t):
    c = t.column_review.select(F.explode(clauses(F.col("source_text"))).alias("c")).select(fold(F.col("c")).alias("c"))
    hit = lambda p: F.col("c").rlike(p)
    return c.groupBy(hit(_HEDGE).alias("hedged"), hit(_NEGATED).alias("negated"), hit(_BOUND).alias("bounded")).agg(F.count(F.lit(1)).alias("n"))


@R.add("""with p as (select study_id, bool_or(view_class = 'A4C' and try_cast(source_text as double) is not null) as part, bool_or(try_cast(source_text as double) is not null) as whole, count(*) filter (view_class = 'A4C') as n_part from column_review group by 1)
select study_id, case when n_part > 0 and part then 'coded' when n_part > 0 then 'text' when whole then 'coded elsewhere' else 'silent' end as status from p""")
def part_whole_fallback(t):
    coded = F.col("source_text").try_cast("double").isNotNull()
    p = t.column_review.groupBy("study_id").agg(F.bool_or((F.col("view_class") == "A4C") & coded).alias("part"), F.bool_or(coded).alias("whole"), F.count_if(F.col("view_class") == "A4C").alias("n_part"))
    own = F.when((F.col("n_part") > 0) & F.col("part"), "coded").when(F.col("n_part") > 0, "text")
    return p.select("study_id", F.coalesce(own, F.when(F.col("whole"), "coded elsewhere"), F.lit("silent")).alias("status"))


@R.add("""with s as (select study_id, list_sort(list(distinct still_tag) filter (still_tag is not null)) as tags, bool_or(split = 'train') as has_train from radar_stills where study_id is not null group by 1)
select study_id, case when len(coalesce(tags, [])) = 0 then 'none' when has_train then 'full' else 'held' end as scope, coalesce(array_to_string([x for x in tags if x in ('MV_E_WAVE', 'TR_VMAX', 'PV_ACCT')], '+'), '') as supported from s""")
def scope_choice(t):
    s = t.radar_stills.where("study_id is not null").groupBy("study_id").agg(F.array_sort(F.collect_set("still_tag")).alias("tags"), F.bool_or(F.col("split") == "train").alias("has_train"))
    scope = F.when(F.size("tags") == 0, "none").when(F.col("has_train"), "full").otherwise("held")
    return s.select("study_id", scope.alias("scope"), F.array_join(F.filter("tags", lambda x: x.isin("MV_E_WAVE", "TR_VMAX", "PV_ACCT")), "+").alias("supported"))


@R.add(f"with {M} select split, round(avg(label), 6) as label, round(avg(n_frames), 6) as n_frames, round(avg(fps), 6) as fps, count(label) as n_label, count(fps) as n_fps from m group by 1")
def per_task_means(t):
    return manifest(t).groupBy("split").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("label", "n_frames", "fps")], F.count("label").alias("n_label"), F.count("fps").alias("n_fps"))


@R.add("select row_id, coalesce(lower(video_path) like '%/v%' and not contains(lower(video_path), 'anon'), false) as legacy from build_manifests")
def path_exceptions(t):
    p = F.lower("video_path")
    return t.build_manifests.select("row_id", F.coalesce(p.like("%/v%") & ~F.contains(p, F.lit("anon")), F.lit(False)).alias("legacy"))


@R.add("""with j as (select concept, origin, count(*) as n, count(distinct source_text) as n_texts from column_review group by all), w as (select concept, sum(n) as total from j group by 1)
select j.concept, origin, n, n_texts, round(n / total, 6) as share, n = max(n) over (partition by j.concept) as most from j join w using (concept)""")
def distinct_text_audit(t):
    j = t.column_review.groupBy("concept", "origin").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source_text").alias("n_texts"))
    w = j.groupBy("concept").agg(F.sum("n").alias("total"), F.max("n").alias("top"))
    return j.join(w, "concept").select("concept", "origin", "n", "n_texts", F.round(F.col("n") / F.col("total"), 6).alias("share"), (F.col("n") == F.col("top")).alias("most"))


@R.add("""with c as (select review_id, concept, origin, row_number() over (partition by concept, origin order by review_id) as k from column_review) select to_json({'review': review_id, 'concept': concept, 'origin': origin}) as record from c where k = 1""")
def report_records(t):
    first = t.column_review.groupBy("concept", "origin").agg(F.min("review_id").alias("review_id"))
    return first.select(F.to_json(F.struct(F.col("review_id").alias("review"), "concept", "origin"), {"ignoreNullFields": "false"}).alias("record"))


@R.add(f"""with o as (select mapping_id, relation, case relation when 'exact' then 'supported' when 'unmapped' then 'rejected' when 'related' then 'corrected' else 'pending' end as verdict from label_mappings)
select coalesce(relation, 'none') as relation, verdict, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from o group by all""")
def review_scoring(t):
    verdict = F.when(F.col("relation") == "exact", "supported").when(F.col("relation") == "unmapped", "rejected").when(F.col("relation") == "related", "corrected").otherwise("pending")
    g = t.label_mappings.groupBy(F.coalesce("relation", F.lit("none")).alias("relation"), verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))
    total = t.label_mappings.count()
    return g.withColumn("share", F.round(F.col("n") / F.lit(max(total, 1)), 6))


QUERIES, SQL = R.queries, R.sql
