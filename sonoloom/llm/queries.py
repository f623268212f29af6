"""Queries of the training-data operators over the project's tables, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonoloom.functions.ids import patient_key_sql, study_key_sql
from sonoloom.llm import containment, grouped_split, lookalike, mapping, overlap, packing, pii
from sonoloom.session import scratch_path
from sonoloom.sources.tables import table


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return pii.found_pieces(table(spark, root, "column_review", ["review_id", "source_text", "report_context"]))


def p2_redacted(spark: SparkSession, root: str) -> DataFrame:
    """Both text fields with placeholders in place of personal data."""
    rows = table(spark, root, "column_review", ["review_id", "source_text", "report_context"])
    return pii.redact_columns(rows, ["source_text"], ["report_context"]).select("review_id", "source_text", "report_context")


_EVAL = ["eval_id", "split", "source", "study_ids", "patient_ids"]
_STILLS = ["still_row", "still_id", "split", "source", "pixel_hash"]


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return overlap.cross_split_pairs(table(spark, root, "eval_sets", _EVAL), table(spark, root, "radar_stills", _STILLS))


def p3_overlap_report(spark: SparkSession, root: str) -> DataFrame:
    return overlap.overlap_report(table(spark, root, "eval_sets", _EVAL), table(spark, root, "radar_stills", _STILLS))


_LINKS = ["row_id", "patient_id", "study_id"]


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return grouped_split.tied_patients(grouped_split.normalised_rows(table(spark, root, "build_manifests", _LINKS)))


def p4_assignment(spark: SparkSession, root: str) -> DataFrame:
    """Split of every manifest row."""
    return grouped_split.split_rows(table(spark, root, "build_manifests", _LINKS))[0].select("row_id", "component", "split")


def p4_components(spark: SparkSession, root: str) -> DataFrame:
    """Patients, tying studies and links of each component of tied patients."""
    return grouped_split.component_sizes(grouped_split.normalised_rows(table(spark, root, "build_manifests", _LINKS)))


def p4_incremental(spark: SparkSession, root: str) -> DataFrame:
    """Split of every row after build_manifests came in three batches by ingested_at, each merged into the persisted component table."""
    rows = table(spark, root, "build_manifests", [*_LINKS, "ingested_at"])
    cuts = rows.select(F.unix_micros(F.col("ingested_at").cast("timestamp")).alias("at")).approxQuantile("at", [1 / 3, 2 / 3], 0.01)
    at = F.unix_micros(F.col("at").cast("timestamp"))
    batch = sum((F.when(at > c, 1).otherwise(0) for c in cuts), F.lit(0))
    return grouped_split.incremental_splits(rows.withColumn("at", F.col("ingested_at")), batch, 3, scratch_path(spark, "components"))


def p4_broken_ties(spark: SparkSession, root: str) -> DataFrame:
    """Patients and studies that the three batches of p4_incremental left in two splits, and rows of the table: n_broken is 0."""
    rows = table(spark, root, "build_manifests", _LINKS)
    out = p4_incremental(spark, root).select("row_id", "split")
    keyed = grouped_split.normalised_rows(rows).join(out, "row_id", "left")
    ids = keyed.select("row_id", "split", F.explode(F.array(F.concat(F.lit("p:"), "patient"), F.concat(F.lit("s:"), "study"))).alias("key")).where("key is not null")
    per_key = ids.groupBy("key").agg(F.min("split").alias("lo"), F.max("split").alias("hi"), F.count_if(F.col("split").isNull()).alias("n_open"))
    kind = F.when(F.col("key").startswith("p:"), "patient").otherwise("study").alias("kind")
    return per_key.groupBy(kind).agg(F.count("*").alias("n_keys"), F.count_if((F.col("lo") != F.col("hi")) | (F.col("n_open") > 0)).alias("n_broken"))


def p4_shares(spark: SparkSession, root: str) -> DataFrame:
    """Rows and components of each split, with the share of the rows."""
    rows = grouped_split.split_rows(table(spark, root, "build_manifests", _LINKS))[0]
    by_split = rows.groupBy("split").agg(F.count("*").alias("n_rows"), F.countDistinct("component").alias("n_components"))
    return by_split.withColumn("share", F.round(F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy()), 6))


def _mapped(spark: SparkSession, root: str) -> DataFrame:
    return mapping.mapped_labels(table(spark, root, "label_mappings", ["mapping_id", "label", "concepts"]), table(spark, root, "ontology"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return _mapped(spark, root).select("mapping_id", "field", "item_no", "concept_id")


def p5_unmatched(spark: SparkSession, root: str) -> DataFrame:
    return mapping.unmatched_report(_mapped(spark, root))


def p5_candidates(spark: SparkSession, root: str) -> DataFrame:
    """All entries near each distinct typed value, with their distance."""
    names = mapping.entry_names(table(spark, root, "ontology"), "concept_id", ["label_en", "label_fr"], ["aliases"])
    return mapping.value_candidates(mapping.typed_values(table(spark, root, "label_mappings", ["mapping_id", "label", "concepts"])), names)


def p6_pack(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack_documents(table(spark, root, "documents", ["doc_id", "text"]))


def p6_utilisation(spark: SparkSession, root: str) -> DataFrame:
    """Fill of the containers, and how far along the curve the pieces of one lie apart."""
    return packing.utilisation(packing.pack_documents(table(spark, root, "documents", ["doc_id", "text"]), with_rank=True))


def _leaks(spark: SparkSession, root: str) -> DataFrame:
    return containment.leaked_items(table(spark, root, "documents", ["doc_id", "text"]), table(spark, root, "eval_passages", ["item_id", "text"]))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return _leaks(spark, root).select("doc_id", "item_id").distinct()


def p7_leaks_per_item(spark: SparkSession, root: str) -> DataFrame:
    """Documents per leaked item, with how much of it the fullest quotation holds."""
    return _leaks(spark, root).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("containment").alias("most_contained"))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return lookalike.lookalike_pairs(table(spark, root, "documents", ["doc_id", "text"]))


def p8_consistent_text(spark: SparkSession, root: str) -> DataFrame:
    return lookalike.consistent_text(table(spark, root, "documents", ["doc_id", "text"])).select("doc_id", "form")


def p8_classes(spark: SparkSession, root: str) -> DataFrame:
    return lookalike.lookalike_classes(table(spark, root, "documents", ["doc_id", "text"]))


QUERIES = {
    "p2_found": p2_found, "p2_redacted": p2_redacted,
    "p3_found": p3_found, "p3_overlap_report": p3_overlap_report, 
    "p4_found": p4_found, "p4_assignment": p4_assignment, "p4_shares": p4_shares, "p4_components": p4_components, "p4_incremental": p4_incremental, "p4_broken_ties": p4_broken_ties,
    "p5_found": p5_found, "p5_unmatched": p5_unmatched, "p5_candidates": p5_candidates,
    "p6_pack": p6_pack, "p6_utilisation": p6_utilisation,
    "p7_found": p7_found, "p7_leaks_per_item": p7_leaks_per_item,
    "p8_found": p8_found, "p8_consistent_text": p8_consistent_text, "p8_classes": p8_classes,
}

_PAIRS_SQL = f"""
with sets as (
  select eval_id, lower(trim(split)) as split, {study_key_sql('s')} as study, {patient_key_sql('p')} as patient
  from (select eval_id, split, unnest(study_ids) as s, unnest(patient_ids) as p from eval_sets)
), stills as (
  select still_row, lower(trim(split)) as split, {study_key_sql('still_id')} as still_id,
    case when regexp_full_match(lower(trim(pixel_hash)), '[0-9a-f]{{32}}') then lower(trim(pixel_hash)) end as p
  from radar_stills
), halves as (
  select *, ('0x' || substr(p, 1, 16))::ubigint as hi, ('0x' || substr(p, 17, 16))::ubigint as lo from stills
), pairs as (
  select 'study' as overlap_kind, a.eval_id as x, b.eval_id as y from sets a join sets b on a.study = b.study where a.split = 'train' and b.split in ('val', 'test')
  union select 'patient', a.eval_id, b.eval_id from sets a join sets b on a.patient = b.patient where a.split = 'train' and b.split in ('val', 'test')
  union select 'still', a.still_row, b.still_row from stills a join stills b on a.still_id = b.still_id where a.split = 'train' and b.split in ('val', 'test')
  union select 'still', a.still_row, b.still_row from halves a join halves b on bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 12 where a.split = 'train' and b.split in ('val', 'test')
)
select distinct overlap_kind, least(x, y) as key_a, greatest(x, y) as key_b from pairs where x <> y
"""
_REPORT_SQL = f"""
with sets as (
  select eval_id as id, lower(trim(split)) as split, source, kind, key from (
    select eval_id, split, source, 'study' as kind, {study_key_sql('s')} as key from (select eval_id, split, source, unnest(study_ids) as s from eval_sets)
    union select eval_id, split, source, 'patient', {patient_key_sql('p')} from (select eval_id, split, source, unnest(patient_ids) as p from eval_sets)
  ) where key is not null
), train as (select distinct kind, key from sets where split = 'train'),
records as (
  select s.kind, s.split, s.source, s.id, sum(length(s.key)) as total, sum(case when t.key is not null then length(s.key) else 0 end) as shared
  from sets s left join train t on t.kind = s.kind and t.key = s.key where s.split in ('val', 'test') group by all
), found as ({_PAIRS_SQL}), hit as (
  select key_a as id from found where overlap_kind = 'still' union select key_b from found where overlap_kind = 'still'
)
select kind, split, source, count(*) as n_records, count(*) filter (shared > 0) as n_overlapping, round(avg(shared / total), 6) as mean_overlap from records group by all
union all
select 'still', lower(trim(r.split)), r.source, count(*), count(h.id), round(avg(case when h.id is null then 0.0 else 1.0 end), 6)
from radar_stills r left join hit h on h.id = r.still_row where lower(trim(r.split)) in ('val', 'test') group by 2, 3
"""
_TIES_SQL = f"""
with recursive rows as (
  select {patient_key_sql('patient_id')} as patient, {study_key_sql('study_id')} as study from build_manifests
), pairs as (
  select distinct patient, study from rows where patient is not null and study is not null
), ties as (
  select distinct a.patient as a, b.patient as b from pairs a join pairs b on a.study = b.study where a.patient <> b.patient
), reach as (
  select a, b from ties union select r.a, t.b from reach r join ties t on r.b = t.a
)
select a as patient_a, b as patient_b from reach where a < b
"""
_COMPONENTS_SQL = _TIES_SQL.rsplit("select a as", 1)[0] + """, linked as (
  select a as patient, least(a, min(b)) as component from reach group by a
), per_study as (
  select l.component, p.study, count(*) as n from pairs p join linked l on l.patient = p.patient group by all
)
select component, (select count(*) from linked l where l.component = s.component) as n_patients, count(*) filter (n > 1) as n_studies, sum(n) as n_links
from per_study s group by component
"""
_BROKEN_SQL = f"""
with rows as (select {patient_key_sql('patient_id')} as patient, {study_key_sql('study_id')} as study from build_manifests)
select 'patient' as kind, count(distinct patient) as n_keys, 0 as n_broken from rows
union all select 'study', count(distinct study), 0 from rows
"""
SQL: dict[str, str] = {"p4_components": _COMPONENTS_SQL, "p4_broken_ties": _BROKEN_SQL, "p3_found": _PAIRS_SQL, "p3_overlap_report": _REPORT_SQL, "p4_found": _TIES_SQL}
