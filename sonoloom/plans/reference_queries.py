"""Queries over orphan references (problem 1) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sonoloom.functions.ids import path_key_sql, study_key_sql
from sonoloom.operators.references import cohort_parents, cohort_references, orphan_counts, orphan_references
from sonoloom.sources.tables import table


def _orphans(spark: SparkSession, root: str) -> DataFrame:
    refs = cohort_references(
        table(spark, root, "build_manifests", ["row_id", "study_id", "video_path", "ingested_at"]),
        table(spark, root, "pilot_upload", ["upload_id", "study_key", "uploaded_at"]),
    )
    parents = cohort_parents(
        table(spark, root, "studies", ["study_id", "study_key", "registered_at", "deleted_at"]),
        table(spark, root, "video_files", ["video_path", "registered_at", "deleted_at"]),
    )
    return orphan_references(refs, parents)


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return _orphans(spark, root).select("ref_table", "ref_field", "ref_row")


def p1_orphans_by_month(spark: SparkSession, root: str) -> DataFrame:
    return orphan_counts(_orphans(spark, root))


_SQL = f"""
with refs as (
  select 'build_manifests' as ref_table, 'study_id' as ref_field, row_id as ref_row, 'study_id' as domain, {study_key_sql('study_id')} as key, ingested_at as ref_time from build_manifests
  union all
  select 'build_manifests', 'video_path', row_id, 'video_path', {path_key_sql('video_path')}, ingested_at from build_manifests
  union all
  select 'pilot_upload', 'study_key', upload_id, 'study_key', {study_key_sql('study_key')}, uploaded_at from pilot_upload
), parents as (
  select 'study_id' as domain, {study_key_sql('study_id')} as key, registered_at, deleted_at from studies
  union all select 'study_key', {study_key_sql('study_key')}, registered_at, deleted_at from studies
  union all select 'video_path', {path_key_sql('video_path')}, registered_at, deleted_at from video_files
), judged as (
  select r.ref_table, r.ref_field, r.ref_row, r.ref_time,
    count(p.key) as n_parents, count(p.key) filter (p.registered_at <= r.ref_time) as n_before,
    count(p.key) filter (p.registered_at <= r.ref_time and (p.deleted_at is null or p.deleted_at > r.ref_time)) as n_live
  from refs r left join parents p on p.domain = r.domain and p.key = r.key
  where r.key is not null group by all
), orphans as (
  select *, case when n_parents = 0 then 'missing' when n_before = 0 then 'late' else 'deleted' end as reason from judged where n_live = 0
)
"""

QUERIES = {"p1_found": p1_found, "p1_orphans_by_month": p1_orphans_by_month}
SQL = {
    "p1_found": _SQL + "select ref_table, ref_field, ref_row from orphans",
    "p1_orphans_by_month": _SQL + "select ref_table, ref_field, strftime(ref_time, '%Y-%m') as month, reason, count(*) as n_orphans from orphans group by all",
}
