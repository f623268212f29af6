"""Views that several queries share, as plans and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoloom.functions.hashing import hash_unit, hash_unit_sql
from sonoloom.functions.ids import path_key, path_key_sql, patient_key, patient_key_sql, study_key, study_key_sql


def manifest(t) -> DataFrame:
    """build_manifests with comparison keys and cleaned categories."""
    return t.build_manifests.select(
        "row_id", patient_key(F.col("patient_id")).alias("patient"), study_key(F.col("study_id")).alias("study"), path_key(F.col("video_path")).alias("path"),
        F.upper(F.trim("exam_type")).alias("exam"), F.coalesce("view_class", F.lit("OTHER")).alias("view"), F.col("avi_status").alias("status"),
        F.substring("study_date", 1, 4).try_cast("int").alias("year"), "site", "split", "label", "n_frames", "fps", "ingested_at",
    )


M = f"""m as (
  select row_id, {patient_key_sql('patient_id')} as patient, {study_key_sql('study_id')} as study, {path_key_sql('video_path')} as path,
    upper(trim(exam_type)) as exam, coalesce(view_class, 'OTHER') as view, avi_status as status, try_cast(substr(study_date, 1, 4) as int) as year,
    site, split, label, n_frames, fps, ingested_at
  from build_manifests
)"""


def study_rows(t) -> DataFrame:
    """studies with comparison keys."""
    return t.studies.select(
        study_key(F.col("study_id")).alias("study"), patient_key(F.col("patient_id")).alias("patient"), F.upper(F.trim("exam_type")).alias("exam"),
        F.substring(F.regexp_replace("study_date", "[^0-9]", ""), 1, 8).alias("day"), "site", "ef", "registered_at", "deleted_at",
    )


S = f"""s as (
  select {study_key_sql('study_id')} as study, {patient_key_sql('patient_id')} as patient, upper(trim(exam_type)) as exam,
    substr(regexp_replace(study_date, '[^0-9]', '', 'g'), 1, 8) as day, site, ef, registered_at, deleted_at
  from studies
)"""


def predictions(t) -> DataFrame:
    """A stand-in model: the label with seeded noise, and a probability of a low label. row_id, study, site, view, split, y, p, low, prob."""
    m = manifest(t).where("label is not null and study is not null")
    u = hash_unit("model", F.col("row_id"))
    p = F.col("label") + (u - 0.5) * 30
    return m.select("row_id", "study", "patient", "site", "view", "split", F.col("label").alias("y"), F.round(p, 2).alias("p"), (F.col("label") < 40).alias("low"), F.round(1 / (1 + F.exp((p - 40) / 8)), 4).alias("prob"))


_U = hash_unit_sql("model", "row_id")
P = f"""{M}, p as (
  select row_id, study, patient, site, view, split, label as y, round(label + ({_U} - 0.5) * 30, 2) as p, label < 40 as low,
    round(1 / (1 + exp((label + ({_U} - 0.5) * 30 - 40) / 8)), 4) as prob
  from m where label is not null and study is not null
)"""
