"""References to records that do not exist at the referring row's time.

References and parent records are brought together by key (one shuffle), sorted by
(key, time) and merged in one linear pass: while the pass moves through time it
carries the latest end of validity of the parents registered so far. A reference
whose time lies before that end is live.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonoloom.functions.ids import path_key, study_key
from sonoloom.functions.skew import copy_salts, hot_keys, spread_salt

FOREVER = "9999-12-31 23:59:59"
EVER = "0001-01-01 00:00:00"


def _ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


def orphan_references(refs: DataFrame, parents: DataFrame, support: float | None = None) -> DataFrame:
    """Orphans among ``refs`` with the reason.

    refs: ref_table, ref_field, ref_row, domain, key, at. parents: domain, key,
    registered_at, deleted_at. Result: ref_table, ref_field, ref_row, key, at, reason.

    Defined cases: a null key is no reference. ``missing``: no parent row has the key;
    ``late``: parents have it, all registered after the reference; ``deleted``: every
    parent registered by then was deleted at or before the reference. A null ``at`` can
    only be ``missing``; a null registered_at counts as registered always; repeated
    parent rows merge; repeated reference rows each come out; an empty parent table
    makes every reference missing; other columns are ignored.

    Keys that hold over ``support`` of the references are spread over salted merges,
    their parents copied to each.
    """
    refs = refs.select("ref_table", "ref_field", "ref_row", F.concat_ws("\u0001", "domain", "key").alias("key"), F.col("key").isNotNull().alias("named"), F.col("at").cast("timestamp_ntz").alias("at")).where("named").drop("named")
    parents = parents.where(F.col("key").isNotNull()).select(
        F.concat_ws("\u0001", "domain", "key").alias("key"),
        F.coalesce(F.col("registered_at").cast("timestamp_ntz"), _ts(EVER)).alias("at"),
        F.coalesce(F.col("deleted_at").cast("timestamp_ntz"), _ts(FOREVER)).alias("until"),
    )
    hot = hot_keys(refs, "key", support)
    left = refs.select("*", F.lit(None).cast("timestamp_ntz").alias("until"), F.lit(1).alias("side"), spread_salt(F.col("key"), hot, F.struct("ref_table", "ref_field", "ref_row")).alias("salt"))
    right = parents.select(*[F.lit(None).cast(t).alias(c) for c, t in refs.dtypes if c.startswith("ref_")], "key", "at", "until", F.lit(0).alias("side"), F.explode(copy_salts(F.col("key"), hot)).alias("salt"))
    group = Window.partitionBy("key", "salt").orderBy("at", "side")
    merged = (
        left.unionByName(right)
        .withColumn("live_until", F.max("until").over(group.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("known", F.min("side").over(group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) == 0)
    )
    reason = (
        F.when(~F.col("known"), "missing")
        .when(F.col("at").isNull(), None)
        .when(F.col("live_until").isNull(), "late")
        .when(F.col("live_until") <= F.col("at"), "deleted")
    )
    return (
        merged.where("side = 1").withColumn("reason", reason).where("reason is not null")
        .select("ref_table", "ref_field", "ref_row", F.element_at(F.split("key", "\u0001"), 2).alias("key"), "at", "reason")
    )


def cohort_references(manifests: DataFrame, uploads: DataFrame) -> DataFrame:
    """References of the project's tables, each table read once."""
    def ref(table: str, field: str, row: str, domain: str, key, at: str):
        return F.struct(F.lit(table).alias("ref_table"), F.lit(field).alias("ref_field"), F.col(row).cast("long").alias("ref_row"), F.lit(domain).alias("domain"), key.alias("key"), F.col(at).alias("at"))

    a = manifests.select(F.inline(F.array(
        ref("build_manifests", "study_id", "row_id", "study_id", study_key(F.col("study_id")), "ingested_at"),
        ref("build_manifests", "video_path", "row_id", "video_path", path_key(F.col("video_path")), "ingested_at"),
    )))
    b = uploads.select(F.inline(F.array(ref("pilot_upload", "study_key", "upload_id", "study_key", study_key(F.col("study_key")), "uploaded_at"))))
    return a.unionByName(b)


def cohort_parents(studies: DataFrame, videos: DataFrame) -> DataFrame:
    """Parent keys with their validity."""
    def key(domain: str, k):
        return F.struct(F.lit(domain).alias("domain"), k.alias("key"), F.col("registered_at"), F.col("deleted_at"))

    a = studies.select(F.inline(F.array(key("study_id", study_key(F.col("study_id"))), key("study_key", study_key(F.col("study_key"))))))
    b = videos.select(F.inline(F.array(key("video_path", path_key(F.col("video_path"))))))
    return a.unionByName(b)


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphans per table, field, month and reason; a null time is month ``unknown``."""
    month = F.coalesce(F.date_format("at", "yyyy-MM"), F.lit("unknown"))
    return orphans.groupBy("ref_table", "ref_field", month.alias("month"), "reason").agg(F.count("*").alias("n_orphans"))
