"""Row pairs between the classes of a group, worked out on class representatives first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoloom.functions.skew import hot_keys, salted_join
from sonoloom.session import write_scratch


def expand_members(classes: DataFrame, members: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """Class pairs (a, b) to member pairs (id_a, id_b). members (of a) and others (of b): cls, id.

    Members of hot classes are spread over salted joins, so that no task holds all
    members of one class. The number of rows is that of the pairs asked for.
    """
    others = members if others is None else others
    hot = hot_keys(members, "cls")
    other_hot = hot if others is members else hot_keys(others, "cls")
    left = salted_join(members.select(F.col("cls").alias("a"), F.col("id").alias("id_a")), classes, "a", hot, F.col("id_a"))
    return salted_join(others.select(F.col("cls").alias("b"), F.col("id").alias("id_b")), left, "b", other_hot, F.col("id_b")).select("id_a", "id_b")


def pairs_across_classes(rows: DataFrame, group: str, cls: str, row_id: str, label: str) -> DataFrame:
    """id_a < id_b for rows of one ``group`` value and different ``cls`` values.

    Groups of one class are dropped before any pair is made. Rows of one class never
    meet each other: the join is over distinct classes, then expanded. Repeated ids
    are taken once.
    """
    rows = write_scratch(rows.select(F.col(group).alias("grp"), F.col(cls).alias("cls"), F.col(row_id).alias("id")), label)
    per_class = rows.select("grp", "cls").distinct()
    mixed = per_class.groupBy("grp").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi").select("grp")
    reps = write_scratch(per_class.join(mixed, "grp", "left_semi"), f"{label}-classes")
    a, b = reps.select("grp", F.col("cls").alias("a")), reps.select("grp", F.col("cls").alias("b"))
    classes = salted_join(a, b, "grp", hot_keys(reps, "grp"), F.col("a")).where("a < b").select("a", "b").distinct()
    members = rows.join(reps.select("cls").distinct(), "cls", "left_semi").select("cls", "id").distinct()
    both = expand_members(classes, members)
    return both.where("id_a <> id_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()
