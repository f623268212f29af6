"""Joins and key checks that refuse or drop ambiguity instead of choosing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_or_drop(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Distinct (key, columns) rows whose key is left exactly once; null keys are dropped."""
    rows = df.where(F.col(key).isNotNull()).select(key, *columns).distinct()
    once = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in columns])
    return once.where("_n = 1").drop("_n")


def drop_repeated(df: DataFrame, key: str) -> DataFrame:
    """Distinct rows, but rows without a key are never taken for repeats."""
    return df.where(F.col(key).isNull()).unionByName(df.where(F.col(key).isNotNull()).distinct())


def conflicting_keys(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys that occur with more than one combination of ``columns``, and how many."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(F.struct(*columns)).alias("n_versions")).where("n_versions > 1")


def null_conflicts(df: DataFrame, group: str, targets: list[str]) -> DataFrame:
    """One row per group: each target if all its known values agree, else null."""
    agree = lambda c: F.when(F.min(c) == F.max(c), F.max(c)).alias(c)
    return df.groupBy(group).agg(*[agree(c) for c in targets])


def same(a: Column, b: Column) -> Column:
    """Equality that is False when a side is missing."""
    return F.coalesce(a == b, F.lit(False))


def verified_link(left: DataFrame, right: DataFrame, key: str, checks: list[tuple[str, str]]) -> DataFrame:
    """Inner join on ``key`` of both sides' unique rows; ``verified`` says whether all checks agree."""
    ok = F.lit(True)
    for a, b in checks:
        ok = ok & same(F.col(a), F.col(b))
    return left.join(right, key).withColumn("verified", ok)


def full_diff(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keyed comparison of two snapshots: added, removed or changed rows."""
    a = before.select(key, F.struct(*columns).alias("_a"), F.lit(1).alias("_ia"))
    b = after.select(key, F.struct(*columns).alias("_b"), F.lit(1).alias("_ib"))
    kind = F.when(F.col("_ia").isNull(), "added").when(F.col("_ib").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, key, "full_outer").select(key, kind.alias("change")).where("change is not null")


def range_lookup(df: DataFrame, value: str, bins: list[tuple[str, float, float]], out: str) -> DataFrame:
    """Name of the half-open interval [low, high) that holds ``value``; null outside all. ``bins`` is a short fixed list."""
    pick = F.lit(None).cast("string")
    for name, low, high in reversed(bins):
        pick = F.when((F.col(value) >= low) & (F.col(value) < high), name).otherwise(pick)
    return df.withColumn(out, pick)


def overlapping_intervals(df: DataFrame, group: list[str], row_id: str, low: str, high: str) -> DataFrame:
    """Rows of a group whose interval [low, high) meets an earlier one's, by one ordered pass (no pairs).

    ``n_open`` counts the rows that started before and had not ended.
    """
    starts = df.select(*group, F.col(row_id).alias("_id"), F.col(low).alias("_at"), F.lit(1).alias("_d"), F.lit(2).alias("_o"))
    ends = df.select(*group, F.col(row_id).alias("_id"), F.col(high).alias("_at"), F.lit(-1).alias("_d"), F.lit(1).alias("_o"))
    w = Window.partitionBy(*group).orderBy("_at", "_o", "_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = starts.unionByName(ends).where("_at is not null").withColumn("_n", F.sum("_d").over(w))
    return swept.where("_d = 1").select(*group, F.col("_id").alias(row_id), (F.col("_n") - 1).alias("n_open")).where("n_open > 0")


def in_two_splits(df: DataFrame, key: str, split: str) -> DataFrame:
    """Keys found in more than one split."""
    n = F.countDistinct(split)
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(n.alias("n_splits"), F.array_join(F.array_sort(F.collect_set(split)), "+").alias("splits")).where("n_splits > 1")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str, out: str, cell: int = 86_400) -> DataFrame:
    """Latest ``value`` of ``right`` at or before each left row's time; null values are passed over.

    Time is cut into cells of ``cell`` seconds, so a key of any size is spread over its cells:
    each cell is one ordered pass over its own rows, and the last value of the cells before
    is carried in from a table with one row per key and cell.
    """
    second = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (1_000_000 * cell)).cast("long")
    kind = right.schema[value].dataType
    a = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(kind))
    b = right.select(key, at, F.col(value).alias("_v")).withColumn("_side", F.lit(0))
    for c in left.columns:
        if c not in (key, at):
            b = b.withColumn(c, F.lit(None).cast(left.schema[c].dataType))
    both = a.unionByName(b.select(*a.columns)).withColumn("_cell", second(at))
    known = F.when(F.col("_v").isNotNull(), F.col(at))
    last = both.groupBy(key, "_cell").agg(F.max_by("_v", known).alias("_last"))
    before = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(F.col(key).alias("_k"), F.col("_cell").alias("_c"), F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    w = Window.partitionBy(key, "_cell").orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = both.withColumn("_in", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    met = inside.join(carried, F.col(key).eqNullSafe(F.col("_k")) & F.col("_cell").eqNullSafe(F.col("_c")), "left")
    return met.select(*left.columns, F.coalesce("_in", "_carried").alias(out))


def rolling_range(df: DataFrame, group: str, us: str, width: int, aggregates: dict[str, Column], cell: int | None = None) -> DataFrame:
    """``df`` with aggregates over the rows of its group in the ``width`` microseconds up to and with each row.

    Time is cut into cells of ``cell`` (six widths); the rows of the last ``width`` of a cell
    are copied into the next one as context, so a window never needs more than one cell
    and a group of any size is spread over its cells. ``aggregates`` maps new columns to aggregates.
    """
    cell = cell or 6 * width
    own = F.floor(F.col(us) / cell)
    late = F.col(us) - own * cell >= cell - width
    copies = F.when(late, F.array(F.struct(own.alias("cell"), F.lit(True).alias("own")), F.struct((own + 1).alias("cell"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(own.alias("cell"), F.lit(True).alias("own"))))
    spread = df.withColumn("_c", F.explode(copies))
    w = Window.partitionBy(group, F.col("_c.cell")).orderBy(us).rangeBetween(-width, 0)
    return spread.select(*df.columns, "_c", *[a.over(w).alias(name) for name, a in aggregates.items()]).where("_c.own").drop("_c")


def validated_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", one: str = "1:1", complete: bool = False) -> DataFrame:
    """Join that refuses repeated keys: ``1:1`` on both sides, ``m:1`` on the right, ``1:m`` on the left.

    With ``complete`` a left row without a partner is refused too. Null keys meet nothing and
    are no repeats. The checks are counts of keys; nothing else goes to the driver.
    """
    left_one, right_one = {"1:1": (True, True), "m:1": (False, True), "1:m": (True, False)}[one]
    for name, df, asked in (("left", left, left_one), ("right", right, right_one)):
        if asked and (n := df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").count()):
            raise ValueError(f"{n} keys of {key} are repeated on the {name} side")
    if complete and (n := left.join(right.select(key).where(F.col(key).isNotNull()), key, "left_anti").count()):
        raise ValueError(f"{n} rows on the left have no partner by {key}")
    return left.join(right, key, how)


def indicator_join(left: DataFrame, right: DataFrame, key: str, out: str = "side") -> DataFrame:
    """Full outer join with ``out``: both, left_only or right_only."""
    a, b = left.withColumn("_l", F.lit(1)), right.withColumn("_r", F.lit(1))
    side = F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), "both").when(F.col("_l").isNotNull(), "left_only").otherwise("right_only")
    return a.join(b, key, "full_outer").withColumn(out, side).drop("_l", "_r")


def array_overlap_join(left: DataFrame, right: DataFrame, left_id: str, left_items: str, right_id: str, right_items: str) -> DataFrame:
    """left_id, right_id, n_shared: rows whose arrays share an item, by an equi-join of the exploded items."""
    a = left.select(left_id, F.explode(F.array_distinct(left_items)).alias("_item"))
    b = right.select(right_id, F.explode(F.array_distinct(right_items)).alias("_item"))
    return a.join(b, "_item").groupBy(left_id, right_id).agg(F.count(F.lit(1)).alias("n_shared"))


def holds_all(needed: Column, have: Column) -> Column:
    """Whether every needed item is there; an empty need always is."""
    return F.size(F.array_except(needed, F.coalesce(have, F.array().cast("array<string>")))) == 0


def boolean_matrix(df: DataFrame, row: str, column: str, names: list[str]) -> DataFrame:
    """One row per ``row`` and one boolean per name: whether the pair occurs."""
    return df.groupBy(row).agg(*[F.coalesce(F.bool_or(F.col(column) == n), F.lit(False)).alias(n) for n in names])


def flat_leaves(df: DataFrame, key: str, document: str) -> DataFrame:
    """key, path, leaf of every scalar in a JSON text, objects to any depth; arrays count as leaves, as do texts that are no object.

    Levels are opened one after the other until none is left; a level is one map-only step.
    """
    level = df.select(key, F.lit("").alias("path"), F.col(document).alias("leaf"))
    done = None
    is_object = F.col("leaf").isNotNull() & F.ltrim("leaf").startswith("{")
    while not level.where(is_object).isEmpty():
        flat = level.where(~is_object | F.col("leaf").isNull())
        done = flat if done is None else done.unionByName(flat)
        opened = level.where(is_object).select(key, "path", F.explode(F.from_json("leaf", "map<string,string>")).alias("k", "leaf"))
        level = opened.select(key, F.concat_ws(".", F.when(F.col("path") != "", F.col("path")), F.col("k")).alias("path"), "leaf")
    return level if done is None else done.unionByName(level)


def nested_diff(before: DataFrame, after: DataFrame, key: str, document: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """key, path, before, after of the leaves that differ between two versions of a JSON text; null stands for missing."""
    a = flat_leaves(before, key, document).withColumnRenamed("leaf", "before")
    b = flat_leaves(after, key, document).withColumnRenamed("leaf", "after")
    return a.join(b, [key, "path"], "full_outer").where(~F.col("before").eqNullSafe(F.col("after")) & ~F.col("path").isin(*ignore))
