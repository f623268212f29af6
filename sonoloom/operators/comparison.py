"""Values of two sources set side by side: intervals from text, classes of agreement, worst of several, first available."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Signs and words of a bound before a number, and words that make a statement less than certain.
AT_LEAST, AT_MOST = (">=", "≥", "at least", "au moins"), ("<=", "≤", "at most", "au plus")
ABOVE, BELOW = (">", "above", "over", "plus de"), ("<", "below", "under", "moins de")
HEDGES = ("about", "around", "approximately", "estimated at", "environ", "estimée à", "probablement", "etwa", "aproximadamente")
NUMBER = r"[0-9]+(?:[.,][0-9]+)?"


def interval_pattern(names: str, unit: str) -> str:
    """Regular expression of a statement: name, hedge (1), bound (2), number (3), second number (4), unit. Works in Java and RE2."""
    alt = lambda words: "|".join(sorted(words, key=len, reverse=True))
    bounds = alt(AT_LEAST + AT_MOST + ABOVE + BELOW)
    return rf"(?i)(?:{names})(?: (?:of|is|de|à|at|:|between|entre))? ?({alt(HEDGES)})? ?({bounds})? ?({NUMBER})(?: ?(?:-|–|to|à|and|et|bis|y) ?({NUMBER}))? ?{unit}"


def intervals(text: Column, pattern: str, top: float) -> Column:
    """Array of (low, high, low_open, high_open, certain), one per statement; a bound on one side leaves the other at 0 or ``top``."""
    group = lambda k: F.regexp_extract_all(text, F.lit(pattern), F.lit(k))
    number = lambda x: F.replace(x, F.lit(","), F.lit(".")).try_cast("double")

    def one(s: Column) -> Column:
        bound, a, b = F.lower(s["bound"]), number(s["a"]), number(s["b"])
        under, over = bound.isin(*AT_MOST, *BELOW), bound.isin(*AT_LEAST, *ABOVE)
        high = F.coalesce(b, a)
        return F.struct(
            F.when(under, F.lit(0.0)).otherwise(F.least(a, high)).alias("low"), F.when(over, F.lit(float(top))).otherwise(F.greatest(a, high)).alias("high"),
            bound.isin(*ABOVE).alias("low_open"), bound.isin(*BELOW).alias("high_open"), (s["hedge"] == "").alias("certain"),
        )

    zipped = F.arrays_zip(group(1).alias("hedge"), group(2).alias("bound"), group(3).alias("a"), group(4).alias("b"))
    return F.transform(zipped, one)


def in_interval(value: Column, s: Column, tolerance: float = 0.0) -> Column:
    """Whether a value lies in an interval of :func:`intervals`, or within ``tolerance`` of it; open ends are outside it."""
    low_ok = (value > s["low"] - tolerance) | (~s["low_open"] & (value == s["low"] - tolerance))
    return low_ok & ((value < s["high"] + tolerance) | (~s["high_open"] & (value == s["high"] + tolerance)))


def reconcile(statements: Column, value: Column, tolerance: float) -> Column:
    """none, stated (text only), appended (value only), agree, or conflict if no statement allows the value."""
    empty = F.coalesce(F.size(statements), F.lit(0)) == 0
    return (
        F.when(empty & value.isNull(), "none").when(empty, "appended").when(value.isNull(), "stated")
        .when(F.exists(statements, lambda s: in_interval(value, s, tolerance)), "agree").otherwise("conflict")
    )


def limit_check(value: Column, low: float, high: float, grey: float) -> Column:
    """consistent inside [low, high], grey within ``grey`` outside it, else contradiction; null for no value."""
    return (
        F.when(value.isNull(), None).when(value.between(low, high), "consistent")
        .when(value.between(low - grey, high + grey), "grey").otherwise("contradiction")
    )


def grade_check(value: Column, stated: Column) -> Column:
    """consistent, off by one or contradiction: distance of a grade to the nearest of an array of stated grades; null without either."""
    d = F.array_min(F.transform(stated, lambda g: F.abs(g - value)))
    return F.when(d.isNull(), None).when(d < 1, "consistent").when(d == 1, "off by one").otherwise("contradiction")


def worst_of(statuses: list[Column], order: tuple[str, ...]) -> Column:
    """The status that comes first in ``order`` among several; null if all are null."""
    known = F.array_compact(F.array(*statuses))
    out = F.lit(None).cast("string")
    for s in reversed(order):
        out = F.when(F.array_contains(known, s), s).otherwise(out)
    return out


def first_available(sources: list[tuple[str, Column]]) -> Column:
    """Struct of the first value that is there and the name of its source; both null if none is."""
    name = F.lit(None).cast("string")
    for n, c in reversed(sources):
        name = F.when(c.isNotNull(), n).otherwise(name)
    return F.struct(F.coalesce(*[c for _, c in sources]).alias("value"), name.alias("source"))


def two_sources(a: Column, b: Column, silent_a: Column, silent_b: Column) -> Column:
    """agree, disagree, only_first, only_second or neither."""
    return (
        F.when(silent_a & silent_b, "neither").when(silent_a, "only_second").when(silent_b, "only_first")
        .when(a.eqNullSafe(b), "agree").otherwise("disagree")
    )


def scaled_in_range(value: Column, factor: float, low: float, high: float) -> Column:
    """``value * factor`` if that lies in [low, high], else null."""
    x = value * F.lit(float(factor))
    return F.when(x.between(low, high), x)


def text_grade(x: Column, words: dict[str, float], top: float) -> Column:
    """Grade of a free text: a word of ``words`` it holds, else a number in [0, ``top``]; dates and all else are null."""
    t = F.lower(F.trim(x))
    number = F.replace(F.regexp_extract(t, rf"^({NUMBER})", 1), F.lit(","), F.lit(".")).try_cast("double")
    out = F.when(t.rlike(r"^[0-9]{1,4}[-/][0-9]{1,2}[-/][0-9]{1,4}"), None).when(number.between(0, top), number)
    for word, grade in reversed(words.items()):
        out = F.when(F.contains(t, F.lit(word)), float(grade)).otherwise(out)
    return out


def override(df: DataFrame, column: str, keep_as: str, when: Column, value: Column) -> DataFrame:
    """``column`` replaced where ``when`` holds, its old content kept in ``keep_as``."""
    return df.withColumn(keep_as, F.col(column)).withColumn(column, F.when(F.coalesce(when, F.lit(False)), value).otherwise(F.col(column)))


def encoded(value: Column, codes: dict[str, int], other: str) -> Column:
    """Number of a category; unknown and missing ones get that of ``other``. Refuses codes that are not 0 .. n-1."""
    if sorted(codes.values()) != list(range(len(codes))):
        raise ValueError("codes must be 0 .. n-1 without gaps")
    pairs = F.create_map(*[x for k, v in codes.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(pairs, value), F.lit(codes[other]))


def robust_outliers(df: DataFrame, group: str, value: str, spread: float, least: int) -> DataFrame:
    """``df`` with left_out: value missing, or over ``spread`` median deviations from the median of its group (of at least ``least`` rows).

    Median and deviation come from a quantile sketch (relative error 1e-4), so no group is held in one task.
    """
    mid = df.groupBy(group).agg(F.percentile_approx(value, 0.5, 10_000).alias("_mid"), F.count(value).alias("_n"))
    near = df.join(mid, group, "left")
    dev = near.groupBy(group).agg(F.percentile_approx(F.abs(F.col(value) - F.col("_mid")), 0.5, 10_000).alias("_dev"))
    far = (F.col("_n") >= least) & (F.abs(F.col(value) - F.col("_mid")) > spread * F.col("_dev"))
    out = F.when(F.col(value).isNull(), "unreadable").when(far, "far_from_group")
    return near.join(dev, group, "left").withColumn("left_out", out).drop("_mid", "_n", "_dev")


def first_stratum(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    """Name of the first rule that holds; a rule without an answer does not hold."""
    out = F.lit(otherwise)
    for name, rule in reversed(rules):
        out = F.when(F.coalesce(rule, F.lit(False)), name).otherwise(out)
    return out


def most_common(df: DataFrame, column: str) -> DataFrame:
    """One row with the most common value of a column (the least of equally common ones), without a one-task sort of rows."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    return counts.orderBy(F.col("_n").desc(), column).limit(1).select(column)


def item_comparison(rows: DataFrame, items: DataFrame, key: str, item: str, values: str, low: str, high: str, grey: float) -> DataFrame:
    """One row per record and item of a short reference list that the record has a value for, with the check against the item's limits.

    ``values`` is a map item -> number, so nothing is multiplied out: the map is exploded
    and meets the list by an equi-join.
    """
    each = rows.select(key, F.explode(values).alias(item, "value"))
    met = each.join(items.select(item, low, high), item)
    inside = F.col("value").between(F.col(low), F.col(high))
    near = F.col("value").between(F.col(low) - grey, F.col(high) + grey)
    return met.withColumn("status", F.when(F.col("value").isNull(), None).when(inside, "consistent").when(near, "grey").otherwise("contradiction"))
