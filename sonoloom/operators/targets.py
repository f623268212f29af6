"""Derived targets with three-valued logic, scalers and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def indicator(cond: Column, known: Column) -> Column:
    """1 if the condition holds, 0 if it is known not to, null if unknown."""
    return F.when(known, F.coalesce(cond, F.lit(False)).cast("double"))


def banded(value: Column, cuts: list[float]) -> Column:
    """0, 1, ... by increasing cut points (a value at a cut belongs above it); null stays null."""
    out = F.lit(float(len(cuts)))
    for k in range(len(cuts) - 1, -1, -1):
        out = F.when(value < cuts[k], float(k)).otherwise(out)
    return F.when(value.isNotNull(), out)


def finite(text: Column) -> Column:
    """Number of a text, null for anything that is no finite number."""
    x = text.try_cast("double")
    return F.when(F.abs(x) < float("inf"), x)


def any_of(flags: list[Column]) -> Column:
    """1 if any flag is 1, 0 if some are known and none is 1, null if none is known."""
    return F.greatest(*flags)


def unit_value(value: Column, unit: Column, factors: dict[str, float]) -> Column:
    """Value in the target unit by a fixed table of factors; null for an unknown unit."""
    table = F.create_map(*[x for k, v in factors.items() for x in (F.lit(k), F.lit(v))])
    return value * F.element_at(table, F.lower(F.trim(unit)))


def decimal_repair(df: DataFrame, value: str, low: float, high: float, gap: float = 0.3) -> DataFrame:
    """Out-of-range values moved by a power of ten if exactly one move lands in range, clearly nearest the median; else null.

    The median is that of the in-range values (one number on the driver).
    """
    inside = df.where(F.col(value).between(low, high))
    median = inside.agg(F.percentile(value, 0.5)).first()[0]
    x = F.col(value)
    if median is None:
        return df.withColumn("repaired", F.when(x.between(low, high), x)).withColumn("action", F.when(x.isNull(), "missing").when(x.between(low, high), "kept").otherwise("dropped"))
    moved = F.transform(F.array(*[F.lit(k) for k in range(-5, 6) if k]), lambda k: x * F.pow(F.lit(10.0), k))
    near = F.array_sort(F.transform(F.filter(moved, lambda v: (v >= low) & (v <= high)), lambda v: F.struct(F.abs(F.log10(v / F.lit(float(median)))).alias("d"), v.alias("v"))))
    clear = (F.size(near) == 1) | (F.get(near, F.lit(1))["d"] - F.get(near, F.lit(0))["d"] > gap)
    fixed = F.when(x.between(low, high), x).when((x > 0) & (F.size(near) > 0) & clear, F.get(near, F.lit(0))["v"])
    return df.withColumn("repaired", fixed).withColumn("action", F.when(x.isNull(), "missing").when(x.between(low, high), "kept").when(fixed.isNotNull(), "shifted").otherwise("dropped"))


def zscore(df: DataFrame, value: str, fit_on: Column) -> DataFrame:
    """z of ``value`` by the mean and population deviation of the rows to fit on; a zero deviation is refused."""
    m, s = df.where(fit_on).agg(F.avg(value), F.stddev_pop(value)).first()
    if not s:
        raise ValueError(f"{value} has no spread where it is fitted")
    return df.withColumn(f"{value}_z", (F.col(value) - F.lit(m)) / F.lit(s))


def log_zscore(df: DataFrame, value: str, fit_on: Column, floor: float = 1e-6) -> DataFrame:
    """As :func:`zscore` on the logarithm of positive values, with a flag that tells whether the value is present."""
    x = F.when(F.col(value) > 0, F.log(F.col(value)))
    m, s = df.where(fit_on).agg(F.avg(x), F.stddev_pop(x)).first()
    z = (x - F.lit(m)) / F.lit(max(s or 0.0, floor)) if m is not None else F.lit(None).cast("double")
    return df.withColumn(f"{value}_logz", z).withColumn(f"{value}_present", x.isNotNull())


def profile(df: DataFrame, columns: list[str], groups: list[str] = ()) -> DataFrame:
    """Per column (and group): known values, coverage, 5 / 50 / 95 % points, mean, population deviation."""
    long = df.unpivot(list(groups), columns, "target", "value")
    q = F.percentile("value", [0.05, 0.5, 0.95])
    return long.groupBy(*groups, "target").agg(
        F.count("value").alias("n"), (F.count("value") / F.count(F.lit(1))).alias("coverage"), q[0].alias("p5"), q[1].alias("median"), q[2].alias("p95"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")
    )
