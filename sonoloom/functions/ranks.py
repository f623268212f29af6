"""Global ranks and running sums without a one-task window.

Rows are cut into buckets that follow the order, each bucket is ranked on its own, and
the totals of the buckets before it are added. Hash buckets are fixed in number and value buckets have BUCKET_ROWS
rows each, so the window over their totals has few rows beside the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_BUCKETS = 4096
BUCKET_ROWS = 50_000


def _offsets(df: DataFrame, total: Column, groups: list[str]) -> DataFrame:
    per = df.groupBy(*groups, "_bucket").agg(total.alias("_t"))
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return per.select(*groups, "_bucket", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys`` in which null meets null; the keys of ``left`` stay."""
    named = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    met = F.lit(True)
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(named, met).drop(*[f"_r_{k}" for k in keys])


def rank_by_hash(df: DataFrame, h: Column, tie: list[str], out: str = "rank", groups: tuple[str, ...] = ()) -> DataFrame:
    """1-based rank of rows in the order of a 32-bit hash, then ``tie``; within ``groups`` if given, where null is a group of its own."""
    g = list(groups)
    rows = df.withColumn("_h", h).withColumn("_bucket", F.shiftright("_h", 20))
    local = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*g, "_bucket").orderBy("_h", *tie)))
    return null_safe_join(local, _offsets(rows, F.count(F.lit(1)), g), [*g, "_bucket"]).withColumn(out, (F.col("_before") + F.col("_r")).cast("long")).drop("_h", "_bucket", "_before", "_r")


def value_bucket(df: DataFrame, value: str, buckets: int) -> Column:
    """Bucket number that grows with ``value``, cut at approximate quantiles; ``buckets`` - 1 numbers come to the driver.

    The cuts are searched in two steps, first among every root-th one, so a row costs about
    twice the root of their number.
    """
    cuts = sorted(set(df.approxQuantile(value, [k / buckets for k in range(1, buckets)], 1.0 / (4 * buckets))))
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    array = lambda xs: F.expr("array(" + ",".join(f"{float(c)!r}D" if abs(c) != float("inf") else f"double('{c}')" for c in xs) + ")")
    below = lambda xs: F.size(F.filter(xs, lambda c: c < F.col(value)))
    coarse = below(array(cuts[step - 1 :: step]))
    return coarse * step + below(F.slice(array(cuts), coarse * step + 1, step))


def running_sums(df: DataFrame, order: str, tie: list[str], sums: dict[str, str]) -> DataFrame:
    """For each ``out: value``: the sum over all rows up to and with this one, in the order of a number and ``tie``.

    One bucket for every BUCKET_ROWS rows.
    """
    buckets = df.count() // BUCKET_ROWS + 1
    rows = df.withColumn("_bucket", value_bucket(df, order, buckets) if buckets > 1 else F.lit(0))
    upto = Window.partitionBy("_bucket").orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.select("*", *[F.sum(v).over(upto).alias(out) for out, v in sums.items()])
    if buckets == 1:
        return local.drop("_bucket")
    per = rows.groupBy("_bucket").agg(*[F.sum(v).alias(f"_t_{out}") for out, v in sums.items()])
    before = Window.partitionBy().orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("_bucket", *[F.coalesce(F.sum(f"_t_{out}").over(before), F.lit(0)).alias(f"_b_{out}") for out in sums])
    joined = local.join(F.broadcast(offsets), "_bucket")
    return joined.select(*df.columns, *[(F.col(out) + F.col(f"_b_{out}")).alias(out) for out in sums])
