"""Hot keys: find them in one pass without a shuffle of the rows, and spread them by a salt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUPPORT = 1e-3
LEAST_SUPPORT = 1e-4
SALTS_PER_PARTITION = 2


def hot_keys(df: DataFrame, key: str, support: float | None = None) -> dict[str | int, int]:
    """Every key that holds more than ``support`` of the rows, with the number of salts it is spread over.

    One scan with a map-side frequent-items sketch that counts. ``support`` is a mean
    shuffle partition, within LEAST_SUPPORT and SUPPORT, so the answer has at most 10,000
    keys at any input size; it goes to the driver once so that all users of the list see the
    same keys even if tasks run again. The salts follow the key's count: each holds at most
    1 / SALTS_PER_PARTITION of a mean shuffle partition (rounded up to a power of two).
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if support is None:
        support = max(LEAST_SUPPORT, min(SUPPORT, 1.0 / partitions))
    most = min(10_000, int(1 / support) + 1)
    k = F.col(key) if dict(df.select(key).dtypes)[key] in ("string", "int", "bigint") else F.col(key).cast("string")
    got = df.select(k.alias("k")).agg(F.count("k").alias("n"), F.expr(f"approx_top_k(k, {most}, {10 * most})").alias("top")).first()
    hot = {}
    for item in got["top"] or []:
        if item["item"] is not None and item["count"] > support * got["n"]:
            need = SALTS_PER_PARTITION * partitions * item["count"] / got["n"]
            hot[item["item"]] = max(2, 1 << (max(1, int(need)) - 1).bit_length())
    return hot


def is_hot(key: Column, hot: dict) -> Column:
    return _as(key, hot).isin(sorted(hot)) if hot else F.lit(False)


def _as(key: Column, hot: dict) -> Column:
    """The key as the sketch saw it: whole numbers and texts as they are, anything else as text."""
    return key.cast("string") if isinstance(next(iter(hot)), str) else key


def salts(key: Column, hot: dict) -> Column:
    """Number of salts of a key; 1 for usual ones."""
    out = F.lit(1)
    for fanout in sorted(set(hot.values())):
        out = F.when(_as(key, hot).isin(sorted(k for k, f in hot.items() if f == fanout)), F.lit(fanout)).otherwise(out)
    return out


def spread_salt(key: Column, hot: dict, by: Column) -> Column:
    """Salt of the large side: 0 for usual keys, a hash of ``by`` modulo the key's salts for hot ones."""
    return F.when(is_hot(key, hot), F.pmod(F.xxhash64(by), salts(key, hot)).cast("int")).otherwise(F.lit(0)) if hot else F.lit(0)


def copy_salts(key: Column, hot: dict) -> Column:
    """Array of the salts that the other side needs a copy for."""
    return F.when(is_hot(key, hot), F.sequence(F.lit(0), salts(key, hot) - 1)).otherwise(F.array(F.lit(0))) if hot else F.array(F.lit(0))


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: dict, by: Column, how: str = "inner") -> DataFrame:
    """Equi-join on ``key`` in which ``left`` may hold hot keys; ``by`` tells its rows apart. Without hot keys a plain join."""
    if not hot:
        return left.join(right, key, how)
    a = left.withColumn("_salt", spread_salt(F.col(key), hot, by))
    b = right.withColumn("_salt", F.explode(copy_salts(F.col(key), hot)))
    return a.join(b, [key, "_salt"], how).drop("_salt")


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """Rows over twice as many partitions as there are cores if the scan gave fewer than that many tasks a core.

    By ``key`` if it tells rows apart, else in turn. Only a table of a few files is moved; a large one has splits enough and stays where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = df._jdf.queryExecution().toRdd().getNumPartitions()
    if tasks >= cores:
        return df
    return df.repartition(2 * cores, key) if key else df.repartition(2 * cores)
