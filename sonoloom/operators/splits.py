"""Patient-disjoint splits: exact counts, hash, volume over time, inherited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoloom.functions.hashing import hash_int, hash_unit
from sonoloom.functions.ranks import rank_by_hash, running_sums


def exact_split(keys: DataFrame, key: str, seed: str, shares: tuple[float, float] = (0.7, 0.1)) -> DataFrame:
    """Exactly round(n * share) keys for train and val, the rest for test, in seeded order."""
    n = F.lit(keys.count())
    ranked = rank_by_hash(keys.select(key), hash_int(seed, F.col(key)), [key])
    train, val = F.bround(n * shares[0]), F.bround(n * shares[1])
    split = F.when(F.col("rank") <= train, "train").when(F.col("rank") <= train + val, "val").otherwise("test")
    return ranked.select(key, "rank", split.alias("split"))


def hash_split(key: Column, seed: str, shares: tuple[float, float] = (0.7, 0.1)) -> Column:
    """Split of a key by its hash alone: the same in any table and any run."""
    u = hash_unit(seed, key)
    return F.when(u < shares[0], "train").when(u < shares[0] + shares[1], "val").otherwise("test")


def inherited_split(df: DataFrame, key: str, known: DataFrame, seed: str) -> DataFrame:
    """Split from the table of known keys, else by hash; ``origin`` says which."""
    old = known.select(F.col(key), F.col("split").alias("_old"))
    got = df.join(old, key, "left")
    return got.select(*df.columns, F.coalesce("_old", hash_split(F.col(key), seed)).alias("split"), F.when(F.col("_old").isNull(), "hash").otherwise("inherited").alias("origin"))


def volume_split(df: DataFrame, key: str, at: str, shares: tuple[float, float] = (0.7, 0.8)) -> DataFrame:
    """Keys in order of their last date; train up to 70 % of the rows, val up to 80 %, then test."""
    per = df.groupBy(key).agg(F.max(at).alias("last_at"), F.count(F.lit(1)).alias("n_rows"))
    per = per.withColumn("_t", F.unix_micros(F.col("last_at").cast("timestamp")).cast("double"))
    total = df.count()
    cum = running_sums(per, "_t", [key], {"upto": "n_rows"})
    split = F.when(F.col("upto") <= shares[0] * total, "train").when(F.col("upto") <= shares[1] * total, "val").otherwise("test")
    return cum.select(key, "last_at", "n_rows", F.col("upto").cast("long").alias("upto"), split.alias("split"))


def temporal_holdout(df: DataFrame, key: str, year: Column, years: list[int], seed: str) -> DataFrame:
    """Rows of late years form test_temporal if their key has no earlier row; other late rows are left out."""
    late = year.isin(*years)
    marks = df.groupBy(key).agg(F.max((~late).cast("int")).alias("_early"))
    both = df.join(marks, key)
    split = F.when(late & (F.col("_early") == 0), "test_temporal").when(late, "left_out").otherwise(hash_split(F.col(key), seed))
    return both.select(*df.columns, split.alias("split"))
