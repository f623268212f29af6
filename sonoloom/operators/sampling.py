"""Seeded samples that do not depend on row order or partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonoloom.functions.hashing import hash_int, hash_unit
from sonoloom.functions.ranks import null_safe_join, rank_by_hash


MAX_WEIGHTS = 100_000


def stratified(df: DataFrame, strata: list[str], k: int, seed: str, key: str) -> DataFrame:
    """Up to ``k`` rows of each stratum with their inclusion probability."""
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("stratum_size"))
    ranked = rank_by_hash(df, hash_int(seed, F.col(key)), [key], "draw", tuple(strata)).where(F.col("draw") <= k)
    p = F.least(F.lit(1.0), F.lit(float(k)) / F.col("stratum_size"))
    return null_safe_join(ranked, sizes, strata).withColumn("inclusion", p)


def two_stage(df: DataFrame, cluster: str, key: str, n_clusters: int, per_cluster: int, seed: str) -> DataFrame:
    """``n_clusters`` clusters, then up to ``per_cluster`` rows of each, with the product of both probabilities."""
    clusters = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("cluster_size"))
    total = clusters.count()
    drawn = rank_by_hash(clusters, hash_int(seed + "-cluster", F.col(cluster)), [cluster], "cluster_rank").where(F.col("cluster_rank") <= n_clusters)
    rows = df.join(drawn, cluster).withColumn("item_rank", F.row_number().over(Window.partitionBy(cluster).orderBy(hash_int(seed + "-item", F.col(key)), key)))
    p = F.least(F.lit(1.0), F.lit(float(n_clusters)) / F.lit(float(total))) * F.least(F.lit(float(per_cluster)), F.col("cluster_size").cast("double")) / F.col("cluster_size")
    return rows.where(F.col("item_rank") <= per_cluster).withColumn("inclusion", p)


def weighted_draws(weights: DataFrame, key: str, weight: str, draws: int, seed: str, spark_range) -> DataFrame:
    """``draws`` keys with replacement, each with probability proportional to its weight (inverse of the running sum).

    weights has one row per dataset or group: a short table, refused above MAX_WEIGHTS rows.
    """
    if weights.count() > MAX_WEIGHTS:
        raise ValueError(f"over {MAX_WEIGHTS} weights; draw groups first, then rows within them")
    w = Window.partitionBy().orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = weights.withColumn("hi", F.sum(weight).over(w)).withColumn("lo", F.col("hi") - F.col(weight))
    total = F.lit(weights.agg(F.sum(weight)).first()[0])
    u = spark_range(draws).select(F.col("id").alias("draw"), (hash_unit(seed, F.col("id")) * total).alias("u"))
    return u.join(F.broadcast(cum), (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("draw", key)


def shards(df: DataFrame, key: str, n: int, seed: str) -> Column:
    """Shard of a key: a hash of it, so it does not depend on the table."""
    return F.pmod(hash_int(seed, F.col(key)), F.lit(n))


def batches(df: DataFrame, key: str, batch: int, world: int, seed: str) -> DataFrame:
    """Seeded permutation cut into full global batches; each rank reads its share of every batch."""
    n = df.count() // batch * batch
    ranked = rank_by_hash(df.select(key), hash_int(seed, F.col(key)), [key]).where(F.col("rank") <= n)
    at = F.col("rank") - 1
    return ranked.select(key, F.floor(at / batch).cast("long").alias("batch"), F.floor((at % batch) / F.lit(batch // world)).cast("long").alias("rank_of_world"))


def reference_sample(population: DataFrame, sample: DataFrame, cluster: str, strata: list[str], k: int, seed: str, key: str) -> DataFrame:
    """Up to ``k`` rows per stratum from clusters outside ``sample``, in strata that the sample holds."""
    rest = population.join(sample.select(cluster).distinct(), cluster, "left_anti").join(sample.select(*strata).distinct(), strata, "left_semi")
    return rank_by_hash(rest, hash_int(seed, F.col(key)), [key], "draw", tuple(strata)).where(F.col("draw") <= k)


def round_robin(df: DataFrame, group: str, family: str, key: str, slots: int, seed: str, tier: Column | None = None) -> DataFrame:
    """Up to ``slots`` rows per group, one of each family in turn; later tiers only fill what is left."""
    h = hash_int(seed, F.col(group), F.col(key))
    ranked = df.withColumn("turn", F.row_number().over(Window.partitionBy(group, family).orderBy(h, key)))
    if tier is None:
        # A later turn of a family has ``slots`` rows of it before it.
        ranked = ranked.where(F.col("turn") <= slots)
    order = ([tier] if tier is not None else []) + [F.col("turn"), hash_int(seed, F.col(group), F.col(family)), F.col(family)]
    return ranked.withColumn("slot", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("slot") <= slots)


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, out: str = "place") -> DataFrame:
    """First ``k`` rows of each group; the rank filter lets Spark keep only k rows of a group per task before the shuffle (window group limit)."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(out) <= k)


def padded(values: Column, slots: int) -> tuple[Column, Column]:
    """(array of exactly ``slots`` elements, array of flags that tell real from padding)."""
    n = F.least(F.size(values), F.lit(slots))
    cut = F.slice(values, 1, slots)
    return F.concat(cut, F.array_repeat(F.lit(None).cast("string"), F.lit(slots) - n)), F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(slots) - n))
