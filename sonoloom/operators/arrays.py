"""Arrays and marks: masks, repeats, pooling, spread of vectors, bit sets, chains of marks, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonoloom.functions.hashing import hash_int, hash_unit
from sonoloom.functions.ranks import null_safe_join, rank_by_hash


def repeated_blocks(x: Column, block: int, times: int) -> Column:
    """Each run of ``block`` items repeated ``times`` times in place."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1)), F.lit(block))
    return F.flatten(F.transform(starts, lambda s: F.flatten(F.array_repeat(F.slice(x, s, block), times))))


def masked_error(a: Column, b: Column, keep: Column, power: float = 1.0) -> Column:
    """Mean of abs(a - b) ** power over the places where ``keep`` holds, over ``power``; null where none does."""
    pairs = F.filter(F.arrays_zip(a.alias("a"), b.alias("b"), keep.alias("k")), lambda z: z["k"])
    total = F.aggregate(pairs, F.lit(0.0), lambda acc, z: acc + F.pow(F.abs(z["a"].cast("double") - z["b"].cast("double")), F.lit(power)))
    return F.try_divide(total, F.size(pairs) * F.lit(power))


def group_spread(df: DataFrame, group: str, vector: str) -> DataFrame:
    """group, n, mean squared distance over all pairs of a group's vectors, from sums alone (no pairs are made)."""
    each = df.select(group, F.posexplode(vector).alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    per = each.groupBy(group, "i").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"))
    return per.groupBy(group).agg(F.max("n").alias("n"), (2 * F.sum(F.col("n") * F.col("ss") - F.col("s") * F.col("s"))).alias("_d")).select(
        group, "n", F.try_divide(F.col("_d"), F.col("n") * (F.col("n") - 1)).alias("mean_distance")
    )


def pooled_grid(x: Column, side: int, cells: int, eps: float) -> Column:
    """A ``side`` x ``side`` map averaged to ``cells`` x ``cells`` and its logarithm taken (``eps`` added)."""
    step = side // cells

    def cell(k: Column) -> Column:
        row, column = F.floor(k / cells) * step, (k % cells) * step
        rows = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(step - 1)), lambda r: F.slice(x, ((row + r) * side + column + 1).cast("int"), step)))
        return F.log(F.aggregate(rows, F.lit(0.0), lambda acc, v: acc + v) / (step * step) + eps)

    return F.transform(F.sequence(F.lit(0), F.lit(cells * cells - 1)), cell)


def hex_bits(x: Column) -> Column:
    """Booleans of the bits of a hexadecimal text, first digit first, high bit first."""
    digits = F.transform(F.filter(F.split(F.lower(x), ""), lambda c: c != ""), lambda c: F.conv(c, 16, 10).cast("int"))
    return F.flatten(F.transform(digits, lambda d: F.array(*[F.shiftright(d, b).bitwiseAND(F.lit(1)) == 1 for b in (3, 2, 1, 0)])))


def clip_frames(n_frames: Column, clips: int, frames: int, stride: int) -> Column:
    """``clips`` arrays of ``frames`` frame numbers at ``stride``, one clip after the other and evenly placed; a short video repeats its last frame."""
    span = (frames - 1) * stride + 1
    room = F.greatest(n_frames - span, F.lit(0))
    start = lambda k: F.floor(room * k / max(clips - 1, 1)).cast("int")
    one = lambda k: F.transform(F.sequence(F.lit(0), F.lit(frames - 1)), lambda i: F.least(start(k) + i * stride, F.greatest(n_frames.cast("int") - 1, F.lit(0))))
    return F.transform(F.sequence(F.lit(0), F.lit(clips - 1)), one)


def chained(df: DataFrame, group: list[str], at: str, gap: float, order: list[str]) -> DataFrame:
    """``df`` with chain: marks of a group whose places are at most ``gap`` from the one before share a chain (one ordered pass)."""
    w = Window.partitionBy(*group).orderBy(at, *order)
    new = F.when(F.col(at) - F.lag(at).over(w) <= gap, 0).otherwise(1)
    return df.withColumn("_new", new).withColumn("chain", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def straight(df: DataFrame, group: list[str], x: str, y: str, least: int, tolerance: float) -> DataFrame:
    """group, n, straight: whether at least ``least`` points lie on one line (unexplained variance at most ``tolerance`` of all), from sums."""
    vx, vy, c = F.var_pop(x), F.var_pop(y), F.covar_pop(x, y)
    total = vx + vy
    off = (total - F.sqrt((vx - vy) * (vx - vy) + 4 * c * c)) / 2
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), ((F.count(F.lit(1)) >= least) & (total > 0) & (off <= tolerance * total)).alias("straight"))


def near_pairs(df: DataFrame, group: str, row_id: str, at: str, width: float) -> DataFrame:
    """id_a < id_b of rows of one group whose places differ by at most ``width``: an equi-join on cells of that width and their right neighbours."""
    rows = df.where(F.col(at).isNotNull() & F.col(group).isNotNull()).select(group, F.col(row_id).alias("id"), F.col(at).cast("double").alias("at"), F.floor(F.col(at) / width).alias("cell"))
    a = rows.select(group, F.col("id").alias("a"), F.col("at").alias("at_a"), F.explode(F.array("cell", F.col("cell") + 1)).alias("cell"), F.col("cell").alias("own"))
    b = rows.select(group, F.col("id").alias("b"), F.col("at").alias("at_b"), "cell")
    met = a.join(b, [group, "cell"]).where((F.abs(F.col("at_a") - F.col("at_b")) <= width) & ((F.col("own") != F.col("cell")) | (F.col("a") < F.col("b"))))
    return met.select(group, F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))


def length_batches(df: DataFrame, length: str, key: str, size: int, seed: str) -> DataFrame:
    """``df`` with batch: rows of one length in batches of ``size``, in a seeded order."""
    ranked = rank_by_hash(df.where(F.col(length).isNotNull()), hash_int(seed, F.col(key)), [key], "_rank", (length,))
    return ranked.withColumn("batch", F.floor((F.col("_rank") - 1) / size).cast("long")).drop("_rank")


def equal_targets(df: DataFrame, batch: list[str], key: str, caption: str) -> DataFrame:
    """batch, a, b, target: for every ordered pair of a batch (bounded in size) with the same caption, 1 over their number; other pairs are 0 and left out."""
    n = df.groupBy(*batch, caption).agg(F.count(F.lit(1)).alias("_n"))
    a = df.select(*batch, F.col(key).alias("a"), caption).join(n, [*batch, caption])
    return a.join(df.select(*batch, F.col(key).alias("b"), caption), [*batch, caption]).select(*batch, "a", "b", (1.0 / F.col("_n")).alias("target"))


def dropped_slots(slots: Column, seed: str, key: Column, chance: float, least: int) -> Column:
    """Present slots that a seeded draw keeps (each goes with ``chance``); at least ``least`` of them stay, those with the highest draws."""
    drawn = F.array_sort(F.transform(slots, lambda s: F.struct(-hash_unit(seed, key, s), s.alias("s"))))
    return F.array_sort(F.transform(F.filter(drawn, lambda d, k: (k < least) | (-d["col1"] >= chance)), lambda d: d["s"]))


def row_map(df: DataFrame, dataset: str, key: str) -> DataFrame:
    """key, dataset, local (place in its dataset from 0), global_row (after all datasets before it, by name); no window holds all rows."""
    sizes = df.groupBy(dataset).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy().orderBy(F.col(dataset).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(dataset, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))  # a row per dataset
    local = rank_by_hash(df.select(key, dataset), hash_int("row", F.col(key)), [key], "local", (dataset,))
    return null_safe_join(local, before, [dataset]).select(key, dataset, (F.col("local") - 1).alias("local"), (F.col("_before") + F.col("local") - 1).alias("global_row"))
