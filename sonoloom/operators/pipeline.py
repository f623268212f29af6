"""Pipeline steps: exhaustive selection, second passes, monitored passes, collation, overrides and rules from text."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoloom.functions.hashing import hash_int
from sonoloom.functions.ranks import rank_by_hash


def exhaustive_selection(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """``df`` with kept and reason: the first step a row fails, in order; a test without an answer fails. Every row comes out once."""
    reason = F.lit(None).cast("string")
    for name, ok in reversed(steps):
        reason = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(reason)
    return df.withColumn("reason", reason).withColumn("kept", F.col("reason").isNull())


def second_pass(df: DataFrame, needed: Column, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Rows that need it go through ``run`` (a batch at a time; its result has ``schema``), the others get nulls there; status says checked, failed or skipped.

    A batch whose run raises is tried row by row, so one bad record fails alone.
    """
    fields = [f.split()[0] for f in schema.split(",")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                yield pdf.assign(status="checked", **{c: v for c, v in run(pdf).items() if c in fields})
            except Exception:  # noqa: BLE001
                for k in range(len(pdf)):
                    one = pdf.iloc[k : k + 1]
                    try:
                        yield one.assign(status="checked", **{c: v for c, v in run(one).items() if c in fields})
                    except Exception:  # noqa: BLE001
                        yield one.assign(status="failed", **dict.fromkeys(fields))

    flagged = F.coalesce(needed, F.lit(False))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", status string, {schema}"
    order = [*df.columns, "status", *fields]
    done = df.where(flagged).mapInPandas(lambda it: (p[order] for p in work(it)), out)
    return df.where(~flagged).select("*", F.lit("skipped").alias("status"), *[F.lit(None).cast(done.schema[c].dataType).alias(c) for c in fields]).unionByName(done)


def monitored(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> DataFrame:
    """One row per task of a pass over ``df``: rows in and out, batches, seconds, CPU seconds and the worker's peak memory in MB."""

    def watch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import resource

        from pyspark import TaskContext

        count = {"rows_in": 0, "batches": 0}

        def counted() -> Iterator[pd.DataFrame]:
            for pdf in batches:
                count["rows_in"] += len(pdf)
                count["batches"] += 1
                yield pdf

        began, cpu = time.time(), time.process_time()
        rows_out = sum(len(p) for p in run(counted()))
        peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
        task = TaskContext.get()
        yield pd.DataFrame([(task.partitionId() if task else 0, count["rows_in"], rows_out, count["batches"], time.time() - began, time.process_time() - cpu, peak)], columns=["task", "rows_in", "rows_out", "batches", "seconds", "cpu_seconds", "peak_mb"])

    return df.mapInPandas(watch, "task int, rows_in long, rows_out long, batches long, seconds double, cpu_seconds double, peak_mb double")


def collated(df: DataFrame, key: str, values: str, size: int, seed: str) -> DataFrame:
    """batch, keys, padded, present: seeded batches of ``size`` rows, their arrays padded with null to the longest of the batch."""
    ranked = rank_by_hash(df.select(key, values), hash_int(seed, F.col(key)), [key], "_k").withColumn("batch", F.floor((F.col("_k") - 1) / size).cast("long"))
    rows = ranked.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("_k", F.col(key).alias("key"), F.coalesce(F.col(values), F.array().cast(df.schema[values].dataType)).alias("v")))).alias("r"), F.max(F.greatest(F.size(values), F.lit(0))).alias("n"))
    kind = df.schema[values].dataType.elementType
    pad = lambda r: F.concat(r["v"], F.array_repeat(F.lit(None).cast(kind), F.col("n") - F.size(r["v"])))
    there = lambda r: F.concat(F.array_repeat(F.lit(True), F.size(r["v"])), F.array_repeat(F.lit(False), F.col("n") - F.size(r["v"])))
    return rows.select("batch", F.transform("r", lambda r: r["key"]).alias("keys"), F.transform("r", pad).alias("padded"), F.transform("r", there).alias("present"))


def compared_policies(df: DataFrame, policies: Mapping[str, Column], truth: Column, groups: list[str]) -> DataFrame:
    """policy, groups, n, n_flagged, n_right: the same rows under several rules, in one scan."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("policy"), F.coalesce(rule, F.lit(False)).alias("flag")) for name, rule in policies.items()])).alias("p")
    rows = df.select(*groups, truth.alias("_truth"), each).select(*groups, "_truth", "p.policy", "p.flag")
    return rows.groupBy("policy", *groups).agg(F.count(F.lit(1)).alias("n"), F.count_if("flag").alias("n_flagged"), F.count_if(F.col("flag") == F.col("_truth")).alias("n_right"))


def existing_share(df: DataFrame, known: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n_checked and n_found of a seeded sample of ``n`` distinct keys looked up in ``known``."""
    drawn = rank_by_hash(df.where(F.col(key).isNotNull()).select(key).distinct(), hash_int(seed, F.col(key)), [key], "_k").where(F.col("_k") <= n)
    there = known.select(key).distinct().withColumn("_there", F.lit(True))
    return drawn.join(there, key, "left").agg(F.count(F.lit(1)).alias("n_checked"), F.count("_there").alias("n_found"))


def draws_per_value(df: DataFrame, value: Column, key: str, k: int, seed: str) -> DataFrame:
    """Up to ``k`` seeded rows per rounded value (column ``value_bin``)."""
    return rank_by_hash(df.withColumn("value_bin", F.round(value)).where("value_bin is not null"), hash_int(seed, F.col(key)), [key], "draw", ("value_bin",)).where(F.col("draw") <= k)


def overridden(base: Mapping, change: Mapping) -> dict:
    """``base`` with the leaves of ``change`` on top, branch by branch; a name that ``base`` does not have is refused."""
    out = dict(base)
    for k, v in change.items():
        if k not in base:
            raise ValueError(f"unknown name {k}")
        out[k] = overridden(base[k], v) if isinstance(base[k], Mapping) and isinstance(v, Mapping) else v
    return out


def slots(specs: list[str], known: list[str]) -> dict[str, int]:
    """``NAME=N`` texts as name -> number; names outside ``known``, repeats and numbers below 1 are refused."""
    out: dict[str, int] = {}
    for spec in specs:
        m = re.fullmatch(r"\s*(\S.*?)\s*=\s*(\d+)\s*", spec)
        if not m or m[1] not in known or m[1] in out or int(m[2]) < 1:
            raise ValueError(f"{spec!r} is no NAME=N of {', '.join(known)}")
        out[m[1]] = int(m[2])
    return out


def selection_rule(text: str, metrics: Mapping[str, bool]) -> tuple[str | None, str, bool]:
    """(head, metric, larger is better) of ``metric`` or ``head/metric``; ``metrics`` says of each whether larger is better."""
    head, _, metric = text.rpartition("/")
    if metric not in metrics:
        raise ValueError(f"no metric {metric}; there are {', '.join(sorted(metrics))}")
    return head or None, metric, metrics[metric]
