"""Ordered rules with reasons, and the counts they leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


Rule = Column | str


def _column(rule: Rule) -> Column:
    """A rule given as SQL text or as a column; a rule on a missing value is False."""
    return F.coalesce(F.expr(rule) if isinstance(rule, str) else rule, F.lit(False))


def with_rules(df: DataFrame, rules: list[tuple[str, Rule]]) -> DataFrame:
    """One boolean column per rule."""
    return df.select("*", *[_column(cond).alias(f"rule_{name}") for name, cond in rules])


def funnel(df: DataFrame, rules: list[tuple[str, Rule]], groups: list[str]) -> DataFrame:
    """Rows left after each rule in turn, per group and overall, in one pass."""
    kept, counts = F.lit(True), [F.count(F.lit(1)).alias("n_all")]
    for name, cond in rules:
        kept = kept & _column(cond)
        counts.append(F.count_if(kept).alias(f"n_{name}"))
    sets = df.groupingSets([[F.col(g)] for g in groups] + [[]], *[F.col(g) for g in groups])
    return sets.agg(F.grouping_id().alias("level"), *counts)


def reasons(rules: list[tuple[str, Rule]]) -> Column:
    """Names of the rules that hit, in rule order, joined by ``;``; null if none did."""
    hits = F.array_compact(F.array(*[F.when(_column(cond), F.lit(name)) for name, cond in rules]))
    return F.when(F.size(hits) > 0, F.array_join(hits, ";"))


def first_reason(text: Column) -> Column:
    return F.split_part(text, F.lit(";"), F.lit(1))


def decision(exclude: Column, unsure: Column) -> Column:
    """exclude before uncertain before keep."""
    return F.when(F.coalesce(exclude, F.lit(False)), "exclude").when(F.coalesce(unsure, F.lit(False)), "uncertain").otherwise("keep")


def suppressed(n: Column, below: int = 5) -> Column:
    """Counts of 1 to ``below`` - 1 are shown as ``<below``."""
    return F.when(n.between(1, below - 1), F.lit(f"<{below}")).otherwise(n.cast("string"))


def shortfall(df: DataFrame, group: str, least: int, family: str, needed: list[str]) -> DataFrame:
    """Per group: rows, families missing, and whether it meets both criteria."""
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"), F.collect_set(family).alias("_f"))
    missing = F.array_except(F.array(*[F.lit(x) for x in needed]), F.col("_f"))
    return g.select(group, "n_rows", F.array_join(missing, "+").alias("missing"), ((F.col("n_rows") >= least) & (F.size(missing) == 0)).alias("ok"))
