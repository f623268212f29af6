"""Clauses, templates, numbers and digests of report text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# End of a clause: a double slash, a semicolon, a line break, or a full stop that is no decimal point.
CLAUSE_END = r"//|;|\n|\.(?:\s|$)"
# Cell texts that mean nothing was entered.
NO_TEXT = ("na", "n/a", "nan", "none", "null", "-", ".")


def clean_cell(x: Column) -> Column:
    """Text without control characters and outer blanks; words for "nothing" become empty."""
    t = F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " "))
    return F.when(F.lower(t).isin(*NO_TEXT), "").otherwise(t)


def clauses(x: Column) -> Column:
    """Trimmed clauses without the empty ones."""
    return F.filter(F.transform(F.split(x, CLAUSE_END), lambda c: F.trim(c)), lambda c: c != "")


def template(x: Column) -> Column:
    """Numbers masked."""
    return F.regexp_replace(x, r"[0-9]+(?:[.,][0-9]+)?", "#")


def canonical(x: Column) -> Column:
    """Lower case, one blank between words, no outer punctuation."""
    t = F.regexp_replace(F.lower(x), r"[\s]+", " ")
    return F.regexp_replace(t, r"^[ .,;:!?]+|[ .,;:!?]+$", "")


def numbers(x: Column) -> Column:
    """All numbers of a text, with a comma or a point before the decimals."""
    return F.transform(F.regexp_extract_all(x, F.lit(r"([0-9]+(?:[.,][0-9]+)?)"), F.lit(1)), lambda n: F.replace(n, F.lit(","), F.lit(".")).cast("double"))


def flags(x: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns found, in order, joined by +."""
    hits = F.array_compact(F.array(*[F.when(F.lower(x).rlike(p), F.lit(name)) for name, p in patterns.items()]))
    return F.array_join(hits, "+")


def clause_counts(df: DataFrame, text: str, least: int) -> DataFrame:
    """Clause templates with at least ``least`` uses."""
    each = df.select(F.explode(clauses(F.col(text))).alias("clause"))
    return each.groupBy(template(canonical(F.col("clause"))).alias("template")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def section(x: Column, header: str) -> Column:
    """Text between a header line and the next empty line; null without the header."""
    found = F.regexp_extract(x, rf"(?s)(?:^|\n){header}\n+(.*?)(?:\n\n|$)", 1)
    return F.when(found != "", found)


def order_free_digest(df: DataFrame, key: str) -> DataFrame:
    """Count and one number for a set of keys, whatever their order: sums of two halves of each key's hash."""
    h = F.md5(F.col(key).cast("string"))
    half = lambda a: F.sum(F.conv(F.substring(h, a, 8), 16, 10).cast("bigint"))
    return df.agg(F.count(F.lit(1)).alias("n"), half(1).alias("digest_a"), half(9).alias("digest_b"))
