"""Scans of the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet scan of one table (a file or a folder), pruned to ``columns``."""
    df = spark.read.parquet(f"{root}/{name}.parquet")
    return df.select(*columns) if columns else df


def require_columns(df: DataFrame, required: list[str], what: str = "table") -> DataFrame:
    """Refuse at plan time a table that lacks a required column."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns {missing}; it has {df.columns}")
    return df
