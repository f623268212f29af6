"""Seeded, order-free uniform numbers from keys; the same value in any SQL engine with md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_int(stage: str, *keys: Column) -> Column:
    """32-bit unsigned number of (stage, keys) as a long."""
    text = F.concat_ws(":", F.lit(stage), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_unit(stage: str, *keys: Column) -> Column:
    """Uniform number in [0, 1)."""
    return hash_int(stage, *keys) / F.lit(4294967296.0)


def hash_int_sql(stage: str, *keys: str) -> str:
    """DuckDB text of :func:`hash_int`."""
    return f"(('0x' || substr(md5(concat_ws(':', '{stage}', {', '.join(keys)})), 1, 8))::bigint)"


def hash_unit_sql(stage: str, *keys: str) -> str:
    """DuckDB text of :func:`hash_unit`."""
    return f"({hash_int_sql(stage, *keys)} / 4294967296.0)"
