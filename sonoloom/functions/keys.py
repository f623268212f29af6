"""Keyed digests and record texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def _pads(secret: str) -> tuple[bytes, bytes]:
    import hashlib

    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > _BLOCK else key).ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac(secret: str, x: Column) -> Column:
    """HMAC-SHA256 of a text as hex; null for null. The secret is part of the plan: read it with ``sources.config.read_salt`` and keep plans private."""
    inner, outer = _pads(secret)
    first = F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), F.encode(x, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(bytearray(outer)), first), 256)


def hmac_sql(secret: str, x: str) -> str:
    """DuckDB text of :func:`hmac` for a quoted secret."""
    inner, outer = (f"unhex('{p.hex()}')" for p in _pads(secret.strip("'")))
    return f"sha256({outer} || unhex(sha256({inner} || encode({x}))))"


def reprefixed(key: Column, prefix: str) -> Column:
    """The leading lower-case letters of a key replaced."""
    return F.regexp_replace(key, r"^[a-z]+", prefix)


def entity_key(name: Column, other: Column) -> Column:
    """Letters of the name and a second part; null if either is empty."""
    letters = F.regexp_replace(F.upper(name), r"[^A-Z]", "")
    return F.when((letters != "") & (other != ""), F.concat_ws("|", letters, other))


def json_row(columns: list[Column]) -> Column:
    """One JSON text per row, valid also where a number is NaN (null) or missing (null, its field kept)."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
