"""Identifier and path normalisers as column expressions, each with its SQL text.

A missing identifier never equals anything: every normaliser returns NULL for
null, empty, zeros-only, punctuation-only and "unknown" texts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blanks and quotation marks that exporters put around ids.
BLANKS = " \t\n\r\f\v             ​‌‍    ⁠　﻿"
QUOTES = "\"'`´‘’‚“”„«»‹›"
# Words that stand for "unknown", in lower case.
UNKNOWN_WORDS = (
    "unknown", "unk", "unspecified", "undefined", "unavailable", "not available", "not known", "missing",
    "none", "null", "nil", "nan", "nat", "na", "n/a", "n.a.", "n.a", "#n/a", "nd", "n/d", "n.d.", "tbd",
    "inconnu", "inconnue", "inconnus", "inconnues", "non disponible", "indisponible", "manquant", "manquante",
    "aucun", "aucune", "sans", "anonyme", "anonymous", "anon",
)

_EDGE = f"[{BLANKS}{QUOTES}]+"
_BLANK_EDGE = f"[{BLANKS}]+"


def strip_id(c: Column) -> Column:
    """Text without surrounding blanks and quotation marks, in any mix."""
    return F.btrim(c.cast("string"), F.lit(BLANKS + QUOTES))


def usable(c: Column) -> Column:
    """NULL for texts that name nothing; ``c`` must be stripped."""
    names = c.rlike(r"[\p{L}1-9]") & ~F.lower(c).isin(*UNKNOWN_WORDS)
    return F.when(names, c)


def study_key(c: Column) -> Column:
    """Comparison key of study and still ids: case, blanks and quotes do not count."""
    return usable(F.lower(strip_id(c)))


def patient_key(c: Column) -> Column:
    """As :func:`study_key`; leading zeros and a decimal part of zeros do not count either."""
    s = F.regexp_replace(F.lower(strip_id(c)), r"^([0-9]+)[.,]0*$", "$1")
    return usable(F.regexp_replace(s, r"^0+(?=.)", ""))


def path_key(c: Column) -> Column:
    """Comparison key of paths: blanks around, kind of slash, repeated slashes and ``.`` steps do not count."""
    s = F.translate(F.btrim(c.cast("string"), F.lit(BLANKS)), "\\", "/")
    s = F.regexp_replace(s, "/+", "/")
    s = F.regexp_replace(F.regexp_replace(s, r"(^|/)(?:\./)+", "$1"), r"(.)/\.$", "$1")
    return usable(s)


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _usable_sql(x: str) -> str:
    words = ", ".join(_q(w) for w in UNKNOWN_WORDS)
    return f"(case when regexp_matches({x}, '[\\p{{L}}1-9]') and lower({x}) not in ({words}) then {x} end)"


def _strip_sql(x: str, edge: str) -> str:
    return f"regexp_replace(regexp_replace(cast({x} as varchar), {_q('^' + edge)}, ''), {_q(edge + '$')}, '')"


def study_key_sql(x: str) -> str:
    """DuckDB text of :func:`study_key`."""
    return _usable_sql(f"lower({_strip_sql(x, _EDGE)})")


def patient_key_sql(x: str) -> str:
    """DuckDB text of :func:`patient_key`."""
    s = f"regexp_replace(lower({_strip_sql(x, _EDGE)}), '^([0-9]+)[.,]0*$', '\\1')"
    return _usable_sql(f"regexp_replace({s}, '^0+(.)', '\\1')")


def path_key_sql(x: str) -> str:
    """DuckDB text of :func:`path_key`."""
    s = f"replace({_strip_sql(x, _BLANK_EDGE)}, '\\', '/')"
    s = f"regexp_replace({s}, '/+', '/', 'g')"
    s = f"regexp_replace({s}, '(^|/)(\\./)+', '\\1', 'g')"
    return _usable_sql(f"regexp_replace({s}, '(.)/\\.$', '\\1')")
