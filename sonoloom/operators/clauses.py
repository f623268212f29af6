"""Clause-level text work: folding, filters, removal with what it strands, assertions, merging, phrases, lines of words."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonoloom.operators.textops import clauses


def _accent_table() -> tuple[str, str]:
    """Accented Latin letters and their plain forms, from the Unicode database."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _PLAIN = _accent_table()


def fold(x: Column) -> Column:
    """Lower case without accents, one kind of apostrophe."""
    t = F.translate(x, _ACCENTED + "’ʼ", _PLAIN + "''")
    return F.lower(F.regexp_replace(t, r"\p{Mn}", ""))


def plain_words(x: Column) -> Column:
    """Folded words without a plural s."""
    return F.transform(F.filter(F.split(fold(x), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.regexp_replace(w, r"(.{3})s$", "$1"))


def naming(parts: Column, pattern: str, but_not: str | None = None) -> Column:
    """Clauses that match ``pattern`` and not ``but_not``."""
    hit = lambda c: F.lower(c).rlike(pattern) & (F.lit(True) if but_not is None else ~F.lower(c).rlike(but_not))
    return F.filter(parts, hit)


def only_findings(parts: Column, patterns: dict[str, str], allowed: list[str]) -> Column:
    """Clauses that state at least one finding, all of them among ``allowed``."""
    def ok(c: Column) -> Column:
        hits = [(name, F.lower(c).rlike(p)) for name, p in patterns.items()]
        some, other = F.lit(False), F.lit(False)
        for name, h in hits:
            some, other = (some | h, other) if name in allowed else (some, other | h)
        return some & ~other

    return F.filter(parts, ok)


def surgery(parts: Column, remove: str, leans: str) -> Column:
    """Struct (kept, n_removed, n_stranded): clauses that match ``remove`` go; a clause right after one that matches ``leans`` (it points back) goes too, stranded."""
    gone = F.transform(parts, lambda c: F.lower(c).rlike(remove))

    def state(c: Column, k: Column) -> Column:
        before = F.when(k > 0, F.get(gone, k - 1)).otherwise(F.lit(False))
        return F.when(F.lower(c).rlike(remove), "removed").when(before & F.lower(c).rlike(leans), "stranded").otherwise("kept")

    marked = F.transform(parts, lambda c, k: F.struct(c.alias("c"), state(c, k).alias("s")))
    count = lambda s: F.size(F.filter(marked, lambda m: m["s"] == s))
    kept = F.transform(F.filter(marked, lambda m: m["s"] == "kept"), lambda m: m["c"])
    return F.struct(F.array_join(kept, "; ").alias("kept"), count("removed").alias("n_removed"), count("stranded").alias("n_stranded"))


def merged(head: Column, said: Column) -> Column:
    """``said`` after those clauses of ``head`` that no clause of ``said`` contains."""
    new = F.filter(head, lambda h: ~F.exists(said, lambda s: F.contains(F.lower(s), F.lower(h))))
    return F.concat(new, said)


def assertion(clause: Column, finding: str, negation: str, doubt: str) -> Column:
    """present, absent or uncertain where the clause names the finding, else null; doubt wins over negation."""
    c = F.lower(clause)
    return F.when(~c.rlike(finding), None).when(c.rlike(doubt), "uncertain").when(c.rlike(negation), "absent").otherwise("present")


def assertions(df: DataFrame, key: str, text: str, findings: dict[str, str], negation: str, doubt: str) -> DataFrame:
    """key, finding, value, n: how many clauses of a record state it.

    Texts repeat, so distinct clauses are read once and joined back by their text.
    """
    each = df.select(key, F.explode(clauses(F.col(text))).alias("clause"))
    distinct = each.select("clause").distinct()
    read = distinct.select("clause", F.explode(F.array(*[F.struct(F.lit(n).alias("finding"), assertion(F.col("clause"), p, negation, doubt).alias("value")) for n, p in findings.items()])).alias("x"))
    facts = read.select("clause", "x.finding", "x.value").where("value is not null")
    return each.join(facts, "clause").groupBy(key, "finding", "value").agg(F.count(F.lit(1)).alias("n"))


def claim_status(values: Column) -> Column:
    """Status of a set of assertions: conflict if both present and absent, else present, absent or uncertain; null for none."""
    has = lambda v: F.array_contains(values, v)
    return F.when(has("present") & has("absent"), "conflict").when(has("present"), "present").when(has("absent"), "absent").when(has("uncertain"), "uncertain")


def matches_scaled(read: Column, values: Column, scales: list[float], tolerance: float) -> Column:
    """Whether a number read equals one of ``values`` in one of ``scales``, within a relative ``tolerance``."""
    one = lambda v, s: F.abs(read - v * F.lit(s)) <= F.abs(v * F.lit(s)) * F.lit(tolerance)
    return F.exists(values, lambda v: F.coalesce(F.greatest(*[one(v, s).cast("int") for s in scales]) == 1, F.lit(False)))


def phrases_in(x: Column, phrases: list[str]) -> Column:
    """Known phrases that a text holds, whatever their case, in the order of the list."""
    return F.array_compact(F.array(*[F.when(F.contains(F.lower(x), F.lit(p.lower())), F.lit(p)) for p in phrases]))


def decimal_text(x: Column, digits: int, mark: str = ",") -> Column:
    """Number with a decimal mark."""
    return F.translate(F.format_string(f"%.{digits}f", x), ".", mark)


def lines_of(df: DataFrame, group: list[str], low: str, high: str, order: list[str]) -> DataFrame:
    """``df`` with line: boxes of a group whose vertical ranges overlap, directly or through others, share a line (numbered from the top).

    One ordered pass per group: a box opens a line if it starts at or below the lowest edge so far.
    """
    w = Window.partitionBy(*group).orderBy(low, *order)
    edge = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = df.withColumn("_new", F.when(edge.isNull() | (F.col(low) >= edge), 1).otherwise(0))
    return opened.withColumn("line", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def unknown_paths(document: Column, allowed: list[str]) -> Column:
    """Keys of a JSON object that a form does not have."""
    return F.array_sort(F.array_except(F.map_keys(F.from_json(document, "map<string,string>")), F.array(*[F.lit(a) for a in allowed])))


def nested_json(df: DataFrame, key: str, path: str, value: str) -> DataFrame:
    """key, document: (path, value) rows with dots in the paths put together to JSON objects, the deepest level first.

    The inverse of :func:`sonoloom.operators.relational.flat_leaves` for objects; values are texts.
    """
    rows = df.select(key, F.split(path, r"\.").alias("p"), F.to_json(F.struct(F.col(value).alias("v"))).alias("j"))
    rows = rows.select(key, "p", F.coalesce(F.get_json_object("j", "$.v"), F.lit("")).alias("raw"), F.col("j").contains('"v"').alias("known"))
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("raw").alias("v"))), r'^\{"v":(.*)\}$', 1)
    level = rows.select(key, "p", F.when(F.col("known"), quoted).otherwise(F.lit("null")).alias("json"))
    while (deepest := level.agg(F.max(F.size("p")).alias("n")).first()["n"] or 0) > 0:
        name = F.regexp_extract(F.to_json(F.struct(F.element_at("p", -1).alias("v"))), r'^\{"v":(.*)\}$', 1)
        closed = level.where(F.size("p") == deepest).groupBy(key, F.slice("p", 1, deepest - 1).alias("p")).agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(F.concat(name, F.lit(":"), "json"))), ","), F.lit("}")).alias("json"))
        level = closed.unionByName(level.where(F.size("p") < deepest))
    return level.select(key, F.col("json").alias("document"))
