"""Where results come from: fingerprints, differences, lineage, and refusal of artefacts that another run wrote."""

from __future__ import annotations

import ast
import hashlib
import inspect
import json
import textwrap
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoloom.sources.sinks import content_digest


def flat(record: Mapping, prefix: str = "") -> dict[str, object]:
    """Dotted path -> leaf of a nested mapping; lists and empty mappings are leaves."""
    out: dict[str, object] = {}
    for k, v in record.items():
        path = f"{prefix}{k}"
        out |= flat(v, f"{path}.") if isinstance(v, Mapping) and v else {path: v}
    return out


def differences(saved: Mapping, current: Mapping, ignore: tuple[str, ...] = ()) -> list[str]:
    """Paths of the leaves that differ or are on one side only; ``ignore`` names paths or whole branches."""
    a, b, gone = flat(saved), flat(current), object()
    skip = lambda p: any(p == i or p.startswith(f"{i}.") for i in ignore)
    return sorted(p for p in a.keys() | b.keys() if not skip(p) and a.get(p, gone) != b.get(p, gone))


def fingerprint(record: Mapping) -> str:
    """One digest of a nested record, whatever the order of its names."""
    return hashlib.sha256(json.dumps(record, sort_keys=True, default=str, separators=(",", ":")).encode()).hexdigest()


def require_same(saved: Mapping, current: Mapping, what: str, ignore: tuple[str, ...] = ()) -> None:
    """Refuse to go on if the two records differ, naming where."""
    if found := differences(saved, current, ignore):
        raise ValueError(f"{what} was made with another setup: {', '.join(found)}")


def code_record(*functions: Callable) -> dict[str, str]:
    """Digest of each function's syntax tree (comments, blank lines and docstrings do not count), by its name."""
    out = {}
    for f in functions:
        tree = ast.parse(textwrap.dedent(inspect.getsource(f)))
        for node in ast.walk(tree):
            body = getattr(node, "body", None)
            if isinstance(node, (ast.FunctionDef, ast.ClassDef)) and body and isinstance(body[0], ast.Expr) and isinstance(getattr(body[0], "value", None), ast.Constant):
                node.body = body[1:] or [ast.Pass()]
        out[f"{f.__module__}.{f.__qualname__}"] = hashlib.sha256(ast.dump(tree).encode()).hexdigest()
    return out


def require_artifact(df: DataFrame, marker: Mapping | None, what: str) -> DataFrame:
    """``df`` if its content has the digest of the marker its writer left, else an error."""
    if not marker:
        raise ValueError(f"{what} has no marker of a finished run")
    if content_digest(df) != marker.get("digest"):
        raise ValueError(f"{what} is not the table its marker speaks of")
    return df


def lineage(edges: DataFrame, start: DataFrame, child: str = "child", parent: str = "parent", depth: int = 64) -> DataFrame:
    """node, level: everything that the nodes of ``start`` (column ``node``) were made from, level by level; a loop ends where it closes."""
    seen = start.select("node").distinct().withColumn("level", F.lit(0))
    front = seen
    for level in range(1, depth + 1):
        step = front.join(edges.select(F.col(child).alias("node"), F.col(parent).alias("_p")), "node").select(F.col("_p").alias("node")).where("node is not null").distinct()
        front = step.join(seen.select("node"), "node", "left_anti").withColumn("level", F.lit(level))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
    raise ValueError(f"the lineage is deeper than {depth}")


def broken_lineage(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges whose parent is gone or has another digest now. edges: child, parent, digest; files: path, digest."""
    now = files.select(F.col("path").alias("parent"), F.col("digest").alias("_now"))
    met = edges.join(now, "parent", "left")
    state = F.when(F.col("_now").isNull(), "gone").when(F.col("_now") != F.col("digest"), "changed")
    return met.select("child", "parent", state.alias("state")).where("state is not null")


def recheck(table: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Rows that do not follow from their source (``extra``) and rows that should be there (``missing``), repeats counted."""
    columns = table.columns
    extra = table.exceptAll(rebuilt.select(*columns)).withColumn("state", F.lit("extra"))
    return extra.unionByName(rebuilt.select(*columns).exceptAll(table).withColumn("state", F.lit("missing")))


def bound_allowed(design: Mapping, drawn: int, screened: int) -> bool:
    """Whether a sample supports a bound on its population: a simple random draw, all of it answered, from a population at least as large."""
    return design.get("kind") == "simple random" and design.get("size") == drawn and 0 < drawn <= screened and not design.get("replaced", 0)
