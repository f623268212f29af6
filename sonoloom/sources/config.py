"""Configuration as a source: YAML and JSON records with constraint checks, salts, a catalogue of data sets, nested documents."""

from __future__ import annotations

import json
import math
import os
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Check = Callable[[object], bool]


def read_config(spark: SparkSession, path: str) -> dict:
    """YAML (by suffix, if a YAML library is there) or JSON object from any file system Spark reaches."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    if path.rsplit(".", 1)[-1].lower() in ("yml", "yaml"):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML needs the yaml library; JSON works without it") from e
        got = yaml.safe_load(text)
    else:
        got = json.loads(text or "{}")
    if not isinstance(got, dict):
        raise ValueError(f"{path} holds no mapping")
    return got


def problems(config: Mapping, checks: Mapping[str, tuple[str, Check]], closed: bool = False) -> list[str]:
    """Every failed check, not only the first: dotted path -> (what is asked, test). With ``closed``, names without a check are problems too."""
    out = []
    for path, (asked, test) in checks.items():
        value: object = config
        for part in path.split("."):
            value = value.get(part) if isinstance(value, Mapping) else None
        try:
            ok = bool(test(value))
        except (TypeError, ValueError):
            ok = False
        if not ok:
            out.append(f"{path}: {asked}, not {value!r}")
    if closed:
        known = {p.split(".")[0] for p in checks}
        out += [f"{k}: unknown name" for k in config if k not in known]
    return out


def require(config: Mapping, checks: Mapping[str, tuple[str, Check]], closed: bool = False) -> Mapping:
    """``config``, or one error that lists all problems."""
    if found := problems(config, checks, closed):
        raise ValueError("; ".join(found))
    return config


def number(low: float, high: float, whole: bool = False) -> tuple[str, Check]:
    """Check of a finite number in [low, high]; booleans are no numbers."""
    kind = "a whole number" if whole else "a number"
    return f"{kind} from {low} to {high}", lambda v: isinstance(v, int if whole else (int, float)) and not isinstance(v, bool) and math.isfinite(v) and low <= v <= high


def shares(names: tuple[str, ...]) -> tuple[str, Check]:
    """Check of positive shares of the named parts that add up to 1."""
    return f"shares of {', '.join(names)} that add up to 1", lambda v: set(v) == set(names) and all(x > 0 for x in v.values()) and abs(sum(v.values()) - 1) < 1e-9


def merged_defaults(defaults: Mapping, text: str | None, checks: Mapping[str, tuple[str, Check]]) -> dict:
    """``defaults`` with the values of a JSON object on top; names that have no default and values that fail a check are refused."""
    given = json.loads(text) if text else {}
    if unknown := sorted(set(given) - set(defaults)):
        raise ValueError(f"unknown names: {', '.join(unknown)}")
    return dict(require({**defaults, **given}, checks))


def read_salt(path: str | None = None, variable: str = "SONOLOOM_SALT", least: int = 16, inside: str | None = None) -> str:
    """Secret for keyed digests: the file's text, else the environment variable; refused if short, absent, or kept under ``inside``."""
    if path is not None:
        if inside and os.path.realpath(path).startswith(os.path.realpath(inside) + os.sep):
            raise ValueError("the salt may not be kept beside the code or the data")
        with open(path, encoding="utf-8") as f:
            salt = f.read().strip()
    else:
        salt = os.environ.get(variable, "").strip()
    if len(salt) < least:
        raise ValueError(f"the salt has fewer than {least} characters")
    return salt


class Catalogue:
    """Named sources: a reader and its options per name; ``views`` registers them for SQL."""

    def __init__(self, spark: SparkSession):
        self.spark, self.readers = spark, {}

    def add(self, name: str, reader: Callable[..., DataFrame], *args, **options) -> None:
        if name in self.readers:
            raise ValueError(f"source {name} is there already")
        self.readers[name] = (reader, args, options)

    def read(self, name: str, default: str | None = None) -> DataFrame:
        """The source of that name, or of ``default``; an unknown name says which there are."""
        pick = name if name in self.readers else default
        if pick not in self.readers:
            raise KeyError(f"no source {name}; there are {', '.join(sorted(self.readers))}")
        reader, args, options = self.readers[pick]
        return reader(self.spark, *args, **options)

    def views(self) -> list[str]:
        for name in self.readers:
            self.read(name).createOrReplaceTempView(name)
        return sorted(self.readers)


def first_that_reads(readers: list[Callable[[], DataFrame]]) -> DataFrame:
    """The first source whose files are there and whose schema can be read; all errors are named if none is."""
    errors = []
    for read in readers:
        try:
            df = read()
            df.schema  # noqa: B018
            return df
        except Exception as e:  # noqa: BLE001
            errors.append(str(e).split("\n", 1)[0])
    raise ValueError("no source could be read: " + " | ".join(errors))


def read_json_documents(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines or whole JSON documents (a file a document), with the file's path."""
    reader = spark.read.option("multiLine", not path.rstrip("/").endswith((".jsonl", ".ndjson")))
    df = reader.schema(schema).json(path) if schema else reader.json(path)
    return df.select("*", F.col("_metadata.file_path").alias("file_path"))


def nested_rows(df: DataFrame, key: str, items: str, children: str, columns: list[str], depth: int = 16) -> DataFrame:
    """Rows of a tree of structs: key, place (like ``2.1``), parent (its place), level, and ``columns`` of every node.

    ``items`` is an array of structs whose field ``children`` holds the next level as an
    array of structs or as the JSON text of one. A level is opened at a time; a tree deeper
    than ``depth`` is refused.
    """
    level = df.select(key, F.posexplode(items).alias("k", "node")).select(key, (F.col("k") + 1).cast("string").alias("place"), F.lit(None).cast("string").alias("parent"), "node")
    out = None
    for n in range(depth):
        rows = level.select(key, "place", "parent", F.lit(n).alias("level"), *[F.col("node")[c].alias(c) for c in columns])
        out = rows if out is None else out.unionByName(rows)
        kinds = {f.name: f.dataType for f in level.schema["node"].dataType.fields}
        if children not in kinds:
            return out
        below = F.col("node")[children]
        if kinds[children].typeName() == "string":
            below = F.from_json(below, f"array<{level.schema['node'].dataType.simpleString()}>")
        level = level.select(key, F.col("place").alias("parent"), F.posexplode(below).alias("k", "node")).select(key, F.concat_ws(".", "parent", (F.col("k") + 1).cast("string")).alias("place"), "parent", "node")
        if level.isEmpty():
            return out
    raise ValueError(f"a document is nested over {depth} levels")


def subset_list(spark: SparkSession, path: str) -> DataFrame:
    """Names listed in a text file, a line each, with the class before the first underscore; blank lines and repeats are left out."""
    lines = spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''").distinct()
    return lines.select("name", F.split("name", "_")[0].alias("class_name"))


def typed_table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """Rows with every column and type of ``schema``, also when there are none."""
    return spark.createDataFrame(rows, schema)
