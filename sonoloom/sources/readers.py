"""Sources: typed and id-safe CSV, headerless manifests, shards, pinned files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonoloom.sources.tables import require_columns


def header_columns(spark: SparkSession, path: str, sep: str, encoding: str = "UTF-8") -> list[str]:
    """Column names of the first line; a byte-order mark is not part of the first name."""
    first = spark.read.option("wholetext", False).text(path).first()
    return [] if first is None else [c.strip().strip('"') for c in first[0].lstrip("﻿").split(sep)]


def read_ids_csv(spark: SparkSession, path: str, required: list[str] = (), sep: str = ",", types: dict[str, str] | None = None) -> DataFrame:
    """CSV with every column as text unless ``types`` names another; ``NA`` stays text, empty cells stay empty.

    Values that do not fit a named type become null (``try_cast``), never an error.
    """
    names = header_columns(spark, path, sep)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    df = spark.read.csv(path, schema=schema, header=True, sep=sep, enforceSchema=True, nullValue="\u0000", emptyValue="", quote='"', escape='"', multiLine=True)
    df = df.select(*[F.col(f"`{c}`").try_cast(types[c]).alias(c) if types and c in types else F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in names])
    return require_columns(df, list(required), path)


def read_sniffed_csv(spark: SparkSession, path: str, required: list[str] = (), separators: str = ";,\tα") -> DataFrame:
    """CSV whose separator is the one that the header line holds most often."""
    first = spark.read.text(path).first()
    line = "" if first is None else first[0]
    return read_ids_csv(spark, path, required, max(separators, key=line.count))


def read_headerless(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    """Headerless manifest of ``path label`` lines; the label is what follows the last separator."""
    line = spark.read.text(path).where(F.trim("value") != "")
    parts = F.split(F.trim("value"), sep if sep != "|" else r"\|")
    return line.select(
        F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), sep).alias("path"),
        F.when(F.size(parts) > 1, F.element_at(parts, -1).try_cast("double")).otherwise(0.0).alias("label"),
    )


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """Headerless lines of several views and a last label, split at white space or ``::``."""
    parts = F.split(F.trim("value"), r"::|\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(F.slice(parts, 1, F.size(parts) - 1).alias("views"), F.element_at(parts, -1).try_cast("double").alias("label"))


def dataset_weights(df: DataFrame, dataset: str, weights: dict[str, float]) -> DataFrame:
    """Each row's share of its dataset's weight."""
    sizes = df.groupBy(dataset).agg(F.count(F.lit(1)).alias("_n"))
    w = F.element_at(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]), F.col(dataset))
    return df.join(F.broadcast(sizes), dataset).withColumn("weight", w / F.col("_n")).drop("_n")


def read_split(spark: SparkSession, path: str, split: str, column: str = "split") -> DataFrame:
    """Rows of one split; the filter reaches the scan, and a folder partitioned by split is pruned. Refuses an empty split."""
    df = spark.read.parquet(path).where(F.col(column) == split)
    if df.isEmpty():
        raise ValueError(f"split {split!r} of {path} has no rows")
    return df


def read_shards(spark: SparkSession, pattern: str, override: DataFrame | None = None, kind: str = "kind", value: str | None = None) -> DataFrame:
    """All shards; rows of one kind are replaced by ``override`` when it is given."""
    df = spark.read.option("mergeSchema", True).parquet(pattern)
    if override is None:
        return df
    return df.where(~F.col(kind).eqNullSafe(F.lit(value))).unionByName(override, allowMissingColumns=True)


def completeness(df: DataFrame, expected: int) -> float:
    """Rows over rows expected."""
    return df.count() / expected if expected else float("nan")


def pinned_files(spark: SparkSession, pattern: str) -> DataFrame:
    """path, length, sha256 of every file."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length", F.sha2("content", 256).alias("sha256"))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files whose digest differs or that are on one side only."""
    j = before.select("path", F.col("sha256").alias("a")).join(after.select("path", F.col("sha256").alias("b")), "path", "full_outer")
    return j.where(~F.col("a").eqNullSafe(F.col("b"))).select("path", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("change"))


def small_files(spark: SparkSession, pattern: str, below: int) -> DataFrame:
    """Paths of files shorter than ``below`` bytes; the length filter is pushed to the listing."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(pattern).where(F.col("length") < below).select("path", "length")


def parse_files(spark: SparkSession, pattern: str, parse, schema: str) -> DataFrame:
    """Rows that ``parse(path, bytes)`` yields for each file; a file that fails gives a row with its error instead.

    ``schema`` needs the columns path and error. The boundary for formats that Spark does not read.
    """
    import pandas as pd

    def rows(batches):
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    out += [{"path": path, "error": None, **r} for r in parse(path, content)]
                except Exception as e:  # noqa: BLE001
                    out.append({"path": path, "error": f"{type(e).__name__}: {e}"[:200]})
            yield pd.DataFrame(out, columns=names, dtype=object)

    names = T._parse_datatype_string(schema).names
    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInPandas(rows, schema)


def keyed_rows(df: DataFrame, key: str, keys: list) -> DataFrame:
    """Exactly one row per key, else an error that names a few keys."""
    got = df.where(F.col(key).isin(keys))
    n = {r[0]: r[1] for r in got.groupBy(key).count().collect()}
    bad = [k for k in keys if n.get(k, 0) != 1]
    if bad:
        raise ValueError(f"{len(bad)} keys without exactly one row, such as {bad[:3]}")
    return got


def role_columns(df: DataFrame, roles: dict[str, str], empty_to_null: tuple[str, ...] = ()) -> DataFrame:
    """Physical columns under their role names; missing ones are refused; empty texts of the named roles become null."""
    require_columns(df, list(roles.values()))
    col = lambda role, name: F.nullif(F.col(name), F.lit("")) if role in empty_to_null else F.col(name)
    return df.select(*[col(role, name).alias(role) for role, name in roles.items()])


def violations(df: DataFrame, checks: dict[str, Column]) -> dict[str, int]:
    """Rows that break each check, in one pass over the table."""
    row = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in checks.items()]).first()
    return {k: row[k] for k in checks}


def refuse(df: DataFrame, checks: dict[str, Column], what: str) -> DataFrame:
    """``df``, or an error that tells how many rows break which check."""
    bad = {k: n for k, n in violations(df, checks).items() if n}
    if bad:
        raise ValueError(f"{what}: {bad}")
    return df
