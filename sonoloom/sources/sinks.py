"""Sinks: split manifests, commit markers, read-back checks, all-or-nothing folders, resumable appends."""

from __future__ import annotations

import json
import os
from html import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonoloom.session import drop_scratch, write_scratch


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def ensure_outside(path: str, forbidden: str) -> str:
    """Refuse an output inside a folder (such as a repository)."""
    a, b = os.path.realpath(path), os.path.realpath(forbidden)
    if os.path.commonpath([a, b]) == b:
        raise ValueError(f"{path} lies inside {forbidden}")
    return path


def publish(df: DataFrame, path: str, write) -> str:
    """Write privately with ``write(df, temporary path)``, then rename: readers see all of it or nothing. Refuses an existing folder."""
    spark = df.sparkSession
    temporary = path.rstrip("/") + ".partial"
    target, fs = _fs(spark, path)
    if fs.exists(target):
        raise ValueError(f"{path} exists")
    part, _ = _fs(spark, temporary)
    fs.delete(part, True)
    write(df, temporary)
    if not fs.rename(part, target):
        raise OSError(f"could not publish {path}")
    return path


def write_marker(spark: SparkSession, path: str, info: dict) -> None:
    """``info`` as JSON beside an output, written last."""
    p, fs = _fs(spark, path.rstrip("/") + ".info.json")
    out = fs.create(p, True)
    try:
        out.write(bytearray(json.dumps(info, sort_keys=True, default=str).encode()))
    finally:
        out.close()


def read_marker(spark: SparkSession, path: str) -> dict | None:
    """The marker of a finished output, or None."""
    p, fs = _fs(spark, path.rstrip("/") + ".info.json")
    if not fs.exists(p):
        return None
    return json.loads("\n".join(r[0] for r in spark.read.text(str(p.toString())).collect()))


def _row_hash(columns: list[str]):
    cells = [F.coalesce(F.to_json(F.struct(F.col(f"`{c}`"))), F.lit("")) for c in sorted(columns)]
    return F.sha2(F.concat_ws("\u0001", *cells), 256)


def _digest_parts(h) -> list:
    half = lambda a: F.sum(F.conv(F.substring(h, a, 12), 16, 10).cast("decimal(38,0)"))
    return [F.count(F.lit(1)), half(1), half(13)]


def _digest_text(n: int, a, b) -> str:
    return f"{n}-{int(a or 0):x}-{int(b or 0):x}"


def content_digest(df: DataFrame) -> str:
    """Digest of the rows, whatever their order: sums of two hash halves, computed on the executors."""
    return _digest_text(*df.agg(*_digest_parts(_row_hash(df.columns))).first())


def write_split_manifests(df: DataFrame, path: str, split: str = "split", columns: tuple[str, str] = ("path", "label")) -> dict:
    """One space-separated headerless folder per split and a marker with counts and digests; returns the marker.

    One write for all splits and one grouped aggregate; rows without a split are left out.
    """
    spark = df.sparkSession
    rows = df.where(F.col(split).isNotNull()).select(F.col(split).cast("string").alias("_split"), *columns)
    rows.select("_split", F.concat_ws(" ", *columns).alias("value")).write.partitionBy("_split").text(f"{path}/.all")
    parts = rows.groupBy("_split").agg(*_digest_parts(_row_hash(list(columns)))).collect()
    info = {r[0]: {"rows": r[1], "digest": _digest_text(*r[1:])} for r in parts}
    for s in sorted(info):
        source, fs = _fs(spark, f"{path}/.all/_split={s}")
        fs.rename(source, _fs(spark, f"{path}/{s}")[0])
    done, fs = _fs(spark, f"{path}/.all")
    fs.delete(done, True)
    write_marker(spark, path, {"splits": info, "complete": True})
    return info


def differs(written: DataFrame, expected: DataFrame) -> tuple[int, int]:
    """Rows missing from and rows too many in what was written (with repeats)."""
    a, b = expected.select(*expected.columns), written.select(*expected.columns)
    return a.exceptAll(b).count(), b.exceptAll(a).count()


def append_missing(df: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key is not in the Parquet folder yet; returns their number. A restart skips what is done."""
    spark = df.sparkSession
    target, fs = _fs(spark, path)
    if fs.exists(target):
        df = df.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    df = df.cache()
    try:
        n = df.count()
        if n:
            df.write.mode("append").parquet(path)
        return n
    finally:
        df.unpersist()


def merge_shards(shards: list[DataFrame], key: str, provenance: str, expected: DataFrame | None = None) -> DataFrame:
    """Union of shards of one provenance; refuses mixed provenance, repeated keys, and missing or unknown keys."""
    union = shards[0]
    for s in shards[1:]:
        union = union.unionByName(s)
    row = union.agg(F.countDistinct(provenance), F.count(F.lit(1)), F.countDistinct(key)).first()
    if row[0] > 1 or row[1] != row[2]:
        raise ValueError(f"{row[0]} provenances, {row[1] - row[2]} repeated keys")
    if expected is not None:
        missing, extra = expected.select(key).subtract(union.select(key)).count(), union.select(key).subtract(expected.select(key)).count()
        if missing or extra:
            raise ValueError(f"{missing} keys missing, {extra} unknown")
    return union


def markdown(df: DataFrame, rows: int = 100) -> str:
    """First rows of a small report as a Markdown table; a last line says how many rows are not shown."""
    got = df.limit(rows + 1).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(cell(v) for v in r) + " |" for r in got[:rows]]
    return "\n".join([*lines, *([f"{df.count() - rows} more rows are not shown."] if len(got) > rows else [])])


def write_groups(df: DataFrame, path: str, group: str, format: str = "csv") -> None:
    """One folder of files per value of ``group``, in one write; the rows of a group are brought together first."""
    df.repartition(group).write.partitionBy(group).format(format).option("header", True).save(path)


def write_pages(df: DataFrame, path: str, order: list[str], per_page: int, title: str = "page") -> int:
    """HTML pages of ``per_page`` rows in the order of the columns, a file a page; returns the number of pages.

    The range sort and the place of each row are worked out on the executors (two-level:
    rows per partition, then a running count of partitions), each page is made in its own task group.
    """
    columns = df.columns
    sorted_rows = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id())
    held = write_scratch(sorted_rows, "pages")
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))  # a row per partition
    ranked = held.join(F.broadcast(before), "_part").withColumn("_r", F.row_number().over(Window.partitionBy("_part").orderBy("_k")) + F.col("_before") - 1)
    paged = ranked.select(F.floor(F.col("_r") / per_page).cast("long").alias("page"), "_r", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])

    def html(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = "".join("<tr>" + "".join(f"<td>{escape(v)}</td>" for v in r) + "</tr>" for r in pdf.sort_values("_r")[columns].itertuples(index=False))
        head = "".join(f"<th>{escape(c)}</th>" for c in columns)
        return pd.DataFrame({"page": [key[0]], "value": [f"<html><title>{escape(title)} {key[0] + 1}</title><table><tr>{head}</tr>{rows}</table></html>"]})

    pages = paged.groupBy("page").applyInPandas(html, "page long, value string")
    pages.write.partitionBy("page").text(path)
    n = -(-held.count() // per_page)
    drop_scratch(held)
    return n


def append_log(df: DataFrame, path: str, formats: dict[str, str]) -> None:
    """Append rows to a folder of CSV lines, each column by its printf format; null cells stay empty."""
    cells = [F.coalesce(F.format_string(f, F.col(c)), F.lit("")) if "%s" in f else F.when(F.col(c).isNotNull(), F.format_string(f, F.col(c))).otherwise("") for c, f in formats.items()]
    df.select(F.concat_ws(",", *cells)).write.mode("append").text(path)


def keep_json_lines(spark: SparkSession, path: str, out: str, keep) -> None:
    """Copy the JSON lines whose parsed record passes ``keep`` (a function of the frame's columns), each line as it was written."""
    lines = spark.read.text(path)
    fields = spark.read.json(path)
    parsed = lines.withColumn("_x", F.from_json("value", fields.schema))
    parsed.select("value", "_x.*").where(keep).select("value").write.text(out)


def write_vectors(df: DataFrame, path: str, key: str, vector: str, files: int = 16) -> None:
    """Vectors with their digest, clustered by key."""
    h = F.sha2(F.array_join(F.transform(vector, lambda x: x.cast("string")), ","), 256)
    df.select(key, vector).withColumn("sha256", h).repartition(files, key).sortWithinPartitions(key).write.parquet(path)


def broken_vectors(spark: SparkSession, path: str, vector: str) -> DataFrame:
    """Stored vectors whose digest no longer fits."""
    h = F.sha2(F.array_join(F.transform(vector, lambda x: x.cast("string")), ","), 256)
    return spark.read.parquet(path).where(h != F.col("sha256"))
