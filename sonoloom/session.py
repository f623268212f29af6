"""Session factory and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "sonoloom", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and the bench; on a cluster, spark-submit's own settings win."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SONOLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors reach: ``spark.checkpoint.dir`` if the session has it,
    else a temporary folder, which only a local master may use."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    where = os.path.join(tempfile.gettempdir(), "sonoloom-checkpoints")
    os.makedirs(where, exist_ok=True)
    return f"file://{where}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder for a table written between stages."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def write_scratch(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back. What is not dropped before goes when the driver ends."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).deleteOnExit(p)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop_scratch(*tables: DataFrame | None) -> None:
    """Delete tables of :func:`write_scratch` that no plan reads any more."""
    for df in tables:
        if df is not None and (path := getattr(df, "_scratch_path", None)):
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
