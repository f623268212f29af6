"""Structured Streaming over event tables: dedup, windows, sessions, custom state, idempotent sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, root: str, name: str = "events", files_per_batch: int = 1) -> DataFrame:
    """File stream of a table's Parquet files, with event time as a session timestamp."""
    schema = spark.read.parquet(f"{root}/{name}.parquet").schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", f"{name}.parquet").parquet(root)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """First event of each key; state is dropped once the watermark has passed."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def tumbling(events: DataFrame, width: str, by: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, width: str, step: str, by: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str, by: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def running_profile(events: DataFrame, by: str = "user_id") -> DataFrame:
    """Count, least, greatest and mean value per key over all batches: built-in aggregates, for update or complete mode."""
    return events.groupBy(by).agg(F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"))


def quiet_keys(events: DataFrame, by: str, gap: str, late: str = "1 hour") -> DataFrame:
    """by, n, last: keys that fell silent for ``gap`` of event time (custom state with a timeout, so state of silent keys is freed)."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({by: [key[0]], "n": [n], "last": [pd.Timestamp(last, unit="us")]})
            return
        for pdf in batches:
            if len(pdf):
                n, last = n + len(pdf), max(last, int(pdf["ts"].max().value // 1000))
        state.update((n, last))
        state.setTimeoutTimestamp(max(last // 1000 + wait, state.getCurrentWatermarkMs() + 1))

    wait = int(pd.Timedelta(gap).total_seconds() * 1000)
    rows = events.select(by, F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return rows.groupBy(by).applyInPandasWithState(update, f"{by} long, n long, last timestamp", "n long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def metric_sink(stream: DataFrame, path: str, checkpoint: str, hidden: tuple[str, ...] = ()) -> list[dict]:
    """Run to the end; each batch leaves one line of numbers (batch, rows, sums of the numeric columns), columns in ``hidden`` left out. Returns the lines.

    A batch that runs again replaces its own line, so a resumed run repeats nothing.
    """
    numeric = [c for c, t in stream.dtypes if t in ("int", "bigint", "float", "double") and c not in hidden]

    def put(df: DataFrame, batch: int) -> None:
        df.agg(F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(f"sum_{c}") for c in numeric]).withColumn("batch", F.lit(batch)).write.mode("overwrite").json(f"{path}/batch={batch}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    lines = stream.sparkSession.read.option("basePath", path).json(f"{path}/batch=*")
    return [r.asDict() for r in lines.orderBy("batch").collect()]


def with_deadline(run, seconds: float):
    """``run(record)`` -> (status, result): ``done``, ``failed`` (with the error) or ``late`` if it takes longer than ``seconds``. For use inside mapInPandas."""
    from concurrent.futures import ThreadPoolExecutor
    from concurrent.futures import TimeoutError as Late

    def timed(record) -> tuple[str, object]:
        pool = ThreadPoolExecutor(1)
        try:
            return "done", pool.submit(run, record).result(seconds)
        except Late:
            return "late", None
        except Exception as e:  # noqa: BLE001
            return "failed", f"{type(e).__name__}: {e}"
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    return timed


def write_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run to the end of what is there; each batch goes to its own folder, so a repeated batch replaces itself."""

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def shard_stream(spark: SparkSession, path: str, schema: str, world: int = 1, rank: int = 0, files_per_batch: int = 8) -> DataFrame:
    """Rows of a folder of Parquet shards as they arrive, those of this node only (a hash of the shard's name), with the shard's name; broken files are skipped."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("ignoreCorruptFiles", True).option("recursiveFileLookup", True).parquet(path)
    named = rows.withColumn("shard", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    return named if world == 1 else named.where(F.pmod(F.xxhash64("shard"), F.lit(world)) == rank)
