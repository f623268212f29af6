"""Event-time windows in batch and as streams, and a few star-schema aggregates."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from sonoloom.operators import relational
from sonoloom.plans.registry import Registry
from sonoloom.session import scratch_path
from sonoloom.streaming import events as stream

R = Registry()


@R.add("select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def event_tumbling(t):
    g = t.events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


@R.add("""with e as (select *, time_bucket(interval 1 hour, ts) as b from events) select b - k * interval 1 hour as start, count(*) as n, round(avg(value), 9) as mean from e, range(3) r(k) group by 1""")
def event_sliding(t):
    g = t.events.groupBy(F.window("ts", "3 hours", "1 hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 9).alias("mean"))
    return g.select(F.col("window.start").alias("start"), "n", "mean")


_SESSION = """g as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 6 hour then 0 else 1 end as new from events),
s as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from g)"""


@R.add(f"with {_SESSION} select user_id, min(ts) as start, count(*) as n, round(sum(value), 4) as total from s group by user_id, session")
def event_session(t):
    g = t.events.groupBy(F.session_window("ts", "6 hours"), "user_id").agg(F.min("ts").alias("start"), F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select("user_id", "start", "n", "total")


@R.add("select event_id, round(avg(value) over (partition by event_type order by epoch_us(ts) range between 3600000000 preceding and current row), 9) as mean_1h from events")
def event_rolling_range(t):
    e = t.events.select("event_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    out = relational.rolling_range(e, "event_type", "us", 3_600_000_000, {"mean_1h": F.avg("value")})
    return out.select("event_id", F.round("mean_1h", 9).alias("mean_1h"))


@R.add("select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as k from events) where k = 1")
def event_dedup_first(t):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return t.events.withColumn("k", F.row_number().over(w)).where("k = 1").select("user_id", "event_type", "event_id", "value")


@R.add("select event_id, round((epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id))) / 1e6, 3) as gap_s, coalesce(value = lag(value) over (partition by user_id order by ts, event_id), false) as repeated from events")
def event_lag_gap(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return t.events.select("event_id", F.round((us - F.lag(us).over(w)) / 1e6, 3).alias("gap_s"), F.coalesce(F.col("value") == F.lag("value").over(w), F.lit(False)).alias("repeated"))


@R.add("select event_type, (props ->> '$.k')::int % 10 as bucket, count(*) as n from events group by 1, 2")
def json_props_profile(t):
    return t.events.groupBy("event_type", (F.get_json_object("props", "$.k").cast("int") % 10).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@R.add("select event_id, round(avg(value) over (partition by user_id order by ts, event_id rows between 4 preceding and current row), 9) as smooth, round(max(value) over (partition by user_id order by ts, event_id rows between 4 preceding and current row), 9) as peak from events")
def smoothed_value(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return t.events.select("event_id", F.round(F.avg("value").over(w), 9).alias("smooth"), F.round(F.max("value").over(w), 9).alias("peak"))


def _run(t, build, mode):
    path = scratch_path(t.spark, "stream")
    stream.write_batches(build(stream.event_stream(t.spark, t.root)), f"{path}/out", f"{path}/check-{uuid.uuid4().hex}", mode)
    return t.spark.read.parquet(f"{path}/out")


@R.add("select event_type, count(*) as n, round(sum(value), 4) as total from events group by 1")
def stream_totals(t):
    out = _run(t, lambda e: e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), "complete")
    last = out.agg(F.max("batch")).first()[0]
    return out.where(F.col("batch") == last).select("event_type", "n", F.round("total", 4).alias("total"))


@R.add("select user_id, count(value) as n, min(value) as low, max(value) as high, round(avg(value), 9) as mean from events group by 1")
def stream_running_profile(t):
    out = _run(t, stream.running_profile, "update")
    w = Window.partitionBy("user_id").orderBy(F.col("batch").desc())
    return out.withColumn("k", F.row_number().over(w)).where("k = 1").select("user_id", "n", "low", "high", F.round("mean", 9).alias("mean"))


@R.add("select event_id, user_id, event_type from events")
def stream_dedup(t):
    twice = lambda e: stream.deduplicated(e.unionByName(e), "event_id").select("event_id", "user_id", "event_type")
    return _run(t, twice, "append").drop("batch")


@R.add("""select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc, round(avg(l_discount), 6) as avg_disc, count(*) as n
from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""")
def star_pricing_summary(t):
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return t.lineitem.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz")).groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(price), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n")
    )


@R.add("""select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey and s_nationkey = c_nationkey join nation on n_nationkey = s_nationkey group by 1""")
def star_local_supplier(t):
    j = t.lineitem.select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount").join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(t.customer.select("c_custkey", "c_nationkey"), (F.col("o_custkey") == F.col("c_custkey")) & (F.col("s_nationkey") == F.col("c_nationkey"))).join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


QUERIES, SQL = R.queries, R.sql
