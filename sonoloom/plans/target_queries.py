"""Derived targets, unit rules, votes and profiles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sonoloom.operators import targets
from sonoloom.plans.common import M, S, manifest, study_rows
from sonoloom.plans.registry import Registry

R = Registry()


@R.add(f"""with {S} select study, ef, case when ef is not null then (ef < 40)::int::double end as low, (case when ef is null then null when ef < 30 then 0 when ef < 40 then 1 when ef < 50 then 2 else 3 end)::double as band,
  case when ef is null and exam is null then null else greatest(coalesce((ef < 40)::int, -1), coalesce((exam = 'ECHO STRESS')::int, -1))::double end as either from s where study is not null""")
def targets_derive(t):
    s = study_rows(t).where("study is not null")
    low = targets.indicator(F.col("ef") < 40, F.col("ef").isNotNull())
    stress = targets.indicator(F.col("exam") == "ECHO STRESS", F.col("exam").isNotNull())
    return s.select("study", "ef", low.alias("low"), targets.banded(F.col("ef"), [30, 40, 50]).alias("band"), targets.any_of([low, stress]).alias("either"))


_COLS = ("label", "n_frames", "fps")


@R.add("with u as (" + " union all ".join(f"select coalesce(split, 'none') as split, '{c}' as target, {c}::double as v from build_manifests" for c in _COLS) + """)
select split, target, count(v) as n, round(count(v) / count(*), 6) as coverage, round(quantile_cont(v, 0.05), 6) as p5, round(quantile_cont(v, 0.5), 6) as median, round(quantile_cont(v, 0.95), 6) as p95, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std from u group by 1, 2""")
def target_profile(t):
    b = t.build_manifests.select(F.coalesce("split", F.lit("none")).alias("split"), *[F.col(c).cast("double").alias(c) for c in _COLS])
    p = targets.profile(b, list(_COLS), ["split"])
    return p.select("split", "target", "n", *[F.round(c, 6).alias(c) for c in ("coverage", "p5", "median", "p95", "mean", "std")])


@R.add("with f as (select avg(label) as m, stddev_pop(label) as s from build_manifests where split = 'train') select row_id, round((label - m) / s, 6) as z from build_manifests, f")
def zscore_train(t):
    b = t.build_manifests.select("row_id", "split", "label")
    return targets.zscore(b, "label", F.col("split") == "train").select("row_id", F.round("label_z", 6).alias("z"))


@R.add("with f as (select avg(ln(n_frames)) as m, stddev_pop(ln(n_frames)) as s from build_manifests where split = 'train' and n_frames > 0) select row_id, round(case when n_frames > 0 then (ln(n_frames) - m) / s end, 6) as z, coalesce(n_frames > 0, false) as present from build_manifests, f")
def log_zscore(t):
    b = t.build_manifests.select("row_id", "split", "n_frames")
    z = targets.log_zscore(b, "n_frames", F.col("split") == "train")
    return z.select("row_id", F.round("n_frames_logz", 6).alias("z"), F.col("n_frames_present").alias("present"))


@R.add("""with x as (select o_orderkey, o_totalprice * power(10.0, (o_orderkey % 7) - 3) as v from orders), m as (select median(v) as med from x where v between 20000 and 60000),
c as (select o_orderkey, v, v * power(10.0, k) as moved, abs(log10(v * power(10.0, k) / med)) as d from x, m, (select unnest([-5,-4,-3,-2,-1,1,2,3,4,5]) as k) where v * power(10.0, k) between 20000 and 60000),
r as (select *, row_number() over (partition by o_orderkey order by d, moved) as k, lead(d) over (partition by o_orderkey order by d, moved) as d2 from c)
select case when v between 20000 and 60000 then 'kept' when r.k is not null and (r.d2 is null or r.d2 - r.d > 0.3) then 'shifted' else 'dropped' end as action, count(*) as n, round(avg(case when x.v between 20000 and 60000 then x.v when r.d2 is null or r.d2 - r.d > 0.3 then r.moved end), 3) as mean
from x left join r using (o_orderkey) where coalesce(r.k, 1) = 1 group by 1""".replace("case when v between 20000 and 60000 then 'kept'", "case when x.v between 20000 and 60000 then 'kept'"))
def decimal_shift_repair(t):
    x = t.orders.select((F.col("o_totalprice") * F.pow(F.lit(10.0), F.col("o_orderkey") % 7 - 3)).alias("v"))
    d = targets.decimal_repair(x, "v", 20000.0, 60000.0)
    return d.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("repaired"), 3).alias("mean"))


@R.add("""with x as (select l_returnflag as unit, l_suppkey, l_quantity as v from lineitem), u as (select * from (values ('A', 0.1), ('N', 1.0)) u(unit, f))
select l_suppkey, round(avg(case when unit = 'A' then v * 0.1 end), 6) as a_cm, round(avg(case when unit = 'N' then v end), 6) as n_cm, count(*) filter (unit not in ('A', 'N')) as n_unknown from x group by 1""")
def unit_rules_pivot(t):
    v = targets.unit_value(F.col("l_quantity"), F.col("l_returnflag"), {"a": 0.1, "n": 1.0})
    x = t.lineitem.select("l_suppkey", "l_returnflag", v.alias("cm"))
    return x.groupBy("l_suppkey").agg(
        F.round(F.avg(F.when(F.col("l_returnflag") == "A", F.col("cm"))), 6).alias("a_cm"), F.round(F.avg(F.when(F.col("l_returnflag") == "N", F.col("cm"))), 6).alias("n_cm"), F.count_if(F.col("cm").isNull()).alias("n_unknown")
    )


@R.add(f"with {M}, c as (select study, view, count(*) as n from m where study is not null group by 1, 2), r as (select *, row_number() over (partition by study order by n desc, view) as k from c) select study, view, n from r where k = 1")
def majority_tag(t):
    c = manifest(t).where("study is not null").groupBy("study", "view").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("study").orderBy(F.col("n").desc(), "view")
    return c.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


_LONG = """k as (select still_row, signed_values, unnest(json_keys(signed_values)) as quantity from radar_stills), x as (select still_row, quantity, unnest((signed_values::json -> ('$."' || quantity || '"'))::double[]) as v from k)"""


def _signed(t):
    m = F.from_json("signed_values", "map<string,array<double>>")
    return t.radar_stills.select("still_row", "manufacturer", F.explode(m).alias("quantity", "vs")).select("still_row", "manufacturer", "quantity", F.explode("vs").alias("v"))


@R.add(f"with {_LONG}, g as (select still_row, quantity, min(v) as lo, max(v) as hi, avg(abs(v)) as mean, count(*) as n from x group by 1, 2) select still_row, quantity, n, case when lo < 0 and hi > 0 then 'mixed' when hi <= 0 then 'negative' else 'positive' end as sign, round(case when not (lo < 0 and hi > 0) then mean end, 6) as value from g")
def signed_mean_targets(t):
    g = _signed(t).groupBy("still_row", "quantity").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg(F.abs("v")).alias("mean"), F.count(F.lit(1)).alias("n"))
    mixed = (F.col("lo") < 0) & (F.col("hi") > 0)
    return g.select("still_row", "quantity", "n", F.when(mixed, "mixed").when(F.col("hi") <= 0, "negative").otherwise("positive").alias("sign"), F.round(F.when(~mixed, F.col("mean")), 6).alias("value"))


@R.add(f"with {_LONG} select quantity, r.manufacturer, count(*) filter (v < 0) as n_negative, count(*) as n from x join radar_stills r using (still_row) group by 1, 2")
def negative_share(t):
    return _signed(t).groupBy("quantity", "manufacturer").agg(F.count_if(F.col("v") < 0).alias("n_negative"), F.count(F.lit(1)).alias("n"))


@R.add(f"with {S} select study, day, case when date_diff('day', try_strptime(day, '%Y%m%d')::date, registered_at::date) between 0 and 3650 then round(date_diff('day', try_strptime(day, '%Y%m%d')::date, registered_at::date) / 365.25, 1) end as age from s where study is not null")
def date_age(t):
    d = F.datediff(F.col("registered_at").cast("date"), F.try_to_date("day", "yyyyMMdd"))
    return study_rows(t).where("study is not null").select("study", "day", F.when(d.between(0, 3650), F.round(d / 365.25, 1)).alias("age"))


@R.add("select still_row, round((spec_y1 - spec_y0) / nullif(img_rows, 0), 6) as height_share, case when spec_y0 < spec_y1 and spec_x0 < spec_x1 then round((spec_x1 - spec_x0) * (spec_y1 - spec_y0), 3) end as area from radar_stills")
def box_calibration(t):
    ok = (F.col("spec_y0") < F.col("spec_y1")) & (F.col("spec_x0") < F.col("spec_x1"))
    return t.radar_stills.select("still_row", F.round((F.col("spec_y1") - F.col("spec_y0")) / F.nullif("img_rows", F.lit(0)), 6).alias("height_share"), F.when(ok, F.round((F.col("spec_x1") - F.col("spec_x0")) * (F.col("spec_y1") - F.col("spec_y0")), 3)).alias("area"))


@R.add(f"with {M}, c as (select study, count(*) as n from m where study is not null group by 1) select round(quantile_cont(n, 0.25), 4) as q25, round(quantile_cont(n, 0.5), 4) as q50, round(quantile_cont(n, 0.9), 4) as q90, max(n) as most, count(*) as n_studies from c")
def group_size_quantiles(t):
    c = manifest(t).where("study is not null").groupBy("study").agg(F.count(F.lit(1)).alias("n"))
    q = F.percentile("n", [0.25, 0.5, 0.9])
    return c.agg(F.round(q[0], 4).alias("q25"), F.round(q[1], 4).alias("q50"), F.round(q[2], 4).alias("q90"), F.max("n").alias("most"), F.count(F.lit(1)).alias("n_studies"))


@R.add(f"with {M}, {S}, k as (select distinct study from s where study is not null) select m.year, count(*) as n, count(k.study) as n_linked, round(count(k.study) / count(*), 6) as rate from m left join k on k.study = m.study where m.year is not null group by 1")
def link_rates_by_year(t):
    k = study_rows(t).select("study").where("study is not null").distinct().withColumn("hit", F.lit(1))
    j = manifest(t).where("year is not null").join(k, "study", "left")
    return j.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("n_linked"), F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("rate"))


QUERIES, SQL = R.queries, R.sql
