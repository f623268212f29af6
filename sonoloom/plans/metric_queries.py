"""Metrics over the stand-in predictions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sonoloom.functions.hashing import hash_int_sql, hash_unit, hash_unit_sql
from sonoloom.operators import metrics
from sonoloom.plans.common import M, P, manifest, predictions
from sonoloom.plans.registry import Registry

R = Registry()

_REG_SQL = """count(*) as n, round(avg(abs(p - y)), 6) as mae, round(sqrt(avg((p - y) * (p - y))), 6) as rmse, round(avg(p - y), 6) as bias,
  round(1 - sum((p - y) * (p - y)) / nullif(var_pop(y) * count(*), 0), 6) as r2, round(covar_pop(y, p) / nullif(stddev_pop(y) * stddev_pop(p), 0), 6) as pearson"""


def _rounded(columns, digits=6):
    return [columns[0], *[F.round(c, digits).alias(n) for c, n in zip(columns[1:], ("mae", "rmse", "bias", "r2", "pearson"))]]


@R.add(f"with {P} select {_REG_SQL} from p")
def metric_regression(t):
    return predictions(t).agg(*_rounded(metrics.regression(F.col("y"), F.col("p"))))


@R.add(f"with {P} select site, {_REG_SQL} from p group by 1")
def metric_regression_by_site(t):
    return predictions(t).groupBy("site").agg(*_rounded(metrics.regression(F.col("y"), F.col("p"))))


@R.add(f"with {P}, g as (select study, max(y) as y, avg(p) as p, count(*) as n_videos, max(y) - min(y) > 1e-6 as spread from p group by 1) select round(avg(abs(p - y)), 6) as mae, count(*) as n_studies, sum(n_videos)::bigint as n_videos, count(*) filter (spread) as n_inconsistent from g")
def metric_by_study(t):
    g = predictions(t).groupBy("study").agg(F.max("y").alias("y"), F.avg("p").alias("p"), F.count(F.lit(1)).alias("n_videos"), (F.max("y") - F.min("y") > 1e-6).alias("spread"))
    return g.agg(F.round(F.avg(F.abs(F.col("p") - F.col("y"))), 6).alias("mae"), F.count(F.lit(1)).alias("n_studies"), F.sum("n_videos").alias("n_videos"), F.count_if("spread").alias("n_inconsistent"))


@R.add(f"""with {P}, b as (select * from (values (0, -1e9, 30.0), (1, 30.0, 40.0), (2, 40.0, 50.0), (3, 50.0, 60.0), (4, 60.0, 1e9)) b(bin, low, high))
select b.bin, count(p.y) as n, round(avg(abs(p.p - p.y)), 6) as mae, round(avg(p.p - p.y), 6) as bias from b left join p on p.y >= b.low and p.y < b.high group by 1""")
def metric_by_range(t):
    bins = t.spark.range(5).select(F.col("id").cast("int").alias("bin"))
    p = predictions(t)
    bin_of = F.expr("case when y < 30 then 0 when y < 40 then 1 when y < 50 then 2 when y < 60 then 3 else 4 end")
    g = p.groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("p") - F.col("y"))), 6).alias("mae"), F.round(F.avg(F.col("p") - F.col("y")), 6).alias("bias"))
    return bins.join(g, "bin", "left").na.fill(0, ["n"])


_RANKS = "select low, prob as s, rank() over (order by prob) + (count(*) over (partition by prob) - 1) / 2.0 as r from p"


@R.add(f"with {P}, r as ({_RANKS}) select sum(low::int)::bigint as n_pos, sum((not low)::int)::bigint as n_neg, round((sum(r) filter (low) - sum(low::int) * (sum(low::int) + 1) / 2) / sum(low::int) / sum((not low)::int), 9) as auroc from r")
def metric_auroc(t):
    return metrics.auroc(predictions(t), "low", "prob").select("n_pos", "n_neg", F.round("auroc", 9).alias("auroc"))


@R.add(f"""with {P}, r as (select site, low, rank() over (partition by site order by prob) + (count(*) over (partition by site, prob) - 1) / 2.0 as r from p)
select site, sum(low::int)::bigint as n_pos, sum((not low)::int)::bigint as n_neg, round((sum(r) filter (low) - sum(low::int) * (sum(low::int) + 1) / 2) / nullif(sum(low::int), 0) / nullif(sum((not low)::int), 0), 9) as auroc from r group by 1""")
def metric_auroc_by_site(t):
    g = metrics.grouped_auroc(predictions(t), ["site"], "low", "prob")
    return g.select("site", "n_pos", "n_neg", F.round("auroc", 9).alias("auroc"))


@R.add(f"""with {P}, g as (select prob, sum(low::int) as pos, count(*) as n from p group by 1), c as (select pos, sum(pos) over (order by prob desc) as tp, sum(n) over (order by prob desc) as k, sum(pos) over () as total from g)
select max(total)::bigint as n_pos, round(sum(pos * tp / k) / max(total), 9) as average_precision from c""")
def metric_average_precision(t):
    return metrics.average_precision(predictions(t), "low", "prob").select("n_pos", F.round("average_precision", 9).alias("average_precision"))


@R.add(f"""with {P}, g as (select p as s, sum(low::int) as pos, count(*) as n from p group by 1),
c as (select s, lead(s) over (order by s) as nxt, sum(pos) over (order by s) as cpos, sum(n - pos) over (order by s) as cneg, sum(pos) over () as tp, sum(n - pos) over () as tn from g),
k as (select (s + nxt) / 2 as th, cpos / tp - cneg / tn as j from c where nxt is not null and tp > 0 and tn > 0 union all select min(s) - 1, 0 from c where tp > 0 and tn > 0 having count(*) > 0 union all select max(s) + 1, 0 from c where tp > 0 and tn > 0 having count(*) > 0)
select round(th, 6) as threshold, round(j, 6) as youden_j from k order by round(j, 12) desc, abs(th - 40), 1 limit 1""")
def metric_youden(t):
    p = predictions(t).withColumn("inv", -F.col("p"))
    best = metrics.youden(p, "low", "inv", -40.0)
    return best.select(F.round(-F.col("threshold"), 6).alias("threshold"), F.round("youden_j", 6).alias("youden_j"))


@R.add(f"""with {P} select site, count(*) filter (prob >= 0.5 and low)::double as tp, count(*) filter (prob >= 0.5 and not low)::double as fp, count(*) filter (prob < 0.5 and low)::double as fn, count(*) filter (prob < 0.5 and not low)::double as tn,
  round(count(*) filter (prob >= 0.5 and low) / nullif(count(*) filter (low), 0), 6) as sensitivity, round(count(*) filter (prob < 0.5 and not low) / nullif(count(*) filter (not low), 0), 6) as specificity,
  round(count(*) filter (prob >= 0.5 and low) / nullif(count(*) filter (prob >= 0.5), 0), 6) as precision from p group by 1""")
def metric_confusion(t):
    c = metrics.confusion(F.col("prob") >= 0.5, F.col("low"))
    names = ["tp", "fp", "fn", "tn"]
    g = predictions(t).groupBy("site").agg(*c)
    return g.select("site", *names, *[F.round(x, 6).alias(x) for x in ("sensitivity", "specificity", "precision")])


@R.add(f"""with {P}, b as (select least(floor(prob * 10), 9) as bin, count(*) as n, avg(prob) as mp, avg(low::int) as o from p group by 1)
select round(sum(n * abs(mp - o)) / sum(n), 9) as ece from b""")
def metric_ece(t):
    return metrics.expected_calibration_error(predictions(t), "low", "prob").select(F.round("ece", 9).alias("ece"))


@R.add(f"with {P} select least(floor(prob * 10), 9)::int as bin, count(*) as n, round(avg(prob), 6) as mean_p, round(avg(low::int), 6) as observed from p group by 1")
def metric_calibration_bins(t):
    return metrics.calibration_bins(predictions(t), "low", "prob").select("bin", "n", F.round("mean_p", 6).alias("mean_p"), F.round("observed", 6).alias("observed"))


def _newton_sql(k: int) -> str:
    """One Newton step of the logistic fit, from (a, b) of ``n{k}`` to those of the next."""
    return f"""n{k + 1} as (select a + (hxx * g - hx * gx) / (h * hxx - hx * hx) as a, b + (h * gx - hx * g) / (h * hxx - hx * hx) as b from (
  select any_value(a) as a, any_value(b) as b, sum(n * m * (1 - m)) as h, sum(n * m * (1 - m) * x) as hx, sum(n * m * (1 - m) * x * x) as hxx, sum(k - n * m) as g, sum((k - n * m) * x) as gx
  from (select lv.*, a, b, 1 / (1 + exp(-(a + b * x))) as m from lv, n{k})))"""


@R.add(f"""with {P}, q as (select low, greatest(least(prob, 1 - 1e-6), 1e-6) as q from p where low is not null and prob is not null), lv as (select ln(q / (1 - q)) as x, count(*) as n, sum(low::int) as k from q group by 1),
n0 as (select 0.0::double as a, 1.0::double as b), {', '.join(_newton_sql(k) for k in range(8))} select round(a, 5) as intercept, round(b, 5) as slope from n8""")
def calibration_line(t):
    a, b = metrics.calibration_line(predictions(t), "low", "prob")
    got = t.spark.createDataFrame([(a, b)], "intercept double, slope double")
    return got.select(F.round("intercept", 5).alias("intercept"), F.round("slope", 5).alias("slope"))


@R.add(f"""with {P}, q as (select view as truth, case when {hash_unit_sql('view', 'row_id')} < 0.8 then view else 'A4C' end as predicted from p),
a as (select truth as cls, count(*) as support, count(*) filter (truth = predicted) as hits from q group by 1), b as (select predicted as cls, count(*) as n_predicted from q group by 1)
select cls, coalesce(support, 0) as support, coalesce(n_predicted, 0) as n_predicted, round(hits / support, 6) as recall, round(hits / n_predicted, 6) as precision, round(2 * hits / (support + n_predicted), 6) as f1 from a full join b using (cls)""")
def metric_macro(t):
    q = predictions(t).withColumn("predicted", F.when(hash_unit("view", F.col("row_id")) < 0.8, F.col("view")).otherwise("A4C"))
    g = metrics.macro_by_class(q, "view", "predicted")
    return g.select("cls", "support", "n_predicted", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "f1")])


@R.add(f"""with {P} select view, count(*) as n, round(covar_pop(y, p) / nullif(stddev_pop(y) * stddev_pop(p), 0), 6) as r, round(avg(p - y), 6) as bias, round(avg(p - y) - 1.96 * stddev_pop(p - y), 6) as loa_low, round(avg(p - y) + 1.96 * stddev_pop(p - y), 6) as loa_high,
  round(avg(abs(p - y)), 6) as mae, round(100 * avg(abs((p - y) / y)), 6) as mape from p group by 1""")
def metric_agreement(t):
    g = predictions(t).groupBy("view").agg(*metrics.agreement(F.col("y"), F.col("p")))
    return g.select("view", "n", *[F.round(c, 6).alias(c) for c in ("r", "bias", "loa_low", "loa_high", "mae", "mape")])


@R.add(f"with {P} select split, round(avg(case when abs(p - y) < 1 then 0.5 * (p - y) * (p - y) else abs(p - y) - 0.5 end), 6) as loss from p group by 1")
def metric_smooth_l1(t):
    return predictions(t).groupBy("split").agg(F.round(metrics.smooth_l1(F.col("y"), F.col("p")), 6).alias("loss"))


@R.add(f"""with {P}, g as (select site, round(avg(p - y), 9) as v from p where site is not null group by 1), x as (select v, row_number() over (order by site) - 1 as pos, count(*) over () as n from g),
d as (select r.range as rep, i.range as i, {hash_int_sql('boot', 'r.range', 'i.range')} as h from range(200) r, range((select max(n) from x)) i),
mm as (select d.rep, avg(x.v) as mean from d join x on x.pos = d.h % x.n group by 1) select round(quantile_cont(mean, 0.025), 6) as low, round(quantile_cont(mean, 0.5), 6) as mid, round(quantile_cont(mean, 0.975), 6) as high, count(*) as reps from mm""")
def bootstrap_cluster_ci(t):
    g = predictions(t).where("site is not null").groupBy("site").agg(F.round(F.avg(F.col("p") - F.col("y")), 9).alias("v"))
    n = g.count()
    x = g.withColumn("at", F.row_number().over(Window.partitionBy().orderBy("site")).cast("long") - 1)
    m = metrics.bootstrap_means(x, "v", "at", n, 200, "boot", t.spark.range(200))
    q = F.percentile("mean", [0.025, 0.5, 0.975])
    return m.agg(F.round(q[0], 6).alias("low"), F.round(q[1], 6).alias("mid"), F.round(q[2], 6).alias("high"), F.count(F.lit(1)).alias("reps"))


@R.add(f"""with {P}, g as (select coalesce(site, 'None') as site, round(sum(p - y), 6) as s, count(p - y) as c from p group by 1), x as (select s, c, row_number() over (order by site) - 1 as pos, count(*) over () as n from g),
d as (select r.range as rep, i.range as i, {hash_int_sql('boot', 'r.range', 'i.range')} as h from range(1000) r, range((select max(n) from x)) i),
mm as (select d.rep, sum(x.s) / nullif(sum(x.c), 0) as value from d join x on x.pos = d.h % x.n group by 1) select round(quantile_cont(value, 0.025), 6) as low, round(quantile_cont(value, 0.5), 6) as mid, round(quantile_cont(value, 0.975), 6) as high, count(value) as reps from mm""")
def bootstrap_cluster_pooled_ci(t):
    e = F.col("p") - F.col("y")
    g = predictions(t).groupBy(F.coalesce("site", F.lit("None")).alias("site")).agg(F.round(F.sum(e), 6).alias("s"), F.count(e).alias("c"))
    x = g.withColumn("at", F.row_number().over(Window.partitionBy().orderBy("site")).cast("long") - 1)
    m = metrics.bootstrap_ratios(x, "s", "c", "at", g.count(), t.spark.range(1000), "boot")
    q = F.percentile("value", [0.025, 0.5, 0.975])
    return m.agg(F.round(q[0], 6).alias("low"), F.round(q[1], 6).alias("mid"), F.round(q[2], 6).alias("high"), F.count("value").alias("reps"))


_WILSON = "count(*) filter (low) as k, count(*) as n"


@R.add(f"""with {P}, g as (select site, {_WILSON} from p group by 1), w as (select *, k / n as q, 1.96 as z from g)
select site, k, n, round((q + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(q * (1 - q) / n + z * z / (4 * n * n)) / (1 + z * z / n), 4) as ci_low,
  round((q + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(q * (1 - q) / n + z * z / (4 * n * n)) / (1 + z * z / n), 4) as ci_high from w""")
def wilson_ci(t):
    g = predictions(t).groupBy("site").agg(F.count_if("low").alias("k"), F.count(F.lit(1)).alias("n"))
    lo, hi = metrics.wilson(F.col("k"), F.col("n"))
    return g.select("site", "k", "n", F.round(lo, 4).alias("ci_low"), F.round(hi, 4).alias("ci_high"))


def _bound_sql(q: float, upper: bool) -> str:
    """Bisection on the binomial tail in SQL: column ``x`` per view."""
    terms = "range(0, k + 1)" if upper else "range(k, n + 1)"
    tail = f"list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln((lo + hi) / 2) + (n - i) * ln(1 - (lo + hi) / 2)) for i in {terms}])"
    # Above the bound the lower tail is under 1 - q; below it the upper tail is under q.
    left = f"{tail} > {1 - q}" if upper else f"{tail} < {q}"
    edge = "case when k >= n then 1.0 else (lo + hi) / 2 end" if upper else "case when k = 0 then 0.0 else (lo + hi) / 2 end"
    return f"""(with recursive r as (select view, k::bigint as k, n::bigint as n, 0.0::double as lo, 1.0::double as hi, 0 as step from g
 union all select view, k, n, case when {left} then (lo + hi) / 2 else lo end, case when {left} then hi else (lo + hi) / 2 end, step + 1 from r where step < 40)
 select view, {edge} as x from r where step = 40)"""


_VIEW_COUNTS = f"with {P}, g as (select view, count(*) filter (low) as k, count(*) as n from p group by 1)"


@R.add(f"{_VIEW_COUNTS} select g.view, k, n, round(x, 6) as upper from g join {_bound_sql(0.95, True)} b using (view)")
def clopper_pearson(t):
    g = predictions(t).groupBy("view").agg(F.count_if("low").alias("k"), F.count(F.lit(1)).alias("n"))
    return g.select("view", "k", "n", F.round(metrics.exact_upper(F.col("k"), F.col("n")), 6).alias("upper"))


@R.add(f"{_VIEW_COUNTS} select g.view, k, n, round(l.x, 6) as low, round(u.x, 6) as high from g join {_bound_sql(0.025, False)} l using (view) join {_bound_sql(0.975, True)} u using (view)")
def exact_two_sided(t):
    g = predictions(t).groupBy("view").agg(F.count_if("low").alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = metrics.exact_interval(F.col("k"), F.col("n"))
    return g.select("view", "k", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


_BANDS = (("low", "y < 40", 35.0), ("middle", "y >= 40 and y < 55", 47.0), ("high", "y >= 55", 62.0))


def _ranks_sql(score: str, positive: str, groups: str) -> str:
    """AUROC by mean ranks per group in SQL."""
    return f"""(select {groups}, n_pos, n_neg, (ranks - n_pos * (n_pos + 1) / 2) / nullif(n_pos * n_neg, 0) as auroc from (
  select {groups}, sum(pos)::bigint as n_pos, sum(n - pos)::bigint as n_neg, sum(pos * (upto - (n - 1) / 2)) as ranks from (
    select {groups}, s, sum(pos) as pos, sum(n) as n, sum(sum(n)) over (partition by {groups} order by s) as upto from (select {groups}, {score} as s, ({positive})::int as pos, 1 as n from e) group by {groups}, s) group by {groups}))"""


@R.add(f"""with {P}, e as (select case when y < 40 then 'low' when y < 55 then 'middle' else 'high' end as truth, c.cls, -abs(p - c.mid) as s from p, (values {', '.join(f"('{n}', {m})" for n, _, m in _BANDS)}) c(cls, mid))
select cls, n_pos, n_neg, round(auroc, 9) as auroc from {_ranks_sql('s', 'truth = cls', 'cls')} where n_pos > 0""")
def auroc_one_versus_rest(t):
    truth = F.when(F.col("y") < 40, "low").when(F.col("y") < 55, "middle").otherwise("high")
    scores = F.create_map(*[x for name, _, mid in _BANDS for x in (F.lit(name), -F.abs(F.col("p") - mid))])
    g = metrics.auroc_one_versus_rest(predictions(t).withColumn("truth", truth), "truth", scores)
    return g.select("cls", "n_pos", "n_neg", F.round("auroc", 9).alias("auroc"))


@R.add(f"""with {P}, e as (select coalesce(split, 'none') as part, -p as s, low from p) select part, n_pos, n_neg, round(n_pos / (n_pos + n_neg), 6) as prevalence, round(auroc, 9) as auroc from {_ranks_sql('s', 'low', 'part')}""")
def inverted_score_metrics(t):
    e = predictions(t).select(F.coalesce("split", F.lit("none")).alias("part"), "low", (-F.col("p")).alias("s"))
    g = metrics.grouped_auroc(e, ["part"], "low", "s")
    return g.select("part", "n_pos", "n_neg", F.round(F.try_divide(F.col("n_pos"), F.col("n_pos") + F.col("n_neg")), 6).alias("prevalence"), F.round("auroc", 9).alias("auroc"))


@R.add(f"""with {M}, r as (select site, label is not null as labelled, n_frames >= 30 as supported, label < 40 as positive from m)
select site, count(*) as n, count(*) filter (labelled) as n_labelled, count(*) filter (supported) as n_supported, count(*) filter (labelled and supported) as n_used,
  round(count(*) filter (labelled and supported) / nullif(count(*) filter (labelled), 0), 6) as coverage, count(*) filter (positive and not coalesce(supported, false)) as unsupported_positives from r group by 1""")
def coverage_report(t):
    m = manifest(t)
    g = m.groupBy("site").agg(*metrics.coverage_report(F.col("label").isNotNull(), F.col("n_frames") >= 30, F.col("label") < 40))
    return g.withColumn("coverage", F.round("coverage", 6))


@R.add(f"with {P}, h as (select view, avg(abs(p - y)) as mae, avg((p - y) ** 2) as mse, count(*) as n from p group by 1) select round(sum((case view when 'A4C' then 2.0 when 'A2C' then 1.0 else 0.5 end) * mse), 6) as weighted_loss, round(max(mae), 6) as worst_mae from h")
def selection_score(t):
    h = predictions(t).groupBy("view").agg(F.avg(F.abs(F.col("p") - F.col("y"))).alias("mae"), F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("mse"))
    w = F.when(F.col("view") == "A4C", 2.0).when(F.col("view") == "A2C", 1.0).otherwise(0.5)
    return h.agg(F.round(F.sum(w * F.col("mse")), 6).alias("weighted_loss"), F.round(F.max("mae"), 6).alias("worst_mae"))


@R.add(f"""with {P} select study, round(avg(p) filter (view = 'A4C'), 6) as a4c, round(avg(p) filter (view = 'A2C'), 6) as a2c, round(avg(p) filter (view = 'PLAX'), 6) as plax from p group by 1""")
def wide_predictions(t):
    wide = predictions(t).groupBy("study").pivot("view", ["A4C", "A2C", "PLAX"]).agg(F.round(F.avg("p"), 6))
    return wide.select("study", F.col("A4C").alias("a4c"), F.col("A2C").alias("a2c"), F.col("PLAX").alias("plax"))


@R.add("""with m as (select manufacturer, quantile_disc(spec_x0, 0.5) as mid from radar_stills group by 1) select manufacturer, (case when mid < 70 then 10.0 else 1.0 end)::double as factor, round(max(spec_x0 * case when mid < 70 then 10.0 else 1.0 end), 6) as largest from radar_stills join m using (manufacturer) group by all""")
def median_unit_choice(t):
    mid = t.radar_stills.groupBy("manufacturer").agg(F.percentile_approx("spec_x0", 0.5, 10_000).alias("mid"))
    rows = t.radar_stills.join(mid, "manufacturer").withColumn("factor", F.when(F.col("mid") < 70, 10.0).otherwise(1.0))
    return rows.groupBy("manufacturer", "factor").agg(F.round(F.max(F.col("spec_x0") * F.col("factor")), 6).alias("largest"))


@R.add(f"""with {M}, a as (select view, count(*) as n_videos from m group by 1), b as (select view_class as view, count(*) as n_reviews from column_review group by 1)
select view, coalesce(n_videos, 0) as n_videos, coalesce(n_reviews, 0) as n_reviews from a full join b using (view)""")
def outer_group_counts(t):
    a = manifest(t).groupBy("view").agg(F.count(F.lit(1)).alias("n_videos"))
    b = t.column_review.groupBy(F.col("view_class").alias("view")).agg(F.count(F.lit(1)).alias("n_reviews"))
    return a.join(b, "view", "full_outer").na.fill(0, ["n_videos", "n_reviews"])


@R.add("""with c as (select concept, origin, count(*) as n, count(distinct source_text) as n_texts, count(*) filter (source_text is null) as n_empty from column_review group by all), k as (select concept, count(distinct lang) as n_langs from column_review group by 1)
select concept, origin, n, n_texts, n_empty, n_langs > 1 as mixed from c join k using (concept)""")
def counter_profile(t):
    c = t.column_review.groupBy("concept", "origin").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source_text").alias("n_texts"), F.count_if(F.col("source_text").isNull()).alias("n_empty"))
    k = t.column_review.groupBy("concept").agg((F.countDistinct("lang") > 1).alias("mixed"))
    return c.join(k, "concept").select("concept", "origin", "n", "n_texts", "n_empty", "mixed")


@R.add("""with r as (select concept, count(*) filter (source_text is null or trim(source_text) = '') as n_bad from column_review where modality = 'bmode' and view_class = 'A4C' group by 1)
select case when r.concept is null then 'unreviewed' when n_bad > 0 then 'invalid' else 'valid' end as status, count(*) as n from ontology o left join r on r.concept = o.concept_id group by 1""")
def review_status(t):
    bad = F.col("source_text").isNull() | (F.trim("source_text") == "")
    r = t.column_review.where("modality = 'bmode' and view_class = 'A4C'").groupBy(F.col("concept").alias("concept_id")).agg(F.count_if(bad).alias("n_bad"))
    status = F.when(F.col("n_bad").isNull(), "unreviewed").when(F.col("n_bad") > 0, "invalid").otherwise("valid")
    return t.ontology.join(r, "concept_id", "left").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@R.add(f"""with {P}, e as (select study, b.range as bag, avg(p + ({hash_unit_sql('bags', 'row_id', 'b.range')} - 0.5)) as z from p, range(3) b group by 1, 2)
select study, round(avg(z), 6) as prediction, round(stddev_pop(z), 6) as bag_std, count(*) as n_bags from e group by 1 having count(distinct bag) = 3""")
def bag_ensemble(t):
    e = predictions(t).withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(2))))
    e = e.groupBy("study", "bag").agg(F.avg(F.col("p") + (hash_unit("bags", F.col("row_id"), F.col("bag")) - 0.5)).alias("z"))
    g = e.groupBy("study").agg(F.round(F.avg("z"), 6).alias("prediction"), F.round(F.stddev_pop("z"), 6).alias("bag_std"), F.count(F.lit(1)).alias("n_bags"))
    return g.where("n_bags = 3")


_VARIANTS = ((1, 0.0), (2, 0.0), (3, 0.0), (1, 0.2), (2, 0.2))


@R.add(f"""with {P}, v as (select * from (values {', '.join(f"({k}, {g})" for k, g in _VARIANTS)}) v(least_n, gate)),
g as (select study, v.least_n, v.gate, max(y) as y, median(p) as p, count(*) as n from p, v where {hash_unit_sql('gate', 'row_id')} >= v.gate group by all having count(*) >= v.least_n),
a as (select least_n, gate, {hash_int_sql('half', 'study')} % 2 as half, avg(abs(p - y)) as mae, count(*) as n from g group by all)
select least_n, gate::double as gate, round(max(mae) filter (half = 0), 6) as dev_mae, round(max(mae) filter (half = 1), 6) as test_mae, sum(n)::bigint as n from a group by 1, 2""")
def variant_sweep(t):
    from sonoloom.functions.hashing import hash_int

    grid = F.explode(F.array(*[F.struct(F.lit(k).alias("least_n"), F.lit(g).alias("gate")) for k, g in _VARIANTS])).alias("v")
    e = predictions(t).select("study", "row_id", "y", "p", grid).select("study", "row_id", "y", "p", "v.*").where(hash_unit("gate", F.col("row_id")) >= F.col("gate"))
    g = e.groupBy("study", "least_n", "gate").agg(F.max("y").alias("y"), F.median("p").alias("p"), F.count(F.lit(1)).alias("n")).where("n >= least_n")
    err = F.abs(F.col("p") - F.col("y"))
    half = hash_int("half", F.col("study")) % 2
    return g.groupBy("least_n", "gate").agg(F.round(F.avg(F.when(half == 0, err)), 6).alias("dev_mae"), F.round(F.avg(F.when(half == 1, err)), 6).alias("test_mae"), F.count(F.lit(1)).alias("n"))


@R.add(f"""with {P}, s as (select split, {hash_int_sql('seed', 'row_id')} % 5 as seed, avg(abs(p - y)) as mae from p where split is not null group by all), b as (select seed, mae from s where split = 'train')
select s.split, round(avg(s.mae - b.mae), 6) as mean_delta, round(stddev_samp(s.mae - b.mae), 6) as sd_delta, count(*) as n_seeds from s join b using (seed) group by 1""")
def paired_delta(t):
    from sonoloom.functions.hashing import hash_int

    s = predictions(t).where("split is not null").groupBy("split", (hash_int("seed", F.col("row_id")) % 5).alias("seed")).agg(F.avg(F.abs(F.col("p") - F.col("y"))).alias("mae"))
    b = s.where("split = 'train'").select("seed", F.col("mae").alias("base"))
    d = F.col("mae") - F.col("base")
    return s.join(b, "seed").groupBy("split").agg(F.round(F.avg(d), 6).alias("mean_delta"), F.round(F.stddev_samp(d), 6).alias("sd_delta"), F.count(F.lit(1)).alias("n_seeds"))


_W = "1 + (row_id % 4)"


@R.add(f"with {P} select site, round(sum(({_W}) * low::int) / sum({_W}), 6) as weighted_share, round(sum({_W}) * sum({_W}) / sum(({_W}) * ({_W})), 4) as effective_n, count(*) as n from p group by 1")
def design_weighted_share(t):
    w = (1 + F.col("row_id") % 4).cast("double")
    return predictions(t).groupBy("site").agg(F.round(F.sum(w * F.col("low").cast("int")) / F.sum(w), 6).alias("weighted_share"), F.round(F.sum(w) * F.sum(w) / F.sum(w * w), 4).alias("effective_n"), F.count(F.lit(1)).alias("n"))


@R.add(f"""with {P}, r as (select view, row_id, prob, low, row_number() over (partition by row_id % 50 order by prob desc, row_id) as place from p)
select view, round(avg(low::int) filter (place <= 10), 6) as precision_at_10, count(*) filter (place <= 10) as n from r group by 1""")
def recall_at_k(t):
    w = Window.partitionBy(F.col("row_id") % 50).orderBy(F.col("prob").desc(), "row_id")
    r = predictions(t).withColumn("place", F.row_number().over(w))
    return r.groupBy("view").agg(F.round(F.avg(F.when(F.col("place") <= 10, F.col("low").cast("int"))), 6).alias("precision_at_10"), F.count_if(F.col("place") <= 10).alias("n"))


QUERIES, SQL = R.queries, R.sql
