"""Evaluation metrics as aggregates; nothing is collected but the final numbers of a fit.

Every metric takes columns, skips rows with a missing label or prediction, and is null
where it has no value (an empty or constant input). Scores are pre-aggregated to distinct
values before any ordered pass, and ordered passes run over value ranges
(:mod:`sonoloom.functions.ranks`), so no window holds all rows in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonoloom.functions.hashing import hash_int
from sonoloom.functions.ranks import running_sums
from sonoloom.session import drop_scratch, write_scratch


def _pearson(a: Column, b: Column) -> Column:
    """Correlation; null where a side has no spread."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def regression(y: Column, p: Column) -> list[Column]:
    """n, mae, rmse, bias, r2 (1 - SSE / SST), pearson."""
    ok = y.isNotNull() & p.isNotNull()
    e = F.when(ok, p - y)
    known = F.when(ok, y)
    sst = F.var_pop(known) * F.count(e)
    return [
        F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"),
        (1 - F.try_divide(F.sum(e * e), sst)).alias("r2"), _pearson(known, F.when(ok, p)).alias("pearson"),
    ]


def smooth_l1(y: Column, p: Column) -> Column:
    e = F.abs(p - y)
    return F.avg(F.when(e < 1, 0.5 * e * e).otherwise(e - 0.5))


def agreement(a: Column, b: Column) -> list[Column]:
    """Two-method agreement: correlation, bias, 95 % limits (population deviation), MAE, MAPE."""
    d = b - a
    return [
        F.count(d).alias("n"), _pearson(F.when(d.isNotNull(), a), F.when(d.isNotNull(), b)).alias("r"), F.avg(d).alias("bias"), (F.avg(d) - 1.96 * F.stddev_pop(d)).alias("loa_low"),
        (F.avg(d) + 1.96 * F.stddev_pop(d)).alias("loa_high"), F.avg(F.abs(d)).alias("mae"), (100 * F.avg(F.abs(F.try_divide(d, a)))).alias("mape"),
    ]


def _distinct_scores(df: DataFrame, positive: str, score: str) -> DataFrame:
    rows = df.where(F.col(positive).isNotNull() & F.col(score).isNotNull())
    return rows.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(F.col(positive).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))


def auroc(df: DataFrame, positive: str, score: str) -> DataFrame:
    """Rank-sum area under the ROC curve; ties count half; null without both classes."""
    cum = running_sums(_distinct_scores(df, positive, score), "s", [], {"upto": "n"})
    mean_rank = F.col("upto") - (F.col("n") - 1) / 2
    out = cum.agg(F.sum("pos").alias("n_pos"), (F.sum("n") - F.sum("pos")).alias("n_neg"), F.sum(F.col("pos") * mean_rank).alias("ranks"))
    return out.select("n_pos", "n_neg", F.try_divide(F.col("ranks") - F.col("n_pos") * (F.col("n_pos") + 1) / 2, F.col("n_pos") * F.col("n_neg")).alias("auroc"))


def grouped_auroc(df: DataFrame, groups: list[str], positive: str, score: str) -> DataFrame:
    """AUROC per group (groups of bounded numbers of distinct scores)."""
    rows = df.where(F.col(positive).isNotNull() & F.col(score).isNotNull())
    s = rows.groupBy(*groups, F.col(score).alias("s")).agg(F.sum(F.col(positive).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*groups).orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = s.withColumn("mean_rank", F.sum("n").over(w) - (F.col("n") - 1) / 2)
    g = r.groupBy(*groups).agg(F.sum("pos").alias("n_pos"), (F.sum("n") - F.sum("pos")).alias("n_neg"), F.sum(F.col("pos") * F.col("mean_rank")).alias("ranks"))
    area = F.try_divide(F.col("ranks") - F.col("n_pos") * (F.col("n_pos") + 1) / 2, F.col("n_pos") * F.col("n_neg"))
    return g.select(*groups, "n_pos", "n_neg", area.alias("auroc"))


def average_precision(df: DataFrame, positive: str, score: str) -> DataFrame:
    """Non-interpolated average precision over the distinct scores."""
    s = _distinct_scores(df, positive, score).withColumn("down", -F.col("s"))
    cum = running_sums(s, "down", [], {"n_upto": "n", "pos_upto": "pos"})
    out = cum.agg(F.sum("pos").alias("n_pos"), F.sum(F.col("pos") * F.col("pos_upto") / F.col("n_upto")).alias("a"))
    return out.select("n_pos", F.try_divide(F.col("a"), F.col("n_pos")).alias("average_precision"))


def youden(df: DataFrame, positive: str, score: str, near: float) -> DataFrame:
    """Threshold with the largest sensitivity + specificity - 1 of "score above it is positive"; ties go nearest to ``near``.

    Candidates lie midway between neighbouring scores, one below the least and one above the
    most. Without both classes there is no row.
    """
    s = _distinct_scores(df, positive, score)
    cum = running_sums(s.withColumn("one", F.lit(1)), "s", [], {"n_upto": "n", "pos_upto": "pos", "r": "one"})
    totals = s.agg(F.sum("pos").alias("p"), F.sum("n").alias("t"), F.min("s").alias("lo"), F.max("s").alias("hi")).first()
    p, t = totals.p or 0, totals.t or 0
    following = cum.select((F.col("r") - 1).alias("r"), F.col("s").alias("next"))
    cut = cum.select("r", "s", "n_upto", "pos_upto").join(following, "r")
    j = (F.lit(float(p)) - F.col("pos_upto")) / F.lit(float(p or 1)) + (F.col("n_upto") - F.col("pos_upto")) / F.lit(float((t - p) or 1)) - 1
    between = cut.select(((F.col("s") + F.col("next")) / 2).alias("threshold"), j.alias("youden_j"))
    ends = df.sparkSession.createDataFrame([] if not p or p == t else [(totals.lo - 1.0, 0.0), (totals.hi + 1.0, 0.0)], "threshold double, youden_j double")
    both = between.where(F.lit(0 < p < t)).unionByName(ends)
    return both.orderBy(F.round("youden_j", 12).desc(), F.abs(F.col("threshold") - near), "threshold").limit(1)


def confusion(predicted: Column, truth: Column, weight: Column | None = None) -> list[Column]:
    """Weighted tp, fp, fn, tn with sensitivity, specificity and precision; null where a class is absent."""
    w = F.lit(1.0) if weight is None else weight
    s = lambda cond: F.sum(F.when(cond, w).otherwise(0.0))
    tp, fp, fn, tn = s(predicted & truth), s(predicted & ~truth), s(~predicted & truth), s(~predicted & ~truth)
    ratio = lambda a, b: F.try_divide(a, a + b)
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), ratio(tp, fn).alias("sensitivity"), ratio(tn, fp).alias("specificity"), ratio(tp, fp).alias("precision")]


def calibration_bins(df: DataFrame, positive: str, probability: str, bins: int = 10) -> DataFrame:
    """Equal-width bins with count, mean probability and observed share."""
    b = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1))
    return df.where(F.col(positive).isNotNull() & F.col(probability).isNotNull()).groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(probability).alias("mean_p"), F.avg(F.col(positive).cast("double")).alias("observed"))


def expected_calibration_error(df: DataFrame, positive: str, probability: str, bins: int = 10) -> DataFrame:
    b = calibration_bins(df, positive, probability, bins)
    return b.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("observed"))) / F.sum("n")).alias("ece"))


def calibration_line(df: DataFrame, positive: str, probability: str, eps: float = 1e-6, steps: int = 30) -> tuple[float | None, float | None]:
    """(intercept, slope) of the logistic curve of the label over the logit of the probability; (None, None) without a finite fit.

    Reweighted least squares on one row per distinct probability, written once. A step that
    does not lower the deviance is halved; the fit ends when the deviance no longer falls by
    1e-12 of itself, and has no value if it never gets there or if the classes are separated
    (fitted probabilities reach the labels). Six sums a step come to the driver.
    """
    q = F.greatest(F.least(F.col(probability).cast("double"), F.lit(1 - eps)), F.lit(eps))
    known = df.where(F.col(positive).isNotNull() & F.col(probability).isNotNull())
    levels = write_scratch(known.groupBy(F.log(q / (1 - q)).alias("x")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(positive).cast("double")).alias("k")), "levels")

    def sums(a: float, b: float) -> tuple:
        """Weighted sums of the working response, and the deviance, at (a, b)."""
        z = F.lit(a) + F.lit(b) * F.col("x")
        # log(1 + exp(z)) without overflow.
        soft = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
        mu = F.exp(z - soft)
        w = F.col("n") * mu * (1 - mu)
        left = F.col("k") - F.col("n") * mu
        return tuple(levels.agg(F.sum(w), F.sum(w * F.col("x")), F.sum(w * F.col("x") * F.col("x")), F.sum(left), F.sum(left * F.col("x")), 2 * F.sum(F.col("n") * soft - F.col("k") * z), F.sum("n")).first())

    try:
        a, b = 0.0, 1.0
        now = sums(a, b)
        if not now[6]:
            return None, None
        for _ in range(steps):
            w, wx, wxx, g, gx, deviance, n = now
            spread = w * wxx - wx * wx
            if spread <= 1e-10 * w * wxx or deviance < 1e-6 * n:
                return None, None
            da, db, scale = (wxx * g - wx * gx) / spread, (w * gx - wx * g) / spread, 1.0
            while (then := sums(a + scale * da, b + scale * db))[5] > deviance and scale > 1e-4:
                scale /= 2
            if deviance - then[5] <= 1e-12 * deviance:
                return (a + da, b + db) if scale == 1.0 else (a, b)
            a, b, now = a + scale * da, b + scale * db, then
        return None, None
    finally:
        drop_scratch(levels)


def bootstrap_means(df: DataFrame, value: str, position: str, n: int, reps: int, seed: str, reps_df: DataFrame) -> DataFrame:
    """Mean of each resample: draw i of replicate b is the row at place hash(b, i) mod n. ``position`` numbers rows from 0.

    The draws of a replicate are counted per place first, so a join row stands for all its repeats.
    """
    draws = reps_df.select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    picked = draws.select("rep", F.pmod(hash_int(seed, F.col("rep"), F.col("i")), F.lit(n)).alias(position)).groupBy("rep", position).agg(F.count(F.lit(1)).alias("times"))
    return picked.join(df.select(position, value), position).groupBy("rep").agg((F.sum(F.col("times") * F.col(value)) / F.sum("times")).alias("mean"))


def bootstrap_ratios(df: DataFrame, top: str, bottom: str, position: str, n: int, reps: DataFrame, seed: str) -> DataFrame:
    """sum(top) / sum(bottom) of each resample of ``n`` groups: the metric over all rows of the drawn groups, from a row of sums per group.

    Draws as in :func:`bootstrap_means`.
    """
    draws = reps.select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    picked = draws.select("rep", F.pmod(hash_int(seed, F.col("rep"), F.col("i")), F.lit(n)).alias(position)).groupBy("rep", position).agg(F.count(F.lit(1)).alias("times"))
    ratio = F.try_divide(F.sum(F.col("times") * F.col(top)), F.sum(F.col("times") * F.col(bottom)))
    return picked.join(df.select(position, top, bottom), position).groupBy("rep").agg(ratio.alias("value"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval of a proportion."""
    p = k / n
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    return mid - half, mid + half


_LGAMMA = np.vectorize(math.lgamma, otypes=[float])


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray, terms: int = 400) -> np.ndarray:
    """Regularised incomplete beta function of arrays, by its continued fraction taken on the side where it converges fast."""
    x = np.clip(x, 1e-300, 1 - 1e-16)
    swap = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    # Convergents by backward evaluation from a fixed depth.
    f = np.ones_like(x)
    for m in range(terms // 2, 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        f = 1 + even / f
        k = m - 1
        odd = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        f = 1 + odd / f
    front = np.exp(a * np.log(x) + b * np.log1p(-x) - np.log(a) + _LGAMMA(a + b) - _LGAMMA(a) - _LGAMMA(b))
    part = front / f
    return np.clip(np.where(swap, 1 - part, part), 0.0, 1.0)


def beta_quantile(q: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where the beta distribution reaches ``q``: Newton steps on its density, kept inside a bracket that shrinks."""
    low, high = np.zeros_like(a), np.ones_like(a)
    x = (a + 0.3) / (a + b + 0.6)
    norm = _LGAMMA(a + b) - _LGAMMA(a) - _LGAMMA(b)
    for _ in range(80):
        miss = beta_cdf(x, a, b) - q
        low, high = np.where(miss < 0, x, low), np.where(miss < 0, high, x)
        density = np.exp(norm + (a - 1) * np.log(x) + (b - 1) * np.log1p(-x))
        step = x - miss / np.maximum(density, 1e-300)
        x = np.where((step > low) & (step < high), step, (low + high) / 2)
    return x


def _exact(k: pd.Series, n: pd.Series, q: float, upper: bool) -> pd.Series:
    """Exact bound of each row: the beta quantile, 0 or 1 at the ends, null without a count."""
    ok = (k.notna() & n.notna() & (n > 0)).to_numpy()
    kk, nn = k.fillna(0).to_numpy(dtype=float), n.fillna(1).to_numpy(dtype=float)
    inner = ok & (kk < nn if upper else kk > 0)
    out = np.full(len(k), 1.0 if upper else 0.0)
    if inner.any():
        a, b = (kk[inner] + 1, nn[inner] - kk[inner]) if upper else (kk[inner], nn[inner] - kk[inner] + 1)
        out[inner] = beta_quantile(q, a, b)
    return pd.Series(np.where(ok, out, np.nan)).astype(object).where(ok, None)


def _exact_udf(q: float, upper: bool):
    def run(k: pd.Series, n: pd.Series) -> pd.Series:
        return _exact(k, n, q, upper)

    return F.pandas_udf(run, "double")


def exact_upper(k: Column, n: Column, confidence: float = 0.95) -> Column:
    """One-sided exact (Clopper-Pearson) upper bound; null when n is 0 or missing."""
    return _exact_udf(confidence, True)(k, n)


def exact_interval(k: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Two-sided exact (Clopper-Pearson) interval; null when n is 0 or missing."""
    tail = (1 - confidence) / 2
    return _exact_udf(tail, False)(k, n), _exact_udf(1 - tail, True)(k, n)


def auroc_one_versus_rest(df: DataFrame, truth: str, scores: Column) -> DataFrame:
    """cls, n_pos, n_neg, auroc of every class with members; ``scores`` is a map class -> score. Their mean is the macro AUROC."""
    each = df.select(truth, F.explode(scores).alias("cls", "_s")).withColumn("_y", F.col(truth) == F.col("cls"))
    return grouped_auroc(each, ["cls"], "_y", "_s").where("n_pos > 0")


def coverage_report(labelled: Column, supported: Column, positive: Column) -> list[Column]:
    """Counts of rows, labelled, supported, both, their share of the labelled, and positives without support."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    both = F.count_if(yes(labelled) & yes(supported))
    return [
        F.count(F.lit(1)).alias("n"), F.count_if(yes(labelled)).alias("n_labelled"), F.count_if(yes(supported)).alias("n_supported"), both.alias("n_used"),
        F.try_divide(both, F.count_if(yes(labelled))).alias("coverage"), F.count_if(yes(positive) & ~yes(supported)).alias("unsupported_positives"),
    ]


def macro_by_class(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Per class: support, recall, precision and F1; classes absent on both sides do not occur."""
    a = df.groupBy(F.col(truth).alias("cls")).agg(F.count(F.lit(1)).alias("support"), F.count_if(F.col(truth) == F.col(predicted)).alias("hits"))
    b = df.groupBy(F.col(predicted).alias("cls")).agg(F.count(F.lit(1)).alias("n_predicted"))
    j = a.join(b, "cls", "full_outer").na.fill(0, ["support", "hits", "n_predicted"])
    ratio = lambda x, y: F.try_divide(x, y)
    return j.select("cls", "support", "n_predicted", ratio(F.col("hits"), F.col("support")).alias("recall"), ratio(F.col("hits"), F.col("n_predicted")).alias("precision"), (2 * F.col("hits") / (F.col("support") + F.col("n_predicted"))).alias("f1"))
