"""Classification metrics, curves, thresholds and their history.

Input rows carry a 0/1 outcome and a probability. Everything that needs an order works
on ``running_totals``: one row per distinct probability with cumulative counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import vocabulary as v
from ..functions import scoring
from ..functions.expr import first_match, half_even, percent, ratio, values_of, worded
from ..functions.ordered import exact_quantiles, running_totals
from ..session import cut_lineage


def _outcomes(df: DataFrame, y: str, p: str, keys: Sequence[str]) -> DataFrame:
    return (df.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
            .select(*keys, F.col(p).cast("double").alias("p"),
                    (F.col(y) == 1).cast("long").alias("pos"), (F.col(y) == 0).cast("long").alias("neg")))


def cumulative_counts(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, p, pos, neg, cum_pos, cum_neg), cumulative from the highest probability."""
    return running_totals(_outcomes(df, y, p, keys), keys, "p", ["pos", "neg"])


def rank_metrics(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """ROC AUC (ties averaged) and average precision (step sum) per key.

    Both are sums over distinct probabilities, so no ordered pass follows the totals.
    """
    c = cumulative_counts(df, y, p, keys)
    # pairs (positive above negative), ties half
    won = F.sum(F.col("neg").cast("double") * (F.col("cum_pos") - F.col("pos")).cast("double")
                + F.lit(0.5) * F.col("neg") * F.col("pos"))
    ap = F.sum(F.col("pos").cast("double") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))
    pos, neg = F.sum("pos"), F.sum("neg")
    return c.groupBy(*keys).agg(
        F.try_divide(won, pos.cast("double") * neg.cast("double")).alias("roc_auc"),
        F.try_divide(ap, pos.cast("double")).alias("average_precision"))


def confusion_metrics(df: DataFrame, y: str, p: str, threshold: float | Column = 0.5,
                      keys: Sequence[str] = ()) -> DataFrame:
    """Confusion matrix and the rates derived from it; 0 where a rate has no denominator."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    pick, pos = F.col(p) >= t, F.col(y) == 1
    base = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(pos & pick).alias("tp"), F.count_if(~pos & pick).alias("fp"),
        F.count_if(pos & ~pick).alias("fn"), F.count_if(~pos & ~pick).alias("tn"),
        F.avg(F.pow(F.col(p) - F.col(y), F.lit(2.0))).alias("brier_score"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    recall, true_negative_rate = ratio(tp, tp + fn), ratio(tn, tn + fp)
    # the mean runs over the classes that occur
    classes = (tp + fn > 0).cast("double") + (tn + fp > 0).cast("double")
    return base.select(
        *keys, "n", "tp", "fp", "fn", "tn",
        ratio(tp + tn, F.col("n").cast("double")).alias("accuracy"),
        ratio(recall + true_negative_rate, classes).alias("balanced_accuracy"),
        ratio(tp, tp + fp).alias("precision"), recall.alias("recall"),
        ratio(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn).alias("f1"), "brier_score",
        (F.col("tp") + F.col("fn")).alias("positives"), (F.col("fp") + F.col("tn")).alias("negatives"))


def classification_metrics(df: DataFrame, y: str, p: str, threshold: float = 0.5,
                           keys: Sequence[str] = ()) -> DataFrame:
    """Threshold metrics and ranking metrics side by side."""
    a, b = confusion_metrics(df, y, p, threshold, keys), rank_metrics(df, y, p, keys)
    if keys:
        return a.join(b, list(keys))
    return a.select("*", *[c.alias(n) for n, c in values_of(b).items()])


def curve_points(df: DataFrame, y: str, p: str, max_points: int = 200,
                 kinds: Sequence[str] = ("roc", "precision_recall")) -> DataFrame:
    """Rows (curve, i, x, y) with at most ``max_points`` evenly spaced points per curve.

    The ROC curve starts at the origin and leaves out points on a straight run; the
    precision-recall curve runs from recall 1 down to the closing point (0, 1). The
    cumulative counts are computed once and stored, since both curves read them often.
    """
    counts = cut_lineage(cumulative_counts(df, y, p))
    totals = counts.agg(F.sum("pos").cast("double"), F.sum("neg").cast("double"), F.count(F.lit(1))).toDF("n_pos", "n_neg", "n_points")
    P, N, n = values_of(totals).values()
    out = []
    if "roc" in kinds:
        # a threshold is left out where the step to it equals the step after it
        after = counts.select((F.col("place") - 1).alias("place"), F.col("pos").alias("_p"), F.col("neg").alias("_n"))
        bend = (F.col("place") == 1) | F.col("_p").isNull() | (F.col("pos") != F.col("_p")) | (F.col("neg") != F.col("_n"))
        kept = counts.join(after, "place", "left").filter(bend).select(
            "p", F.lit(1).alias("i"), (F.col("cum_neg") / N).alias("x"), (F.col("cum_pos") / P).alias("y"))
        numbered = cut_lineage(running_totals(kept, [], "p", ["x", "y"]).select(F.col("place").alias("i"), "x", "y"))
        origin = totals.select(F.lit(0).cast("long").alias("i"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
        out.append(_thin(numbered.unionByName(origin), max_points).withColumn("curve", F.lit("roc")))
    if "precision_recall" in kinds:
        xy = counts.select((n - F.col("place")).alias("i"), (F.col("cum_pos") / P).alias("x"),
                           (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("y"))
        end = totals.select(F.col("n_points").alias("i"), F.lit(0.0).alias("x"), F.lit(1.0).alias("y"))
        out.append(_thin(xy.unionByName(end), max_points).withColumn("curve", F.lit("precision_recall")))
    points = out[0]
    for more in out[1:]:
        points = points.unionByName(more)
    return points.select("curve", "i", "x", "y")


def _thin(points: DataFrame, limit: int) -> DataFrame:
    """Keep ``limit`` evenly spaced positions. Position i is kept when it equals
    floor(k * (n - 1) / (limit - 1)) for some k."""
    n = points.agg(F.count(F.lit(1))).scalar()
    m = F.lit(limit - 1)
    k = F.ceil(F.col("i") * m / (n - 1))
    at = F.floor(k.cast("double") * (n - 1) / m)
    return points.filter((n <= limit) | ((k <= m) & (at == F.col("i"))))


def tune_thresholds(df: DataFrame, y: str, p: str, target_recall: float = 0.95,
                    lift: float = 2.5) -> DataFrame:
    """One row (low, high, decision, base_rate).

    low: highest cut that keeps the recall; high: lowest cut whose precision reaches
    ``lift`` times the base rate (at most 0.95); decision: lowest cut with the best F1.
    Missing cuts fall back to the 25th and 95th percentile of p; both are kept ordered.
    Everything, the percentiles included, follows from the cumulative counts.
    """
    counts = cut_lineage(cumulative_counts(df, y, p))
    totals = counts.agg(F.struct(F.sum("pos").cast("double").alias("P"), F.sum(F.col("pos") + F.col("neg")).alias("n"))).scalar()
    P, n = totals["P"], totals["n"]
    rate = F.try_divide(P, n.cast("double"))
    cp, picked = F.col("cum_pos").cast("double"), F.col("cum_pos") + F.col("cum_neg")
    recall, precision = F.try_divide(cp, P), cp / picked
    f1 = ratio(F.lit(2.0) * precision * recall, precision + recall)
    staged = counts.select("p", (F.col("pos") + F.col("neg")).alias("c"), (n - picked).alias("below"), n.alias("n"), rate.alias("rate"),
                           recall.alias("recall"), precision.alias("precision"), f1.alias("f1"))

    def at_rank(r: Column) -> Column:
        return F.min(F.when((F.col("below") <= r) & (r < F.col("below") + F.col("c")), F.col("p")))

    def percentile(q: float) -> Column:
        h = (F.col("n") - 1).cast("double") * F.lit(q)
        lo, hi = at_rank(F.floor(h)), at_rank(F.ceil(h))
        return lo + (hi - lo) * F.max(h - F.floor(h))

    wanted = F.least(F.lit(0.95), F.col("rate") * F.lit(lift))
    found = staged.agg(
        F.coalesce(F.max(F.when(F.col("recall") >= F.lit(target_recall), F.col("p"))), percentile(0.25)).alias("low"),
        F.coalesce(F.min(F.when(F.col("precision") >= wanted, F.col("p"))), percentile(0.95)).alias("high"),
        F.coalesce(F.max_by("p", F.struct(F.col("f1"), -F.col("p"))), F.lit(0.5)).alias("decision"),
        F.max("rate").alias("base_rate"))
    low = F.least(F.greatest("low", F.lit(1e-4)), F.lit(0.98))
    return found.withColumn("low", low).withColumn("high", F.least(
        F.greatest("high", F.col("low") + F.lit(1e-3)), F.lit(0.999))).select("low", "high", "decision", "base_rate")


def fit_cutoffs(df: DataFrame, y: str, p: str, **kw) -> scoring.Cutoffs:
    """``tune_thresholds`` brought to the driver as three constants."""
    r = tune_thresholds(df, y, p, **kw).first()
    return scoring.Cutoffs(r["low"], r["high"], r["decision"])


# ---- bands and distributions ---------------------------------------------------

def level_counts(df: DataFrame, level: str = "risk_level") -> DataFrame:
    """One row with a zero-filled count per level."""
    return df.agg(*[F.count_if(F.col(level) == x).alias(x) for x in v.RISK_LEVELS])


def band_table(df: DataFrame, level: str, y: str) -> DataFrame:
    """Count, share and observed default rate of every level, zero-filled."""
    one = df.agg(F.count(F.lit(1)).alias("n"),
                 *[F.count_if(F.col(level) == x).alias(f"n_{x}") for x in v.RISK_LEVELS],
                 *[F.avg(F.when(F.col(level) == x, F.col(y).cast("double"))).alias(f"r_{x}")
                   for x in v.RISK_LEVELS])
    rows = F.array(*[F.struct(
        F.lit(x).alias("level"), F.col(f"n_{x}").alias("count"),
        ratio(F.col(f"n_{x}").cast("double"), F.col("n").cast("double")).alias("share"),
        F.coalesce(F.col(f"r_{x}"), F.lit(0.0)).alias("default_rate")) for x in v.RISK_LEVELS])
    return one.select(F.inline(rows))


def score_distribution(df: DataFrame, score: str = "risk_score") -> DataFrame:
    q = exact_quantiles(df, [score], [0.1, 0.5, 0.9])
    at = lambda x: q.filter(F.col("prob") == x).select("value").scalar()
    return df.agg(F.avg(score).alias("mean")).select(
        "mean", at(0.1).alias("p10"), at(0.5).alias("p50"), at(0.9).alias("p90"))


def evaluation(df: DataFrame, y: str, p: str, cut: scoring.Cutoffs) -> dict[str, DataFrame]:
    """The whole evaluation of a scored table, as separate lazy tables. Cache ``df``
    before running more than one of them."""
    scored = df.withColumn("risk_score", scoring.risk_score(p, cut)) \
        .withColumn("risk_level", scoring.risk_level("risk_score"))
    return {"metrics": classification_metrics(scored, y, p, cut.decision),
            "curves": curve_points(scored, y, p),
            "bands": band_table(scored, "risk_level", y),
            "distribution": score_distribution(scored)}


# ---- history, agreement, throughput --------------------------------------------

def period_metrics(df: DataFrame, y: str, p: str, period: str = "period",
                   version: str = "model_version", threshold: float = 0.5) -> DataFrame:
    """Metrics per cohort; ``low_auc`` marks a cohort below the acceptable AUC."""
    return (classification_metrics(df, y, p, threshold, [period, version])
            .withColumn("low_auc", F.col("roc_auc") < F.lit(v.MIN_AUC)))


def performance_trend(history: DataFrame, order: Sequence[str] = ("period",), auc: str = "roc_auc",
                      limit: int = 100) -> DataFrame:
    """Latest period against the mean of the earlier ones, over the last ``limit`` rows.
    Periods without an AUC (one class only) cannot be compared and are left out."""
    recent = history.filter(F.col(auc).isNotNull()).orderBy(*[F.desc(o) for o in order]).limit(limit)  # at most ``limit`` rows
    w = W.orderBy(*order)
    staged = recent.select(
        "*", F.avg(auc).over(w.rowsBetween(W.unboundedPreceding, -1)).alias("_earlier"),
        F.row_number().over(W.orderBy(*[F.desc(o) for o in order])).alias("_rn"))
    last = staged.filter(F.col("_rn") == 1)
    baseline = F.coalesce(F.col("_earlier"), F.col(auc))
    drop = baseline - F.col(auc)
    below = F.col(auc) < F.lit(v.MIN_AUC)
    dropped = drop > F.lit(v.AUC_DROP)
    return last.select(
        *order, half_even(baseline, 4).alias("baseline_auc"), F.col(auc).alias("latest_auc"),
        half_even(drop, 4).alias("auc_degradation"), below.alias("below_minimum"),
        dropped.alias("significant_drop"), (below | dropped).alias("alert"),
        F.when(below | dropped, "degraded").otherwise("healthy").alias("status"),
        F.when(below, "Trigger retraining: performance has fallen below the acceptable threshold.")
        .when(dropped, "Investigate: AUC dropped materially versus the historical baseline.")
        .otherwise("No action required.").alias("recommendation"))


def officer_agreement(decisions: DataFrame, recommended: str = "ai_recommendation",
                      final: str = "final_decision") -> DataFrame:
    """How often officers follow the recommendation, among comparable decisions."""
    a, b = F.col(recommended), F.col(final)
    both = a.isin("approve", "reject") & b.isin("approve", "reject")
    one = decisions.agg(
        F.count_if(both).alias("sample_size"), F.count_if(both & (a == b)).alias("agreed"),
        F.count_if(both & (a == "reject") & (b == "approve")).alias("reject_to_approve"),
        F.count_if(both & (a == "approve") & (b == "reject")).alias("approve_to_reject"))
    rate = F.try_divide(F.col("agreed").cast("double"), F.col("sample_size").cast("double"))
    ra, ar = F.col("reject_to_approve"), F.col("approve_to_reject")
    lean = first_match([(ra > ar, "conservative"), (ar > ra, "permissive")], "even")
    return one.select(
        half_even(rate, 4).alias("agreement_rate"), "sample_size",
        (ra + ar).alias("override_count"), ra, ar,
        first_match([(rate.isNull(), "no_data"), (rate >= 0.80, "healthy"), (rate >= 0.65, "review")],
                    "concerning").alias("status"),
        F.when(rate.isNotNull(), first_match([(lean == way, worded(s, rate=percent(rate))) for way, s in v.AGREEMENT.items()])).alias("interpretation"))


def throughput(recent: DataFrame, ts: str, latency: str, score: str, level: str, fraud: str) -> DataFrame:
    """Volume, latency and score summary of an already limited set of predictions."""
    return recent.agg(
        F.count(F.lit(1)).alias("total_predictions"),
        half_even(F.avg(F.coalesce(F.col(latency), F.lit(0.0))), 2).alias("avg_latency_ms"),
        half_even(F.percentile(F.coalesce(F.col(latency), F.lit(0.0)), 0.95), 2).alias("p95_latency_ms"),
        half_even(F.avg(F.coalesce(F.col(score), F.lit(0.0))), 2).alias("mean_risk_score"),
        *[F.count_if(F.col(level) == x).alias(f"n_{x}") for x in v.RISK_LEVELS],
        F.count_if(F.col(fraud)).alias("fraud_flagged"),
        F.min(ts).alias("window_start"), F.max(ts).alias("window_end"))


def fold_summary(folds: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean and population standard deviation of cross-validation metrics."""
    return folds.groupBy(*keys).agg(*[f for m in metrics for f in (
        F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))])
