"""Population stability of features and scores between a reference and current data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import vocabulary as v
from ..functions.expr import half_even, values_of
from ..functions.ordered import exact_quantiles
from ..functions.scoring import psi_status


def _term(e: Column, a: Column) -> Column:
    e, a = (F.greatest(x, F.lit(v.PSI_FLOOR)) for x in (e, a))
    return (a - e) * F.ln(a / e)


def fit_edges(reference: DataFrame, features: Sequence[str], bins: int = 10) -> dict[str, list[float]]:
    """Interior bin edges: the distinct reference quantiles without the two outer ones.

    A feature with fewer than ``bins`` values or fewer than three distinct quantiles
    gets no edges and cannot drift. The edges are fitted constants, stored with the
    model; a later check needs no pass over the reference for them.
    """
    probs = [i / bins for i in range(bins + 1)]
    values: dict[str, list[float]] = {f: [] for f in features}
    for r in exact_quantiles(reference, features, probs).collect():  # one row per feature and edge
        if r["n"] >= bins:
            values[r["feature"]].append(r["value"])
    distinct = {f: sorted(set(x)) for f, x in values.items()}
    return {f: x[1:-1] if len(x) >= 3 else [] for f, x in distinct.items()}


def _finite(name: str) -> Column:
    c = F.col(name).cast("double")
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def bin_of(c: Column, edges: Sequence[float]) -> Column:
    """Number of interior edges at or below the value."""
    out = F.lit(0)
    for e in edges:
        out = out + (c >= F.lit(float(e))).cast("int")
    return out


def histogram(df: DataFrame, edges: dict[str, list[float]], categorical: Sequence[str] = (),
              by: Sequence[str] = ()) -> DataFrame:
    """Counts per (feature, kind, bin); every feature in one partial aggregation."""
    cells = [F.when(_finite(f).isNotNull(), F.struct(
        F.lit(f).alias("feature"), F.lit("numeric").alias("kind"),
        bin_of(_finite(f), e).cast("string").alias("bin"))) for f, e in edges.items()]
    cells += [F.when(F.col(c).isNotNull(), F.struct(
        F.lit(c).alias("feature"), F.lit("categorical").alias("kind"),
        F.col(c).cast("string").alias("bin"))) for c in categorical]
    found = F.array_compact(F.array(*cells)) if cells else F.array().cast(
        "array<struct<feature:string,kind:string,bin:string>>")
    return (df.select(*by, F.explode(found).alias("s"))
            .groupBy(*by, "s.feature", "s.kind", "s.bin").agg(F.count(F.lit(1)).alias("n")))


def psi_rows(reference: DataFrame, current: DataFrame, edges: dict[str, list[float]],
             categorical: Sequence[str] = ()) -> DataFrame:
    """One row per feature: PSI and status.

    Both sides are histograms before they meet, so the full outer join that aligns
    bins and levels handles a few rows per feature.
    """
    return psi_counts(reference_counts(reference, edges, categorical), current, edges, categorical)


def _usable(edges: dict[str, list[float]]) -> dict[str, list[float]]:
    return {f: e for f, e in edges.items() if e}


def reference_counts(reference: DataFrame, edges: dict[str, list[float]], categorical: Sequence[str] = ()) -> DataFrame:
    """All that PSI needs of a reference of any size, to be stored with its edges: the rows in every bin and level."""
    return histogram(reference, _usable(edges), categorical)


def psi_counts(counts: DataFrame, current: DataFrame, edges: dict[str, list[float]], categorical: Sequence[str] = ()) -> DataFrame:
    """``psi_rows`` against the reference's counts for the same edges; features that are not asked for are left out."""
    flat = [f for f, e in edges.items() if not e]
    usable = _usable(edges)
    share = lambda h, name: h.select(
        "feature", "kind", "bin",
        (F.col("n") / F.sum("n").over(W.partitionBy("feature"))).alias(name))
    e = share(counts.filter(F.col("feature").isin(*usable, *categorical)), "e")
    a = share(histogram(current, usable, categorical), "a")
    both = e.join(a, ["feature", "kind", "bin"], "full_outer")
    psi = F.sum(_term(F.coalesce("e", F.lit(0.0)), F.coalesce("a", F.lit(0.0))))
    # a numeric feature with nothing on one side has no drift to measure
    one_sided = (F.col("kind") == "numeric") & ((F.count("e") == 0) | (F.count("a") == 0))
    rows = both.groupBy("feature", "kind").agg(F.when(one_sided, 0.0).otherwise(psi).alias("psi"))
    if flat:
        none = counts.sparkSession.createDataFrame([(f, "numeric", 0.0) for f in flat],
                                                      "feature string, kind string, psi double")
        rows = rows.unionByName(none)
    return rows.select("feature", "kind", half_even("psi", 4).alias("psi"),
                       psi_status(half_even("psi", 4)).alias("status"), F.col("psi").alias("psi_raw"))


def psi_numeric(reference: DataFrame, current: DataFrame, feature: str, bins: int = 10) -> DataFrame:
    return psi_rows(reference, current, fit_edges(reference, [feature], bins))


def psi_categorical(reference: DataFrame, current: DataFrame, feature: str) -> DataFrame:
    return psi_rows(reference, current, {}, [feature])


def missing_shift(reference: DataFrame, current: DataFrame, features: Sequence[str]) -> DataFrame:
    """Missing rate per feature on both sides: PSI alone calls a vanished column stable."""
    rates = lambda df: df.agg(*[F.avg(F.col(f).isNull().cast("double")).alias(f) for f in features])
    melt = lambda df, name: df.unpivot([], list(features), "feature", name)
    return (melt(rates(reference), "reference_missing").join(melt(rates(current), "current_missing"), "feature")
            .withColumn("missing_shift", F.col("current_missing") - F.col("reference_missing")))


def drift_summary(rows: DataFrame) -> DataFrame:
    """Totals over the per-feature rows."""
    hit = F.col("status").isin("warning", "alert")
    worst = F.coalesce(F.max("psi"), F.lit(0.0))
    return rows.agg(
        F.count(F.lit(1)).alias("features_checked"),
        F.array_sort(F.collect_list(F.when(hit, F.col("feature")))).alias("drifted"),
        F.array_sort(F.collect_list(F.when(F.col("status") == "alert", F.col("feature")))).alias("alerting"),
        worst.alias("max_psi"), half_even(F.coalesce(F.avg("psi"), F.lit(0.0)), 4).alias("mean_psi"),
        psi_status(worst).alias("status"),
        (F.count_if(F.col("status") == "alert") > 0).alias("drift_detected"))


def prediction_drift(reference: DataFrame, current: DataFrame, score: str,
                     edges: dict[str, list[float]] | None = None) -> DataFrame:
    """Shift of the score distribution itself."""
    edges = edges or fit_edges(reference, [score])
    psi = F.coalesce(psi_rows(reference, current, edges).select("psi").scalar(), F.lit(0.0))
    ref_mean = reference.agg(F.avg(score)).scalar()
    n, mean = F.count(score), F.avg(score)
    return current.agg(n.alias("sample_size"), mean.alias("_m")).select(
        F.when(F.col("sample_size") > 0, psi_status(psi)).otherwise("no_data").alias("status"),
        F.when(F.col("sample_size") > 0, psi).otherwise(0.0).alias("psi"),
        ((F.col("sample_size") > 0) & (psi >= v.PSI_ALERT)).alias("drift_detected"),
        half_even(ref_mean, 2).alias("reference_mean"), half_even("_m", 2).alias("current_mean"),
        half_even(F.col("_m") - ref_mean, 2).alias("mean_shift"), "sample_size")


def last_events(log: DataFrame, n: int, ts: str = "timestamp", tie: str | None = None,
                event: str | None = None, event_col: str = "event") -> DataFrame:
    """The last ``n`` events by time (a top-n: each task keeps n rows, none is shuffled
    but those)."""
    rows = log if event is None else log.filter(F.col(event_col) == event)
    order = [F.desc(ts)] + ([F.desc(tie)] if tie else [])
    return rows.orderBy(*order).limit(n)


def log_drift_report(log: DataFrame, reference: DataFrame, edges: dict[str, list[float]],
                     categorical: Sequence[str], score: str, window: int = 1000,
                     minimum: int = 30, ts: str = "timestamp", tie: str | None = None) -> DataFrame:
    """One-row drift report of the last ``window`` predictions against the reference.

    ``log`` and ``reference`` hold the features and the score flat; ``edges`` covers
    both. Too few predictions give status ``insufficient_data``.
    """
    recent = last_events(log, window, ts, tie)
    rows = psi_rows(reference, recent, edges, categorical)
    is_score = F.col("feature") == score
    worst = rows.agg(
        F.max(F.when(~is_score, F.col("psi"))).alias("feature_psi"),
        F.max(F.when(is_score, F.col("psi"))).alias("score_psi"),
        F.array_sort(F.collect_list(F.when(F.col("status") != "stable", F.col("feature")))).alias("drifted"))
    seen = recent.agg(F.count(F.lit(1)).alias("sample_size"), F.min(ts).alias("window_start"),
                      F.max(ts).alias("window_end"))
    feature, score_psi = F.coalesce("feature_psi", F.lit(0.0)), F.coalesce("score_psi", F.lit(0.0))
    overall = (F.when(F.col("sample_size") < minimum, "insufficient_data")
               .when((feature >= v.PSI_ALERT) | (score_psi >= v.PSI_ALERT), "alert")
               .when(feature >= v.PSI_WARN, "warning").otherwise("stable"))
    staged = seen.select("*", *[c.alias(n) for n, c in values_of(worst).items()])
    return staged.select(
        overall.alias("status"), (overall == "alert").alias("drift_detected"), "sample_size",
        "window_start", "window_end", "feature_psi", "score_psi", "drifted",
        F.when(overall == "alert", "Retrain the model against recent data.")
        .when(overall == "stable", "Monitor; no action required.")
        .when(overall == "warning",
              "Investigate the drifting features before the next scheduled retrain.").alias("recommendation"))
