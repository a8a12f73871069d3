"""Retraining data, triggers and promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as v
from ..functions.expr import first_match, plain, values_of, worded


def deduplicate(df: DataFrame, id_col: str, arrival: str) -> DataFrame:
    """Keep the first row of each id, then drop exact copies.

    Rows without an id are only compared as a whole: a missing id identifies nobody.
    The first row per id is a min over structs (partial aggregation), so an id with
    very many copies never gathers in one task. ``arrival`` gives the order and is not
    part of the comparison.
    """
    rest = [c for c in df.columns if c not in (id_col, arrival)]
    with_id = (df.filter(F.col(id_col).isNotNull()).groupBy(id_col)
               .agg(F.min(F.struct(arrival, *rest)).alias("x")).select(id_col, "x.*"))
    without = (df.filter(F.col(id_col).isNull())
               .groupBy(id_col, *rest).agg(F.min(arrival).alias(arrival)))
    return with_id.unionByName(without)


def retraining_dataset(historical: DataFrame, outcomes: DataFrame, id_col: str = v.ID,
                       arrival: str = "arrival", target: str = v.TARGET) -> DataFrame:
    """Historical rows and labelled outcomes, de-duplicated."""
    labelled = outcomes.filter(F.col(target).isNotNull())
    return deduplicate(historical.unionByName(labelled, allowMissingColumns=True), id_col, arrival)


def dataset_statistics(historical: DataFrame, outcomes: DataFrame, combined: DataFrame,
                       target: str = v.TARGET) -> DataFrame:
    count = lambda d: d.agg(F.count(F.lit(1))).scalar()
    labelled = outcomes.filter(F.col(target).isNotNull())
    return combined.agg(F.count(F.lit(1)).alias("total_rows")).select(
        count(historical).alias("historical_rows"), count(labelled).alias("outcome_rows"), "total_rows",
        (count(historical) + count(labelled) - F.col("total_rows")).alias("removed_rows"))


def retrain_triggers(drift: DataFrame, trend: DataFrame, outcomes: DataFrame,
                     recorded_at: str = "recorded_at", last_trained: Column | None = None,
                     backlog: int = v.OUTCOME_BACKLOG) -> DataFrame:
    """One row: whether to retrain and why. Outcomes count since the last training."""
    new = outcomes if last_trained is None else outcomes.filter(F.col(recorded_at) > last_trained)
    n = F.col("new_outcomes")
    t = values_of(trend, "alert", "recommendation")
    staged = new.agg(F.count(F.lit(1)).alias("new_outcomes")).select(
        "new_outcomes", drift.select("drift_detected").scalar().alias("drift"),
        t["alert"].alias("degraded"), t["recommendation"].alias("_advice"))
    reasons = F.array_compact(F.array(
        F.when(F.col("drift"), F.lit(v.DRIFT_ALERT)),
        F.when(F.col("degraded"), F.col("_advice")),
        F.when(n >= backlog, worded(v.OUTCOMES_WAIT, count=n.cast("string")))))
    return staged.select((F.size(reasons) > 0).alias("should_retrain"), reasons.alias("reasons"),
                         F.coalesce("drift", F.lit(False)).alias("drift"),
                         F.coalesce("degraded", F.lit(False)).alias("degraded"), "new_outcomes")


def promotion(challenger: Column, challenger_auc: Column, champion: Column, champion_auc: Column,
              gain_needed: float = v.PROMOTION_GAIN) -> dict[str, Column]:
    """Promotion columns for a row that holds both sides."""
    gain = F.coalesce(challenger_auc, F.lit(0.0)) - champion_auc
    first = champion.isNull() | (champion == challenger)
    enough = gain >= F.lit(gain_needed)
    number = lambda c: plain(c, 4)
    say = lambda case: worded(
        v.PROMOTION[case], challenger=number(F.coalesce(challenger_auc, F.lit(0.0))), champion=number(champion_auc),
        gain=F.concat(F.when(gain >= 0, "+").otherwise(""), number(gain)), needed=F.lit(f"{gain_needed:.4f}"))
    return {
        "promoted": first | champion_auc.isNull() | enough,
        "reason": first_match([(first, say("first")), (champion_auc.isNull(), say("unmeasured")), (enough, say("better"))], say("not_better")),
    }


def compare_versions(registry: DataFrame, challenger: str, champion: str | None) -> DataFrame:
    """Promotion decision between two registry rows."""
    get = lambda ver, c: registry.filter(F.col("version") == ver).agg(F.first(c)).scalar()
    base = registry.filter(F.col("version") == challenger).select(
        F.col("version").alias("challenger_version"), F.col("roc_auc").alias("challenger_auc"),
        F.lit(champion).cast("string").alias("champion_version"),
        (get(champion, "roc_auc") if champion else F.lit(None).cast("double")).alias("champion_auc"))
    return base.withColumns(promotion(*[F.col(c) for c in (
        "challenger_version", "challenger_auc", "champion_version", "champion_auc")]))


def model_health(metrics: DataFrame, drift: DataFrame, trend: DataFrame, throughput: DataFrame,
                 fairness_alert: Column) -> DataFrame:
    """One row with metrics, drift, trend, throughput and the list of alerts."""
    d, t = values_of(drift, "status", "drift_detected"), values_of(trend, "status", "alert", "recommendation")
    volume = values_of(throughput, "total_predictions", "avg_latency_ms")
    staged = metrics.select(
        "*", d["status"].alias("drift_status"), d["drift_detected"].alias("drift_detected"),
        t["status"].alias("trend_status"), t["alert"].alias("_trend_alert"), t["recommendation"].alias("_advice"),
        *[c.alias(n) for n, c in volume.items()], fairness_alert.alias("_bias"))
    low = F.coalesce("roc_auc", F.lit(0.0)) < v.MIN_AUC
    alerts = F.array_compact(F.array(
        F.when(F.col("drift_detected"), F.lit(v.DRIFT_ALERT)),
        F.when(F.col("_trend_alert"), F.col("_advice")),
        F.when(low, worded(v.LOW_AUC, auc=F.coalesce(plain(F.col("roc_auc"), 4), F.lit("unknown")), floor=F.lit(str(v.MIN_AUC)))),
        F.when(F.col("_bias"), F.lit(v.TRAINING_BIAS))))
    return staged.withColumn("alerts", alerts).withColumn(
        "status", F.when(F.size("alerts") > 0, "degraded").otherwise("healthy")
    ).withColumn("meets_minimum_auc", ~low).drop("_trend_alert", "_advice", "_bias")
