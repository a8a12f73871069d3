"""Approval-rate audit over protected attributes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as v
from ..functions.expr import first_match, half_even, percent, plain, values_of, worded


def approved_by_score(score: Column | str) -> Column:
    """Approved in the audit's sense: strictly below the automatic-approval score."""
    s = F.col(score) if isinstance(score, str) else score
    return (s < F.lit(v.LOW_SCORE)).cast("int")


def group_stats(df: DataFrame, attributes: Sequence[str], approved: str,
                target: str | None = None, min_rows: int = v.MIN_GROUP_ROWS) -> DataFrame:
    """One row per (attribute, group). All attributes in one pass: each row is turned
    into one (attribute, group) pair per attribute and partially aggregated at once."""
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"),
                               F.coalesce(F.col(a).cast("string"), F.lit("unknown")).alias("group"))
                      for a in attributes])
    y = F.col(target).cast("int") if target else F.lit(None).cast("int")
    long = df.select(F.inline(pairs), F.col(approved).cast("int").alias("a"), y.alias("y"))
    ok, bad = F.col("y") == 0, F.col("y") == 1
    rate = lambda cond: F.avg(F.when(cond, F.col("a").cast("double")))
    return long.groupBy("attribute", "group").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg(F.col("a").cast("double")).alias("approval_rate"),
        rate(ok).alias("creditworthy_approval_rate"),
        F.when(F.count_if(bad) > 0, F.avg(F.col("y").cast("double"))).alias("default_rate"),
        rate(bad).alias("defaulter_approval_rate"),
        (F.count(F.lit(1)) >= min_rows).alias("sufficient_sample"))


def significant_gap(ra: Column, na: Column, rb: Column, nb: Column) -> Column:
    """Pooled two-proportion z-test at 95 %. A gap with zero pooled variance (0 % against
    100 %) counts as significant."""
    na, nb = na.cast("double"), nb.cast("double")
    pooled = (ra * na + rb * nb) / (na + nb)
    var = pooled * (F.lit(1.0) - pooled) * (F.lit(1.0) / na + F.lit(1.0) / nb)
    z = F.try_divide(F.abs(ra - rb), F.sqrt(F.greatest(var, F.lit(0.0))))
    return first_match([((na == 0) | (nb == 0) | (ra == rb), False), (var <= 0, True)],
                       z >= F.lit(v.Z_95))


def audit(stats: DataFrame) -> DataFrame:
    """One row per attribute from ``group_stats`` (a few rows per attribute)."""
    enough = F.col("sufficient_sample")
    who = F.when(enough, F.struct("approval_rate", "group", "count"))
    # ties go to the group that comes first in label order
    grouped = stats.groupBy("attribute").agg(
        F.count_if(enough).alias("usable_groups"),
        F.min_by(who, F.when(enough, F.struct(-F.col("approval_rate"), F.col("group")))).alias("_most"),
        F.min_by(F.struct("approval_rate", "group", "count"),
                 F.when(enough, F.struct("approval_rate", "group"))).alias("_least"),
        F.max(F.when(enough, F.col("creditworthy_approval_rate"))).alias("_hi"),
        F.min(F.when(enough, F.col("creditworthy_approval_rate"))).alias("_lo"),
        F.count(F.when(enough, F.col("creditworthy_approval_rate"))).alias("_n_ok"))
    most, least = F.col("_most"), F.col("_least")
    shown = F.col("usable_groups") >= 2
    hi, lo = most["approval_rate"], least["approval_rate"]
    impact = F.coalesce(F.try_divide(lo, hi), F.lit(1.0))
    parity = hi - lo
    breach = (impact < F.lit(v.IMPACT_FLOOR)) | (parity > F.lit(v.PARITY_TOLERANCE))
    alert = F.coalesce(shown & breach & significant_gap(hi, most["count"], lo, least["count"]), F.lit(False))
    when = lambda c: F.when(shown, c)
    return grouped.select(
        "attribute", "usable_groups",
        when(most["group"]).alias("most_favoured"), when(hi).alias("most_favoured_rate"),
        when(least["group"]).alias("least_favoured"), when(lo).alias("least_favoured_rate"),
        when(half_even(impact, 4)).alias("disparate_impact_ratio"),
        when(half_even(parity, 4)).alias("parity_difference"),
        when(F.when(F.col("_n_ok") >= 2, half_even(F.col("_hi") - F.col("_lo"), 4))).alias("equal_opportunity_gap"),
        when(impact >= F.lit(v.IMPACT_FLOOR)).alias("passes_four_fifths"),
        alert.alias("bias_alert"))


def alert_sentence() -> Column:
    c = F.col
    return F.when(c("bias_alert"), worded(
        v.BIAS_ALERT, attribute=c("attribute"), least=c("least_favoured"), least_rate=percent(c("least_favoured_rate"), 1),
        most_rate=percent(c("most_favoured_rate"), 1), most=c("most_favoured"), ratio=plain(c("disparate_impact_ratio"), 2)))


def report_totals(df: DataFrame, score: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_applications"),
                  F.coalesce(F.avg(approved_by_score(score).cast("double")), F.lit(0.0)).alias("overall_approval_rate"),
                  F.coalesce(F.avg(score), F.lit(0.0)).alias("overall_mean_score"))


def fairness_report(df: DataFrame, score: str, target: str | None = None,
                    attributes: Sequence[str] = tuple(v.PROTECTED)) -> DataFrame:
    """Audit rows with the alert sentence and the table's totals beside them."""
    marked = df.withColumn("_approved", approved_by_score(score))
    per_attribute = audit(group_stats(marked, attributes, "_approved", target))
    totals = report_totals(df, score)
    return per_attribute.select("*", alert_sentence().alias("alert"),
                                *[c.alias(n) for n, c in values_of(totals).items()])


def aligned(scores: DataFrame, outcomes: DataFrame, id_col: str) -> DataFrame:
    """Scores and outcomes joined by id (never by position); ``unmatched`` marks rows
    present on one side only, which the caller must treat as an error."""
    s, o = scores.withColumn("_s", F.lit(True)), outcomes.withColumn("_o", F.lit(True))
    return (s.join(o, id_col, "full_outer")
            .withColumn("unmatched", F.col("_s").isNull() | F.col("_o").isNull()).drop("_s", "_o"))
