"""Consistency rules, resubmission detection and their combination.

Rules are data: ``(code, weight, condition, reason)``. A new rule is one more entry,
not a UDF.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import vocabulary as v
from ..functions.expr import first_match, fixed, half_even, percent_change, plain, values_of, worded
from ..session import cut_lineage


def _value(name: str, default: float) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(float(default)))


def consistency_rules(missing_is_unknown: bool = False) -> list[tuple[str, float, Column, Column]]:
    """Combinations of declared values that cannot all be true.

    Missing inputs default to harmless values (age 40, score 600) or to 0. With
    ``missing_is_unknown`` the two rules that fire on a defaulted 0 (no credit lines,
    no income) need the value to be really there.
    """
    age, score = _value("Age", 40), _value("CreditScore", 600)
    income, loan, months, lines, dti = (
        _value(c, 0) for c in ("Income", "LoanAmount", "MonthsEmployed", "NumCreditLines", "DTIRatio"))
    job = F.coalesce(F.col("EmploymentType"), F.lit(""))
    know = lambda c: F.col(c).isNotNull() if missing_is_unknown else F.lit(True)
    say = lambda rule, **slots: worded(v.FRAUD_REASONS[rule], **slots)
    multiple = F.try_divide(loan, income)
    round_figure = lambda c: (c > 0) & (c % F.lit(10000.0) == 0)
    return [
        ("INCOME_EMPLOYMENT_MISMATCH", 0.35, (job == "Unemployed") & (income > 75_000), say("unemployed_income", income=fixed(income))),
        ("INCOME_EMPLOYMENT_MISMATCH", 0.20, (job == "Part-time") & (income > 120_000), say("part_time_income", income=fixed(income))),
        ("TENURE_EXCEEDS_AGE", 0.40, months > F.greatest((age - F.lit(16.0)) * F.lit(12.0), F.lit(0.0)),
         say("tenure", months=plain(months), age=plain(age))),
        ("CREDIT_HISTORY_AGE_MISMATCH", 0.25, (age < 22) & (lines >= 4), say("credit_lines", lines=plain(lines), age=plain(age))),
        ("CREDIT_SCORE_AGE_MISMATCH", 0.30, (age < 21) & (score > 780), say("young_score", score=plain(score), age=plain(age))),
        ("IMPLAUSIBLE_LOAN_TO_INCOME", 0.25, (income > 0) & (multiple > 8), say("loan_multiple", multiple=plain(multiple, 1))),
        ("ZERO_INCOME_WITH_LOAN_REQUEST", 0.35, (income <= 0) & (loan > 0) & know("Income"), say("no_income")),
        ("DTI_CREDIT_SCORE_CONTRADICTION", 0.20, (dti > F.lit(0.85)) & (score > 760),
         say("debt_ratio", ratio=plain(dti, 2), score=plain(score))),
        ("SCORE_WITHOUT_CREDIT_FILE", 0.25, (lines == 0) & (score > 720) & know("NumCreditLines"), say("no_lines", score=plain(score))),
        ("SUSPICIOUSLY_ROUND_FIGURES", 0.10, round_figure(income) & round_figure(loan), say("round_figures")),
    ]


def _rule(cond: Column, code: Column | str, weight: Column | float, reason: Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(cond, F.struct(lit(code).alias("code"), lit(weight).alias("weight"),
                                 reason.alias("reason")))


def triggered(rules: Sequence[tuple[str, float, Column, Column]], extra: Sequence[Column] = ()) -> Column:
    """Array of the rules that fire, each a struct (code, weight, reason)."""
    fired = [_rule(cond, code, weight, reason) for code, weight, cond, reason in rules]
    return F.array_compact(F.array(*fired, *extra))


def fraud_probability(rules: Sequence[tuple[str, float, Column, Column]], *more: Column) -> Column:
    """1 - product of (1 - weight) over the firing rules; ``more`` are extra factors.

    Taken from the conditions, not from the array of fired rules: a query that does not
    ask for the reasons never builds them."""
    miss = F.lit(1.0)
    for factor in [*[F.when(cond, F.lit(1.0 - w)).otherwise(F.lit(1.0)) for _, w, cond, _ in rules], *more]:
        miss = miss * factor
    return half_even(F.lit(1.0) - miss, 4)


def _with_verdict(df: DataFrame) -> DataFrame:
    """Flag, tier and texts from ``fraud_probability`` and ``rules``."""
    p = F.col("fraud_probability")
    flag = p >= F.lit(v.FRAUD_FLAG_AT)
    reasons = F.transform("rules", lambda x: x["reason"])
    return df.withColumns({
        "fraud_flag": flag,
        "fraud_tier": first_match([(flag, "high"), (p >= F.lit(v.FRAUD_MEDIUM_AT), "medium")], "low"),
        "fraud_reasons": reasons,
        "fraud_reason": F.when(flag, F.array_join(reasons, " ")),
    })


def screen(df: DataFrame, missing_is_unknown: bool = False) -> DataFrame:
    """Append the consistency screening; no shuffle. Columns not selected later (the
    rules with their texts above all) are pruned from the plan."""
    rules = consistency_rules(missing_is_unknown)
    return _with_verdict(df.withColumns({"fraud_probability": fraud_probability(rules), "rules": triggered(rules)}))


# ---- identity and resubmission --------------------------------------------------

def fingerprint(fields: Sequence[str] = v.IDENTITY_FIELDS, width: int = 32) -> Column:
    """Hash of the stable attributes; amounts are left out because a resubmission may
    change exactly those."""
    parts = [F.coalesce(F.lower(F.trim(F.col(f).cast("string"))), F.lit("none")) for f in fields]
    return F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(width))


def previous_submissions(df: DataFrame, key: str, ts: str = "ts", id_col: str = "application_id",
                         carry: Sequence[str] = ("Income", "LoanAmount")) -> DataFrame:
    """Occurrence number and previous submission of the same ``key``.

    Five coarse attributes collide often, so one key may own a large part of the
    table. The rows are therefore dealt by range of (key, time, id) into partitions of
    even size, which split a hot key wherever it is too large, a busy month or rows
    without a time included. The window runs per (key, partition); what precedes a
    partition comes from a table with one row per key and partition: its running count
    and last submission. The result equals one window over the whole key. The dealt
    rows are written once, so that every reader sees the same ranges.
    ``key`` must not be NULL (a fingerprint never is).
    """
    snapshot = F.struct(F.col(ts).alias("ts"), F.col(id_col).alias("id"),
                        *[F.col(c).alias(c) for c in carry])
    dealt = df.withColumn("_row", snapshot).repartitionByRange(key, F.col(ts).asc_nulls_first(), id_col)
    rows = cut_lineage(dealt.withColumn("_segment", F.spark_partition_id()))
    inside = W.partitionBy(key, "_segment").orderBy(F.col(ts).asc_nulls_first(), id_col)
    local = rows.withColumns({"_rank": F.row_number().over(inside),
                              "_lag": F.lag("_row").over(inside)})
    summary = rows.groupBy(key, "_segment").agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.struct(F.col(ts), F.col(id_col), F.col("_row"))).alias("_last"))
    across = W.partitionBy(key).orderBy("_segment")
    before = summary.select(
        key, "_segment",
        F.coalesce(F.sum("_n").over(across.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.lag("_last").over(across)["_row"].alias("_carried"))
    joined = local.join(before, [key, "_segment"])
    prev = F.coalesce(F.col("_lag"), F.col("_carried"))
    return joined.withColumns({
        "occurrence": (F.col("_rank") + F.col("_before")).cast("long"),
        "previous_id": prev["id"], "previous_ts": prev["ts"],
        **{f"{c}_change_pct": percent_change(prev[c], F.col(c)) for c in carry},
    }).drop("_segment", "_row", "_rank", "_lag", "_before", "_carried")


def _inflated() -> Column:
    return F.coalesce(F.col("Income_change_pct") > 20, F.lit(False))


def _repeat_weight() -> Column:
    return first_match([(_inflated(), 0.55), (F.col("occurrence") == 2, 0.25)], 0.40)


def resubmission_rule() -> Column:
    """Struct (code, weight, reason) for a repeated application, NULL for a first one."""
    n, change, inflated = F.col("occurrence"), F.col("Income_change_pct"), _inflated()
    code = F.when(inflated, "DUPLICATE_WITH_INFLATED_INCOME").otherwise("DUPLICATE_APPLICATION")
    weight = _repeat_weight()
    reason = F.when(inflated, worded(v.FRAUD_REASONS["inflated_income"], change=plain(change))).otherwise(
        worded(v.FRAUD_REASONS["seen_before"], times=(n - 1).cast("string")))
    return _rule(n > 1, code, weight, reason)


def screen_with_history(df: DataFrame, fields: Sequence[str] = v.IDENTITY_FIELDS,
                        **window) -> DataFrame:
    """Consistency rules and resubmission rules together."""
    seen = previous_submissions(df.withColumn("fingerprint", fingerprint(fields)), "fingerprint", **window)
    rules, extra = consistency_rules(), resubmission_rule()
    repeated = F.when(F.col("occurrence") > 1, F.lit(1.0) - _repeat_weight()).otherwise(F.lit(1.0))
    return _with_verdict(seen.withColumns({"fraud_probability": fraud_probability(rules, repeated),
                                           "rules": triggered(rules, [extra])}))


def duplicate_groups(df: DataFrame, key: Column, id_col: str, members: int = 20,
                     groups: int = 50) -> DataFrame:
    """Largest groups sharing a key, with their first members and the overall totals.

    Counting is a partial aggregation. The member list filters ``row_number() <= k``,
    which Spark cuts down before the shuffle (WindowGroupLimit), so a hot key moves
    at most k rows per task.
    """
    keyed = df.select(key.alias("key"), F.col(id_col).alias("id"))
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("occurrences")).filter("occurrences > 1")
    totals = counts.agg(F.count(F.lit(1)).alias("duplicate_groups"),
                        F.coalesce(F.sum("occurrences"), F.lit(0)).alias("duplicate_rows"))
    top = counts.orderBy(F.desc("occurrences"), "key").limit(groups)
    # at most ``groups`` rows on the broadcast side, one on the other
    first = (keyed.join(F.broadcast(top.select("key")), "key", "left_semi")
             .withColumn("rn", F.row_number().over(W.partitionBy("key").orderBy("id")))
             .filter(F.col("rn") <= members)
             .groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("members")))
    return top.join(first, "key").select(
        "key", "occurrences", "members",
        *[c.alias(n) for n, c in values_of(totals).items()])
