"""Named queries: every operator bound to the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocabulary as v
from ..functions import scoring
from ..functions.expr import first_match, half_even, plain
from ..functions.ordered import exact_quantiles, hash_position
from ..operators import (canonical, drift, explain, fairness, features, fraud, metrics, payload, portfolio,
                         quality, retrain, scenarios)
from . import bindings as b

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


# ---- features and canonicalisation ----------------------------------------------

@query
def engineered_features(spark, sf):
    df = features.derived(quality.repair(b.applications(spark, sf)))
    return df.select("application_id", *[r6(c).alias(c) for c in v.DERIVED_NUMERIC], *v.DERIVED_CATEGORICAL)


@query
def source_mapping(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    cust = b.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    ext = lambda m, hole: F.when(k % hole != 0, (k % m).cast("double") / F.lit(float(m - 20)))
    raw = b.table(spark, sf, "orders").join(cust, c == F.col("c_custkey")).select(
        k.alias("SK_ID_CURR"), (F.col("o_orderstatus") == "F").cast("int").alias("TARGET"),
        (-(F.lit(7000) + (k * 13) % 18000)).alias("DAYS_BIRTH"),
        first_match([(k % 17 == 0, v.NOT_EMPLOYED_DAYS)], (F.lit(200) - k % 6000)).alias("DAYS_EMPLOYED"),
        F.round((F.col("c_acctbal") + F.lit(1000.0)) * F.lit(12.0), 2).alias("AMT_INCOME_TOTAL"),
        F.col("o_totalprice").alias("AMT_CREDIT"),
        F.when(k % 19 != 0, (k % 23).cast("double") * F.lit(500.0)).alias("AMT_ANNUITY"),
        ext(100, 3).alias("EXT_SOURCE_1"), ext(90, 5).alias("EXT_SOURCE_2"), ext(80, 2).alias("EXT_SOURCE_3"),
        b.pick(k % 6, "Secondary / secondary special", "Lower secondary", "Incomplete higher",
               "Higher education", "Academic degree", "Other").alias("NAME_EDUCATION_TYPE"),
        b.pick(c % 9, "Working", "Commercial associate", "State servant", "Pensioner", "Businessman",
               "Unemployed", "Student", "Maternity leave", None).alias("NAME_INCOME_TYPE"),
        b.pick(c % 6, "Married", "Civil marriage", "Single / not married", "Separated", "Widow",
               "Unknown").alias("NAME_FAMILY_STATUS"),
        b.pick(k % 3, "Y", "N", None).alias("FLAG_OWN_REALTY"),
        F.when(k % 4 != 0, k % 3).alias("CNT_CHILDREN"),
        b.pick(k % 4, "Unaccompanied", "Family", "Children", None).alias("NAME_TYPE_SUITE"))
    return rounded(canonical.application_fields(raw).withColumnRenamed("SK_ID_CURR", "application_id"),
                   "MonthsEmployed", "DTIRatio")


def _payments(spark, sf):
    li = b.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity",
                                               "l_shipdate", "l_discount")
    o = b.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    k = F.col("l_orderkey")
    return li.join(o, k == F.col("o_orderkey")).select(
        F.when(k % 29 != 0, F.col("o_custkey")).alias("SK_ID_CURR"), F.lit(0).alias("DAYS_INSTALMENT"),
        F.when(k % 7 != 0, F.datediff("l_shipdate", "o_orderdate")).alias("DAYS_ENTRY_PAYMENT"),
        F.when(k % 13 != 0, F.col("l_quantity") * F.lit(1000.0)).alias("AMT_INSTALMENT"),
        F.col("l_extendedprice").alias("AMT_PAYMENT"))


@query
def installment_history(spark, sf):
    return rounded(canonical.instalment_history(_payments(spark, sf)), "InstallmentLatePaymentRate",
                   "InstallmentAvgDaysLate", "InstallmentAvgPaymentRatio")


def _bureau(spark, sf):
    k = F.col("o_orderkey")
    bureau = b.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("SK_ID_CURR"), k.alias("SK_ID_BUREAU"),
        F.when(F.col("o_orderstatus") == "O", "Active").otherwise("Closed").alias("CREDIT_ACTIVE"),
        (k % 4 - 1).alias("CREDIT_DAY_OVERDUE"), (-(k % 3000)).alias("DAYS_CREDIT"),
        F.when(k % 13 != 0, F.col("o_totalprice")).alias("AMT_CREDIT_SUM"),
        F.when(k % 3 != 0, F.col("o_totalprice") * (k % 10).cast("double") / F.lit(4.0)).alias("AMT_CREDIT_SUM_DEBT"))
    balance = b.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("SK_ID_BUREAU"), b.pick(F.col("l_linenumber"), "C", "0", "1", "X", "2", None, "5"
                                                          ).alias("STATUS"))
    return bureau, balance


@query
def two_level_rate(spark, sf):
    return rounded(canonical.bureau_history(*_bureau(spark, sf)), "BureauDebtToCreditRatio",
                   "BureauAvgDaysSinceCredit", "BureauBalanceDelinquencyRate")


def _previous(spark, sf):
    return b.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("SK_ID_CURR"), F.col("o_orderkey").alias("SK_ID_PREV"),
        first_match([(F.col("o_orderstatus") == "F", "Approved"), (F.col("o_orderstatus") == "P", "Refused")],
                    "Canceled").alias("NAME_CONTRACT_STATUS"))


@query
def prior_applications(spark, sf):
    return rounded(canonical.prior_applications(_previous(spark, sf)), "PriorApprovalRate", "PriorRefusalRate")


def _balances(spark, sf):
    k = F.col("l_suppkey")
    return b.table(spark, sf, "lineitem").select(
        F.when(F.col("l_partkey") % 31 != 0, k).alias("SK_ID_CURR"),
        F.col("l_extendedprice").alias("AMT_BALANCE"),
        F.when(F.col("l_quantity") > 3, F.col("l_quantity") * F.lit(1500.0)).otherwise(0.0).alias("AMT_CREDIT_LIMIT_ACTUAL"),
        F.when(F.col("l_orderkey") % 5 != 0, F.col("l_orderkey") % 40).alias("SK_DPD"))


@query
def card_utilisation(spark, sf):
    return rounded(canonical.card_history(_balances(spark, sf)), "CreditCardUtilizationRatio")


@query
def pos_dpd(spark, sf):
    return rounded(canonical.pos_history(_balances(spark, sf)), "PosAvgDaysPastDue")


@query
def canonical_join(spark, sf):
    who = b.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("SK_ID_CURR"), F.lit(None).cast("double").alias("NumCreditLines"),
        F.col("c_acctbal").alias("Income"))
    out = canonical.join_history(who, [
        canonical.bureau_history(*_bureau(spark, sf)), canonical.prior_applications(_previous(spark, sf)),
        canonical.instalment_history(_payments(spark, sf)), canonical.pos_history(_balances(spark, sf)),
        canonical.card_history(_balances(spark, sf))])
    return out.select("SK_ID_CURR", "Income", "NumCreditLines",
                      *[(c if c.startswith("Has") or c.endswith("Count") or "Max" in c else r6(c).alias(c))
                        for c in v.HISTORY_NUMERIC])


# ---- payloads, quality ----------------------------------------------------------

def _payloads(spark, sf):
    k = F.col("application_id")
    a = b.applications(spark, sf, lines=False)
    return a.select(
        "application_id",
        F.struct(F.when(k % 6 != 0, F.col("Age")).alias("age"),
                 b.pick(k % 5, "single", "MARRIED", "divorced", "widowed", "unknown").alias("maritalStatus"),
                 b.pick(k % 8, "full_time", "part_time", "self_employed", "contract", "retired", "unemployed",
                        "Full-time", None).alias("employmentType"),
                 F.when(k % 4 != 0, (k % 3).cast("int")).alias("dependents"),
                 b.pick(k % 6, "high_school", "bachelors", " masters ", "doctorate", "other", "PhD").alias("education"),
                 ).alias("personalInfo"),
        F.struct(F.when(k % 10 != 0, F.col("Income")).alias("income"),
                 F.when(k % 7 != 0, (k % 5).cast("double") * F.lit(9000.0)).alias("existingDebts"),
                 F.col("LoanAmount").alias("loanAmountRequested"), F.col("LoanTerm").cast("int").alias("tenure"),
                 F.col("CreditScore").alias("creditScore"),
                 b.pick(k % 9, "home_purchase", "auto_loan", "education", "business", "personal",
                        "debt_consolidation", "medical", "other", "Home").alias("purpose")).alias("financialInfo"),
        F.when(k % 12 == 0, F.lit(55555)).alias("income"),
        F.when(k % 24 == 0, F.lit(77777)).alias("annualIncome"),
        F.when(k % 15 == 0, F.lit(0.33)).alias("dtiRatio"),
        b.pick(k % 5, "true", "0", "Y", "maybe", None).alias("hasMortgage"),
        F.when(k % 14 == 0, F.lit("no")).alias("HasCoSigner"),
        F.when(k % 21 == 0, F.lit("41.5")).alias("Age"))


@query
def payload_normalise(spark, sf):
    out = payload.normalise(_payloads(spark, sf), ["application_id"])
    return rounded(out, "DTIRatio").withColumn("imputed", F.array_join(payload.imputed_fields(), ","))


@query
def intake_quarantine(spark, sf):
    k = F.col("application_id")
    a = b.applications(spark, sf, lines=False)
    blank = k % 113 == 0
    keep = lambda c: F.when(~blank, c)
    df = a.select(
        "application_id",
        F.struct(keep(first_match([(k % 50 == 0, 17.0)], F.col("Age"))).alias("age"),
                 keep(first_match([(k % 60 == 0, 21)], (k % 4).cast("int"))).alias("dependents")).alias("personalInfo"),
        F.struct(keep(first_match([(k % 70 == 0, -1.0)], F.col("Income"))).alias("income"),
                 keep(first_match([(k % 80 == 0, 481)], F.col("LoanTerm").cast("int"))).alias("tenure"),
                 keep(first_match([(k % 90 == 0, 851.0)], F.col("CreditScore"))).alias("creditScore")).alias("financialInfo"))
    checked = payload.intake_check(df, ignore=("application_id",))
    return payload.quarantined(checked).select("application_id", F.array_join("violations", ",").alias("violations"))


@query
def document_constraints(spark, sf):
    k = F.col("application_id")
    a = b.applications(spark, sf, lines=False)
    df = a.select(
        F.when(k % 41 != 0, F.col("applicant_id")).alias("applicantId"),
        F.struct("Age", b.pick(k % 5, "single", "married", "divorced", "widowed", "other").alias("maritalStatus"),
                 F.lit("contract").alias("employmentType"), (k % 5 - 1).alias("dependents"),
                 F.lit("masters").alias("education")).alias("personalInfo"),
        F.struct(F.when(k % 43 != 0, F.col("Income")).alias("income"), F.lit(0.0).alias("existingDebts"),
                 F.col("LoanAmount").alias("loanAmountRequested"), (F.col("LoanTerm") * 7).alias("tenure"),
                 (F.col("CreditScore") + F.lit(10.0)).alias("creditScore"), F.lit("medical").alias("purpose")).alias("financialInfo"),
        first_match([(k % 37 == 0, "draft")], F.col("status")).alias("status"),
        F.repeat(F.lit("x"), (F.lit(995) + k % 10).cast("int")).alias("notes"))
    return quality.violation_counts(quality.constraint_check(df, quality.application_rules()))


@query
def repair_clip(spark, sf):
    return quality.repair(b.messy_applications(spark, sf).drop("Default"))


@query
def validation_report(spark, sf):
    return quality.validation_report(b.messy_applications(spark, sf))


# ---- fraud ----------------------------------------------------------------------

@query
def fraud_rules(spark, sf):
    return fraud.screen(b.applications(spark, sf)).select(
        "application_id", "fraud_probability", "fraud_flag", "fraud_tier",
        F.array_join(F.transform("rules", lambda r: r["code"]), ",").alias("codes"),
        F.array_join("fraud_reasons", " ").alias("reasons"), "fraud_reason")


@query
def fraud_summary(spark, sf):
    df = features.derived(quality.repair(b.applications(spark, sf)))
    return (fraud.screen(df).groupBy("fraud_tier").agg(F.count(F.lit(1)).alias("applications"),
                                       F.count_if("fraud_flag").alias("flagged"),
                                       r6(F.avg("LoanToIncomeRatio")).alias("mean_loan_to_income"),
                                       r6(F.avg("ThinFileScore")).alias("mean_thin_file")))


@query
def resubmission(spark, sf):
    df = b.applications(spark, sf, lines=False).withColumn("NumCreditLines", F.lit(2.0))
    out = fraud.screen_with_history(df, ["nation", "segment"])
    return out.select(
        "application_id", "fingerprint", "occurrence", "previous_id", F.col("previous_ts").cast("timestamp_ntz").alias("previous_ts"),
        "Income_change_pct", "LoanAmount_change_pct", "fraud_probability", "fraud_tier",
        F.array_join(F.transform("rules", lambda r: r["code"]), ",").alias("codes"))


@query
def duplicate_groups(spark, sf):
    docs = b.table(spark, sf, "documents").select("doc_id", "text")
    return fraud.duplicate_groups(docs, F.sha2("text", 256), "doc_id").withColumn("key", F.left("key", F.lit(16))).withColumn(
        "members", F.array_join(F.transform("members", lambda x: x.cast("string")), ","))


@query
def identity_duplicates(spark, sf):
    a = b.applications(spark, sf, lines=False)
    return fraud.duplicate_groups(a, fraud.fingerprint(width=64), "application_id").withColumn("key", F.left("key", F.lit(16))).withColumn(
        "members", F.array_join(F.transform("members", lambda x: x.cast("string")), ","))


# ---- scoring and decisions ------------------------------------------------------

def _scored(spark, sf):
    return b.scored(b.applications(spark, sf, lines=False, income=False))


@query
def score_bands(spark, sf):
    return rounded(_scored(spark, sf).select("application_id", "risk_score", "risk_level", "confidence",
                                             scoring.confidence("probability").alias("plain_confidence")),
                   "confidence", "plain_confidence")


@query
def band_table(spark, sf):
    return rounded(metrics.band_table(_scored(spark, sf), "risk_level", "Default"), "share", "default_rate")


@query
def score_distribution(spark, sf):
    return rounded(metrics.score_distribution(_scored(spark, sf)), "mean", "p10", "p50", "p90")


@query
def risk_distribution(spark, sf):
    return metrics.level_counts(_scored(spark, sf))


@query
def batch_summary(spark, sf):
    df = fraud.screen(b.scored(b.applications(spark, sf)))
    return df.agg(half_even(F.avg("risk_score"), 2).alias("mean_risk_score"),
                  *[F.count_if(F.col("risk_level") == x).alias(x) for x in v.RISK_LEVELS],
                  F.count_if("fraud_flag").alias("flagged_for_fraud"))


def _decided(spark, sf):
    df = fraud.screen(b.scored(b.applications(spark, sf)).drop("status"))
    return portfolio.auto_decide(df)


@query
def auto_decision(spark, sf):
    return _decided(spark, sf).select("application_id", "ai_recommendation", "status", "final_decision")


@query
def auto_decision_audit(spark, sf):
    return portfolio.auto_audit(_decided(spark, sf))


@query
def decision_notifications(spark, sf):
    return (portfolio.notifications(_decided(spark, sf)).groupBy("user_id", "title", "message", "type", "read")
            .agg(F.count(F.lit(1)).alias("n")))


def _manual(spark, sf):
    o = b.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    requests = o.select(
        k.alias("application_id"), F.col("o_custkey").alias("applicant_id"), (k % 7).alias("officer_id"),
        b.pick(k % 5, "approve", "reject", "review", "approve", "escalate").alias("decision"),
        F.when(k % 3 != 0, F.concat(F.lit("note "), k.cast("string"))).alias("override_reason"))
    scores = o.select(k.alias("application_id"), F.when(k % 8 != 0, half_even(scoring.risk_score(
        (k % 1000).cast("double") / F.lit(1000.0), b.CUT), 2)).alias("risk_score"))
    return portfolio.manual_decide(requests, scores)


@query
def manual_override(spark, sf):
    return _manual(spark, sf)


@query
def officer_audit(spark, sf):
    return portfolio.officer_audit(_manual(spark, sf))


@query
def eligibility(spark, sf):
    a = b.applications(spark, sf, lines=False)
    pts = scoring.eligibility_points(F.col("Income"), F.col("LoanAmount"), F.col("CreditScore"),
                                     F.col("DTIRatio") * F.lit(100.0), F.col("MonthsEmployed") / F.lit(12.0))
    return a.select("application_id", pts.alias("points")).select(
        "*", scoring.eligibility_band(F.col("points")).alias("band"),
        scoring.eligibility_risk(F.col("points")).alias("risk"))


@query
def scenario_table(spark, sf):
    def rescore(df: DataFrame) -> DataFrame:
        p = (F.lit(0.6) * F.least(F.try_divide(F.col("LoanAmount"), F.col("Income") + F.lit(1000.0)) / F.lit(20.0), F.lit(1.0))
             + F.lit(0.4) * (F.lit(850.0) - F.col("CreditScore")) / F.lit(550.0))
        return df.withColumn("_p", p).withColumn("risk_score", half_even(scoring.risk_score("_p", b.CUT), 2)).withColumn(
            "risk_level", scoring.risk_level("risk_score")).drop("_p")

    a = b.applications(spark, sf, lines=False)
    return scenarios.scenario_table(a, {
        "raise_income": {"Income": F.round(F.col("Income") * F.lit(1.5), 2)},
        "smaller_loan": {"LoanAmount": F.round(F.col("LoanAmount") * F.lit(0.8), 2), "LoanTerm": 24.0},
        "unchanged": {},
    }, rescore).withColumn("changed_fields", F.array_join("changed_fields", ", "))


# ---- metrics ---------------------------------------------------------------------

@query
def classification_metrics(spark, sf):
    m = metrics.confusion_metrics(b.labelled(spark, sf), "y", "p", 0.5)
    return rounded(m, "accuracy", "balanced_accuracy", "precision", "recall", "f1", "brier_score")


@query
def auc_ap(spark, sf):
    return rounded(metrics.rank_metrics(b.labelled(spark, sf), "y", "p"), "roc_auc", "average_precision")


@query
def threshold_tuning(spark, sf):
    return rounded(metrics.tune_thresholds(b.labelled(spark, sf), "y", "p"), "low", "high", "decision", "base_rate")


@query
def curve_points(spark, sf):
    return rounded(metrics.curve_points(b.labelled(spark, sf), "y", "p"), "x", "y")


def _periods(spark, sf):
    """A score that is informative in most months and weak in some."""
    a = b.applications(spark, sf, lines=False, income=False)
    k, month = F.col("application_id"), F.month("ts")
    noise = (k * 7919 % 1000).cast("double") / F.lit(1000.0)
    p = first_match([(month % 4 == 1, noise)], F.lit(0.6) * noise + F.lit(0.4) * F.col("Default"))
    return a.select(F.date_format("ts", "yyyy-MM").alias("period"), F.lit("v1").alias("model_version"),
                    F.col("Default").alias("y"), p.alias("p"))


@query
def period_metrics(spark, sf):
    return rounded(metrics.period_metrics(_periods(spark, sf), "y", "p"), "accuracy", "balanced_accuracy",
                   "precision", "recall", "f1", "brier_score", "roc_auc", "average_precision")


@query
def performance_trend(spark, sf):
    history = metrics.rank_metrics(_periods(spark, sf), "y", "p", ["period"])
    return rounded(metrics.performance_trend(history), "latest_auc")


@query
def agreement(spark, sf):
    return metrics.officer_agreement(b.decisions(spark, sf))


@query
def throughput_lastn(spark, sf):
    recent = drift.last_events(b.predictions(spark, sf), 1000, "timestamp", "event_id")
    return metrics.throughput(recent, "timestamp", "value", "risk_score", "risk_level", "fraud_flag")


# ---- fairness --------------------------------------------------------------------

FAIR = ["AgeGroup", "MaritalStatus", "EmploymentType", "segment"]


def _audited(spark, sf):
    a = b.scored(features.derived(b.applications(spark, sf, lines=False)))
    # a score that leans against one segment, so that an alert is there to be found
    lean = F.when(F.col("segment") == "BUILDING", F.least(F.col("probability") * 3, F.lit(1.0))).otherwise(F.col("probability") * F.lit(0.2))
    return a.withColumn("risk_score", half_even(scoring.risk_score(lean, b.CUT), 2))


@query
def fairness_groups(spark, sf):
    df = _audited(spark, sf).withColumn("approved", fairness.approved_by_score("risk_score"))
    return rounded(fairness.group_stats(df, FAIR, "approved", "Default"), "approval_rate",
                   "creditworthy_approval_rate", "default_rate", "defaulter_approval_rate")


@query
def fairness_audit(spark, sf):
    out = fairness.fairness_report(_audited(spark, sf), "risk_score", "Default", FAIR)
    return rounded(out, "most_favoured_rate", "least_favoured_rate", "overall_approval_rate", "overall_mean_score")


@query
def aligned_outcomes(spark, sf):
    docs = b.table(spark, sf, "documents").select("doc_id", "n_chars")
    y = b.table(spark, sf, "labels").select("doc_id", "quality")
    return (fairness.aligned(docs, y, "doc_id").groupBy("unmatched")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("quality").cast("long").alias("positives")))


# ---- drift -----------------------------------------------------------------------

def _halves(spark, sf):
    e = b.table(spark, sf, "events").select("ts", "value", "event_type", "user_id")
    mid = F.lit("2024-01-16").cast("timestamp_ntz")
    return e.filter(F.col("ts") < mid), e.filter(F.col("ts") >= mid)


@query
def psi_numeric(spark, sf):
    out = drift.psi_numeric(*_halves(spark, sf), "value")
    return out.select("feature", r6("psi_raw").alias("psi_raw"), "status")


@query
def psi_categorical(spark, sf):
    out = drift.psi_categorical(*_halves(spark, sf), "event_type")
    return out.select("feature", r6("psi_raw").alias("psi_raw"), "status")


@query
def drift_report(spark, sf):
    ref, cur = _halves(spark, sf)
    cur = cur.withColumn("value", F.col("value") * F.lit(1.5))
    rows = drift.psi_rows(ref, cur, drift.fit_edges(ref, ["value", "user_id"]), ["event_type"])
    return rows.select("feature", "kind", r6("psi_raw").alias("psi_raw"), "status")


@query
def drift_totals(spark, sf):
    ref, cur = _halves(spark, sf)
    cur = cur.withColumn("value", F.col("value") * F.lit(1.5))
    rows = drift.psi_rows(ref, cur, drift.fit_edges(ref, ["value", "user_id"]), ["event_type"])
    return drift.drift_summary(rows).withColumns({
        "drifted": F.array_join("drifted", ","), "alerting": F.array_join("alerting", ",")})


@query
def prediction_drift(spark, sf):
    ref, cur = _halves(spark, sf)
    return drift.prediction_drift(ref, cur.withColumn("value", F.col("value") * F.lit(1.5)), "value")


@query
def log_drift(spark, sf):
    log = b.predictions(spark, sf)
    ref = log.filter(F.col("timestamp") < F.lit("2024-01-16").cast("timestamp_ntz"))
    edges = drift.fit_edges(ref, ["value", "risk_score"])
    out = drift.log_drift_report(log, ref, edges, ["event_type"], "risk_score", tie="event_id")
    return out.withColumn("drifted", F.array_join("drifted", ","))


@query
def missing_shift(spark, sf):
    a = b.applications(spark, sf, lines=False, income=False).withColumn("y", F.year("ts"))
    cols = ["MonthsEmployed", "EmploymentType", "LoanPurpose"]
    out = drift.missing_shift(a.filter("y < 1998"), a.filter("y >= 1998").withColumn(
        "LoanPurpose", F.lit(None).cast("string")), cols)
    return rounded(out, "reference_missing", "current_missing", "missing_shift")


# ---- portfolio -------------------------------------------------------------------

@query
def portfolio_kpis(spark, sf):
    a = _scored(spark, sf)
    return rounded(portfolio.portfolio_kpis(a, a), "approval_rate", "rejection_rate")


@query
def dashboard_counts(spark, sf):
    a = b.applications(spark, sf, lines=False, income=False)
    return portfolio.officer_dashboard(a, b.decisions(spark, sf), "officer-3",
                                       F.lit("1998-03-05 10:00:00").cast("timestamp_ntz"))


@query
def client_dashboard(spark, sf):
    out = portfolio.client_dashboard(_scored(spark, sf))
    return out.withColumns({"loan_volume": F.round("loan_volume", 2), "mean_score": r6("mean_score")})


@query
def monthly_trend(spark, sf):
    return rounded(portfolio.monthly_trend(_scored(spark, sf)), "avg_score")


@query
def purpose_breakdown(spark, sf):
    return portfolio.breakdown(b.applications(spark, sf, lines=False, income=False))


@query
def action_list(spark, sf):
    return portfolio.action_list(b.audit_log(spark, sf))


@query
def unread_notifications(spark, sf):
    e = b.table(spark, sf, "events").select("user_id", (F.col("event_id") % 3 == 0).alias("read"))
    return portfolio.unread_notifications(e)


@query
def review_queue(spark, sf):
    a = b.applications(spark, sf, lines=False, income=False)
    scores = fraud.screen(b.scored(b.applications(spark, sf))).select("application_id", "risk_level", "fraud_flag")
    return portfolio.review_queue(a, b.users(spark, sf), scores, level="medium", fraud=False).select(
        "application_id", "applicant_id", "ts", "name", "email")


@query
def applicant_search(spark, sf):
    a = b.applications(spark, sf, lines=False, income=False).select(
        "application_id", "applicant_id", "status", F.col("application_id").cast("string").alias("code"))
    joined = a.join(b.users(spark, sf).withColumnRenamed("user_id", "applicant_id"), "applicant_id", "left")
    hits = portfolio.search(portfolio.where_equal(joined, status="under_review"), "MER#00000012", ["name", "code"])
    return hits.select("application_id", "name", portfolio.matches("email", r"9@EXAMPLE").alias("ends_in_nine"))


@query
def case_history(spark, sf):
    a = b.applications(spark, sf, lines=False, income=False).select("application_id", "applicant_id", "status")
    out = portfolio.case_file(a, b.score_history(spark, sf), b.decisions(spark, sf), b.users(spark, sf))
    return out.select("application_id", "applicant_id", "status", "risk_score", "risk_level", "name",
                      "n_decisions", "last_decision", "last_officer")


@query
def case_decisions(spark, sf):
    a = b.applications(spark, sf, lines=False, income=False)
    return portfolio.case_decisions(portfolio.where_equal(a, status="under_review"), b.decisions(spark, sf))


@query
def decision_history(spark, sf):
    a = b.applications(spark, sf, lines=False, income=False)
    return portfolio.decision_history(b.decisions(spark, sf), a, b.users(spark, sf), "officer-3").select(
        "application_id", "decided_at", "final_decision", "applicant_id", "LoanAmount", "name")


@query
def audit_page(spark, sf):
    log = portfolio.where_equal(b.audit_log(spark, sf), actor_type=["AI", "Officer"])
    log = log.filter(portfolio.matches("action", "ERR|click"))
    return portfolio.page(log, [F.desc("timestamp"), F.desc("log_id")], number=3, size=20)


@query
def latest_score(spark, sf):
    return portfolio.latest_per(b.score_history(spark, sf), "application_id", "scored_at", "seq")


@query
def newest_per_user(spark, sf):
    return portfolio.newest_per(b.audit_log(spark, sf).select("log_id", "timestamp", "action", "actor_type"),
                                "actor_type", "timestamp", "log_id", 50)


@query
def risk_report(spark, sf):
    a = b.scored(features.derived(b.applications(spark, sf, lines=False)))
    a = a.join(b.users(spark, sf).withColumnRenamed("user_id", "applicant_id"), "applicant_id", "left")
    return portfolio.risk_report_rows(a.withColumns({
        "risk_score": F.when(F.col("application_id") % 9 != 0, F.col("risk_score")),
        "fraud_flag": F.col("application_id") % 37 == 0, "fraud_reason": F.lit(None).cast("string")}))


@query
def chat_intents(spark, sf):
    c = b.table(spark, sf, "conversations").filter(F.col("role") == "user")
    k = F.col("conv_id")
    # two thirds of the questions name an application; three in four carry a routed word
    questions = c.select("conv_id", "turn", F.when(k % 3 != 0, k).alias("application_id"),
                         F.concat(b.pick(k % 4, "WHY was it? ", "document: ", "Rejected ", ""), "text").alias("question"))
    explained = b.table(spark, sf, "documents").select(
        F.col("doc_id").alias("application_id"), F.array(F.concat(F.lit("Source "), "source")).alias("sentences"))
    return portfolio.answer_questions(questions, explained).select("conv_id", "turn", "intent", "answer")


def _explained(spark, sf):
    """Factors from a hand-set linear rule, so that the wording is checkable in SQL."""
    a = b.scored(features.derived(b.applications(spark, sf, lines=False)))
    parts = {
        "CreditScore": (F.lit(575.0) - F.col("CreditScore")) / F.lit(400.0),
        "LoanToIncomeRatio": (F.col("LoanToIncomeRatio") - F.lit(12.0)) / F.lit(30.0),
        "DTIRatio": F.col("DTIRatio") - F.lit(0.77),
        "InstallmentCount": F.lit(9.0),
        "LoanPurpose": F.when(F.col("LoanPurpose").isin("Home", "Auto"), F.lit(-0.31)).otherwise(F.lit(0.29)),
    }
    contribs = F.array(*[F.struct(F.lit(n).alias("feature"), c.alias("contribution")) for n, c in parts.items()])
    a = a.withColumn("contribs", contribs)
    return a.withColumn("factors", explain.top_factors("contribs", {n: F.col(n) for n in parts if n != "InstallmentCount"}, 3))


@query
def narrative(spark, sf):
    value = r" \(value: ([^)]*)\)"

    def number(line):
        text = F.regexp_extract(line, value, 1)
        return F.coalesce(plain(text.try_cast("double"), 3), text)

    out = explain.with_narrative(_explained(spark, sf), audience="applicant").withColumn(
        "lines", F.transform(explain.describe_factors(), lambda f: f["description"]))
    return out.select("application_id", F.array_join("sentences", " ").alias("sentences"),
                      F.regexp_replace(F.array_join("lines", " "), value, "").alias("description"),
                      F.array_join(F.transform("lines", number), "|").alias("shown"))


# ---- retraining, registry ---------------------------------------------------------

def _retrain_inputs(spark, sf):
    o = b.table(spark, sf, "orders")
    li = b.table(spark, sf, "lineitem")
    historical = o.select(F.col("o_orderkey").alias("LoanID"), F.col("o_orderkey").alias("arrival"),
                          F.col("o_totalprice").alias("LoanAmount"), F.lit(0).alias("Default"))
    k = F.col("l_orderkey")
    outcomes = li.select(
        F.when(k % 4 != 0, k).alias("LoanID"), (F.lit(10_000_000) + k * 10 + F.col("l_linenumber")).alias("arrival"),
        F.col("l_quantity").cast("double").alias("LoanAmount"),
        F.when(F.col("l_linenumber") != 3, F.col("l_linenumber") % 2).cast("int").alias("Default"))
    return historical, outcomes


@query
def retrain_dedup(spark, sf):
    historical, outcomes = _retrain_inputs(spark, sf)
    return retrain.retraining_dataset(historical, outcomes)


@query
def retrain_statistics(spark, sf):
    historical, outcomes = _retrain_inputs(spark, sf)
    return retrain.dataset_statistics(historical, outcomes, retrain.retraining_dataset(historical, outcomes))


def _registry(spark, sf):
    """Each month is a trained version with the AUC measured in it."""
    h = metrics.rank_metrics(_periods(spark, sf), "y", "p", ["period"])
    return h.select(F.concat(F.lit("v"), "period").alias("version"), F.col("period").alias("created_at"), "roc_auc")


def _activations(spark, sf):
    """The first month of a quarter activates its version; each activation is logged twice."""
    e = (b.table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("m"),
                                             F.month("o_orderdate").alias("n")).distinct().filter(F.col("n").isin(1, 4, 7, 10)))
    return e.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("again"), "m").select(
        F.concat(F.lit("v"), "m").alias("version"), F.concat("m", F.lit("-"), F.col("again").cast("string")).alias("activated_at"))


@query
def registry_view(spark, sf):
    from ..sources import registry
    return rounded(registry.versions_view(_registry(spark, sf), _activations(spark, sf)), "roc_auc")


@query
def registry_prune(spark, sf):
    from ..sources import registry
    return registry.prunable(_registry(spark, sf), _activations(spark, sf), keep=5)


@query
def promotion_decision(spark, sf):
    """Each month's version challenges the one active in the month before."""
    from pyspark.sql import Window as W
    r = _registry(spark, sf)
    w = W.orderBy("created_at")  # one row per month
    pairs = r.select(F.col("version").alias("challenger"), F.col("roc_auc").alias("challenger_auc"),
                     F.lag("version").over(w).alias("champion"), F.lag("roc_auc").over(w).alias("champion_auc"))
    out = pairs.withColumns(retrain.promotion(*[F.col(c) for c in ("challenger", "challenger_auc", "champion", "champion_auc")]))
    return rounded(out, "challenger_auc", "champion_auc")


@query
def retrain_triggers(spark, sf):
    ref, cur = _halves(spark, sf)
    d = drift.prediction_drift(ref, cur.withColumn("value", F.col("value") * F.lit(1.5)), "value")
    trend = metrics.performance_trend(metrics.rank_metrics(_periods(spark, sf), "y", "p", ["period"]))
    o = b.table(spark, sf, "orders").select(F.col("o_orderdate").alias("recorded_at"))
    out = retrain.retrain_triggers(d, trend, o, last_trained=F.lit("2000-01-01").cast("timestamp_ntz"))
    return out.withColumn("reasons", F.array_join("reasons", " "))


@query
def model_health(spark, sf):
    log = drift.last_events(b.predictions(spark, sf), 1000, "timestamp", "event_id")
    ref, cur = _halves(spark, sf)
    m = metrics.rank_metrics(b.labelled(spark, sf), "y", "p").select("roc_auc")
    trend = metrics.performance_trend(metrics.rank_metrics(_periods(spark, sf), "y", "p", ["period"]))
    audit = fairness.fairness_report(_audited(spark, sf), "risk_score", "Default", FAIR)
    out = retrain.model_health(
        m, drift.prediction_drift(ref, cur, "value"), trend,
        metrics.throughput(log, "timestamp", "value", "risk_score", "risk_level", "fraud_flag"),
        audit.agg(F.max("bias_alert")).scalar())
    return rounded(out, "roc_auc").withColumn("alerts", F.array_join("alerts", " | "))


# ---- preparation for learning ------------------------------------------------------

STAT_COLUMNS = ["Income", "LoanAmount", "MonthsEmployed", "DTIRatio", "LoanToIncomeRatio"]


@query
def preprocess_stats(spark, sf):
    df = features.derived(quality.repair(b.applications(spark, sf, lines=False)))
    q = exact_quantiles(df, STAT_COLUMNS, [0.005, 0.5, 0.995])
    return (q.groupBy("feature").pivot("prob", [0.005, 0.5, 0.995]).agg(F.first("value"))
            .select("feature", r6(F.col("`0.005`")).alias("clip_low"), r6(F.col("`0.5`")).alias("median"),
                    r6(F.col("`0.995`")).alias("clip_high")))


@query
def category_modes(spark, sf):
    from ..learn.preprocess import modes
    return modes(quality.repair(b.applications(spark, sf, lines=False, income=False)), v.CATEGORICAL)


@query
def class_weight(spark, sf):
    out = quality.class_balance(b.applications(spark, sf, lines=False, income=False))
    return rounded(out, "rate", "pos_weight")


def _positions(spark, sf):
    a = b.applications(spark, sf, lines=False, income=False)
    return a.select("application_id", "Default", hash_position("application_id").alias("position"))


@query
def strat_split(spark, sf):
    from ..learn.preprocess import stratified_split
    out = stratified_split(_positions(spark, sf), "Default", "application_id", position="position")
    return out.select("application_id", "split")


@query
def undersample(spark, sf):
    from ..learn.preprocess import undersample as op
    return op(_positions(spark, sf), "Default", "application_id", position="position").select("application_id", "Default")


@query
def stratified_folds(spark, sf):
    from ..learn.preprocess import fold_column
    folds = _positions(spark, sf).withColumn("fold", fold_column("position", 5))
    return folds.groupBy("Default", "fold").agg(F.count(F.lit(1)).alias("n"))


@query
def record_constraints(spark, sf):
    """Broken rules per kind of operational record, over records made from orders, customers and labelled documents."""
    k, c, d = F.col("o_orderkey"), F.col("c_custkey"), F.col("doc_id")
    orders, people, cohorts = b.table(spark, sf, "orders"), b.table(spark, sf, "customer"), b.labelled(spark, sf)
    app = F.when(k % 41 != 0, k).alias("applicationId")
    text = lambda letter, least, n: F.repeat(F.lit(letter), (F.lit(least) + n % 10).cast("int"))
    records = {
        "risk_score": (orders.select(app, F.when(k % 43 != 0, k % 130 - 10).alias("riskScore"), b.pick(k % 4, "low", "medium", "high", "extreme").alias("riskLevel"),
                                     ((k % 12).cast("double") / F.lit(10.0)).alias("confidenceScore")), quality.risk_score_rules()),
        "decision": (orders.select(app, F.when(k % 7 != 0, F.col("o_custkey")).alias("decidedBy"),
                                   b.pick(k % 4, "approve", "reject", "review", "maybe").alias("aiRecommendation"),
                                   b.pick(k % 4, "approve", "reject", "review", None).alias("finalDecision"), text("x", 495, k).alias("overrideReason")), quality.decision_rules()),
        "audit": (orders.select(b.pick(k % 6, "AI", "Officer", "Admin", "System", "Robot", None).alias("actorType"), text("a", 195, k).alias("action"),
                                text("d", 995, k).alias("details")), quality.audit_rules()),
        "metric": (cohorts.select(F.when(d % 11 != 0, d).alias("date"), (F.col("p") * 1.5).alias("accuracy"), F.col("p").alias("aucRoc"),
                                  (F.col("p") - 0.2).alias("driftScore"), (F.col("p") * 1.25).alias("agreementRate")), quality.metric_rules()),
        "notification": (people.select(F.when(c % 41 != 0, c).alias("userId"), text("t", 195, c).alias("title"), text("m", 995, c).alias("message"),
                                       b.pick(c % 3, "status_update", "system", "advert").alias("type")), quality.notification_rules()),
        "user": (people.select(F.when(c % 13 != 0, F.col("c_name")).alias("name"), F.concat("c_name", b.pick(c % 4, "@bank.org", "@bank", "bank.org", " @bank.org")).alias("email"),
                               text("p", 0, c).alias("password"), b.pick(c % 4, "applicant", "officer", "admin", "guest").alias("role"),
                               b.pick(c % 3, "active", "suspended", "closed").alias("status")), quality.user_rules()),
    }
    parts = [quality.violation_counts(quality.constraint_check(df, rules)).select(F.lit(name).alias("record"), "rule", "n") for name, (df, rules) in records.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@query
def fold_metrics(spark, sf):
    """Mean and population deviation over five folds of the metrics of labelled documents."""
    folds = b.labelled(spark, sf).withColumn("fold", F.col("doc_id") % 5)
    per = metrics.classification_metrics(folds, "y", "p", 0.5, ["fold"])
    return rounded(metrics.fold_summary(per, ["accuracy", "recall"]), "accuracy_mean", "accuracy_std", "recall_mean", "recall_std")


@query
def public_profiles(spark, sf):
    """Customers as users with their secrets; only the public columns come out."""
    c = b.table(spark, sf, "customer")
    users = c.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.concat("c_name", F.lit("@bank.org")).alias("email"),
                     F.lit("applicant").alias("role"), F.lit("active").alias("status"), F.sha2("c_name", 256).alias("password"), F.lit("t").alias("refreshToken"))
    return portfolio.public_users(users)


@query
def financial_limits(spark, sf):
    """Applications within the limits on debt to income and on loan to income, by purpose."""
    a = features.derived(quality.repair(b.applications(spark, sf))).withColumns(portfolio.financial_flags())
    return a.groupBy("LoanPurpose").agg(*[F.count_if(F.col(c)).alias(c) for c in ("dti_ok", "lti_ok")], F.count(F.lit(1)).alias("n"))
