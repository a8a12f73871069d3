"""Claims about features, payloads, quality, fraud, fairness, drift, metrics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendframe import vocabulary as v
from lendframe.functions import scoring
from lendframe.operators import (canonical, drift, explain, fairness, features, fraud, metrics, payload, portfolio, quality,
                                 retrain, scenarios)

GOOD = dict(application_id=1, Age=40.0, Income=60000.0, LoanAmount=30000.0, CreditScore=700.0, MonthsEmployed=60.0,
            NumCreditLines=2.0, InterestRate=8.0, LoanTerm=36.0, DTIRatio=0.3, Education="Bachelor's",
            EmploymentType="Full-time", MaritalStatus="Married", HasMortgage="Yes", HasDependents="No",
            LoanPurpose="Home", HasCoSigner="No")
SCHEMA = "application_id long, " + ", ".join(f"{c} double" for c in v.NUMERIC) + ", " + ", ".join(f"{c} string" for c in v.CATEGORICAL)


def frame(spark, *changes):
    rows = [{**GOOD, "application_id": i + 1, **c} for i, c in enumerate(changes)]
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SCHEMA)


# ---- features -------------------------------------------------------------------

@pytest.mark.parametrize("p,r,t,want", [(100_000, 12, 12, 8884.88), (120_000, 0, 12, 10_000), (1000, None, None, 1000),
                                        (1000, 60.0, 480, 50.0)])
def test_instalment(spark, p, r, t, want):
    lit = lambda x: F.lit(x).cast("double")
    got = spark.range(1).select(features.monthly_instalment(lit(p), lit(r), lit(t))).first()[0]
    assert got == pytest.approx(want, abs=0.01)


def test_bands_and_ratios(spark):
    df = features.derived(frame(spark, dict(Age=20.0), dict(Age=30.0), dict(Age=45.0), dict(Age=60.0), dict(Age=70.0),
                                dict(Income=50_000.0, LoanAmount=150_000.0), dict(Income=0.0), dict(CreditScore=None)))
    rows = {r["application_id"]: r for r in df.collect()}
    assert [rows[i]["AgeGroup"] for i in range(1, 6)] == ["18-25", "26-35", "36-50", "51-65", "65+"]
    assert rows[6]["LoanToIncomeRatio"] == 3.0
    assert rows[7]["LoanToIncomeRatio"] == 0.0
    assert rows[8]["CreditScoreBandOrdinal"] is None


def test_model_frame_has_every_column_even_from_nothing(spark):
    out = features.model_frame(spark.range(1).withColumnRenamed("id", "x"))
    assert out.columns == v.ALL_FEATURES and out.count() == 1


def test_repair(spark):
    df = spark.createDataFrame([("9999", "Kindergarten"), ("-50", "PhD"), ("oops", None)], "CreditScore string, Education string")
    rows = quality.repair(df).select("CreditScore", "Education", "Age").collect()
    assert [tuple(r) for r in rows] == [(850.0, None, None), (300.0, "PhD", None), (None, None, None)]


def test_validation_flags(spark):
    df = frame(spark, {}, dict(LoanPurpose="Spaceship")).withColumn("Default", F.lit(0))
    found = {(r["column"], r["check"]): r for r in quality.validation_report(df.drop("HasCoSigner", "InterestRate")).collect()}
    assert found[("LoanPurpose", "unknown_level")]["detail"] == "Spaceship"
    assert ("Default", "single_class") in found and ("HasCoSigner", "missing_column") in found
    with pytest.raises(ValueError):
        quality.require_valid(quality.validation_report(df))
    empty = quality.validation_report(df.limit(0))
    assert any(r["check"] == "empty_table" for r in empty.collect())


def test_payload_precedence_and_dti(spark):
    df = spark.createDataFrame(
        [((30.0, "widowed", "unemployed", 2, "bachelors"), (50000.0, 25000.0, 9000.0, 24, 700.0, "medical"), "61000", None, "PhD")],
        "personalInfo struct<age:double,maritalStatus:string,employmentType:string,dependents:int,education:string>, "
        "financialInfo struct<income:double,existingDebts:double,loanAmountRequested:double,tenure:int,creditScore:double,purpose:string>, "
        "annualIncome string, Age double, Education string")
    r = payload.normalise(df).withColumn("imputed", payload.imputed_fields()).first()
    assert (r["Age"], r["Income"], r["Education"], r["MaritalStatus"], r["HasDependents"], r["LoanPurpose"], r["MonthsEmployed"]) == (
        30.0, 61000.0, "PhD", "Divorced", "Yes", "Other", 0.0)
    assert r["DTIRatio"] == 0.5 and r["imputed"] == ["NumCreditLines", "InterestRate", "HasMortgage", "HasCoSigner"]


@pytest.mark.parametrize("debts,income,explicit,want", [(50_000, 100_000, 0.33, 0.33), (1, 0, None, None), (0, 1, None, None),
                                                        (1e7, 1e4, None, 1.5)])
def test_derive_dti(spark, debts, income, explicit, want):
    lit = lambda x: F.lit(x).cast("double")
    assert spark.range(1).select(payload.derive_dti(lit(debts), lit(income), lit(explicit))).first()[0] == want


# ---- canonical table: null traps --------------------------------------------------

def test_instalment_history_nulls(spark):
    df = spark.createDataFrame([(1, 0.0, 5.0, 100.0, 100.0), (1, 0.0, None, 100.0, None), (None, 0.0, 9.0, 1.0, 1.0)],
                               "SK_ID_CURR long, DAYS_INSTALMENT double, DAYS_ENTRY_PAYMENT double, AMT_INSTALMENT double, AMT_PAYMENT double")
    r = canonical.instalment_history(df).collect()
    assert len(r) == 1 and tuple(r[0]) == (1, 2, 0.5, 5.0, 1.0)


def test_two_level_mean_and_empty_sums(spark):
    bureau = spark.createDataFrame([(1, 10, "Active", 0, -100, None, None), (1, 11, "Closed", 3, -300, None, None)],
                                   "SK_ID_CURR long, SK_ID_BUREAU long, CREDIT_ACTIVE string, CREDIT_DAY_OVERDUE int, DAYS_CREDIT int, AMT_CREDIT_SUM double, AMT_CREDIT_SUM_DEBT double")
    balance = spark.createDataFrame([(10, "1")] + [(11, "C")] * 9, "SK_ID_BUREAU long, STATUS string")
    r = canonical.bureau_history(bureau, balance).first()
    assert r["BureauBalanceDelinquencyRate"] == 0.5 and r["BureauDebtToCreditRatio"] == 0.0
    assert r["BureauAvgDaysSinceCredit"] == 200.0 and r["BureauActiveLoanCount"] == 1


# ---- fraud -------------------------------------------------------------------------

@pytest.mark.parametrize("change,code", [
    (dict(EmploymentType="Unemployed", Income=140_000.0), "INCOME_EMPLOYMENT_MISMATCH"),
    (dict(Age=20.0, MonthsEmployed=200.0), "TENURE_EXCEEDS_AGE"),
    (dict(Income=20_000.0, LoanAmount=240_000.0), "IMPLAUSIBLE_LOAN_TO_INCOME")])
def test_single_rules(spark, change, code):
    r = fraud.screen(frame(spark, change)).first()
    assert code in [x["code"] for x in r["rules"]]


def test_combined_fraud_and_clean(spark):
    bad = dict(Age=19.0, Income=130_000.0, EmploymentType="Unemployed", MonthsEmployed=180.0, CreditScore=820.0,
               NumCreditLines=4.0, LoanAmount=240_000.0, DTIRatio=0.9)
    empty = {c: None for c in v.BASE}
    rows = fraud.screen(frame(spark, bad, dict(LoanAmount=31_000.0), empty)).orderBy("application_id").collect()
    assert rows[0]["fraud_flag"] and rows[0]["fraud_tier"] == "high"
    assert not rows[1]["fraud_flag"] and rows[1]["fraud_reason"] is None
    assert 0.0 <= rows[2]["fraud_probability"] <= 1.0
    want = 1.0
    for r in rows[0]["rules"]:
        want *= 1.0 - r["weight"]
    assert rows[0]["fraud_probability"] == pytest.approx(round(1 - want, 4))


@pytest.mark.parametrize("ranges", ["1", "23"])
def test_resubmission_equals_one_window(spark, ranges):
    """One identity owns a third of the rows; the ranges it is dealt into must not change the result."""
    n = 600
    df = frame(spark, *[dict(Age=30.0 + (i % 3 != 0) * (i % 7), Income=1000.0 + 37.0 * (i * 7919 % 100), application_id=i) for i in range(n)])
    df = df.withColumn("ts", (F.lit("2024-01-01").cast("timestamp").cast("long") + F.col("application_id") * 7000).cast("timestamp"))
    settings = {"spark.sql.shuffle.partitions": ranges, "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, x in settings.items():
        spark.conf.set(k, x)
    try:
        got = fraud.screen_with_history(df).toPandas().sort_values("application_id")
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)
    pdf = df.toPandas().sort_values("application_id")
    pdf["occ"] = pdf.groupby("Age").cumcount() + 1
    pdf["prev"] = pdf.groupby("Age")["application_id"].shift()
    assert got["occurrence"].tolist() == pdf["occ"].tolist()
    assert got["previous_id"].fillna(-1).tolist() == pdf["prev"].fillna(-1).tolist()
    assert got["Income_change_pct"].notna().sum() == pdf["prev"].notna().sum()


def test_duplicate_groups(spark):
    df = frame(spark, dict(Age=50.0), dict(Age=50.0), dict(Age=50.0), dict(Age=51.0))
    r = fraud.duplicate_groups(df, fraud.fingerprint(), "application_id").collect()
    assert len(r) == 1 and r[0]["duplicate_groups"] == 1 and r[0]["duplicate_rows"] == 3 and r[0]["members"] == [1, 2, 3]


# ---- fairness ------------------------------------------------------------------------

def audited(spark, groups):
    rows = [(g, s) for g, n, s in groups for _ in range(n)]
    return spark.createDataFrame(rows, "MaritalStatus string, risk_score double")


def test_bias_alert(spark):
    r = fairness.fairness_report(audited(spark, [("Single", 200, 90.0), ("Married", 200, 10.0), ("Divorced", 200, 10.0)]),
                                 "risk_score", attributes=["MaritalStatus"]).first()
    assert r["bias_alert"] and r["disparate_impact_ratio"] < 0.8 and r["least_favoured"] == "Single"
    assert r["most_favoured"] == "Divorced"  # tie goes to the first label
    assert "approval rate for 'Single' is 0.0% vs 100.0%" in r["alert"]


def test_small_group_gives_no_alert(spark):
    r = fairness.fairness_report(audited(spark, [("Single", 200, 10.0), ("Married", 3, 90.0)]), "risk_score",
                                 attributes=["MaritalStatus"]).first()
    assert not r["bias_alert"] and r["disparate_impact_ratio"] is None and r["usable_groups"] == 1


def test_random_scores_give_no_alert(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(str(rng.choice(["a", "b", "c"])), float(rng.uniform(0, 100))) for _ in range(400)], "MaritalStatus string, risk_score double")
    assert not fairness.fairness_report(df, "risk_score", attributes=["MaritalStatus"]).first()["bias_alert"]


# ---- drift ---------------------------------------------------------------------------

def numbers(spark, xs):
    return spark.createDataFrame([(float(x),) for x in xs], "x double")


def psi(spark, a, b):
    return drift.psi_numeric(numbers(spark, a), numbers(spark, b), "x").first()


def test_psi(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(0, 1, 5000)
    assert psi(spark, base, base)["psi_raw"] < 0.01
    moved = psi(spark, base, rng.normal(2.5, 1, 5000))
    assert moved["psi_raw"] > 0.25 and moved["status"] == "alert"
    assert psi(spark, [1.0] * 50, rng.normal(2.5, 1, 50))["psi_raw"] == 0.0
    assert psi(spark, [1.0, 2.0, 3.0], base)["psi_raw"] == 0.0


def test_categorical_psi(spark):
    one = lambda a, b: spark.createDataFrame([("a",)] * a + [("b",)] * b, "c string")
    assert drift.psi_categorical(one(800, 200), one(200, 800), "c").first()["psi_raw"] > 0.25
    only_a = spark.createDataFrame([("a",)] * 100, "c string")
    assert drift.psi_categorical(one(100, 100), only_a, "c").first()["psi_raw"] > 1


def test_no_current_scores(spark):
    r = drift.prediction_drift(numbers(spark, range(100)), numbers(spark, [1.0]).limit(0), "x").first()
    assert r["status"] == "no_data" and not r["drift_detected"]


# ---- metrics -------------------------------------------------------------------------

def outcomes(spark, ys, ps):
    return spark.createDataFrame([(int(y), float(p)) for y, p in zip(ys, ps)], "y int, p double")


def test_perfect_ranking(spark):
    r = metrics.classification_metrics(outcomes(spark, [0, 0, 1, 1], [0, 0.1, 0.9, 1.0]), "y", "p").first()
    assert r["roc_auc"] == 1.0 and r["accuracy"] == 1.0 and r["average_precision"] == 1.0


def test_auc_against_pairs(spark):
    rng = np.random.default_rng(2)
    y, p = rng.integers(0, 2, 400), np.round(rng.uniform(0, 1, 400), 2)
    pos, neg = p[y == 1], p[y == 0]
    pairs = (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()
    assert metrics.rank_metrics(outcomes(spark, y, p), "y", "p").first()["roc_auc"] == pytest.approx(pairs)


def test_single_class_has_no_auc(spark):
    r = metrics.classification_metrics(outcomes(spark, [0, 0], [0.1, 0.6]), "y", "p").first()
    assert r["roc_auc"] is None and r["precision"] == 0.0 and r["balanced_accuracy"] == 0.5


def test_thresholds_are_ordered(spark):
    rng = np.random.default_rng(4)
    p = rng.uniform(0, 1, 2000)
    y = (rng.uniform(0, 1, 2000) < p * 0.3).astype(int)
    r = metrics.tune_thresholds(outcomes(spark, y, p), "y", "p").first()
    assert 0 < r["low"] < r["high"] < 1
    flat = metrics.tune_thresholds(outcomes(spark, [0] * 20, [0.5] * 20), "y", "p").first()
    assert flat["low"] < flat["high"]


def test_long_curve_is_thinned(spark):
    rng = np.random.default_rng(5)
    y, p = rng.integers(0, 2, 3000), rng.uniform(0, 1, 3000)
    rows = metrics.curve_points(outcomes(spark, y, p), "y", "p").toPandas()
    assert rows.groupby("curve").size().max() == 200
    roc = rows[rows.curve == "roc"].sort_values("i")
    assert roc.iloc[0][["x", "y"]].tolist() == [0, 0] and roc.iloc[-1][["x", "y"]].tolist() == [1, 1]


def test_agreement(spark):
    rows = [("approve", "approve")] * 7 + [("reject", "approve")] * 3 + [("review", "approve")]
    r = metrics.officer_agreement(spark.createDataFrame(rows, "ai_recommendation string, final_decision string")).first()
    assert r["agreement_rate"] == 0.7 and r["reject_to_approve"] == 3 and r["status"] == "review" and r["sample_size"] == 10


def test_trend(spark):
    h = spark.createDataFrame([("1", 0.75), ("2", 0.77), ("3", 0.70), ("4", None)], "period string, roc_auc double")
    r = metrics.performance_trend(h).first()
    assert r["period"] == "3" and r["baseline_auc"] == 0.76 and r["significant_drop"] and not r["below_minimum"]


# ---- explanation, scenarios, decisions, retraining --------------------------------------

def test_top_factors_hide_history(spark):
    c = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(x).alias("contribution")) for n, x in
                  [("BureauLoanCount", 9.0), ("CreditScore", -3.0), ("Income", 1.0), ("HasCoSigner", 0.0)]])
    fs = spark.range(1).select(c.alias("c")).select(explain.top_factors("c", k=2)).first()[0]
    assert [(f["raw_feature"], f["impact"], f["weight"]) for f in fs] == [("CreditScore", "positive", 0.75), ("Income", "negative", 0.25)]


def test_source_groups():
    g = explain.source_groups(["Age", "Education_PhD", "Education_High School", "EmploymentType_Part-time"])
    assert g == {"Age": [0], "Education": [1, 2], "EmploymentType": [3]}


def test_scenarios_keep_the_base(spark):
    rescore = lambda df: df.withColumn("risk_score", F.lit(100.0) - F.col("Income") / 1000.0).withColumn(
        "risk_level", scoring.risk_level("risk_score"))
    rows = {r["scenario"]: r for r in scenarios.scenario_table(frame(spark, {}), {
        "more": {"Income": F.col("Income") * 1.5}, "same": {}}, rescore).collect()}
    assert rows["more"]["score_change"] == -30.0 and rows["more"]["improved"]
    assert "lowers the risk score by 30 points" in rows["more"]["narrative"]
    assert rows["same"]["changed_fields"] == [] and "unchanged" in rows["same"]["narrative"]


def test_override_needs_a_reason(spark):
    req = spark.createDataFrame([(1, 1, "approve", None), (2, 1, "approve", "why"), (3, 1, "review", None), (4, 1, "approve", None)],
                                "application_id long, applicant_id long, decision string, override_reason string")
    scores = spark.createDataFrame([(1, 80.0), (2, 80.0), (3, 80.0)], "application_id long, risk_score double")
    r = {x["application_id"]: x for x in portfolio.manual_decide(req, scores).collect()}
    assert not r[1]["accepted"] and r[2]["accepted"] and r[2]["recorded_reason"] == "why"
    assert r[3]["final_decision"] is None and r[4]["ai_recommendation"] == "review" and r[4]["accepted"]


def test_rows_without_id_all_survive(spark):
    h = spark.createDataFrame([(1, 1, 5.0), (1, 2, 6.0)], "LoanID long, arrival long, x double").withColumn("Default", F.lit(0))
    o = spark.createDataFrame([(None, 3, 7.0), (None, 4, 8.0), (None, 5, 8.0)], "LoanID long, arrival long, x double").withColumn("Default", F.lit(1))
    out = retrain.retraining_dataset(h, o).orderBy("arrival").collect()
    assert [(r["LoanID"], r["x"]) for r in out] == [(1, 5.0), (None, 7.0), (None, 8.0)]


def test_promotion(spark):
    reg = spark.createDataFrame([("v1", 0.75), ("v2", 0.7515), ("v3", 0.76)], "version string, roc_auc double")
    decide = lambda a, b: retrain.compare_versions(reg, a, b).first()
    assert not decide("v2", "v1")["promoted"] and decide("v3", "v1")["promoted"] and decide("v1", None)["promoted"]
    assert "+0.0100" in decide("v3", "v1")["reason"]
