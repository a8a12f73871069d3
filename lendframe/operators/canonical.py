"""Raw source tables -> one row per applicant.

Each satellite table is aggregated on the person key before it is joined, so a join
only ever meets one row per person. The five joins share one key: with a table
bucketed by it, or after the first shuffle, no further exchange of the left side is
needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as v
from ..functions.expr import clip, half_even, holds, recode, share, total

PERSON, LOAN, PREVIOUS = "SK_ID_CURR", "SK_ID_BUREAU", "SK_ID_PREV"


def loan_delinquency(balance: DataFrame, loan: str = LOAN, status: str = "STATUS",
                     delinquent: list[str] | None = None) -> DataFrame:
    """Share of months with a delinquent status, per bureau loan."""
    bad = F.col(status).isin(*(delinquent or v.DELINQUENT_STATUSES))
    return (balance.filter(F.col(loan).isNotNull())
            .groupBy(loan).agg(share(bad).alias("BureauBalanceDelinquencyRate")))


def bureau_history(bureau: DataFrame, balance: DataFrame | None = None) -> DataFrame:
    """Credit-bureau history per person.

    The delinquency rate is a mean of per-loan rates, each loan counting once however
    many months it has.
    """
    if balance is None:
        loans = bureau.withColumn("BureauBalanceDelinquencyRate", F.lit(None).cast("double"))
    else:
        loans = bureau.join(loan_delinquency(balance), LOAN, "left")
    grouped = loans.filter(F.col(PERSON).isNotNull()).groupBy(PERSON).agg(
        F.count(LOAN).alias("BureauLoanCount"),
        F.count_if(F.col("CREDIT_ACTIVE") == "Active").alias("BureauActiveLoanCount"),
        F.count_if(F.col("CREDIT_DAY_OVERDUE") > 0).alias("BureauOverdueLoanCount"),
        total("AMT_CREDIT_SUM").alias("_credit"),
        total("AMT_CREDIT_SUM_DEBT").alias("_debt"),
        F.avg("DAYS_CREDIT").alias("_days"),
        F.avg("BureauBalanceDelinquencyRate").alias("BureauBalanceDelinquencyRate"))
    return grouped.select(
        PERSON, F.lit(1.0).alias("HasBureauHistory"),
        "BureauLoanCount", "BureauActiveLoanCount", "BureauOverdueLoanCount",
        clip(F.col("_debt") / clip("_credit", lo=1.0), 0.0, 5.0).alias("BureauDebtToCreditRatio"),
        clip(-F.col("_days"), lo=0.0).alias("BureauAvgDaysSinceCredit"),
        "BureauBalanceDelinquencyRate")


def prior_applications(previous: DataFrame, approved: str = "Approved",
                       refused: str = "Refused") -> DataFrame:
    """Earlier applications per person: how many, and the share approved and refused."""
    status = F.col("NAME_CONTRACT_STATUS")
    at_least_one = F.greatest(F.count(PREVIOUS), F.lit(1)).cast("double")
    return previous.filter(F.col(PERSON).isNotNull()).groupBy(PERSON).agg(
        F.lit(1.0).alias("HasPriorApplications"),
        F.count(PREVIOUS).alias("PriorApplicationCount"),
        (F.count_if(status == approved) / at_least_one).alias("PriorApprovalRate"),
        (F.count_if(status == refused) / at_least_one).alias("PriorRefusalRate"))


def instalment_history(payments: DataFrame) -> DataFrame:
    """Repayment behaviour per person. A missing payment day is not late, but counts
    in the denominator of the late rate."""
    late = clip(F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT"), lo=0.0)
    paid = clip(F.col("AMT_PAYMENT") / clip("AMT_INSTALMENT", lo=1.0), 0.0, 3.0)
    return payments.filter(F.col(PERSON).isNotNull()).groupBy(PERSON).agg(
        F.count("AMT_INSTALMENT").alias("InstallmentCount"),
        share(late > 0).alias("InstallmentLatePaymentRate"),
        F.avg(late).alias("InstallmentAvgDaysLate"),
        F.avg(paid).alias("InstallmentAvgPaymentRatio"))


def pos_history(pos: DataFrame) -> DataFrame:
    return pos.filter(F.col(PERSON).isNotNull()).groupBy(PERSON).agg(
        F.avg("SK_DPD").alias("PosAvgDaysPastDue"), F.max("SK_DPD").alias("PosMaxDaysPastDue"))


def card_history(cards: DataFrame) -> DataFrame:
    used = clip(F.col("AMT_BALANCE") / clip("AMT_CREDIT_LIMIT_ACTUAL", lo=1.0), 0.0, 3.0)
    return cards.filter(F.col(PERSON).isNotNull()).groupBy(PERSON).agg(
        F.avg(used).alias("CreditCardUtilizationRatio"),
        F.max("SK_DPD").alias("CreditCardMaxDaysPastDue"))


def credit_score(*sources: Column) -> Column:
    """Mean of the available 0-1 scores on the 300-850 scale; NULL when none is there."""
    present = F.array_compact(F.array(*sources))
    mean = F.try_divide(F.aggregate(present, F.lit(0.0), lambda a, x: a + x),
                        F.size(present).cast("double"))
    return half_even(F.lit(300.0) + clip(mean, 0.0, 1.0) * F.lit(550.0), 0)


def application_fields(app: DataFrame) -> DataFrame:
    """Main application table -> canonical columns."""
    employed = F.nullif(F.col("DAYS_EMPLOYED").cast("double"), F.lit(float(v.NOT_EMPLOYED_DAYS)))
    alone = F.col("NAME_TYPE_SUITE").isNull() | (F.col("NAME_TYPE_SUITE") == "Unaccompanied")
    flag = lambda cond: F.when(holds(cond), "Yes").otherwise("No")
    annuity, income, credit = (F.col(c).cast("double") for c in
                               ("AMT_ANNUITY", "AMT_INCOME_TOTAL", "AMT_CREDIT"))
    return app.select(
        F.col(PERSON),
        F.col("TARGET").cast("int").alias(v.TARGET),
        half_even(-F.col("DAYS_BIRTH") / F.lit(365.25), 1).alias("Age"),
        clip(-employed / F.lit(30.44), lo=0.0).alias("MonthsEmployed"),
        income.alias("Income"),
        credit.alias("LoanAmount"),
        credit_score(*[F.col(f"EXT_SOURCE_{i}").cast("double") for i in (1, 2, 3)]).alias("CreditScore"),
        F.lit(0.0).alias("InterestRate"),
        clip(half_even(F.try_divide(credit, annuity), 0), 1.0, 480.0).alias("LoanTerm"),
        clip(F.try_divide(annuity, income), 0.0, 1.5).alias("DTIRatio"),
        recode("NAME_EDUCATION_TYPE", v.SOURCE_EDUCATION).alias("Education"),
        recode("NAME_INCOME_TYPE", v.SOURCE_EMPLOYMENT).alias("EmploymentType"),
        recode("NAME_FAMILY_STATUS", v.SOURCE_MARITAL).alias("MaritalStatus"),
        flag(F.col("FLAG_OWN_REALTY") == "Y").alias("HasMortgage"),
        flag(F.col("CNT_CHILDREN") > 0).alias("HasDependents"),
        flag(~alone).alias("HasCoSigner"),
        F.lit("Other").alias("LoanPurpose"))


def join_history(applicants: DataFrame, satellites: list[DataFrame], key: str = PERSON) -> DataFrame:
    """Left-join one-row-per-person tables and fill what "no history" means: both flags
    become 0, and the number of credit lines falls back to the bureau's loan count."""
    out = applicants
    for satellite in satellites:
        out = out.join(satellite, key, "left")
    have = set(out.columns)
    filled = {flag: F.coalesce(F.col(flag), F.lit(0.0))
              for flag in ("HasBureauHistory", "HasPriorApplications") if flag in have}
    if "BureauLoanCount" in have:
        lines = F.col("BureauLoanCount").cast("double")
        filled["NumCreditLines"] = F.coalesce(F.col("NumCreditLines"), lines) \
            if "NumCreditLines" in have else lines
    return out.withColumns(filled)


# part of the canonical table -> its source tables and what is made of them, one row per person
PARTS = {
    "application": (("application",), application_fields),
    "bureau": (("bureau", "bureau_balance"), bureau_history),
    "previous": (("previous_application",), prior_applications),
    "instalments": (("installments_payments",), instalment_history),
    "pos": (("POS_CASH_balance",), pos_history),
    "card": (("credit_card_balance",), card_history),
}


def assembled(parts: dict[str, DataFrame]) -> DataFrame:
    """The canonical table from its parts."""
    joined = join_history(parts["application"], [parts[p] for p in PARTS if p != "application"])
    return joined.withColumnRenamed(PERSON, v.ID).select(v.ID, *v.BASE, *v.HISTORY_NUMERIC, v.TARGET)


def canonical_table(tables: dict[str, DataFrame]) -> DataFrame:
    """Seven source tables -> the canonical training table with its history columns."""
    return assembled({part: build(*[tables[t] for t in needed]) for part, (needed, build) in PARTS.items()})
