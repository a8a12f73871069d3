"""Derived credit features: one projection over the repaired base columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as v
from ..functions.expr import clip, lower_closed_rank, ratio, recode, upper_closed_band
from .quality import repair

_n = F.col


def _or(c: Column, fill: float) -> Column:
    return F.coalesce(c, F.lit(float(fill)))


def monthly_instalment(principal: Column, rate_percent: Column, months: Column) -> Column:
    """Annuity payment; straight line where the rate is zero or the power overflows."""
    p, term = _or(principal, 0), F.greatest(_or(months, 0), F.lit(1.0))
    rate = _or(rate_percent, 0) / F.lit(100.0) / F.lit(12.0)
    growth = F.pow(F.lit(1.0) + rate, term)
    annuity = F.try_divide(p * rate * growth, growth - F.lit(1.0))
    usable = (rate > F.lit(1e-9)) & (F.abs(annuity) < F.lit(float("inf")))
    return F.greatest(F.when(usable, annuity).otherwise(p / term), F.lit(0.0))


def derived(df: DataFrame) -> DataFrame:
    """Append the derived columns. Nothing here is learned from data.

    Two projections: the second reads the instalment and stability columns of the
    first, so each is computed once.
    """
    have = set(df.columns)
    absent = {c: F.lit(None).cast("double") for c in v.NUMERIC if c not in have}
    absent |= {c: F.lit(None).cast("string") for c in v.CATEGORICAL if c not in have}
    base = df.withColumns(absent) if absent else df

    weight = _or(recode("EmploymentType", v.EMPLOYMENT_WEIGHT), 0.5)
    tenure = F.lit(1.0) - F.exp(-_or(_n("MonthsEmployed"), 0) / F.lit(36.0))
    first = base.withColumns({
        "MonthlyInstalment": monthly_instalment(_n("LoanAmount"), _n("InterestRate"), _n("LoanTerm")),
        "EmploymentStabilityScore": clip(F.lit(0.6) * tenure + F.lit(0.4) * weight, 0, 1),
        "AgeGroup": upper_closed_band(_n("Age"), 0, v.AGE_BANDS),
    })

    to_income = clip(ratio("MonthlyInstalment", _n("Income") / F.lit(12.0)), 0, 20)
    lines, months, age = _n("NumCreditLines"), _n("MonthsEmployed"), _n("Age")
    thin = (F.lit(0.4) * clip(F.lit(1.0) - _or(lines, 0) / F.lit(4.0), 0, 1)
            + F.lit(0.35) * clip(F.lit(1.0) - _or(months, 0) / F.lit(120.0), 0, 1)
            + F.lit(0.25) * clip((F.lit(30.0) - _or(age, 45)) / F.lit(12.0), 0, 1))
    is_yes = lambda c: _or((_n(c) == "Yes").cast("double"), 0)
    secured = _or(_n("LoanPurpose").isin("Home", "Auto").cast("double"), 0)
    rank = _or(recode("Education", v.EDUCATION_RANK), 1) / F.lit(3.0)
    second = first.withColumns({
        "LoanToIncomeRatio": clip(ratio("LoanAmount", "Income"), 0, 50),
        "InstalmentToIncomeRatio": to_income,
        "TotalDebtServiceRatio": clip(_or(_n("DTIRatio"), 0) + to_income, 0, 20),
        "CreditUtilizationProxy": clip(ratio("DTIRatio", clip(lines, lo=1)), 0, 5),
        "CreditScoreBandOrdinal": lower_closed_rank(_n("CreditScore"), v.CREDIT_BAND_EDGES),
        "CreditLinesPerYearOfAge": clip(ratio(lines, clip(age - F.lit(18.0), lo=1)), 0, 5),
        "InterestBurden": _or(_n("LoanAmount") * _n("InterestRate") / F.lit(100.0), 0),
        "AgeRiskBand": recode("AgeGroup", v.AGE_RISK),
        "IncomeQuartileBand": upper_closed_band(_n("Income"), None, v.INCOME_BANDS, v.INCOME_TOP_BAND),
        "ThinFileScore": clip(thin, 0, 1),
        "AlternateDataScore": clip(F.lit(0.40) * is_yes("HasMortgage")
                                   + F.lit(0.35) * _n("EmploymentStabilityScore")
                                   + F.lit(0.25) * rank, 0, 1),
        "CollateralSupportScore": clip(F.lit(0.45) * is_yes("HasCoSigner") + F.lit(0.35) * secured
                                       + F.lit(0.20) * is_yes("HasMortgage"), 0, 1),
    })
    history = {c: (_n(c).cast("double") if c in have else F.lit(None).cast("double"))
               for c in v.HISTORY_NUMERIC}
    return second.withColumns(history)


def model_frame(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Repair, derive, and project to the fixed feature order."""
    return derived(repair(df)).select(*(keep or []), *v.ALL_FEATURES)
