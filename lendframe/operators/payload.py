"""Incoming application payloads -> canonical columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import vocabulary as v
from ..functions.expr import clean_double, clip, first_match, names_where, number, recode, yes_no

# canonical name -> path in the nested document
NESTED = {
    "Age": "personalInfo.age",
    "Education": "personalInfo.education",
    "EmploymentType": "personalInfo.employmentType",
    "MaritalStatus": "personalInfo.maritalStatus",
    "Income": "financialInfo.income",
    "LoanAmount": "financialInfo.loanAmountRequested",
    "CreditScore": "financialInfo.creditScore",
    "LoanTerm": "financialInfo.tenure",
    "LoanPurpose": "financialInfo.purpose",
}

PAYLOAD_SCHEMA = T.StructType([
    T.StructField("applicationId", T.StringType()),
    T.StructField("personalInfo", T.StructType([
        T.StructField("age", T.DoubleType()),
        T.StructField("maritalStatus", T.StringType()),
        T.StructField("employmentType", T.StringType()),
        T.StructField("dependents", T.IntegerType()),
        T.StructField("education", T.StringType())])),
    T.StructField("financialInfo", T.StructType([
        T.StructField("income", T.DoubleType()),
        T.StructField("existingDebts", T.DoubleType()),
        T.StructField("loanAmountRequested", T.DoubleType()),
        T.StructField("tenure", T.IntegerType()),
        T.StructField("creditScore", T.DoubleType()),
        T.StructField("purpose", T.StringType())])),
])


def level_of(name: str, c: Column) -> Column:
    """Canonical spelling as it is, otherwise the payload code in any case."""
    text = F.trim(c.cast("string"))
    return F.when(text.isin(*v.LEVELS[name]), text).otherwise(
        recode(F.lower(text), v.PAYLOAD_LEVELS[name]))


def derive_dti(debts: Column, income: Column, explicit: Column) -> Column:
    """An explicit ratio wins; otherwise debts over income, unknown from zero of either."""
    derived = F.when((debts != 0) & (income > 0), F.try_divide(debts, income))
    return clip(F.coalesce(explicit, derived), 0.0, 1.5)


def _paths(schema: T.StructType) -> dict[str, T.DataType]:
    out = {}
    for f in schema.fields:
        out[f.name] = f.dataType
        if isinstance(f.dataType, T.StructType):
            out |= {f"{f.name}.{g.name}": g.dataType for g in f.dataType.fields}
    return out


def normalise(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Nested, flat-alias and canonical spellings merged into the canonical columns.

    For each field the canonical column wins, then the last listed alias, then the
    nested document; a NULL never overrides a value. ``keep`` are columns passed on.
    Only fields with a text spelling pay for the tolerant number parse.
    """
    there = _paths(df.schema)

    def read(path: str) -> Column:
        if path not in there:
            return F.lit(None).cast("double")
        return clean_double(path) if isinstance(there[path], T.NumericType) else number(path)

    def nested(name: str) -> Column | None:
        if name == "HasDependents" and "personalInfo.dependents" in there:
            given = F.col("personalInfo.dependents").isNotNull()
            some = F.coalesce(read("personalInfo.dependents"), F.lit(0.0)) != 0
            return F.when(given, F.when(some, "Yes").otherwise("No"))
        if name == "DTIRatio":
            return derive_dti(*[read(f"financialInfo.{c}") for c in ("existingDebts", "income", "dtiRatio")])
        path = NESTED.get(name)
        if path not in there:
            return None
        return read(path) if name in v.NUMERIC_BOUNDS else F.col(path).cast("string")

    def merged(name: str) -> Column:
        spellings = [s for s in (name, *reversed(v.PAYLOAD_ALIASES[name])) if s in there]
        numeric = name in v.NUMERIC_BOUNDS and all(isinstance(there[s], T.NumericType) for s in spellings)
        kind = "double" if numeric else "string"
        candidates = [F.col(s).cast(kind) for s in spellings]
        deep = nested(name)
        if deep is not None:
            candidates.append(deep.cast(kind))
        one = F.coalesce(*candidates) if candidates else F.lit(None).cast(kind)
        if name in v.NUMERIC_BOUNDS:
            return clean_double(one) if numeric else number(one)
        return yes_no(one) if name.startswith("Has") else level_of(name, one)

    typed = df.select(*(keep or []), *[merged(n).alias(n) for n in v.BASE])
    no_tenure = (F.col("EmploymentType") == "Unemployed") & F.col("MonthsEmployed").isNull()
    return typed.withColumn("MonthsEmployed", first_match([(no_tenure, 0.0)], F.col("MonthsEmployed")))


def imputed_fields() -> Column:
    """Names of the canonical fields a normalised row leaves to imputation."""
    return names_where({n: F.col(n).isNull() for n in v.BASE})


# Strict limits at intake: path -> (lower, upper)
INTAKE_LIMITS: dict[str, tuple[float, float | None]] = {
    "personalInfo.age": (18, 100),
    "personalInfo.dependents": (0, 20),
    "financialInfo.income": (0, 10_000_000),
    "financialInfo.existingDebts": (0, None),
    "financialInfo.loanAmountRequested": (0, 10_000_000),
    "financialInfo.tenure": (1, 480),
    "financialInfo.creditScore": (300, 850),
    "Age": (18, 100),
    "Income": (0, 10_000_000),
    "LoanAmount": (0, 10_000_000),
    "CreditScore": (300, 850),
    "MonthsEmployed": (0, 720),
    "NumCreditLines": (0, 50),
    "InterestRate": (0, 60),
    "LoanTerm": (1, 480),
    "DTIRatio": (0, 1.5),
}


def intake_check(df: DataFrame, ignore: tuple[str, ...] = ("applicationId",)) -> DataFrame:
    """Adds ``violations``: names of the fields outside their limits, and ``no_signal``
    for a row that carries nothing to score."""
    there = _paths(df.schema)
    rules = {}
    for path, (lo, hi) in INTAKE_LIMITS.items():
        if path in there:
            c = F.col(path).cast("double")
            rules[path] = (c < lo) if hi is None else (c < lo) | (c > hi)
    leaves = []
    for f in df.schema.fields:
        if f.name in ignore:
            continue
        if isinstance(f.dataType, T.StructType):
            leaves += [F.col(f"{f.name}.{g.name}") for g in f.dataType.fields]
        else:
            leaves.append(F.col(f.name))
    if leaves:
        rules["no_signal"] = F.coalesce(*[F.when(c.isNotNull(), F.lit(False)) for c in leaves],
                                        F.lit(True))
    return df.withColumn("violations", names_where(rules))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("violations") == 0).drop("violations")


def quarantined(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("violations") > 0)
