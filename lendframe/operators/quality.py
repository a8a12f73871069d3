"""Validation report, repair, and the constraints of the operational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import vocabulary as v
from ..functions.expr import allowed, clean_double, clip, first_match, names_where, number


def as_number(df: DataFrame, name: str) -> Column:
    """Numeric reading of a column; only text columns pay for the tolerant parse."""
    kind = df.schema[name].dataType
    return number(name) if isinstance(kind, T.StringType) else clean_double(name)


def repair(df: DataFrame) -> DataFrame:
    """Coerce to the canonical schema without dropping a row: numbers are clipped to
    their bounds, unknown levels become NULL, absent columns are created."""
    have = set(df.columns)
    fixed = {}
    for name, (lo, hi) in v.NUMERIC_BOUNDS.items():
        fixed[name] = clip(as_number(df, name), lo, hi) if name in have else F.lit(None).cast("double")
    for name, levels in v.LEVELS.items():
        fixed[name] = allowed(name, levels) if name in have else F.lit(None).cast("string")
    others = [F.col(f"`{c}`") for c in df.columns if c not in fixed]
    return df.select(*others, *[c.alias(n) for n, c in fixed.items()])


def validation_report(df: DataFrame, require_target: bool = True,
                      require_all: bool = True) -> DataFrame:
    """Rows (column, check, n, detail, severity), one per finding.

    The per-column counts come from one aggregation over one scan, unknown levels from a
    second one. Column-presence findings need no scan; an empty table is reported as such.
    """
    have = set(df.columns)
    aggs: list[Column] = [F.count(F.lit(1)).alias("rows")]
    picks: list[tuple[str, str, Column, Column, Column]] = []
    none = F.lit(None).cast("string")
    for i, (name, (lo, hi)) in enumerate(v.NUMERIC_BOUNDS.items()):
        if name not in have:
            continue
        value = as_number(df, name)
        aggs += [F.count_if(F.col(name).isNotNull() & value.isNull()).alias(f"c{i}"),
                 F.count_if(value.isNull()).alias(f"m{i}"),
                 F.count_if((value < lo) | (value > hi)).alias(f"r{i}")]
        picks += [(name, "non_numeric", F.col(f"c{i}"), none, F.lit("error")),
                  (name, "missing", F.col(f"m{i}"), none, F.lit("info")),
                  (name, "out_of_range", F.col(f"r{i}"), none, F.lit("warning"))]
    for i, name in enumerate(v.LEVELS):
        if name in have:
            aggs.append(F.count_if(F.col(name).isNull()).alias(f"x{i}"))
            picks.append((name, "missing", F.col(f"x{i}"), none, F.lit("info")))
    if require_target and v.TARGET in have:
        y = F.col(v.TARGET)
        aggs += [F.count_if(~y.isin(0, 1)).alias("bad_target"), F.avg(y.cast("double")).alias("rate")]
        rate = F.col("rate")
        single = (rate == 0) | (rate == 1)
        picks += [
            (v.TARGET, "not_binary", F.col("bad_target"), none, F.lit("error")),
            (v.TARGET, "single_class", single.cast("long"), rate.cast("string"), F.lit("error")),
            (v.TARGET, "imbalance", (~single & (rate < 0.01)).cast("long"), rate.cast("string"),
             F.lit("warning"))]
    picks.append(("*", "empty_table", (F.col("rows") == 0).cast("long"), none, F.lit("error")))
    absent = [c for c in v.BASE if c not in have]
    level = "error" if require_all else "warning"
    picks += [(c, "missing_column", F.lit(1).cast("long"), none, F.lit(level)) for c in absent]
    if require_target and v.TARGET not in have:
        picks.append((v.TARGET, "missing_column", F.lit(1).cast("long"), none, F.lit("error")))

    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(k).alias("check"),
                              F.coalesce(n, F.lit(0)).cast("long").alias("n"), d.alias("detail"),
                              s.alias("severity")) for c, k, n, d, s in picks])
    counted = df.agg(*aggs).select(F.inline(rows)).filter(F.col("n") > 0)
    return counted.unionByName(unknown_levels(df))


def unknown_levels(df: DataFrame) -> DataFrame:
    """One finding per unknown level of a categorical column, with its number of rows.

    Only unknown values leave the map side, and they are counted, not gathered: a column
    of free text yields many rows, never one large cell."""
    cells = []
    for name, levels in v.LEVELS.items():
        if name in df.columns:
            text = F.col(name).cast("string")
            cells.append(F.when(~text.isin(*levels), F.struct(F.lit(name).alias("column"), text.alias("detail"))))
    found = F.array_compact(F.array(*cells)) if cells else F.array().cast("array<struct<column:string,detail:string>>")
    return (df.select(F.inline(found)).groupBy("column", "detail").agg(F.count(F.lit(1)).alias("n"))
            .select("column", F.lit("unknown_level").alias("check"), "n", "detail", F.lit("warning").alias("severity")))


def require_valid(report: DataFrame) -> None:
    """Strict mode: raise when the report holds an error (the report is a few rows)."""
    errors = report.filter(F.col("severity") == "error").collect()
    if errors:
        raise ValueError("; ".join(f"{r['column']}: {r['check']} ({r['n']})" for r in errors))


# ---- constraints of the operational tables -------------------------------------

class Rule:
    """A named condition that must hold; NULL passes unless the rule says otherwise."""

    def __init__(self, path: str, kind: str, ok: Column):
        self.name, self.ok = f"{path}:{kind}", ok


def required(path: str) -> Rule:
    return Rule(path, "required", F.col(path).isNotNull())


def within(path: str, lo: float | None = None, hi: float | None = None) -> Rule:
    c, ok = F.col(path), F.lit(True)
    if lo is not None:
        ok = ok & (c >= lo)
    if hi is not None:
        ok = ok & (c <= hi)
    return Rule(path, "range", c.isNull() | ok)


def one_of(path: str, *values: str) -> Rule:
    return Rule(path, "enum", F.col(path).isNull() | F.col(path).isin(*values))


def length(path: str, hi: int, lo: int = 0) -> Rule:
    n = F.length(path)
    return Rule(path, "length", F.col(path).isNull() | ((n <= hi) & (n >= lo)))


def matching(path: str, pattern: str) -> Rule:
    return Rule(path, "pattern", F.col(path).isNull() | F.col(path).rlike(pattern))


def constraint_check(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``violations``, the names of the broken rules."""
    return df.withColumn("violations", names_where({r.name: ~r.ok for r in rules}))


def violation_counts(checked: DataFrame) -> DataFrame:
    return (checked.select(F.explode("violations").alias("rule"))
            .groupBy("rule").agg(F.count(F.lit(1)).alias("n")))


def application_rules() -> list[Rule]:
    return [
        required("applicantId"),
        within("personalInfo.age", 18, 100),
        one_of("personalInfo.maritalStatus", "single", "married", "divorced", "widowed"),
        one_of("personalInfo.employmentType", "full_time", "part_time", "self_employed",
               "contract", "retired", "unemployed"),
        within("personalInfo.dependents", 0),
        one_of("personalInfo.education", "high_school", "bachelors", "masters", "doctorate", "other"),
        required("financialInfo.income"), within("financialInfo.income", 0),
        within("financialInfo.existingDebts", 0),
        required("financialInfo.loanAmountRequested"), within("financialInfo.loanAmountRequested", 100),
        required("financialInfo.tenure"), within("financialInfo.tenure", 1, 360),
        within("financialInfo.creditScore", 300, 850),
        one_of("financialInfo.purpose", "home_purchase", "auto_loan", "education", "personal",
               "business", "debt_consolidation", "medical", "other"),
        one_of("status", "submitted", "under_review", "approved", "rejected"),
        length("notes", 1000),
    ]


def risk_score_rules() -> list[Rule]:
    return [required("applicationId"), required("riskScore"), within("riskScore", 0, 100),
            required("riskLevel"), one_of("riskLevel", *v.RISK_LEVELS),
            within("confidenceScore", 0, 1)]


def decision_rules() -> list[Rule]:
    """``finalDecision`` may be NULL: a manual "review" is a decision without outcome."""
    return [required("applicationId"), required("decidedBy"),
            one_of("aiRecommendation", "approve", "reject", "review"),
            one_of("finalDecision", "approve", "reject"), length("overrideReason", 500)]


def audit_rules() -> list[Rule]:
    return [required("actorType"), one_of("actorType", "AI", "Officer", "Admin", "System"),
            required("action"), length("action", 200), length("details", 1000)]


def metric_rules() -> list[Rule]:
    return [required("date"), within("accuracy", 0, 1), within("aucRoc", 0, 1),
            within("driftScore", 0), within("agreementRate", 0, 1)]


def notification_rules() -> list[Rule]:
    return [required("userId"), required("title"), length("title", 200), required("message"),
            length("message", 1000), one_of("type", "status_update", "system")]


def user_rules() -> list[Rule]:
    return [required("name"), length("name", 100), required("email"),
            matching("email", r"^\S+@\S+\.\S+$"), required("password"), length("password", 10_000, 6),
            one_of("role", "applicant", "officer", "admin"), one_of("status", "active", "suspended")]


def class_balance(df: DataFrame, target: str = v.TARGET) -> DataFrame:
    """Positive rate and negative-to-positive ratio (1 without positives)."""
    pos, n = F.count_if(F.col(target) == 1), F.count(target)
    return df.agg(n.alias("n"), pos.alias("positives"), F.avg(F.col(target).cast("double")).alias("rate"),
                  first_match([(pos > 0, (n - pos) / pos)], 1.0).alias("pos_weight"))
