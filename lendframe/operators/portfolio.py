"""Operational queries of a lender: KPIs, queues, case files, audit pages, decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.expr import first_match, fixed, percent, ratio

# Lookup columns a reader may see; secrets such as password or refreshToken never are.
USER_PUBLIC = ["user_id", "name", "email", "phone", "role", "status"]


def public_users(users: DataFrame) -> DataFrame:
    """Projection by allow-list: a new sensitive column stays hidden by default."""
    return users.select(*[c for c in USER_PUBLIC if c in users.columns])


def portfolio_kpis(applications: DataFrame, scores: DataFrame, status: str = "status",
                   score: str = "risk_score") -> DataFrame:
    """Totals, approval and rejection rate and the rounded mean score; 0 when empty."""
    counts = applications.agg(
        F.count(F.lit(1)).alias("total_applications"),
        F.count_if(F.col(status) == "approved").cast("double").alias("_a"),
        F.count_if(F.col(status) == "rejected").cast("double").alias("_r"))
    n = F.col("total_applications").cast("double")
    mean = scores.agg(F.avg(score)).scalar()
    return counts.select("total_applications", ratio("_a", n).alias("approval_rate"),
                         ratio("_r", n).alias("rejection_rate"),
                         # half-up, unlike the half-even rounding of the model reports
                         F.coalesce(F.floor(mean + F.lit(0.5)), F.lit(0)).cast("long").alias("avg_risk_score"))


def officer_dashboard(applications: DataFrame, decisions: DataFrame, officer: str,
                      now: Column) -> DataFrame:
    """Pending reviews, today's outcomes and one officer's total. ``now`` is an argument."""
    today = F.col("decided_at") >= F.date_trunc("day", now)
    pending = applications.agg(F.count_if(F.col("status") == "under_review")).scalar()
    return decisions.agg(
        F.count_if(today & (F.col("final_decision") == "approve")).alias("approved_today"),
        F.count_if(today & (F.col("final_decision") == "reject")).alias("rejected_today"),
        F.count_if(F.col("decided_by") == officer).alias("decisions_by_officer"),
    ).select(pending.alias("pending_reviews"), "*")


def client_dashboard(applications: DataFrame, amount: str = "LoanAmount", score: str = "risk_score",
                     status: str = "status") -> DataFrame:
    s = F.col(status)
    return applications.agg(
        F.coalesce(F.sum(amount), F.lit(0.0)).alias("loan_volume"),
        F.count_if(s.isin("submitted", "under_review")).alias("pending"),
        F.count_if(s == "approved").alias("approved"), F.avg(score).alias("mean_score"))


def unread_notifications(notifications: DataFrame) -> DataFrame:
    return notifications.filter(~F.col("read")).groupBy("user_id").agg(F.count(F.lit(1)).alias("unread"))


def action_list(audit: DataFrame) -> DataFrame:
    return audit.select("action").distinct()


def monthly_trend(applications: DataFrame, ts: str = "ts", status: str = "status",
                  score: str = "risk_score") -> DataFrame:
    return (applications.groupBy(F.date_format(ts, "yyyy-MM").alias("month"))
            .agg(F.count(F.lit(1)).alias("applications"),
                 F.count_if(F.col(status) == "approved").alias("approved"),
                 F.avg(score).alias("avg_score")))


def breakdown(applications: DataFrame, by: str = "LoanPurpose") -> DataFrame:
    """Counts per level, largest first."""
    return (applications.groupBy(by).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), by))


# ---- filters and search ---------------------------------------------------------

def where_equal(df: DataFrame, **wanted) -> DataFrame:
    """Equality or membership filters; an argument of None is no filter."""
    for name, value in wanted.items():
        if value is not None:
            c = F.col(name)
            df = df.filter(c.isin(*value) if isinstance(value, (list, tuple, set)) else c == F.lit(value))
    return df


def search(df: DataFrame, text: str, columns: Sequence[str]) -> DataFrame:
    """Case-insensitive substring in any of the columns."""
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(text.lower())), F.lit(False))
    return df.filter(cond) if text else df


def matches(c: str | Column, pattern: str) -> Column:
    """Case-insensitive regular expression."""
    c = F.col(c) if isinstance(c, str) else c
    return c.rlike("(?i)" + pattern)


def page_after(df: DataFrame, keys: Sequence[str], last: Sequence[object] | None = None, size: int = 20,
               newest_first: bool = True) -> DataFrame:
    """The page behind the row whose ``keys`` are ``last`` (the first page without): a task
    keeps ``size`` rows however deep the page is. The keys must not be NULL and end in a unique one."""
    order = [F.desc(k) if newest_first else F.asc(k) for k in keys]
    if last is not None:
        at, mark = F.struct(*keys), F.struct(*[F.lit(x).alias(k) for k, x in zip(keys, last, strict=True)])
        df = df.filter(at < mark if newest_first else at > mark)
    return df.orderBy(*order).limit(size)


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 20) -> DataFrame:
    """One page in a total order, each row carrying the number of all matching rows.

    Offset paging keeps ``number * size`` rows per task; deep pages go by ``page_after``."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.orderBy(*order).offset((number - 1) * size).limit(size).withColumn("total", total)


def newest(df: DataFrame, ts: str, tie: str, n: int = 50, oldest_first: bool = False) -> DataFrame:
    order = [F.asc(ts), F.asc(tie)] if oldest_first else [F.desc(ts), F.desc(tie)]
    return df.orderBy(*order).limit(n)


def newest_per(df: DataFrame, key: str, ts: str, tie: str, n: int = 50) -> DataFrame:
    """The n newest rows per key; Spark limits each task's groups before the shuffle."""
    w = W.partitionBy(key).orderBy(F.desc(ts), F.desc(tie))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def latest_per(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Latest row per key as a max over structs: partial aggregation, no sort."""
    rest = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct(F.col(ts), F.col(tie)))
    return df.groupBy(key).agg(best.alias("_row")).select(key, "_row.*")


# ---- review queue and case files -----------------------------------------------

def review_queue(applications: DataFrame, users: DataFrame, scores: DataFrame | None = None,
                 level: str | None = None, fraud: bool | None = None) -> DataFrame:
    """Applications under review with their applicant, optionally restricted to a risk
    level or fraud flag by a semi-join. The users side is left to AQE: it is broadcast
    only when its measured size allows."""
    queue = applications.filter(F.col("status") == "under_review")
    if level is not None or fraud is not None:
        chosen = where_equal(scores, risk_level=level, fraud_flag=fraud).select("application_id")
        queue = queue.join(chosen, "application_id", "left_semi")
    who = users.select(F.col("user_id").alias("applicant_id"), "name", "email")
    return queue.join(who, "applicant_id", "left")


def case_decisions(applications: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decision history as rows, one per decision of the given applications. Rows, not an
    array per application: no task has to hold one application's whole history."""
    return decisions.join(applications.select("application_id"), "application_id", "left_semi")


def case_file(applications: DataFrame, scores: DataFrame, decisions: DataFrame,
              users: DataFrame | None = None) -> DataFrame:
    """Each application with its latest score, the number of its decisions and the last
    one. Both satellites are reduced by partial aggregation before they are joined."""
    latest = latest_per(scores.select("application_id", "scored_at", "risk_score", "risk_level"),
                        "application_id", "scored_at", "risk_score")
    history = decisions.groupBy("application_id").agg(
        F.count(F.lit(1)).alias("n_decisions"),
        F.max(F.struct("decided_at", "final_decision", "decided_by")).alias("_last")).select(
        "application_id", "n_decisions", F.col("_last.decided_at").alias("last_decided_at"),
        F.col("_last.final_decision").alias("last_decision"), F.col("_last.decided_by").alias("last_officer"))
    out = applications.join(latest, "application_id", "left").join(history, "application_id", "left")
    if users is not None:
        out = out.join(users.select(F.col("user_id").alias("applicant_id"), "name"), "applicant_id", "left")
    return out.withColumn("n_decisions", F.coalesce("n_decisions", F.lit(0)))


def decision_history(decisions: DataFrame, applications: DataFrame, users: DataFrame,
                     officer: str | None = None, n: int = 50) -> DataFrame:
    """The newest decisions with application and applicant. The limit comes before the
    joins, so only ``n`` rows are looked up."""
    mine = decisions if officer is None else decisions.filter(F.col("decided_by") == officer)
    top = newest(mine, "decided_at", "application_id", n)
    return (top.join(applications.select("application_id", "applicant_id", "LoanAmount"), "application_id", "left")
            .join(users.select(F.col("user_id").alias("applicant_id"), "name"), "applicant_id", "left"))


# ---- decisions and what follows from them --------------------------------------

def auto_decide(scored: DataFrame) -> DataFrame:
    """Automatic decision columns for rows with ``risk_score`` and ``fraud_flag``."""
    rec = scoring.recommendation("risk_score", "fraud_flag")
    return scored.withColumn("ai_recommendation", rec).withColumns({
        "status": scoring.status_after(F.col("ai_recommendation")),
        "final_decision": F.nullif(F.col("ai_recommendation"), F.lit("review"))})


def manual_decide(requests: DataFrame, latest_scores: DataFrame, split_at: float = 50.0) -> DataFrame:
    """Officer decisions checked against the score. ``accepted`` is false where an
    override lacks its reason or the decision is not a known word. A manual "review"
    has no final decision."""
    joined = requests.join(latest_scores.select("application_id", "risk_score"), "application_id", "left")
    score, decision = F.col("risk_score"), F.col("decision")
    rec = F.when(score > split_at, "reject").when(score.isNotNull(), "approve")
    override = F.coalesce((decision != rec) & (decision != "review"), F.lit(False))
    reasoned = F.length(F.coalesce("override_reason", F.lit(""))) > 0
    known = F.coalesce(decision.isin("approve", "reject", "review"), F.lit(False))
    return joined.select(
        *requests.columns, "risk_score", F.coalesce(rec, F.lit("review")).alias("ai_recommendation"),
        override.alias("is_override"), (known & (~override | reasoned)).alias("accepted"),
        F.nullif(decision, F.lit("review")).alias("final_decision"),
        F.when(override, F.col("override_reason")).alias("recorded_reason"),
        scoring.status_after(decision).alias("status"))


def auto_audit(decided: DataFrame) -> DataFrame:
    """Audit rows of automatic decisions."""
    d = F.col("final_decision")
    return decided.filter(d.isNotNull()).select(
        F.lit("AI").alias("actor_type"), F.lit("AI").alias("actor_id"), "application_id",
        F.concat(F.lit("Auto-"), d, F.lit(" application")).alias("action"),
        F.col("risk_score").alias("ai_score"), F.lit(None).cast("string").alias("override_reason"),
        F.concat(F.lit("Application auto-"), d, F.lit(" based on score "),
                 F.col("risk_score").cast("string"), F.lit(". Fraud flag: "),
                 F.col("fraud_flag").cast("string")).alias("details"))


def officer_audit(decided: DataFrame, officer: str = "officer_id") -> DataFrame:
    """Audit rows of accepted manual decisions."""
    return decided.filter("accepted").select(
        F.lit("Officer").alias("actor_type"), F.col(officer).cast("string").alias("actor_id"), "application_id",
        F.concat(F.lit("Officer "), F.col("decision"), F.lit(" application")).alias("action"),
        F.col("risk_score").alias("ai_score"), F.col("recorded_reason").alias("override_reason"),
        F.concat(F.lit("Officer manually set status to "), F.col("decision")).alias("details"))


def notifications(decided: DataFrame, manual: bool = False) -> DataFrame:
    """One status notification per decided application."""
    d = F.col("final_decision")
    message = F.concat(F.lit("Your loan application has been manually reviewed and "), d, F.lit("ed.")) \
        if manual else F.concat(F.lit("Your loan application has been "), d, F.lit("."))
    rows = decided.filter(d.isNotNull())
    return (rows.filter("accepted") if manual else rows).select(
        F.col("applicant_id").alias("user_id"), F.concat(F.lit("Application "), F.initcap(d)).alias("title"),
        message.alias("message"), F.lit("status_update").alias("type"), F.lit(False).alias("read"))


# ---- reports and questions -----------------------------------------------------

def financial_flags() -> dict[str, Column]:
    return {"dti_ok": F.col("DTIRatio") <= F.lit(0.36), "lti_ok": F.col("LoanToIncomeRatio") <= F.lit(4.0)}


def risk_report_rows(cases: DataFrame) -> DataFrame:
    """Report lines (application_id, section, position, label, value) of each case.

    Expects the application fields, optional score columns, ``factors`` (array of
    struct feature, impact, description) and ``sentences`` (array of string).
    """
    na = lambda c: F.coalesce(c.cast("string"), F.lit("N/A"))
    money = lambda c: F.concat(F.lit("$"), fixed(F.coalesce(F.col(c), F.lit(0.0)), 0))
    line = lambda section, pos, label, value: F.struct(
        F.lit(section).alias("section"), F.lit(pos).alias("position") if isinstance(pos, int) else pos.alias("position"),
        (F.lit(label) if isinstance(label, str) else label).alias("label"), value.alias("value"))
    details = [
        ("Application ID", na(F.col("application_id"))), ("Applicant", na(F.col("name"))),
        ("Loan Amount", money("LoanAmount")), ("Annual Income", money("Income")),
        ("Employment", na(F.col("EmploymentType"))),
        ("Tenure", F.concat(na(F.col("LoanTerm").cast("int")), F.lit(" months"))),
        ("Status", F.coalesce(F.upper("status"), F.lit("N/A"))),
        ("Submitted", na(F.date_format("ts", "yyyy-MM-dd")))]
    fixed_lines = [line("details", i, label, value) for i, (label, value) in enumerate(details)]
    scored = F.col("risk_score").isNotNull()
    fixed_lines += [
        F.when(scored, line("risk", 0, "Risk Score", F.concat(
            F.col("risk_score").cast("string"), F.lit("/100 ("), F.upper("risk_level"), F.lit(")")))),
        F.when(scored, line("risk", 1, "Confidence", percent(F.coalesce("confidence", F.lit(0.0)), 1))),
        F.when(scored & F.col("fraud_flag"), line("risk", 2, "FRAUD FLAG", F.coalesce(
            F.col("fraud_reason"), F.lit("Suspicious patterns detected")))),
        F.when(~scored, line("risk", 0, "Risk Score",
                             F.lit("Risk assessment has not been completed yet.")))]
    factors = F.transform(F.coalesce("factors", F.array()), lambda f, i: line("factors", i, f["feature"], f["description"])) \
        if "factors" in cases.columns else None
    sentences = F.transform("sentences", lambda s, i: line("explanation", i, "", s)) \
        if "sentences" in cases.columns else None
    parts = [F.array_compact(F.array(*fixed_lines))] + [
        F.coalesce(x, F.array().cast("array<struct<section:string,position:int,label:string,value:string>>"))
        for x in (factors, sentences) if x is not None]
    lines = F.concat(*parts) if len(parts) > 1 else parts[0]
    return cases.select("application_id", F.inline(lines))


def question_intent(text: Column) -> Column:
    q = F.lower(text)
    has = lambda *words: F.coalesce(
        F.greatest(*[F.contains(q, F.lit(w)).cast("int") for w in words]) == 1, F.lit(False)) \
        if len(words) > 1 else F.coalesce(F.contains(q, F.lit(words[0])), F.lit(False))
    return first_match([(has("rejected", "why"), "reason"), (has("document", "upload"), "documents")], "other")


def answer_questions(questions: DataFrame, explanations: DataFrame) -> DataFrame:
    """Route each question by keyword and answer it from the stored explanation.

    ``questions``: question, application_id (nullable); ``explanations``: one row per
    application with its sentences.
    """
    first = explanations.select("application_id", F.try_element_at("sentences", F.lit(1)).alias("_first"))
    intent = F.col("intent")
    answer = first_match([
        ((intent == "reason") & F.col("application_id").isNull(),
         "I need your application ID to explain the decision."),
        ((intent == "reason") & F.col("_first").isNotNull(),
         F.concat(F.lit("Based on your application, "), F.lower("_first"))),
        (intent == "reason", "I don't have the specific risk explanation for this application yet."),
        (intent == "documents",
         "You can upload ID proofs, bank statements, and tax returns in the 'Documents' tab."),
    ], "I'm a simple AI assistant. Please contact support for more complex queries.")
    return (questions.withColumn("intent", question_intent(F.col("question")))
            .join(first, "application_id", "left").withColumn("answer", answer).drop("_first"))
