"""Credit tables seen through the driver's tables.

The driver's tables hold no loans, so every operator runs on a stand-in view: an order
is an application, a customer an applicant, an order line an instalment. All derived
values come from integer arithmetic on keys, with missing and invalid values planted at
fixed residues.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.expr import first_match, half_even

CUT = scoring.Cutoffs(low=0.05, high=0.30, decision=0.20)
KEY, CUST = F.col, F.col


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(n: Column, *values: str | None) -> Column:
    """values[n]; a None gives NULL."""
    return first_match([(n == i, v) for i, v in enumerate(values) if v is not None])


def applications(spark: SparkSession, sf_dir: str, lines: bool = True, income: bool = True) -> DataFrame:
    """One row per order. ``lines`` adds the line count (a join with lineitem), ``income``
    the customer's columns (a join with customer); without them those are left out."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, sf_dir, "orders")
    if lines:
        n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"))
        o = o.join(n, k == F.col("l_orderkey"), "left")
    if income:
        cust = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey")
        o = o.join(cust, c == F.col("c_custkey"))
    cols = [
        k.alias("application_id"), c.alias("applicant_id"), F.col("o_orderdate").alias("ts"),
        first_match([(F.col("o_orderstatus") == "F", "approved"), (F.col("o_orderstatus") == "P", "rejected")],
                    "under_review").alias("status"),
        (F.lit(18) + c % 63).cast("double").alias("Age"),
        F.col("o_totalprice").alias("LoanAmount"),
        (F.lit(300) + (k * 7919) % 551).cast("double").alias("CreditScore"),
        F.when(k % 11 != 0, (k % 241).cast("double")).alias("MonthsEmployed"),
        (c % 26).cast("double").alias("InterestRate"),
        (F.lit(12) * (F.lit(1) + k % 5)).cast("double").alias("LoanTerm"),
        ((k % 160).cast("double") / F.lit(100.0)).alias("DTIRatio"),
        pick(k % 5, "High School", "Bachelor's", "Master's", "PhD", "Kindergarten").alias("Education"),
        pick(c % 5, "Full-time", "Part-time", "Self-employed", "Unemployed", None).alias("EmploymentType"),
        pick(c % 4, "Single", "Married", "Divorced", None).alias("MaritalStatus"),
        pick(k % 2, "Yes", "No").alias("HasMortgage"),
        pick(c % 3, "Yes", "No", "No").alias("HasDependents"),
        pick(k % 6, "Auto", "Business", "Education", "Home", "Other", "Spaceship").alias("LoanPurpose"),
        pick(k % 7, "Yes", *["No"] * 6).alias("HasCoSigner"),
        (F.col("o_orderstatus") == "F").cast("int").alias("Default"),
        ((k % 1000).cast("double") / F.lit(1000.0)).alias("probability"),
        F.col("o_orderpriority").alias("priority"),
    ]
    if lines:
        cols.append(F.col("n_lines").cast("double").alias("NumCreditLines"))
    if income:
        cols += [F.round((F.col("c_acctbal") + F.lit(1000.0)) * F.lit(12.0), 2).alias("Income"),
                 F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")]
    return o.select(*cols)


def scored(df: DataFrame) -> DataFrame:
    """Score, level and confidence from ``probability``."""
    return (df.withColumn("risk_score", half_even(scoring.risk_score("probability", CUT), 2))
            .withColumns({"risk_level": scoring.risk_level("risk_score"),
                          "confidence": scoring.confidence("probability", CUT)}))


def messy_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applications as loosely typed text with planted bad values."""
    k = F.col("application_id")
    whole = F.floor("Income").cast("string")
    return applications(spark, sf_dir, lines=False).select(
        "application_id", "Age",
        first_match([(k % 97 == 0, "abc"), (k % 89 == 0, F.lit(None).cast("string"))], whole).alias("Income"),
        "LoanAmount",
        first_match([(k % 101 == 0, 9999.0), (k % 103 == 0, -50.0)], F.col("CreditScore")).alias("CreditScore"),
        "MonthsEmployed", "LoanTerm", "DTIRatio", "Education", "EmploymentType", "MaritalStatus",
        "HasMortgage", "HasDependents", "LoanPurpose",
        first_match([(k % 107 == 0, 5)], F.col("Default")).alias("Default"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"),
                    F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"))


def score_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several scores per application, one per line."""
    li = table(spark, sf_dir, "lineitem")
    p = (F.pmod(F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17, F.lit(1000))).cast("double") / F.lit(1000.0)
    return li.select(F.col("l_orderkey").alias("application_id"), F.col("l_shipdate").alias("scored_at"),
                     F.col("l_linenumber").alias("seq"),
                     half_even(scoring.risk_score(p, CUT), 2).alias("risk_score")
                     ).withColumn("risk_level", scoring.risk_level("risk_score"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("application_id"), F.col("o_orderdate").alias("decided_at"),
        F.concat(F.lit("officer-"), (k % 7).cast("string")).alias("decided_by"),
        first_match([(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "approve"),
                     (F.col("o_orderpriority").isin("4-NOT SPECIFIED", "5-LOW"), "reject")],
                    "review").alias("ai_recommendation"),
        first_match([(F.col("o_orderstatus") == "F", "approve"), (F.col("o_orderstatus") == "O", "reject")],
                    F.lit(None).cast("string")).alias("final_decision"))


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("log_id"), F.col("ts").alias("timestamp"),
                    pick(F.col("user_id") % 4, "AI", "Officer", "Admin", "System").alias("actor_type"),
                    F.col("event_type").alias("action"), "value")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a prediction log."""
    e = table(spark, sf_dir, "events")
    p = (F.col("event_id") % 1000).cast("double") / F.lit(1000.0)
    return e.select(F.col("ts").alias("timestamp"), "event_id", "user_id", "event_type", "value",
                    half_even(scoring.risk_score(p, CUT), 2).alias("risk_score"),
                    (F.col("event_id") % 37 == 0).alias("fraud_flag")
                    ).withColumn("risk_level", scoring.risk_level("risk_score"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a 0/1 outcome and a probability from their length."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    y = table(spark, sf_dir, "labels").select("doc_id", "quality")
    n = F.col("n_chars").cast("double")
    p = n / (n + F.lit(2048.0))
    return d.join(y, "doc_id").select("doc_id", F.col("quality").alias("y"), p.alias("p"))
