"""Streaming jobs run to completion over the driver's tables as file streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import half_even
from ..functions import scoring
from ..operators import drift
from ..session import shared_folder
from ..streaming import jobs
from . import bindings as b
from .queries import query, rounded

def _stream(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return jobs.read_stream(spark, sf, b.table(spark, sf, table).schema, only=f"{table}.parquet")


def _predictions(events: DataFrame) -> DataFrame:
    p = (F.col("event_id") % 1000).cast("double") / F.lit(1000.0)
    return events.select(F.col("ts").alias("timestamp"), "event_id", "event_type", "value",
                         half_even(scoring.risk_score(p, b.CUT), 2).alias("risk_score"),
                         (F.col("event_id") % 37 == 0).alias("fraud_flag")
                         ).withColumn("risk_level", scoring.risk_level("risk_score"))


@query
def stream_throughput(spark, sf):
    df = jobs.throughput_windows(_predictions(_stream(spark, sf, "events")), "timestamp", "value", "risk_score",
                                 "risk_level", "fraud_flag")
    out = jobs.settle_windows(df, shared_folder(spark, "throughput"), ["window_start", "window_end"])
    ntz = lambda c: F.col(c).cast("timestamp_ntz")
    return rounded(out.withColumns({"window_start": ntz("window_start"), "window_end": ntz("window_end")}),
                   "avg_latency_ms", "p95_latency_ms", "mean_risk_score")


@query
def stream_duplicates(spark, sf):
    e = _stream(spark, sf, "events").select(
        F.col("event_id").alias("application_id"), "ts", F.col("value").alias("Income"),
        (F.col("value") * F.lit(10.0)).alias("LoanAmount"), "user_id", "event_type")
    root = shared_folder(spark, "resubmissions")
    jobs.resubmissions(e, root, root + "/ckpt", ["user_id", "event_type"]).awaitTermination()
    return jobs.submissions_seen(spark, root).select(
        "application_id", "fingerprint", "occurrence", "previous_id", "Income_change_pct", "LoanAmount_change_pct")


@query
def stream_drift(spark, sf):
    mid = F.lit("2024-01-16").cast("timestamp_ntz")
    ref = b.table(spark, sf, "events").filter(F.col("ts") < mid)
    edges = drift.fit_edges(ref, ["value"])
    current = _stream(spark, sf, "events").filter(F.col("ts") >= mid)
    counts = jobs.settle_windows(jobs.drift_windows(current, edges, ["event_type"], "ts"), shared_folder(spark, "drift"),
                                 ["window_start", "feature", "kind", "bin"])
    psi = jobs.window_psi(counts, drift.histogram(ref, edges, ["event_type"]))
    return psi.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "feature", "kind", "psi", "status")


@query
def stream_decisions(spark, sf):
    c = b.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    k = F.col("o_orderkey")
    apps = _stream(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        k.alias("application_id"), F.col("o_custkey").alias("applicant_id"), F.col("o_totalprice").alias("LoanAmount"),
        F.round((F.col("c_acctbal") + F.lit(1000.0)) * F.lit(12.0), 2).alias("Income"),
        (F.lit(18) + F.col("o_custkey") % 63).cast("double").alias("Age"),
        (F.lit(300) + (k * 7919) % 551).cast("double").alias("CreditScore"),
        F.when(k % 11 != 0, (k % 241).cast("double")).alias("MonthsEmployed"), F.lit(2.0).alias("NumCreditLines"),
        ((k % 160).cast("double") / F.lit(100.0)).alias("DTIRatio"),
        b.pick(F.col("o_custkey") % 5, "Full-time", "Part-time", "Self-employed", "Unemployed", None).alias("EmploymentType"),
        ((k % 1000).cast("double") / F.lit(1000.0)).alias("probability"))
    root = shared_folder(spark, "decisions")
    jobs.start_decisions(apps, b.scored, root + "/out", root + "/ckpt").awaitTermination()
    return spark.read.parquet(root + "/out/decisions").select(
        "application_id", "risk_score", "fraud_probability", "fraud_flag", "ai_recommendation", "status", "final_decision")


@query
def stream_outcomes(spark, sf):
    """Outcomes recorded since the last training, counted over the stream of decided orders."""
    recorded = jobs.event_time(_stream(spark, sf, "orders").filter("o_orderstatus <> 'P'").withColumnRenamed("o_orderdate", "recorded_at"), "recorded_at")
    root = shared_folder(spark, "outcomes")
    counted = jobs.outcome_backlog(recorded, F.lit("1996-01-01").cast("timestamp"))
    (counted.writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(root + "/out"))
     .option("checkpointLocation", root + "/ckpt").trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(counted.schema).parquet(root + "/out")


@query
def stream_late_rows(spark, sf):
    """Events arrive in four parts; every fiftieth arrives with the last part. Per hour: rows counted in time and rows in the side table."""
    e = b.table(spark, sf, "events").select("event_id", "ts").withColumn("part", F.when(F.col("event_id") % 50 == 7, F.lit(3)).otherwise(
        F.least(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(3))).cast("int"))
    root = shared_folder(spark, "late")
    schema = e.drop("part").schema
    for part in range(4):  # each run of the stream finds one part more
        e.filter(F.col("part") == part).drop("part").write.parquet(f"{root}/in/{part}")
        jobs.keep_late(jobs.read_stream(spark, f"{root}/in/*", schema), "ts", root, f"{root}/ckpt").awaitTermination()
    read = lambda name, flag: spark.read.schema("event_id long, ts timestamp").parquet(f"{root}/{name}").withColumn("late", F.lit(flag))
    both = read("on_time", False).unionAll(read("late", True))
    return both.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("window_start")).agg(
        F.count_if(~F.col("late")).alias("on_time"), F.count_if("late").alias("late"))
