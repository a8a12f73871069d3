"""Structured Streaming jobs.

State is bounded everywhere: by a watermark where rows are windowed by event time, by an
interval without use where they are keyed by identity.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from .. import vocabulary as v
from ..functions.expr import half_even, percent_change
from ..operators import drift, fraud, portfolio
from ..session import released
from ..sources.readers import _exists

LATE = "10 minutes"


def event_time(df: DataFrame, ts: str) -> DataFrame:
    """Timestamps without zone are read as UTC, which watermarks need."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


# ---- windowed throughput ---------------------------------------------------------

def throughput_windows(predictions: DataFrame, ts: str, latency: str, score: str, level: str, fraud_flag: str,
                       width: str = "1 hour", late: str = LATE) -> DataFrame:
    """Volume, latency and score summary per tumbling window; works on a stream and,
    with the same result, on a table."""
    df = event_time(predictions, ts)
    if df.isStreaming:
        df = df.withWatermark(ts, late)
    return df.groupBy(F.window(ts, width).alias("w")).agg(
        F.count(F.lit(1)).alias("total_predictions"), F.avg(latency).alias("avg_latency_ms"),
        F.percentile_approx(latency, 0.95, 10_000).alias("p95_latency_ms"), F.avg(score).alias("mean_risk_score"),
        *[F.count_if(F.col(level) == x).alias(f"n_{x}") for x in v.RISK_LEVELS],
        F.count_if(F.col(fraud_flag)).alias("fraud_flagged"),
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "total_predictions",
             "avg_latency_ms", "p95_latency_ms", "mean_risk_score", *[f"n_{x}" for x in v.RISK_LEVELS], "fraud_flagged")


# ---- windows of a stream that runs to completion ------------------------------------

def settle_windows(windows: DataFrame, root: str, keys: Sequence[str]) -> DataFrame:
    """Run a windowed stream over everything available and read the last state of every window.

    Update mode: each batch writes the windows it changed to its own folder (a replay
    overwrites it), and the newest version of a window counts. Windows that no watermark
    has closed yet are therefore there as well.
    """
    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    (windows.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", root + "/ckpt")
     .trigger(availableNow=True).start().awaitTermination())
    spark, rest = windows.sparkSession, [c for c in windows.columns if c not in keys]
    written = spark.read.schema(T.StructType([*windows.schema.fields, T.StructField("batch", T.LongType())])).parquet(root + "/out")
    return written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_w")).select(
        *[f"_w.{c}" if c in rest else c for c in windows.columns])


# ---- resubmission with keyed state -------------------------------------------------

LAST = [("id", "long"), ("ts", "timestamp"), ("Income", "double"), ("LoanAmount", "double")]
LAST_STRUCT = "struct<" + ",".join(f"{n}:{t}" for n, t in LAST) + ">"
ROWS = ("application_id long, ts timestamp, Income double, LoanAmount double, fingerprint string, occurrence long, previous_id long, "
        "previous_ts timestamp, Income_change_pct double, LoanAmount_change_pct double, batch long")
SUMMARY = f"fingerprint string, n long, first timestamp, last {LAST_STRUCT}, batch long"
CARRY = f"fingerprint string, batch long, before long, last {LAST_STRUCT}"


def ordered_batch(sink: str, fields: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: the submissions of a batch in the order of their times, and one row per fingerprint.

    The batch operator orders a fingerprint's rows by time, whatever the Arrow or file layout and
    however many they are; so a hot fingerprint meets the state as one row. A replay overwrites.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        keyed = event_time(batch, "ts").select(
            F.col("application_id").cast("long").alias("application_id"), "ts", F.col("Income").cast("double").alias("Income"),
            F.col("LoanAmount").cast("double").alias("LoanAmount"), fraud.fingerprint(fields).alias("fingerprint"))
        with released(spark):
            fraud.previous_submissions(keyed, "fingerprint").withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{sink}/rows/{batch_id}")
        rows = spark.read.schema(ROWS).parquet(f"{sink}/rows/{batch_id}")
        last = F.struct(F.col("application_id").alias("id"), "ts", "Income", "LoanAmount")
        rows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"),
                                        F.max_by(last, F.struct("ts", "application_id")).alias("last"), F.first("batch").alias("batch")
                                        ).write.mode("overwrite").parquet(f"{sink}/summary/{batch_id}")
    return run


class LastSubmission(StatefulProcessor):
    """Per fingerprint: how many submissions there were, the last of them, and the batch that told so.

    Hands every batch's row of the fingerprint what came before it. A batch told before (a replay) changes
    nothing. Rows are handed over many keys to a batch, not as one frame per key. The last submission is the latest by time, in whatever order batches come. A fingerprint whose next
    submission is more than ``keep`` later starts again; the state store itself forgets one that nobody touches for as long.
    """

    def __init__(self, keep: str) -> None:
        self.keep = pd.Timedelta(keep).to_pytimedelta()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("seen", ", ".join(["n long", *[f"{n} {t}" for n, t in LAST], "batch long"]),
                                          ttlDurationMs=int(self.keep.total_seconds() * 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        stamp = lambda t: t.replace(tzinfo=None) if t is not None and t.tzinfo else t
        place = lambda r: (r[1] is not None, r[1] or datetime.min, r[0] if r[0] is not None else -1)
        n, last, told, changed = 0, None, -1, False
        if (seen := self.state.get()) is not None:
            n, *last, told = seen
            last[1] = stamp(last[1])
        for row in sorted(rows, key=lambda r: r["batch"]):
            if row["batch"] <= told:
                continue
            first = stamp(row["first"])
            if last is not None and first is not None and last[1] is not None and first - last[1] > self.keep:
                n, last = 0, None
            yield Row(fingerprint=key[0], batch=row["batch"], before=n, last=Row(**dict(zip([c for c, _ in LAST], last))) if last else None)
            own = [row["last"][c] for c, _ in LAST]
            own[1] = stamp(own[1])
            n, last, told = n + row["n"], own if last is None or place(own) >= place(last) else last, row["batch"]
            changed = True
        if changed:
            self.state.update((n, *last, told))

    def close(self) -> None:
        pass


def resubmissions(applications: DataFrame, sink: str, checkpoint: str, fields: Sequence[str] = v.IDENTITY_FIELDS,
                  keep: str = "3650 days") -> StreamingQuery:
    """Process everything available; ``submissions_seen`` reads the result.

    One query orders each batch and tells one row per fingerprint; the second keeps the state of fingerprints in
    RocksDB and touches only those of its batch. Old versions of the state go with the store's own
    maintenance; a version that is missing is an error.
    """
    spark = applications.sparkSession
    (applications.writeStream.foreachBatch(ordered_batch(sink, fields)).option("checkpointLocation", f"{checkpoint}/order")
     .trigger(availableNow=True).start().awaitTermination())

    def keep_carry(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/carry/{batch_id}")

    told = spark.readStream.schema(SUMMARY).option("ignoreMissingFiles", "true").parquet(f"{sink}/summary/*")
    carried = told.groupBy("fingerprint").transformWithState(LastSubmission(keep), CARRY, "Update", "processingTime")
    with rocksdb(spark):
        return (carried.writeStream.outputMode("update").foreachBatch(keep_carry).option("checkpointLocation", f"{checkpoint}/state")
                .trigger(availableNow=True).start())


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which their checkpoint remembers, and end when the
    data does: a state with a time to live would ask for batches without data for ever."""
    own = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
           "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, x in own.items():
            spark.conf.set(k, x)
        yield
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)


def submissions_seen(spark: SparkSession, sink: str) -> DataFrame:
    """Every submission with its occurrence number and previous submission, over all batches processed so far."""
    rows = spark.read.schema(ROWS).parquet(f"{sink}/rows/*")
    carry = spark.read.schema(CARRY).parquet(f"{sink}/carry/*").withColumnRenamed("last", "_last")
    both = rows.join(carry, ["fingerprint", "batch"])
    first = F.col("occurrence") == 1
    carried = lambda c, own: F.when(first, F.col(f"_last.{c}")).otherwise(F.col(own))
    change = lambda c: F.when(first, percent_change(F.col(f"_last.{c}"), F.col(c))).otherwise(F.col(f"{c}_change_pct"))
    return both.select(
        "application_id", "ts", "Income", "LoanAmount", "fingerprint", (F.col("occurrence") + F.col("before")).alias("occurrence"),
        carried("id", "previous_id").alias("previous_id"), carried("ts", "previous_ts").alias("previous_ts"),
        change("Income").alias("Income_change_pct"), change("LoanAmount").alias("LoanAmount_change_pct"), "batch")


def _earlier(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """What earlier batches wrote; partition pruning leaves the replayed batch out."""
    if batch_id == 0 or not _exists(spark, path):
        return None
    return spark.read.parquet(path).filter(F.col("batch") < batch_id)


# ---- submit -> score -> decide ----------------------------------------------------

def decide_batch(score: Callable[[DataFrame], DataFrame], sink: str, id_col: str = "application_id", look_back: bool = True
                 ) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: score, screen, decide and write decisions, audit rows and
    notifications.

    Idempotent: every output goes to a folder named by the batch id and overwrites it,
    so a replayed batch (after a lost driver or executor) leaves the same files. With ``look_back`` what
    earlier batches decided is left out by reading it; a stream whose state knows the ids does without.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        once = batch.dropDuplicates([id_col])
        earlier = _earlier(batch.sparkSession, f"{sink}/decisions", batch_id) if look_back else None
        if earlier is not None:  # an application sent again was decided in its first batch
            once = once.join(earlier.select(id_col), id_col, "left_anti")
        decided = portfolio.auto_decide(fraud.screen(score(once)))
        decided = decided.persist()
        try:
            keep = [id_col, "applicant_id", "risk_score", "risk_level", "fraud_flag", "fraud_probability",
                    "ai_recommendation", "status", "final_decision"]
            out = lambda df, name: df.write.mode("overwrite").parquet(f"{sink}/{name}/batch={batch_id}")
            out(decided.select(*keep), "decisions")
            out(portfolio.auto_audit(decided), "audit")
            out(portfolio.notifications(decided), "notifications")
        finally:
            decided.unpersist()
    return run


def start_decisions(stream: DataFrame, score: Callable[[DataFrame], DataFrame], sink: str,
                    checkpoint: str, available_now: bool = True, id_col: str = "application_id") -> StreamingQuery:
    """Decide every application once: the ids decided so far are state, of which a batch touches its own only."""
    once = stream.dropDuplicates([id_col])
    w = once.writeStream.foreachBatch(decide_batch(score, sink, id_col, look_back=False)).option("checkpointLocation", checkpoint)
    with rocksdb(stream.sparkSession):
        return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")).start()


# ---- drift on a stream -------------------------------------------------------------

def drift_windows(predictions: DataFrame, edges: dict[str, list[float]], categorical: Sequence[str], ts: str,
                  width: str = "1 day", late: str = LATE) -> DataFrame:
    """Histogram counts per window, feature and bin against the stored edges."""
    df = event_time(predictions, ts)
    if df.isStreaming:
        df = df.withWatermark(ts, late)
    windowed = df.withColumn("w", F.window(ts, width))
    counts = drift.histogram(windowed, edges, categorical, by=["w"])
    return counts.select(F.col("w.start").alias("window_start"), "feature", "kind", "bin", "n")


def window_psi(counts: DataFrame, reference: DataFrame) -> DataFrame:
    """PSI per window and feature from window histograms and the reference's histogram
    (rows feature, kind, bin, n). Empty bins of either side count at the floor share."""
    from pyspark.sql import Window as W
    e = reference.select("feature", "kind", "bin", (F.col("n") / F.sum("n").over(W.partitionBy("feature"))).alias("e"))
    a = counts.select("window_start", "feature", "kind", "bin", (
        F.col("n") / F.sum("n").over(W.partitionBy("window_start", "feature"))).alias("a"))
    # every window meets every reference bin of its feature: a few bins each
    grid = a.select("window_start", "feature").distinct().join(e, "feature")
    both = grid.join(a, ["window_start", "feature", "kind", "bin"], "full_outer")
    term = drift._term(F.coalesce("e", F.lit(0.0)), F.coalesce("a", F.lit(0.0)))
    psi = half_even(F.sum(term), 4)
    return both.groupBy("window_start", "feature", "kind").agg(
        psi.alias("psi"), drift.psi_status(psi).alias("status"))


# ---- outcomes and late rows ---------------------------------------------------------

def outcome_backlog(outcomes: DataFrame, trained_at: Column, ts: str = "recorded_at") -> DataFrame:
    """Running number of outcomes since the last training (complete output mode)."""
    return outcomes.filter(F.col(ts) > trained_at).groupBy().agg(
        F.count(F.lit(1)).alias("new_outcomes")).withColumn("retrain", F.col("new_outcomes") >= v.OUTCOME_BACKLOG)


def split_late(batch: DataFrame, ts: str, watermark: Column, width: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(on time, late): a row is late when it lies behind the watermark, or with ``width`` when the watermark has
    closed its window of that width. Rows without a time are on time."""
    untimed = batch.filter(F.col(ts).isNull())  # a window would drop them
    behind = F.col(ts) < watermark if width is None else F.window(ts, width)["end"] <= watermark
    marked = batch.filter(F.col(ts).isNotNull()).withColumn("_late", F.coalesce(behind, F.lit(False)))
    return marked.filter("NOT _late").drop("_late").unionByName(untimed), marked.filter("_late").drop("_late")


def keep_late(stream: DataFrame, ts: str, sink: str, checkpoint: str, width: str = "1 hour", late: str = LATE) -> StreamingQuery:
    """Process everything available: rows on time to ``sink/on_time``, late ones to the side table ``sink/late``.

    The watermark of a batch is the latest event time of all earlier batches less ``late``. It is kept beside the
    rows, one row per batch that a replay overwrites; a batch whose predecessor's is missing fails. A windowed stream over
    ``sink/on_time`` with the same delay drops nothing: its watermark is never ahead of the one used here.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark, mark = batch.sparkSession, "latest timestamp"
        before = spark.read.schema(mark).parquet(f"{sink}/marks/{batch_id - 1}") if batch_id else spark.createDataFrame([], mark)
        rows = event_time(batch, ts).persist()
        try:
            watermark = before.agg(F.max("latest") - F.expr(f"INTERVAL {late}")).scalar()
            for name, part in zip(("on_time", "late"), split_late(rows, ts, watermark, width)):
                part.write.mode("overwrite").parquet(f"{sink}/{name}/batch={batch_id}")
            rows.select(F.col(ts).alias("latest")).unionAll(before).agg(F.max("latest").alias("latest")).write.mode("overwrite").parquet(f"{sink}/marks/{batch_id}")
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_stream(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet",
                files_per_batch: int | None = None, only: str | None = None) -> DataFrame:
    """A folder as a stream of files; ``only`` restricts it to matching file names."""
    r = spark.readStream.schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    if only:
        r = r.option("pathGlobFilter", only)
    return r.format(kind).load(path)
