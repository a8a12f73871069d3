"""Files, registry, streams and models."""

import json

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from lendframe import vocabulary as v
from lendframe.learn import neighbours, pipeline
from lendframe.learn.preprocess import stratified_split, undersample
from lendframe.operators import fraud
from lendframe.sources import readers, registry, stores
from lendframe.streaming import jobs



def write_sources(folder, extra=""):
    files = {
        "application": "SK_ID_CURR,UNUSED,TARGET,DAYS_BIRTH,DAYS_EMPLOYED,AMT_INCOME_TOTAL,AMT_CREDIT,AMT_ANNUITY,EXT_SOURCE_1,EXT_SOURCE_2,EXT_SOURCE_3,NAME_EDUCATION_TYPE,NAME_INCOME_TYPE,NAME_FAMILY_STATUS,FLAG_OWN_REALTY,CNT_CHILDREN,NAME_TYPE_SUITE\n"
                       "1,x,0,-14610,365243,100000,50000,0,,0.5,,Higher education,Pensioner,Widow,Y,2,Family\n"
                       "2,x,1,-9000,-3044,0,50000,2500,0.2,0.4,0.6,Odd,Working,Married,N,,\n" + extra,
        "bureau": "SK_ID_CURR,SK_ID_BUREAU,CREDIT_ACTIVE,CREDIT_DAY_OVERDUE,DAYS_CREDIT,AMT_CREDIT_SUM,AMT_CREDIT_SUM_DEBT\n1,10,Active,0,-50,1000,500\n",
        "bureau_balance": "SK_ID_BUREAU,STATUS\n10,0\n10,2\n",
        "previous_application": "SK_ID_CURR,SK_ID_PREV,NAME_CONTRACT_STATUS\n1,7,Approved\n1,8,Refused\n",
        "installments_payments": "SK_ID_CURR,DAYS_INSTALMENT,DAYS_ENTRY_PAYMENT,AMT_INSTALMENT,AMT_PAYMENT\n1,-10,-5,100,100\n1,-9,,100,\n",
        "POS_CASH_balance": "SK_ID_CURR,SK_DPD\n1,0\n1,4\n",
        "credit_card_balance": "SK_ID_CURR,AMT_BALANCE,AMT_CREDIT_LIMIT_ACTUAL,SK_DPD\n1,50,0,3\n",
    }
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text)


def test_sources_to_canonical_with_cache(spark, tmp_path):
    src, cache = tmp_path / "src", tmp_path / "cache"
    src.mkdir()
    with pytest.raises(FileNotFoundError, match="bureau_balance"):
        readers.read_sources(spark, str(src))
    write_sources(src)
    rows = {r[v.ID]: r for r in stores.cached_canonical(spark, str(src), str(cache)).collect()}
    a, b = rows[1], rows[2]
    assert (a["Age"], a["MonthsEmployed"], a["CreditScore"], a["LoanTerm"], a["NumCreditLines"]) == (40.0, None, 575.0, None, 1.0)
    assert (a["EmploymentType"], a["MaritalStatus"], a["HasCoSigner"], a["BureauBalanceDelinquencyRate"]) == ("Part-time", "Divorced", "Yes", 0.5)
    assert (a["InstallmentLatePaymentRate"], a["PosMaxDaysPastDue"], a["CreditCardUtilizationRatio"]) == (0.5, 4, 3.0)
    assert (b["HasBureauHistory"], b["NumCreditLines"], b["DTIRatio"], b["Education"], b["HasCoSigner"]) == (0.0, None, None, None, "No")
    stores.cached_canonical(spark, str(src), str(cache))
    assert len(list(cache.iterdir())) == 1  # nothing rebuilt
    write_sources(src, "3,x,0,-9000,-10,1,1,1,,,,,,,N,0,\n")
    assert stores.cached_canonical(spark, str(src), str(cache)).count() == 3


def test_a_changed_source_rebuilds_its_part_only(spark, tmp_path):
    src, cache = tmp_path / "src", tmp_path / "cache"
    src.mkdir()
    write_sources(src)
    fresh = lambda: {r["part"]: r["fresh"] for r in stores.cache_state(spark, str(src), str(cache)).collect()}
    assert not any(fresh().values())
    stores.cached_canonical(spark, str(src), str(cache))
    assert all(fresh().values())
    written = {p: p.stat().st_mtime_ns for p in (cache / "canonical").iterdir()}
    assert len(written) == 7  # six parts and a build
    (src / "bureau_balance.csv").write_text("SK_ID_BUREAU,STATUS\n10,0\n")
    assert [p for p, ok in fresh().items() if not ok] == ["bureau"]
    stores.cached_canonical(spark, str(src), str(cache))
    now = {p: p.stat().st_mtime_ns for p in (cache / "canonical").iterdir()}
    assert len(now) == 9 and all(now[p] == t for p, t in written.items())


def test_rows_behind_the_watermark_go_to_the_side_table(spark, tmp_path):
    root = str(tmp_path)
    schema = "id long, ts timestamp"
    batches = [[(1, "2024-01-01 10:05:00"), (2, "2024-01-01 12:30:00")],
               [(3, "2024-01-01 11:59:00"), (4, "2024-01-01 12:01:00"), (5, None)],  # watermark 12:20: hour 11 is closed
               [(6, "2024-01-01 10:00:00"), (7, "2024-01-01 15:00:00")],
               [(8, "2024-01-01 13:59:59"), (9, "2024-01-01 14:30:00")]]  # watermark 14:50
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "id long, ts string").select("id", F.col("ts").cast("timestamp")).write.parquet(f"{root}/in/{i}")
        jobs.keep_late(jobs.read_stream(spark, f"{root}/in/*", spark.createDataFrame([], schema).schema), "ts", root, f"{root}/ckpt").awaitTermination()
    read = lambda name: sorted(r["id"] for r in spark.read.schema(schema).parquet(f"{root}/{name}").collect())
    assert read("late") == [3, 6, 8] and read("on_time") == [1, 2, 4, 5, 7, 9]
    # a windowed stream over the rows on time drops none of them
    given = spark.createDataFrame([], schema).schema
    counted = jobs.read_stream(spark, f"{root}/on_time/*", given, files_per_batch=1).withWatermark("ts", jobs.LATE).groupBy(
        F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    assert sum(r["n"] for r in jobs.settle_windows(counted, f"{root}/windows", ["w"]).collect()) == 5


def test_snapshots(spark, tmp_path):
    root = str(tmp_path)
    df = spark.range(10).withColumn("Default", (F.col("id") % 2).cast("int"))
    stores.save_snapshot(df, root, "v1", "a.csv", F.lit("2024-01-01").cast("timestamp"))
    stores.save_snapshot(df.limit(4), root, "v2", "b.csv", F.lit("2024-01-02").cast("timestamp"))
    assert [r["version"] for r in stores.list_versions(spark, root).collect()] == ["v2", "v1"]
    assert stores.read_snapshot(spark, root).count() == 4 and stores.read_snapshot(spark, root, "v1").count() == 10
    meta = stores.list_versions(spark, root).filter("version = 'v1'").first()
    assert meta["positive_rate"] == 0.5 and meta["columns"] == ["id", "Default"]
    with pytest.raises(FileNotFoundError):
        stores.read_snapshot(spark, root, "v9")
    assert readers.table_digest(df).first() == readers.table_digest(df.repartition(7)).first()


def test_logs_skip_bad_lines(spark, tmp_path):
    good = {"timestamp": "2024-01-01T00:00:00Z", "event": "predict", "latency_ms": 5.0, "response": {"riskScore": 10.0}}
    f = tmp_path / "log.jsonl"
    f.write_text(json.dumps(good) + "\n\n{broken\n   \n" + json.dumps(good) + "\n")
    assert readers.read_lines(spark, str(f), readers.PREDICTION_SCHEMA).count() == 2
    assert [r[0] for r in readers.bad_lines(spark, str(f), readers.PREDICTION_SCHEMA).collect()] == ["{broken"]


def test_prediction_log_round_trip(spark, tmp_path):
    path = str(tmp_path / "predictions")
    scored = spark.createDataFrame([(1, 40.0, "PhD", 12.5, "low", 0.02)], "application_id long, Age double, Education string, risk_score double, risk_level string, probability double")
    for day in ("2024-01-01", "2024-01-02"):
        stores.append_predictions(stores.prediction_rows(scored, "v1", now=F.lit(day + " 10:00:00").cast("timestamp")), path)
    assert stores.read_predictions(spark, path).count() == 2
    r = readers.flat_predictions(stores.read_predictions(spark, path, since="2024-01-02")).collect()
    assert len(r) == 1 and (r[0]["Age"], r[0]["Education"], r[0]["risk_score"]) == (40.0, "PhD", 12.5)


def test_registry_life(spark, tmp_path):
    root = str(tmp_path)
    model = Pipeline(stages=[VectorAssembler(inputCols=["id"], outputCol="x")]).fit(spark.range(2))
    stores.save_model(spark, root, "v1", model, {"roc_auc": 0.75}, now="1")
    stores.save_model(spark, root, "v2", model, {"roc_auc": 0.751}, activate=False)
    lost = stores.promote_if_better(spark, root, "v2", now="2")
    assert not lost["promoted"]
    stores.save_model(spark, root, "v3", model, {"roc_auc": 0.80}, activate=False)
    assert stores.promote_if_better(spark, root, "v3", now="3")["promoted"]
    known, log = stores.registry_tables(spark, root)
    p = registry.active_pointer(log).first()
    assert (p["active_version"], p["previous_version"]) == ("v3", "v1")
    assert [r["version"] for r in registry.prunable(known, log, keep=1).collect()] == ["v2"]
    assert stores.rollback(spark, root, now="4") == "v1"
    assert stores.load_model(spark, root).transform(spark.range(1)).count() == 1
    with pytest.raises(FileNotFoundError):
        stores.set_active(spark, root, "v9")


def test_outcomes_keep_the_application_id(spark):
    df = spark.createDataFrame([(5, "full_time", 1)], "app long, employmentType string, bad int")
    r = stores.outcome_rows(df, "bad", "app").first()
    assert (r["application_id"], r["EmploymentType"], r["Default"]) == ("5", "Full-time", 1)


# ---- streams ------------------------------------------------------------------------

def people(spark, lo, hi):
    return spark.range(lo, hi).select(
        F.col("id").alias("application_id"), (F.lit("2024-01-01").cast("timestamp").cast("long") + F.col("id") * 60).cast("timestamp").alias("ts"),
        (F.lit(1000.0) + F.col("id")).alias("Income"), F.lit(10.0).alias("LoanAmount"), (F.col("id") % 3).cast("double").alias("Age"),
        F.lit("x").alias("EmploymentType"), F.lit("y").alias("MaritalStatus"), F.lit("z").alias("Education"), F.lit("No").alias("HasDependents"))


def test_duplicates_survive_a_restart(spark, tmp_path):
    """Two runs, the second from its checkpoint; more rows per key than one Arrow batch, times descending in the files."""
    src, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for lo, hi in ((0, 30), (30, 60)):
            people(spark, lo, hi).orderBy(F.desc("ts")).coalesce(1).write.mode("append").parquet(src)
            jobs.resubmissions(jobs.read_stream(spark, src, people(spark, 0, 1).schema), out, ckpt).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    columns = ["application_id", "occurrence", "previous_id", "Income_change_pct"]
    got = jobs.submissions_seen(spark, out).select(*columns).orderBy("application_id").collect()
    want = fraud.previous_submissions(people(spark, 0, 60).withColumn("fingerprint", fraud.fingerprint()), "fingerprint").select(*columns).orderBy("application_id").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def sent(spark, src, rows):
    rows.coalesce(1).write.mode("append").parquet(src)
    return jobs.read_stream(spark, src, rows.schema, files_per_batch=1)


def test_forgotten_fingerprints_start_again(spark, tmp_path):
    """A submission more than an hour after the last one of its fingerprint is a first one."""
    src, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    day = F.expr("INTERVAL 1 DAY")
    later = people(spark, 0, 3).withColumn("ts", F.col("ts") + day)
    again = later.filter("Age = 0").withColumn("ts", F.col("ts") + F.expr("INTERVAL 10 MINUTES"))
    for rows in (people(spark, 0, 3), later, again):
        jobs.resubmissions(sent(spark, src, rows), out, ckpt, ["Age"], "1 hours").awaitTermination()
    got = {(r["batch"], r["application_id"]): r["occurrence"] for r in jobs.submissions_seen(spark, out).collect()}
    assert got == {(0, 0): 1, (0, 1): 1, (0, 2): 1, (1, 0): 1, (1, 1): 1, (1, 2): 1, (2, 0): 2}


def test_twenty_batches_keep_the_latest_and_leave_bounded_files(spark, tmp_path):
    """Batches out of order: the previous submission is the latest by time. What a batch needed on the way is gone."""
    src, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    import os
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    rows = people(spark, 0, 40).withColumn("Age", F.lit(1.0))
    for k in [1, 0, *range(2, 20)]:
        stream = sent(spark, src, rows.filter(f"application_id div 2 = {k}"))
    jobs.resubmissions(stream, out, ckpt, ["Age"]).awaitTermination()
    got = {r["application_id"]: r for r in jobs.submissions_seen(spark, out).collect()}
    assert len(got) == 40 and {r["batch"] for r in got.values()} == set(range(20))
    assert sorted(r["occurrence"] for r in got.values()) == list(range(1, 41))
    assert got[0]["previous_id"] == 3 and got[4]["previous_id"] == 3 and got[39]["previous_id"] == 38  # 2 and 3 came first, then 0 and 1
    assert set(os.listdir(base)) <= before
    assert all(len([f for f in os.listdir(f"{out}/summary/{k}") if f.endswith(".parquet")]) <= 8 for k in range(20))


def test_replayed_batch_is_told_once(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    jobs.resubmissions(sent(spark, src, people(spark, 0, 9)), out, ckpt, ["Age"]).awaitTermination()
    jobs.ordered_batch(out, ["Age"])(people(spark, 0, 9), 0)
    jobs.resubmissions(sent(spark, src, people(spark, 9, 12)), out, ckpt, ["Age"]).awaitTermination()
    got = sorted((r["application_id"], r["occurrence"]) for r in jobs.submissions_seen(spark, out).collect())
    assert got == [(i, i // 3 + 1) for i in range(12)]


def test_stream_decides_an_application_once(spark, tmp_path):
    src, sink, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    rows = people(spark, 0, 6).withColumns({"applicant_id": F.col("application_id"), "CreditScore": F.lit(700.0), "MonthsEmployed": F.lit(1.0),
                                            "NumCreditLines": F.lit(1.0), "DTIRatio": F.lit(0.1)})
    score = lambda df: df.withColumn("risk_score", F.col("application_id") * 20.0).withColumn("risk_level", F.lit("low"))
    for part in (rows.filter("application_id < 4"), rows):
        jobs.start_decisions(sent(spark, src, part), score, sink, ckpt).awaitTermination()
    assert sorted(r["application_id"] for r in spark.read.parquet(sink + "/decisions").collect()) == list(range(6))


def test_decisions_are_idempotent(spark, tmp_path):
    sink = str(tmp_path / "sink")
    rows = people(spark, 0, 6).withColumns({"applicant_id": F.col("application_id"), "CreditScore": F.lit(700.0), "MonthsEmployed": F.lit(1.0),
                                            "NumCreditLines": F.lit(1.0), "DTIRatio": F.lit(0.1)})
    score = lambda df: df.withColumn("risk_score", F.col("application_id") * 20.0).withColumn("risk_level", F.lit("low"))
    run = jobs.decide_batch(score, sink)
    for _ in range(2):
        run(rows.unionAll(rows), 0)
    assert spark.read.parquet(sink + "/decisions").count() == 6
    run(rows, 1)  # sent again in a later batch
    assert spark.read.parquet(sink + "/decisions").count() == 6
    assert spark.read.parquet(sink + "/audit").count() == spark.read.parquet(sink + "/notifications").count()


def test_late_rows_are_kept_aside(spark):
    on_time, late = jobs.split_late(people(spark, 0, 10), "ts", F.lit("2024-01-01 00:05:00").cast("timestamp"))
    assert (on_time.count(), late.count()) == (5, 5)


# ---- learning -----------------------------------------------------------------------

def test_split_and_undersample_shares(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    counts = {(r["y"], r["split"]): r["count"] for r in stratified_split(df, "y", "id").groupBy("y", "split").count().collect()}
    assert counts == {(0, "test"): 135, (0, "val"): 135, (0, "train"): 630, (1, "test"): 15, (1, "val"): 15, (1, "train"): 70}
    under = {r["y"]: r["count"] for r in undersample(df, "y", "id").groupBy("y").count().collect()}
    assert under == {0: 100, 1: 100}


@pytest.mark.parametrize("pivots,rows", [(1, 1000), (5, 16)])
def test_nearest_is_exact(spark, monkeypatch, pivots, rows):
    """Brute force on clustered points, a third of them identical."""
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", rows)
    rng = np.random.default_rng(0)
    x = np.round(np.concatenate([np.zeros((40, 3)), rng.normal(3, 1, (40, 3)), rng.normal(-4, 1, (40, 3))]), 3)
    df = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id long, x array<double>")
    got = neighbours.nearest(df, "id", "x", 4, pivots=pivots).toPandas().sort_values(["id", "rank"])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = [np.lexsort((np.arange(len(x)), d[i]))[:4].tolist() for i in range(len(x))]
    assert got.groupby("id")["neighbour"].apply(list).tolist() == want


def test_bands_find_nine_of_ten_neighbours(spark):
    """Leaves of at most 128 of 3,000 clustered points in 12 dimensions, a tenth of them one point, against brute force."""
    rng = np.random.default_rng(5)
    x = np.concatenate([np.zeros((300, 12)), *[rng.normal(rng.normal(0, 3, 12), 1, (270, 12)) for _ in range(10)]])
    df = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id long, x array<double>")
    got = neighbours.nearest_by_bands(df, "id", "x", 5, probe=F.col("id") % 3 == 0, bands=24, leaf_rows=128).toPandas()
    assert (got["id"] % 3 == 0).all()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.testing.assert_allclose(got["distance"], d[got["id"], got["neighbour"]], atol=1e-9)
    np.fill_diagonal(d, np.inf)
    radius = np.sort(d, axis=1)[:, 4]  # identical points: any of them is as near
    probes = np.arange(0, len(x), 3)
    hits = (got["distance"].to_numpy() <= radius[got["id"]] + 1e-9).sum()
    assert hits / (5 * len(probes)) >= 0.9
    whole = neighbours.nearest_by_bands(df, "id", "x", 3).toPandas().sort_values(["id", "rank"])
    exact = neighbours.nearest(df, "id", "x", 3).toPandas().sort_values(["id", "rank"])
    assert whole["neighbour"].tolist() == exact["neighbour"].tolist()  # one leaf


def test_bands_of_small_and_empty_tables(spark):
    empty = spark.createDataFrame([], "id long, x array<double>")
    assert neighbours.nearest_by_bands(empty, "id", "x").count() == 0
    assert neighbours.nearest_by_bands(spark.createDataFrame([(1, [0.0])], "id long, x array<double>"), "id", "x").count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(600)], "id long, x array<double>")
    near = neighbours.nearest_by_bands(same, "id", "x", 2, leaf_rows=50)
    assert near.groupBy("id").count().filter("count = 2").count() == 600 and near.filter("distance > 0").count() == 0


@pytest.mark.parametrize("search", [neighbours.nearest, neighbours.nearest_by_bands])
def test_tomek_links_against_brute_force(spark, search):
    rng = np.random.default_rng(8)
    x, y = rng.normal(0, 1, (300, 2)), (rng.random(300) < 0.3).astype(int)
    df = spark.createDataFrame([(i, int(c), [float(a) for a in r]) for i, (r, c) in enumerate(zip(x, y))], "id long, y int, x array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    first = d.argmin(axis=1)
    want = sorted((i, int(j)) for i, j in enumerate(first) if first[j] == i and y[i] != y[j] and i < j)
    assert sorted(map(tuple, neighbours.tomek_links(df, "y", "id", "x", search).collect())) == want


def test_smote_tomek_keeps_rows_without_links(spark):
    rows = [(i, int(i < 5), [float(i < 5) * 100 + i * 0.01]) for i in range(40)]
    out = neighbours.smote_tomek(spark.createDataFrame(rows, "id long, y int, x array<double>"), "y", "id", "x")
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {0: 35, 1: 35}


def test_smote_balances_between_neighbours(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(i < 12), [float(a) for a in rng.normal(5 if i < 12 else 0, 1, 2)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, y int, x array<double>")
    out = neighbours.smote(df, "y", "id", "x")
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {0: 48, 1: 48}
    small = np.array([r[2] for r in rows if r[1] == 1])
    made = np.array([r["x"] for r in out.filter("synthetic").collect()])
    assert (made >= small.min(0) - 1e-9).all() and (made <= small.max(0) + 1e-9).all()
    first = sorted(map(tuple, made.tolist()))
    assert first == sorted(tuple(r["x"]) for r in neighbours.smote(df, "y", "id", "x").filter("synthetic").collect())


def test_tomek_links_are_mutual(spark):
    df = spark.createDataFrame([(1, 0, [0.0]), (2, 1, [0.1]), (3, 0, [5.0]), (4, 0, [5.1]), (5, 1, [9.0])], "id long, y int, x array<double>")
    assert [tuple(r) for r in neighbours.tomek_links(df, "y", "id", "x").collect()] == [(1, 2)]


def test_prepare_unknown_levels_and_empty_columns(spark, tmp_path):
    df = spark.createDataFrame([(1.0, None, "a"), (3.0, None, "a"), (None, None, "b"), (100.0, None, None)], "n double, empty double, c string")
    fitted = pipeline.preprocessor(["n", "empty"], ["c"]).fit(df)
    assert pipeline.encoded_names(fitted) == ["n", "empty", "c_a", "c_b"]
    new = spark.createDataFrame([(None, 5.0, "zzz")], "n double, empty double, c string")
    vec = pipeline.encode(fitted, new).first()["features"].toArray()
    assert vec[1] == 0.0 and vec[2:].tolist() == [0.0, 0.0]
    assert fitted.stages[0].constants()["n"][0] == 3.0 and "empty" in fitted.stages[0].constant_columns()
    fitted.write().overwrite().save(str(tmp_path / "m"))
    from pyspark.ml import PipelineModel
    again = PipelineModel.load(str(tmp_path / "m"))
    assert (pipeline.encode(again, new).first()["features"].toArray() == vec).all()


def test_encoding_is_one_projection_with_the_stages_values(spark, monkeypatch):
    rows = [(1.5, 2.0, "b", "\uffee"), (None, 2.0, None, "\U0001f600"), (-7.25, 2.0, "A", None), (30.0, None, "a", "\uffee"), (0.1, 2.0, "b", "x"), (0.2, 2.0, "c", "x")]
    df = spark.createDataFrame(rows, "n double, same double, c string, d string")
    fitted = pipeline.preprocessor(["n", "same"], ["c", "d"]).fit(df)
    assert pipeline.encoded_names(fitted) == ["n", "same", "c_A", "c_a", "c_b", "c_c", "d_x", "d_\uffee", "d_\U0001f600"]
    # the learned levels are those that MLlib finds in the prepared rows
    found = StringIndexer(inputCols=["c", "d"], outputCols=["i", "j"], handleInvalid="keep", stringOrderType="alphabetAsc").fit(fitted.stages[0].transform(df))
    assert [list(x) for x in found.labelsArray] == [list(x) for x in fitted.stages[4].labelsArray]
    new = spark.createDataFrame([*rows, (None, None, None, None), (9e9, -9e9, "new", "X")], df.schema)
    want, got = fitted.transform(new).select("n", "same", "c", "d", "features"), pipeline.encode(fitted, new)
    plain = lambda t: [(*r[:4], r["features"].toArray().tolist()) for r in t.collect()]
    assert got.columns == want.columns and plain(got) == plain(want)
    assert got.schema["features"].metadata == want.schema["features"].metadata != {}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("UDF(") == 1
    monkeypatch.setattr(pipeline, "WIDE", 0)
    assert plain(pipeline.encode(fitted, new)) == plain(want)


def test_model_ranks_and_calibrates(spark):
    df = spark.range(2000).select("id", (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("n"), F.lit("a").alias("c"))
    df = df.withColumn("Default", (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 1000.0 < F.col("n") * 0.8).cast("int"))
    prep = pipeline.preprocessor(["n"], ["c"]).fit(df)
    enc = pipeline.class_weights(pipeline.encode(prep, df)).withColumn("position", F.pmod(F.xxhash64("id", F.lit(9)), F.lit(4294967296))).persist()
    c = pipeline.candidates()[0]
    model, summary = pipeline.search(enc, c, folds=3, draws=2)
    assert summary["cv_roc_auc_mean"] > 0.6
    cal = pipeline.fit_calibrator(model.transform(enc).select("Default", pipeline.raw_probability().alias("p")))
    from lendframe.functions.scoring import Cutoffs
    scored = pipeline.RiskModel(prep, model, Cutoffs(0.1, 0.6), cal).score(df)
    r = scored.agg(F.avg("probability"), F.avg("Default"), F.max("risk_score")).first()
    assert r[0] == pytest.approx(r[1], abs=0.02) and r[2] <= 100
    assert pipeline.batch_summary(scored).first()["mean_risk_score"] > 0
    enc.unpersist()


# ---- the training job ------------------------------------------------------------------

@pytest.fixture(scope="module")
def applicants(spark):
    n = F.col("id")
    return spark.range(1200).select(
        n.alias("row"), ((n * 7919) % 97).cast("double").alias("a"), F.when(n % 9 != 0, ((n * 31) % 13).cast("double")).alias("b"),
        F.when(n % 3 == 0, "x").when(n % 7 != 0, "y").alias("c"), (((n * 7919) % 97 + (n * 104729) % 60) > 110).cast("int").alias("bad"))


def test_training_stores_a_model_that_scores_the_same(spark, applicants, tmp_path):
    from lendframe.learn import training
    cs = [c for c in pipeline.candidates("bad") if c.name != "boosted_trees"]
    cs[1].estimator.setNumTrees(5).setMaxDepth(3)
    done = training.train(applicants, cs, "bad", "row", ["a", "b"], ["c"], draws=0)
    assert {s["candidate"] for s in done.validation} == {"logistic_regression", "random_forest"}
    assert done.champion == max(done.validation, key=lambda s: s["roc_auc"])["candidate"] and done.reference.count() <= training.REFERENCE_ROWS
    training.save(done, str(tmp_path))
    stored = training.load(spark, str(tmp_path))
    columns = ["row", "probability", "risk_score", "risk_level", "confidence"]
    want = [tuple(r) for r in done.model.score(applicants).select(*columns).orderBy("row").collect()]
    got = stored.score(applicants, factors=2)
    assert [tuple(r) for r in got.select(*columns).orderBy("row").collect()] == want and len(want) == 1200
    assert all(len(r["factors"]) == 2 for r in got.select("factors").take(5))
    same = {r["feature"]: r["psi"] for r in stored.drift(stored.reference).collect()}
    assert set(same) == {"a", "b", "c"} and all(x < 0.02 for x in same.values())
    moved = {r["feature"]: r["psi"] for r in stored.drift(applicants.withColumn("a", F.col("a") + 60)).collect()}
    assert moved["a"] > 1
    both = training.compare_on(done.test, {"v1": stored, "v2": stored}, "bad").collect()
    assert len(both) == 2 and both[0]["roc_auc"] == both[1]["roc_auc"] > 0.6


@pytest.mark.parametrize("strategy", ["class_weight", "none", "undersample", "smote", "smote_tomek"])
def test_imbalance_strategies_feed_training(spark, applicants, strategy):
    from lendframe.learn import training
    done = training.train(applicants, pipeline.candidates("bad")[:1], "bad", "row", ["a", "b"], ["c"], strategy=strategy, draws=0)
    assert done.validation[0]["roc_auc"] > 0.6


def test_unknown_strategy_and_missing_outcome(spark, applicants):
    from lendframe.learn import training
    with pytest.raises(ValueError, match="unknown imbalance strategy"):
        training.balanced(applicants, "oversample", "bad", "row")
    with pytest.raises(ValueError, match="no outcome column"):
        training.train(applicants.drop("bad"), [], "bad", "row")


def test_deep_pages_go_on_behind_the_last_row(spark):
    from lendframe.operators import portfolio
    df = spark.range(95).select((F.col("id") % 10).alias("t"), F.col("id"))
    seen, last = [], None
    while rows := portfolio.page_after(df, ["t", "id"], last, 20).collect():
        seen += [(r["t"], r["id"]) for r in rows]
        last = seen[-1]
    assert seen == sorted(((i % 10, i) for i in range(95)), reverse=True)


def test_digest_sees_swapped_nulls_and_large_ids_have_positions(spark):
    from lendframe.functions.ordered import hash_position
    one, two = spark.createDataFrame([("x", None)], "a string, b string"), spark.createDataFrame([(None, "x")], "a string, b string")
    assert readers.table_digest(one).first() != readers.table_digest(two).first()
    ids = [5, 4_000_000_000, 2**62 + 12345, -7]
    got = {r["i"]: r["p"] for r in spark.createDataFrame([(i,) for i in ids], "i long").select("i", hash_position("i").alias("p")).collect()}
    assert got == {i: i * 2654435761 % 2**32 for i in ids}


def test_csv_files_of_a_folder_share_their_header(spark, tmp_path):
    from pyspark.sql import types as T
    (tmp_path / "t.csv").mkdir()
    (tmp_path / "t.csv" / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "t.csv" / "b.csv").write_text("y,x\n3,4\n")
    with pytest.raises(Exception, match="header|CSV"):
        readers.read_csv(spark, str(tmp_path / "t.csv"), [("x", T.LongType()), ("y", T.LongType())]).collect()


def test_numbers_are_scaled_by_the_population_deviation(spark, applicants):
    fitted = pipeline.preprocessor(["a"], ["c"]).fit(applicants)
    x = np.array([r["features"].toArray()[0] for r in pipeline.encode(fitted, applicants).select("features").collect()])
    assert abs(x.mean()) < 1e-9 and abs((x ** 2).mean() - 1) < 1e-9


def test_search_folds_are_even_within_a_split(spark, monkeypatch):
    """The training split is a range of positions; its folds are not, with a sample or without."""
    class Seen(Exception):
        pass

    def fit(self, df):
        raise Seen({r["_fold"]: r["count"] for r in df.groupBy("_fold").count().collect()})

    monkeypatch.setattr(pipeline.CrossValidator, "_fit", fit)
    rows = spark.range(3000).selectExpr("pmod(xxhash64(id), 4294967296) AS position", "CAST(id % 2 AS int) AS Default").filter(f"position > {0.3 * 2 ** 32}")
    for sample in (None, 0.6):
        with pytest.raises(Seen) as seen:
            pipeline.search(rows, pipeline.candidates()[0], sample=sample)
        counts = seen.value.args[0]
        assert set(counts) == set(range(5)) and max(counts.values()) < 1.5 * min(counts.values())


# ---- versions and batches ---------------------------------------------------------------

def test_a_batch_is_in_the_log_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "period string, n_observations long")
    path = str(tmp_path / "history")
    for batch in ("1", "1", "2"):
        stores.append_json(rows, path, batch)
    assert readers.read_lines(spark, path, readers.HISTORY_SCHEMA).count() == 4
    log = str(tmp_path / "log")
    scored = spark.range(3).select(F.col("id").alias("application_id"), F.lit(0.5).alias("probability"))
    for batch, day in (("x", "2024-01-01"), ("x", "2024-01-01"), ("y", "2024-01-01"), ("z", "2024-01-02"), ("z", "2024-01-02")):
        stores.append_predictions(stores.prediction_rows(scored, "v1", now=F.lit(day + " 10:00:00").cast("timestamp")), log, batch)
    assert stores.read_predictions(spark, log).count() == 9 and stores.read_predictions(spark, log, since="2024-01-02").count() == 3


def test_log_files_are_small(spark, tmp_path, monkeypatch):
    """Compressed, and in files of bounded rows, since a task reads a compressed file alone; older plain files are read beside them."""
    monkeypatch.setattr(stores, "FILE_ROWS", 1000)
    rows = stores.prediction_rows(spark.range(0, 4000, 1, 1).select(F.col("id").alias("application_id"), (F.col("id") / 4000).alias("probability")),
                                  "v1", now=F.lit("2024-01-01 10:00:00").cast("timestamp"))
    path, plain = str(tmp_path / "log"), rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
    for _ in range(2):
        stores.append_predictions(rows, path, batch="1")
    files = [f for f in (tmp_path / "log").rglob("part-*")]
    assert len(files) == 4 and sum(f.stat().st_size for f in files) < plain.agg(F.sum(F.length("value"))).first()[0] / 5
    plain.withColumn("date", F.lit("2024-01-01").cast("date")).withColumn("batch", F.lit("0")).write.mode("append").partitionBy("date", "batch").text(path)
    got = readers.flat_predictions(stores.read_predictions(spark, path))
    assert got.count() == 8000 and got.agg(F.sum("probability")).first()[0] == pytest.approx(2 * sum(range(4000)) / 4000)


def test_training_leaves_only_its_rows_and_counts(spark, applicants, tmp_path, monkeypatch):
    """The encoded rows and scores of a training are removed when the model stands."""
    from lendframe import session
    from lendframe.learn import training

    monkeypatch.setattr(session, "shared_base", lambda spark: str(tmp_path))
    done = training.train(applicants, pipeline.candidates("bad")[:1], "bad", "row", ["a", "b"], ["c"], draws=0)
    left = [set(spark.read.parquet(str(d / "rows")).columns) for d in tmp_path.iterdir()]
    assert left and not any("features" in x or "p" in x for x in left) and any("position" in x for x in left)
    assert done.test.count() > 0 and done.reference.count() > 0


def test_retraining_promotes_only_a_better_version(spark, tmp_path):
    from lendframe.learn import training

    u = lambda k: F.pmod(F.xxhash64("row", F.lit(k)), F.lit(1000)) / F.lit(1000.0)
    rows = spark.range(900).select(F.col("id").alias("row")).select("row", u(1).alias("a"), u(2).alias("b"), F.lit("k").alias("c"),
                                                                   (u(3) < u(1)).cast("int").alias("bad")).cache()
    noise = rows.withColumn("bad", (u(5) < 0.5).cast("int"))
    root = str(tmp_path)
    lr = pipeline.candidates("bad")[:1]
    given = dict(target="bad", id_col="row", numeric=["a", "b"], categorical=["c"], draws=0, holdout=rows)
    one = training.retraining_run(noise, lr, root, "v1", "1", **given).first()
    assert one["promoted"] and one["champion_version"] is None
    two = training.retraining_run(rows, lr, root, "v2", "2", **given).first()
    assert two["promoted"] and two["champion_version"] == "v1" and two["challenger_auc"] > 0.7 > two["champion_auc"] and "beats champion" in two["reason"]
    three = training.retraining_run(rows, lr, root, "v3", "3", **given).first()
    assert not three["promoted"] and "stays active" in three["reason"]
    active = lambda: training.active_bundle(spark, root).score(rows).agg(F.avg("probability")).first()[0]
    best = training.load(spark, root + "/bundles/v2").score(rows).agg(F.avg("probability")).first()[0]
    assert active() == best
    assert stores.rollback(spark, root, now="4") == "v1" and active() != best


def test_drift_and_background_come_from_all_training_rows(spark, applicants, tmp_path, monkeypatch):
    """However few rows are stored as examples: the PSI is that against the whole split, the background its mean."""
    from lendframe.learn import preprocess, training
    from lendframe.operators import drift

    monkeypatch.setattr(training, "REFERENCE_ROWS", 7)
    done = training.train(applicants, pipeline.candidates("bad")[:1], "bad", "row", ["a", "b"], ["c"], draws=0)
    training.save(done, str(tmp_path))
    stored, current = training.load(spark, str(tmp_path)), applicants.withColumn("a", F.col("a") * 1.2)
    placed = applicants.withColumn("position", training.hash_position("row", 42))
    rows = preprocess.stratified_split(placed, "bad", "row", position="position").filter("split = 'train'")
    psi = lambda df: {r["feature"]: r["psi_raw"] for r in df.collect()}
    want = psi(drift.psi_rows(rows, current, drift.fit_edges(rows, ["a", "b"]), ["c"]))
    assert stored.reference.count() == 7 and psi(stored.drift(current)) == pytest.approx(want) and want["a"] > 0.01
    assert psi(stored.drift(current.drop("b"))) == pytest.approx({k: x for k, x in want.items() if k != "b"})
    assert stored.model.background == pytest.approx(pipeline.background_mean(pipeline.encode(done.model.prepare, rows)), abs=1e-9)


def test_stored_models_are_ranked_by_written_scores(spark, applicants, monkeypatch):
    """A filter or a group by a score that is still an expression repeats the whole model in the plan."""
    from lendframe.learn import search, training

    done = training.train(applicants, pipeline.candidates("bad")[:1], "bad", "row", ["a", "b"], ["c"], draws=0)
    bundle, seen, ranked = training.Bundle(done.model, {}, done.reference, done.counts), [], training.metrics.rank_metrics
    monkeypatch.setattr(training.metrics, "rank_metrics", lambda df, *rest: seen.append(df) or ranked(df, *rest))
    got = {r["version"]: r["roc_auc"] for r in training.compare_on(applicants, {"v1": bundle, "v2": bundle}, "bad").collect()}
    assert "UDF" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
    y, p = np.array([(r["bad"], r["probability"]) for r in done.model.score(applicants).select("bad", "probability").collect()]).T
    assert got == {"v1": pytest.approx(search.auc(y, p)), "v2": pytest.approx(search.auc(y, p))}


def test_state_takes_rows_not_a_frame_per_key():
    from datetime import datetime

    from pyspark.sql import Row

    class State:
        value = None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    at = lambda day: datetime(2024, 1, day)
    told = lambda batch, n, first, last: Row(fingerprint="f", n=n, first=first, last=Row(id=batch, ts=last, Income=None, LoanAmount=2.0), batch=batch)
    seen = jobs.LastSubmission("10 days")
    seen.state = State()
    rows = [told(1, 2, at(5), at(6)), told(0, 3, None, at(2)), told(2, 1, at(30), at(30))]
    out = list(seen.handleInputRows(("f",), iter(rows), None))
    assert [(r.batch, r.before, r.last and r.last.id) for r in out] == [(0, 0, None), (1, 3, 0), (2, 0, None)]
    assert seen.state.value == (1, 2, at(30), None, 2.0, 2)
    assert list(seen.handleInputRows(("f",), iter(rows[:1]), None)) == []  # told before
