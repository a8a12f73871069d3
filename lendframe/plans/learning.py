"""Queries that fit and apply models, bound to the driver's tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as v
from ..functions.ordered import hash_position
from ..session import compiled, computed, cut_lineage
from ..learn import neighbours, pipeline, search, training
from ..learn.preprocess import stratified_split
from ..operators import explain, fairness, features, fraud, metrics, quality
from . import bindings as b
from .queries import query, rounded

NUMERIC = [c for c in v.NUMERIC + v.DERIVED_NUMERIC]
CATEGORICAL = v.ALL_CATEGORICAL


def _frame(spark, sf) -> DataFrame:
    """Feature rows with an outcome that depends on them (a stand-in for defaults)."""
    a = features.derived(quality.repair(b.applications(spark, sf)))
    risk = (F.lit(0.5) * (F.lit(850.0) - F.col("CreditScore")) / F.lit(550.0)
            + F.lit(0.3) * F.least(F.coalesce(F.col("LoanToIncomeRatio"), F.lit(0.0)) / F.lit(20.0), F.lit(1.0)))
    noise = hash_position("application_id", 7).cast("double") / F.lit(4294967296.0)
    return (a.withColumn("Default", (risk > noise * F.lit(1.2)).cast("int"))
            .withColumn("position", hash_position("application_id", 42))
            .select("application_id", "applicant_id", "position", "Default", "segment", *NUMERIC, *CATEGORICAL))


def _split(spark, sf) -> DataFrame:
    """The frame, written once, with its split: every fit below reads it several times."""
    base = cut_lineage(pipeline.parallel(_frame(spark, sf)))
    return stratified_split(base, "Default", "application_id", position="position")


def _part(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col("split") == name).drop("split")


def train(spark, sf, candidate: str, **params) -> tuple[pipeline.RiskModel, DataFrame]:
    """Prepare, fit, calibrate and tune on train and validation; returns model and test rows."""
    with compiled(spark):
        held = _split(spark, sf)
        fit_rows = _part(held, "train")
        prepared = pipeline.preprocessor(NUMERIC, CATEGORICAL).fit(fit_rows)
        enc = cut_lineage(pipeline.class_weights(pipeline.encode(prepared, fit_rows)).select("features", "Default", "weight"))
        est = {c.name: c for c in pipeline.candidates()}[candidate].estimator
        model = est.copy({est.getParam(k): x for k, x in params.items()}).fit(enc)
        val = cut_lineage(model.transform(pipeline.encode(prepared, _part(held, "val"))).select(
            "Default", pipeline.raw_probability().alias("p")))
        calibrator = pipeline.fit_calibrator(val)
        cut = metrics.fit_cutoffs(pipeline.calibrate(calibrator, val), "Default", "p")
        return pipeline.RiskModel(prepared, model, cut, calibrator, pipeline.background_mean(enc)), _part(held, "test")


def _score(spark, sf, candidate: str, **params) -> DataFrame:
    model, test = train(spark, sf, candidate, **params)
    return computed(model.score(test).select("application_id", "Default", "probability", "risk_score", "risk_level", "confidence"))


@query
def fit_score_logistic(spark, sf):
    return _score(spark, sf, "logistic_regression", maxIter=20)


@query
def fit_score_forest(spark, sf):
    return _score(spark, sf, "random_forest", numTrees=20, maxDepth=6)


@query
def fit_score_boosted(spark, sf):
    return _score(spark, sf, "boosted_trees", maxIter=8, maxDepth=4)


@query
def search_candidates(spark, sf):
    """All candidates with their own draws, ranges, trees and rounds in five folds; the best cross-validated one is the champion.

    Every fit is a task; a third of the draws stays after each round, with three times the rows and trees. The
    search reads ``search.ROWS`` rows at most; ``training.train`` refits its choice on the whole split.
    """
    held = training.split(_frame(spark, sf), "Default", "application_id", NUMERIC, CATEGORICAL)
    found = search.search_all(held.fit_rows, pipeline.candidates(), "Default")
    names = ("candidate", "best_params", "cv_roc_auc_mean", "cv_roc_auc_std", "n_folds", "fits")
    rows = [tuple(json.dumps(s[n]) if n == "best_params" else s[n] for n in names) for s in found]
    table = spark.createDataFrame(rows, "candidate string, best_params string, cv_roc_auc_mean double, cv_roc_auc_std double, n_folds int, fits int")
    best = pipeline.choose_champion(table.withColumnRenamed("cv_roc_auc_mean", "roc_auc")).select("champion").scalar()
    base = table.filter("candidate = 'logistic_regression'").select("cv_roc_auc_mean").scalar()
    return table.withColumns({"champion": F.col("candidate") == best, "lift_over_baseline": F.col("cv_roc_auc_mean") - base})


@query
def evaluation_report(spark, sf):
    """Metrics and risk bands of a fitted model on its test split."""
    model, test = train(spark, sf, "logistic_regression", maxIter=20)
    scored = computed(model.score(test).select("Default", "probability", "risk_level"))
    m = metrics.classification_metrics(scored, "Default", "probability", model.cutoffs.decision)
    bands = metrics.band_table(scored, "risk_level", "Default")
    share = lambda x: bands.filter(F.col("level") == x).select("share").scalar().alias(f"share_{x}")
    return m.select("*", *[share(x) for x in v.RISK_LEVELS])


@query
def training_fairness(spark, sf):
    model, test = train(spark, sf, "logistic_regression", maxIter=20)
    return fairness.fairness_report(computed(model.score(test)), "risk_score", "Default", v.PROTECTED)


@query
def explained_scores(spark, sf):
    """Scored rows with their top factors and sentences."""
    model, test = train(spark, sf, "logistic_regression", maxIter=20)
    names = pipeline.encoded_names(model.prepare)
    scored = fraud.screen(model.score(test)).withColumn("contribs", explain.contributions(
        "features", model.weights(), model.background, explain.source_groups(names)))
    values = {c: F.col(c) for c in NUMERIC + CATEGORICAL}
    full = scored.withColumn("factors", explain.top_factors("contribs", values, 5))
    helping, hurting = explain.helping_and_hurting("contribs")
    return explain.with_narrative(full, fraud=True).select(
        "application_id", "risk_score", "risk_level",
        F.transform("factors", lambda f: f["raw_feature"]).alias("top_features"),
        F.size(helping).alias("n_helping"), F.size(hurting).alias("n_hurting"),
        "sentences")


@query
def global_importance(spark, sf):
    """Mean absolute attribution by importances of a forest (approximate for trees)."""
    model, test = train(spark, sf, "random_forest", numTrees=10, maxDepth=5)
    names = pipeline.encoded_names(model.prepare)
    enc = pipeline.encode(model.prepare, test)
    contribs = explain.contributions("features", model.weights(), model.background, explain.source_groups(names))
    return computed(explain.global_importance(enc.withColumn("contribs", contribs), "contribs"))


@query
def isotonic_calibration(spark, sf):
    """Calibrated against raw probability on labelled documents, per raw value."""
    lab = b.labelled(spark, sf)
    calibrator = pipeline.fit_calibrator(lab, "y", "p")
    out = pipeline.calibrate(calibrator, lab.withColumn("raw", F.col("p")))
    return rounded(out.groupBy("raw").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("calibrated")), "raw", "calibrated")


def _vectors(spark, sf) -> DataFrame:
    return b.table(spark, sf, "embeddings").select("vec_id", "embedding", (F.col("label") == 3).cast("int").alias("y"))


@query
def nearest_neighbours(spark, sf):
    return rounded(neighbours.nearest(_vectors(spark, sf), "vec_id", "embedding", 5), "distance")


@query
def smote(spark, sf):
    out = neighbours.smote(_vectors(spark, sf), "y", "vec_id", "embedding")
    return out.groupBy("y", "synthetic").agg(F.count(F.lit(1)).alias("n"))


@query
def smote_tomek(spark, sf):
    out = neighbours.smote_tomek(_vectors(spark, sf), "y", "vec_id", "embedding")
    return out.groupBy("y", "synthetic").agg(F.count(F.lit(1)).alias("n"))
