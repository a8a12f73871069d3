"""The training job, its stored result, batch scoring with it and the retraining run."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocabulary as v
from ..functions import scoring
from ..functions.ordered import hash_position
from ..operators import drift, explain, fraud, metrics, retrain
from ..session import compiled, cut_lineage, released
from ..sources import registry, stores
from . import neighbours, pipeline, preprocess, search

STRATEGIES = ("class_weight", "none", "undersample", "smote", "smote_tomek")
REFERENCE_ROWS = 5000  # rows stored to look at; nothing is computed from them


def balanced(encoded: DataFrame, strategy: str, target: str = v.TARGET, id_col: str = v.ID, seed: int = 42) -> DataFrame:
    """Encoded training rows (``features``, target, id) under an imbalance strategy, with ``weight``.

    ``class_weight`` weighs, ``undersample`` drops rows of the majority in hash order, ``smote`` adds
    synthetic rows of the minority, ``smote_tomek`` also removes Tomek links; ``none`` leaves
    the rows alone. Any other name is an error.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown imbalance strategy '{strategy}'; one of {', '.join(STRATEGIES)}")
    if strategy == "class_weight":
        return pipeline.class_weights(encoded, target)
    if strategy == "undersample":
        encoded = preprocess.undersample(encoded, target, id_col, seed)
    elif strategy in ("smote", "smote_tomek"):
        grow = neighbours.smote if strategy == "smote" else neighbours.smote_tomek
        grown = grow(encoded, target, id_col, "features", seed=seed)
        encoded = grown.withColumn("features", array_to_vector("features")).withColumn(
            "position", hash_position(F.coalesce(F.col("id"), F.xxhash64(F.col("features").cast("string"))), seed))
    return encoded.withColumn("weight", F.lit(1.0))


@dataclass
class Trained:
    """A fitted model with all that scoring, drift and explanation later need."""

    model: pipeline.RiskModel
    champion: str
    validation: list[dict]
    edges: dict[str, list[float]]
    numeric: list[str]
    categorical: list[str]
    reference: DataFrame
    test: DataFrame
    counts: DataFrame


@dataclass
class Split:
    """A frame split and prepared once: what every fit reads is written."""

    prepared: PipelineModel
    train: DataFrame
    fit_rows: DataFrame
    val: DataFrame
    test: DataFrame


def split(frame: DataFrame, target: str = v.TARGET, id_col: str = v.ID, numeric: Sequence[str] = tuple(v.ALL_NUMERIC),
          categorical: Sequence[str] = tuple(v.ALL_CATEGORICAL), strategy: str = "class_weight", seed: int = 42) -> Split:
    return prepared_split(held_rows(frame, target, id_col, seed), target, id_col, numeric, categorical, strategy, seed)


def held_rows(frame: DataFrame, target: str = v.TARGET, id_col: str = v.ID, seed: int = 42) -> DataFrame:
    """The frame, written once, with ``position`` and ``split``."""
    if target not in frame.columns:
        raise ValueError(f"no outcome column '{target}'")
    placed = frame.withColumn("position", hash_position(id_col, seed))
    with compiled(frame.sparkSession):
        return preprocess.stratified_split(cut_lineage(pipeline.parallel(placed)), target, id_col, position="position")


def prepared_split(held: DataFrame, target: str, id_col: str, numeric: Sequence[str], categorical: Sequence[str], strategy: str, seed: int) -> Split:
    part = lambda name: held.filter(F.col("split") == name).drop("split")
    with compiled(held.sparkSession):
        rows = part("train")
        prepared = pipeline.preprocessor(numeric, categorical).fit(rows)
        fit_rows = cut_lineage(balanced(pipeline.encode(prepared, rows).select(id_col, "features", target, "position"), strategy, target, id_col, seed))
        return Split(prepared, rows, fit_rows, cut_lineage(pipeline.encode(prepared, part("val")).select(id_col, "features", target)), part("test"))


def train(frame: DataFrame, candidates: Sequence[pipeline.Candidate], target: str = v.TARGET, id_col: str = v.ID,
          numeric: Sequence[str] = tuple(v.ALL_NUMERIC), categorical: Sequence[str] = tuple(v.ALL_CATEGORICAL),
          strategy: str = "class_weight", draws: int | None = None, folds: int = 5, rows: int = search.ROWS,
          seed: int = 42) -> Trained:
    """Split, prepare, search all candidates, refit, take the best on validation, calibrate, tune.

    The search gives every fit a task of its own and reads ``rows`` rows at most; MLlib refits the chosen
    draw of each candidate on the whole training split. ``draws`` bounds the draws per candidate (its own
    number by default); with ``draws=0`` the candidates are fitted as given.
    """
    spark, rows_held = frame.sparkSession, held_rows(frame, target, id_col, seed)
    with released(spark):  # the encoded rows and the scores go when the model stands
        held = prepared_split(rows_held, target, id_col, numeric, categorical, strategy, seed)
        prepared, fit_rows, val = held.prepared, held.fit_rows, held.val
        tuned = {} if draws == 0 else {s["candidate"]: s for s in search.search_all(fit_rows, candidates, target, folds=folds, draws=draws, rows=rows, seed=seed)}
        with compiled(spark):
            fitted, found = {}, []
            for c in candidates:
                summary = tuned.get(c.name, {"candidate": c.name})
                model = search.refit(fit_rows, c, summary) if c.name in tuned else c.estimator.fit(fit_rows)
                scored = cut_lineage(model.transform(val).select(target, pipeline.raw_probability().alias("p")))
                auc = metrics.rank_metrics(scored, target, "p").select("roc_auc").first()[0]
                fitted[c.name] = (model, scored)
                found.append(summary | {"roc_auc": auc})
            champion = max(found, key=lambda s: (s["roc_auc"] if s["roc_auc"] is not None else -1.0, s["candidate"]))["candidate"]
            model, scored = fitted[champion]
            calibrator = pipeline.fit_calibrator(scored, target)
            cut = metrics.fit_cutoffs(pipeline.calibrate(calibrator, scored), target, "p")
            # of every training row: the fit's rows are these unless the strategy adds or drops some
            own = fit_rows if strategy in ("class_weight", "none") else pipeline.encode(prepared, held.train)
            background = pipeline.background_mean(own)
    with compiled(spark):
        edges = drift.fit_edges(held.train, list(numeric))
        counts = cut_lineage(drift.reference_counts(held.train, edges, list(categorical)))
        return Trained(pipeline.RiskModel(prepared, model, cut, calibrator, background), champion, found, edges, list(numeric), list(categorical),
                       pipeline.first_rows(held.train, "position", REFERENCE_ROWS), held.test, counts)


def save(trained: Trained, root: str) -> None:
    """All of it below ``root``; the description goes last, so a half-written model is never read."""
    model, spark = trained.model, trained.reference.sparkSession
    model.prepare.write().save(f"{root}/prepare")
    PipelineModel(stages=[model.classifier]).write().save(f"{root}/classifier")
    model.calibrator.write().save(f"{root}/calibrator")
    trained.reference.write.parquet(f"{root}/reference")
    trained.counts.write.parquet(f"{root}/counts")
    text = json.dumps({"champion": trained.champion, "validation": trained.validation, "edges": trained.edges,
                       "numeric": trained.numeric, "categorical": trained.categorical, "background": model.background,
                       "cutoffs": [model.cutoffs.low, model.cutoffs.high, model.cutoffs.decision]})
    spark.createDataFrame([(text,)], "text string").coalesce(1).write.parquet(f"{root}/description")


@dataclass
class Bundle:
    """A stored model, read back."""

    model: pipeline.RiskModel
    description: dict
    reference: DataFrame
    counts: DataFrame

    def score(self, frame: DataFrame, with_fraud: bool = False, factors: int = 0) -> DataFrame:
        """Every row with its score; fraud verdict and top factors on request. One plan, nothing is collected."""
        out = self.model.score(frame)
        if with_fraud:
            out = fraud.screen(out)
        if factors:
            groups = explain.source_groups(pipeline.encoded_names(self.model.prepare))
            contribs = explain.contributions("features", self.model.weights(), self.model.background, groups)
            values = {c: F.col(c) for c in self.description["numeric"] + self.description["categorical"]}
            out = out.withColumn("contribs", contribs).withColumn("factors", explain.top_factors("contribs", values, factors)).drop("contribs")
        return out.drop("features")

    def drift(self, current: DataFrame) -> DataFrame:
        """PSI of every feature against the stored counts of all training rows, by their edges."""
        edges = {c: e for c, e in self.description["edges"].items() if c in current.columns}
        return drift.psi_counts(self.counts, current, edges, [c for c in self.description["categorical"] if c in current.columns])


def load(spark: SparkSession, root: str) -> Bundle:
    d = json.loads(spark.read.parquet(f"{root}/description").first()["text"])
    low, high, decision = d["cutoffs"]
    model = pipeline.RiskModel(PipelineModel.load(f"{root}/prepare"), PipelineModel.load(f"{root}/classifier").stages[0],
                               scoring.Cutoffs(low=low, high=high, decision=decision), IsotonicRegressionModel.load(f"{root}/calibrator"), d["background"])
    return Bundle(model, d, spark.read.parquet(f"{root}/reference"), spark.read.parquet(f"{root}/counts"))


def compare_on(holdout: DataFrame, bundles: dict[str, Bundle], target: str = v.TARGET) -> DataFrame:
    """``version, roc_auc`` of stored models on one and the same hold-out, as promotion needs it.

    The scores are stored before they are ranked: the ranking filters and groups by them, and the optimizer would
    carry the whole model, some thousand expressions, into every such place and every constraint it infers.
    """
    parts = [b.model.score(holdout).select(F.lit(name).alias("version"), F.col(target).alias("y"), F.col("probability").alias("p"))
             for name, b in bundles.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return metrics.rank_metrics(cut_lineage(every), "y", "p", ["version"]).select("version", "roc_auc")


# ---- versions of whole bundles -----------------------------------------------------

def publish(trained: Trained, root: str, version: str, now: str) -> None:
    """Store a bundle under its version and register it; it isn't active yet. A version is written once."""
    spark = trained.reference.sparkSession
    save(trained, f"{root}/bundles/{version}")
    best = {s["candidate"]: s for s in trained.validation}[trained.champion]
    cut = trained.model.cutoffs
    stores.register(spark, root, version, {
        "created_at": now, "algorithm": trained.champion, "feature_count": len(trained.numeric) + len(trained.categorical), "roc_auc": best["roc_auc"],
        "thresholds": {"low": cut.low, "high": cut.high, "decision": cut.decision}})


def active_bundle(spark: SparkSession, root: str) -> Bundle:
    row = registry.active_pointer(stores.registry_tables(spark, root)[1]).first()
    if row is None:
        raise FileNotFoundError("no active model")
    return load(spark, f"{root}/bundles/{row['active_version']}")


def retraining_run(frame: DataFrame, candidates: Sequence[pipeline.Candidate], root: str, version: str, now: str,
                   holdout: DataFrame | None = None, target: str = v.TARGET, **params) -> DataFrame:
    """Train a challenger, store it without activating it, score it and the active version on one and the same
    hold-out (the challenger's test rows by default), and activate it only if it wins by the required margin.

    One row: both versions with their AUC there, ``promoted`` and ``reason``. Without an active version the challenger becomes it.
    """
    spark = frame.sparkSession
    trained = train(frame, candidates, target, **params)
    publish(trained, root, version, now)
    current = registry.active_pointer(stores.registry_tables(spark, root)[1]).first()
    champion = current["active_version"] if current else None
    rows = holdout if holdout is not None else trained.test
    bundles = {n: load(spark, f"{root}/bundles/{n}") for n in dict.fromkeys([version, champion]) if n}
    with compiled(spark):
        aucs = {r["version"]: r["roc_auc"] for r in compare_on(rows, bundles, target).collect()}  # two rows
    one = spark.createDataFrame([(version, aucs.get(version), champion, aucs.get(champion))],
                                "challenger_version string, challenger_auc double, champion_version string, champion_auc double")
    decided = one.withColumns(retrain.promotion(*[F.col(c) for c in one.columns]))
    done = decided.first()
    if done["promoted"]:
        stores.set_active(spark, root, version, now)
    return spark.createDataFrame([done], decided.schema)
