"""Model fitting, calibration, selection and batch scoring on MLlib."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import ElementwiseProduct, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.tuning import CrossValidator
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as v
from ..functions import scoring
from ..functions.expr import clip, half_even
from ..functions.ordered import hash_position, quantile_constants
from .preprocess import fold_column, levels, sample_by_hash


# ---- column preparation -----------------------------------------------------------

class _Constants(Params):
    """Per-column constants kept as a JSON-friendly dict, so that the stage can be saved."""

    table = Param(Params._dummy(), "table", "fitted constants per column")

    def constants(self) -> dict:
        import json
        return json.loads(self.getOrDefault(self.table))

    def _put(self, values: Mapping[str, object]):
        import json
        self._set(table=json.dumps(values))
        return self


class Prepare(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Median imputation and winsorising of numbers, mode imputation of levels.

    One quantile pass serves medians and clipping bounds of all numeric columns, one
    aggregation serves all modes. An all-missing numeric column is kept, filled with 0.
    """

    numeric = Param(Params._dummy(), "numeric", "numeric columns", TypeConverters.toListString)
    categorical = Param(Params._dummy(), "categorical", "text columns", TypeConverters.toListString)
    low = Param(Params._dummy(), "low", "lower clipping percentile", TypeConverters.toFloat)
    high = Param(Params._dummy(), "high", "upper clipping percentile", TypeConverters.toFloat)

    def __init__(self, numeric: Sequence[str] = (), categorical: Sequence[str] = (),
                 low: float = 0.005, high: float = 0.995):
        super().__init__()
        self._set(numeric=list(numeric), categorical=list(categorical), low=low, high=high)

    def _fit(self, df: DataFrame) -> PrepareModel:
        return self.fit_counted(df)[0]

    def fit_counted(self, df: DataFrame) -> tuple[PrepareModel, dict[str, list[str]], int | None]:
        """The model, for each text column the levels that it has once prepared, and the rows (None without numeric columns)."""
        nums, cats = self.getOrDefault(self.numeric), self.getOrDefault(self.categorical)
        low, high = self.getOrDefault(self.low), self.getOrDefault(self.high)
        fitted: dict[str, object] = {}
        rows = None
        if nums:
            fitted |= {c: [q[1] if q[1] is not None else 0.0, q[0], q[2]]
                       for c, q in quantile_constants(df, nums, [low, 0.5, high]).items()}
            # Imputation comes before clipping: a column with missing values has its
            # bounds taken again with the median filled in.
            present = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.nullif(F.col(c).cast("double"), F.lit(float("nan")))).alias(c)
                               for c in nums]).first()
            rows = present["_rows"]
            holes = [c for c in nums if present[c] < rows]
            if holes:
                filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(fitted[c][0])).alias(c) for c in holes])
                for c, (lo, hi) in quantile_constants(filled, holes, [low, high]).items():
                    fitted[c] = [fitted[c][0], lo, hi]
        kept: dict[str, list[str]] = {c: [] for c in cats}
        if cats:
            found = {r["feature"]: r for r in levels(df, cats).collect()}  # one row per column
            for c in cats:
                row = found.get(c)
                fitted[c] = (row and row["mode"]) or "unknown"
                kept[c] = list(set(row["levels"]) | ({fitted[c]} if row["missing"] else set())) if row else []
        return PrepareModel()._put(fitted), kept, rows


class PrepareModel(Model, _Constants, DefaultParamsReadable, DefaultParamsWritable):
    def _transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, k in self.constants().items():
            if isinstance(k, list):
                value = F.coalesce(F.col(c).cast("double"), F.lit(float(k[0])))
                lo, hi = (k[1] if k[1] is not None else k[0]), (k[2] if k[2] is not None else k[0])
                out[c] = clip(value, lo, hi)
            else:
                out[c] = F.coalesce(F.col(c).cast("string"), F.lit(k))
        return df.withColumns(out)

    def constant_columns(self) -> list[str]:
        """Numeric columns without spread in training; their values carry nothing."""
        return [c for c, k in self.constants().items() if isinstance(k, list) and k[1] == k[2]]


class Preprocessor(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Impute -> clip -> standardise numbers; impute -> one-hot levels; one vector.

    The levels come from the count that gives the modes, without another pass for the indexer. Deviations are
    those of the population: the scaler's sample ones times sqrt(n / (n - 1)).
    """

    numeric, categorical = Prepare.numeric, Prepare.categorical
    output = Param(Params._dummy(), "output", "name of the vector", TypeConverters.toString)

    def __init__(self, numeric: Sequence[str] = (), categorical: Sequence[str] = (), output: str = "features"):
        super().__init__()
        self._set(numeric=list(numeric), categorical=list(categorical), output=output)

    def _fit(self, df: DataFrame) -> PipelineModel:
        nums, cats = self.getOrDefault(self.numeric), self.getOrDefault(self.categorical)
        prepare, found, n = Prepare(nums, cats).fit_counted(df)
        ready = prepare.transform(df)
        scaler = StandardScaler(inputCol="_num", outputCol="_scaled", withMean=True, withStd=True).fit(
            ready.select(array_to_vector(F.array(*nums)).alias("_num")))
        factor = math.sqrt(n / (n - 1)) if n > 1 else 1.0
        most = max([len(found[c]) for c in cats], default=0)
        few = [tuple(found[c][min(i, len(found[c]) - 1)] if found[c] else None for c in cats) for i in range(most)]  # each level at least once
        index = StringIndexer(inputCols=cats, outputCols=[f"_i_{c}" for c in cats], handleInvalid="keep", stringOrderType="alphabetAsc").fit(
            df.sparkSession.createDataFrame(few, ", ".join(f"`{c}` string" for c in cats)))
        hot = OneHotEncoder(inputCols=[f"_i_{c}" for c in cats], outputCols=[f"_h_{c}" for c in cats],
                            handleInvalid="error", dropLast=True).fit(index.transform(ready))
        return PipelineModel(stages=[
            prepare, VectorAssembler(inputCols=nums, outputCol="_num"), scaler,
            ElementwiseProduct(scalingVec=Vectors.dense([factor] * len(nums)), inputCol="_scaled", outputCol="_standard"), index, hot,
            VectorAssembler(inputCols=["_standard", *[f"_h_{c}" for c in cats]], outputCol=self.getOrDefault(self.output))])


def preprocessor(numeric: Sequence[str] = tuple(v.ALL_NUMERIC),
                 categorical: Sequence[str] = tuple(v.ALL_CATEGORICAL), output: str = "features") -> Preprocessor:
    """Impute -> clip -> standardise numbers; impute -> one-hot levels; one vector.

    A level unknown at fit time becomes the zero vector.
    """
    return Preprocessor(numeric, categorical, output)


def encoded_names(fitted: PipelineModel) -> list[str]:
    """Names of the encoded columns: numeric names, then ``<column>_<level>``."""
    numeric = fitted.stages[1].getInputCols()
    indexer = fitted.stages[4]
    return list(numeric) + [f"{c}_{level}" for c, levels in zip(indexer.getInputCols(), indexer.labelsArray)
                            for level in levels]


WIDE = 512  # encoded columns up to which a vector is written out column by column


def encode(fitted: PipelineModel, df: DataFrame, output: str = "features") -> DataFrame:
    """The prepared columns and their vector.

    The stages' constants become one projection with the stages' own arithmetic; a chain of transformers would build
    and take apart a vector per stage and row. Vectors wider than ``WIDE`` (texts with many levels) are left to the transformers.
    """
    prepare, assemble, scaler, product, index, _, last = fitted.stages
    if len(encoded_names(fitted)) > WIDE:
        out = fitted.transform(df)
        return out.drop(*[c for c in out.columns if c.startswith(("_i_", "_h_")) or c in ("_num", "_scaled", "_standard")])
    nums, cats = assemble.getInputCols(), index.getInputCols()
    scaled = [(F.col(c) - F.lit(float(m))) * F.lit(1.0 / float(d) if d else 0.0) * F.lit(float(f))
              for c, m, d, f in zip(nums, scaler.mean, scaler.std, product.getScalingVec())]
    hot = [(F.col(c) == F.lit(x)).cast("double") for c, labels in zip(cats, index.labelsArray) for x in labels]
    one = df.sparkSession.range(1).select(*[F.lit(0.0).alias(c) for c in nums], *[F.lit("").alias(c) for c in cats])
    kinds = fitted.transform(one).schema[last.getOutputCol()].metadata  # tells trees which columns are levels
    return prepare.transform(df).withColumn(last.getOutputCol(), array_to_vector(F.array(*scaled, *hot)).alias(last.getOutputCol(), metadata=kinds))


def class_weights(df: DataFrame, target: str = v.TARGET, name: str = "weight") -> DataFrame:
    """Balanced weights n / (2 * n_class): both classes weigh the same in total."""
    r = df.agg(F.count_if(F.col(target) == 1).alias("p"), F.count(target).alias("n")).first()
    p, n = r["p"], r["n"]
    w1, w0 = (n / (2 * p) if p else 1.0), (n / (2 * (n - p)) if n > p else 1.0)
    return df.withColumn(name, F.when(F.col(target) == 1, w1).otherwise(F.lit(w0)))


def parallel(df: DataFrame) -> DataFrame:
    """Even partitions for a table that iterative fits pass over many times; AQE chooses
    their number from the data's size and the cores."""
    return df.hint("rebalance")


# ---- candidates and search ----------------------------------------------------------

@dataclass
class Candidate:
    name: str
    estimator: object
    draws: int
    space: dict = field(default_factory=dict)  # param -> sampler(rng)
    baseline: bool = False


def candidates(target: str = v.TARGET, weight: str | None = "weight", seed: int = 42) -> list[Candidate]:
    """Logistic regression as the benchmark, random forest and boosted trees."""
    common = dict(labelCol=target, featuresCol="features")
    if weight:
        common["weightCol"] = weight
    log_u = lambda lo, hi: lambda r: float(math.exp(r.uniform(math.log(lo), math.log(hi))))
    whole = lambda lo, hi: lambda r: int(r.integers(lo, hi))
    lr = LogisticRegression(maxIter=2000, **common)
    rf = RandomForestClassifier(seed=seed, **common)
    gbt = GBTClassifier(seed=seed, **common)
    return [
        Candidate("logistic_regression", lr, 8, {lr.regParam: log_u(1e-6, 1e-1)}, baseline=True),
        Candidate("random_forest", rf, 12, {
            rf.numTrees: whole(200, 500), rf.maxDepth: whole(6, 20), rf.minInstancesPerNode: whole(10, 120)}),
        Candidate("boosted_trees", gbt, 25, {
            gbt.maxIter: whole(250, 700), gbt.maxDepth: whole(3, 9), gbt.stepSize: log_u(0.01, 0.25),
            gbt.subsamplingRate: lambda r: float(r.uniform(0.6, 1.0)), gbt.minInstancesPerNode: whole(1, 40)}),
    ]


def random_maps(c: Candidate, draws: int | None = None, seed: int = 42) -> list[dict]:
    rng = np.random.default_rng(seed)
    return [{p: draw(rng) for p, draw in c.space.items()} for _ in range(draws or c.draws)]


def search(train: DataFrame, c: Candidate, target: str = v.TARGET, position: str = "position",
           folds: int = 5, draws: int | None = None, sample: float | None = None, parallelism: int = 2,
           seed: int = 42) -> tuple[Model, dict]:
    """Randomised search by cross-validated AUC, then a refit on the whole training set.

    Folds come from a hash of the position; ``sample`` restricts the search (not the refit)
    to a deterministic share of every class. Cache ``train`` first: each fold of each
    draw reads it.
    """
    data = sample_by_hash(train, position, sample, seed) if sample else train
    # Hashed anew: the training split is a range of positions, and the sample a range of another hash.
    data = data.withColumn("_at", hash_position(position, seed + 1)).withColumn("_fold", fold_column("_at", folds)).drop("_at")
    evaluator = BinaryClassificationEvaluator(labelCol=target, rawPredictionCol="rawPrediction",
                                              metricName="areaUnderROC")
    maps = random_maps(c, draws, seed)
    cv = CrossValidator(estimator=c.estimator, estimatorParamMaps=maps, evaluator=evaluator, numFolds=folds,
                        foldCol="_fold", parallelism=parallelism, seed=seed)
    fitted = cv.fit(data)
    best = int(np.argmax(fitted.avgMetrics))
    model = c.estimator.copy(maps[best]).fit(train) if sample else fitted.bestModel
    summary = {"candidate": c.name, "best_params": {p.name: x for p, x in maps[best].items()},
               "cv_roc_auc_mean": float(fitted.avgMetrics[best]),
               "cv_roc_auc_std": float(fitted.stdMetrics[best]), "n_folds": folds}
    return model, summary


# ---- calibration --------------------------------------------------------------------

def raw_probability(column: str = "probability") -> Column:
    """Probability of the positive class from MLlib's probability vector."""
    return F.element_at(vector_to_array(F.col(column)), 2)


def fit_calibrator(validation: DataFrame, target: str = v.TARGET, p: str = "p"):
    """Isotonic map from raw to calibrated probability, fitted on the validation rows."""
    return IsotonicRegression(labelCol=target, featuresCol=p, predictionCol="calibrated").fit(
        validation.select(F.col(p).cast("double").alias(p), F.col(target).cast("double").alias(target)))


def calibrate(calibrator, scored: DataFrame, p: str = "p") -> DataFrame:
    """Replace p by its calibrated value. The fitted step function is a short table of
    boundaries, applied by MLlib's own transformer."""
    out = calibrator.transform(scored)
    return out.withColumn(p, clip("calibrated", 0.0, 1.0)).drop("calibrated")


def choose_champion(validation_metrics: DataFrame, baseline: str = "logistic_regression") -> DataFrame:
    """Best validation AUC with its lift over the baseline (rows: candidate, roc_auc)."""
    base = validation_metrics.filter(F.col("candidate") == baseline).agg(F.max("roc_auc")).scalar()
    return validation_metrics.agg(
        F.max_by("candidate", F.struct("roc_auc", "candidate")).alias("champion"), F.max("roc_auc").alias("roc_auc")
    ).withColumn("lift_over_baseline", F.col("roc_auc") - base)


# ---- scoring ------------------------------------------------------------------------

@dataclass
class RiskModel:
    """Everything needed to score a feature frame."""

    prepare: PipelineModel
    classifier: Model
    cutoffs: scoring.Cutoffs
    calibrator: object | None = None
    background: list[float] | None = None

    def score(self, features: DataFrame) -> DataFrame:
        """Adds probability, risk_score, risk_level, confidence; keeps ``features`` vector.

        One plan of JVM expressions: MLlib transformers and column arithmetic.
        """
        keep = features.columns
        encoded = encode(self.prepare, features)
        out = (self.classifier.transform(encoded).withColumn("p", raw_probability())
               .drop("probability", "rawPrediction", "prediction"))
        if self.calibrator is not None:
            out = calibrate(self.calibrator, out)
        p = F.col("p")
        staged = out.withColumn("_score", scoring.risk_score(p, self.cutoffs))
        # the level follows the unrounded score
        return staged.select(
            *keep, "features", half_even(p, 6).alias("probability"), half_even("_score", 2).alias("risk_score"),
            scoring.risk_level("_score").alias("risk_level"),
            half_even(scoring.confidence(p, self.cutoffs), 4).alias("confidence"))

    def weights(self) -> list[float]:
        """Coefficients of a linear model, importances of a tree model."""
        if hasattr(self.classifier, "coefficients"):
            return [float(x) for x in self.classifier.coefficients.toArray()]
        return [float(x) for x in self.classifier.featureImportances.toArray()]

    def is_linear(self) -> bool:
        return hasattr(self.classifier, "coefficients")


def background_mean(encoded: DataFrame, features: str = "features") -> list[float]:
    """Mean of the encoded vectors: a distributed summary, one vector comes back."""
    from pyspark.ml.stat import Summarizer
    return [float(x) for x in encoded.select(Summarizer.mean(F.col(features))).first()[0].toArray()]


def first_rows(df: DataFrame, position: str, n: int) -> DataFrame:
    """The first n rows in hash order, stored with the model as examples (a top-n)."""
    return df.orderBy(position).limit(n)


def batch_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(
        half_even(F.avg("risk_score"), 2).alias("mean_risk_score"),
        *[F.count_if(F.col("risk_level") == x).alias(x) for x in v.RISK_LEVELS])
