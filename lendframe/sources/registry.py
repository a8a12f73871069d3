"""Model registry and activation log as tables.

Both tables are append-only. What is active follows from the log, so an activation or
a rollback is one more row and no file is ever rewritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import values_of

REGISTRY_SCHEMA = T.StructType([
    T.StructField("version", T.StringType(), False),
    T.StructField("created_at", T.StringType()),
    T.StructField("algorithm", T.StringType()),
    T.StructField("dataset_version", T.StringType()),
    T.StructField("dataset_rows", T.LongType()),
    T.StructField("feature_count", T.IntegerType()),
    T.StructField("roc_auc", T.DoubleType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("thresholds", T.MapType(T.StringType(), T.DoubleType())),
])
ACTIVATION_SCHEMA = T.StructType([
    T.StructField("version", T.StringType(), False),
    T.StructField("activated_at", T.StringType(), False),
])


def active_pointer(activations: DataFrame) -> DataFrame:
    """One row (active_version, previous_version, activated_at); empty before the first
    activation. Activating the active version again changes nothing, so ``previous`` is
    the last different one. The log has one row per activation: small by nature."""
    w = W.orderBy("activated_at")
    changes = (activations.withColumn("_before", F.lag("version").over(w))
               .filter(F.col("_before").isNull() | (F.col("_before") != F.col("version"))))
    pointed = changes.withColumn("previous_version", F.lag("version").over(w))
    return pointed.orderBy(F.desc("activated_at")).limit(1).select(
        F.col("version").alias("active_version"), "previous_version", "activated_at")


def versions_view(registry: DataFrame, activations: DataFrame) -> DataFrame:
    """Registry rows, newest first, with the active and the previous one marked."""
    p = active_pointer(activations)
    now = values_of(p, "active_version", "previous_version")
    same = lambda c: F.coalesce(F.col("version") == now[c], F.lit(False))
    return registry.withColumns({"is_active": same("active_version"), "is_previous": same("previous_version")}
                                ).orderBy(F.desc("version"))


def prunable(registry: DataFrame, activations: DataFrame, keep: int = 5) -> DataFrame:
    """Versions beyond the newest ``keep`` that are neither active nor previous."""
    p = active_pointer(activations)
    protected = p.select(F.explode(F.array_compact(F.array("active_version", "previous_version"))).alias("version"))
    ranked = registry.select("version", F.row_number().over(W.orderBy(F.desc("version"))).alias("rn"))
    return ranked.filter(F.col("rn") > keep).join(protected, "version", "left_anti").select("version")


def rollback_target(registry: DataFrame, activations: DataFrame) -> DataFrame:
    """The row to append for a rollback: empty when there is no previous version or it
    is no longer registered."""
    p = active_pointer(activations).select(F.col("previous_version").alias("version")).filter("version is not null")
    return p.join(registry.select("version"), "version", "left_semi")
