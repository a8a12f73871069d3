"""Imputation, winsorising, encoding, splitting and resampling."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import hash_order_cuts, hash_position
from ..session import cut_lineage


def levels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column that has rows its levels, the most frequent one (ties go to the smallest) and the rows without any."""
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("level")) for c in columns])))
    counts = long.groupBy("feature", "level").agg(F.count(F.lit(1)).alias("n"))
    # a handful of levels per feature by now
    there = F.when(F.col("level").isNotNull(), F.struct(-F.col("n"), F.col("level")))
    return counts.groupBy("feature").agg(F.min_by("level", there).alias("mode"), F.collect_set("level").alias("levels"),
                                         F.coalesce(F.sum(F.when(F.col("level").isNull(), F.col("n"))), F.lit(0)).alias("missing"))


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent level per column; ties go to the smallest."""
    return levels(df, columns).filter(F.size("levels") > 0).select("feature", "mode")


def _with_position(df: DataFrame, id_col: str, seed: int, position: str | None) -> tuple[DataFrame, str]:
    if position:
        return df, position
    return df.withColumn("_pos", hash_position(id_col, seed)), "_pos"


def _within(cuts: DataFrame, name: str, position: str, id_col: str) -> Column:
    return F.coalesce(F.struct(F.col(position), F.col(id_col)) <= F.struct(
        F.col(f"{name}._u"), F.col(f"{name}._id")), F.lit(False))


def stratified_split(df: DataFrame, target: str, id_col: str, test: float = 0.15, val: float = 0.15,
                     seed: int = 42, position: str | None = None) -> DataFrame:
    """Adds ``split`` (train, val, test) with exact shares in every class.

    Rows are ordered by a hash of their id, so the split is reproducible and survives
    re-runs and lost executors. Only the cut points per class are computed, once; the table
    itself is neither shuffled nor written.
    """
    df, pos = _with_position(df, id_col, seed, position)
    n = F.col("n").cast("double")
    cuts = cut_lineage(hash_order_cuts(df, target, pos, id_col, {
        "test_cut": F.ceil(n * F.lit(test)), "val_cut": F.ceil(n * F.lit(test)) + F.ceil(n * F.lit(val))}))
    # one row per class
    out = df.join(F.broadcast(cuts), target, "left")
    split = F.when(_within(cuts, "test_cut", pos, id_col), "test").when(
        _within(cuts, "val_cut", pos, id_col), "val").otherwise("train")
    return out.withColumn("split", split).drop("test_cut", "val_cut", "_pos")


def undersample(df: DataFrame, target: str, id_col: str, seed: int = 42,
                position: str | None = None) -> DataFrame:
    """Every class cut down to the size of the smallest, in hash order."""
    df, pos = _with_position(df, id_col, seed, position)
    cuts = hash_order_cuts(df, target, pos, id_col, {"cut": F.col("smallest")})
    return (df.join(F.broadcast(cuts), target)
            .filter(_within(cuts, "cut", pos, id_col)).drop("cut", "_pos"))


def fold_column(position: str, k: int = 5) -> Column:
    """Fold number 0..k-1 from the hash position: equal shares per class up to chance."""
    return F.floor(F.col(position) * F.lit(float(k)) / F.lit(4294967296.0)).cast("int")


def sample_by_hash(df: DataFrame, id_col: str, fraction: float, seed: int = 42) -> DataFrame:
    """A deterministic share of the rows, stratified by construction, without a shuffle."""
    return df.filter(hash_position(id_col, seed) < F.lit(math.floor(fraction * 4294967296)))
