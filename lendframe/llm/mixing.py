"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .rows import pack, unpack

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
BLOCK_DOCS, MOST_BLOCKS = 256, 1 << 16
CHUNKS = 256
SEPARATORS = "\t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; 0 for null."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SEPARATORS, " " * len(SEPARATORS))
    return F.size(F.array_remove(F.split(spaced, " ", -1), "")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds ``target`` to ``source, source_size``: weights in turn by code point (null last), together
    ``share`` of all sizes, at most ``most`` times a source's size, the excess reshared by weight.

    Resharing until none is above ends where every target is the smaller of its limit and weight
    times one common level. In order of limit per weight, a source stops at its limit if the level
    that the sources before it leave is higher.
    """
    turn = (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights)
    weighed = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    weighed = weighed.withColumn("_limit", F.col("source_size") * F.lit(float(most)))
    every = Window.partitionBy(F.lit(0))
    order = Window.orderBy(F.col("_limit") / F.col("_w"), F.asc_nulls_last("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))
    behind = F.sum("_w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    judged = weighed.withColumn("_stops", F.col("_limit") < left / behind * F.col("_w"))
    free = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum(F.when(F.col("_stops"), F.col("_limit"))).over(every), F.lit(0.0))
    level = free / F.sum(F.when(~F.col("_stops"), F.col("_w"))).over(every)
    target = F.when(F.col("_stops"), F.col("_limit")).otherwise(F.least("_limit", level * F.col("_w")))
    return judged.withColumn("target", F.coalesce(target, F.col("_limit"))).drop("_w", "_limit", "_stops")


def draw(rng: np.random.Generator, quotas: np.ndarray, n: int) -> np.ndarray:
    """How many of each kind are among ``n`` of all, without replacement. Beyond numpy's range (10^9) by the normal limit."""
    out, left = np.zeros_like(quotas), int(quotas.sum())
    for i, q in enumerate(quotas.tolist()):
        left -= q
        if left + q < 1_000_000_000:
            x = int(rng.hypergeometric(q, left, n)) if n else 0
        else:
            p = q / (left + q)
            sd = (n * p * (1 - p) * (left + q - n) / max(left + q - 1, 1)) ** 0.5
            x = int(min(max(round(rng.normal(n * p, sd)), n - left, 0), q, n))
        out[i], n = x, n - x
    return out


def split_tree(rng: np.random.Generator, quotas: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Kinds by shards: halve the shards, draw what the left half gets, go on in both halves. ``sizes`` are the shards' totals."""
    if len(sizes) == 1:
        return quotas[:, None]
    half = len(sizes) // 2
    first = draw(rng, quotas, int(sizes[:half].sum()))
    return np.hstack([split_tree(rng, first, sizes[:half]), split_tree(rng, quotas - first, sizes[half:])])


def even(total: int, shards: int) -> np.ndarray:
    return np.diff(np.arange(shards + 1, dtype=np.int64) * total // shards)


def _tree(shards: int, seed: int, kind: str) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Splits one group: rows (kind, quota) and, below the root, the group's own shard totals."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(kind, na_position="last", ignore_index=True)
        quotas = rows["quota"].to_numpy(dtype=np.int64)
        sizes = np.array(rows["totals"][0], dtype=np.int64) if "totals" in rows else even(int(quotas.sum()), shards)
        rng = np.random.default_rng([seed, zlib.crc32(f"{kind}{key}".encode())])
        return pd.DataFrame({kind: rows[kind], "split": list(split_tree(rng, quotas, sizes))})

    return run


def shard_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """``source, split``: each source's block quota divided among the shards.

    The tree runs over chunks of sources first and then, inside a chunk, over its sources with the
    totals it got, which has the same distribution; no task sees all sources.
    """
    chunked = quotas.withColumn("chunk", F.pmod(F.xxhash64("source"), F.lit(CHUNKS)).cast("int"))
    tops = chunked.groupBy("chunk").agg(F.sum("quota").alias("quota")).withColumn("all", F.lit(0))
    totals = tops.groupBy("all").applyInPandas(_tree(shards, seed, "chunk"), "chunk int, split array<long>").withColumnRenamed("split", "totals")
    return chunked.join(totals, "chunk").groupBy("chunk").applyInPandas(_tree(shards, seed, "source"), "source string, split array<long>")


def planned_mix(docs: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source", shards: int = 8, seed: int = 17,
                weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Every document with the places it takes in the mix.

    Documents of a source are dealt into blocks by a seeded hash of their id (about 256 each, 65,536
    blocks at most), and the blocks permuted by another. A source's blocks are drawn whole as often
    as its target holds all its words, then once more in permuted order while they fit; of the next
    block, single documents fill what is left, the last one only if it brings the sum nearer. The
    number of block draws is the source's quota, which the splitting tree divides among the shards;
    a shard takes the next run of its sources' permuted draws, so no draw is taken twice. All random
    choices are hashes, so reruns agree.

    Adds ``size``, ``source_size``, ``target`` and ``draws``, an array of (shard, position); a shard's order
    is that of ``position``, a seeded hash. Rows with one id are drawn together; null ids count as one
    id; a null source is a source, the last. A source without words has target 0. An empty table
    stays empty. Columns of these names are replaced.
    """
    added = ("size", "source_size", "target", "draws")
    own = [c for c in docs.columns if c not in added]
    rows = docs.select(pack(own).alias("_row"), size.alias("size"), F.col(source_col).cast("string").alias("_s"),
                       F.coalesce(F.concat(F.lit("k"), F.col(id_col).cast("string")), F.lit("-")).alias("_key"))
    # The plan needs sizes only; they are counted once, and the documents are read again where it is applied.
    light = cut_lineage(rows.select("size", "_s", "_key"))
    sums = light.groupBy(F.col("_s").alias("source")).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_n"))
    blocks = F.least(F.lit(MOST_BLOCKS), F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.lit(1), F.col("_n") / BLOCK_DOCS)))))
    sources = cut_lineage(source_targets(sums, weights, share, most).withColumn("_blocks", blocks.cast("long"))
                          .withColumn("_tag", F.xxhash64(F.lit(seed), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-")))))
    sources = sources.withColumnRenamed("source", "_source")
    in_block = F.pmod(F.xxhash64(F.lit(seed), F.lit("block"), "_key"), F.col("_blocks"))
    placed = lambda df: df.join(sources, F.col("_s").eqNullSafe(F.col("_source"))).withColumn("_block", in_block)
    one = ["_tag", "_block"]
    words = placed(light).groupBy("_source", *one, "source_size", "target").agg(F.sum("size").alias("_words"))
    order = Window.partitionBy("_tag").orderBy(F.xxhash64(F.lit(seed), F.lit("order"), *one), "_block")
    ranked = (words.withColumn("_rank", F.row_number().over(order) - 1).withColumn("_sum", F.sum("_words").over(order))
              .withColumn("_of", F.count(F.lit(1)).over(Window.partitionBy("_tag"))))
    rounds = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(most)))).otherwise(0).cast("long")
    ranked = ranked.withColumn("_rounds", rounds).withColumn(
        "_rest", F.when(F.col("_rounds") >= int(most), F.lit(0.0)).otherwise(F.col("target") - F.col("_rounds") * F.col("source_size")))
    ranked = cut_lineage(ranked.withColumn("_full", (F.col("_sum") <= F.col("_rest")) & (F.col("_rest") > 0)).withColumn(
        "_gap", F.when(~F.col("_full") & (F.col("_sum") - F.col("_words") < F.col("_rest")), F.col("_rest") - F.col("_sum") + F.col("_words"))))
    # The block in which a source's target ends: its ids in hash order, taken while they fit.
    edge = (placed(light).join(ranked.filter("_gap IS NOT NULL").select(*one, "_gap"), one)
            .groupBy(*one, "_gap", "_key").agg(F.sum("size").alias("size"))
            .groupBy(*one, "_gap").agg(F.sort_array(F.collect_list(F.struct(
                F.xxhash64(F.lit(seed), F.lit("edge"), "_key").alias("h"), F.col("_key").alias("key"), F.col("size").cast("double").alias("size")))).alias("_ids")))
    start = F.struct(F.col("_gap").alias("left"), F.array().cast("array<string>").alias("taken"))
    fits = lambda a, x: F.when(x["size"] <= a["left"], F.struct((a["left"] - x["size"]).alias("left"), F.concat(a["taken"], F.array(x["key"])).alias("taken"))).otherwise(a)
    edge = edge.withColumn("_fit", F.aggregate("_ids", start, fits))
    over = lambda x: F.struct(F.abs(x["size"] - F.col("_fit.left")).alias("off"), x["key"].alias("key"))
    last = F.array_min(F.transform(F.filter("_ids", lambda x: ~F.array_contains(F.col("_fit.taken"), x["key"])), over))
    edge = edge.withColumn("_last", last).select(*one, F.when(F.col("_last.off") < F.col("_fit.left"), F.concat(
        F.col("_fit.taken"), F.array("_last.key"))).otherwise(F.col("_fit.taken")).alias("_part"))
    plan = ranked.join(edge, one, "left")
    again = F.col("_full") | (F.size(F.coalesce("_part", F.array().cast("array<string>"))) > 0)
    quota = plan.groupBy("_source", "_tag").agg(F.sum(F.col("_rounds") + again.cast("long")).alias("quota"))
    splits = quota.join(shard_quotas(quota.select(F.col("_source").alias("source"), "quota"), shards, seed),
                        F.col("_source").eqNullSafe(F.col("source"))).select("_tag", "split")
    upto = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda k: F.aggregate(F.slice("split", F.lit(1), k), F.lit(0).cast("long"), lambda a, x: a + x))
    drawn = plan.join(splits.withColumn("_upto", upto), "_tag").withColumn("_again", again)
    number = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.lit(int(most)).cast("long")), lambda e: (e < F.col("_rounds")) | ((e == F.col("_rounds")) & F.col("_again"))),
                         lambda e: e * F.col("_of") + F.col("_rank"))
    drawn = drawn.select(*one, "_rounds", "_of", "_part", F.transform(number, lambda d: F.struct(
        F.size(F.filter("_upto", lambda x: x <= d)).alias("shard"), d.alias("draw"))).alias("_draws"))
    joined = placed(rows).join(drawn, one, "left").withColumn("_draws", F.filter("_draws", lambda d: F.col("_part").isNull() | (
        d["draw"] < F.col("_rounds") * F.col("_of")) | F.array_contains("_part", F.col("_key"))))
    place = F.transform("_draws", lambda d: F.struct(d["shard"].alias("shard"), F.xxhash64(F.lit(seed), F.lit("place"), d["draw"], F.col("_key")).alias("position")))
    return joined.select(*unpack("_row", own), "size", "source_size", "target", place.alias("draws"))


def mix(docs: DataFrame, size: Column, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, one row for each draw, with ``shard`` and ``position`` in it."""
    kept = [c for c in docs.columns if c not in ("shard", "position")]
    packed = docs.select(pack(kept).alias("_doc"), size.alias("_words"), *[F.col(c) for c in {options.get("id_col", "doc_id"), options.get("source_col", "source")}])
    drawn = planned_mix(packed, F.col("_words"), **options).select("_doc", F.explode("draws").alias("_draw"))
    return drawn.select(*unpack("_doc", kept), "_draw.shard", "_draw.position")
