"""Line deduplication by the number of distinct sites a line appears on."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .rows import pack, unpack

MIN_SITES = 5
COPY_SHARE = 0.5
LG_K = 12


def line_hash(line: Column) -> Column:
    return F.unhex(F.md5(line))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """Hashes of the lines on at least ``min_sites`` sites; ``lines`` has ``hash`` and ``site``.

    A line counts once per site from the start, so a very common line is a few rows. Lines of one
    site are left out first (smallest and largest site are equal). For the others
    HyperLogLog sketches merge by aggregation. Four standard errors round the limit, one site at
    least, an estimate decides nothing: those lines, and only those, are counted exactly.
    """
    lines = lines.select("hash", "site").distinct()
    several = lines.groupBy("hash").agg(F.min("site").alias("lo"), F.max("site").alias("hi")).filter("lo <> hi").select("hash")
    sketches = (lines.join(several, "hash", "left_semi").groupBy("hash").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("s"))
                .select("hash", F.hll_sketch_estimate("s").alias("sites")))
    band = max(1, math.ceil(4 * 1.04 / math.sqrt(2 ** lg_k) * min_sites))
    judged = cut_lineage(sketches.filter(F.col("sites") >= min_sites - band))
    sure = judged.filter(F.col("sites") > min_sites + band).select("hash")
    near = judged.filter(F.col("sites") <= min_sites + band).select("hash")
    exact = (lines.join(near, "hash", "left_semi").groupBy("hash").agg(F.count_distinct("site").alias("sites"))
             .filter(F.col("sites") >= min_sites).select("hash"))
    return sure.unionAll(exact)


def without_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                        min_sites: int = MIN_SITES, copy_share: float = COPY_SHARE, lg_k: int = LG_K) -> DataFrame:
    """Documents without the lines that appear on ``min_sites`` or more sites.

    A line is what stands between line breaks, without spaces round it; blank lines are never
    removed. A document of which more than ``copy_share`` of the characters stand in such lines
    is a copy, not a carrier of boilerplate: it stays whole, for document deduplication to judge.

    Adds ``n_lines`` (not blank), ``n_spread`` (of these, spread), ``n_removed`` and ``is_copy``; the
    text is replaced. Null text gives null text and no lines; a null site is a site of its own; rows
    that share an id are judged each by its own text; an empty table stays empty. Columns of those
    names are replaced.
    """
    added = ("n_lines", "n_spread", "n_removed", "is_copy")
    own = [c for c in docs.columns if c not in added or c == text_col]
    carried = [c for c in own if c != text_col]
    docs = docs.select(pack(carried).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"),
                       F.coalesce(F.concat(F.lit("s"), F.col(site_col).cast("string")), F.lit("-")).alias("site"))
    exploded = docs.select("_id", "site", F.explode(_lines(F.col("_text"))).alias("line"))
    lines = exploded.select("_id", "site", F.trim("line").alias("line")).filter("line <> ''").select("_id", "site", line_hash(F.col("line")).alias("hash"))
    spread = cut_lineage(spread_lines(lines.select("hash", "site"), min_sites, lg_k))
    found = lines.join(spread, "hash", "left_semi").groupBy(F.col("_id").alias("_of")).agg(F.collect_set("hash").alias("_spread"))
    joined = docs.join(found, F.col("_id").eqNullSafe(F.col("_of")), "left")
    hit = lambda x: F.array_contains(F.col("_spread"), line_hash(F.trim(x)))
    blank = lambda x: F.trim(x) == ""
    chars = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + F.length(F.trim(x)))
    cut = joined.withColumn("_all", _lines(F.col("_text"))).withColumn(
        "_in", F.when(F.col("_spread").isNull(), F.array().cast("array<string>")).otherwise(
            F.filter("_all", lambda x: ~blank(x) & hit(x))))
    cut = (cut.withColumn("n_lines", F.size(F.filter("_all", lambda x: ~blank(x))).cast("long"))
           .withColumn("n_spread", F.size("_in").cast("long"))
           .withColumn("is_copy", chars(F.col("_in")) > chars(F.col("_all")) * F.lit(copy_share))
           .withColumn("n_removed", F.when(F.col("is_copy"), F.lit(0)).otherwise(F.col("n_spread")).cast("long")))
    text = F.when(F.col("n_removed") == 0, F.col("_text")).otherwise(
        F.array_join(F.filter("_all", lambda x: blank(x) | ~hit(x)), "\n"))
    back = dict(zip(carried, unpack("_row", carried))) | {text_col: text.alias(text_col)}
    return cut.select(*[back[c] for c in own], *added)
