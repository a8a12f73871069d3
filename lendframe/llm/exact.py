"""Exact deduplication by a tree merge of digest runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

FAN_IN = 32
KEY = ["_digest", "_check", "_bytes"]


def digest_runs(docs: DataFrame, id_col: str, text_col: str, keep: str) -> DataFrame:
    """One light row per document: identifier, digest with its two checks, and the run (input partition).

    ``_ident`` orders the rows of a group: by id, then by place in the input, so that of
    repeated rows exactly one stays. A null id loses against every other.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    place = F.monotonically_increasing_id()
    known = F.col(id_col).isNotNull() if keep == "max" else F.col(id_col).isNull()
    return docs.select(
        F.col(id_col).alias("_id"), F.unhex(F.sha2(text, 256)).alias("_digest"), F.xxhash64(text).alias("_check"),
        F.octet_length(text).alias("_bytes"), F.spark_partition_id().alias("_run"), place.alias("_place"),
        F.struct(known.alias("known"), F.col(id_col).alias("id"), place.alias("place")).alias("_ident"))


def merge_level(rows: DataFrame, ident: str, count: Column, best) -> DataFrame:
    """Merge the runs of one exchange: equal (digest, check, bytes) of a run become one row."""
    return rows.groupBy(*KEY, "_run").agg(best(ident).alias("_ident"), F.sum(count).alias("_n"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max",
                     fan_in: int = FAN_IN) -> DataFrame:
    """Which document stays of each group of equal texts.

    Every input partition is a run of digests. In each round ``fan_in`` neighbouring runs are
    exchanged and merged; equal digests keep their smallest (``keep="min"``) or largest
    (``"max"``) identifier and their number. A merge is verified at every level: rows meet
    only if SHA-256, a second hash and the byte length agree. After the last round the
    winners go down the same tree, so a group that holds a third of all rows has at most
    ``fan_in`` rows of a level in one place, and at the leaves one run's rows.

    Rows out: ``_id, keep_id, group_size, kept, digest`` (binary), one per row in. Null text
    is the empty text. Null ids stay only where a group has no other. Of repeated rows one is
    kept. An empty table gives no rows. Other columns are not read.
    """
    if keep not in ("max", "min"):
        raise ValueError("keep is 'max' or 'min'")
    best = F.max if keep == "max" else F.min
    leaves = cut_lineage(digest_runs(docs, id_col, text_col, keep))
    runs = leaves.agg(F.max("_run")).first()[0]
    levels = [merge_level(leaves, "_ident", F.lit(1), best)]
    width, shift = (runs or 0) + 1, 1
    while width > 1:
        shift, width = shift * fan_in, -(-width // fan_in)
        up = levels[-1].withColumn("_run", F.expr(f"_run div {fan_in}").cast("int"))
        levels.append(merge_level(up, "_ident", F.col("_n"), best))
    # Downwards only the groups with copies travel; whoever meets none stays as it is.
    winners = levels[-1].filter("_n > 1").select(*KEY, "_run", F.col("_ident").alias("_keep"), F.col("_n").alias("_size"))
    for level in reversed(levels[:-1]):
        own = level.select(*KEY, F.col("_run").alias("_own"), F.expr(f"_run div {fan_in}").cast("int").alias("_run"))
        winners = own.join(winners, [*KEY, "_run"]).select(*KEY, F.col("_own").alias("_run"), "_keep", "_size")
    joined = leaves.join(winners, [*KEY, "_run"], "left")
    return joined.select(
        "_id", F.coalesce(F.col("_keep.id"), F.when(F.col("_keep").isNull(), F.col("_id"))).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("_keep.place") == F.col("_place"), F.lit(True)).alias("kept"), F.col("_digest").alias("digest"))
