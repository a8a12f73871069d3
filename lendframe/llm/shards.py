"""Sharding by a two-pass external shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructField, StructType

from ..session import cut_lineage

BUCKET_BYTES = 32 << 20
LEAST_BUCKETS = 64


def _content(field: StructField) -> Column:
    """Bytes of a column beyond a fixed width: of text and binary, and of nested values as JSON."""
    at = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (ArrayType, MapType, StructType)):
        at = F.to_json(F.struct(at))
    elif not isinstance(field.dataType, (StringType, BinaryType)):
        return F.lit(0)
    return F.coalesce(F.octet_length(at), F.lit(0)).cast("long")


def shuffled_shards(records: DataFrame, shards: int = 8, seed: int = 17, bytes_col: str | None = None,
                    bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All records in one random order, cut into ``shards`` shards whose counts differ by at most one.

    Pass one scatters the records over buckets by a seeded hash of their place in the input and
    writes them; the number of buckets follows the bytes, so a bucket fits in memory whatever
    its records hold. Pass two gathers one bucket at a time, brings it into a fixed order and
    applies Fisher-Yates (``shuffle``). The buckets in sequence are the new order; position
    ``g`` of ``n`` goes to shard ``g * shards div n``.

    Adds ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard) to the columns. Any
    column may be null, rows may repeat, fewer rows than shards leave shards empty, an empty
    table stays empty. ``bytes_col`` names a size per record if its text is among the columns.
    Columns named ``shard`` or ``slot`` are replaced.
    """
    kept = [c for c in records.columns if c not in ("shard", "slot")]
    content = [F.coalesce(F.col(bytes_col), F.lit(0))] if bytes_col else [_content(records.schema[c]) for c in kept]
    rest = sum(content, F.lit(16 * len(kept)))
    placed = cut_lineage(records.select(F.struct(*[F.col(c) for c in kept]).alias("_record"),
                                        F.monotonically_increasing_id().alias("_place"), rest.cast("long").alias("_bytes")))
    n, total = placed.agg(F.count(F.lit(1)), F.coalesce(F.sum("_bytes"), F.lit(0))).first()
    buckets = max(LEAST_BUCKETS, -(-total // bucket_bytes))
    scattered = placed.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), "_place"), F.lit(buckets)).cast("int"))
    # One row per bucket: their number is the bytes over ``bucket_bytes``.
    before = scattered.groupBy("_bucket").count().select(
        "_bucket", (F.sum("count").over(Window.orderBy("_bucket")) - F.col("count")).alias("_before"))
    # A task gathers one bucket, and the bucket's start travels with its records.
    rows = scattered.select("_bucket", F.struct("_place", "_record").alias("_row"), F.lit(None).cast("long").alias("_before"))
    starts = before.select("_bucket", F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), "_before")
    gathered = (rows.unionAll(starts).repartitionById(buckets, "_bucket").groupBy("_bucket")
                .agg(F.max("_before").alias("_before"), F.sort_array(F.collect_list("_row")).alias("_rows")))
    mixed = gathered.select("_before", F.shuffle("_rows", F.lit(seed)).alias("_rows"))
    at = F.col("_before") + F.col("_at")
    ordered = mixed.select("_before", F.posexplode("_rows").alias("_at", "_row"))
    shard = F.expr(f"(_before + _at) * {shards} div {max(n, 1)}")
    return ordered.select("_row._record.*", shard.cast("int").alias("shard"),
                          (at - F.expr(f"({shards - 1} + {n} * ((_before + _at) * {shards} div {max(n, 1)})) div {shards}"))
                          .alias("slot"))


def write_shards(records: DataFrame, path: str, shards: int = 8, seed: int = 17, bytes_col: str | None = None) -> None:
    """The shards as folders ``shard=k`` below ``path``, each part file in slot order."""
    out = shuffled_shards(records, shards, seed, bytes_col)
    parts = F.col("slot").cast("double") / F.lit(1e6)
    (out.repartition("shard", F.floor(parts)).sortWithinPartitions("shard", "slot")
     .write.mode("errorifexists").partitionBy("shard").parquet(path))
