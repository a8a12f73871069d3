"""Tables this library writes: snapshots, caches, logs and the model registry."""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocabulary as v
from ..operators import canonical, payload, retrain
from . import readers, registry

VERSION_SCHEMA = ("version string, created_at timestamp, source string, n_rows long, columns array<string>, "
                  "positive_rate double, content_hash string, findings long, errors long")

FILE_ROWS = 100_000  # rows of a log file


def has_table(spark: SparkSession, path: str) -> bool:
    return readers._exists(spark, path.rstrip("/") + "/*")


def load_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    if has_table(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


# ---- derived-table cache --------------------------------------------------------

def _part_paths(spark: SparkSession, source_dir: str, cache_dir: str, kind: str) -> dict[str, str]:
    """Where each part of the canonical table belongs, given the source files as they are."""
    prints = {t: readers.source_fingerprint(spark, readers.table_path(source_dir, t, kind)) for t in readers.SOURCE_COLUMNS}
    return {part: f"{cache_dir.rstrip('/')}/canonical/{part}-" + hashlib.sha256("_".join(prints[t] for t in needed).encode()).hexdigest()[:24]
            for part, (needed, _) in canonical.PARTS.items()}


def cache_state(spark: SparkSession, source_dir: str, cache_dir: str, kind: str = "csv") -> DataFrame:
    """(part, fresh): which parts the cache holds for the source files as they are; the others will be rebuilt."""
    paths = _part_paths(spark, source_dir, cache_dir, kind)
    return spark.createDataFrame([(p, readers._exists(spark, f"{at}/_SUCCESS")) for p, at in paths.items()], "part string, fresh boolean")


def cached_canonical(spark: SparkSession, source_dir: str, cache_dir: str, kind: str = "csv",
                     use_cache: bool = True) -> DataFrame:
    """The canonical table; what is made of a source table is made again only when a file of that table changed.

    Every part (the applications, each satellite aggregated per person) and every build is a folder named by
    the digest of the files it comes from (name, size, modification time), and counts when its write has
    ended. So a half-written or outdated folder is never read, readers of an old build are not disturbed, and a
    changed satellite costs its own aggregation and the join.
    """
    tables = readers.read_sources(spark, source_dir, kind)
    paths = _part_paths(spark, source_dir, cache_dir, kind)
    done = lambda path: use_cache and readers._exists(spark, path + "/_SUCCESS")
    target = f"{cache_dir.rstrip('/')}/canonical/build-{hashlib.sha256('_'.join(paths.values()).encode()).hexdigest()[:24]}"
    if not done(target):
        for part, (needed, build) in canonical.PARTS.items():
            if not done(paths[part]):
                build(*[tables[t] for t in needed]).write.mode("overwrite").parquet(paths[part])
        canonical.assembled({part: spark.read.parquet(path) for part, path in paths.items()}).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


# ---- versioned snapshots --------------------------------------------------------

def save_snapshot(df: DataFrame, root: str, version: str, source: str, now: Column | None = None,
                  report: DataFrame | None = None, target: str = v.TARGET) -> None:
    """Write one immutable dataset version and append its metadata row.

    The data goes first; a version without a metadata row does not exist for readers,
    so a failed write leaves nothing half-visible. A version is written once.
    """
    spark = df.sparkSession
    data, meta = f"{root}/data/version={version}", f"{root}/versions"
    df.write.mode("errorifexists").parquet(data)
    stored = spark.read.parquet(data)
    rate = F.avg(F.col(target).cast("double")) if target in df.columns else F.lit(None).cast("double")
    counted = (F.sum("n"), F.sum(F.when(F.col("severity") == "error", F.col("n"))))
    found, errors = (report.agg(F.coalesce(c, F.lit(0)).cast("long")).scalar() if report is not None
                     else F.lit(0).cast("long") for c in counted)
    stored.agg(F.count(F.lit(1)).alias("n_rows"), rate.alias("positive_rate"),
               readers.content_hash(stored).cast("string").alias("content_hash")).select(
        F.lit(version).alias("version"), (now if now is not None else F.current_timestamp()).alias("created_at"),
        F.lit(source).alias("source"), "n_rows", F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
        "positive_rate", "content_hash", found.alias("findings"), errors.alias("errors"),
    ).coalesce(1).write.mode("append").parquet(meta)


def list_versions(spark: SparkSession, root: str) -> DataFrame:
    return load_or_empty(spark, f"{root}/versions", VERSION_SCHEMA).orderBy(F.desc("created_at"), F.desc("version"))


def read_snapshot(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """One version (the newest by default); the path is the partition, so nothing else is listed."""
    known = list_versions(spark, root)
    row = (known if version is None else known.filter(F.col("version") == version)).select("version").first()
    if row is None:
        raise FileNotFoundError(f"no such dataset version: {version or '(none saved)'}")
    return spark.read.parquet(f"{root}/data/version={row['version']}")


# ---- append-only logs -----------------------------------------------------------

def prediction_rows(scored: DataFrame, version: str, event: str = "predict", now: Column | None = None,
                    latency: Column | None = None) -> DataFrame:
    """Scored rows as prediction-log records."""
    rec = F.struct(*[(F.col(c) if c in scored.columns else F.lit(None)).cast(
        "double" if c in v.NUMERIC_BOUNDS else "string").alias(c) for c in v.BASE])
    get = lambda c, t: (F.col(c) if c in scored.columns else F.lit(None)).cast(t)
    return scored.select(
        (now if now is not None else F.current_timestamp()).alias("timestamp"), F.lit(event).alias("event"),
        F.lit(version).alias("model_version"), (latency if latency is not None else F.lit(None)).cast("double").alias("latency_ms"),
        F.struct(get("application_id", "string").alias("applicationId"), rec.alias("normalized")).alias("request"),
        F.struct(get("risk_score", "double").alias("riskScore"), get("risk_level", "string").alias("riskLevel"),
                 get("probability", "double").alias("probability"), get("fraud_flag", "boolean").alias("fraudFlag")).alias("response"))


def _append(rows: DataFrame, path: str, keys: list[str], batch: str | None) -> None:
    """Append JSON lines; rows of a named batch replace what an earlier run of that batch wrote, and nothing else.

    The files are gzipped: the names in every line are most of its text, and a batch that replaces another needs room
    for both. A gzipped file is read by one task, so ``FILE_ROWS`` bounds it.
    """
    if batch is not None:
        rows, keys = rows.withColumn("batch", F.lit(batch)), [*keys, "batch"]
    out = rows.write.mode("append") if batch is None else rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (out.partitionBy(*keys) if keys else out).option("compression", "gzip").option("maxRecordsPerFile", FILE_ROWS).json(path)


def append_predictions(rows: DataFrame, path: str, batch: str | None = None) -> None:
    """Append to the JSON log, partitioned by day so that a tail read prunes by date.

    With ``batch`` (a name that a rerun repeats) each batch is in the log once, however often it is written;
    a log is written either with batches or without.
    """
    _append(rows.withColumn("date", F.to_date("timestamp")), path, ["date"], batch)


def read_predictions(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """The prediction log; ``since`` (a date) prunes whole partitions."""
    lines = spark.read.text(path)
    if since:
        lines = lines.filter(F.col("date") >= F.lit(since).cast("date"))
    parsed = readers.parse_lines(lines, readers.PREDICTION_SCHEMA)
    return parsed.filter(F.col("_bad").isNull()).drop("_bad", "date", "batch")


def outcome_rows(applications: DataFrame, defaulted: str, id_col: str, now: Column | None = None) -> DataFrame:
    """Realised outcomes with the normalised record and the application's id."""
    norm = payload.normalise(applications, [id_col, defaulted])
    return norm.select((now if now is not None else F.current_timestamp()).alias("recorded_at"),
                       F.col(id_col).cast("string").alias("application_id"), *v.BASE,
                       F.col(defaulted).cast("boolean").cast("int").alias(v.TARGET))


def append_json(rows: DataFrame, path: str, batch: str | None = None) -> None:
    """Append outcome or performance-history rows; with ``batch``, once however often that batch is written."""
    _append(rows, path, [], batch)


# ---- model registry -------------------------------------------------------------

def register(spark: SparkSession, root: str, version: str, metadata: dict) -> None:
    """Append a version's registry row; what the version consists of was written before."""
    row = {f.name: metadata.get(f.name) for f in registry.REGISTRY_SCHEMA.fields} | {"version": version}
    spark.createDataFrame([tuple(row[f.name] for f in registry.REGISTRY_SCHEMA.fields)], registry.REGISTRY_SCHEMA) \
        .write.mode("append").parquet(f"{root}/registry")


def save_model(spark: SparkSession, root: str, version: str, model, metadata: dict, activate: bool = True,
               now: str | None = None) -> None:
    """Store a fitted pipeline under its version and append the registry row; then,
    if asked, activate it."""
    model.write().save(f"{root}/models/{version}")
    register(spark, root, version, metadata)
    if activate:
        set_active(spark, root, version, now)


def registry_tables(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return (load_or_empty(spark, f"{root}/registry", registry.REGISTRY_SCHEMA),
            load_or_empty(spark, f"{root}/activations", registry.ACTIVATION_SCHEMA))


def set_active(spark: SparkSession, root: str, version: str, now: str | None = None) -> None:
    """Append an activation; activating the active version again writes nothing."""
    known, log = registry_tables(spark, root)
    if known.filter(F.col("version") == version).limit(1).count() == 0:
        raise FileNotFoundError(f"cannot activate '{version}': not registered")
    current = registry.active_pointer(log).first()
    if current is not None and current["active_version"] == version:
        return
    at = now or dt.datetime.now(dt.timezone.utc).isoformat()
    spark.createDataFrame([(version, at)], registry.ACTIVATION_SCHEMA).write.mode("append").parquet(f"{root}/activations")


def rollback(spark: SparkSession, root: str, now: str | None = None) -> str:
    known, log = registry_tables(spark, root)
    target = registry.rollback_target(known, log).first()
    if target is None:
        raise RuntimeError("no previous version to roll back to")
    set_active(spark, root, target["version"], now)
    return target["version"]


def promote_if_better(spark: SparkSession, root: str, challenger: str, now: str | None = None) -> dict:
    """Compare a challenger with the active version and activate it when it wins. A
    losing challenger changes nothing, so the rollback target stays."""
    known, log = registry_tables(spark, root)
    active = registry.active_pointer(log).first()
    row = retrain.compare_versions(known, challenger, active["active_version"] if active else None).first()
    if row is None:
        raise FileNotFoundError(f"no metadata for challenger '{challenger}'")
    if row["promoted"]:
        set_active(spark, root, challenger, now)
    return row.asDict()


def load_model(spark: SparkSession, root: str, version: str | None = None):
    from pyspark.ml import PipelineModel
    if version is None:
        active = registry.active_pointer(registry_tables(spark, root)[1]).first()
        if active is None:
            raise FileNotFoundError("no active model")
        version = active["active_version"]
    return PipelineModel.load(f"{root}/models/{version}")
