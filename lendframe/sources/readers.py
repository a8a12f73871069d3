"""Readers for the source tables, canonical files and JSON-lines logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import vocabulary as v

_L, _I, _D, _S = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()

# table -> (column, type); only these columns are ever read
SOURCE_COLUMNS: dict[str, list[tuple[str, T.DataType]]] = {
    "application": [
        ("SK_ID_CURR", _L), ("TARGET", _I), ("DAYS_BIRTH", _I), ("DAYS_EMPLOYED", _I),
        ("AMT_INCOME_TOTAL", _D), ("AMT_CREDIT", _D), ("AMT_ANNUITY", _D), ("EXT_SOURCE_1", _D),
        ("EXT_SOURCE_2", _D), ("EXT_SOURCE_3", _D), ("NAME_EDUCATION_TYPE", _S), ("NAME_INCOME_TYPE", _S),
        ("NAME_FAMILY_STATUS", _S), ("FLAG_OWN_REALTY", _S), ("CNT_CHILDREN", _I), ("NAME_TYPE_SUITE", _S)],
    "bureau": [
        ("SK_ID_CURR", _L), ("SK_ID_BUREAU", _L), ("CREDIT_ACTIVE", _S), ("CREDIT_DAY_OVERDUE", _I),
        ("DAYS_CREDIT", _I), ("AMT_CREDIT_SUM", _D), ("AMT_CREDIT_SUM_DEBT", _D)],
    "bureau_balance": [("SK_ID_BUREAU", _L), ("STATUS", _S)],
    "previous_application": [("SK_ID_CURR", _L), ("SK_ID_PREV", _L), ("NAME_CONTRACT_STATUS", _S)],
    "installments_payments": [
        ("SK_ID_CURR", _L), ("DAYS_INSTALMENT", _D), ("DAYS_ENTRY_PAYMENT", _D), ("AMT_INSTALMENT", _D),
        ("AMT_PAYMENT", _D)],
    "POS_CASH_balance": [("SK_ID_CURR", _L), ("SK_DPD", _I)],
    "credit_card_balance": [
        ("SK_ID_CURR", _L), ("AMT_BALANCE", _D), ("AMT_CREDIT_LIMIT_ACTUAL", _D), ("SK_DPD", _I)],
}


def no_nan(df: DataFrame) -> DataFrame:
    """NaN means missing in the sources; inside it is NULL everywhere."""
    nan = F.lit(float("nan"))
    fix = {f.name: F.nullif(F.col(f"`{f.name}`"), nan.cast(f.dataType)) for f in df.schema.fields
           if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(fix) if fix else df


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) is not None \
        and len(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)) > 0


def table_path(directory: str, name: str, kind: str) -> str:
    return f"{directory.rstrip('/')}/{name}.{kind}"


def missing_tables(spark: SparkSession, directory: str, kind: str = "csv",
                   required: Sequence[str] = tuple(SOURCE_COLUMNS)) -> list[str]:
    """Required source tables that are not there."""
    return [t for t in required if not _exists(spark, table_path(directory, t, kind))]


def read_csv(spark: SparkSession, path: str, columns: Sequence[tuple[str, T.DataType]]) -> DataFrame:
    """Header CSV with declared columns by name: the file may hold more columns, in any
    order, and only the declared ones are parsed. Files of a folder must share one header;
    one that differs fails the read, since columns go by place."""
    header = spark.read.option("header", True).csv(path).columns  # first line only
    absent = [c for c, _ in columns if c not in header]
    if absent:
        raise ValueError(f"{path}: missing columns {absent}")
    kinds = dict(columns)
    schema = T.StructType([T.StructField(c, kinds.get(c, _S)) for c in header])
    read = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return read.select(*[c for c, _ in columns])


def read_sources(spark: SparkSession, directory: str, kind: str = "csv") -> dict[str, DataFrame]:
    """All seven source tables, column-pruned; raises with the list of absent ones."""
    absent = missing_tables(spark, directory, kind)
    if absent:
        raise FileNotFoundError(f"missing source tables in {directory}: {', '.join(absent)}")
    out = {}
    for name, columns in SOURCE_COLUMNS.items():
        path = table_path(directory, name, kind)
        if kind == "csv":
            df = read_csv(spark, path, columns)
        else:
            df = spark.read.parquet(path).select(*[F.col(c).cast(t).alias(c) for c, t in columns])
        out[name] = no_nan(df)
    return out


def read_canonical(spark: SparkSession, path: str, with_target: bool = True) -> DataFrame:
    """A flat canonical file (CSV or Parquet by its suffix)."""
    schema = v.canonical_schema(with_target)
    if path.rstrip("/").endswith(".parquet"):
        return no_nan(spark.read.schema(schema).parquet(path))
    return no_nan(read_csv(spark, path, [(f.name, f.dataType) for f in schema.fields]))


# ---- JSON-lines logs ------------------------------------------------------------

_record = T.StructType([T.StructField(c, _D) for c in v.NUMERIC] + [T.StructField(c, _S) for c in v.CATEGORICAL])
PREDICTION_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType()), T.StructField("event", _S), T.StructField("model_version", _S),
    T.StructField("latency_ms", _D),
    T.StructField("request", T.StructType([T.StructField("applicationId", _S), T.StructField("normalized", _record)])),
    T.StructField("response", T.StructType([
        T.StructField("riskScore", _D), T.StructField("riskLevel", _S), T.StructField("probability", _D),
        T.StructField("fraudFlag", T.BooleanType())]))])
HISTORY_SCHEMA = T.StructType([
    T.StructField("recorded_at", T.TimestampType()), T.StructField("period", _S), T.StructField("model_version", _S),
    *[T.StructField(c, _D) for c in ("accuracy", "roc_auc", "precision", "recall", "f1", "average_precision")],
    T.StructField("n_observations", _L)])
OUTCOME_SCHEMA = T.StructType([T.StructField("recorded_at", T.TimestampType()), T.StructField("application_id", _S),
                               *_record.fields, T.StructField(v.TARGET, _I)])


def parse_lines(lines: DataFrame, schema: T.StructType, line: str = "value") -> DataFrame:
    """Text lines -> parsed rows with ``_bad``, the line itself where it does not parse.
    Blank lines are left out."""
    with_bad = T.StructType([*schema.fields, T.StructField("_bad", _S)])
    parsed = F.from_json(F.col(line), with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rest = [c for c in lines.columns if c != line]
    return lines.filter(F.length(F.trim(line)) > 0).select(*rest, parsed.alias("r")).select(*rest, "r.*")


def read_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Tolerant read of a JSON-lines log: malformed and blank lines are skipped."""
    return parse_lines(spark.read.option("recursiveFileLookup", True).text(path), schema).filter(F.col("_bad").isNull()).drop("_bad")


def bad_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The lines a tolerant read leaves out."""
    return parse_lines(spark.read.option("recursiveFileLookup", True).text(path), schema).filter(F.col("_bad").isNotNull()).select("_bad")


def flat_predictions(log: DataFrame) -> DataFrame:
    """Prediction log with the request's fields and the response's scores as columns."""
    return log.select("timestamp", "event", "model_version", "latency_ms",
                      F.col("request.applicationId").alias("application_id"), "request.normalized.*",
                      F.col("response.riskScore").alias("risk_score"), F.col("response.riskLevel").alias("risk_level"),
                      F.col("response.probability").alias("probability"), F.col("response.fraudFlag").alias("fraud_flag"))


# ---- fingerprints ---------------------------------------------------------------

def source_fingerprint(spark: SparkSession, path: str) -> str:
    """Digest of name, size and modification time of the files below a path.

    The file listing is read as a table whose content column is pruned: no file is opened."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
             .select("path", "length", "modificationTime"))
    one = F.sha2(F.concat_ws(":", "path", F.col("length").cast("string"),
                             F.unix_micros("modificationTime").cast("string")), 256)
    # order-free: the digests are added as exact decimals
    total = F.sum(F.conv(F.left(one, F.lit(15)), 16, 10).cast("decimal(38,0)"))
    r = files.agg(total.alias("t"), F.count(F.lit(1)).alias("n")).first()
    return f"{r['t'] or 0}-{r['n']}"


def content_hash(df: DataFrame) -> Column:
    """Aggregate: order-free hash of all rows, independent of files and partitions. The hash passes
    over NULL, so which columns are NULL is hashed as well."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    return F.sum(F.xxhash64(*cols, *[c.isNull() for c in cols]).cast("decimal(38,0)"))


def table_digest(df: DataFrame) -> DataFrame:
    """One row: row count and content hash."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(content_hash(df), F.lit(0).cast("decimal(38,0)"))
                  .cast("string").alias("content_hash"))
