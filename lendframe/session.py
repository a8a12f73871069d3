"""Session settings and the shared working folder."""

from __future__ import annotations

import contextlib
import contextvars
import os
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# What the operators rely on. Partition counts are left to AQE; the advisory size keeps
# a shuffle partition well inside an executor's memory.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}

# Wide projections become generated methods above the JVM's 8000-byte compile limit; lifting
# it halves their run time. Takes effect where the JVMs are started with it.
COMPILE_WIDE = "-XX:-DontCompileHugeMethods"


def session(app: str = "lendframe", master: str | None = None, **extra: str) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    jvm = {"spark.driver.extraJavaOptions": COMPILE_WIDE, "spark.executor.extraJavaOptions": COMPILE_WIDE}
    for k, x in {**SETTINGS, **jvm, **extra}.items():
        b = b.config(k, x)
    return b.getOrCreate()


@contextlib.contextmanager
def compiled(spark: SparkSession) -> Iterator[None]:
    """Jobs that start inside keep their generated methods below the size that a JVM without ``COMPILE_WIDE`` would
    leave to its interpreter: stages with larger ones run as single operators, whose expressions Spark splits."""
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "8000")
    try:
        yield
    finally:
        spark.conf.set(key, before)


_made: contextvars.ContextVar[list | None] = contextvars.ContextVar("made", default=None)


@contextlib.contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Folders of the shared one that are made inside are removed at its end, for work that repeats without end."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for path in made:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            files = at.getFileSystem(spark._jsc.hadoopConfiguration())
            files.delete(at, True)
            files.cancelDeleteOnExit(at)


def shared_base(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or where that is unset a
    folder of the warehouse, which a cluster shares as well."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    return base or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "lendframe-work")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared one, removed with its content when the application ends."""
    path = os.path.join(shared_base(spark), f"{purpose}-{uuid.uuid4().hex[:12]}")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    if (made := _made.get()) is not None:
        made.append(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """The table computed once and written to the shared folder, for work that reads an
    intermediate result several times. Lost executors cost nothing, and later reads still
    prune columns."""
    path = shared_folder(df.sparkSession, "stored") + "/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def computed(df: DataFrame) -> DataFrame:
    """``cut_lineage`` of a wide computation, in methods that every JVM compiles."""
    with compiled(df.sparkSession):
        return cut_lineage(df)
