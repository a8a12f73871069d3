"""The corpus pipeline: documents in, token ids out.

Each stage works on all that its predecessor kept. Every stage takes nulls in any column, empty and
long texts, repeated rows, an empty table and extra columns, as its operator does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lendframe.llm import encode, language, lines, mixing, nearby, queries
from lendframe.llm.rows import unused
from lendframe.session import cut_lineage


def _with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, the length that goes with the text brought up to date."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, which replaces their label; those without a letter and those
    for which no language has half of the share are rejected. Without any label nothing can be
    decided, and all documents stay."""
    model = language.learn_documents(docs)
    if not model.languages:
        return docs
    judged = language.identify(docs, model).filter((F.col("lang_pred") != language.UNKNOWN) & ~F.col("ambiguous"))
    return judged.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def remove_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stand on many sites. Documents that are mostly such lines are left whole for the next stage."""
    return _with_text(lines.without_boilerplate(docs), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8): the one with the smallest id.

    Rows without an id stay unless they repeat each other; of repeated rows one stays; rows
    that share an id but not their text stay or go together.
    """
    of, nr = unused("_of", docs.columns), unused("_nr", docs.columns)
    kept = nearby.near_duplicates(docs.select("doc_id", "text")).filter("kept").select(F.col("doc_id").alias(of)).distinct()
    staying = docs.join(kept, F.col("doc_id").eqNullSafe(F.col(of)), "left_semi")
    same = Window.partitionBy("doc_id", F.xxhash64("text"), F.length("text")).orderBy("doc_id")
    return staying.withColumn(nr, F.row_number().over(same)).filter(F.col(nr) == 1).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as it takes them, not at all or up to twice."""
    return mixing.mix(docs, mixing.word_count(F.col("text"))).select(*docs.columns)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with the digests of the ids and of the text they decode to."""
    wanted = docs.select("doc_id", "lang", "source", "text")
    return encode.encode(wanted, queries.vocabulary_path(), outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("line_dedup", remove_boilerplate),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("encoding", encode_texts),
]
#: Learned classifiers, sketches and BPE have no SQL; tests hold the rows against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
