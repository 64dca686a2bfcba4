"""A training-text pipeline over ``documents``: five stages, each written as Parquet and reread.

Toxic documents go; of equal texts, and then of near duplicates, the document with the smallest
doc_id stays; documents that hold benchmark passages go; what is left is mixed to target weights.
Rows are told apart by a row id that each of the stages between gives its input, so rows with a null
or repeated doc_id are dropped one by one; of a group exactly one row stays (nulls last, then row id).
All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import ROW, all_but_first, by_row, materialize, numbered, without_rows
from ledgerlens.llm.decontamination import contaminated
from ledgerlens.llm.exact_dedup import exact_dedup
from ledgerlens.llm.mixing import mix
from ledgerlens.llm.ngram_join import near_duplicates
from ledgerlens.llm.toxicity import without_toxic
from ledgerlens.sources.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = numbered(docs, "copies-input")
    copies = exact_dedup(by_row(rows)).where(~F.col("kept"))
    return without_rows(rows, all_but_first(rows, copies.select(F.col("doc_id").alias(ROW), F.col("keep_id").alias("group"))))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five words and 0.8 here; op6 by itself takes four and 0.85."""
    rows = numbered(docs, "near-copies-input")
    copies = near_duplicates(by_row(rows), shingle=5, percent=80).where(F.col("doc_id") != F.col("component_id"))
    return without_rows(rows, all_but_first(rows, copies.select(F.col("doc_id").alias(ROW), F.col("component_id").alias("group"))))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = numbered(docs, "contaminated-input")
    return without_rows(rows, contaminated(by_row(rows), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(ROW)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: Learnt weights, tiles and sketches aren't SQL; the tests compare with a brute-force pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
