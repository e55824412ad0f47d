"""The corpus pipeline: quality, exact copies, near copies, benchmark leaks, source mix.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame that run() writes as Parquet to the shared folder and reads again as the next
stage's docs. All stages but the last return the columns of documents.

Null texts count as empty; an empty table passes through as an empty table; columns beyond those of
documents are carried along. Stages judge rows, not ids: of rows that repeat an id only those go whose
own text is rejected, a copy or a leak. A null id comes after all others: its row goes where another row
has its text. Rows that agree in id (or in having none) and text stay or go together in the copy
stages. The mix takes words, so rows without any (null or blank texts) end there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tripwise.llm import decontam, exact_dedup, minhash_forest, mixing, quality
from tripwise.llm.common import drop_tables, materialize, read_table, tables_made


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise-ranking classifier rejects go."""
    return quality.drop_low_quality(docs, read_table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the smallest doc_id stays."""
    return exact_dedup.drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, the one with the smallest doc_id."""
    return minhash_forest.drop_near_copies(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontam.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the source mix takes, with n_words and copies."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("benchmark", benchmark_stage),
    ("mix", mix_stage),
]

#: A trained classifier and MinHash retrieval have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that all stages leave. Once a stage is written, what it was made from is deleted."""
    docs = read_table(spark, sf_dir, "documents")
    before = tables_made()
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_tables(spark, before)
    return docs
