"""The corpus pipeline: quality rules, near duplicates, decontamination, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's `docs`.

Defined results: rows whose text is null or empty fail the quality rules. Rows
without an id pass through all stages like others; of a group of near duplicates
the row of the smallest id stays, of rows that repeat an id and text one. Extra
columns pass through all stages, but those named as the mix's own (size,
source_size, target, taken) are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import decontamination, mixing, ngram_join, pii, quality_rules
from lexloom.llm.common import table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules or the trained model reject go."""
    return quality_rules.passing(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays."""
    return ngram_join.without_copies(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, also under other numbers or names, go."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by marks."""
    return pii.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words taken of each (repeats counted)."""
    return mixing.mixed(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("pii", personal_data_stage),
    ("source_mixing", mixing_stage),
]

#: The trained models and the similarity join have no SQL form; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
