"""A corpus pipeline of five operators. Each stage works on all that the one before it kept.

Stages but the last return the columns of ``documents``; the last returns packed pieces. A stage is
written as Parquet in the shared scratch folder and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import catalog, packing, pii, quality, simhash, toxicity
from cairn.runtime import materialize, ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the likelihood-ratio threshold go."""
    ship(spark)
    return quality.keep_good(docs.select(*COLUMNS), _labels(spark, sf_dir))


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier flags with their language's threshold go."""
    ship(spark)
    return toxicity.keep_clean(docs.select(*COLUMNS), _labels(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id.

    Groups are components of pairs whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.
    Rows that repeat a doc_id count as copies of it; of a group without any doc_id, one row stays.
    """
    ship(spark)
    return simhash.keep_first(docs.select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind in brackets."""
    ship(spark)
    return pii.redact(docs.select(*COLUMNS))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 4096 tokens."""
    ship(spark)
    return packing.pack(docs, catalog.public_tokenizers.path(catalog.WORD_VOCABULARY))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic_documents),
    ("near_duplicates", near_duplicates),
    ("pii", personal_data),
    ("packing", packed_sequences),
]

#: SQL can express none of the learned stages; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
