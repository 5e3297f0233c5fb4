"""A training-data pipeline over ``documents``: filter, deduplicate, decontaminate, redact, pack.

Every stage takes the rows that the one before it kept, and all but the last return the
columns of ``documents``. Rows are whole documents throughout; no stage samples or cuts its
input. Null texts are empty ones to all stages, rows without a doc_id are kept, rows that repeat
a doc_id are taken as one document by the near-duplicates alone, very long texts are taken
whole, and an empty table gives an empty table. Columns of ``documents`` may have any names.
Held by ``tests/llm/test_queries.py`` against a brute-force version, stage by stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitegrain.llm import decontamination, near_duplicates, personal_data, quality
from sitegrain.llm.packing import pack_documents
from sitegrain.llm.runtime import materialize, small_batches
from sitegrain.llm.tokens import vocabulary_path


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier, trained on ``labels`` outside the held-out rows, rejects."""
    small_batches(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that with the smallest doc_id, of each group of near-duplicates."""
    small_batches(spark)
    return near_duplicates.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold passages of ``benchmark`` in a twentieth of their words or more."""
    small_batches(spark)
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; every document stays."""
    return personal_data.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens: a row for each piece."""
    small_batches(spark)
    return pack_documents(docs, vocabulary_path())


STAGES = [
    ("quality_classifier", quality_filter),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("personal_data", redact_personal_data),
    ("best_fit_packing", packing),
]

#: Tokens, learned scores and near-duplicate groups are beyond one SQL query.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
