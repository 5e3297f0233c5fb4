"""The queries ``opN_<name>`` of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, lexical, main_text, near_duplicates, nearest, oracles, passages, personal_data, quality, token_counts, warc, whitening
from .grammar import read_tokens, write_tokens
from .packing import pack_documents
from .runtime import small_batches
from .tokens import vocabulary_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``pages`` written as monolithic archives, normalised, and read back by the index."""
    return warc.archive_pages(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicates among whole ``documents``."""
    return near_duplicates.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` packed into sequences of 2048 tokens."""
    return pack_documents(_table(spark, sf_dir, "documents"), vocabulary_path())


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` against all windows of ``benchmark``."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.digest(decontamination.find_hits(docs, _table(spark, sf_dir, "benchmark")))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` written as grammar-compressed token files and read back."""
    return read_tokens(write_tokens(_table(spark, sf_dir, "documents"), vocabulary_path()))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of whole ``documents``, learned from ``labels`` outside the held-out rows."""
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that repeat across whole ``documents``, up to small edits."""
    return passages.repeated_passages(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of unigram pieces in whole ``documents``."""
    return token_counts.count_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path("piece_bpe_32k.model"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in whole ``documents``."""
    return personal_data.digest(personal_data.find_personal_data(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of all ``embeddings`` for every vector whose vec_id 50 divides."""
    return nearest.top_k(_table(spark, sf_dir, "embeddings"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``embeddings`` whitened: up to 16 components of every vector."""
    return whitening.digest(whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of whole ``documents`` for every item of ``benchmark``."""
    return lexical.search(_table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of whole ``pages``, by the wrappers of their hosts."""
    return main_text.main_text(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_archives": op1_warc_archives,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_decontamination": op4_decontamination,
    "op5_token_files": op5_token_files,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_repeated_passages": op7_repeated_passages,
    "op8_token_counts": op8_token_counts,
    "op9_personal_data": op9_personal_data,
    "op10_exact_top_k": op10_exact_top_k,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_ranked_search": op12_ranked_search,
    "op13_html_extraction": op13_html_extraction,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc_archives": oracles.OP1,
    "op2_near_duplicates": oracles.OP2,
    "op4_decontamination": oracles.OP4,
    "op9_personal_data": oracles.OP9,
    "op10_exact_top_k": oracles.OP10,
    "op12_ranked_search": oracles.OP12,
    "op13_html_extraction": oracles.OP13,
}
