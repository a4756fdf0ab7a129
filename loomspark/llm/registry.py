"""The queries of this folder and the DuckDB statements that check them.

Operator modules are imported when a query runs, so one of them can be used
without the others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .session import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    return decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("removal_spans")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chatformat import chat_format, digest, with_probe

    return digest(chat_format(with_probe(read_table(spark, sf_dir, "conversations"))))


def op3_pii_boosted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii

    return find_pii(read_table(spark, sf_dir, "documents"))


def op4_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import dedup_lines

    return dedup_lines(read_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmltext import extract_text

    return extract_text(read_table(spark, sf_dir, "pages"))


def op7_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linecrf import quality, train

    docs = read_table(spark, sf_dir, "documents")
    return quality(docs, train(docs, read_table(spark, sf_dir, "labels")))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chosen_path import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op9_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity, train

    docs = read_table(spark, sf_dir, "documents")
    return toxicity(docs, train(docs, read_table(spark, sf_dir, "labels")))


def op10_warc_zip_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warczip import archive_round_trip

    return archive_round_trip(read_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def pii_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3 that SQL can express."""
    return op3_pii_boosted_candidates(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op5 that SQL can express."""
    return op5_source_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


def quality_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op7 that SQL can express."""
    return op7_line_crf_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_benchmark_decontamination, op2_chat_formatting, op3_pii_boosted_candidates, op4_fuzzy_line_dedup, op5_source_mixing, op6_html_extraction, op7_line_crf_quality, op8_ngram_jaccard_join, op9_toxicity_grammar, op10_warc_zip_round_trip, pii_base_counts, mixing_targets, quality_base_columns)}


def oracle_sql() -> dict[str, str]:
    """Statements of the queries that SQL can express in full; the tests hold the others against brute force."""
    return {"op1_benchmark_decontamination": oracles.OP1, "op2_chat_formatting": oracles.OP2, "op10_warc_zip_round_trip": oracles.OP10,
            "pii_base_counts": oracles.PII_BASE, "mixing_targets": oracles.MIXING_TARGETS, "quality_base_columns": oracles.QUALITY_BASE}
