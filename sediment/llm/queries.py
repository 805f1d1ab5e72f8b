"""Queries of this subpackage: each applies its operator to the whole table that it is meant for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .fingerprints import fingerprint_documents
from .mixing import mix
from .near_dedup import near_duplicates
from .oracle import ORACLE_SQL
from .packing import pack
from .pii import pii
from .quality_classifier import classify
from .quality_rules import quality_rules
from .token_counts import token_counts
from .token_files import token_files_digest
from .warc import captures


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files_digest(spark, table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), classes="lang").select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii(table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures(spark, table(spark, sf_dir, "pages"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_token_files, op2_pii, op3_token_counts, op4_quality_rules, op5_fingerprints, op6_mixing, op7_near_dedup, op8_warc, op9_packing, op10_quality_classifier)}

__all__ = ["ORACLE_SQL", "QUERIES"]
