"""The registered queries over documents. SQL can't express their operators; tests hold them against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stranda.llm import leakage, pii, tokens
from stranda.session import table


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents", "doc_id", "text"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_item", "item_id", "item_text"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "name_part", "name_text", "name_role"))


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "name_part", "name_text", "name_role"))


def p8_disclosing(spark: SparkSession, d: str) -> DataFrame:
    return pii.disclosing_terms(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "name_part", "name_text", "name_role"))


def p8_sanitised(spark: SparkSession, d: str) -> DataFrame:
    return pii.sanitised(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "name_part", "name_text", "name_role"))


QUERIES = {q.__name__: q for q in (p6_ids, p7_found, p8_found, p8_redacted, p8_disclosing, p8_sanitised)}
SQL: dict[str, str] = {}
