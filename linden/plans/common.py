"""Shared inputs of the named queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linden.sources import views
from linden.sources.tables import Tables, spread, table


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(spark, sf_dir)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.lines(documents(spark, sf_dir))


def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.tokens(doc_lines(spark, sf_dir))


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.code_lines(doc_lines(spark, sf_dir))


def code_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.tokens(code_lines(spark, sf_dir))


def edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.edit_log(table(spark, sf_dir, "events"))
