"""Named queries of the engine with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliomill.plans import document_queries, lifecycle_queries, table_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = document_queries.QUERIES | table_queries.QUERIES | lifecycle_queries.QUERIES
ORACLES: dict[str, str] = document_queries.ORACLES | table_queries.ORACLES | lifecycle_queries.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections, tier-1 scores, the five best, and an answer from their text."""
    return document_queries.answer_topk(spark, sf_dir)
