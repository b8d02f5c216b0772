"""The registered queries over the driver's tables, each with the SQL that DuckDB runs for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import codec_queries, record_queries, signal_queries, vector_queries  # noqa: F401  they register their queries
from .registry import QUERIES, SQL, Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lapped transform of every signal and its inverse."""
    return signal_queries.imdct_overlap_add(spark, sf_dir)


def queries() -> dict[str, Query]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
