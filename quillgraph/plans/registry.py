"""The library's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import model_queries, table_queries, text_queries
from .common import QUERIES, SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What English documents state, by relation."""
    english = text_queries.docs(spark, sf_dir, "doc_id", "lang", "text").where("lang = 'en'").drop("lang")
    return text_queries.tr.extract(english).groupBy("relation").agg(F.count("*").alias("n"), F.count_distinct("subject").alias("n_subjects"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


__all__ = ["flagship", "model_queries", "oracle_sql", "queries", "table_queries"]
