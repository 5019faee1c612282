"""Every registered query of the library, with its equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import commit_queries, committee_queries, market_queries, news_queries, stream_queries

MODULES = (news_queries, market_queries, committee_queries, stream_queries, commit_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actionable news of the last day, by score."""
    return news_queries.news_actionable(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
