"""Functions for SQL text: the news score under its own name."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import values as V

COMPONENTS = ("macro", "volatility", "reliability", "surprise", "duration")


def register(spark: SparkSession) -> None:
    """Creates the temporary function fn_news_score(macro, volatility, reliability, surprise, duration); null if any argument is.

    It is an SQL function, so Catalyst inlines it: no Python worker, and filters pass through.
    """
    total = " + ".join(f"cast({w} as decimal(3,2)) * {name}" for w, name in zip(V.WEIGHTS, COMPONENTS))
    arguments = ", ".join(f"{name} decimal(6,2)" for name in COMPONENTS)
    spark.sql(f"create or replace temporary function fn_news_score({arguments}) returns decimal(6,2) return cast(round({total}, 2) as decimal(6,2))")
