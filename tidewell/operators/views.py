"""The named read views over news, ticks, analyses and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ledger
from .market import latest_by


def news_high_impact(news: DataFrame, as_of: Column) -> DataFrame:
    return news.where(F.col("classification").isin("major", "critical") & (F.col("ts") > as_of - F.expr("interval 48 hours"))).orderBy(F.col("ts").desc(), "id")


def news_actionable(news: DataFrame, as_of: Column) -> DataFrame:
    return news.where((F.col("action") != "ARCHIVE_ONLY") & (F.col("ts") > as_of - F.expr("interval 24 hours"))).orderBy(F.col("news_score").desc(), F.col("ts").desc(), "id")


def news_pending(news: DataFrame, as_of: Column) -> DataFrame:
    return ledger.pending(news, as_of).orderBy(F.col("news_score").desc(), "ts", "id")


def engine_last_run(runs: DataFrame) -> DataFrame:
    return latest_by(runs, "engine", F.col("started_at").desc(), F.col("id").desc())


def with_scenarios(analyses: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Analyses with a map from horizon to scenario, empty where there is none. A horizon stands once in an analysis."""
    fields = [c for c in scenarios.columns if c not in ("analysis_id", "horizon")]
    maps = scenarios.groupBy("analysis_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("horizon", F.struct(*fields).alias("scenario"))))).alias("scenarios"))
    kinds = dict(maps.dtypes)["scenarios"]
    return analyses.join(maps, "analysis_id", "left").withColumn("scenarios", F.coalesce("scenarios", F.create_map().cast(kinds)))


def ai_latest(analyses: DataFrame, scenarios: DataFrame, as_of: Column, latest_then_filter: bool = False) -> DataFrame:
    """The newest analysis of each symbol with its scenarios; expired ones go first, or last with `latest_then_filter`."""
    valid = F.col("valid_until").isNull() | (F.col("valid_until") > as_of)
    order = ("symbol", F.col("analysis_ts").desc(), F.col("analysis_id").desc())
    newest = latest_by(analyses, *order).where(valid) if latest_then_filter else latest_by(analyses.where(valid), *order)
    # scenarios of the shown analyses alone are gathered; the short list of ids is broadcast where its size allows
    return with_scenarios(newest, scenarios.join(newest.select("analysis_id"), "analysis_id", "left_semi"))


def audit_chain(news: DataFrame, events: DataFrame, scenarios: DataFrame, limit: int = 5) -> DataFrame:
    """The newest news rows with the scenarios that their events led to; counts of scenarios by news row are made before the join."""
    counted = scenarios.groupBy("analysis_id").agg(F.count("*").alias("n"))
    chain = events.join(counted, "analysis_id", "left").groupBy("news_id").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n_scenarios"), F.count("*").alias("n_events"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_events", "n_scenarios")]
    return news.join(chain, "news_id", "left").select("news_id", "ts", *zero).orderBy(F.col("ts").desc(), F.col("news_id").desc()).limit(limit)


def class_distribution(news: DataFrame) -> DataFrame:
    return news.groupBy("classification").agg(F.count("*").alias("n"), F.round(F.min("news_score"), 0).cast("double").alias("least"), F.round(F.max("news_score"), 0).cast("double").alias("most"))


def repeated(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def recent(df: DataFrame, time: str, key: str, limit: int = 25) -> DataFrame:
    """The newest rows of a listing, ties by key; `limit` is the listing's length."""
    return df.orderBy(F.col(time).desc(), F.col(key).desc()).limit(limit)
