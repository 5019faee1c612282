"""Market points: ordered validation, ticks with macro stamps, the latest row of a key, the snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions import values as V

GOLD = "XAUUSD"
STAMPS = {"DXY": "dxy_value", "US10Y": "us10y_yield", "US10YR": "real_yield", "VIX": "vix", "WTI": "wti"}


def point_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(V.POINT_RULES, "symbol string, least double, most double, negatives boolean, live_s long, stale_s long")


def validate_points(points: DataFrame, rules: DataFrame, as_of: Column) -> DataFrame:
    """Adds age_seconds, freshness and reason: the first failing check of each point, null where all pass.

    points: symbol, value, observed_at, open, high, low, bid, ask. The rule table has one row a symbol, five in all.
    """
    p = points.join(F.broadcast(rules), "symbol", "left")
    value, open_, high, low = F.col("value"), F.col("open"), F.col("high"), F.col("low")
    age = F.floor(F.unix_micros(as_of) / 1e6 - F.unix_micros(F.col("observed_at").cast("timestamp")) / 1e6 + F.lit(0.5)).cast("long")
    fresh = scoring.freshness(F.greatest(F.lit(0), age), F.col("live_s"), F.col("stale_s"))
    inverted = (high < low) | (high < F.greatest(value, F.coalesce(open_, value))) | (low > F.least(value, F.coalesce(open_, value)))
    reason = (
        F.when(value.isNull(), "absent").when(F.isnan(value) | F.abs(value).isin(float("inf")), "not_finite").when(F.col("least").isNull(), "no_rule")
        .when((value < 0) & ~F.col("negatives"), "negative").when((value < F.col("least")) | (value > F.col("most")), "implausible")
        .when(F.col("observed_at").isNull(), "no_time").when(age < -V.FUTURE_TOLERANCE_S, "future").when(fresh == "UNAVAILABLE", "too_old")
        .when(high.isNotNull() & low.isNotNull() & inverted, "ohlc").when(F.col("bid") <= 0, "bid").when(F.col("ask") <= 0, "ask").when(F.col("ask") < F.col("bid"), "book")
    )
    return p.withColumns({"age_seconds": F.greatest(F.lit(0), age), "freshness": fresh, "reason": reason}).drop("least", "most", "negatives", "live_s", "stale_s")


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason)."""
    return checked.where("reason is null").drop("reason"), checked.where("reason is not null")


def stamp(points: DataFrame) -> DataFrame:
    """Gold rows with the newest value of each macro symbol beside them; macro symbols give no row of their own.

    The macros are one row of maxima by time, so the join adds one row's columns and needs no shuffle of the gold rows.
    """
    latest = lambda symbol: F.max_by("value", F.when(F.col("symbol") == symbol, F.struct("observed_at", "value")))
    macros = points.where(F.col("symbol") != GOLD).agg(*[latest(symbol).alias(name) for symbol, name in STAMPS.items()])
    return points.where(F.col("symbol") == GOLD).join(F.broadcast(macros), how="cross")


def latest_by(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in `order`, which must be total."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def market_latest(ticks: DataFrame, as_of: Column) -> DataFrame:
    """The newest tick of each symbol (source, then id break ties) with its age in seconds, rounded."""
    newest = latest_by(ticks, "symbol", F.col("ts").desc(), F.col("source"), F.col("id"))
    return newest.withColumn("staleness_seconds", F.round(F.unix_micros(as_of) / 1e6 - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("int"))


def snapshot(latest: DataFrame) -> DataFrame:
    """One row: spot and each macro, from gold's stamp or else the macro's own latest row, with its age and where it came from."""
    def of(symbol: str, column: str) -> Column:
        return F.max(F.when(F.col("symbol") == symbol, F.col(column)))

    row = latest.agg(of(GOLD, "close").alias("spot"), of(GOLD, "staleness_seconds").alias("spot_age"), *[
        x for symbol, name in STAMPS.items() for x in (of(GOLD, name).alias(f"{name}_stamp"), of(symbol, "close").alias(f"{name}_own"), of(symbol, "staleness_seconds").alias(f"{name}_own_age"))
    ])
    fields = [x for name in STAMPS.values() for x in (
        F.coalesce(f"{name}_stamp", f"{name}_own").alias(name), F.when(F.col(f"{name}_stamp").isNotNull(), F.col("spot_age")).otherwise(F.col(f"{name}_own_age")).alias(f"{name}_age"),
    )]
    return row.select("spot", "spot_age", *fields, F.when(F.col("spot").isNull(), "DATA_UNAVAILABLE").otherwise("OK").alias("status"))


def run_status(errors: Column, has_gold: Column, rejected: Column) -> Column:
    return F.when(errors > 0, "FAILED").when(has_gold & (rejected == 0), "SUCCESS").when(has_gold, "PARTIAL").otherwise("FAILED")
