"""What a dashboard shows: changes, labels, impact of macro moves, scenarios fit to show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import values as V


def changes(ticks: DataFrame) -> DataFrame:
    """Adds previous, change and the session's first price by symbol, in order of time and id.

    Rows are windowed by symbol and day, so a busy symbol is many tasks; each day's first and last value are carried over from a
    table of one row a symbol and day.
    """
    day, at = F.coalesce(F.col("ts").cast("date"), F.lit("0001-01-01").cast("date")), F.struct("ts", "id")
    dated = ticks.withColumns({"_symbol": F.coalesce("symbol", F.lit("")), "_day": day})
    by, days = Window.partitionBy("_symbol", "_day").orderBy("ts", "id"), Window.partitionBy("_symbol").orderBy("_day")
    daily = dated.groupBy("_symbol", "_day").agg(F.min_by("value", at).alias("_first"), F.max_by("value", at).alias("_last"))
    daily = daily.select("_symbol", "_day", F.lag("_last").over(days).alias("_before"), F.first("_first").over(days).alias("session_open"))
    own = dated.withColumns({"_n": F.row_number().over(by), "_lag": F.lag("value").over(by)}).join(daily, ["_symbol", "_day"])
    out = own.withColumn("previous", F.when(F.col("_n") == 1, F.col("_before")).otherwise(F.col("_lag"))).drop("_symbol", "_day", "_n", "_lag", "_before")
    return out.withColumns({"change": F.col("value") - F.col("previous"), "session_change": F.col("value") - F.col("session_open")})


def macro_impact(moves: DataFrame) -> DataFrame:
    """moves (driver, change) with impact and label; under 1e-9 a move is flat, neutral and `Stable`. The rule table has ten rows."""
    spark = SparkSession.getActiveSession()
    table = F.broadcast(spark.createDataFrame(V.MACRO_IMPACT, "driver string, movement string, impact string, label string"))
    movement = F.when(F.abs("change") < 1e-9, "flat").when(F.col("change") > 0, "up").when(F.col("change") < 0, "down").otherwise("flat")
    out = moves.withColumn("movement", movement).join(table, ["driver", "movement"], "left")
    return out.withColumns({"impact": F.coalesce("impact", F.lit("neutral")), "label": F.coalesce("label", F.lit("Stable"))})


def tradable(activation: Column) -> Column:
    return ~F.coalesce(activation.startswith("LEGACY:"), F.lit(False))


def displayable(s: DataFrame) -> DataFrame:
    """Scenarios with numbers and an activation condition that is long enough."""
    return s.where(F.col("target").isNotNull() & F.col("invalidation").isNotNull() & F.col("probability").isNotNull() & (F.length(F.trim("activation_condition")) >= V.MIN_ACTIVATION))


def shown(x: Column, decimals: int = 2) -> Column:
    """A number with fixed decimals, for a listing; N/A for what is none."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), "N/A").otherwise(F.format_string(f"%.{decimals}f", x))


def shown_signed(x: Column, decimals: int = 2) -> Column:
    """As `shown`, with a plus sign before what is above 0."""
    return F.concat(F.when(x > 0, F.when(F.isnan(x) | (x == float("inf")), "").otherwise("+")).otherwise(""), shown(x, decimals))


def moves(x: Column) -> Column:
    """up, down or flat; what is no number, or within a billionth of 0, is flat."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | (F.abs(x) < 1e-9), "flat").when(x > 0, "up").otherwise("down")


def quote_lines(ticks: DataFrame, session_open: Column) -> DataFrame:
    """id with the texts of a quote: price, change against the session's opening price, in points and percent, spread, direction and hour of the day.

    ticks: id, ts, close, bid, ask, spread. A missing spread is ask less bid; an opening price of 0 gives 0 percent.
    """
    change = F.col("close") - session_open
    share = F.when(session_open != 0, change / session_open * 100).otherwise(0.0)
    return ticks.select(
        "id", shown(F.col("close")).alias("price"), F.concat(shown_signed(change), F.lit("  "), shown_signed(share), F.lit("%")).alias("change"), shown(F.coalesce("spread", F.col("ask") - F.col("bid"))).alias("spread"),
        moves(change).alias("direction"), F.coalesce(F.date_format("ts", "HH:mm"), F.lit("--:--")).alias("at"))
