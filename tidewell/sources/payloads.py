"""Provider payloads as landed JSON: explicit schemas, strict numbers, absence with a reason instead of zero."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

SERIES = "observations array<struct<date: string, value: string>>"
QUOTE = "close string, open string, high string, low string, volume string, timestamp long, last_quote_at long, datetime string, status string, message string"
ARTICLES = "status string, message string, articles array<struct<title: string, description: string, content: string, url: string, publishedAt: string, source: struct<name: string>>>"
FEED = "articles array<struct<title: string, url: string, domain: string, seendate: string>>"


def parse_series(payloads: DataFrame) -> DataFrame:
    """(symbol, payload) -> the last numeric observation; `.` and blanks are skipped."""
    seen = F.from_json("payload", SERIES).observations
    numeric = F.filter(F.transform(seen, lambda o: F.struct(o.date.alias("date"), text.strict_number(o.value).alias("value"))), lambda o: o.value.isNotNull())
    last = F.try_element_at(numeric, F.lit(-1))
    reason = F.when(seen.isNull(), "unreadable").when(F.size(numeric) == 0, "no_numeric_observation")
    return payloads.select("symbol", last.value.alias("value"), last.date.try_cast("timestamp").alias("observed_at"), reason.alias("unavailable_reason"))


def parse_quote(payloads: DataFrame) -> DataFrame:
    """(symbol, payload) -> a point; an error status inside a reply is absence, the time is the first of three that is there."""
    q = F.from_json("payload", QUOTE)
    failed = F.coalesce(q.status == "error", F.lit(False))
    times = F.coalesce(F.timestamp_seconds(q.last_quote_at), F.timestamp_seconds(q.timestamp), text.parse_time(q.datetime))
    number = lambda name: F.when(~failed, text.strict_number(q[name])).alias("value" if name == "close" else name)
    reason = F.when(F.col("payload").isNull() | q.isNull(), "unreadable").when(failed, F.coalesce(q.message, F.lit("error"))).when(text.strict_number(q.close).isNull(), "no_price")
    return payloads.select("symbol", *map(number, ("close", "open", "high", "low", "volume")), F.when(~failed, times).alias("observed_at"), reason.alias("unavailable_reason"))


def parse_articles(payloads: DataFrame) -> DataFrame:
    """Articles of keyed replies; a status other than ok gives none, `[Removed]` items and those without title or time go."""
    each = payloads.select(F.from_json("payload", ARTICLES).alias("p")).where("p.status = 'ok'").select(F.explode("p.articles").alias("a"))
    body = F.nullif(F.concat_ws(" ", "a.description", "a.content"), F.lit(""))
    out = each.select(text.clean_text(F.col("a.title"), 500).alias("title"), text.clean_text(body, 4000).alias("content"), F.col("a.url").alias("url"), text.domain(F.col("a.url")).alias("domain"), text.parse_time(F.col("a.publishedAt")).alias("ts"))
    return out.where("title is not null and title <> '[Removed]' and ts is not null")


def parse_feed(payloads: DataFrame) -> DataFrame:
    """Articles of the keyless feed, whose items have no body."""
    each = payloads.select(F.explode(F.from_json("payload", FEED).articles).alias("a"))
    out = each.select(text.clean_text(F.col("a.title"), 500).alias("title"), F.lit(None).cast("string").alias("content"), F.col("a.url").alias("url"), F.coalesce(F.lower("a.domain"), text.domain(F.col("a.url"))).alias("domain"), text.parse_time(F.col("a.seendate")).alias("ts"))
    return out.where("title is not null and ts is not null")
