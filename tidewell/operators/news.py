"""News: publishers, best of duplicates, scoring, alerts and notifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..functions import values as V
from . import ledger


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(V.SOURCES, "code string, source_domain string, reliability double").where("source_domain is not null")


def resolve_source(articles: DataFrame, sources: DataFrame, most: int = 1_000) -> DataFrame:
    """Adds source and reliability: the registry row of `domain`, else of its longest registered parent of two labels or more, else the fallback.

    The registry is looked up as one literal map, so no join and no shuffle; it may have `most` rows, more are an error.
    """
    rows = sources.select("source_domain", "code", "reliability").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the registry has more than {most} publishers")
    entries = [x for r in rows for x in (F.lit(r.source_domain), F.struct(F.lit(r.code).alias("code"), F.lit(r.reliability).alias("reliability")))]
    known, labels = F.create_map(*entries), F.split(F.lower("domain"), "[.]")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hit = F.get(F.array_compact(F.transform(parents, lambda d: F.try_element_at(known, d))), F.lit(0)) if rows else F.lit(None).cast("struct<code:string,reliability:double>")
    return articles.withColumn("_hit", hit).withColumns(
        {"source": F.coalesce("_hit.code", F.lit(V.FALLBACK[0])), "reliability": F.coalesce("_hit.reliability", F.lit(V.FALLBACK[1]))}
    ).drop("_hit")


def best_of_duplicates(articles: DataFrame, shortest: int = 8) -> DataFrame:
    """Of articles with one key (`dedup_key`) the most reliable, a body counting ten; the earliest on ties. Short keys go.

    Rows are grouped by 128 bits of the key's hash, not by the key, which may be a whole text; each task sends a group's best row only.
    """
    # the key is read here once: hashes and length leave explode as values, and no condition is pushed below it
    bound = F.explode(F.array(F.struct(F.xxhash64("dedup_key").alias("a"), F.xxhash64(F.lit("2"), "dedup_key").alias("b"), F.length("dedup_key").alias("n"))))
    order = Window.partitionBy("_k.a", "_k.b").orderBy((F.col("reliability") + F.when(F.col("has_body"), 10).otherwise(0)).desc(), F.col("ordinal"))
    return articles.withColumn("_k", bound).where(F.col("_k.n") >= shortest).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_k")


def in_age_window(articles: DataFrame, as_of: Column, hours: int = 48, skew_minutes: int = 10) -> DataFrame:
    return articles.where(F.col("ts").between(as_of - F.make_interval(hours=F.lit(hours)), as_of + F.make_interval(mins=F.lit(skew_minutes))))


def body() -> Column:
    """What the terms are looked for in: title and content in lower case."""
    return F.lower(F.concat_ws(" ", "title", F.coalesce("content", F.lit(""))))


def score(articles: DataFrame, least_relevance: int = 1) -> DataFrame:
    """Relevant articles (title, content, reliability, source) with every derived column of a news row."""
    # rows come out of explode: what is computed below it stays there once, and no condition is pushed into it and repeats it
    found = F.expr(f"explode(transform(array(_body), t -> struct(t as text, {scoring.terms('t')} as terms)))")
    out = articles.withColumn("_body", body()).withColumn("_k", found).withColumns({"_text": F.col("_k.text"), "_terms": F.col("_k.terms")}).drop("_body", "_k")
    out = out.where(scoring.relevance("_text", "_terms") >= least_relevance)
    out = out.withColumns({"_c": scoring.catalyst("_text", "_terms"), "_s": scoring.surprise("_text", "_terms"), "region": scoring.region("_text", "_terms")})
    out = out.withColumn("_d", scoring.direction("_text", F.col("_c.bias"), "_terms"))
    points = scoring.news_score(F.col("_c.macro"), F.col("_c.volatility"), F.col("reliability"), F.col("_s.score"), F.col("_c.duration"))
    out = out.withColumns({"category": F.col("_c.category"), "news_score": points, "direction": F.col("_d.direction"), "sentiment": F.col("_d.sentiment"), "cancelling": F.col("_c.cancelling"), "_h": scoring.channel(F.col("_c.place"))})
    out = out.withColumns({
        "classification": scoring.news_class(F.col("news_score")), "action": scoring.news_action(F.col("news_score")), "risk_level": scoring.risk_level(F.col("category"), F.col("news_score")),
        "sentiment_label": scoring.sentiment_label(F.col("sentiment")), "assumptions": assumptions(F.col("_c.known"), F.col("source"), F.col("content"), F.col("_s.proven"), F.col("_s.score")),
    })
    out = out.withColumns({"channel": F.col("_h.channel"), "impact_duration": F.col("_h.duration")}).drop("_text", "_terms", "_c", "_s", "_d", "_h")
    return out.select(F.explode(F.array(F.struct(*[F.col(f"`{c}`") for c in out.columns]))).alias("_row")).select("_row.*")


def assumptions(known: Column, source: Column, content: Column, proven: Column, surprise: Column) -> Column:
    """What was assumed, in order: default catalyst, unknown publisher, no body, unproven surprise."""
    def entry(when: Column, variable: str, value: Column) -> Column:
        return F.when(when, F.struct(F.lit(variable).alias("variable"), value.cast("double").alias("assumed_value")))

    return F.array_compact(F.array(
        entry(~known, "macro_score", F.lit(V.DEFAULT_CATALYST[0])), entry(source == V.FALLBACK[0], "reliability_score", F.lit(V.FALLBACK[1])),
        entry(F.coalesce(content, F.lit("")) == "", "scoring_input", F.lit(0)), entry(~proven, "surprise_score", surprise),
    ))


def notifications(news: DataFrame) -> DataFrame:
    """Events for actionable rows, by score; archived rows make none."""
    live = news.where(F.col("action") != "ARCHIVE_ONLY")
    return live.select(F.concat_ws(":", F.lit("news"), "id", "action").alias("event_id"), F.col("action").alias("event_type"), F.lit("news_engine").alias("source"), F.col("id").alias("news_event_id"), "news_score").orderBy(F.col("news_score").desc(), "event_id")


def alerts(news: DataFrame) -> DataFrame:
    """An alert for each critical or major row; its key holds the hour and the start of the title's key."""
    critical = F.col("classification") == "critical"
    hour = F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd'T'HH")
    return news.where(F.col("classification").isin("critical", "major")).select(
        F.col("id").alias("news_id"), F.when(F.col("category") == "geopolitics", "macro").otherwise("news").alias("alert_type"), F.when(critical, "critical").otherwise("high").alias("severity"),
        F.when(critical, V.CRITICAL).otherwise(V.MAJOR).alias("threshold"), F.concat(F.lit("news:"), hour, F.lit(":"), F.substring(text.dedup_key(F.col("title")), 1, 80)).alias("dedup_key"),
    )


def run_status(errors: Column, failed_providers: Column) -> Column:
    return F.when((errors == 0) & (failed_providers == 0), "success").otherwise("partial")


def run_counters(fetched: DataFrame, kept: DataFrame, persisted: DataFrame) -> DataFrame:
    """One row: what a run fetched, kept after its own duplicates, persisted, and of that critical and major rows; duplicates are those of the run and of the target."""
    n = lambda df, name, *more: df.agg(F.count("*").alias(name), *more)
    of = lambda c: F.count_if(F.col("classification") == c).alias(c)
    counts = n(fetched, "fetched").join(F.broadcast(n(kept, "kept")), how="cross").join(F.broadcast(n(persisted, "persisted", of("critical"), of("major"))), how="cross")
    return counts.withColumn("duplicate", F.col("fetched") - F.col("persisted"))


def sweep_alerts(pending: DataFrame, delivered: DataFrame, existing: DataFrame, least: float = 80) -> DataFrame:
    """System alerts to append for pending rows (id, title, news_score) of `least` or more that the sweep could not deliver (ids in
    `delivered` were); none while an alert of the row is active."""
    failed = pending.where(F.col("news_score") >= least).join(delivered.select("id").distinct(), "id", "left_anti")
    made = failed.select(
        F.col("id").alias("news_id"), F.lit("system").alias("alert_type"), F.lit("high").alias("severity"), F.lit("triggered").alias("status"), "title",
        F.concat(F.lit("notify-stuck:"), F.col("id").cast("string")).alias("dedup_key"))
    return ledger.new_alerts(made, existing)
