"""Queries of the news operators over stand-in relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring, sql, text
from ..functions import values as V
from ..operators import ledger, news, views
from . import stand_ins as S

COMPONENTS = "doc_id, doc_id % 101 AS macro, (doc_id * 7 + n_chars) % 101 AS volatility, (n_chars * 13) % 101 AS reliability, (doc_id * 31) % 101 AS surprise, (n_chars + doc_id) % 101 AS duration"


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.read(spark, sf_dir, "documents").selectExpr(*COMPONENTS.split(", "))


def _score() -> F.Column:
    return scoring.news_score(*map(F.col, ("macro", "volatility", "reliability", "surprise", "duration")))


def news_score(spark, sf_dir):
    return _components(spark, sf_dir).select("doc_id", _score().cast("double").alias("news_score"))


def news_class_action(spark, sf_dir):
    docs = _components(spark, sf_dir).withColumns({"s": _score(), "incoming": F.when(F.col("doc_id") % 3 == 0, "moderate").otherwise("noise"), "category": F.when(F.col("doc_id") % 2 == 0, "geopolitics").otherwise("trade")})
    return docs.select("doc_id", scoring.news_class(F.col("s"), F.col("incoming")).alias("classification"), scoring.news_action(F.col("s")).alias("action"), scoring.risk_level(F.col("category"), F.col("s")).alias("risk_level"))


def sentiment_label(spark, sf_dir):
    return S.read(spark, sf_dir, "documents").select("doc_id", scoring.sentiment_label((F.col("doc_id") % 201 - 100) / 100).alias("label"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news.score(news.resolve_source(S.articles(spark, sf_dir), news.registry(spark)))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored rows as views read them: no condition on a score is pushed into the scoring, which `score` sees to."""
    return scored(spark, sf_dir)


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.articles(spark, sf_dir).select("id", news.body().alias("low"))


def catalyst_resolution(spark, sf_dir):
    c = _bodies(spark, sf_dir).select("id", scoring.catalyst("low").alias("c"))
    return c.select("id", *[F.col(f"c.{n}").cast("long").alias(n) for n in ("macro", "volatility", "duration")], "c.category", "c.bias", F.concat_ws("|", "c.cancelling").alias("cancelling"), "c.known")


def catalyst_channel(spark, sf_dir):
    return _bodies(spark, sf_dir).select("id", scoring.channel(scoring.catalyst("low")["place"]).alias("c")).select("id", "c.channel", F.col("c.duration").alias("impact_duration"))


def sweep_alerts(spark, sf_dir):
    waiting = ledger.pending(_ledger(spark, sf_dir), S.as_of())
    have = waiting.where("n % 7 = 0").select(F.concat(F.lit("notify-stuck:"), "id").alias("dedup_key"), F.when(F.col("n") % 2 == 0, "triggered").otherwise("resolved").alias("status"))
    return news.sweep_alerts(waiting, waiting.where("n % 3 = 0"), have).select("news_id", "alert_type", "severity", "dedup_key")


def news_run_counters(spark, sf_dir):
    fetched = S.articles(spark, sf_dir)
    rows = stored(spark, sf_dir)
    return news.run_counters(fetched, rows, rows.where("cast(id as bigint) % 3 <> 0")).select("fetched", "kept", "persisted", "duplicate", "critical", "major")


def news_score_sql(spark, sf_dir):
    sql.register(spark)
    return _components(spark, sf_dir).selectExpr("doc_id", "cast(fn_news_score(macro, volatility, reliability, surprise, duration) as double) as news_score")


def direction_sentiment(spark, sf_dir):
    return scored(spark, sf_dir).select("id", "direction", F.col("sentiment").cast("double").alias("sentiment"))


def surprise_score(spark, sf_dir):
    return _bodies(spark, sf_dir).select("id", scoring.surprise("low").alias("s")).select("id", F.col("s.score").cast("double").alias("surprise"), "s.proven")


def region_relevance(spark, sf_dir):
    return _bodies(spark, sf_dir).select("id", scoring.region("low").alias("region"), scoring.relevance("low").cast("long").alias("relevance"))


def scored_news(spark, sf_dir):
    return scored(spark, sf_dir).select("id", F.col("news_score").cast("double").alias("news_score"), "category", "region", "classification", "action", "risk_level", "source")


def quality_score(spark, sf_dir):
    d = S.read(spark, sf_dir, "documents")
    flags = [F.col("doc_id") % k != 0 for k in (2, 3, 5)]
    return d.select("doc_id", scoring.quality((F.col("doc_id") % 2000).cast("double"), *flags, (F.col("doc_id") % 101).cast("double")).alias("quality"))


def assumption_log(spark, sf_dir):
    return scored(spark, sf_dir).select("id", F.explode("assumptions").alias("a")).select("id", "a.variable", "a.assumed_value")


def domain_resolve(spark, sf_dir):
    pages = S.read(spark, sf_dir, "pages").select("page_id", text.domain(F.col("url")).alias("host"))
    doms = pages.withColumn("domain", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("a.b."), F.expr(S.pick(f"page_id % {len(S.DOMAINS)}", S.DOMAINS)))).otherwise(F.col("host")))
    return news.resolve_source(doms, news.registry(spark)).select("page_id", "host", "source", "reliability")


def dedup_best(spark, sf_dir):
    arts = S.read(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("ordinal"), text.dedup_key(F.col("text")).alias("dedup_key"), (F.col("n_chars") % 50).cast("double").alias("reliability"), (F.col("doc_id") % 3 == 0).alias("has_body"))
    return news.best_of_duplicates(arts).select("doc_id", F.sha2("dedup_key", 256).alias("key_hash"))


def dedup_hash_unique(spark, sf_dir):
    return views.repeated(S.read(spark, sf_dir, "documents").select(text.dedup_hash(F.col("text")).alias("dedup_hash")), "dedup_hash")


def clean_text(spark, sf_dir):
    return S.read(spark, sf_dir, "pages").select("page_id", text.clean_text(F.col("html"), 300).alias("cleaned"))


def log_redaction(spark, sf_dir):
    ev = S.read(spark, sf_dir, "events").selectExpr("event_id", """concat('{"id":', event_id, ',"apiKey":"k', user_id, '","nested":{"list":[{"auth_token":', user_id, '},"see ?key=', event_type, '&x=1"],"note":"Bearer ', event_id, '"}}') as context""")
    return ev.select("event_id", text.redact_json(F.col("context")).alias("shown"))


def _ledger(spark, sf_dir) -> DataFrame:
    rows = stored(spark, sf_dir).withColumn("n", F.col("id").cast("long"))
    return rows.withColumns({"notified_at": F.when(F.col("n") % 4 == 0, F.col("ts")), "notify_attempts": (F.col("n") % 12).cast("int")})


def news_high_impact(spark, sf_dir):
    return views.news_high_impact(stored(spark, sf_dir), S.as_of()).select("id", "classification", F.col("news_score").cast("double").alias("news_score"))


def news_actionable(spark, sf_dir):
    return views.news_actionable(stored(spark, sf_dir), S.as_of()).select("id", "action", F.col("news_score").cast("double").alias("news_score"))


def news_pending(spark, sf_dir):
    return views.news_pending(_ledger(spark, sf_dir), S.as_of()).select("id", "notify_attempts")


def news_stuck(spark, sf_dir):
    return ledger.stuck(_ledger(spark, sf_dir), S.as_of()).select("id")


def class_distribution(spark, sf_dir):
    return views.class_distribution(stored(spark, sf_dir))


def notification_build(spark, sf_dir):
    return news.notifications(stored(spark, sf_dir)).select("event_id", "event_type", "news_event_id")


def alert_build(spark, sf_dir):
    return news.alerts(stored(spark, sf_dir))


def alert_insert(spark, sf_dir):
    made = news.alerts(stored(spark, sf_dir))
    have = made.where(F.col("news_id").cast("long") % 2 == 0).withColumn("status", F.when(F.col("news_id").cast("long") % 4 == 0, "triggered").otherwise("resolved"))
    return ledger.new_alerts(made, have).select("dedup_key")


def news_age_window(spark, sf_dir):
    shifted = S.articles(spark, sf_dir).withColumn("ts", F.col("ts") + F.make_interval(mins=F.lit(30)))
    return news.in_age_window(shifted, S.as_of()).select("id")


_NEWS = "WITH " + S.scored_sql()
_DOCS = f"WITH c AS (SELECT {COMPONENTS} FROM documents), d AS (SELECT *, {S.SCORE} AS news_score FROM c)"
_LEDGER = _NEWS + ", l AS (SELECT *, CASE WHEN CAST(id AS bigint) % 4 = 0 THEN ts END AS notified_at, CAST(CAST(id AS bigint) % 12 AS int) AS notify_attempts FROM news)"
_PENDING = f"action <> 'ARCHIVE_ONLY' AND notified_at IS NULL AND ts < {S.AS_OF} - INTERVAL 90 SECOND AND notify_attempts < 10"
_BODY = f"WITH a AS ({S.ARTICLES_DB}), b AS (SELECT *, {S.TEXT} AS body FROM a)"
_KEY = r"trim(regexp_replace(regexp_replace(strip_accents(lower(trim(regexp_replace({}, '\s+[-|–—]\s+[^-|–—]{{2,40}}$', '')))), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"
_ALERTS = f"""m AS (SELECT id AS news_id, CASE WHEN category = 'geopolitics' THEN 'macro' ELSE 'news' END AS alert_type, CASE WHEN classification = 'critical' THEN 'critical' ELSE 'high' END AS severity,
  CAST(CASE WHEN classification = 'critical' THEN 80 ELSE 60 END AS int) AS threshold, 'news:' || strftime(date_trunc('hour', ts), '%Y-%m-%dT%H') || ':' || left({_KEY.format('title')}, 80) AS dedup_key
  FROM news WHERE classification IN ('critical', 'major'))"""


def _clean_sql() -> str:
    x = r"regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
    for name, char in V.ENTITIES.items():
        if name != "&amp;":
            x = f"regexp_replace({x}, {S.quote('(?i)' + name)}, {S.quote(char)}, 'g')"
    x = f"replace(regexp_replace(regexp_replace({x}, '(?i)&amp;', chr(1), 'g'), '(?i)&[a-z]+;|&#x[0-9a-f]+;', ' ', 'g'), chr(1), '&')"
    x = rf"regexp_replace({x}, '(?i)\[\+[0-9]+\s*chars?\]', ' ', 'g')"
    return rf"trim(regexp_replace({x}, '[\x00-\x20\x7f\x{{a0}}\x{{2000}}-\x{{200f}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x{{feff}}]+', ' ', 'g'))"


QUERIES = {f.__name__: f for f in (
    catalyst_channel, sweep_alerts, news_run_counters, news_score_sql, news_score, news_class_action, sentiment_label, catalyst_resolution, direction_sentiment, surprise_score, region_relevance, scored_news, quality_score, assumption_log, domain_resolve, dedup_best,
    dedup_hash_unique, clean_text, news_high_impact, news_actionable, news_pending, news_stuck, class_distribution, notification_build, alert_build, alert_insert, news_age_window, log_redaction,
)}
_FRESH = f"CASE WHEN doc_id % 2000 <= 15 THEN 100.0 ELSE {S.clamp('100 - (doc_id % 2000 - 15) / CAST(1440 AS double) * 100')} END"
ORACLE_SQL = {
    "news_score": f"{_DOCS} SELECT doc_id, CAST(news_score AS double) AS news_score FROM d",
    "news_class_action": f"""{_DOCS}, e AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'geopolitics' ELSE 'trade' END AS category FROM d)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'moderate' ELSE {S.CLASS} END AS classification, {S.ACTION} AS action, {S.RISK} AS risk_level FROM e""",
    "sentiment_label": """SELECT doc_id, CASE WHEN s <= -0.6 THEN 'very_negative' WHEN s <= -0.2 THEN 'negative' WHEN s < 0.2 THEN 'neutral' WHEN s < 0.6 THEN 'positive' ELSE 'very_positive' END AS label
FROM (SELECT doc_id, (doc_id % 201 - 100) / CAST(100 AS double) AS s FROM documents)""",
    "catalyst_resolution": f"{_BODY}, c AS (SELECT id, {S.catalyst_columns('body')} FROM b) SELECT id, CAST(macro AS bigint) AS macro, CAST(volatility AS bigint) AS volatility, CAST(duration AS bigint) AS duration, category, bias, cancelling, known FROM c",
    "catalyst_channel": f"{_BODY} SELECT id, {S.channel_columns('body')} FROM b",
    "sweep_alerts": f"""{_LEDGER}, p AS (SELECT *, CAST(id AS bigint) AS n FROM l WHERE {_PENDING} AND news_score >= 80)
SELECT id AS news_id, 'system' AS alert_type, 'high' AS severity, 'notify-stuck:' || id AS dedup_key FROM p WHERE n % 3 <> 0 AND n % 14 <> 0""",
    "news_run_counters": f"""{_NEWS}, p AS (SELECT * FROM news WHERE CAST(id AS bigint) % 3 <> 0) SELECT (SELECT count(*) FROM documents) AS fetched, (SELECT count(*) FROM news) AS kept, count(*) AS persisted,
(SELECT count(*) FROM documents) - count(*) AS duplicate, count(*) FILTER (classification = 'critical') AS critical, count(*) FILTER (classification = 'major') AS major FROM p""",
    "news_score_sql": f"{_DOCS} SELECT doc_id, CAST(news_score AS double) AS news_score FROM d",
    "direction_sentiment": f"{_NEWS} SELECT id, direction, CAST(sentiment AS double) + 0.0 AS sentiment FROM news",
    "surprise_score": f"{_BODY} SELECT id, {S.surprise_columns('body')} FROM b",
    "region_relevance": f"{_BODY} SELECT id, CASE {' '.join(f'WHEN {S.like('body', p)} THEN {S.quote(r)}' for p, r in V.REGIONS)} ELSE 'GLOBAL' END AS region, CAST({S.weighted('body', [(p, 1) for p in V.RELEVANCE])} AS bigint) AS relevance FROM b",
    "scored_news": f"{_NEWS} SELECT id, CAST(news_score AS double) AS news_score, category, region, classification, action, risk_level, source FROM news",
    "quality_score": f"""SELECT doc_id, {S.clamp(f"({_FRESH}) * 0.4 + (40 + CASE WHEN doc_id % 2 <> 0 THEN 35 ELSE 0 END + CASE WHEN doc_id % 3 <> 0 THEN 15 ELSE 0 END + CASE WHEN doc_id % 5 <> 0 THEN 10 ELSE 0 END) * CAST(0.3 AS double) + (doc_id % 101) * CAST(0.3 AS double)")} AS quality FROM documents""",
    "assumption_log": f"""{_NEWS} SELECT id, 'macro_score' AS variable, CAST(25 AS double) AS assumed_value FROM news WHERE NOT known UNION ALL SELECT id, 'reliability_score', 40.0 FROM news WHERE source = 'unknown_source'
UNION ALL SELECT id, 'scoring_input', 0.0 FROM news WHERE coalesce(content, '') = '' UNION ALL SELECT id, 'surprise_score', surprise FROM news WHERE NOT proven""",
    "domain_resolve": rf"""WITH p AS (SELECT page_id, regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1), '^www\.', '') AS host FROM pages),
q AS (SELECT *, CASE WHEN page_id % 3 = 0 THEN 'a.b.' || {S.pick(f"page_id % {len(S.DOMAINS)}", S.DOMAINS)} ELSE host END AS domain FROM p) SELECT page_id, host, source, CAST(reliability AS double) AS reliability FROM (SELECT *, {S.source_columns()} FROM q)""",
    "dedup_best": f"""WITH k AS (SELECT doc_id, n_chars, {_KEY.format('text')} AS k FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n_chars % 50 + CASE WHEN doc_id % 3 = 0 THEN 10 ELSE 0 END DESC, doc_id) AS n FROM k WHERE length(k) >= 8) SELECT doc_id, sha256(k) AS key_hash FROM r WHERE n = 1""",
    "dedup_hash_unique": "SELECT sha256(lower(trim(text))) AS dedup_hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "log_redaction": """SELECT event_id, '{"id":' || event_id || ',"apiKey":"[REDACTED]","nested":{"list":[{"auth_token":"[REDACTED]"},"see ?key=[REDACTED]&x=1"],"note":"Bearer [REDACTED]"}}' AS shown FROM events""",
    "clean_text": f"WITH c AS (SELECT page_id, {_clean_sql()} AS t FROM pages) SELECT page_id, CASE WHEN length(t) > 300 THEN rtrim(left(t, 299)) || '…' WHEN length(t) > 0 THEN t END AS cleaned FROM c",
    "news_high_impact": f"{_NEWS} SELECT id, classification, CAST(news_score AS double) AS news_score FROM news WHERE classification IN ('major', 'critical') AND ts > {S.AS_OF} - INTERVAL 48 HOUR",
    "news_actionable": f"{_NEWS} SELECT id, action, CAST(news_score AS double) AS news_score FROM news WHERE action <> 'ARCHIVE_ONLY' AND ts > {S.AS_OF} - INTERVAL 24 HOUR",
    "news_pending": f"{_LEDGER} SELECT id, notify_attempts FROM l WHERE {_PENDING}",
    "news_stuck": f"{_LEDGER} SELECT id FROM l WHERE {_PENDING} AND news_score >= 80",
    "class_distribution": f"{_NEWS} SELECT classification, count(*) AS n, CAST(round(min(news_score), 0) AS double) AS least, CAST(round(max(news_score), 0) AS double) AS most FROM news GROUP BY 1",
    "notification_build": f"{_NEWS} SELECT 'news:' || id || ':' || action AS event_id, action AS event_type, id AS news_event_id FROM news WHERE action <> 'ARCHIVE_ONLY'",
    "alert_build": f"{_NEWS}, {_ALERTS} SELECT * FROM m",
    "alert_insert": f"{_NEWS}, {_ALERTS} SELECT DISTINCT dedup_key FROM m WHERE dedup_key NOT IN (SELECT dedup_key FROM m WHERE CAST(news_id AS bigint) % 4 = 0)",
    "news_age_window": f"WITH a AS ({S.ARTICLES_DB}) SELECT id FROM a WHERE ts + INTERVAL 30 MINUTE BETWEEN {S.AS_OF} - INTERVAL 48 HOUR AND {S.AS_OF} + INTERVAL 10 MINUTE",
}
