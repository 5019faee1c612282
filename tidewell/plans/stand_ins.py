"""Relations of the library's domain that are made from the driver's tables, in both dialects, and pieces of SQL for oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
HEADLINES = [
    "Fed rate decision surprises markets as FOMC cuts rates - Reuters", "CPI came in at 4.0% vs 3.1% expected, hotter than expected", "Nonfarm payrolls beat forecasts in jobs report",
    "War escalation drives safe haven demand for gold", "Sanctions and embargo on Russia widen", "Bank failure sparks banking crisis and contagion fears", "Central banks bought record gold, bullion rallies",
    "Debt ceiling standoff and downgrade risk for Treasury", "Tariffs and trade talks with China stall", "GDP shrinks as recession fears rise in Germany", "Retail sales unexpectedly drop, PPI lower than expected",
    "Jobless claims rise to 250 versus forecast of 210", "Treasury yields fall as bond market rallies", "Dollar index slips, greenback weakness", "OPEC output lifts crude, oil price jumps",
    "PMI misses expectations, consumer confidence fades", "Election vote in Japan weighs on yen", "ETF outflow and net short positioning in gold", "Local weather stays mild this weekend", "Ceasefire and peace talks end the truce dispute in Gaza",
    "Powell hawkish at Jackson Hole, yields surge", "Gold falls as risk-on rally in stocks lifts record equity highs", "PCE inflation eases, cooler than expected", "Emergency intermeeting rate cut shocks markets; breaking news",
]
DOMAINS = ["www.reuters.com", "markets.ft.com", "uk.finance.yahoo.com", "example.org", "kitco.com", "blog.unknown.net", "news.treasury.gov"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of() -> Column:
    return F.expr(AS_OF)


def quote(x: object) -> str:
    return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"


def pick(index: str, items: list[str]) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN {quote(x)}" for i, x in enumerate(items)) + " END"


ARTICLES = f"""SELECT CAST(doc_id AS string) AS id, doc_id AS ordinal, concat({pick(f"doc_id % {len(HEADLINES)}", HEADLINES)}, ' ', left(text, 0)) AS title,
  CASE WHEN doc_id % 5 = 0 THEN NULL ELSE text END AS content, {pick(f"doc_id % {len(DOMAINS)}", DOMAINS)} AS domain,
  TIMESTAMP '2024-01-31 00:00:00' - make_interval(0, 0, 0, 0, 0, doc_id % 4000, 0) AS ts FROM documents"""
ARTICLES = ARTICLES.replace(", ' ', left(text, 0)", "")
ARTICLES_DB = ARTICLES.replace("AS string", "AS varchar").replace("make_interval(0, 0, 0, 0, 0, doc_id % 4000, 0)", "to_minutes(doc_id % 4000)")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: a headline by id, the whole text as body for four of five, a publisher's domain, a time."""
    return spark.sql(ARTICLES.replace("FROM documents", "FROM {docs}"), docs=read(spark, sf_dir, "documents"))


# pieces of oracle SQL


def like(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {quote('(?i)' + pattern)})"


def weighted(text: str, lexicon: list[tuple[str, int]]) -> str:
    return "(" + " + ".join(f"CASE WHEN {like(text, p)} THEN {w} ELSE 0 END" for p, w in lexicon) + ")"


def clamp(x: str) -> str:
    return f"floor(least(100.0, greatest(0.0, {x})) * 100 + 0.5) / 100"


def catalyst_columns(text: str) -> str:
    """Columns macro, volatility, duration, category, bias, cancelling, known of the catalysts that match."""
    hit = [like(text, r[0]) for r in V.CATALYSTS]
    most = lambda k: f"coalesce(list_max([{', '.join(f'CASE WHEN {h} THEN {r[k]} END' for h, r in zip(hit, V.CATALYSTS))}]), {V.DEFAULT_CATALYST[k - 1]})"
    ranked = sorted(range(len(hit)), key=lambda i: (-V.CATALYSTS[i][1], i))
    category = "CASE " + " ".join(f"WHEN {hit[i]} THEN {quote(V.CATALYSTS[i][4])}" for i in ranked) + " ELSE 'other' END"
    bias = "CASE " + " ".join(f"WHEN {hit[i]} THEN {quote(r[5])}" for i, r in enumerate(V.CATALYSTS) if r[5]) + " END"
    factors = "concat_ws('|', " + ", ".join(f"CASE WHEN {h} THEN {quote('|'.join(r[6]))} END" for h, r in zip(hit, V.CATALYSTS)) + ")"
    return f"{most(1)} AS macro, {most(2)} AS volatility, {most(3)} AS duration, {category} AS category, {bias} AS bias, {factors} AS cancelling, ({' OR '.join(hit)}) AS known"


def channel_columns(text: str) -> str:
    """Columns channel and impact_duration of the dominant catalyst."""
    ranked = sorted(range(len(V.CATALYSTS)), key=lambda i: (-V.CATALYSTS[i][1], i))
    column = lambda k: "CASE " + " ".join(f"WHEN {like(text, V.CATALYSTS[i][0])} THEN {quote(V.CHANNELS[i][k])}" for i in ranked) + f" ELSE {quote(V.DEFAULT_CHANNEL[k])} END"
    return f"{column(0)} AS channel, {column(1)} AS impact_duration"


def surprise_columns(text: str) -> str:
    a, b = (f"try_cast(replace(regexp_extract({text}, {quote('(?i)' + V.NUMBER_PAIR)}, {i}), ',', '.') AS double)" for i in (1, 2))
    by_number, terms = f"CASE WHEN {b} <> 0 THEN {clamp(f'abs(({a} - {b}) / {b}) * 333')} END", weighted(text, V.SURPRISE)
    by_terms = f"CASE WHEN {terms} > 0 THEN {clamp(terms)} END"
    return f"coalesce({by_number}, {by_terms}, CASE WHEN {like(text, V.SCHEDULED)} THEN 50.0 ELSE 25.0 END) AS surprise, coalesce({by_number}, {by_terms}) IS NOT NULL AS proven"


def source_columns() -> str:
    """Columns source and reliability for `domain`: longest registered suffix of two labels or more."""
    known = sorted((s for s in V.SOURCES if s[1]), key=lambda s: -len(s[1]))
    ends = [f"WHEN domain = {quote(d)} OR ends_with(domain, {quote('.' + d)}) THEN " for _, d, _ in known]
    return "CASE " + " ".join(e + quote(s[0]) for e, s in zip(ends, known)) + " ELSE 'unknown_source' END AS source, CASE " + " ".join(e + f"{s[2]:.1f}" for e, s in zip(ends, known)) + " ELSE 40.0 END AS reliability"


TEXT = "concat_ws(' ', title, coalesce(content, ''))"
SCORE = "CAST(round(0.30 * CAST(macro AS decimal(6,2)) + 0.20 * CAST(volatility AS decimal(6,2)) + 0.15 * CAST(reliability AS decimal(6,2)) + 0.20 * CAST(surprise AS decimal(6,2)) + 0.15 * CAST(duration AS decimal(6,2)), 2) AS decimal(6,2))"
CLASS = "CASE WHEN news_score >= 80 THEN 'critical' WHEN news_score >= 60 THEN 'major' ELSE 'noise' END"
ACTION = "CASE WHEN news_score >= 80 THEN 'RECALC_H1_H2' WHEN news_score >= 60 THEN 'REEVALUATE_H3' ELSE 'ARCHIVE_ONLY' END"
RISK = "CASE WHEN category IN ('geopolitics', 'financial_stability') THEN CASE WHEN news_score >= 80 THEN 'CRITICAL' WHEN news_score >= 65 THEN 'HIGH' WHEN news_score >= 45 THEN 'MEDIUM' ELSE 'LOW' END END"


def scored_sql() -> str:
    """CTEs that end in `news`, the scored articles."""
    relevant = " + ".join(f"CASE WHEN {like('body', p)} THEN 1 ELSE 0 END" for p in V.RELEVANCE)
    bull, bear = weighted("body", V.BULLISH), weighted("body", V.BEARISH)
    region = "CASE " + " ".join(f"WHEN {like('body', p)} THEN {quote(r)}" for p, r in V.REGIONS) + " ELSE 'GLOBAL' END"
    return f"""a AS ({ARTICLES_DB}), b AS (SELECT *, {TEXT} AS body FROM a), c AS (SELECT * FROM b WHERE {relevant} >= 1),
d AS (SELECT *, {catalyst_columns('body')}, {surprise_columns('body')}, {region} AS region, {source_columns()} FROM c),
e AS (SELECT *, {bull} + CASE WHEN bias = 'bullish' THEN 2 ELSE 0 END AS bull, {bear} + CASE WHEN bias = 'bearish' THEN 2 ELSE 0 END AS bear, {SCORE} AS news_score FROM d),
news AS (SELECT *, {CLASS} AS classification, {ACTION} AS action, {RISK} AS risk_level,
  CASE WHEN bull - bear >= 2 THEN 'bullish' WHEN bull - bear <= -2 THEN 'bearish' ELSE 'neutral' END AS direction,
  CASE WHEN bull + bear = 0 THEN 0.0 ELSE floor(-(bull - bear) / CAST(bull + bear AS double) * 1000 + 0.5) / 1000 END AS sentiment FROM e)"""


POINTS = """SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'XAUUSD' WHEN 'view' THEN 'US10Y' WHEN 'signup' THEN 'US10YR' WHEN 'purchase' THEN 'VIX' ELSE 'WTI' END AS symbol, ts,
  CASE WHEN event_id % 41 = 0 THEN NULL WHEN event_id % 37 = 0 THEN -value WHEN event_type = 'click' THEN value + 200 WHEN event_type IN ('view', 'signup') THEN value / 20 ELSE value END AS value,
  CASE WHEN event_id % 43 = 0 THEN TIMESTAMP '2024-02-03 00:00:00' WHEN event_id % 47 = 0 THEN NULL ELSE ts END AS observed_at,
  CASE WHEN event_id % 3 = 0 THEN value + 199 END AS open, CASE WHEN event_id % 3 = 0 THEN value + 201 END AS high, CASE WHEN event_id % 3 = 0 THEN value + 198 + event_id % 4 END AS low,
  CASE WHEN event_id % 7 = 0 THEN event_id % 5 - 0.5 END AS bid, CASE WHEN event_id % 7 = 0 THEN event_id % 11 - 0.5 END AS ask, user_id FROM events"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as market points with planted faults."""
    return spark.sql(POINTS.replace("FROM events", "FROM {ev}"), ev=read(spark, sf_dir, "events"))


#: Rows for the rules of each table but market_ticks, made from every event: columns in SQL of both dialects.
RULE_ROWS = {
    "instruments": "case event_id % 9 when 0 then 'x' when 1 then 'Eur' else event_type end as symbol, event_id % 5 as tick_size, event_id % 11 - 1 as price_decimals",
    "data_sources": "case when event_id % 4 = 0 then 'Feed' when event_id % 4 = 1 then null else event_type end as code",
    "news_events": "case event_id % 13 when 0 then '  ' when 1 then null else event_type end as title, case event_id % 5 when 0 then 'ftp://x' when 1 then null else 'HTTPS://x' end as source_url,"
    " (event_id % 7 - 3) / 2.5 as sentiment, event_id % 103 as macro_score, event_id % 102 as quality_score, event_id % 9 - 1 as notify_attempts",
    "ai_scenarios": "event_id % 13 / 10.0 as probability, event_id % 12 / 10.0 as confidence, case event_id % 3 when 0 then 'bullish' when 1 then 'bearish' else 'neutral' end as direction, event_id % 17 as target, event_id % 5 as invalidation,"
    " case event_id % 6 when 0 then null when 1 then ' short ' else 'a reason of some length' end as reasoning, case when event_id % 8 = 0 then 'soon' else 'a close above the level' end as activation_condition",
    "ai_analyses": "case when event_id % 8 = 0 then ts else ts + interval 1 hour end as valid_until, ts as analysis_ts, case when event_id % 3 = 0 then event_id end as tick_id, case when event_id % 6 = 0 then ts end as tick_ts,"
    " case when event_id % 9 = 0 then 'no version' else 'model-1.0' end as model_version, case event_id % 4 when 0 then 'REJECTED' when 1 then 'APPROVED' when 2 then null else 'CONFLICT' end as risk_verdict,"
    " case event_id % 5 when 0 then array() when 1 then null else array('x') end as rejection_reasons, case when event_id % 7 < 3 then 'VALID_SETUP' else 'NO_VALID_SETUP' end as execution_status,"
    " case event_id % 10 when 0 then 'bullish' when 1 then null else 'neutral' end as overall_bias, event_id % 23 / 20.0 as confidence_cap",
    "alerts": "case event_id % 4 when 0 then 'triggered' when 1 then 'acknowledged' when 2 then 'resolved' else 'pending' end as status, case when event_id % 5 > 0 then ts end as triggered_at, case when event_id % 6 > 0 then ts end as acknowledged_at,"
    " case when event_id % 7 > 0 then ts end as resolved_at, case when event_id % 11 = 0 then ts + interval 1 hour else ts end as created_at, case event_id % 3 when 0 then '[1]' when 1 then null else '{}' end as trigger",
    "ingestion_runs": "ts as started_at, case event_id % 3 when 0 then ts - interval 1 hour when 1 then null else ts end as finished_at, event_id % 5 - 1 as fetched, event_id % 7 as persisted",
    "ai_events": "case when event_id % 3 = 0 then '' else event_type end as event_id, case event_id % 4 when 0 then 'PROCESSED' when 1 then 'RUNNING' else 'FAILED' end as status, case when event_id % 5 = 0 then 'a' end as analysis_id, case when event_id % 6 > 0 then ts end as finished_at",
    "performance_scorecard": "event_id % 13 / 10.0 as accuracy, event_id % 12 / 10.0 as brier_score, event_id % 5 - 2 as model_drift, event_id % 9 - 1 as sample_size",
}


def rules_sql(table: str, rules: list[tuple[str, str]]) -> str:
    """Count of broken rows by rule, over the table's rows."""
    rows = RULE_ROWS[table].replace("array()", "CAST([] AS varchar[])").replace("array('x')", "['x']")
    swaps = [("coalesce(source_url rlike '(?i)^https?://', true)", "coalesce(regexp_matches(source_url, '(?i)^https?://'), true)"), ("model_version rlike '^[a-zA-Z0-9._-]+$'", "regexp_matches(model_version, '^[a-zA-Z0-9._-]+$')"),
        ("isnull(tick_id) = isnull(tick_ts)", "(tick_id IS NULL) = (tick_ts IS NULL)"), ("size(rejection_reasons)", "len(rejection_reasons)"), ("json_object_keys(trigger) is not null", "coalesce(json_type(trigger) = 'OBJECT', false)")]
    parts = []
    for name, condition in rules:
        for spark, duck in swaps:
            condition = condition.replace(spark, duck)
        parts.append(f"SELECT '{table}' AS table_name, '{name}' AS rule, count(*) FILTER (({condition}) IS FALSE) AS n FROM (SELECT {rows} FROM events)")
    return " UNION ALL ".join(parts)
