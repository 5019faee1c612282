"""Queries of the committee operators and the analysis views over stand-in relations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions import values as V
from ..operators import committee, constraints, display, views
from . import stand_ins as S

#: One scenario for each order line, lines of one number made one; SQL that both dialects read.
SCENARIOS = """SELECT l_orderkey AS analysis_id, concat('H', CAST(1 + l_linenumber % 4 AS {text})) AS horizon, min(CASE l_returnflag WHEN 'A' THEN 'bullish' WHEN 'R' THEN 'bearish' ELSE 'neutral' END) AS direction,
  max(l_quantity * 2.5 - 10) AS probability, max(l_extendedprice) AS target, min(CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_extendedprice * (0.8 + l_discount * 4) END) AS invalidation, max(l_extendedprice) * 0.97 AS spot,
  min(CASE WHEN l_suppkey % 17 = 0 THEN 'court' WHEN l_suppkey % 19 = 0 THEN 'LEGACY: carried over from before' ELSE 'breaks above the level on volume' END) AS activation_condition,
  min(CASE WHEN l_partkey % 11 = 0 THEN 'too short' ELSE 'yields fall while the dollar weakens' END) AS reasoning, max(l_quantity * 3) AS confidence
FROM lineitem GROUP BY 1, 2"""


def _scenarios(spark, sf_dir):
    return spark.sql(SCENARIOS.format(text="string").replace("FROM lineitem", "FROM {li}"), li=S.read(spark, sf_dir, "lineitem"))


def _checked(spark, sf_dir):
    return committee.scenario_errors(_scenarios(spark, sf_dir), F.col("spot"))


def risk_reward(spark, sf_dir):
    s = _scenarios(spark, sf_dir)
    return s.select("analysis_id", "horizon", F.round(scoring.risk_reward(F.col("spot"), F.col("target"), F.col("invalidation")), 6).alias("ratio"))


def scenario_validation(spark, sf_dir):
    return _checked(spark, sf_dir).select("analysis_id", "horizon", F.concat_ws(",", "errors").alias("errors"))


def output_validation(spark, sf_dir):
    checked = _checked(spark, sf_dir).withColumn("v", F.expr("case analysis_id % 7 when 0 then 'REJECTED' when 1 then 'CONFLICT' when 2 then 'MAYBE' else 'APPROVED' end"))
    return committee.output_verdict(checked, F.col("v"))


def blocked_analyses(spark, sf_dir):
    checked = _checked(spark, sf_dir).withColumn("v", F.expr("case analysis_id % 7 when 0 then 'REJECTED' else 'APPROVED' end"))
    spots = checked.groupBy("analysis_id").agg(F.round(F.max("spot"), 6).alias("spot"))
    return committee.blocked_rows(committee.output_verdict(checked, F.col("v")).join(spots, "analysis_id")).select("analysis_id", "horizon", "direction", "probability", "target", "confidence")


def _weights(spark, sf_dir):
    return S.read(spark, sf_dir, "events").groupBy((F.col("user_id")).alias("analysis_id"), F.concat(F.lit("H"), (F.col("event_id") % 4 + 1).cast("string")).alias("horizon")).agg(F.sum(F.col("event_id") % 10).cast("double").alias("probability"))


def largest_remainder(spark, sf_dir):
    return committee.largest_remainder(_weights(spark, sf_dir), "analysis_id", "horizon", "probability").select("analysis_id", "horizon", "share")


def scoped_budget(spark, sf_dir):
    base = committee.largest_remainder(_weights(spark, sf_dir), "analysis_id", "horizon", "probability").select("analysis_id", "horizon", F.col("share").alias("probability"))
    new = _weights(spark, sf_dir).withColumn("probability", F.pmod(F.col("probability") * 7, F.lit(100.0)))
    return committee.scoped_merge(new, base, "H1_H2")


def confidence_cap(spark, sf_dir):
    d = S.read(spark, sf_dir, "events")
    share = F.round(scoring.confidence(F.when(F.col("event_id") % 9 != 0, F.col("value") / F.when(F.col("event_id") % 2 == 0, 500.0).otherwise(4.0))), 6)
    return d.select("event_id", share.alias("share"), committee.capped((F.col("event_id") % 101).cast("int"), (F.col("event_id") % 10) / F.lit(10.0)).alias("capped"))


def event_validation(spark, sf_dir):
    e = S.read(spark, sf_dir, "events").selectExpr("event_id as n", "case when event_id % 5 = 0 then ' ' when event_id % 23 = 0 then repeat('x', 201) else cast(event_id as string) end as event_id", "case when event_id % 7 = 0 then 'OTHER' else 'RECALC_H1_H2' end as event_type",
        "case when event_id % 11 = 0 then null else 'news' end as source", "case when event_id % 13 = 0 then 'soon' else '2024-01-01T00:00:00Z' end as at", "case event_id % 3 when 0 then 'not-an-id' when 1 then '0f8fad5b-d9cb-469f-a165-70867728950e' end as news_event_id",
        "case when event_id % 4 = 0 then value else null end as news_score")
    from ..functions import text

    return committee.event_errors(e, text.parse_time(F.col("at"))).select("n", F.concat_ws(",", "errors").alias("errors"))


def scope_resolution(spark, sf_dir):
    d = S.read(spark, sf_dir, "events").withColumn("t", F.expr("case event_id % 3 when 0 then 'RECALC_H1_H2' when 1 then 'REEVALUATE_H3' else 'FULL' end"))
    return d.select("event_id", committee.scope_of(F.col("t"), F.col("event_id") % 5 != 0).alias("scope"))


def bridge_weights(spark, sf_dir):
    links = S.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("analysis_id"), F.col("l_partkey").alias("news_id")).distinct()
    return committee.bridge(links).withColumn("weight", F.col("weight").cast("double"))


def probability_sum_check(spark, sf_dir):
    s = S.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("analysis_id"), "l_linenumber").agg(F.max("l_discount").alias("probability"))
    return constraints.probability_sums(s).select("analysis_id", F.round("total", 6).alias("total"))


def legacy_tradable(spark, sf_dir):
    return _scenarios(spark, sf_dir).groupBy(display.tradable(F.col("activation_condition")).alias("is_tradable")).agg(F.count("*").alias("n"))


def displayable(spark, sf_dir):
    return display.displayable(_scenarios(spark, sf_dir)).select("analysis_id", "horizon")


def _analyses(spark, sf_dir):
    return S.read(spark, sf_dir, "orders").selectExpr("o_orderkey as analysis_id", "cast(o_custkey as string) as symbol", "cast(o_orderdate as timestamp) as analysis_ts",
        "case when o_orderkey % 3 = 0 then timestamp '2000-01-01 00:00:00' when o_orderkey % 3 = 1 then timestamp '2100-01-01 00:00:00' end as valid_until")


def _shown(latest):
    return latest.select("symbol", "analysis_id", F.explode_outer("scenarios").alias("horizon", "s")).select("symbol", "analysis_id", "horizon", "s.direction")


def ai_latest(spark, sf_dir):
    return _shown(views.ai_latest(_analyses(spark, sf_dir), _scenarios(spark, sf_dir), S.as_of()))


def ai_latest_then_filter(spark, sf_dir):
    return _shown(views.ai_latest(_analyses(spark, sf_dir), _scenarios(spark, sf_dir), S.as_of(), latest_then_filter=True))


def agent_replies(spark, sf_dir):
    raw = S.read(spark, sf_dir, "events").selectExpr("event_id as analysis_id", "case when event_id % 2 = 0 then 'risk' else 'macro' end as agent", """concat('```json\n', case event_id % 4 when 0 then '{"verdict":"APPROVED","confidence":72,"overall_bias":"Bullish","missing_data":["dxy"]}'
        when 1 then '{"verdict":"PERHAPS","confidence":0.4,"key_supports":[3380.5,3400]}' when 2 then '{"confidence_cap":1.7,"overall_bias":"sideways"}' else '{}' end, '\n```') as reply_json""")
    r = committee.coerce_replies(raw)
    return r.select("analysis_id", "agent", "verdict", "confidence", "confidence_cap", "overall_bias", F.size("missing_data").alias("n_missing"), F.size("key_supports").alias("n_supports"))


def verdict_backfill(spark, sf_dir):
    j = S.read(spark, sf_dir, "events").selectExpr("event_id", """case event_id % 3 when 0 then '{"verdict":"REJECTED"}' when 1 then '{"verdict":"odd"}' else '{}' end as ctx""")
    return j.select("event_id", committee.backfilled_verdict(F.col("ctx")).alias("risk_verdict"))


def severity_order(spark, sf_dir):
    a = S.read(spark, sf_dir, "events").select("event_id", F.expr("case event_id % 5 when 0 then 'critical' when 1 then 'info' when 2 then 'high' when 3 then 'low' else 'medium' end").alias("severity"))
    rank = F.row_number().over(Window.partitionBy(F.col("event_id") % 100).orderBy(constraints.ordinal(F.col("severity"), V.DOMAINS["severity"]).desc(), "event_id"))
    return a.withColumn("rank", rank).where("rank <= 3")


def scorecard_ext(spark, sf_dir):
    p = S.read(spark, sf_dir, "lineitem").selectExpr("l_linestatus as horizon", "l_discount * 10 as p", "case when l_returnflag = 'A' then 1.0 else 0.0 end as y")
    return committee.scorecard(p, "horizon").select("horizon", F.round("accuracy", 6).alias("accuracy"), F.round("brier_score", 6).alias("brier"), "sample_size")


def calibration_ext(spark, sf_dir):
    p = S.read(spark, sf_dir, "lineitem").selectExpr("l_linestatus as horizon", "l_linenumber % 7 as part", "l_discount * 10 as p", "case when l_returnflag = 'A' then 1.0 else 0.0 end as y")
    return committee.scorecard(p, "horizon", "part").select("horizon", "part", F.round("calibration", 6).alias("calibration"), "sample_size")


def drift_ext(spark, sf_dir):
    p = S.read(spark, sf_dir, "events").selectExpr("user_id", "event_id % 2 as half", "0.5 as p", "case when value > 40 then 1.0 else 0.0 end as y")
    now, before = (committee.scorecard(p.where(F.col("half") == h), "user_id") for h in (0, 1))
    return committee.drift_alerts(now, before, "user_id").select("user_id", F.round("drift", 6).alias("drift"), "alert_type")


def _outcomes(spark, sf_dir):
    return S.read(spark, sf_dir, "events").selectExpr(
        "concat('model-', user_id % 3) as model_version", "'d1' as evaluation_window", "concat('H', 1 + event_id % 4) as horizon", "cast(ts as date) as evaluation_date", "event_id % 11 / 10.0 as p",
        "if(value > 40, 1, 0) as y", "event_id % 3 > 0 as direction_ok", "event_id % 5 > 0 as timing_ok", "event_id % 7 > 0 as risk_ok")


def scorecard_daily(spark, sf_dir):
    cards = committee.daily_cards(_outcomes(spark, sf_dir))
    stale = cards.where("day(evaluation_date) % 2 = 0").withColumn("prediction_accuracy", F.lit(-1.0))  # written by an earlier evaluation of these days
    now = committee.upsert_cards(stale, cards)
    shown = ["prediction_accuracy", "direction_accuracy", "probability_calibration", "timing_accuracy", "risk_accuracy", "brier_score", "model_drift"]
    return now.select("model_version", "evaluation_window", "horizon", F.date_format("evaluation_date", "yyyy-MM-dd").alias("evaluation_date"), *[F.round(c, 6).alias(c) for c in shown], "sample_size", (F.abs("model_drift") > V.MAX_DRIFT).alias("degraded"))


def cap_policy_ext(spark, sf_dir):
    missing = (F.col("event_id") % 6).cast("int")
    cap = committee.confidence_cap_policy(F.col("value") < 1, missing, F.col("event_id") % 8 == 0, F.col("event_id") % 9 == 0)
    return S.read(spark, sf_dir, "events").select("event_id", cap.alias("cap"))


QUERIES = {f.__name__: f for f in (
    risk_reward, scenario_validation, output_validation, blocked_analyses, largest_remainder, scoped_budget, confidence_cap, event_validation, scope_resolution, bridge_weights, probability_sum_check, legacy_tradable, displayable,
    ai_latest, ai_latest_then_filter, agent_replies, verdict_backfill, severity_order, scorecard_ext, cap_policy_ext, calibration_ext, drift_ext, scorecard_daily,
)}

_S = f"s AS ({SCENARIOS.format(text='varchar')})"
_RATIO = "CASE WHEN abs(spot - invalidation) >= 1e-9 THEN abs(target - spot) / abs(spot - invalidation) END"
_STRUCTURAL = """nullif(concat_ws(',', CASE WHEN length(trim(reasoning)) < 20 THEN 'reasoning' END, CASE WHEN NOT probability BETWEEN 0 AND 100 THEN 'probability' END, CASE WHEN length(trim(activation_condition)) < 15 THEN 'activation' END,
  CASE WHEN invalidation IS NULL OR invalidation <= 0 THEN 'invalidation' END, CASE WHEN target IS NULL OR target <= 0 THEN 'target' END), '')"""
_DERIVED = f"""concat_ws(',', CASE WHEN (direction = 'bullish' AND target <= invalidation) OR (direction = 'bearish' AND target >= invalidation) THEN 'geometry' END,
  CASE WHEN direction <> 'neutral' AND {_RATIO} IS NULL THEN 'ratio_undefined' END, CASE WHEN direction <> 'neutral' AND {_RATIO} < 1 THEN 'ratio' END)"""
_E = f"WITH {_S}, e AS (SELECT *, coalesce({_STRUCTURAL}, {_DERIVED}) AS errors FROM s)"


def _verdict(cases: str) -> str:
    return f"""v AS (SELECT analysis_id, count(DISTINCT horizon) = 4 AND max(length(errors)) = 0 AS valid, CASE WHEN {cases} IN ('APPROVED', 'APPROVED_WITH_CONDITIONS', 'REJECTED', 'DATA_INSUFFICIENT', 'CONFLICT') THEN {cases} ELSE 'DATA_INSUFFICIENT' END AS risk_verdict, max(spot) AS spot FROM e GROUP BY analysis_id),
b AS (SELECT *, NOT valid OR risk_verdict IN ('REJECTED', 'DATA_INSUFFICIENT', 'CONFLICT') AS blocked FROM v)"""


_W = "w AS (SELECT user_id AS analysis_id, 'H' || (event_id % 4 + 1) AS horizon, CAST(sum(event_id % 10) AS double) AS p FROM events GROUP BY 1, 2)"


def _shares(src: str, budget: str, name: str) -> str:
    return f"""{name}1 AS (SELECT *, CASE WHEN sum(p) OVER k > 0 THEN p / sum(p) OVER k * {budget} ELSE {budget} / CAST(count(*) OVER k AS double) END AS x FROM {src} WINDOW k AS (PARTITION BY analysis_id)),
{name}2 AS (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY x - floor(x) DESC, horizon) AS n, {budget} - sum(floor(x)) OVER (PARTITION BY analysis_id) AS spare FROM {name}1),
{name} AS (SELECT analysis_id, horizon, CAST(floor(x) + CASE WHEN n <= spare THEN 1 ELSE 0 END AS int) AS share FROM {name}2)"""


_LATEST = """a AS (SELECT o_orderkey AS analysis_id, CAST(o_custkey AS varchar) AS symbol, o_orderdate AS t, o_orderkey % 3 <> 0 AS ok FROM orders)"""
_SHOW = "SELECT l.symbol, l.analysis_id, s.horizon, s.direction FROM l LEFT JOIN s ON s.analysis_id = l.analysis_id"
ORACLE_SQL = {
    "risk_reward": f"WITH {_S} SELECT analysis_id, horizon, round({_RATIO}, 6) AS ratio FROM s",
    "scenario_validation": f"{_E} SELECT analysis_id, horizon, errors FROM e",
    "output_validation": f"""{_E}, {_verdict("CASE analysis_id % 7 WHEN 0 THEN 'REJECTED' WHEN 1 THEN 'CONFLICT' WHEN 2 THEN 'MAYBE' ELSE 'APPROVED' END")}
SELECT analysis_id, valid, risk_verdict, blocked, CASE WHEN blocked THEN 'NO_VALID_SETUP' ELSE 'VALID_SETUP' END AS execution_status, CAST(CASE WHEN blocked THEN 90 ELSE 360 END AS int) AS valid_minutes,
CASE WHEN NOT valid THEN 'validation' WHEN blocked THEN lower(risk_verdict) END AS reason FROM b""",
    "blocked_analyses": f"""{_E}, {_verdict("CASE analysis_id % 7 WHEN 0 THEN 'REJECTED' ELSE 'APPROVED' END")}
SELECT analysis_id, h AS horizon, 'neutral' AS direction, CAST(25 AS int) AS probability, round(spot, 6) AS target, CAST(0 AS int) AS confidence FROM b, (VALUES ('H1'), ('H2'), ('H3'), ('H4')) t(h) WHERE blocked""",
    "largest_remainder": f"WITH {_W}, {_shares('w', '100', 'r')} SELECT * FROM r",
    "scoped_budget": f"""WITH {_W}, {_shares('w', '100', 'r')}, j AS (SELECT w.analysis_id, w.horizon, (p * 7) % 100 AS p, share AS base, horizon IN ('H1', 'H2') AS inside FROM w JOIN r USING (analysis_id, horizon)),
i AS (SELECT *, sum(CASE WHEN inside THEN base ELSE 0 END) OVER (PARTITION BY analysis_id) AS budget FROM j), f AS (SELECT * FROM i WHERE inside), {_shares('f', 'budget', 'q')}
SELECT analysis_id, horizon, share AS probability FROM q UNION ALL SELECT analysis_id, horizon, base FROM i WHERE NOT inside""",
    "confidence_cap": """WITH x AS (SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN value / CASE WHEN event_id % 2 = 0 THEN 500.0 ELSE 4.0 END END AS c FROM events)
SELECT event_id, round(least(1.0, greatest(0.0, CASE WHEN coalesce(c, 0.5) > 1 THEN c / 100 ELSE coalesce(c, 0.5) END)), 6) AS share, CAST(least(event_id % 101, (event_id % 10) * 10) AS int) AS capped FROM x""",
    "event_validation": """SELECT event_id AS n, concat_ws(',', CASE WHEN event_id % 5 = 0 THEN 'event_id_missing' END, CASE WHEN event_id % 5 <> 0 AND event_id % 23 = 0 THEN 'event_id_long' END, CASE WHEN event_id % 7 = 0 THEN 'event_type' END, CASE WHEN event_id % 11 = 0 THEN 'source' END,
CASE WHEN event_id % 13 = 0 THEN 'triggered_at' END, CASE WHEN event_id % 3 = 0 THEN 'news_event_id' END, CASE WHEN event_id % 4 = 0 AND NOT value BETWEEN 0 AND 100 THEN 'news_score' END) AS errors FROM events""",
    "scope_resolution": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'FULL' WHEN event_id % 3 = 0 THEN 'H1_H2' WHEN event_id % 3 = 1 THEN 'H3' ELSE 'FULL' END AS scope FROM events",
    "bridge_weights": "WITH d AS (SELECT DISTINCT l_orderkey AS analysis_id, l_partkey AS news_id FROM lineitem) SELECT analysis_id, news_id, round(CAST(1 AS double) / count(*) OVER (PARTITION BY analysis_id), 4) AS weight FROM d",
    "probability_sum_check": "WITH s AS (SELECT l_orderkey, l_linenumber, max(l_discount) AS p FROM lineitem GROUP BY 1, 2) SELECT l_orderkey AS analysis_id, round(sum(p), 6) AS total FROM s GROUP BY 1 HAVING count(*) = 4 AND abs(sum(p) - 1) > 0.01",
    "legacy_tradable": f"WITH {_S} SELECT activation_condition NOT LIKE 'LEGACY:%' AS is_tradable, count(*) AS n FROM s GROUP BY 1",
    "displayable": f"WITH {_S} SELECT analysis_id, horizon FROM s WHERE target IS NOT NULL AND invalidation IS NOT NULL AND probability IS NOT NULL AND length(trim(activation_condition)) >= 15",
    "ai_latest": f"WITH {_S}, {_LATEST}, l AS (SELECT * FROM a WHERE ok QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY t DESC, analysis_id DESC) = 1) {_SHOW}",
    "ai_latest_then_filter": f"WITH {_S}, {_LATEST}, n AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY t DESC, analysis_id DESC) = 1), l AS (SELECT * FROM n WHERE ok) {_SHOW}",
    "agent_replies": """SELECT event_id AS analysis_id, CASE WHEN event_id % 2 = 0 THEN 'risk' ELSE 'macro' END AS agent, CASE WHEN event_id % 4 = 0 THEN 'APPROVED' WHEN event_id % 2 = 0 THEN 'DATA_INSUFFICIENT' END AS verdict,
CAST(CASE event_id % 4 WHEN 0 THEN 0.72 WHEN 1 THEN 0.4 ELSE 0.5 END AS double) AS confidence, CAST(CASE event_id % 4 WHEN 2 THEN 1.0 ELSE 0.0 END AS double) AS confidence_cap, CASE WHEN event_id % 4 = 0 THEN 'bullish' ELSE 'neutral' END AS overall_bias,
CAST(CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS int) AS n_missing, CAST(CASE WHEN event_id % 4 = 1 THEN 2 ELSE 0 END AS int) AS n_supports FROM events""",
    "verdict_backfill": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'REJECTED' END AS risk_verdict FROM events",
    "severity_order": """WITH a AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'info' WHEN 2 THEN 'high' WHEN 3 THEN 'low' ELSE 'medium' END AS severity, CASE event_id % 5 WHEN 0 THEN 5 WHEN 1 THEN 1 WHEN 2 THEN 4 WHEN 3 THEN 2 ELSE 3 END AS o FROM events)
SELECT event_id, severity, CAST(row_number() OVER (PARTITION BY event_id % 100 ORDER BY o DESC, event_id) AS int) AS rank FROM a QUALIFY rank <= 3""",
    "scorecard_ext": """WITH p AS (SELECT l_linestatus AS horizon, l_discount * 10 AS p, CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END AS y FROM lineitem)
SELECT horizon, round(avg(CAST(y AS double)), 6) AS accuracy, round(avg((p - CAST(y AS double)) * (p - CAST(y AS double))), 6) AS brier, count(*) AS sample_size FROM p GROUP BY 1""",
    "cap_policy_ext": """SELECT event_id, CASE WHEN value < 1 THEN 0.2::double ELSE round(greatest(0.2::double, CASE event_id % 6 WHEN 0 THEN 0.9::double WHEN 1 THEN 0.7 WHEN 2 THEN 0.5 ELSE 0.3 END
  - CASE WHEN event_id % 8 = 0 THEN 0.1 ELSE 0 END - CASE WHEN event_id % 9 = 0 THEN 0.1 ELSE 0 END), 2) END AS cap FROM events""",
    "calibration_ext": """SELECT l_linestatus AS horizon, l_linenumber % 7 AS part, round(abs(avg(l_discount * 10) - avg(CASE WHEN l_returnflag = 'A' THEN 1.0::double ELSE 0 END)), 6) AS calibration, count(*) AS sample_size FROM lineitem GROUP BY 1, 2""",
    "drift_ext": """WITH a AS (SELECT user_id, event_id % 2 AS half, avg(CASE WHEN value > 40 THEN 1.0::double ELSE 0 END) AS acc FROM events GROUP BY 1, 2)
SELECT n.user_id, round(n.acc - b.acc, 6) AS drift, 'model_drift' AS alert_type FROM a n JOIN a b ON b.user_id = n.user_id AND n.half = 0 AND b.half = 1 WHERE abs(n.acc - b.acc) > 0.15::double""",
    "scorecard_daily": """WITH o AS (SELECT 'model-' || (user_id % 3) AS model_version, 'd1' AS evaluation_window, 'H' || (1 + event_id % 4) AS horizon, CAST(ts AS date) AS d, (event_id % 11) / 10.0::double AS p, CASE WHEN value > 40 THEN 1.0::double ELSE 0.0 END AS y,
  CASE WHEN event_id % 3 > 0 THEN 1.0::double ELSE 0 END AS a, CASE WHEN event_id % 5 > 0 THEN 1.0::double ELSE 0 END AS b, CASE WHEN event_id % 7 > 0 THEN 1.0::double ELSE 0 END AS c FROM events),
u AS (SELECT * FROM o UNION ALL SELECT model_version, evaluation_window, NULL, d, p, y, a, b, c FROM o),
g AS (SELECT model_version, evaluation_window, horizon, d, avg(y) AS acc, avg(a) AS da, abs(avg(p) - avg(y)) AS cal, avg(b) AS ta, avg(c) AS ra, avg((p - y) * (p - y)) AS br, count(*) AS n FROM u GROUP BY 1, 2, 3, 4),
l AS (SELECT *, acc - coalesce(lag(acc) OVER (PARTITION BY model_version, evaluation_window, horizon ORDER BY d), acc) AS drift FROM g)
SELECT model_version, evaluation_window, horizon, strftime(d, '%Y-%m-%d') AS evaluation_date, round(acc, 6) AS prediction_accuracy, round(da, 6) AS direction_accuracy, round(cal, 6) AS probability_calibration, round(ta, 6) AS timing_accuracy,
  round(ra, 6) AS risk_accuracy, round(br, 6) AS brier_score, round(drift, 6) AS model_drift, n AS sample_size, abs(drift) > 0.15::double AS degraded FROM l""",
}
