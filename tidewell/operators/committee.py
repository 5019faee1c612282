"""Scenario sets: validation, probabilities that sum to 100, scoped merges, blocked analyses, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions import values as V


def scenario_errors(s: DataFrame, spot: Column) -> DataFrame:
    """Adds errors: all structural ones, or only where there are none, those of geometry and of risk against reward."""
    def error(when: Column, name: str) -> Column:
        return F.when(F.coalesce(when, F.lit(True)), name)

    def absent(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | ~(x > 0) | (x == float("inf"))

    direction, target, invalidation = F.coalesce("direction", F.lit("neutral")), F.col("target"), F.col("invalidation")
    structural = F.array_compact(F.array(
        error(F.length(F.trim("reasoning")) < V.MIN_REASONING, "reasoning"), error(~F.col("probability").between(0, 100), "probability"),
        error(F.length(F.trim("activation_condition")) < V.MIN_ACTIVATION, "activation"), error(absent(invalidation), "invalidation"), error(absent(target), "target"),
    ))
    ratio = scoring.risk_reward(spot, target, invalidation)
    wrong = ((direction == "bullish") & (target <= invalidation)) | ((direction == "bearish") & (target >= invalidation))
    derived = F.array_compact(F.array(F.when(wrong, "geometry"), F.when((direction != "neutral") & ratio.isNull(), "ratio_undefined"), F.when((direction != "neutral") & (ratio < V.MIN_RATIO), "ratio")))
    return s.withColumn("errors", F.when(F.size(structural) > 0, structural).otherwise(derived))


def largest_remainder(parts: DataFrame, key: str, ordinal: str, weight: str, total: Column | float = 100) -> DataFrame:
    """Adds share: integers in proportion to `weight` that sum to `total` for each key; equal shares where all weights are 0.

    The largest remainders get the rest; ties go by `ordinal`.
    """
    whole = Window.partitionBy(key)
    budget = F.lit(total) if isinstance(total, (int, float)) else total
    summed = F.sum(weight).over(whole)
    exact = F.when(summed > 0, F.col(weight) / summed * budget).otherwise(budget / F.count("*").over(whole))
    out = parts.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact")).withColumn("_left", budget - F.sum("_floor").over(whole))
    rank = F.row_number().over(whole.orderBy((F.col("_exact") - F.col("_floor")).desc(), F.col(ordinal)))
    return out.withColumn("share", (F.col("_floor") + F.when(rank <= F.col("_left"), 1).otherwise(0)).cast("int")).drop("_exact", "_floor", "_left")


def scoped_merge(recalculated: DataFrame, baseline: DataFrame, scope: str) -> DataFrame:
    """Both have analysis_id, horizon, probability; out of scope the baseline's stay, in scope they share the baseline's budget."""
    inside = F.col("horizon").isin(V.SCOPES[scope])
    base = baseline.withColumnRenamed("probability", "base")
    both = recalculated.join(base, ["analysis_id", "horizon"]).withColumn("in_scope", inside)
    budget = F.sum(F.when(inside, F.col("base")).otherwise(0)).over(Window.partitionBy("analysis_id"))
    scoped = largest_remainder(both.withColumn("_budget", budget).where("in_scope"), "analysis_id", "horizon", "probability", F.col("_budget"))
    kept = both.where("not in_scope").select("analysis_id", "horizon", F.col("base").cast("int").alias("probability"))
    return scoped.select("analysis_id", "horizon", F.col("share").alias("probability")).union(kept)


def output_verdict(scenarios: DataFrame, verdict: Column) -> DataFrame:
    """One row an analysis: valid if all four horizons are there without errors, and blocked by errors or by the verdict.

    An unknown verdict is DATA_INSUFFICIENT; a blocked analysis has no setup, 90 minutes of validity and a reason.
    """
    seen = scenarios.groupBy("analysis_id").agg(F.count_distinct("horizon").alias("horizons"), F.max(F.size("errors")).alias("worst"), F.first(verdict, ignorenulls=True).alias("_v"))
    known = F.coalesce(F.when(F.col("_v").isin(V.DOMAINS["risk_verdict"]), F.col("_v")), F.lit("DATA_INSUFFICIENT"))
    out = seen.withColumns({"valid": (F.col("horizons") == 4) & (F.col("worst") == 0), "risk_verdict": known})
    blocked = ~F.col("valid") | F.col("risk_verdict").isin(V.BLOCKING)
    return out.withColumn("blocked", blocked).select(
        "analysis_id", "valid", "risk_verdict", "blocked", F.when(F.col("blocked"), "NO_VALID_SETUP").otherwise("VALID_SETUP").alias("execution_status"),
        F.when(F.col("blocked"), V.BLOCKED_MINUTES).otherwise(V.VALID_MINUTES).alias("valid_minutes"),
        F.when(~F.col("valid"), "validation").when(F.col("blocked"), F.lower("risk_verdict")).alias("reason"),
    )


def blocked_rows(analyses: DataFrame) -> DataFrame:
    """The four flat rows of a blocked analysis: neutral, 25 each, target and invalidation at spot, confidence 0."""
    return analyses.where("blocked").withColumn("horizon", F.explode(F.array(*map(F.lit, V.HORIZONS)))).select(
        "analysis_id", "horizon", F.lit("neutral").alias("direction"), F.lit(25).alias("probability"), F.col("spot").alias("target"), F.col("spot").alias("invalidation"), F.lit(0).alias("confidence"))


def capped(confidence: Column, cap: Column) -> Column:
    """Declared percent, at most the cap's."""
    return F.least(confidence, F.round(cap * 100).cast("int"))




def event_errors(e: DataFrame, triggered: Column) -> DataFrame:
    """Adds errors of a payload (event_id, event_type, source, news_event_id, news_score), all of them, in order."""
    event_id = F.trim(F.coalesce("event_id", F.lit("")))
    return e.withColumn("errors", F.array_compact(F.array(
        F.when(event_id == "", "event_id_missing"), F.when(F.length(event_id) > 200, "event_id_long"), F.when(~F.coalesce(F.col("event_type").isin(V.DOMAINS["committee_event"]), F.lit(False)), "event_type"),
        F.when(F.trim(F.coalesce("source", F.lit(""))) == "", "source"), F.when(triggered.isNull(), "triggered_at"), F.when(~F.col("news_event_id").rlike(V.UUID), "news_event_id"),
        F.when(~F.col("news_score").between(0, 100) | F.isnan("news_score"), "news_score"),
    )))


def scope_of(event_type: Column, has_baseline: Column) -> Column:
    return F.when(~has_baseline, "FULL").when(event_type == "RECALC_H1_H2", "H1_H2").when(event_type == "REEVALUATE_H3", "H3").otherwise("FULL")


def bridge(links: DataFrame) -> DataFrame:
    """(analysis_id, news_id) with equal weights that are rounded to four places."""
    return links.withColumn("weight", F.round(F.lit(1.0) / F.count("*").over(Window.partitionBy("analysis_id")), 4).cast("decimal(5,4)"))


def coerce_replies(replies: DataFrame) -> DataFrame:
    """Typed fields of agent replies (analysis_id, agent, reply_json); text around the JSON object and code fences are dropped, wrong types are null or default."""
    raw = F.regexp_extract("reply_json", r"(?s)(\{.*\})", 1)
    schema = "verdict string, confidence double, confidence_cap double, overall_bias string, market_regime string, reasoning string, missing_data array<string>, rejection_reasons array<string>, key_supports array<double>, key_resistances array<double>"
    j = F.from_json(raw, schema, {"mode": "PERMISSIVE"})
    bias = F.lower(j.overall_bias)
    return replies.select("analysis_id", "agent", F.coalesce(F.when(j.verdict.isin(V.DOMAINS["risk_verdict"]), j.verdict), F.when(F.col("agent") == "risk", "DATA_INSUFFICIENT")).alias("verdict"),
        scoring.confidence(j.confidence).alias("confidence"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), j.confidence_cap)).alias("confidence_cap"),
        F.when(bias.isin(V.DOMAINS["direction"]), bias).otherwise("neutral").alias("overall_bias"), j.market_regime.alias("market_regime"), F.coalesce(j.reasoning, F.lit("")).alias("reasoning"),
        *[F.coalesce(j[n], F.array().cast("array<string>")).alias(n) for n in ("missing_data", "rejection_reasons")],
        *[F.coalesce(j[n], F.array().cast("array<double>")).alias(n) for n in ("key_supports", "key_resistances")])


def confidence_cap_policy(unavailable: Column, missing: Column, stale: Column, contradictions: Column) -> Column:
    """The cap of a confidence: by missing inputs, less a tenth for stale data and for contradictions each; no data at all leaves a fifth."""
    by_missing = F.when(missing == 0, 0.90).when(missing == 1, 0.70).when(missing == 2, 0.50).otherwise(0.30)
    return F.when(unavailable, 0.20).otherwise(F.round(F.greatest(F.lit(0.20), by_missing - F.when(stale, 0.10).otherwise(0.0) - F.when(contradictions, 0.10).otherwise(0.0)), 2))


def backfilled_verdict(context: Column) -> Column:
    """The verdict that an older row's JSON context holds, null if it is none of the domain's."""
    verdict = F.get_json_object(context, "$.verdict")
    return F.when(verdict.isin(V.DOMAINS["risk_verdict"]), verdict)


def scorecard(outcomes: DataFrame, *keys: str) -> DataFrame:
    """accuracy, brier_score, calibration (the gap between mean probability and mean outcome) and sample_size by `keys`, of (p, y)."""
    p, y = F.col("p").cast("double"), F.col("y").cast("double")
    return outcomes.groupBy(*keys).agg(F.avg(y).alias("accuracy"), F.avg(F.pow(p - y, 2)).alias("brier_score"), F.abs(F.avg(p) - F.avg(y)).alias("calibration"), F.count("*").alias("sample_size"))


def drift_alerts(cards: DataFrame, previous: DataFrame, key: str, limit: float = V.MAX_DRIFT) -> DataFrame:
    """Keys whose accuracy moved by more than `limit`, up or down, against the card before, as model_drift alerts."""
    both = cards.select(key, "accuracy").join(previous.select(key, F.col("accuracy").alias("before")), key)
    drift = F.col("accuracy") - F.col("before")
    return both.where(F.abs(drift) > limit).select(key, drift.alias("drift"), F.lit("model_drift").alias("alert_type"))


CARD = ["model_version", "evaluation_window", "horizon", "evaluation_date"]


def daily_cards(outcomes: DataFrame) -> DataFrame:
    """One card for each model, window, horizon and day of (CARD, p, y, direction_ok, timing_ok, risk_ok); a null horizon is the card of all horizons together.

    model_drift is the change of accuracy against the card of the same model, window and horizon before it, 0 for the first. A series of
    cards is one row a day, so its window stays small however many outcomes there are.
    """
    share = lambda c: F.avg(F.col(c).cast("double"))
    both = outcomes.unionByName(outcomes.withColumn("horizon", F.lit(None).cast("string")))
    cards = both.groupBy(*CARD).agg(
        share("y").alias("prediction_accuracy"), share("direction_ok").alias("direction_accuracy"), F.abs(share("p") - share("y")).alias("probability_calibration"), share("timing_ok").alias("timing_accuracy"),
        share("risk_ok").alias("risk_accuracy"), F.avg(F.pow(F.col("p").cast("double") - F.col("y").cast("double"), 2)).alias("brier_score"), F.count("*").alias("sample_size"))
    series = Window.partitionBy(*CARD[:3]).orderBy("evaluation_date")
    return cards.withColumn("model_drift", F.col("prediction_accuracy") - F.coalesce(F.lag("prediction_accuracy").over(series), F.col("prediction_accuracy")))


def degraded(cards: DataFrame, limit: float = V.MAX_DRIFT) -> DataFrame:
    return cards.where(F.abs("model_drift") > limit)


def upsert_cards(existing: DataFrame, cards: DataFrame) -> DataFrame:
    """`existing` with the cards: a day that is evaluated again replaces its card."""
    same = [F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}")) for c in CARD]
    return existing.alias("_old").join(cards.alias("_new"), same, "left_anti").unionByName(cards)


def with_fallbacks(replies: DataFrame) -> DataFrame:
    """replies with drivers, risks and invalidations that are never empty for want of a reply: the main driver, the committee's
    contradictions and flags (empty ones dropped), one line a horizon (map `levels` of horizon to level). Given lists stay."""
    given = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    empty = F.array().cast("array<string>")
    raised = F.filter(F.concat(F.coalesce("contradictions", empty), F.coalesce("bias_flags", empty)), lambda x: F.length(x) > 0)
    lines = F.transform(F.array(*map(F.lit, V.HORIZONS)), lambda h: F.concat(h, F.lit(V.INVALIDATION), F.coalesce(F.try_element_at(F.col("levels"), h).cast("string"), F.lit("null"))))
    return replies.withColumns({
        "drivers": F.when(given("drivers"), F.col("drivers")).otherwise(F.array("main_driver")), "risks": F.when(given("risks"), F.col("risks")).otherwise(raised),
        "invalidations": F.when(given("invalidations"), F.col("invalidations")).otherwise(lines),
    })
