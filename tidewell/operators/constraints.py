"""The catalogue of data-quality rules. A rule is broken where its condition is false; an unknown condition passes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rule, table, condition in SQL. Rules over several rows or tables are functions below.
RULES = [
    ("C1", "instruments", "upper(symbol) = symbol and length(symbol) between 2 and 20"),
    ("C2", "data_sources", "lower(code) = code"),
    ("C3", "instruments", "tick_size > 0 and price_decimals between 0 and 8"),
    ("C4", "market_ticks", "close is not null and close > 0 and coalesce(open > 0, true) and coalesce(high > 0, true) and coalesce(low > 0, true) and coalesce(volume >= 0, true)"),
    ("C5", "market_ticks", "us10y_yield between -5 and 25 and real_yield between -10 and 25 and vix between 0 and 300 and wti between 0 and 1000"),
    ("C6", "market_ticks", "ask >= bid"),
    ("C7", "market_ticks", "high is null or low is null or (high >= low and high >= greatest(coalesce(open, close), close) and low <= least(coalesce(open, close), close))"),
    ("C8", "market_ticks", "timeframe = 'tick' or (open is not null and high is not null and low is not null)"),
    ("C9", "market_ticks", "ts <= created_at + interval 5 minutes"),
    ("C11", "news_events", "length(trim(title)) > 0 and coalesce(source_url rlike '(?i)^https?://', true)"),
    ("C12", "news_events", "sentiment between -1 and 1 and macro_score between 0 and 100 and quality_score between 0 and 100"),
    ("C13", "ai_scenarios", "probability between 0 and 1 and confidence between 0 and 1"),
    ("C14", "ai_analyses", "valid_until > analysis_ts"),
    ("C15", "ai_analyses", "isnull(tick_id) = isnull(tick_ts)"),
    ("C16", "ai_analyses", "model_version rlike '^[a-zA-Z0-9._-]+$'"),
    ("C17", "ai_scenarios", "(direction <> 'bullish' or target > invalidation) and (direction <> 'bearish' or target < invalidation)"),
    ("C18", "ai_scenarios", "length(trim(reasoning)) >= 10"),
    ("C19", "ai_scenarios", "length(trim(activation_condition)) >= 15"),
    ("C21", "ai_analyses", "risk_verdict not in ('REJECTED', 'DATA_INSUFFICIENT', 'CONFLICT') or size(rejection_reasons) > 0"),
    ("C22", "ai_analyses", "risk_verdict not in ('REJECTED', 'DATA_INSUFFICIENT', 'CONFLICT') or execution_status <> 'VALID_SETUP'"),
    ("C23", "ai_analyses", "execution_status <> 'NO_VALID_SETUP' or coalesce(overall_bias, 'neutral') = 'neutral'"),
    ("C24", "ai_analyses", "confidence_cap between 0 and 1"),
    ("C25", "alerts", "(status <> 'triggered' or triggered_at is not null) and (status <> 'acknowledged' or acknowledged_at is not null) and (status <> 'resolved' or resolved_at is not null)"),
    ("C26", "alerts", "coalesce(triggered_at >= created_at, true) and coalesce(acknowledged_at >= created_at, true) and coalesce(resolved_at >= created_at, true)"),
    ("C27", "alerts", "json_object_keys(trigger) is not null"),
    ("C28", "ingestion_runs", "coalesce(finished_at >= started_at, true) and fetched >= 0 and persisted >= 0"),
    ("C29", "ai_events", "length(event_id) between 1 and 200 and (status <> 'PROCESSED' or analysis_id is not null) and (status = 'RUNNING' or finished_at is not null)"),
    ("C30", "performance_scorecard", "accuracy between 0 and 1 and brier_score between 0 and 1 and model_drift between -1 and 1 and sample_size >= 0"),
    ("C31", "news_events", "notify_attempts >= 0"),
]


def broken(condition: str) -> Column:
    return F.expr(f"({condition}) is false")


def rules_of(table: str) -> list[tuple[str, str]]:
    return [(name, condition) for name, of, condition in RULES if of == table]


def check(df: DataFrame, table: str) -> DataFrame:
    """Adds violations, the names of the rules that a row breaks."""
    return df.withColumn("violations", F.array_compact(F.array(*[F.when(broken(c), name) for name, c in rules_of(table)])))


def split(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with violations)."""
    checked = check(df, table)
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)


def violation_counts(df: DataFrame, table: str) -> DataFrame:
    """(rule, n) of every rule of the table, 0 included, in one pass over its rows."""
    counts = df.agg(*[F.count_if(broken(c)).alias(name) for name, c in rules_of(table)])
    return counts.unpivot([], [name for name, _ in rules_of(table)], "rule", "n")


def orphans(child: DataFrame, parent: DataFrame, column: str, key: str) -> DataFrame:
    """C10: rows whose non-null reference has no parent."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")


def probability_sums(scenarios: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """C20: analyses with exactly four horizons whose probabilities do not sum to 1."""
    sums = scenarios.groupBy("analysis_id").agg(F.count("*").alias("n"), F.sum("probability").alias("total"))
    return sums.where((F.col("n") == 4) & (F.abs(F.col("total") - 1) > tolerance))


def in_domain(df: DataFrame, **domains: list[str]) -> DataFrame:
    """Rows with a value outside its closed domain, nulls aside."""
    return df.where(reduce(lambda a, b: a | b, [F.col(c).isNotNull() & ~F.col(c).isin(values) for c, values in domains.items()]))


def ordinal(column: Column, domain: list[str]) -> Column:
    """Place of a value in its domain from 1, for sorts by declaration."""
    return F.array_position(F.array(*map(F.lit, domain)), column)


def integrity_probes(ticks: DataFrame, runs: DataFrame, as_of: Column) -> DataFrame:
    """Three counts that should be 0: ticks closing at zero, ticks over five minutes ahead, runs that run for over twenty minutes."""
    count = lambda df, name, broken: df.agg(F.count_if(broken).alias("n")).select(F.lit(name).alias("probe"), "n")
    late = (F.col("status") == "running") & (F.col("started_at") < as_of - F.make_interval(mins=F.lit(20)))
    return count(ticks, "zero_close", F.col("close") == 0).union(count(ticks, "future_ts", F.col("ts") > as_of + F.make_interval(mins=F.lit(5)))).union(count(runs, "stuck_locks", late))
