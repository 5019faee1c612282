"""Runs, events and notifications: insert-ignore, claims, stale locks, the pending sweep. Tables are frames; writers append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_a_key(new: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row in `order` of each key."""
    return new.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*(order or [F.lit(1)])))).where("_n = 1").drop("_n")


def insert_ignore(new: DataFrame, target: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """Rows of `new` to append: one a key (the first in `order`), and none whose key the target has. Keys compare null-safely."""
    one = one_a_key(new, key, *order)
    have = target.select(*[F.col(k).alias(f"_t_{k}") for k in key]).distinct()
    return one.join(have, [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in key], "left_anti")


def new_alerts(alerts: DataFrame, existing: DataFrame) -> DataFrame:
    """Alerts whose key no active alert has: only pending, triggered and acknowledged ones block."""
    return insert_ignore(alerts, existing.where(F.col("status").isin("pending", "triggered", "acknowledged")), ["dedup_key"], F.col("news_id"))


def latest_state(ledger: DataFrame, key: str, *columns: str) -> DataFrame:
    """The last appended state of each key, by version."""
    return ledger.groupBy(key).agg(F.max_by(F.struct(*columns), "version").alias("_s")).select(key, "_s.*")


def reclaim_stale(runs: DataFrame, as_of: Column, minutes: int = 15) -> DataFrame:
    """Runs that have been running for longer than `minutes` become failed, with their duration and an added error."""
    if minutes <= 0:
        raise ValueError("minutes must be positive")
    seconds = F.unix_micros(as_of) / 1e6 - F.unix_micros(F.col("started_at").cast("timestamp")) / 1e6
    stale = (F.col("status") == "running") & (seconds > minutes * 60)
    return runs.withColumns({
        "duration_ms": F.when(stale, F.greatest(F.lit(0), F.round(seconds).cast("long") * 1000)).otherwise(F.col("duration_ms")),
        "errors": F.when(stale, F.array_append(F.col("errors"), F.lit("stale_lock"))).otherwise(F.col("errors")), "status": F.when(stale, "failed").otherwise(F.col("status")),
    })


def open_run(runs: DataFrame, run_id: str, engine: str, trigger: str, as_of: Column) -> DataFrame:
    """The row to append for a new run of the engine; none while another one of it runs, so one of several attempts wins where one driver asks."""
    busy = runs.where((F.col("engine") == engine) & (F.col("status") == "running")).select(F.lit(1).alias("busy")).limit(1)
    new = runs.sparkSession.range(1).select(F.lit(run_id).alias("id"), F.lit(engine).alias("engine"), F.lit(trigger).alias("trigger_type"), F.lit("running").alias("status"), as_of.alias("started_at"))
    return new.join(busy, how="left_anti")


def close_runs(runs: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    """runs with status, duration and counters of the results (id, final, fetched, persisted); only running ones are closed, once."""
    joined = runs.join(results, "id", "left")
    closes = (F.col("status") == "running") & F.col("final").isNotNull()
    seconds = F.unix_micros(as_of) / 1e6 - F.unix_micros(F.col("started_at").cast("timestamp")) / 1e6
    return joined.withColumns({
        "finished_at": F.when(closes, as_of), "duration_ms": F.when(closes, F.round(F.greatest(F.lit(0.0), seconds) * 1000).cast("long")),
        "fetched": F.when(closes, F.coalesce("fetched", F.lit(0))), "persisted": F.when(closes, F.coalesce("persisted", F.lit(0))), "status": F.when(closes, F.col("final")).otherwise(F.col("status")),
    }).drop("final")


def close_events(events: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    """events with the outcome of (event_id, outcome, analysis_id); PROCESSED needs an analysis and is FAILED without one, closed events stay."""
    done = results.withColumn("outcome", F.when((F.col("outcome") == "PROCESSED") & F.col("analysis_id").isNull(), "FAILED").otherwise(F.col("outcome")))
    joined = events.join(done, "event_id", "left")
    closes = (F.col("status") == "RUNNING") & F.col("outcome").isNotNull()
    return joined.withColumns({"finished_at": F.when(closes, as_of), "analysis_id": F.when(closes, F.col("analysis_id")), "status": F.when(closes, F.col("outcome")).otherwise(F.col("status"))}).drop("outcome")


def inserted_scored(inserted: DataFrame, scored: DataFrame) -> DataFrame:
    """The scored rows of the ids that an insert took, by id alone; formatted times or titles are no keys."""
    return scored.join(inserted.select("id").distinct(), "id", "left_semi")


def unclaimed(events: DataFrame, claimed: DataFrame) -> DataFrame:
    """Events to claim: one an id, those aside that the ledger has."""
    return insert_ignore(events, claimed, ["event_id"], F.col("at"))


def touch(changed: DataFrame, before: DataFrame, key: str, as_of: Column) -> DataFrame:
    """`changed` with updated_at: now where any column differs from the row before, else as it was."""
    columns = [c for c in before.columns if c not in (key, "updated_at")]
    old = before.select(F.col(key), F.struct(*columns).alias("_old"), F.col("updated_at").alias("_was"))
    new = changed.drop("updated_at").join(old, key, "left")
    return new.withColumn("updated_at", F.when(F.struct(*columns).eqNullSafe(F.col("_old")), F.col("_was")).otherwise(as_of)).drop("_old", "_was")


def touched(before: DataFrame, after: DataFrame, key: str, column: str) -> DataFrame:
    """One row: how many rows of `after` differ from `before` in the column."""
    both = before.select(key, F.col(column).alias("_b")).join(after.select(key, F.col(column).alias("_a")), key)
    return both.agg(F.count_if(~F.col("_b").eqNullSafe(F.col("_a"))).alias("n"))


def may_start(runs: DataFrame, engine: str) -> bool:
    """True unless the engine has a running run (reclaim stale ones first). One driver must ask: files have no unique index."""
    return runs.where((F.col("engine") == engine) & (F.col("status") == "running")).isEmpty()


def mark_notified(news: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    """news with notified_at and notify_attempts after delivery results (id, delivered); only failures count another attempt."""
    joined = news.join(results, "id", "left")
    return joined.withColumns({
        "notified_at": F.when(F.col("delivered"), as_of).otherwise(F.col("notified_at")),
        "notify_attempts": F.col("notify_attempts") + F.when(~F.col("delivered"), 1).otherwise(0),
    }).drop("delivered")


def pending(news: DataFrame, as_of: Column, grace_s: int = 90, attempts: int = 10) -> DataFrame:
    late = F.col("ts") < as_of - F.make_interval(secs=F.lit(grace_s))
    return news.where((F.col("action") != "ARCHIVE_ONLY") & F.col("notified_at").isNull() & late & (F.col("notify_attempts") < attempts))


def stuck(news: DataFrame, as_of: Column, score: float = 80) -> DataFrame:
    """Rows that the sweep should raise an alert for."""
    return pending(news, as_of).where(F.col("news_score") >= score)


def write_monthly(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Append, partitioned by month of `ts`; a reader prunes months by year_month."""
    df.withColumn("year_month", F.date_format(ts, "yyyy_MM")).repartition("year_month").write.mode("append").partitionBy("year_month").parquet(path)


def month_partitions(as_of: Column, spark) -> DataFrame:
    """The months from two before `as_of` to six after it, with names and bounds."""
    base = spark.range(1).select(F.explode(F.sequence(F.lit(-2), F.lit(6))).alias("offset"), F.date_trunc("month", as_of).alias("base"))
    start = F.add_months(F.col("base").cast("date"), F.col("offset"))
    return base.select("offset", F.concat(F.lit("market_ticks_"), F.date_format(start, "yyyy_MM")).alias("name"), start.alias("first_day"), F.add_months(start, 1).alias("next_first_day"))
