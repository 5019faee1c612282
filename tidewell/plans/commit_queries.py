"""Writes through the commit log over the driver's tables: what readers see after repeated, failed, fenced and archived ones."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import committee
from ..sources import commits
from . import stand_ins as S
from .stream_queries import shared


def _log(spark):
    return commits.Log(spark, f"{shared(spark)}/tidewell/tables/t{uuid.uuid4().hex}")


def _events(spark, sf_dir):
    return S.read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("date").cast("string").alias("day"))


def commit_epochs(spark, sf_dir):
    """Three deliveries of ticks as epochs; the second comes twice, and a writer that fails leaves folders that don't count."""
    log, events, key = _log(spark), _events(spark, sf_dir), ["user_id", "event_type", "day"]
    for epoch in (0, 1, 1, 2):
        log.insert_ignore("ticks", events.where(F.col("event_id") % 3 == epoch), key, "feed", epoch, F.col("event_id"))
    log._written("ticks", events, None, [])
    return log.read("ticks")


def committee_write(spark, sf_dir):
    """Analyses with their scenarios and news links, each third of them in one version; the second writer fails before it commits."""
    log = _log(spark)
    orders = S.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("analysis_id"), F.col("o_orderpriority").alias("bias"))
    lines = S.read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "analysis_id")
    details = lines.select("analysis_id", F.concat(F.lit("H"), (F.col("l_linenumber") % 4 + 1).cast("string")).alias("horizon")).distinct()
    links = committee.bridge(lines.select("analysis_id", F.col("l_partkey").alias("news_id")).distinct())
    for epoch in range(3):
        frames = {n: df.where(F.col("analysis_id") % 3 == epoch) for n, df in (("analyses", orders), ("scenarios", details), ("analysis_news", links))}
        if epoch == 1:
            for name in ("analyses", "scenarios"):
                log._written(name, frames[name], None, [])
        else:
            log.commit(frames, "committee", epoch)
    state = log.snapshot()
    count = lambda name, n: log.read(name, state).groupBy("analysis_id").agg(F.count("*").alias(n))
    whole = log.read("analyses", state).join(count("scenarios", "n_scenarios"), "analysis_id", "left").join(count("analysis_news", "n_news"), "analysis_id", "left")
    return whole.select("analysis_id", "bias", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_scenarios", "n_news")])


def fenced_writes(spark, sf_dir):
    """A run is taken over when it is stale; what it still writes is refused, so rows come from the run that holds the lease."""
    log = _log(spark)
    lease, orders = commits.Lease(spark, f"{log.path}/leases"), S.read(spark, sf_dir, "orders").select("o_orderkey")
    write = lambda run, epoch: log.commit({"rows": orders.where(F.col("o_orderkey") % 3 == epoch).withColumn("run", F.lit(run))}, f"run-{run}", epoch, lease=(lease, "news", run))
    first = lease.acquire("news", "a", 0.0)
    refused = lease.acquire("news", "b", 60.0)
    write(first, 0)
    second = lease.acquire("news", "b", 3600.0)
    try:
        write(first, 1)
    except commits.Fenced:
        write(second, 2)
    return log.read("rows").withColumn("refused", F.lit(refused is None))


def month_archive(spark, sf_dir):
    """Orders by month; the months of 1995 are detached, and one of them comes back."""
    log = _log(spark)
    orders = S.read(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy_MM").alias("year_month"))
    log.commit({"orders": orders}, "load", 0, part={"orders": F.col("year_month")})
    log.detach("orders", [f"1995_{m:02d}" for m in range(1, 13)])
    log.restore("orders", ["1995_03"])
    found = [df.groupBy("year_month").agg(F.count("*").alias("n")).withColumn("archived", F.lit(away)) for df, away in ((log.read("orders"), False), (log.archived("orders"), True))]
    return found[0].unionByName(found[1])


def event_claims(spark, sf_dir):
    """Claims of events in batches, by buckets: each event once, whoever brings it again."""
    log, events = _log(spark), _events(spark, sf_dir).select(F.concat_ws(":", "user_id", "event_type").alias("event_id"), F.col("event_id").alias("first_id"))
    for epoch, part in enumerate(("first_id % 2 = 0", "first_id % 3 = 0", "true")):
        log.insert_ignore("claims", events.where(part).withColumn("batch", F.lit(epoch)), ["event_id"], "router", epoch, F.col("first_id"), buckets=16)
    log.compact("claims")
    return log.read("claims")


QUERIES = {f.__name__: f for f in (commit_epochs, committee_write, fenced_writes, month_archive, event_claims)}
ORACLE_SQL = {
    "commit_epochs": """SELECT event_id, user_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS date) ORDER BY event_id % 3, event_id) = 1""",
    "committee_write": """WITH s AS (SELECT l_orderkey AS k, count(DISTINCT l_linenumber % 4) AS n_scenarios, count(DISTINCT l_partkey) AS n_news FROM lineitem GROUP BY 1)
SELECT o_orderkey AS analysis_id, o_orderpriority AS bias, coalesce(n_scenarios, 0) AS n_scenarios, coalesce(n_news, 0) AS n_news FROM orders LEFT JOIN s ON k = o_orderkey WHERE o_orderkey % 3 <> 1""",
    "fenced_writes": "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS int) AS run, true AS refused FROM orders WHERE o_orderkey % 3 <> 1",
    "month_archive": "SELECT strftime(o_orderdate, '%Y_%m') AS year_month, count(*) AS n, year(o_orderdate) = 1995 AND month(o_orderdate) <> 3 AS archived FROM orders GROUP BY ALL",
    "event_claims": """WITH e AS (SELECT user_id || ':' || event_type AS event_id, event_id AS first_id, CASE WHEN event_id % 2 = 0 THEN 0 WHEN event_id % 3 = 0 THEN 1 ELSE 2 END AS batch FROM events)
SELECT event_id, first_id, CAST(batch AS int) AS batch FROM e QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY e.batch, first_id) = 1""",
}
