"""Streams over the events table, run to the end of what is there; results equal the batch forms."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..sources import commits
from ..streaming import state, streams
from . import stand_ins as S


def _events(spark, sf_dir):
    return streams.change_feed(spark, f"{sf_dir}/event[s].parquet", S.read(spark, sf_dir, "events").schema)


def shared(spark):
    """The folder that driver and executors share; a temporary one only on one machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return base or f"file://{tempfile.gettempdir()}/tidewell-checkpoints"


def _folder(spark):
    return f"{shared(spark)}/tidewell/streams/s{uuid.uuid4().hex}"


def _run(stream, mode):
    at = _folder(stream.sparkSession)
    return streams.run_once(stream, f"{at}/table", f"{at}/state", mode)


def stream_dedup(spark, sf_dir):
    twice = _events(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    return _run(streams.dedup(twice, "event_id", "60 days").select("event_id", "event_type"), "append")


def stream_hourly(spark, sf_dir):
    out = _run(streams.hourly(_events(spark, sf_dir), "event_type"), "complete")
    return out.select("event_type", F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "n", F.round("total", 4).alias("total"))


def stream_bars_ext(spark, sf_dir):
    ticks = _events(spark, sf_dir).select("ts", F.col("event_id").alias("id"), F.col("event_type").alias("symbol"), "value")
    out = _run(streams.bars(ticks, "1 day", "2 days"), "complete")
    return out.select("symbol", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "open", "high", "low", "close")


def stream_feed(spark, sf_dir):
    """Inserted news as a listing keeps them: critical and major ones, none from the future."""
    news = _events(spark, sf_dir).select("ts", F.col("event_id").alias("id"), F.expr("case event_type when 'purchase' then 'critical' when 'signup' then 'major' when 'error' then null else 'noise' end").alias("classification"))
    shown = streams.not_from_future(streams.notable(news), as_of=F.expr("TIMESTAMP '2024-01-20 00:00:00'"))
    return _run(shown.select("id", "classification"), "append")


def _ticks(spark, sf_dir):
    return S.read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), F.col("event_type").alias("symbol"), "value")


def _delivered(spark, rows, at):
    """The rows in three deliveries that overlap, as files; a stream that takes a few files a batch."""
    for part in ("pmod(id, 3) < 2", "pmod(id, 3) > 0", "pmod(id, 4) = 0"):
        rows.where(part).write.mode("append").parquet(f"{at}/deliveries")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/deliveries")


def stream_carried(spark, sf_dir):
    at = _folder(spark)
    ticks = _delivered(spark, _ticks(spark, sf_dir), at)
    query = ticks.writeStream.foreachBatch(streams.carry(f"{at}/state")).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return streams.carried(spark, f"{at}/state")


def stream_prices(spark, sf_dir):
    at = _folder(spark)
    with state.rocksdb(spark, 16):
        changes = streams.run_once(state.prices(_delivered(spark, _ticks(spark, sf_dir), at)), f"{at}/table", f"{at}/progress")
    return state.latest(changes)


def stream_unseen(spark, sf_dir):
    at = _folder(spark)
    with state.rocksdb(spark):
        # no bound, so each row is told from its repetitions however late they come
        rows = streams.run_once(state.unseen(_delivered(spark, _ticks(spark, sf_dir), at), most=0), f"{at}/table", f"{at}/progress")
    return rows.select(F.col("key").alias("symbol"), "id", "value")


def stream_listing(spark, sf_dir):
    """The newest 60 of critical and major news, kept between batches."""
    at = _folder(spark)
    news = _ticks(spark, sf_dir).select("ts", "id", F.expr("case symbol when 'purchase' then 'critical' when 'signup' then 'major' else 'noise' end").alias("classification"), "value")
    with state.rocksdb(spark, 16):
        versions = streams.run_once(state.newest(streams.notable(_delivered(spark, news, at)), "news", ["classification", "value"]), f"{at}/table", f"{at}/progress")
    return state.newest_listing(versions).select("place", "id", F.get_json_object("row", "$.classification").alias("classification"))


def stream_sweep(spark, sf_dir):
    """Deliveries of news whose acknowledgement is missing, by the events' own time."""
    at = _folder(spark)
    news = _events(spark, sf_dir).select(F.col("event_id").alias("id"), "ts", F.expr("if(event_id % 4 = 0, 'ARCHIVE_ONLY', 'REEVALUATE_H3')").alias("action"), F.expr("60 + event_id % 40").cast("double").alias("score"))
    both = news.withColumn("kind", F.explode(F.when(F.col("id") % 3 == 0, F.array(F.lit("news"), F.lit("ack"))).otherwise(F.array(F.lit("news")))))
    with state.rocksdb(spark):
        made = streams.run_once(state.sweep(both), f"{at}/table", f"{at}/progress")
    return made.groupBy("id").agg(F.max("attempt").alias("attempts"), F.count_if(F.col("kind") == "notify").alias("notified"), F.count_if(F.col("kind") == "alert").alias("alerts"))


def stream_claims(spark, sf_dir):
    """Events that a stream brings several times, claimed in buckets of the commit log."""
    at = _folder(spark)
    rows = S.read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat_ws(":", "user_id", "event_type").alias("event_id"))
    query = _delivered(spark, rows, at).select("event_id").writeStream.foreachBatch(streams.claims(f"{at}/ledger", "router", 8)).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return commits.Log(spark, f"{at}/ledger").read("claims")


QUERIES = {f.__name__: f for f in (stream_dedup, stream_hourly, stream_bars_ext, stream_feed, stream_carried, stream_prices, stream_unseen, stream_listing, stream_sweep, stream_claims)}
_CARRIED = """SELECT event_type AS symbol, arg_max(value, struct_pack(t := ts, i := event_id)) AS value, max(CASE WHEN n = 2 THEN value END) AS previous, arg_min(value, struct_pack(t := ts, i := event_id)) AS session_open
FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) GROUP BY 1"""
ORACLE_SQL = {
    "stream_claims": "SELECT DISTINCT user_id || ':' || event_type AS event_id FROM events",
    "stream_prices": _CARRIED,
    "stream_unseen": "SELECT event_type AS symbol, event_id AS id, value FROM events",
    "stream_listing": """SELECT CAST(row_number() OVER (ORDER BY ts DESC, event_id DESC) AS int) AS place, event_id AS id, CASE event_type WHEN 'purchase' THEN 'critical' ELSE 'major' END AS classification
FROM events WHERE event_type IN ('purchase', 'signup') QUALIFY place <= 60""",
    "stream_sweep": """WITH n AS (SELECT event_id AS id, epoch_ms(ts) + 90000 AS due, (SELECT max(epoch_ms(ts)) FROM events WHERE event_id % 4 <> 0 OR event_id % 3 = 0) AS now, event_id FROM events WHERE event_id % 4 <> 0 AND event_id % 3 <> 0),
a AS (SELECT id, CAST(least(10, (now - due) // 300000 + 1) AS int) AS attempts FROM n WHERE due <= now)
SELECT id, attempts, CAST(attempts AS bigint) AS notified, CAST(CASE WHEN attempts = 10 AND 60 + id % 40 >= 80 THEN 1 ELSE 0 END AS bigint) AS alerts FROM a""",
    "stream_feed": "SELECT event_id AS id, CASE event_type WHEN 'purchase' THEN 'critical' ELSE 'major' END AS classification FROM events WHERE event_type IN ('purchase', 'signup') AND ts <= TIMESTAMP '2024-01-20 00:10:00'",
    "stream_carried": _CARRIED,
    "stream_dedup": "SELECT DISTINCT event_id, event_type FROM events",
    "stream_hourly": "SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_bars_ext": "SELECT event_type AS symbol, strftime(ts, '%Y-%m-%d') AS day, arg_min(value, struct_pack(t := ts, i := event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, struct_pack(t := ts, i := event_id)) AS close FROM events GROUP BY ALL",
}
