"""Structured Streaming forms: overlapping pulls, late rows, claims of events, hourly counts, the state of last prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import commits


def change_feed(spark: SparkSession, path: str, schema) -> DataFrame:
    """Inserts into an append-only Parquet table, as a stream; `ts` as an instant, for watermarks."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def dedup(stream: DataFrame, key: str, late: str = "48 hours") -> DataFrame:
    """Each key once, though overlapping windows deliver it several times; rows later than `late` are dropped, and state with them."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def not_from_future(stream: DataFrame, skew: str = "10 minutes", as_of: Column | None = None) -> DataFrame:
    """Rows stamped at `as_of` (the batch's time where none is given) plus `skew` at the latest."""
    return stream.where(F.col("ts") <= (F.current_timestamp() if as_of is None else as_of) + F.expr(f"interval {skew}"))


def notable(feed: DataFrame) -> DataFrame:
    """Inserted news that a listing shows: critical and major ones; a row without a class is noise."""
    return feed.where(F.col("classification").isin("critical", "major"))


def scheduled(stream: DataFrame, path: str, checkpoint: str, every: str = "5 minutes"):
    """A running query that appends to Parquet at `path` in micro-batches on a schedule; the caller stops it."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def carry(path: str, key: str = "symbol"):
    """A foreachBatch writer that carries last, previous and session_open of each key from batch to batch, by (ts, id).

    State is one row a key: version N at `path` is made from the one before it and batch N, so a replayed batch gives the same
    version again. A batch is cut to two rows a key before the shuffle; late rows take their place in the order, and a row of
    one (ts, id) that is delivered again is the same row.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        at = F.struct("ts", "id", "value")
        newest = Window.partitionBy(key).orderBy(F.col("ts").desc(), F.col("id").desc())
        batch = batch.groupBy(key, "ts", "id").agg(F.any_value("value").alias("value"))
        two = batch.withColumn("_n", F.row_number().over(newest)).where("_n <= 2").select(key, F.array(at).alias("_late"))
        parts = two.unionByName(batch.groupBy(key).agg(F.min(at).alias("first")), allowMissingColumns=True)
        if epoch:
            before = spark.read.parquet(f"{path}/version={epoch - 1}")
            parts = parts.unionByName(before.select(key, "first", F.filter(F.array("last", "previous"), lambda x: x.isNotNull()).alias("_late")))
        state = parts.groupBy(key).agg(F.min("first").alias("first"), F.flatten(F.collect_list("_late")).alias("_late"))
        ranked = F.sort_array(F.array_distinct("_late"), asc=False)
        state.select(key, "first", F.get(ranked, F.lit(0)).alias("last"), F.get(ranked, F.lit(1)).alias("previous")).write.mode("overwrite").parquet(f"{path}/version={epoch}")

    return write


def carried(spark: SparkSession, path: str, key: str = "symbol") -> DataFrame:
    """The newest version of what `carry` keeps at `path`: value, previous and session_open of each key."""
    versions = spark.read.parquet(path)
    newest = versions.agg(F.max("version").alias("version"))
    return versions.join(F.broadcast(newest), "version").select(key, F.col("last.value").alias("value"), F.col("previous.value").alias("previous"), F.col("first.value").alias("session_open"))


def hourly(stream: DataFrame, key: str, late: str = "48 hours") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def bars(stream: DataFrame, size: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Open, high, low, close by symbol and interval."""
    at = F.struct("ts", "id")
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size), "symbol").agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"))


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is there now, into Parquet at `path`, read from there; for tests and backfills. No row passes through the driver.

    In append mode new rows are added, in complete mode each batch replaces the table; update mode has no such table.
    """
    if mode == "complete":
        writer = stream.writeStream.foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(path))
    else:
        writer = stream.writeStream.format("parquet").option("path", path)
    query = writer.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def claim(path: str):
    """A foreachBatch writer that appends events whose id the ledger at `path` lacks; a replayed batch appends nothing twice. It reads the whole ledger: `claims` doesn't."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark, new = batch.sparkSession, batch.dropDuplicates(["event_id"])
        if commits.names(spark, path):  # the first batch finds no ledger
            new = new.join(spark.read.parquet(path).select("event_id"), "event_id", "left_anti")
        new.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(path)

    return write


def claims(path: str, writer: str, buckets: int = 64):
    """A foreachBatch writer of claims into the commit log at `path`: each event_id once whoever brings it, each epoch of the writer once, and a batch
    reads only what may hold its ids, not the ledger."""

    def write(batch: DataFrame, epoch: int) -> None:
        commits.Log(batch.sparkSession, path).insert_ignore("claims", batch, ["event_id"], writer, epoch, buckets=buckets)

    return write
