"""Streams: bank lines that arrive more than once, sums by day, sessions, and invoices that fall due."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, folder: str, per_batch: int = 1) -> DataFrame:
    """Event files of a folder as a stream; new files make new micro-batches."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame, key: str = "event_id", lateness: str = "7 days") -> DataFrame:
    """Each key once; its state is forgotten once no line that old can come any more."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark([key])


def daily_sums(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """(day, event_type, amount_cents, n) in tumbling windows of a day."""
    cents = F.round(F.col("value") * 100).cast("bigint")
    sums = events.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.sum(cents).alias("amount_cents"), F.count("*").alias("n"))
    return sums.select(F.to_date("w.start").alias("day"), "event_type", "amount_cents", "n")


def sessions(events: DataFrame, gap: str = "90 seconds", lateness: str = "10 minutes") -> DataFrame:
    """(user_id, started, ended, n): activity of a user without a pause longer than ``gap``."""
    grouped = events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def append_new(stream: DataFrame, target: str, checkpoint: str, *keys: str) -> StreamingQuery:
    """Append the lines of a stream whose keys have not come before.

    The keys that have come are the stream's state, kept by key beside the checkpoint, so a batch reads nothing of the target and
    costs as much as its own lines, however large the target is. A batch that is done again overwrites itself. A large state
    wants the RocksDB store (``spark.sql.streaming.stateStore.providerClass``).
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return stream.dropDuplicates(list(keys)).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def change_feed(changes: DataFrame, checkpoint: str, tell: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Tell which tables changed: (entity, version, n_changes) of those that a micro-batch of changes (id, entity) touches.

    The highest version and the number of changes of each table are the stream's state, so nobody polls the tables.
    """
    counters = changes.groupBy("entity").agg(F.max("id").alias("version"), F.count("*").alias("n_changes"))
    return counters.writeStream.outputMode("update").foreachBatch(tell).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def on_schedule(ticks: DataFrame, plan: Callable[[date], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """For every micro-batch of ticks (column ``day``) write what falls due up to the latest day."""

    def batch(df: DataFrame, batch_id: int) -> None:
        last = df.agg(F.max("day").alias("d")).first().d
        if last is not None:
            plan(last).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return ticks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
