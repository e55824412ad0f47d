"""Streaming trips, camera health and heartbeat throttling.

Trips are session windows, put out once the watermark has closed them, so the state holds open
trips only. Health keeps the latest heartbeat per camera. Every batch is written to a folder of
its own number, so a batch that is run again replaces itself. The *_once functions drive a
stream over files to its end and return what its sink holds.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..scratch import new_folder

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A file stream of the events table: `path` may be one file or a folder."""
    folder, _, name = path.rpartition("/")
    events = spark.readStream.schema(EVENTS).option("pathGlobFilter", name).parquet(folder)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def session_trips(events: DataFrame, gap: str, lateness: str = "1 hour") -> DataFrame:
    """Trips as session windows: events no more than `gap` apart; closed once the watermark has passed."""
    return (
        events.withWatermark("ts", lateness)
        .groupBy("user_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("events_count"), F.min("ts").alias("t_start"), F.max("ts").alias("t_end"))
        .select(
            F.col("user_id").alias("detection_id"),
            F.unix_millis("t_start").alias("t_start_ms"),
            F.unix_millis("t_end").alias("t_end_ms"),
            "events_count",
        )
    )


def _folder(spark: SparkSession) -> str:
    """A new folder below the shared one; removed with the others of this application when the process ends."""
    return new_folder(spark, "stream")


def batches_to(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to its own folder: running a batch again does not store it twice."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def run_to_end(stream: DataFrame, mode: str, at: str, sink: Callable[[DataFrame, int], None] | None = None) -> None:
    started = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(sink or batches_to(f"{at}/out"))
        .option("checkpointLocation", f"{at}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()


def closed_by_an_event(spark: SparkSession, path: str, at: str, user: int | None = None) -> DataFrame:
    """A file stream and one event far in the future: read in the same batch as the files there are, it moves the watermark
    past all others, so the batch without data that follows puts them out. What it opens itself stays open."""
    closing = f"{at}/closing"
    spark.createDataFrame([(None, datetime.datetime(2200, 1, 1), user, None, None, None)], EVENTS).write.parquet(closing)
    late = spark.readStream.schema(EVENTS).parquet(closing).withColumn("ts", F.col("ts").cast("timestamp"))
    return read_events(spark, path).unionByName(late)


def session_trips_once(spark: SparkSession, path: str, gap: str) -> DataFrame:
    """All trips of a finite stream, in append mode."""
    at = _folder(spark)
    run_to_end(session_trips(closed_by_an_event(spark, path, at), gap), "append", at)
    return spark.read.parquet(f"{at}/out").drop("epoch")


def camera_health(events: DataFrame) -> DataFrame:
    """Latest heartbeat per camera."""
    return events.groupBy(F.col("user_id").alias("camera_id")).agg(F.unix_millis(F.max("ts")).alias("last_seen_ms"), F.count(F.lit(1)).alias("beats"))


def camera_health_once(spark: SparkSession, path: str) -> DataFrame:
    """The latest state of each camera at the end of a finite stream: of its updates the one of the last batch."""
    at = _folder(spark)
    run_to_end(camera_health(read_events(spark, path)), "update", at)
    latest = spark.read.parquet(f"{at}/out").groupBy("camera_id")
    return latest.agg(F.max_by("last_seen_ms", "epoch").alias("last_seen_ms"), F.max_by("beats", "epoch").alias("beats"))


class Throttle(StatefulProcessor):
    """Sends a heartbeat on when `every_ms` have passed since the last one sent; the anchor is the state."""

    def __init__(self, every_ms: int):
        self.every_ms = every_ms

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        kept = self.last.get()[0] if self.last.exists() else None
        out = []
        for t in sorted(t for pdf in rows for t in pdf["t_ms"].tolist()):
            if kept is None or t - kept >= self.every_ms:
                kept = t
                out.append((key[0], t))
        if out:
            self.last.update((kept,))
        yield pd.DataFrame(out, columns=["camera_id", "t_ms"])

    def close(self) -> None:
        pass


def throttled_stream(ticks: DataFrame, every_ms: int = 2000) -> DataFrame:
    """ticks (camera_id, t_ms) as a stream; needs the RocksDB state store."""
    return ticks.groupBy("camera_id").transformWithStateInPandas(
        statefulProcessor=Throttle(every_ms), outputStructType="camera_id long, t_ms long", outputMode="Append", timeMode="None"
    )


STORE = "spark.sql.streaming.stateStore.providerClass"


def stateful_to_end(stream: DataFrame, at: str, sink: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Runs a stream with keyed state to its end, its state in RocksDB, and reads what it put out."""
    spark = stream.sparkSession
    held = spark.conf.get(STORE, None)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        run_to_end(stream, "append", at, sink)
    finally:
        spark.conf.set(STORE, held) if held else spark.conf.unset(STORE)
    return spark.read.parquet(f"{at}/out").drop("epoch")


def throttled_once(spark: SparkSession, path: str, every_ms: int) -> DataFrame:
    """The heartbeats (camera_id, t_ms) that a finite stream sends on."""
    ticks = read_events(spark, path).select(F.col("user_id").alias("camera_id"), F.unix_millis("ts").alias("t_ms"))
    return stateful_to_end(throttled_stream(ticks, every_ms), _folder(spark))
