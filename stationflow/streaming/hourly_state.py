"""Hourly mean availability as event-time state: no stored day is read again.

The state of a station-hour is the newest count of each of its polls. A batch updates the hours it brings rows
for and gives their new means; a late or corrected poll does the same as long as its time is not older than the
watermark (the newest poll time minus ``delay``). When the watermark has passed the end of an hour, its state is
dropped: what is kept is bounded by stations x hours of the delay x polls an hour. Older polls change no hour any
more; the status table still gets them.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.timecols import hour_floor, wall_clock
from .snapshots import landing_stream, parse_polls, station_rows

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# How rows arrive; pandas would rename columns that start with an underscore.
_AGE = ["file_time", "file", "block", "line", "pos"]


class HourState(StatefulProcessor):
    """Key: station and hour (as text). State: the newest count of each poll, by the poll's time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.polls = handle.getMapState("polls", "collected_at string", "bikes double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        for row in batch.sort_values(_AGE).itertuples(index=False):
            self.polls.updateValue((row.collected_at,), (None if pd.isna(row.bikes) else float(row.bikes),))
        # The timer of an hour; setting it again changes nothing.
        end = datetime.fromisoformat(key[1]) + timedelta(hours=1)
        self.handle.registerTimer(int(pd.Timestamp(end, tz="UTC").timestamp() * 1000))
        counts = [v[0] for v in self.polls.values() if v[0] is not None]
        yield pd.DataFrame({"station_id": [key[0]], "hour": [key[1]], "inv_act": [sum(counts) / len(counts) if counts else None]}).astype({"inv_act": "float64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.polls.clear()
        return iter([])

    def close(self) -> None:
        pass


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``_line``: where a row stands in its task, which reads a file block in order."""
    at = 0
    for batch in batches:
        yield batch.append_column("_line", pa.array(range(at, at + batch.num_rows), pa.int64()))
        at += batch.num_rows


def hourly_rows(raw: DataFrame) -> DataFrame:
    """station_id, hour (text), collected_at, bikes, ts and the order of arrival, of all readable poll entries."""
    lines = raw.mapInArrow(_numbered, StructType([*raw.schema.fields, StructField("_line", LongType())]))
    rows = station_rows(parse_polls(lines)).withColumn("at", wall_clock("collected_at")).where(F.col("at").isNotNull())
    # The watermark's clock is the poll's wall clock read as UTC.
    utc = F.timestamp_seconds(F.unix_seconds(F.to_utc_timestamp(F.col("at").cast("string"), "UTC")))
    return rows.select("station_id", F.date_format(hour_floor("at"), "yyyy-MM-dd HH:mm:ss").alias("hour"), "collected_at",
                       F.col("bikes_available").cast("double").alias("bikes"), utc.alias("ts"), *[F.col(f"_{c}").alias(c) for c in _AGE])


@contextmanager
def _state_store(spark: SparkSession):
    """Keyed state with timers needs the RocksDB store; the session's own setting is put back once the query runs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def hourly_state_stream(spark: SparkSession, landing: str, out: str, checkpoint: str, delay: str = "2 days",
                        max_files: int | None = None) -> StreamingQuery:
    """Processes what has landed; each batch writes the hours it changed to its own folder (``snapshots.read_hourly``)."""
    rows = hourly_rows(landing_stream(spark, landing, max_files)).withWatermark("ts", delay)
    hours = rows.groupBy("station_id", "hour").transformWithStateInPandas(
        HourState(), "station_id string, hour string, inv_act double", outputMode="Update", timeMode="EventTime")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("hour", F.col("hour").cast("timestamp_ntz")).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    with _state_store(spark):
        return (hours.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start())
