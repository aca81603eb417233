"""Availability snapshots: landing folder -> status table, log, quarantine, hourly means.

A landing file holds JSON lines ``{"collected_at": ..., "body": <payload>}``, one per poll.
Every micro-batch writes its own ``batch_id=N`` folder and overwrites only that one, so a
repeated batch changes nothing and no folder is read and replaced at once. The newest row
per key wins when the table is read.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.payload import ALIASES, normalise, pick, unwrap
from ..functions.timecols import hour_floor, wall_clock

LANDING_SCHEMA = "collected_at string, body string, _corrupt_record string"
STATUS_COLUMNS = ["collected_at", "station_id", "station_name", "bikes_available", "lat", "lon",
                  "address", "raw_json"]
_ARRIVAL = ["_file_time", "_file", "_block", "_line"]


def landing_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(LANDING_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path).select("collected_at", "body", "_corrupt_record", *_where_from())


def landing_batch(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.schema(LANDING_SCHEMA).json(path)
            .select("collected_at", "body", "_corrupt_record", *_where_from()))


def _where_from():
    return (F.col("_metadata.file_modification_time").alias("_file_time"),
            F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))


def with_arrival(batch: DataFrame) -> DataFrame:
    """Position of a line in its file block; directly on the scan it is the same on a re-run."""
    return batch.withColumn("_line", F.monotonically_increasing_id())


def parse_polls(raw: DataFrame) -> DataFrame:
    """One row per poll: its station list, or the reason it has none."""
    items = unwrap(F.col("body"))
    return raw.withColumn("items", items).withColumn(
        "message", F.when(F.col("items").isNull(), F.concat(
            F.lit("no station list found: "), F.coalesce("_corrupt_record", "body", F.lit("empty payload")))))


def station_rows(polls: DataFrame) -> DataFrame:
    """Normalised station entries; entries without an id are dropped."""
    origin = [c for c in polls.columns if c in _ARRIVAL]
    entries = polls.where(F.col("items").isNotNull()).select(
        "collected_at", *origin, F.posexplode("items").alias("_pos", "_item"))
    return (entries.select("collected_at", *origin, "_pos", *normalise(F.col("_item")))
            .where(F.col("station_id") != ""))


def newest(rows: DataFrame, key: list[str], age: list[str]) -> DataFrame:
    """Last write wins. ``row_number() = 1`` is limited per map task before the shuffle."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in age])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert_rows(polls: DataFrame) -> DataFrame:
    """Rows of a batch, one per (collected_at, station_id): the one that came last."""
    return newest(station_rows(polls), ["collected_at", "station_id"], [*_ARRIVAL, "_pos"]).select(*STATUS_COLUMNS)


def _log_key() -> Column:
    """A poll is known by its time and outcome; one without a time by its place in the landing folder."""
    place = F.concat_ws(":", "_file", F.col("_block").cast("string"), F.col("_line").cast("string"))
    return F.concat_ws("|", "status", F.coalesce("collected_at", place))


def poll_log(polls: DataFrame) -> DataFrame:
    """One row per poll: OK with the number of entries that have an id, or FAIL with a message.

    A poll that came again replaces its row; polls that can't be read each keep their own.
    """
    with_id = F.filter("items", lambda item: F.trim(F.coalesce(pick(item, ALIASES["station_id"]), F.lit(""))) != "")
    logged = polls.select(
        "collected_at", *_ARRIVAL,
        F.when(F.col("items").isNull(), 0).otherwise(F.size(with_id)).alias("n_rows"),
        F.when(F.col("items").isNull(), "FAIL").otherwise("OK").alias("status"),
        F.coalesce("message", F.lit("")).alias("message")).withColumn("poll", _log_key())
    return newest(logged, ["poll"], _ARRIVAL).drop(*_ARRIVAL)


def write_batch(raw: DataFrame, batch_id: int, sink: str) -> None:
    """Write one micro-batch; running it again gives the same folders."""
    polls = parse_polls(with_arrival(raw)).persist()
    try:
        rows = upsert_rows(polls).withColumn("collected_date", F.substring("collected_at", 1, 10))
        (rows.hint("rebalance", F.col("collected_date")).write.mode("overwrite").partitionBy("collected_date")
         .parquet(f"{sink}/status/batch_id={batch_id}"))
        poll_log(polls).write.mode("overwrite").parquet(f"{sink}/log/batch_id={batch_id}")
        (polls.where(F.col("items").isNull()).select("collected_at", "body", "_corrupt_record", "message")
         .write.mode("overwrite").parquet(f"{sink}/quarantine/batch_id={batch_id}"))
    finally:
        polls.unpersist()


def ingest(spark: SparkSession, landing: str, sink: str, checkpoint: str,
           max_files: int | None = None) -> StreamingQuery:
    """Process everything that has landed, then stop. Run it again for later files."""
    return (landing_stream(spark, landing, max_files).writeStream
            .foreachBatch(lambda df, batch_id: write_batch(df, batch_id, sink))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_status(spark: SparkSession, sink: str, first_day: str | None = None,
                last_day: str | None = None, version: int | None = None) -> DataFrame:
    """Current status table: newest batch per (collected_at, station_id), plus ``ts``.

    The optional bounds ('yyyy-MM-dd') are partition filters: only those folders are read.
    """
    stored = stored_status(spark, sink, version)
    if first_day:
        stored = stored.where(F.col("collected_date") >= F.lit(first_day).cast("date"))
    if last_day:
        stored = stored.where(F.col("collected_date") <= F.lit(last_day).cast("date"))
    return (newest(stored, ["collected_at", "station_id"], ["batch_id"])
            .select(*STATUS_COLUMNS, wall_clock("collected_at").alias("ts")))


def read_log(spark: SparkSession, sink: str) -> DataFrame:
    return (newest(spark.read.parquet(f"{sink}/log"), ["poll"], ["batch_id"])
            .select("collected_at", "n_rows", "status", "message"))


def read_quarantine(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.parquet(f"{sink}/quarantine")


def hours_touched(spark: SparkSession, sink: str, batch_id: int) -> DataFrame:
    """Mean availability of the station-hours that a batch wrote to, from the table as it stands now.

    The mean is over the newest row of each poll, so a station that a poll lists twice, or a poll that
    came again, counts once. NULL where no poll of the hour has a count.
    """
    written = spark.read.schema("collected_at string, station_id string, collected_date date").parquet(f"{sink}/status/batch_id={batch_id}")
    hour = hour_floor(wall_clock("collected_at")).alias("hour")
    touched = written.select("station_id", hour).distinct()
    days = written.agg(F.min("collected_date"), F.max("collected_date")).first()
    if days[0] is None:
        return touched.withColumn("inv_act", F.lit(None).cast("double"))  # no readable poll: no row
    # Partition filter: only the days the batch wrote to are read again.
    stored = stored_status(spark, sink).where(F.col("collected_date").between(F.lit(days[0]), F.lit(days[1])))
    stored = stored.where(F.col("batch_id") <= batch_id).select("batch_id", "collected_at", "station_id", "bikes_available", hour)
    current = newest(stored.join(touched, ["station_id", "hour"], "left_semi"), ["collected_at", "station_id"], ["batch_id"])
    return current.groupBy("station_id", "hour").agg(F.avg("bikes_available").alias("inv_act"))


def write_hourly(raw: DataFrame, batch_id: int, sink: str, out: str) -> None:
    """Upserts a micro-batch and writes the hours it touched; running it again gives the same folders."""
    write_batch(raw, batch_id, sink)
    hours_touched(raw.sparkSession, sink, batch_id).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")


def hourly_stream(spark: SparkSession, landing: str, sink: str, out: str, checkpoint: str,
                  max_files: int | None = None) -> StreamingQuery:
    """Streaming form of the hourly mean. Late and corrected polls change their hour, none is dropped."""
    return (landing_stream(spark, landing, max_files).writeStream
            .foreachBatch(lambda df, batch_id: write_hourly(df, batch_id, sink, out))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_hourly(spark: SparkSession, out: str) -> DataFrame:
    """station_id, hour, inv_act: the newest state of each station-hour that has a mean."""
    stored = spark.read.parquet(out)
    return newest(stored, ["station_id", "hour"], ["batch_id"]).where(F.col("inv_act").isNotNull()).select("station_id", "hour", "inv_act")


def _store(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as one of its own."""
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark._jsc.hadoopConfiguration()), made


def versions(spark: SparkSession, sink: str) -> list[int]:
    """Committed versions of the status table, oldest first. Version 0, the batches alone, is not listed."""
    store, path = _store(spark, f"{sink}/versions")
    names = [f.getPath().getName() for f in store.listStatus(path)] if store.exists(path) else []
    return sorted(int(n[1:]) for n in names if re.fullmatch(r"v\d+", n))


def _pointer(spark: SparkSession, sink: str, version: int | None) -> dict | None:
    known = versions(spark, sink)
    version = (known[-1] if known else 0) if version is None else version
    if not version:
        return None
    return json.loads(spark.read.text(f"{sink}/versions/v{version}").first()[0])


def stored_status(spark: SparkSession, sink: str, version: int | None = None) -> DataFrame:
    """Rows of the status table as of a version (the newest if None), with batch_id and collected_date.

    A version names a base folder with the current rows of the days before a day, as of a batch. Of the batch
    folders it leaves out just these days of just these batches, so whether they are still there makes no difference.
    """
    pointer = _pointer(spark, sink, version)
    if pointer is None:
        return spark.read.parquet(f"{sink}/status")
    base = spark.read.parquet(f"{sink}/{pointer['base']}").withColumn("batch_id", F.lit(-1))
    base = base.select(*STATUS_COLUMNS, "batch_id", "collected_date")
    open_days = F.col("collected_date") >= F.lit(pointer["before"]).cast("date")
    batches = spark.read.schema(base.schema).parquet(f"{sink}/status").where(open_days | (F.col("batch_id") > pointer["batch"]))
    return base.unionByName(batches)


def compact(spark: SparkSession, sink: str, before: str) -> int:
    """Makes a version whose days before ``before`` ('yyyy-MM-dd') are one folder of current rows; returns its number.

    The folder is written first; then one rename makes the version's pointer appear. Until then readers see the
    version before, afterwards the new one, and a run that breaks off leaves files that nobody reads. Nothing is
    deleted (see ``vacuum``), so readers of an older version go on, as does the stream. One compaction runs at a time.
    """
    now = stored_status(spark, sink)
    batch = now.agg(F.max("batch_id")).first()[0]
    base = f"base/{uuid.uuid4().hex}"
    closed = now.where((F.col("collected_date") < F.lit(before).cast("date")) & (F.col("batch_id") <= batch))
    (newest(closed, ["collected_at", "station_id"], ["batch_id"]).drop("batch_id").hint("rebalance", F.col("collected_date"))
     .write.partitionBy("collected_date").parquet(f"{sink}/{base}"))
    pointer = _pointer(spark, sink, None) or {"batch": -1}
    version = (versions(spark, sink) or [0])[-1] + 1
    _commit(spark, sink, version, {"base": base, "before": before, "batch": max(batch, pointer["batch"])})
    return version


def _commit(spark: SparkSession, sink: str, version: int, pointer: dict) -> None:
    store, fresh = _store(spark, f"{sink}/versions/new-{uuid.uuid4().hex}")
    out = store.create(fresh, False)
    out.write(bytearray(json.dumps(pointer).encode()))
    out.close()
    target = _store(spark, f"{sink}/versions/v{version}")[1]
    if store.exists(target) or not store.rename(fresh, target):
        raise RuntimeError(f"version {version} of {sink} was made by another compaction")


def vacuum(spark: SparkSession, sink: str, keep: int = 1) -> None:
    """Deletes what no version but the ``keep`` newest ones needs. It may break off anywhere and run again."""
    known = versions(spark, sink)
    if len(known) < max(keep, 1):
        return
    kept = known[-max(keep, 1):]
    pointers = [_pointer(spark, sink, v) for v in kept]
    for folder in _listed(spark, f"{sink}/base"):
        if f"base/{folder.getName()}" not in [p["base"] for p in pointers]:
            _delete(spark, folder)
    oldest = pointers[0]
    for folder in _listed(spark, f"{sink}/status"):
        if int(folder.getName().split("=")[1]) <= oldest["batch"]:
            for day in _listed(spark, folder.toString()):
                if day.getName().split("=")[-1] < oldest["before"]:
                    _delete(spark, day)
    for v in known[:-len(kept)]:
        _delete(spark, _store(spark, f"{sink}/versions/v{v}")[1])


def _listed(spark: SparkSession, path: str) -> list:
    store, path = _store(spark, path)
    return [f.getPath() for f in store.listStatus(path) if f.isDirectory()] if store.exists(path) else []


def _delete(spark: SparkSession, path) -> None:
    _store(spark, path.toString())[0].delete(path, True)
