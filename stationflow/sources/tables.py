"""Product tables: parquet by default, CSV and JSON for hand-over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timecols import wall_clock
from ..operators.snapshots import MIN_SNAPSHOTS


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_by_month(df: DataFrame, path: str, column: str = "src_month") -> None:
    """One folder per month. The rebalance hint gives every month few, evenly sized files:
    AQE merges small months and splits one that holds most rows over several tasks."""
    write_table(df.hint("rebalance", F.col(column)), path, [column])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_by_month(spark: SparkSession, path: str, column: str = "src_month") -> DataFrame:
    """The month folders; the month is text although it may look like a number."""
    return spark.read.parquet(path).withColumn(column, F.col(column).cast("string"))


def write_report(df: DataFrame, path: str, order: list | None = None) -> None:
    """Result table as CSV with a header, optionally in order."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", "true").csv(path)


def read_report(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(path)


def write_documents(df: DataFrame, path: str) -> None:
    """One JSON object per line, written by the tasks."""
    df.write.mode("overwrite").json(path)


def snapshots_with_time(status: DataFrame) -> DataFrame:
    """Adds the naive local time of each snapshot; its offset is dropped."""
    return status.withColumn("ts", wall_clock("collected_at"))


def enough_snapshots(status: DataFrame, minimum: int = MIN_SNAPSHOTS) -> bool:
    """Gate before a validation run (one number reaches the driver)."""
    return status.agg(F.count_distinct("collected_at").alias("n")).first()["n"] >= minimum
