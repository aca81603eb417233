"""Does a gap overlap any of many time windows: a semi-join by ranges.

A gap (start, end) overlaps a window [begin, stop) if begin < end and stop > start. Among the windows that begin
before ``end`` only the latest stop matters, so the question is one look-up by ``end``: is the latest stop of all
windows that begin before it after ``start``? Windows that another one covers are left out; the rest are filed
in time bins, each with the latest stop of all earlier bins. A gap of any length meets one bin, so nothing is
spread or found twice, and gaps are joined to bins by equality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timecols import micros
from ..runtime import stage

# Bins that are broadcast; more are joined by a shuffle.
BROADCAST_BINS = 50_000
# A bin is so wide that it holds about so many windows if they are spread evenly.
PER_BIN = 32


def window_bins(windows: DataFrame, begin: str, stop: str) -> tuple[DataFrame, int]:
    """bin, windows (begin and latest stop so far, ascending), before (latest stop of earlier bins); the width of a bin."""
    spans = windows.select(micros(begin).alias("begin"), micros(stop).alias("stop")).where("begin < stop")
    spans = stage(spans.groupBy("begin").agg(F.max("stop").alias("stop")), "windows")
    n, low, high = spans.agg(F.count(F.lit(1)), F.min("begin"), F.max("begin")).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) * PER_BIN // max(n, 1)))
    binned = spans.withColumn("bin", F.floor(F.col("begin") / F.lit(width)))
    inside = Window.partitionBy("bin").orderBy("begin").rowsBetween(Window.unboundedPreceding, 0)
    binned = binned.withColumn("latest", F.max("stop").over(inside))
    kept = binned.where(F.col("stop") == F.col("latest")).groupBy("bin").agg(
        F.array_sort(F.collect_list(F.struct("begin", "stop"))).alias("windows"), F.max("stop").alias("latest"))
    # One row per bin with windows: fewer than windows.
    earlier = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = kept.select("bin", "windows", F.max("latest").over(earlier).alias("before"), F.lead("bin").over(Window.orderBy("bin")).alias("_next"), "latest")
    # Bins without windows up to the next one hold what came before.
    empty = bins.select(F.explode(F.sequence(F.col("bin") + 1, F.coalesce(F.col("_next") - 1, F.col("bin") + 1))).alias("bin"),
                        F.expr("CAST(array() AS array<struct<begin:bigint,stop:bigint>>)").alias("windows"),
                        F.greatest("before", "latest").alias("before"), (F.col("_next") == F.col("bin") + 1).alias("_none")).where("NOT coalesce(_none, false)")
    return stage(bins.drop("_next", "latest").unionByName(empty.drop("_none")), "window_bins"), width


def overlaps_windows(df: DataFrame, start: str, end: str, windows: DataFrame, begin: str, stop: str, name: str = "spans_gap") -> DataFrame:
    """Adds a boolean ``name``: whether (start, end) overlaps any window; false for a null bound."""
    bins, width = window_bins(windows, begin, stop)
    rows, last = bins.agg(F.count(F.lit(1)), F.max("bin")).first()
    columns = df.columns
    if not rows:
        return df.withColumn(name, F.lit(False))
    if rows <= BROADCAST_BINS:
        bins = F.broadcast(bins)
    # A gap that ends after the last window meets the last bin, which is empty.
    gaps = df.withColumns({"_start": micros(start), "_end": micros(end)})
    gaps = gaps.withColumn("bin", F.when(F.col("_end").isNotNull(), F.least(F.floor((F.col("_end") - 1) / F.lit(width)), F.lit(last))))
    hit = (F.col("before") > F.col("_start")) | F.exists("windows", lambda w: (w["begin"] < F.col("_end")) & (w["stop"] > F.col("_start")))
    return gaps.join(bins, "bin", "left").withColumn(name, F.coalesce(hit, F.lit(False))).select(*columns, name)
