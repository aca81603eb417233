"""Measured availability against the estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import correlation, ratio
from ..functions.timecols import hour_floor
from .demand import relative_inventory
from .ranks import quantiles

MIN_SNAPSHOTS = 200
MIN_PAIRS = 24
WARN_BELOW_PCT = 90


def collection_summary(status: DataFrame, interval_min: int = 5) -> DataFrame:
    """Rows, stations, snapshots, first and last, and the days they amount to."""
    # Two plain aggregates instead of two distinct counts in one, which would double every row.
    polls = status.groupBy("collected_at").agg(F.count(F.lit(1)).alias("_n")).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("snapshots"),
        F.min("collected_at").alias("first"), F.max("collected_at").alias("last"))
    seen = status.select("station_id").distinct().agg(F.count(F.lit(1)).alias("stations"))
    return (polls.crossJoin(F.broadcast(seen))
            .withColumn("days", F.col("snapshots") * interval_min / 60 / 24))


def bikes_per_snapshot(status: DataFrame) -> DataFrame:
    return status.groupBy("collected_at").agg(
        F.count(F.lit(1)).alias("stations"),
        F.sum(F.coalesce("bikes_available", F.lit(0))).alias("bikes"))


def enough_snapshots(status: DataFrame, minimum: int = MIN_SNAPSHOTS) -> DataFrame:
    return (status.agg(F.count_distinct("collected_at").alias("snapshots"))
            .withColumn("enough", F.col("snapshots") >= minimum))


def id_coverage(status: DataFrame, known: DataFrame) -> DataFrame:
    """Share of the measured stations that the history knows; low coverage is a warning."""
    history = known.select("station_id").distinct().withColumn("_hit", F.lit(1))
    return (status.select("station_id").distinct().join(history, "station_id", "left")
            .agg(F.count(F.lit(1)).alias("api_ids"), F.count("_hit").alias("matched"))
            .withColumn("match_pct", 100 * ratio("matched", "api_ids"))
            .withColumn("warn", F.col("match_pct") < WARN_BELOW_PCT))


def hourly_availability(status: DataFrame) -> DataFrame:
    return (status.groupBy("station_id", hour_floor("ts").alias("ts"))
            .agg(F.avg("bikes_available").alias("inv_act"))
            .where(F.col("inv_act").isNotNull()))


def estimate_and_measure(panel: DataFrame, status: DataFrame) -> DataFrame:
    """Hours in which a station has both an estimated and a measured inventory."""
    estimated = relative_inventory(panel).select("station_id", "ts", F.col("inv").alias("inv_est"))
    return estimated.join(hourly_availability(status), ["station_id", "ts"])


def change_correlation(paired: DataFrame, min_pairs: int = MIN_PAIRS) -> DataFrame:
    """Per station: correlation of the row-to-row changes, for stations with enough rows."""
    w = Window.partitionBy("station_id").orderBy("ts")
    changes = paired.select("station_id",
                            (F.col("inv_est") - F.lag("inv_est").over(w)).alias("d_est"),
                            (F.col("inv_act") - F.lag("inv_act").over(w)).alias("d_act"))
    return (changes.where(F.col("d_est").isNotNull() & F.col("d_act").isNotNull())
            .groupBy("station_id").agg(F.count(F.lit(1)).alias("pairs"), correlation("d_est", "d_act").alias("corr"))
            .where((F.col("pairs") > min_pairs) & F.col("corr").isNotNull() & ~F.isnan("corr")))


def correlation_summary(per_station: DataFrame) -> DataFrame:
    quartiles = quantiles(per_station, "corr", {"median": 0.5, "q25": 0.25, "q75": 0.75})
    return per_station.agg(
        F.count(F.lit(1)).alias("stations"),
        (100 * F.avg((F.col("corr") >= 0.5).cast("int"))).alias("at_least_half_pct")).crossJoin(F.broadcast(quartiles))


def zero_share(status: DataFrame) -> DataFrame:
    """Percent of snapshots with no bike; a missing count is not an empty station."""
    empty = F.coalesce(F.col("bikes_available") == 0, F.lit(False))
    return status.groupBy("station_id").agg((100 * F.avg(empty.cast("int"))).alias("zero_pct"))


def zero_share_contrast(shares: DataFrame, metrics: DataFrame) -> DataFrame:
    """Empty share of the strongest against the weakest outflow quarter, and the correlation."""
    both = (shares.join(metrics.select("station_id", "net_out_per_day"), "station_id")
            .where(F.col("net_out_per_day").isNotNull()))
    cuts = quantiles(both, "net_out_per_day", {"_q25": 0.25, "_q75": 0.75})
    x = F.col("net_out_per_day")
    return both.crossJoin(F.broadcast(cuts)).agg(
        F.count(F.lit(1)).alias("stations"), correlation("zero_pct", "net_out_per_day").alias("corr"),
        F.avg(F.when(x > F.col("_q75"), F.col("zero_pct"))).alias("high_pct"),
        F.avg(F.when(x < F.col("_q25"), F.col("zero_pct"))).alias("low_pct"))


def control_presence(status: DataFrame, master: DataFrame) -> DataFrame:
    """Do control nodes show up in the measurements, and with how many bikes?"""
    control = master.where(F.col("station_type") == "CONTROL").select("station_id")
    return (status.join(control, "station_id", "left_semi")
            .agg(F.count(F.lit(1)).alias("rows"), F.avg("bikes_available").alias("mean_bikes"))
            .withColumn("verdict", F.when(F.col("rows") > 0, "present").otherwise("absent")))


def inventory_offset(paired: DataFrame) -> DataFrame:
    """What to add to the estimated (relative) inventory to obtain the measured one."""
    return paired.groupBy("station_id").agg((F.avg("inv_act") - F.avg("inv_est")).alias("offset"))


def offset_summary(offsets: DataFrame) -> DataFrame:
    return (offsets.agg(F.count(F.lit(1)).alias("stations"))
            .crossJoin(F.broadcast(quantiles(offsets, "offset", {"median": 0.5}))))
