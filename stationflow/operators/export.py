"""Array tables behind the dashboard document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_even
from ..functions.timecols import dow, month_label
from .panel import on_observed_days


def _active(panel: DataFrame, master: DataFrame, days: DataFrame) -> DataFrame:
    active = master.where(F.col("station_type") == "ACTIVE").select("station_id")
    return on_observed_days(panel, days).join(active, "station_id", "left_semi")


def observed_months(days: DataFrame) -> DataFrame:
    """One row: the sorted months and the observed days in each."""
    per_month = days.groupBy(month_label("d").alias("ym")).agg(F.count(F.lit(1)).alias("n_days"))
    return (per_month.agg(F.array_sort(F.collect_list(F.struct("ym", "n_days"))).alias("m"))
            .select(F.col("m.ym").alias("months"), F.col("m.n_days").alias("days_per_month")))


def monthly_arrays(panel: DataFrame, master: DataFrame, days: DataFrame) -> DataFrame:
    """Per station one array of rentals and one of returns, a slot per month, empty months 0."""
    sums = (_active(panel, master, days).groupBy("station_id", month_label("ts").alias("ym"))
            .agg(F.sum("rentals").alias("r"), F.sum("returns").alias("b")))
    # The months of the whole panel: as many elements as the calendar has months.
    months = sums.agg(F.array_sort(F.collect_set("ym")).alias("months"))
    maps = sums.groupBy("station_id").agg(
        F.map_from_entries(F.collect_list(F.struct("ym", "r"))).alias("_r"),
        F.map_from_entries(F.collect_list(F.struct("ym", "b"))).alias("_b"))
    return maps.crossJoin(F.broadcast(months)).select(
        "station_id", "months",
        F.expr("transform(months, m -> coalesce(_r[m], 0L))").alias("rentals"),
        F.expr("transform(months, m -> coalesce(_b[m], 0L))").alias("returns"))


def profile_arrays(panel: DataFrame, master: DataFrame, days: DataFrame) -> DataFrame:
    """Per station 168 slots (weekday * 24 + hour) of real rentals and real returns."""
    slot = dow("ts") * 24 + F.hour("ts")
    sums = (_active(panel, master, days).groupBy("station_id", slot.alias("k"))
            .agg(F.sum("rentals_real").alias("r"), F.sum("returns_real").alias("b")))
    maps = sums.groupBy("station_id").agg(
        F.map_from_entries(F.collect_list(F.struct("k", "r"))).alias("_r"),
        F.map_from_entries(F.collect_list(F.struct("k", "b"))).alias("_b"))
    return maps.select(
        "station_id",
        F.expr("transform(sequence(0, 167), k -> coalesce(_r[k], 0L))").alias("rentals"),
        F.expr("transform(sequence(0, 167), k -> coalesce(_b[k], 0L))").alias("returns"))


def days_per_dow(days: DataFrame) -> DataFrame:
    return days.groupBy(dow("d").alias("dow")).agg(F.count(F.lit(1)).alias("n_days"))


def station_documents(metrics: DataFrame, monthly: DataFrame, profile: DataFrame) -> DataFrame:
    """One JSON-ready row per station: description, month arrays and profile arrays."""
    return (metrics.select(
        F.col("station_id").alias("id"), F.col("name").alias("n"), F.col("gu").alias("g"),
        F.col("dong").alias("d"), round_even("lat", 5).alias("la"), round_even("lon", 5).alias("lo"),
        round_even("CPI", 3).alias("cpi"), round_even("WR", 3).alias("wr"), F.col("use_type").alias("t"),
        F.col("reloc_in").alias("ri"), F.col("reloc_out").alias("ro"))
        .join(monthly.select(F.col("station_id").alias("id"),
                             F.array("rentals", "returns").alias("monthly")), "id", "left")
        .join(profile.select(F.col("station_id").alias("id"),
                             F.array("rentals", "returns").alias("profile")), "id", "left"))


def dashboard_meta(daily: DataFrame, days: DataFrame, trips: DataFrame) -> DataFrame:
    """One row of period, day and trip counts; ``daily`` is the full calendar with NULL gaps."""
    total = trips.agg(F.count(F.lit(1)).alias("total_trips"))
    return (daily.agg(F.min("d").alias("first"), F.max("d").alias("last"),
                      F.count("n").alias("obs_days"), F.count_if(F.col("n").isNull()).alias("missing_days"))
            .crossJoin(F.broadcast(days.agg(F.count_if(dow("d") <= 4).alias("weekday_days"))))
            .crossJoin(F.broadcast(total)))
