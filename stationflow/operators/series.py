"""Daily series per key: calendars, moving averages, gaps, decomposition, profiles.

A series holds at most one row per calendar day, so windows per series key are bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio, round_even
from ..functions.timecols import day_of, dow, is_weekend
from ..runtime import spread
from .panel import on_observed_days


def full_calendar(daily: DataFrame, key: str = "series_key", day: str = "d", value: str = "n") -> DataFrame:
    """Every day between the first and last of each series; no row or a total of 0 is NULL.

    A zero total means the data is missing, not that nobody rode.
    """
    bounds = daily.groupBy(key).agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    spine = (spread(bounds, key).select(key, F.explode(F.sequence("_a", "_b")).alias(day)))
    return (spine.join(daily.select(key, day, value), [key, day], "left")
            .withColumn(value, F.nullif(F.col(value), F.lit(0))))


def moving_average(series: DataFrame, days: int, key: str = "series_key", day: str = "d",
                   value: str = "n", name: str | None = None) -> DataFrame:
    """Trailing mean over a full window; NULL when any of the days is missing."""
    w = Window.partitionBy(key).orderBy(day).rowsBetween(-(days - 1), 0)
    return series.withColumn(name or f"ma{days}",
                             F.when(F.count(value).over(w) == days, F.avg(value).over(w)))


def interpolate(series: DataFrame, key: str = "series_key", day: str = "d", value: str = "n",
                name: str = "filled") -> DataFrame:
    """Linear interpolation by position; both ends take the nearest value."""
    order = Window.partitionBy(key).orderBy(day)
    forward = order.rowsBetween(Window.unboundedPreceding, 0)
    # Looking ahead as a running window in reverse order stays linear in the series length.
    backward = Window.partitionBy(key).orderBy(F.desc(day)).rowsBetween(Window.unboundedPreceding, 0)
    v = F.col(value).cast("double")
    known = F.when(v.isNotNull(), F.struct(F.col("_pos").alias("p"), v.alias("v")))
    around = (series.withColumn("_pos", F.row_number().over(order))
              .withColumn("_l", F.last(known, ignorenulls=True).over(forward))
              .withColumn("_r", F.last(known, ignorenulls=True).over(backward)))
    left, right = F.col("_l.v"), F.col("_r.v")
    step = (right - left) / (F.col("_r.p") - F.col("_l.p"))
    between = F.when(F.col("_r.p") == F.col("_l.p"), left).otherwise(
        left + step * (F.col("_pos") - F.col("_l.p")))
    return (around.withColumn(name, F.coalesce(between, left, right))
            .drop("_pos", "_l", "_r"))


def decompose(series: DataFrame, period: int = 7, key: str = "series_key", day: str = "d",
              value: str = "filled") -> DataFrame:
    """Additive decomposition: centred moving average, position means, remainder."""
    order = Window.partitionBy(key).orderBy(day)
    half = period // 2
    v = F.col(value)
    wide = order.rowsBetween(-half, half)
    whole = F.count(v).over(wide) == 2 * half + 1
    if period % 2:
        trend = F.avg(v).over(wide)
    else:
        inner = order.rowsBetween(-(half - 1), half - 1)
        ends = F.lag(v, half).over(order) + F.lead(v, half).over(order)
        trend = (F.sum(v).over(inner) + 0.5 * ends) / period
    with_trend = (series.withColumn("_slot", (F.row_number().over(order) - 1) % period)
                  .withColumn("trend", F.when(whole, trend)))
    slot = Window.partitionBy(key, "_slot")
    centred = with_trend.withColumn("_mean", F.avg(v - F.col("trend")).over(slot))
    # Slots differ in length by one row at most; the level is the mean of the slot means.
    level = (centred.groupBy(key, "_slot").agg(F.first("_mean").alias("_m"))
             .groupBy(key).agg(F.avg("_m").alias("_level")))
    return (centred.join(level, key)
            .withColumn("seasonal", F.col("_mean") - F.col("_level"))
            .withColumn("resid", v - F.col("trend") - F.col("seasonal"))
            .drop("_slot", "_mean", "_level"))


def lowest_residuals(parts: DataFrame, k: int = 3, key: str = "series_key", day: str = "d") -> DataFrame:
    """The k days of each series that fall furthest below trend and season."""
    w = Window.partitionBy(key).orderBy("resid", day)
    return (parts.where(F.col("resid").isNotNull()).withColumn("pos", F.row_number().over(w))
            .where(F.col("pos") <= k).select(key, day, "pos", "resid"))


def monthly_means(series: DataFrame, key: str = "series_key", day: str = "d", value: str = "n") -> DataFrame:
    """Per month: observed days and rounded mean per observed day."""
    return (series.where(F.col(value).isNotNull())
            .groupBy(key, F.trunc(day, "MM").alias("month"))
            .agg(F.count(F.lit(1)).alias("days"), F.rint(F.avg(value)).alias("per_day")))


def year_on_year(months: DataFrame, key: str = "series_key") -> DataFrame:
    """Each month with the month twelve before it; months without a partner are left out."""
    before = months.select(key, F.add_months("month", 12).alias("month"), F.col("per_day").alias("year_before"))
    return (months.join(before, [key, "month"])
            .withColumn("change_pct", round_even((ratio("per_day", "year_before") - 1) * 100, 1)))


def seasonal_amplitude(months: DataFrame, key: str = "series_key") -> DataFrame:
    return (months.groupBy(key).agg(F.min("per_day").alias("low"), F.max("per_day").alias("high"))
            .withColumn("amplitude", ratio("high", "low")))


def dow_hour_sums(panel: DataFrame, master: DataFrame, days: DataFrame) -> DataFrame:
    """Real rentals per (day of week, hour) over the observed days, control nodes left out."""
    real = master.where(F.col("station_type") != "CONTROL").select("station_id")
    per_station = (on_observed_days(panel, days)
                   .groupBy("station_id", dow("ts").alias("dow"), F.hour("ts").alias("hh"))
                   .agg(F.sum("rentals_real").alias("n")))
    return (per_station.join(real, "station_id", "left_semi")
            .groupBy("dow", "hh").agg(F.sum("n").alias("n")))


def dow_hour_matrix(sums: DataFrame, days: DataFrame) -> DataFrame:
    """All 7 x 24 cells: mean per observed day of that weekday, empty cells 0."""
    spark = sums.sparkSession
    cells = (spark.range(168).select(F.floor(F.col("id") / 24).cast("int").alias("dow"),
                                     (F.col("id") % 24).cast("int").alias("hh")))
    per_dow = days.groupBy(dow("d").alias("dow")).agg(F.count(F.lit(1)).alias("n_days"))
    return (cells.join(F.broadcast(sums), ["dow", "hh"], "left")
            .join(F.broadcast(per_dow), "dow", "left")
            .select("dow", "hh", (F.coalesce("n", F.lit(0)) / F.col("n_days")).alias("mean_rentals")))


def peak_hours(matrix: DataFrame) -> DataFrame:
    """Busiest hour per day of week; the earliest wins a tie."""
    return matrix.groupBy("dow").agg(
        F.max_by("hh", F.struct(F.col("mean_rentals"), -F.col("hh"))).alias("peak_hour"),
        F.max("mean_rentals").alias("peak_mean"))


def hour_shares(sums: DataFrame) -> DataFrame:
    """Share of each hour in the weekday and the weekend total (48 rows)."""
    merged = (sums.groupBy((F.col("dow") >= 5).alias("weekend"), "hh").agg(F.sum("n").alias("n")))
    total = Window.partitionBy("weekend")
    return merged.withColumn("share_pct", 100 * ratio(F.col("n"), F.sum("n").over(total)))


def hour_bands(shares: DataFrame, bands=((7, 9), (17, 19))) -> DataFrame:
    """Share of the rush-hour bands and the peak hour, weekday against weekend."""
    sums = [F.sum(F.when(F.col("hh").between(a, b), F.col("share_pct")).otherwise(0.0)).alias(f"band_{a}_{b}_pct")
            for a, b in bands]
    return shares.groupBy("weekend").agg(
        *sums, F.max_by("hh", F.struct(F.col("n"), -F.col("hh"))).alias("peak_hour"),
        F.max("share_pct").alias("peak_pct"))


def daily_profile(panel: DataFrame, days: DataFrame, stations: DataFrame | None = None) -> DataFrame:
    """Relative inventory over an average weekday: cumulative flow per hour, starting at 0.

    ``raw`` counts use only, ``all`` includes relocations.
    """
    chosen = panel if stations is None else panel.join(stations.select("station_id"), "station_id", "left_semi")
    n_weekday = days.agg(F.count_if(dow("d") <= 4).alias("n_weekday"))
    sums = (on_observed_days(chosen, days).where(~is_weekend("ts"))
            .groupBy("station_id", F.hour("ts").alias("hh"))
            .agg(F.sum(F.col("returns") - F.col("rentals")).alias("raw_flow"),
                 F.sum("net_flow").alias("all_flow")))
    hours = sums.select("station_id").distinct().withColumn("hh", F.explode(F.sequence(F.lit(0), F.lit(23))))
    running = Window.partitionBy("station_id").orderBy("hh").rowsBetween(Window.unboundedPreceding, 0)
    filled = (hours.join(sums, ["station_id", "hh"], "left").crossJoin(F.broadcast(n_weekday))
              .na.fill(0, ["raw_flow", "all_flow"]))
    return filled.select(
        "station_id", "hh", "raw_flow", "all_flow",
        ratio(F.sum("raw_flow").over(running), "n_weekday").alias("cum_raw"),
        ratio(F.sum("all_flow").over(running), "n_weekday").alias("cum_all"))


def profile_minimum(profile: DataFrame) -> DataFrame:
    """Hour and depth of the lowest point of each profile; the earliest hour wins a tie."""
    return profile.groupBy("station_id").agg(
        F.min_by("hh", F.struct("cum_raw", "hh")).alias("low_hour"), F.min("cum_raw").alias("low"))


def city_series(days: DataFrame, label: str = "city") -> DataFrame:
    return days.select(F.lit(label).alias("series_key"), "d", "n")


def to_daily(rows: DataFrame, at: str, key, measure) -> DataFrame:
    """Daily totals of any dated rows: (series_key, d, n)."""
    return (rows.groupBy(key.alias("series_key"), day_of(at).alias("d"))
            .agg(F.sum(measure).alias("n")))
