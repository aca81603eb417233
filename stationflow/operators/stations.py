"""Station life, types, metrics, and the tables built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip, ratio, round_even
from ..functions.timecols import day_of, dow
from .panel import on_observed_days
from .ranks import many_quantiles, quantiles

# Thresholds of the station typing and of the use types.
NEW_WINDOW_DAYS = 90
CLOSED_WINDOW_DAYS = 90
TEMP_SPAN_DAYS = 60
TEMP_TAIL_DAYS = 7
LOW_USE_RATIO = 0.5
LOW_USE_EVENTS = 500
TEMP_NAME_PATTERN = "축제|행사|임시|팝업|이벤트"
PEAK_HOURS = (7, 8, 9, 17, 18, 19)
CPI_COMMUTE, WR_COMMUTE = 0.40, 0.80
CPI_LEISURE, WR_LEISURE = 0.30, 1.10
MIN_MONTHLY_RENTALS = 30
DAYS_PER_MONTH = 30.44



def _life(days: DataFrame) -> DataFrame:
    """Life summary from one row per (station, day)."""
    return (days.groupBy("station_id").agg(
        F.min("date").alias("first_seen"), F.max("date").alias("last_seen"),
        F.count(F.lit(1)).alias("active_days"),
        F.sum("rent_events").alias("rent_events"), F.sum("ret_events").alias("ret_events"))
        .withColumn("span_days", F.datediff("last_seen", "first_seen") + 1)
        .withColumn("activity_ratio", round_even(ratio("active_days", "span_days"), 4))
        .withColumn("total_events", F.col("rent_events") + F.col("ret_events")))


def life_from_events(daily_events: DataFrame) -> DataFrame:
    """Station life from the rental and return events."""
    return _life(daily_events)


def life_from_panel(panel: DataFrame) -> DataFrame:
    """Station life from the panel, which also sees days with relocations only."""
    return _life(panel.groupBy("station_id", day_of("ts").alias("date")).agg(
        F.sum("rentals").alias("rent_events"), F.sum("returns").alias("ret_events")))


def last_day(trips: DataFrame) -> DataFrame:
    return trips.agg(F.max(day_of("rent_dt")).alias("data_end"))


def classify_stations(stations: DataFrame, data_end: DataFrame, control_keyword: str = "관제",
                      temp_pattern: str = TEMP_NAME_PATTERN, new_days: int = NEW_WINDOW_DAYS,
                      closed_days: int = CLOSED_WINDOW_DAYS, temp_span: int = TEMP_SPAN_DAYS,
                      temp_tail: int = TEMP_TAIL_DAYS, low_ratio: float = LOW_USE_RATIO,
                      low_events: int = LOW_USE_EVENTS) -> DataFrame:
    """Station type. The strongest rule wins: control, temporary, new, closed, low use, active."""
    name = F.coalesce("name", F.lit(""))
    end = F.col("data_end")
    short = (F.col("span_days") < temp_span) & (F.col("last_seen") < F.date_sub(end, temp_tail))
    low = ((F.col("activity_ratio") < low_ratio) & (F.col("total_events") < low_events)
           & (F.col("span_days") >= temp_span))
    kind = (F.when(name.contains(control_keyword), "CONTROL")
            .when(name.rlike(temp_pattern) | short, "TEMPORARY")
            .when(F.col("first_seen") > F.date_sub(end, new_days), "NEW")
            .when(F.col("last_seen") < F.date_sub(end, closed_days), "CLOSED")
            .when(low, "LOW_USE")
            .otherwise("ACTIVE"))
    return (stations.crossJoin(F.broadcast(data_end))
            .withColumn("station_type", kind).drop("data_end"))


def station_master(panel: DataFrame, attributes: DataFrame, current_ids: DataFrame,
                   data_end: DataFrame, **rules) -> DataFrame:
    current = current_ids.select("station_id").distinct().withColumn("in_current_list", F.lit(True))
    described = (life_from_panel(panel).join(attributes, "station_id", "left")
                 .join(current, "station_id", "left")
                 .withColumn("in_current_list", F.coalesce("in_current_list", F.lit(False))))
    return classify_stations(described, data_end, **rules)


def day_counts(days: DataFrame) -> DataFrame:
    """One row: observed days, weekdays, weekend days, months."""
    return days.agg(
        F.count(F.lit(1)).alias("n_days"),
        F.count_if(dow("d") <= 4).alias("n_weekday"),
        F.count_if(dow("d") >= 5).alias("n_weekend")
    ).withColumn("n_months", F.col("n_days") / F.lit(DAYS_PER_MONTH))


def station_sums(panel: DataFrame, master: DataFrame, days: DataFrame,
                 peak_hours=PEAK_HOURS) -> DataFrame:
    """Conditional sums of the active stations over the observed days."""
    weekday, real = dow("ts") <= 4, F.col("rentals_real")
    peak = F.hour("ts").isin(*peak_hours)
    active = master.where(F.col("station_type") == "ACTIVE").select("station_id")
    sums = on_observed_days(panel, days).groupBy("station_id").agg(
        F.sum("rentals").alias("rentals"), F.sum("returns").alias("returns_n"),
        F.sum("rentals_real").alias("rentals_real"), F.sum("net_out").alias("net_out"),
        F.sum("reloc_in_phys").alias("reloc_in"), F.sum("reloc_out_phys").alias("reloc_out"),
        F.sum(F.col("rentals_to_ctrl") + F.col("returns_from_ctrl")).alias("ctrl_events"),
        F.sum(F.when(weekday, real).otherwise(0)).alias("wd_rent"),
        F.sum(F.when(weekday & peak, real).otherwise(0)).alias("wd_peak"),
        F.sum(F.when(~weekday, real).otherwise(0)).alias("we_rent"))
    return sums.join(active, "station_id", "left_semi")


def use_type(cpi_commute=CPI_COMMUTE, wr_commute=WR_COMMUTE, cpi_leisure=CPI_LEISURE,
             wr_leisure=WR_LEISURE, min_monthly=MIN_MONTHLY_RENTALS):
    """Use type expression; thresholds may be numbers or columns. Missing CPI or WR means mixed."""
    return (F.when(~F.coalesce(F.col("monthly_rentals") >= min_monthly, F.lit(False)), "insufficient")
            .when((F.col("CPI") >= cpi_commute) & (F.col("WR") <= wr_commute), "commute")
            .when((F.col("WR") >= wr_leisure) & (F.col("CPI") <= cpi_leisure), "leisure")
            .otherwise("mixed"))


def station_metrics(panel: DataFrame, master: DataFrame, days: DataFrame, peak_hours=PEAK_HOURS,
                    **use_rules) -> DataFrame:
    """One row per active station. Daily means divide by the observed days of the whole city."""
    described = (station_sums(panel, master, days, peak_hours)
                 .crossJoin(F.broadcast(day_counts(days)))
                 .join(master.select("station_id", "name", "gu", "dong", "lat", "lon", "total_events"),
                       "station_id", "left"))
    per_weekend_day = ratio("we_rent", "n_weekend")
    per_weekday = ratio("wd_rent", "n_weekday")
    return (described
            .withColumn("net_out_per_day", round_even(ratio("net_out", "n_days"), 3))
            .withColumn("CPI", round_even(ratio("wd_peak", "wd_rent"), 4))
            .withColumn("WR", round_even(ratio(per_weekend_day, per_weekday), 4))
            .withColumn("ctrl_pct", round_even(
                ratio(100 * F.col("ctrl_events"), F.col("rentals") + F.col("returns_n")), 2))
            .withColumn("reloc_net_in", F.col("reloc_in") - F.col("reloc_out"))
            .withColumn("unmet", F.col("net_out") - F.col("reloc_net_in"))
            .withColumn("monthly_rentals", round_even(ratio("rentals_real", "n_months"), 1))
            .withColumn("use_type", use_type(**use_rules))
            .drop("n_days", "n_weekday", "n_weekend", "n_months"))


def top_stations(metrics: DataFrame, k: int, by: str = "net_out_per_day", lowest: bool = False) -> DataFrame:
    """Top-k report; equal values are ordered by station id."""
    key = F.asc_nulls_last(by) if lowest else F.desc_nulls_last(by)
    return metrics.orderBy(key, "station_id").limit(k)


def trip_classes(trips: DataFrame) -> DataFrame:
    """Trips as general/control to general/control: count, share, durations, distance, round trips.

    A class may hold nearly all trips, so its medians come from distributed running counts.
    """
    def side(flag):
        return F.when(F.col(flag), "control").otherwise("general")

    labelled = trips.withColumn("trip_class", F.concat_ws("->", side("f_ctrl_rent"), side("f_ctrl_ret")))
    sums = labelled.groupBy("trip_class").agg(
        F.count(F.lit(1)).alias("n"), F.avg("dur_min").alias("mean_min"),
        F.avg((F.col("rent_st") == F.col("ret_st")).cast("int")).alias("same_share"))
    total = trips.agg(F.count(F.lit(1)).alias("_all"))
    # Four classes at most.
    medians = many_quantiles(labelled, {"dur_min": {"median_min": 0.5}, "dist_km": {"median_km": 0.5}}, ("trip_class",))
    return (sums.crossJoin(F.broadcast(total)).withColumn("share", ratio("n", "_all")).drop("_all")
            .join(F.broadcast(medians), "trip_class", "left"))


def district_totals(metrics: DataFrame, days: DataFrame) -> DataFrame:
    n = days.agg(F.count(F.lit(1)).alias("_days"))
    return (metrics.groupBy("gu").agg(F.count(F.lit(1)).alias("stations"), F.sum("net_out").alias("net_out"))
            .crossJoin(F.broadcast(n))
            .withColumn("per_station_day", ratio("net_out", F.col("stations") * F.col("_days")))
            .drop("_days"))


def fulfilment(metrics: DataFrame) -> DataFrame:
    """How much of a station's net outflow the relocations brought back."""
    return metrics.select(
        "station_id", "net_out", "reloc_net_in", "unmet",
        round_even(100 * ratio("reloc_net_in", "net_out"), 1).alias("fulfilment_pct"))


def use_type_mix(metrics: DataFrame, k: int = 30) -> DataFrame:
    """Stations per use type, overall and among the top-k net outflow, and mean outflow."""
    top = top_stations(metrics, k).select("station_id", F.lit(1).alias("_top"))
    return (metrics.join(F.broadcast(top), "station_id", "left")
            .groupBy("use_type")
            .agg(F.count(F.lit(1)).alias("stations"), F.count("_top").alias("in_top"),
                 F.avg("net_out_per_day").alias("mean_net_out")))


def direction_symmetry(metrics: DataFrame, k: int = 3) -> DataFrame:
    """Relocation sums of the k strongest sources and sinks; trucks should work against the flow."""
    ends = (top_stations(metrics, k).withColumn("end", F.lit("top"))
            .unionByName(top_stations(metrics, k, lowest=True).withColumn("end", F.lit("bottom"))))
    return ends.groupBy("end").agg(
        F.sum("reloc_in").alias("reloc_in"), F.sum("reloc_out").alias("reloc_out")
    ).withColumn("against_flow", F.when(F.col("end") == "top", F.col("reloc_in") > F.col("reloc_out"))
                 .otherwise(F.col("reloc_out") > F.col("reloc_in")))


def histogram(df: DataFrame, value: str, bins: int, upper_share: float | None = None) -> DataFrame:
    """Equal-width counts between min and max, optionally clipped at an upper quantile."""
    v = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    if upper_share is not None:
        top = quantiles(v, "v", {"_top": upper_share})
        v = v.crossJoin(F.broadcast(top)).select(F.least("v", "_top").alias("v"))
    edges = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    slot = F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))
    return (v.crossJoin(F.broadcast(edges))
            .withColumn("bin", F.when(F.col("hi") > F.col("lo"), slot).otherwise(F.lit(0)))
            .groupBy("bin").agg(F.count(F.lit(1)).alias("n")))


def magnitude_limit(df: DataFrame, columns: list[str], share: float) -> DataFrame:
    """One row: quantile of the absolute values of station-level columns, the range to show."""
    values = df.select(F.explode(F.array(*[F.abs(c) for c in columns])).alias("v"))
    return quantiles(values, "v", {"lim": share})


def map_points(metrics: DataFrame, share: float = 0.98) -> DataFrame:
    """Net outflow clipped at a quantile of its magnitude, for stations with coordinates."""
    located = metrics.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    lim = magnitude_limit(located, ["net_out_per_day"], share)
    return located.crossJoin(F.broadcast(lim)).select(
        "station_id", "lat", "lon", clip("net_out_per_day", -F.col("lim"), F.col("lim")).alias("shown"),
        (F.sqrt("total_events") * 0.28).alias("size"))
