"""Station x hour panel and the calendars around it.

After the first aggregate a station has at most one row per hour of the calendar, however
many trips it saw. Windows per station on the panel are therefore bounded by the calendar
(8,760 rows per year) and need no further splitting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timecols import at_hour, day_of
from ..runtime import spread

COUNTS = ["rentals", "returns", "rentals_real", "returns_real", "rentals_to_ctrl", "returns_from_ctrl",
          "reloc_in", "reloc_out", "reloc_in_phys", "reloc_out_phys"]
PANEL_COLUMNS = ["station_id", "ts", *COUNTS, "net_out", "net_flow"]


def _events(rows: DataFrame, station: str, at: str, **ones) -> DataFrame:
    return rows.select(F.col(station).alias("station_id"), day_of(at).alias("d"), F.hour(at).alias("hh"),
                       *[F.when(ones[c], 1).otherwise(0).alias(c) if c in ones else F.lit(0).alias(c)
                         for c in COUNTS])


def station_hourly(trips: DataFrame, moved: DataFrame) -> DataFrame:
    """Sparse hourly panel from one stacked aggregate.

    Each trip and move yields its two station events; one hash aggregate with map-side
    partial sums replaces four aggregates and their joins, so the panel costs one shuffle
    of already combined rows and a busy station is not a hot partition. The four inputs are
    narrow column scans that stay in generated code.
    """
    yes = F.lit(True)
    physical = F.col("move_type") == "RELOCATION"
    events = (_events(trips, "rent_st", "rent_dt", rentals=yes, rentals_real=~F.col("f_cancel"),
                      rentals_to_ctrl=F.col("f_ctrl_ret"))
              .unionByName(_events(trips, "ret_st", "ret_dt", returns=yes, returns_real=~F.col("f_cancel"),
                                   returns_from_ctrl=F.col("f_ctrl_rent")))
              .unionByName(_events(moved, "from_st", "reloc_ts", reloc_out=yes, reloc_out_phys=physical))
              .unionByName(_events(moved, "to_st", "reloc_ts", reloc_in=yes, reloc_in_phys=physical)))
    summed = (events.groupBy("station_id", "d", "hh")
              .agg(*[F.sum(c).cast("int").alias(c) for c in COUNTS]))
    return (summed.withColumn("ts", at_hour("d", "hh"))
            .withColumn("net_out", F.col("rentals") - F.col("returns"))
            .withColumn("net_flow", F.col("returns") - F.col("rentals") + F.col("reloc_in") - F.col("reloc_out"))
            .select(*PANEL_COLUMNS))


def event_days(trips: DataFrame, rent_st: str, rent_dt: str, ret_st: str, ret_dt: str) -> DataFrame:
    """(station, day) -> rental and return events, from one stacked aggregate."""
    def side(station, at, rents):
        return trips.select(F.col(station).alias("station_id"), day_of(at).alias("date"),
                            F.lit(rents).alias("rent_events"), F.lit(1 - rents).alias("ret_events"))

    stacked = side(rent_st, rent_dt, 1).unionByName(side(ret_st, ret_dt, 0))
    return (stacked.where(F.col("station_id").isNotNull() & F.col("date").isNotNull())
            .groupBy("station_id", "date")
            .agg(F.sum("rent_events").cast("int").alias("rent_events"),
                 F.sum("ret_events").cast("int").alias("ret_events")))


def city_days(panel: DataFrame, master: DataFrame) -> DataFrame:
    """Real rentals per day over all stations but control nodes."""
    per_station = (panel.groupBy("station_id", day_of("ts").alias("d"))
                   .agg(F.sum("rentals_real").alias("n")))
    real = master.where(F.col("station_type") != "CONTROL").select("station_id")
    return per_station.join(real, "station_id", "left_semi").groupBy("d").agg(F.sum("n").alias("n"))


def observed_days(days: DataFrame) -> DataFrame:
    """Days with data. Relocations alone do not make a day observed.

    The result has one row per calendar day, and a DATE has fewer than 3.7 million values,
    so broadcasting it is bounded by the type.
    """
    return days.where(F.col("n") > 0).select("d")


def on_observed_days(panel: DataFrame, days: DataFrame) -> DataFrame:
    return (panel.withColumn("d", day_of("ts"))
            .join(F.broadcast(days.select("d")), "d", "left_semi").drop("d"))


def activity_index(days: DataFrame) -> DataFrame:
    """Day total over the mean day total, observed days only."""
    seen = days.where(F.col("n") > 0)
    mean = seen.agg(F.avg("n").alias("_mean"))
    return seen.crossJoin(F.broadcast(mean)).select("d", (F.col("n") / F.col("_mean")).alias("day_index"))


def hour_spine(stations: DataFrame, first: str, last: str) -> DataFrame:
    """Every hour between the two dates of each station, generated per station (no cross join)."""
    days = spread(stations, "station_id").withColumn("d", F.explode(F.sequence(F.col(first), F.col(last))))
    hours = days.withColumn("hh", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return hours.withColumn("ts", at_hour("d", "hh")).drop("hh")


def dense_panel(panel: DataFrame, stations: DataFrame, index: DataFrame,
                first: str = "first_seen", last: str = "last_seen") -> DataFrame:
    """Every observed hour of a station's life, empty hours as 0.

    ``index`` (one row per day) is broadcast; its days are the observed ones.
    """
    spine = hour_spine(stations.select("station_id", first, last), first, last)
    spine = spine.join(F.broadcast(index), "d").select("station_id", "ts", "day_index")
    return (spine.join(panel.select("station_id", "ts", "rentals_real", "net_flow"), ["station_id", "ts"], "left")
            .select("station_id", "ts", F.coalesce("rentals_real", F.lit(0)).alias("rentals"),
                    F.coalesce("net_flow", F.lit(0)).alias("net_flow"), "day_index"))


def continuous_panel(panel: DataFrame, stations: DataFrame, days: DataFrame) -> DataFrame:
    """Every hour from the first to the last observed day; unobserved hours are NULL, not 0."""
    span = days.agg(F.min("d").alias("_first"), F.max("d").alias("_last"))
    spine = hour_spine(stations.select("station_id").crossJoin(F.broadcast(span)), "_first", "_last")
    seen = days.select("d").withColumn("observed", F.lit(True))
    return (spine.join(F.broadcast(seen), "d", "left")
            .join(panel.select("station_id", "ts", "net_out"), ["station_id", "ts"], "left")
            .select("station_id", "ts",
                    F.when(F.col("observed"), F.coalesce("net_out", F.lit(0))).alias("net_out")))
