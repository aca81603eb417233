"""Expected demand, stock-out suspicion and the response of rentals to low inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import correlation, ratio, round_even
from ..functions.timecols import dow, minute_index
from .ranks import many_quantiles

DEMAND_THRESHOLD = 2.0
MIN_RUN = 3
MIN_DEMAND_HOURS = 200
MIN_MONTHLY = 100
TRAILING_ROWS = 168


def candidates(metrics: DataFrame, master: DataFrame, min_monthly: float = MIN_MONTHLY) -> DataFrame:
    """Stations busy enough for a stable expectation, with the bounds of their life."""
    return (metrics.where(F.col("monthly_rentals") >= min_monthly)
            .select("station_id", "name", "gu", "net_out_per_day", "rentals", "reloc_net_in")
            .join(master.select("station_id", "first_seen", "last_seen"), "station_id"))


def by_station(dense: DataFrame) -> DataFrame:
    """One shuffle by station; every window below is per station or finer and reuses it."""
    return dense.repartition("station_id")


def expected_demand(dense: DataFrame, threshold: float = DEMAND_THRESHOLD) -> DataFrame:
    """Adds base_lam, lam and demand_slot.

    The base is the mean of rentals over the day's activity index per (station, weekday,
    hour), so season and weather drop out; multiplying by the index puts them back.
    """
    slot = Window.partitionBy("station_id", dow("ts"), F.hour("ts"))
    return (dense.withColumn("base_lam", F.avg(F.col("rentals") / F.col("day_index")).over(slot))
            .withColumn("lam", F.col("base_lam") * F.col("day_index"))
            .withColumn("demand_slot", F.col("base_lam") >= threshold))


def zero_runs(expected: DataFrame) -> DataFrame:
    """Adds zero_hit (a demand slot without a rental) and the length of its run.

    Runs are over consecutive dense rows, so an unobserved day does not end one and a slot
    without demand does.
    """
    flagged = expected.withColumn("zero_hit", F.col("demand_slot") & (F.col("rentals") == 0))
    per_station = Window.partitionBy("station_id").orderBy("ts")
    per_state = Window.partitionBy("station_id", "zero_hit").orderBy("ts")
    islands = flagged.withColumn("_grp", F.row_number().over(per_station) - F.row_number().over(per_state))
    return (islands.withColumn("run_len", F.count(F.lit(1)).over(
        Window.partitionBy("station_id", "zero_hit", "_grp"))).drop("_grp"))


def _chance():
    """Probability of an empty hour under a Poisson demand, demand slots only."""
    return F.when(F.col("demand_slot"), F.exp(-F.col("lam"))).otherwise(0.0)


def stockout_by_station(flagged: DataFrame, stations: DataFrame, min_run: int = MIN_RUN,
                        min_hours: int = MIN_DEMAND_HOURS) -> DataFrame:
    """Empty demand hours beyond chance per station."""
    sums = flagged.groupBy("station_id").agg(
        F.count_if("demand_slot").alias("demand_hours"),
        F.count_if("zero_hit").alias("zero_hours"),
        F.sum(_chance()).alias("expected_zero_hours"),
        F.count_if(F.col("zero_hit") & (F.col("run_len") >= min_run)).alias("long_run_hours"),
        F.max(F.when(F.col("zero_hit"), F.col("run_len"))).alias("longest_run"))
    excess = F.col("zero_hours") - F.col("expected_zero_hours")
    return (sums
            .withColumn("excess_zero_rate", round_even(ratio(100 * excess, "demand_hours"), 2))
            .withColumn("zero_ratio", round_even(ratio("zero_hours", "expected_zero_hours"), 2))
            .withColumn("naive_rate", round_even(ratio(100 * F.col("zero_hours"), "demand_hours"), 2))
            .join(stations, "station_id", "left")
            .withColumn("rankable", F.col("demand_hours") >= min_hours))


def stockout_summary(stock: DataFrame) -> DataFrame:
    """Medians and correlations over the rankable stations."""
    rankable = stock.where("rankable")
    medians = many_quantiles(rankable, {"excess_zero_rate": {"median_excess": 0.5}, "naive_rate": {"median_naive": 0.5}})
    return rankable.agg(
        F.count(F.lit(1)).alias("stations"),
        correlation("excess_zero_rate", "net_out_per_day").alias("corr_net_out"),
        correlation("naive_rate", "net_out_per_day").alias("corr_naive"),
        correlation("excess_zero_rate", "reloc_net_in").alias("corr_reloc")).crossJoin(F.broadcast(medians))


def stockout_by_hour(flagged: DataFrame) -> DataFrame:
    sums = flagged.groupBy(F.hour("ts").alias("hh")).agg(
        F.count_if("zero_hit").alias("zero_hours"), F.sum(_chance()).alias("chance"),
        F.count_if("demand_slot").alias("demand_hours"))
    return sums.select("hh", "zero_hours", "demand_hours",
                       (100 * ratio(F.col("zero_hours") - F.col("chance"), "demand_hours")).alias("excess_rate"))


def relative_inventory(panel: DataFrame) -> DataFrame:
    """Running sum of the net flow per station."""
    w = Window.partitionBy("station_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return panel.withColumn("inv", F.sum("net_flow").over(w))


def inventory_deviation(dense: DataFrame, rows: int = TRAILING_ROWS) -> DataFrame:
    """Inventory minus its mean over the ``rows`` preceding rows and the current one.

    The frame counts rows (169 by default, fewer at the start), not hours.
    """
    w = Window.partitionBy("station_id").orderBy("ts").rowsBetween(-rows, 0)
    return relative_inventory(dense).withColumn("inv_dev", F.col("inv") - F.avg("inv").over(w))


def previous_state(expected: DataFrame, mode: str = "filtered") -> DataFrame:
    """Demand slots with the deviation that preceded them.

    ``filtered``: that of the previous demand slot of the station (as published).
    ``hour``: that of the hour before, if that hour was observed.
    """
    w = Window.partitionBy("station_id").orderBy("ts")
    if mode == "filtered":
        lagged = expected.where("demand_slot").withColumn("inv_dev_prev", F.lag("inv_dev").over(w))
    elif mode == "hour":
        one_hour = F.make_dt_interval(F.lit(0), F.lit(1), F.lit(0), F.lit(0))
        just_before = F.lag("ts").over(w) == F.col("ts") - one_hour
        lagged = (expected.withColumn("inv_dev_prev", F.when(just_before, F.lag("inv_dev").over(w)))
                  .where("demand_slot"))
    else:
        raise ValueError(f"mode must be 'filtered' or 'hour', not {mode!r}")
    return lagged.where(F.col("inv_dev_prev").isNotNull())


def inventory_deciles(states: DataFrame, parts: int = 10) -> DataFrame:
    w = Window.partitionBy("station_id").orderBy("inv_dev_prev", "ts")
    return states.withColumn("decile", F.ntile(parts).over(w))


def inventory_response(dense: DataFrame, threshold: float = DEMAND_THRESHOLD, mode: str = "filtered",
                       rows: int = TRAILING_ROWS) -> DataFrame:
    """Actual over expected rentals per decile of the preceding inventory deviation.

    A stock-out effect shows as a ratio below 1 in the lowest deciles. The state must come
    before the rentals it explains, or heavy renting itself would look like low stock.
    """
    expected = expected_demand(inventory_deviation(by_station(dense), rows), threshold)
    return (inventory_deciles(previous_state(expected, mode)).groupBy("decile")
            .agg(F.sum("rentals").alias("actual"), F.sum("lam").alias("expected"),
                 F.count(F.lit(1)).alias("n"), F.avg("inv_dev_prev").alias("mean_dev"))
            .withColumn("ratio", ratio("actual", "expected")))


def response_gap(curve: DataFrame) -> DataFrame:
    """Ratio of the lowest to the highest decile."""
    return curve.agg(F.min_by("ratio", "decile").alias("lowest"), F.max_by("ratio", "decile").alias("highest")
                     ).withColumn("low_over_high", ratio("lowest", "highest"))


def dawn_anchored(dense: DataFrame, hours: tuple[int, int] = (3, 5)) -> DataFrame:
    """Inventory level against the dawn minimum, when a station is taken to be at its emptiest.

    ``inv`` is the running sum of net flow. A day's anchor is the dawn hour in which it is lowest (the first of
    them); ``level`` is the running sum since the last anchor, null before the first. ``inv_abs`` is the one offset
    per station that puts its lowest dawn at zero. Station rows are bounded by the calendar.
    """
    w = Window.partitionBy("station_id").orderBy("ts")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    by_day = Window.partitionBy("station_id", F.to_date("ts"))
    rows = dense.withColumn("inv", F.sum("net_flow").over(so_far))
    dawn = F.when(F.hour("ts").between(*hours), F.struct("inv", "ts"))
    rows = rows.withColumn("is_anchor", F.coalesce(F.col("ts") == F.min(dawn).over(by_day)["ts"], F.lit(False)))
    anchor = F.last(F.when(F.col("is_anchor"), F.col("inv")), ignorenulls=True).over(so_far)
    lowest = F.min(F.when(F.col("is_anchor"), F.col("inv"))).over(Window.partitionBy("station_id"))
    return rows.select("station_id", "ts", "inv", "is_anchor", (F.col("inv") - anchor).cast("long").alias("level"), (F.col("inv") - lowest).alias("inv_abs"))


def drift_slope(panel: DataFrame) -> DataFrame:
    """Bikes a day by which a station's inventory would drift if nobody moved any: slope of the running net flow of
    trips over time. The regression is an aggregate of moments, merged like a sum."""
    so_far = Window.partitionBy("station_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    days = minute_index("ts") / F.lit(1440.0)
    rows = panel.select("station_id", F.sum(-F.col("net_out")).over(so_far).alias("raw_inv"),
                        (days - F.min(days).over(Window.partitionBy("station_id"))).alias("day"))
    found = rows.groupBy("station_id").agg(F.count(F.lit(1)).alias("hours"), F.regr_slope("raw_inv", "day").alias("drift_per_day"),
                                           F.regr_r2("raw_inv", "day").alias("r2"))
    return found.where("hours > 1")
