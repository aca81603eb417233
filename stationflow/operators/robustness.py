"""Do the findings survive another period, another assumption, another threshold?"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import correlation, ratio, round_even
from ..functions.timecols import day_of
from ..runtime import stage
from .panel import on_observed_days
from .ranks import many_quantiles, quantiles, spearman
from .stations import (CPI_COMMUTE, CPI_LEISURE, MIN_MONTHLY_RENTALS, PEAK_HOURS, WR_COMMUTE, WR_LEISURE,
                       top_stations, use_type)

MIN_PERIOD_RENTALS = 300
PERIODS = {"peak": ("2025-04-01", "2025-09-30"), "low": ("2025-11-01", "2026-02-28")}


def in_period(panel: DataFrame, first: str, last: str) -> DataFrame:
    """Rows from the first to the last day, as a plain range on ``ts`` (reaches the scan).

    A panel stored in month folders (column ``ym``) is pruned to the folders it needs.
    """
    start, end = F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("date") + 1
    rows = panel.where((F.col("ts") >= start) & (F.col("ts") < end.cast("timestamp_ntz")))
    return rows.where(F.col("ym").between(first[:7].replace("-", ""), last[:7].replace("-", ""))) if "ym" in panel.columns else rows


def period_flow(panel: DataFrame, master: DataFrame, days: DataFrame, period: tuple[str, str] | None = None,
                min_rentals: int = MIN_PERIOD_RENTALS) -> DataFrame:
    """Net outflow per *own active day* of the active stations within a period.

    The denominator differs from the metrics table, which divides by all observed days.
    """
    rows = panel if period is None else in_period(panel, *period)
    per_day = (on_observed_days(rows, days).groupBy("station_id", day_of("ts").alias("d"))
               .agg(F.sum("net_out").alias("net_out"), F.sum("rentals").alias("rentals")))
    active = master.where(F.col("station_type") == "ACTIVE").select("station_id")
    return (per_day.groupBy("station_id")
            .agg(F.sum("net_out").alias("net_out"), F.sum("rentals").alias("rent"),
                 F.count(F.lit(1)).alias("days"))
            .where(F.col("rent") >= min_rentals)
            .join(active, "station_id", "left_semi")
            .withColumn("npd", ratio("net_out", "days")))


def top_overlap(a: DataFrame, b: DataFrame, k: int, by: str) -> DataFrame:
    """One row: how many of the top-k of one ranking are in the top-k of the other."""
    left = top_stations(a, k, by).select("station_id")
    right = top_stations(b, k, by).select("station_id")
    return left.join(F.broadcast(right), "station_id", "left_semi").agg(F.count(F.lit(1)).alias("overlap"))


def compare_periods(full: DataFrame, part: DataFrame, label: str, k: int = 10) -> DataFrame:
    """Common stations, rank correlation, top-k overlap and sign flips of two periods."""
    # One row per station; three statistics read it.
    common = stage(full.select("station_id", F.col("npd").alias("a"))
                   .join(part.select("station_id", F.col("npd").alias("b")), "station_id"), "common")
    flips = common.agg(F.count_if((F.col("a") > 0) != (F.col("b") > 0)).alias("sign_flips"))
    overlap = top_overlap(common, common.select("station_id", "b").withColumnRenamed("b", "a"), k, "a")
    return (spearman(common, "a", "b")
            .crossJoin(F.broadcast(overlap)).crossJoin(F.broadcast(flips))
            .select(F.lit(label).alias("period"), F.col("n").alias("common_stations"),
                    round_even("spearman", 3).alias("rank_corr"), F.col("overlap").alias("top_overlap"),
                    "sign_flips",
                    round_even(ratio("sign_flips", "n") * 100, 1).alias("flip_pct")))


def seasonal_flips(a: DataFrame, b: DataFrame) -> DataFrame:
    """Stations that are a source in one period and a sink in the other."""
    both = (a.select("station_id", F.col("npd").alias("a"))
            .join(b.select("station_id", F.col("npd").alias("b")), "station_id"))
    opposite = ((F.col("a") > 0) & (F.col("b") < 0)) | ((F.col("a") < 0) & (F.col("b") > 0))
    return both.agg(F.count(F.lit(1)).alias("stations"), F.count_if(opposite).alias("flips")
                    ).withColumn("flip_pct", round_even(ratio("flips", "stations") * 100, 1))


def relocation_time_sensitivity(moved: DataFrame) -> DataFrame:
    """Share of trustworthy relocations per hour, station and assumed relocation time."""
    kept = moved.where((F.col("move_type") == "RELOCATION") & ~F.col("spans_gap"))
    assumed = kept.select(F.col("to_st").alias("station_id"), F.explode(F.array(*[
        F.struct(F.lit(name).alias("assumption"), F.hour(c).alias("hh"))
        for name, c in (("midpoint", "reloc_ts"), ("start", "gap_start"), ("end", "gap_end"))])).alias("a")
    ).groupBy("station_id", "a.assumption", "a.hh").agg(F.count(F.lit(1)).alias("n"))
    # At most 24 rows per window.
    total = F.sum("n").over(Window.partitionBy("station_id", "assumption"))
    return assumed.withColumn("share_pct", 100 * ratio(F.col("n"), total))


def relocation_time_summary(hours: DataFrame) -> DataFrame:
    """Peak hour and night share (0-5 h) per station and assumption."""
    return hours.groupBy("station_id", "assumption").agg(
        F.sum("n").alias("n"),
        F.max_by("hh", F.struct(F.col("n"), -F.col("hh"))).alias("peak_hour"),
        F.sum(F.when(F.col("hh") <= 5, F.col("share_pct")).otherwise(0.0)).alias("night_pct"))


def judged(metrics: DataFrame, min_monthly: float = MIN_MONTHLY_RENTALS) -> DataFrame:
    return metrics.where((F.col("monthly_rentals") >= min_monthly)
                         & F.col("CPI").isNotNull() & F.col("WR").isNotNull())


def distribution(df: DataFrame, value: str, shares=(0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """Quantiles, range, mean and sample deviation of one column (one row)."""
    names = {f"q{round(q * 10000) / 100:g}".replace(".", "_"): q for q in shares}
    moments = df.agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"),
                     F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return quantiles(df, value, names).crossJoin(F.broadcast(moments)).select(
        F.lit(value).alias("column"), "n", *[F.col(c).cast("double").alias(c) for c in
                                             (*names, "min", "max", "mean", "std")])


def share_beyond(df: DataFrame, conditions: dict[str, object]) -> DataFrame:
    """Percent of rows that meet each condition."""
    return df.agg(*[(100 * F.avg(c.cast("int"))).alias(name) for name, c in conditions.items()])


# The published threshold sets.
def threshold_grid(stations: DataFrame, peak_hours=PEAK_HOURS) -> DataFrame:
    """Six threshold sets: as published, from quantiles, the uniform baseline, looser, stricter."""
    names = {c: {f"{c}_{round(s * 100)}": s for s in (0.10, 0.25, 0.75, 0.90)} for c in ("CPI", "WR")}
    found = many_quantiles(stations, names)
    q = found.select(*[round_even(n, 3).alias(n) for n in found.columns])
    uniform = len(peak_hours) / 24.0

    def scenario(name, *values):
        named = zip(("cpi_commute", "wr_commute", "cpi_leisure", "wr_leisure"), values)
        return F.struct(F.lit(name).alias("scenario"), *[
            (v if not isinstance(v, float) else F.lit(v)).alias(c) for c, v in named])

    return q.select(F.inline(F.array(
        scenario("adopted", CPI_COMMUTE, WR_COMMUTE, CPI_LEISURE, WR_LEISURE),
        scenario("quartiles", F.col("CPI_75"), F.col("WR_25"), F.col("CPI_25"), F.col("WR_75")),
        scenario("uniform", uniform, WR_COMMUTE, CPI_LEISURE, WR_LEISURE),
        scenario("loose", 0.35, 0.85, 0.32, 1.05),
        scenario("strict", 0.45, 0.75, 0.28, 1.15),
        scenario("top_tenth", F.col("CPI_90"), F.col("WR_10"), F.col("CPI_10"), F.col("WR_90")))))


def threshold_sensitivity(metrics: DataFrame, min_monthly: float = MIN_MONTHLY_RENTALS, k: int = 30) -> DataFrame:
    """Type counts per threshold set and how far commuter stations crowd the top-k outflow.

    The multiple divides the two already rounded percentages.
    """
    base = judged(metrics, min_monthly)
    grid = threshold_grid(base)
    top = top_stations(metrics, k).select("station_id", F.lit(True).alias("_top"))
    overall = base.agg(F.count(F.lit(1)).alias("_judged"),
                       round_even(correlation("CPI", "net_out_per_day"), 3).alias("cpi_corr"))
    # Six rows: the stations are scanned once, each row meets six scenarios.
    typed = (metrics.select("station_id", "CPI", "WR", "monthly_rentals")
             .join(F.broadcast(top), "station_id", "left")
             .crossJoin(F.broadcast(grid))
             .withColumn("use_type", use_type(F.col("cpi_commute"), F.col("wr_commute"), F.col("cpi_leisure"),
                                              F.col("wr_leisure"), min_monthly)))
    limits = ["cpi_commute", "wr_commute", "cpi_leisure", "wr_leisure"]
    commute = F.col("use_type") == "commute"
    counted = typed.groupBy("scenario", *limits).agg(
        *[F.count_if(F.col("use_type") == t).alias(t) for t in ("commute", "leisure", "mixed", "insufficient")],
        F.count_if(commute & F.coalesce("_top", F.lit(False))).alias("commute_in_top"))
    return (counted.crossJoin(F.broadcast(overall))
            .withColumn("overall_pct", round_even(ratio("commute", "_judged") * 100, 1))
            .withColumn("top_pct", round_even(ratio("commute_in_top", F.lit(k)) * 100, 1))
            .withColumn("multiple", round_even(ratio("top_pct", "overall_pct"), 2))
            .drop("_judged"))


def correlations(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Pearson correlations, each over the rows where both values are present."""
    return df.agg(*[correlation(a, b).alias(name) for name, (a, b) in pairs.items()])


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
