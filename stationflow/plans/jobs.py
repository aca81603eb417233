"""The end-to-end jobs: ingest, panel, analysis, forecast, export, validation.

Each job reads product tables and writes product tables, so a later job never repeats an
earlier one and a restart begins at the last written table.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timecols import month_key
from ..operators import (cleaning, dedup, demand, export, forecast, moves, panel, quality, robustness,
                         series, snapshots, stations, stl, verify)
from ..runtime import stage, staging_scope
from ..sources import tables, trip_files


def _job(run):
    """A job deletes what it staged on the way; its products stay."""
    @wraps(run)
    def job(first, *args, **kwargs):
        with staging_scope(first if isinstance(first, SparkSession) else first.sparkSession):
            return run(first, *args, **kwargs)
    return job


def _hourly(spark: SparkSession, out: str) -> DataFrame:
    return tables.read_by_month(spark, f"{out}/station_hourly", "ym")


@_job
def run_ingest(spark: SparkSession, raw_dir: str, out: str, **thresholds) -> None:
    """Monthly files -> trips (by month, with duplicate flag), file stats, station tables."""
    manifest = stage(trip_files.file_manifest(spark, raw_dir), "manifest")
    clean = stage(cleaning.clean_trips(trip_files.read_trips(spark, manifest, malformed="malformed"), **thresholds), "clean")
    trips = cleaning.trip_columns(clean)
    tables.write_by_month(cleaning.flag_duplicates(trips), f"{out}/trips")
    stats = quality.file_stats(trips)
    files = manifest.groupBy("src_month").agg(F.min("encoding").alias("encoding"), F.sum("length").alias("bytes"))
    tables.write_table(stats.join(files, "src_month", "left"), f"{out}/ingest_stats")
    tables.write_table(quality.station_daily_events(clean), f"{out}/station_daily_events")
    daily = tables.read_table(spark, f"{out}/station_daily_events")
    attributes = dedup.latest_attributes(dedup.station_sides(clean))
    tables.write_table(stations.life_from_events(daily).join(attributes, "station_id", "left"),
                       f"{out}/station_master_raw")
    completeness = quality.load_completeness(trip_files.read_lines(spark, manifest),
                                             clean.select("file", "malformed"), "malformed")
    tables.write_table(completeness, f"{out}/load_completeness")


@_job
def build_panel(trips: DataFrame, attributes: DataFrame, current_ids: DataFrame, out: str,
                move_rules: dict | None = None, type_rules: dict | None = None) -> None:
    """Raw trips -> deduplicated trips, moves, hourly panel, station master."""
    spark = trips.sparkSession
    tables.write_table(dedup.dedup_trips(trips), f"{out}/trips_dedup")
    unique = tables.read_table(spark, f"{out}/trips_dedup")
    tables.write_table(moves.moves(unique, **(move_rules or {})), f"{out}/bike_moves")
    moved = tables.read_table(spark, f"{out}/bike_moves")
    hours = panel.station_hourly(unique, moved).withColumn("ym", month_key("ts"))
    tables.write_by_month(hours, f"{out}/station_hourly", "ym")
    hourly = _hourly(spark, out)
    master = stations.station_master(hourly, attributes, current_ids, stations.last_day(unique),
                                     **(type_rules or {}))
    tables.write_table(master, f"{out}/station_master")
    tables.write_table(verify.conservation(hourly), f"{out}/conservation")


@_job
def analyse(spark: SparkSession, out: str, **use_rules) -> None:
    """Panel -> observed days, metrics, weekday profiles, daily series and its decomposition."""
    hourly, master = _hourly(spark, out), tables.read_table(spark, f"{out}/station_master")
    tables.write_table(panel.city_days(hourly, master), f"{out}/city_days")
    city = tables.read_table(spark, f"{out}/city_days")
    days = panel.observed_days(city)
    tables.write_table(stations.station_metrics(hourly, master, days, **use_rules), f"{out}/station_metrics")
    metrics = tables.read_table(spark, f"{out}/station_metrics")
    daily = series.full_calendar(series.city_series(city))
    averaged = series.moving_average(series.moving_average(daily, 7), 30)
    tables.write_table(stl.stl(series.interpolate(averaged)), f"{out}/daily_stl")
    tables.write_table(averaged, f"{out}/daily_series")
    tables.write_table(series.dow_hour_matrix(series.dow_hour_sums(hourly, master, days), days),
                       f"{out}/dow_hour")
    tables.write_table(series.daily_profile(hourly, days, metrics.select("station_id")), f"{out}/profiles")


@_job
def stockouts(spark: SparkSession, out: str, min_monthly: float = demand.MIN_MONTHLY,
              threshold: float = demand.DEMAND_THRESHOLD) -> None:
    hourly = _hourly(spark, out)
    master, metrics, city = (tables.read_table(spark, f"{out}/{t}") for t in (
        "station_master", "station_metrics", "city_days"))
    chosen = demand.candidates(metrics, master, min_monthly)
    tables.write_table(panel.dense_panel(hourly, chosen, panel.activity_index(city)), f"{out}/dense")
    dense = tables.read_table(spark, f"{out}/dense")
    flagged = demand.zero_runs(demand.expected_demand(demand.by_station(dense), threshold))
    tables.write_table(demand.stockout_by_station(flagged, chosen), f"{out}/stockout_by_station")
    tables.write_table(demand.stockout_by_hour(flagged), f"{out}/stockout_by_hour")
    tables.write_table(demand.inventory_response(dense, threshold), f"{out}/inventory_response_curve")


@_job
def run_forecast(spark: SparkSession, out: str, fit_stations: int = 20, holdout_days: int = 7 * forecast.HOLDOUT_WEEKS,
                 seasonal_days: int = 7 * forecast.SEASONAL_WEEKS, iterations: int = 300,
                 min_monthly: float = demand.MIN_MONTHLY) -> None:
    hourly = _hourly(spark, out)
    metrics, master, city = (tables.read_table(spark, f"{out}/{t}") for t in (
        "station_metrics", "station_master", "city_days"))
    chosen = demand.candidates(metrics, master, min_monthly)
    axis = panel.continuous_panel(hourly, chosen, panel.observed_days(city))
    features = stage(forecast.with_split(forecast.add_features(axis), holdout_days), "features")
    # The model is fitted on the strongest stations and used for all.
    strongest = stations.top_stations(chosen, fit_stations).select("station_id")
    model = forecast.fit_trees(features.join(F.broadcast(strongest), "station_id", "left_semi"), iterations=iterations)
    test = forecast.predict_trees(model, forecast.test_rows(forecast.add_baselines(features, seasonal_days)))
    tables.write_table(test.select("station_id", "ts", "net_out", "b0_pred", "b1_pred", "b2_pred", "zero_pred"),
                       f"{out}/forecast")
    models = {"B0": "b0_pred", "B1": "b1_pred", "B2": "b2_pred", "zero": "zero_pred"}
    tables.write_table(forecast.score(tables.read_table(spark, f"{out}/forecast"), models, base="B0"),
                       f"{out}/forecast_metrics")
    tables.write_table(forecast.last_days(tables.read_table(spark, f"{out}/forecast"), stations.top_stations(chosen, 1)),
                       f"{out}/forecast_last_days")


@_job
def run_robustness(spark: SparkSession, out: str, periods: dict | None = None,
                   min_rentals: int = robustness.MIN_PERIOD_RENTALS) -> None:
    hourly = _hourly(spark, out)
    master, metrics, city, moved = (tables.read_table(spark, f"{out}/{t}") for t in (
        "station_master", "station_metrics", "city_days", "bike_moves"))
    days = panel.observed_days(city)
    full = stage(robustness.period_flow(hourly, master, days, None, min_rentals), "full")
    rows = [robustness.compare_periods(full, robustness.period_flow(hourly, master, days, span, min_rentals), name)
            for name, span in (periods or robustness.PERIODS).items()]
    tables.write_table(robustness.union_all(rows), f"{out}/robustness")
    tables.write_table(robustness.relocation_time_summary(robustness.relocation_time_sensitivity(moved)),
                       f"{out}/relocation_time")
    tables.write_table(robustness.threshold_sensitivity(metrics), f"{out}/threshold_sensitivity")


@_job
def export_dashboard(spark: SparkSession, out: str, target: str) -> None:
    hourly = _hourly(spark, out)
    master, metrics, city = (tables.read_table(spark, f"{out}/{t}") for t in (
        "station_master", "station_metrics", "city_days"))
    days = panel.observed_days(city)
    daily = series.full_calendar(series.city_series(city))
    tables.write_documents(export.station_documents(
        metrics, export.monthly_arrays(hourly, master, days), export.profile_arrays(hourly, master, days)),
        f"{target}/stations")
    tables.write_documents(export.dashboard_meta(
        daily, days, tables.read_table(spark, f"{out}/trips_dedup")).crossJoin(
        F.broadcast(export.observed_months(days))), f"{target}/meta")
    tables.write_documents(daily.select("d", "n"), f"{target}/daily")


@_job
def validate(spark: SparkSession, out: str, status: DataFrame) -> bool:
    """Estimates against measured availability; False (and nothing written) with too few snapshots."""
    if not tables.enough_snapshots(status):
        return False
    hourly = _hourly(spark, out)
    master, metrics = (tables.read_table(spark, f"{out}/{t}") for t in (
        "station_master", "station_metrics"))
    tables.write_table(snapshots.id_coverage(status, master), f"{out}/live_id_coverage")
    tables.write_table(snapshots.estimate_and_measure(hourly, status), f"{out}/live_pairs")
    paired = tables.read_table(spark, f"{out}/live_pairs")
    tables.write_table(snapshots.change_correlation(paired), f"{out}/live_change_correlation")
    tables.write_table(snapshots.zero_share_contrast(snapshots.zero_share(status), metrics),
                       f"{out}/live_zero_contrast")
    tables.write_table(snapshots.control_presence(status, master), f"{out}/live_control")
    tables.write_table(snapshots.inventory_offset(paired), f"{out}/inventory_offset")
    return True
