"""Time the headline queries; prints one JSON line.

Every query starts from the input tables: the products it needs (clean text, dedup, moves,
panel, master, metrics) are rebuilt for it unless its name says ``on products``. The sum of
``build_products`` is the chain from raw text to metrics, run once.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from stationflow.workload import queries as _queries  # noqa: F401
from stationflow.workload.registry import REGISTRY, shaped
from stationflow.workload.views import Tables

FROM_SCRATCH = ["csv_trips_clean", "file_quality_items", "duplicate_flags", "dedup_items", "republished_files",
                "gap_midpoints", "net_outflow_top", "seasonal_decomposition", "robust_stl", "snapshot_status"]
ON_PRODUCTS = ["bike_moves", "moves_by_position", "station_hourly", "station_daily_events", "latest_attributes",
               "trip_classes", "dow_hour_matrix", "dense_panel", "stockout_by_station", "inventory_response",
               "forecast_features", "forecast_scores", "forecast_trees", "period_robustness",
               "relocation_time_sensitivity", "threshold_sensitivity", "trip_distance_rank", "change_correlation",
               "profile_arrays"]


# Copies of the events, each with users of their own, in the trial of the chain at a larger size.
TRIAL_FACTOR = int(os.environ.get("BENCH_TRIAL_FACTOR", "20"))


class Trial(Tables):
    """The driver's events many times over."""

    @property
    def events(self):
        copies = F.explode(F.sequence(F.lit(0), F.lit(TRIAL_FACTOR - 1)))
        return (Tables.events.func(self).withColumn("copy", copies)
                .withColumns({"user_id": F.col("user_id") * TRIAL_FACTOR + F.col("copy"),
                              "event_id": F.col("event_id") * TRIAL_FACTOR + F.col("copy")}).drop("copy"))


def timed(run) -> float:
    began = time.perf_counter()
    run()
    return round(time.perf_counter() - began, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="stationflow-")).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")

    def drain(name: str, tables: Tables):
        return lambda: shaped(REGISTRY[name], tables).write.format("noop").mode("overwrite").save()

    timed(drain("gap_midpoints", Tables(spark, sf_dir)))  # JVM warm-up
    seconds = {name: timed(drain(name, Tables(spark, sf_dir, REGISTRY[name].grain))) for name in FROM_SCRATCH}
    products = {g: Tables(spark, sf_dir, g) for g in ("coarse", "fine")}

    def build():
        for t in products.values():
            t.metrics, t.dense, t.features
    seconds["build_products"] = timed(build)
    products["coarse"].status
    for name in ON_PRODUCTS:
        seconds[name] = timed(drain(name, products[REGISTRY[name].grain]))
    # Text trips -> clean -> dedup -> moves -> hourly panel, on TRIAL_FACTOR times the events.
    trial = Trial(spark, sf_dir)
    for step in ("clean", "trips", "moves", "panel"):
        seconds[f"trial_{step}"] = timed(lambda step=step: getattr(trial, step))
    trial_trips = trial.clean.count()
    spark.stop()
    print(json.dumps({"trial_trips": trial_trips, "metric": "total wall-clock of the headline queries", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
