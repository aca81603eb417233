"""All jobs in a row on the driver's tables; their tables must equal those of the single operators."""

from pyspark.sql import functions as F

from stationflow.operators import cleaning, demand, export, forecast, verify
from stationflow.plans import jobs
from stationflow.sources import tables
from stationflow.workload import views


def test_jobs_chain(spark, tmp_path):
    out, target = str(tmp_path / "products"), str(tmp_path / "dashboard")
    t = views.tables_for(spark, "/root/testdata/sf0.001", "coarse")
    jobs.build_panel(cleaning.trip_columns(t.clean), t.attributes, t.current_ids, out, t.move_rules, views.TYPE_RULES)
    jobs.analyse(spark, out, min_monthly=views.MIN_MONTHLY)

    def product(name):
        return tables.read_table(spark, f"{out}/{name}")
    for name, expected in {"trips_dedup": t.trips, "bike_moves": t.moves, "station_master": t.master, "city_days": t.city,
                           "station_metrics": t.metrics}.items():
        assert verify.differing_rows(product(name), expected).count() == 0, name
    assert verify.differing_rows(tables.read_by_month(spark, f"{out}/station_hourly", "ym").drop("ym"), t.panel).count() == 0
    assert product("daily_stl").where("trend is not null").count() == product("daily_series").count()
    assert product("dow_hour").count() == 168
    assert product("profiles").groupBy("station_id").count().where("count = 24").count() == t.metrics.count()

    jobs.stockouts(spark, out, views.MIN_MONTHLY, views.DEMAND)
    assert verify.differing_rows(product("dense"), t.dense).count() == 0
    same = demand.stockout_by_station(t.flagged, t.candidates).select("station_id", "demand_hours", "zero_hours", "longest_run")
    assert verify.differing_rows(product("stockout_by_station").select(*same.columns), same).count() == 0
    assert product("inventory_response_curve").agg(F.max("decile")).first()[0] <= 10

    jobs.run_forecast(spark, out, 20, views.HOLDOUT_DAYS, views.SEASONAL_DAYS, iterations=2, min_monthly=views.MIN_MONTHLY)
    shown = product("forecast_last_days")
    assert shown.count() > 24 and "b2_pred" in shown.columns and shown.where("b2_pred IS NULL").count() == 0
    scores = {r.model: r for r in product("forecast_metrics").collect()}
    assert set(scores) == {"B0", "B1", "B2", "zero"} and scores["B0"].improvement_pct == 0
    assert scores["zero"].n == forecast.test_rows(t.features).count()

    jobs.run_robustness(spark, out, {"first": ("2024-01-01", "2024-01-15"), "second": ("2024-01-16", "2024-01-31")}, 2)
    assert product("robustness").count() == 2 and product("threshold_sensitivity").count() == 6

    jobs.export_dashboard(spark, out, target)
    documents = spark.read.json(f"{target}/stations")
    assert documents.count() == t.metrics.count()
    assert documents.where((F.size(F.col("profile")[0]) != 168)).count() == 0
    meta = spark.read.json(f"{target}/meta").first()
    assert meta.total_trips == t.trips.count() and meta.months == ["2024-01"]
    assert export.days_per_dow(t.days).agg(F.sum("n_days")).first()[0] == meta.obs_days

    assert jobs.validate(spark, out, t.status.limit(5)) is False
    assert jobs.validate(spark, out, t.status) is True
    assert product("live_control").first().verdict == "present"
    assert product("inventory_offset").count() > 0
