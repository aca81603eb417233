import random
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stationflow.operators import demand, forecast, panel, ranks, robustness, series, stations, stl


@pytest.mark.parametrize("values", [[1.0, 2.0, 2.0, 3.0], [5.0] * 7, [3.0], [random.Random(1).randrange(40) / 4 for _ in range(500)],
                                    [None, 1.0, None, -2.0, 1.0]])
def test_average_ranks(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").repartition(3)
    got = {r["i"]: r["rank"] for r in ranks.average_rank(df, "v").collect()}
    want = pd.Series(values, dtype=float).rank()
    assert [got[i] for i in range(len(values))] == [None if np.isnan(x) else x for x in want]


def test_spearman_equals_ranked_pearson(spark):
    rnd = random.Random(2)
    rows = [(rnd.randrange(30) / 2, rnd.choice([None, *map(float, range(10))])) for _ in range(400)]
    got = ranks.spearman(spark.createDataFrame(rows, "x double, y double"), "x", "y").first()
    pdf = pd.DataFrame(rows, columns=["x", "y"], dtype=float).dropna()
    assert got.n == len(pdf)
    assert got.spearman == pytest.approx(pdf.x.rank().corr(pdf.y.rank()), abs=1e-12)


@pytest.mark.parametrize("n", [1, 2, 11, 1000])
def test_quantiles_are_linear(spark, n):
    rnd = random.Random(n)
    rows = [(rnd.choice("ab"), rnd.randrange(200) / 8) for _ in range(n)]
    shares = {"q10": 0.1, "q50": 0.5, "q99": 0.99, "low": 0.0, "high": 1.0}
    df = spark.createDataFrame(rows, "g string, v double")
    pdf = pd.DataFrame(rows, columns=["g", "v"])
    got = ranks.quantiles(df, "v", shares).first()
    assert [got[s] for s in shares] == pytest.approx([pdf.v.quantile(q) for q in shares.values()], abs=1e-12)
    for r in ranks.quantiles(df, "v", shares, ("g",)).collect():
        part = pdf[pdf.g == r.g].v
        assert [r[s] for s in shares] == pytest.approx([part.quantile(q) for q in shares.values()], abs=1e-12)


def daily(spark, values, key="k", start=date(2024, 1, 1)):
    rows = [(key, start + timedelta(days=i), v) for i, v in enumerate(values) if v != "gap"]
    return spark.createDataFrame(rows, "series_key string, d date, n bigint")


def test_zero_day_is_missing_and_stops_the_average(spark):
    full = series.full_calendar(daily(spark, [5, 0, "gap", 7, 8, 9, 1, 2, 3, 4]))
    assert [r.n for r in full.orderBy("d").collect()] == [5, None, None, 7, 8, 9, 1, 2, 3, 4]
    averaged = [r.ma7 for r in series.moving_average(full, 7).orderBy("d").collect()]
    assert averaged[:9] == [None] * 9 and averaged[9] == pytest.approx(34 / 7)


def test_interpolation_matches_pandas(spark):
    values = ["gap", 5, "gap", "gap", 8, 0, 2, 0]
    df = series.full_calendar(daily(spark, [0, *values[1:]]))
    got = [r.filled for r in series.interpolate(df).orderBy("d").collect()]
    want = pd.Series([np.nan, 5, np.nan, np.nan, 8, np.nan, 2, np.nan]).interpolate(limit_direction="both")
    assert got == pytest.approx(list(want))


def test_decomposition_adds_up(spark):
    values = [50 + i + 10 * ((i % 7) - 3) for i in range(70)]
    parts = series.decompose(series.interpolate(daily(spark, values))).orderBy("d").collect()
    assert parts[0].trend is None and parts[3].trend == pytest.approx(53)
    for r in parts[3:-3]:
        assert r.trend + r.seasonal + r.resid == pytest.approx(r.filled)
        assert r.resid == pytest.approx(0, abs=1e-9)
    assert sum(r.seasonal for r in parts[:7]) == pytest.approx(0, abs=1e-9)
    even = series.decompose(series.interpolate(daily(spark, [10 * (i % 4) for i in range(1, 41)])), period=4)
    assert even.where("trend is not null").agg(F.max(F.abs("resid"))).first()[0] == pytest.approx(0, abs=1e-9)


def test_robust_stl_finds_trend_season_and_outlier(spark):
    n, outlier = 140, 60
    rnd = np.random.default_rng(0)
    season = np.tile([3.0, 1.0, 0.0, -1.0, -3.0, -1.0, 1.0], n // 7)
    y = 100 + 0.2 * np.arange(n) + season + rnd.normal(0, 0.1, n)
    y[outlier] -= 40
    rows = [(k, date(2024, 1, 1) + timedelta(days=i), float(v)) for k in ("a", "b") for i, v in enumerate(y)]
    rows += [("short", date(2024, 1, 1) + timedelta(days=i), 1.0) for i in range(5)]
    got = stl.stl(spark.createDataFrame(rows, "series_key string, d date, filled double")).toPandas()
    a = got[got.series_key == "a"].sort_values("d").reset_index(drop=True)
    assert np.allclose(a.trend + a.seasonal + a.resid, y)
    assert a.resid.idxmin() == outlier and a.resid[outlier] == pytest.approx(-40, abs=1.5)
    inner = slice(14, n - 14)
    assert np.abs(a.trend[inner] - (100 + 0.2 * np.arange(n))[inner]).max() < 0.5
    assert np.abs(a.seasonal[inner] - season[inner]).max() < 1.0
    assert got[got.series_key == "short"].trend.isna().all()


def hourly(spark, rows):
    return spark.createDataFrame([(s, datetime(2024, 1, 1) + timedelta(hours=h), r, f, 1.0) for s, h, r, f in rows],
                                 "station_id string, ts timestamp_ntz, rentals int, net_flow int, day_index double")


def test_run_bridges_an_unobserved_day_but_not_a_quiet_slot(spark):
    rows = [("a", 23, 0, True), ("a", 48, 0, True), ("a", 49, 0, False), ("a", 50, 0, True), ("a", 51, 1, True)]
    df = spark.createDataFrame([(s, datetime(2024, 1, 1) + timedelta(hours=h), r, slot) for s, h, r, slot in rows],
                               "station_id string, ts timestamp_ntz, rentals int, demand_slot boolean")
    got = [(r.zero_hit, r.run_len) for r in demand.zero_runs(df).orderBy("ts").collect()]
    assert got == [(True, 2), (True, 2), (False, 1), (True, 1), (False, 1)]


def test_previous_state_modes(spark):
    rows = [("a", 8, True, 1.0), ("a", 9, False, 2.0), ("a", 10, False, 3.0), ("a", 11, True, 4.0), ("a", 13, True, 5.0)]
    df = spark.createDataFrame([(s, datetime(2024, 1, 1, h), d, v) for s, h, d, v in rows],
                               "station_id string, ts timestamp_ntz, demand_slot boolean, inv_dev double")
    after = demand.previous_state(df).orderBy("ts").collect()
    assert [(r.ts.hour, r.inv_dev_prev) for r in after] == [(11, 1.0), (13, 4.0)]
    before = demand.previous_state(df, "hour").orderBy("ts").collect()
    assert [(r.ts.hour, r.inv_dev_prev) for r in before] == [(11, 3.0)]
    with pytest.raises(ValueError):
        demand.previous_state(df, "other")


def test_trailing_frame_has_169_rows(spark):
    flows = [1 if h == 0 else 0 for h in range(170)]
    df = hourly(spark, [("a", h, 0, f) for h, f in enumerate(flows)])
    got = demand.inventory_deviation(df).orderBy(F.desc("ts")).first()
    assert (got.inv, got.inv_dev) == (1, 0.0)
    jump = hourly(spark, [("a", h, 0, 1 if h == 1 else 0) for h in range(170)])
    assert demand.inventory_deviation(jump).orderBy(F.desc("ts")).first().inv_dev == 0.0
    assert demand.inventory_deviation(jump).orderBy(F.desc("ts")).collect()[1].inv_dev == pytest.approx(1 / 169)


def test_features_match_pandas(spark):
    rnd = random.Random(3)
    y = [None if 30 <= h < 54 else rnd.randrange(-3, 4) for h in range(400)]
    start = datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", start + timedelta(hours=h), v) for h, v in enumerate(y)], "station_id string, ts timestamp_ntz, net_out int")
    got = forecast.add_features(df).orderBy("ts").toPandas()
    s = pd.Series(y, dtype=float)
    for k in forecast.LAGS:
        assert np.allclose(got[f"lag_{k}"].astype(float), s.shift(k), equal_nan=True)
    for r in forecast.ROLLS:
        rolled = s.shift(1).rolling(r, min_periods=max(2, r // 3))
        assert np.allclose(got[f"roll_mean_{r}"].astype(float), rolled.mean(), equal_nan=True)
        assert np.allclose(got[f"roll_std_{r}"].astype(float), rolled.std(), equal_nan=True)
    hours = got.ts.dt.hour
    assert np.allclose(got.hour_sin, np.sin(2 * np.pi * hours / 24)) and list(got.dw) == list(got.ts.dt.dayofweek)


def test_trees_beat_the_mean_on_a_learnable_signal(spark):
    rows = [(s, datetime(2024, 1, 1) + timedelta(hours=h), (h % 24 // 12) * 4 - 2) for s in "ab" for h in range(24 * 40)]
    df = spark.createDataFrame(rows, "station_id string, ts timestamp_ntz, net_out int")
    features = forecast.with_split(forecast.add_features(df), 7)
    model = forecast.fit_trees(features, iterations=5, rate=0.5, depth=3)
    tested = forecast.predict_trees(model, forecast.test_rows(forecast.add_baselines(features, 14)))
    scores = {r.model: r for r in forecast.score(tested, {"B0": "b0_pred", "B1": "b1_pred", "B2": "b2_pred", "zero": "zero_pred"}, base="zero").collect()}
    assert scores["B0"].mae == 0 and scores["B1"].mae == 0 and scores["zero"].mae == 2.0
    assert scores["B2"].mae < 0.5 and scores["B2"].improvement_pct > 75
    assert scores["B0"].n == 2 * 24 * 7


def test_scores_skip_missing_forecasts(spark):
    df = spark.createDataFrame([(1, 2.0, None), (3, 1.0, 3.0), (None, 1.0, 1.0)], "net_out int, a double, b double")
    got = {r.model: (r.n, r.mae, r.rmse) for r in forecast.score(df, {"A": "a", "B": "b"}).collect()}
    assert got == {"A": (2, 1.5, 1.5811), "B": (1, 0.0, 0.0)}


def test_station_types_by_strength_of_rule(spark):
    end = date(2026, 3, 31)
    def row(sid, name, first, last, ratio, events):
        return (sid, name, first, last, (last - first).days + 1, ratio, events)
    rows = [row("ctrl", "관제센터", end - timedelta(days=5), end, 1.0, 10), row("fest", "축제 임시", date(2025, 1, 1), end, 1.0, 9999),
            row("short", "A", date(2025, 1, 1), date(2025, 2, 1), 1.0, 9999), row("new", "A", end - timedelta(days=30), end, 1.0, 9999),
            row("closed", "A", date(2024, 9, 1), date(2025, 6, 1), 1.0, 9999), row("low", None, date(2024, 9, 1), end, 0.4, 100),
            row("active", "A", date(2024, 9, 1), end, 0.9, 100), row("edge", "A", end - timedelta(days=90), end, 0.9, 100),
            row("shortnew", "A", end - timedelta(days=20), end - timedelta(days=7), 1.0, 9999)]
    df = spark.createDataFrame(rows, "station_id string, name string, first_seen date, last_seen date, span_days int, activity_ratio double, total_events bigint")
    ends = spark.createDataFrame([(end,)], "data_end date")
    got = {r.station_id: r.station_type for r in stations.classify_stations(df, ends).collect()}
    assert got == {"ctrl": "CONTROL", "fest": "TEMPORARY", "short": "TEMPORARY", "new": "NEW", "closed": "CLOSED", "low": "LOW_USE",
                   "active": "ACTIVE", "edge": "ACTIVE", "shortnew": "NEW"}


def test_use_types(spark):
    rows = [(29.9, 0.9, 0.1), (30.0, 0.40, 0.80), (30.0, 0.30, 1.10), (30.0, 0.35, 1.0), (30.0, None, 0.1), (None, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "monthly_rentals double, CPI double, WR double").withColumn("u", stations.use_type())
    assert [r.u for r in df.collect()] == ["insufficient", "commute", "leisure", "mixed", "mixed", "insufficient"]


def test_threshold_multiple_uses_rounded_percentages(spark):
    rnd = random.Random(5)
    rows = [(f"s{i}", rnd.random() / 2 + 0.2, rnd.random() + 0.5, 30.0 + i, rnd.random()) for i in range(97)]
    df = spark.createDataFrame(rows, "station_id string, CPI double, WR double, monthly_rentals double, net_out_per_day double")
    got = {r.scenario: r for r in robustness.threshold_sensitivity(df).collect()}
    assert len(got) == 6 and got["uniform"].cpi_commute == 0.25
    pdf = pd.DataFrame(rows, columns=["station_id", "CPI", "WR", "m", "net"])
    assert got["quartiles"].cpi_commute == np.round(pdf.CPI.quantile(0.75), 3)
    for r in got.values():
        commute = (pdf.CPI >= r.cpi_commute) & (pdf.WR <= r.wr_commute)
        top = pdf.nlargest(30, "net").index
        overall, share = np.round(commute.mean() * 100, 1), np.round(commute[top].sum() / 30 * 100, 1)
        assert (r.commute, r.commute_in_top) == (commute.sum(), commute[top].sum())
        assert r.multiple == (np.round(share / overall, 2) if overall else None)


def test_period_comparison(spark):
    a = spark.createDataFrame([(f"s{i}", float(i - 5)) for i in range(12)], "station_id string, npd double")
    b = spark.createDataFrame([(f"s{i}", float(5 - i)) for i in range(10)], "station_id string, npd double")
    r = robustness.compare_periods(a, b, "p", k=3).first()
    assert (r.common_stations, r.rank_corr, r.top_overlap, r.sign_flips, r.flip_pct) == (10, -1.0, 0, 9, 90.0)
    assert tuple(robustness.seasonal_flips(a, b).first()) == (10, 9, 90.0)


def test_dense_panel_covers_life_on_observed_days_only(spark):
    hours = spark.createDataFrame([("a", datetime(2024, 1, 1, 5), 2, 1), ("a", datetime(2024, 1, 2, 5), 0, 1), ("b", datetime(2024, 1, 3, 1), 1, -1)],
                                  "station_id string, ts timestamp_ntz, rentals_real int, net_flow int")
    life = spark.createDataFrame([("a", date(2024, 1, 1), date(2024, 1, 3)), ("b", date(2024, 1, 3), date(2024, 1, 3))],
                                 "station_id string, first_seen date, last_seen date")
    city = spark.createDataFrame([(date(2024, 1, 1), 2), (date(2024, 1, 2), 0), (date(2024, 1, 3), 1)], "d date, n bigint")
    assert [r.d.day for r in panel.observed_days(city).orderBy("d").collect()] == [1, 3]
    dense = panel.dense_panel(hours, life, panel.activity_index(city))
    counts = {r.station_id: (r["n"], r["s"]) for r in dense.groupBy("station_id").agg(F.count(F.lit(1)).alias("n"), F.sum("rentals").alias("s")).collect()}
    assert counts == {"a": (48, 2), "b": (24, 1)}
    axis = panel.continuous_panel(hours.withColumn("net_out", F.col("rentals_real")), life, panel.observed_days(city))
    one = axis.where("station_id = 'a'")
    assert one.count() == 72 and one.where("net_out is null").count() == 24


def test_histogram_counts_every_value(spark):
    values = [float(i % 10) for i in range(100)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r["bin"]: r["n"] for r in stations.histogram(df, "v", 9).collect()}
    want, _ = np.histogram(values, 9)
    assert [got.get(i, 0) for i in range(9)] == list(want)
    assert {r["bin"]: r["n"] for r in stations.histogram(df.where("v = 1"), "v", 9).collect()} == {0: 10}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 16, 17, 63])
def test_buckets_count_the_bounds_below(spark, n):
    bounds = [float(i * i) for i in range(n)]
    values = [-1.0, 0.0, 0.5, *bounds, 1e9, *[b + 0.1 for b in bounds]]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", ranks.bucket_of(F.col("v"), bounds).alias("b")).collect()
    assert all(r.b == sum(b < r.v for b in bounds) for r in rows)


def test_correlation_of_a_constant_is_null(spark):
    """Stations that are never empty all have the rate 0: Spark's own corr divides by that spread."""
    schema = "rankable boolean, excess_zero_rate double, naive_rate double, net_out_per_day double, reloc_net_in long"
    rows = [(True, 0.1 * i, 0.0, 0.3 * i * i, -i) for i in range(6)] + [(True, None, 0.0, 5.0, 5), (False, 9.0, 9.0, 9.0, 9)]
    r = demand.stockout_summary(spark.createDataFrame(rows, schema).repartition(3)).first()
    pdf = pd.DataFrame(rows[:6], columns=["rankable", "x", "naive", "y", "reloc"])
    assert (r.stations, r.median_naive, r.corr_naive) == (7, 0.0, None)
    assert r.corr_net_out == pytest.approx(pdf.x.corr(pdf.y), abs=1e-12)
    assert r.corr_reloc == pytest.approx(-1.0, abs=1e-12)
    # A sum of thirds differs by the order of adding; the value itself is one and the same.
    flat = spark.createDataFrame([(1 / 3, float(i)) for i in range(1000)], "a double, b double").repartition(7)
    got = robustness.correlations(flat, {"ab": ("a", "b"), "ba": ("b", "a"), "bb": ("b", "b")}).first()
    assert (got.ab, got.ba) == (None, None) and got.bb == pytest.approx(1.0, abs=1e-12)
    assert robustness.correlations(flat.where("b < 1"), {"bb": ("b", "b")}).first().bb is None
