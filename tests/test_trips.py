"""Cleaning, duplicates, trajectories; brute force on small frames, with every key hot."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stationflow.operators import chunked, cleaning, dedup, moves, panel, quality, verify

T0 = datetime(2024, 1, 1)
TRIP_SCHEMA = ("bike_id string, rent_dt timestamp_ntz, rent_st string, ret_dt timestamp_ntz, ret_st string, dur_min int, "
               "dist_km float, f_ctrl_rent boolean, f_ctrl_ret boolean, f_cancel boolean, f_dur_out boolean, "
               "f_dist_out boolean, f_time_bad boolean, src_month string")


def trip(bike, start, rent_st, minutes, ret_st, month="202401", dist=1.0, bad=False):
    begin = T0 + timedelta(minutes=start)
    return (bike, begin, rent_st, begin + timedelta(minutes=minutes), ret_st, minutes, dist,
            False, False, False, False, False, bad, month)


def random_trips(n, seed, bikes=5, hot=True):
    rnd = random.Random(seed)
    rows, seen = [], set()
    while len(rows) < n:
        bike = "hot" if hot and rnd.random() < 0.4 else f"b{rnd.randrange(bikes)}"
        row = trip(bike, rnd.randrange(0, 6000), f"s{rnd.randrange(4)}", rnd.randrange(1, 50), f"s{rnd.randrange(4)}")
        if row[:5] not in seen:
            seen.add(row[:5])
            rows.append(row)
    return rows


def brute_moves(rows):
    out = []
    by_bike = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[3], r[2], r[4], r[5])):
        last = by_bike.get(r[0])
        if last is not None and last[4] != r[2]:
            out.append((r[0], last[4], r[2], last[3], r[1]))
        by_bike[r[0]] = r
    return sorted(out)


@pytest.mark.parametrize("hot_rows", [1, 20, 10**9])
@pytest.mark.parametrize("partitions", [1, 7])
def test_moves_equal_brute_force(spark, monkeypatch, hot_rows, partitions):
    monkeypatch.setattr(chunked, "SLICE_ROWS", 45)
    rows = random_trips(400, seed=1)
    random.Random(partitions).shuffle(rows)
    df = spark.createDataFrame(rows, TRIP_SCHEMA).repartition(partitions)
    got = moves.moves(df, hot_rows=hot_rows).select("bike_id", "from_st", "to_st", "gap_start", "gap_end").collect()
    assert sorted(tuple(r) for r in got) == brute_moves(rows)


@pytest.mark.parametrize("hot_rows", [1, 20, 10**9])
def test_positions_equal_brute_force(spark, hot_rows):
    rows = [(None if r[0] == "hot" else r[0], r[1], i) for i, r in enumerate(random_trips(300, seed=2))]
    df = spark.createDataFrame(rows, "k string, at timestamp_ntz, i int")
    got = {r["i"]: (r["seq"], r["prev_i"]) for r in chunked.chained(df, ["k"], ["at", "i"], ["i"], seq="seq", hot_rows=hot_rows, slice_rows=30).collect()}
    want, last = {}, {}
    for k, _, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        n, before = last.get(k, (0, None))
        want[i] = (n + 1, before)
        last[k] = (n + 1, i)
    assert got == want


def test_a_hot_key_within_one_hour_is_cut_equally(spark):
    """All rows of the hot key lie in one hour, most of them in one minute; some repeat."""
    rnd = random.Random(5)
    rows = [("hot", T0 + timedelta(minutes=rnd.choice([7] * 9 + [8, 50])), rnd.randrange(700), i) for i in range(1500)]
    rows += [("hot", T0 + timedelta(minutes=7), 3, 9999)] * 400 + [(f"k{i % 40}", T0 + timedelta(minutes=i), i, i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, at timestamp_ntz, j int, i int").repartition(11)
    slices = chunked.sliced(df.where("k = 'hot'"), ["k"], ["at", "j", "i"], 1900, 100).groupBy("k", "_slice").count().collect()
    assert len(slices) >= 15 and max(r["count"] for r in slices) <= 200
    got = chunked.chained(df, ["k"], ["at", "j", "i"], ["i", "j"], seq="seq", hot_rows=100, slice_rows=100).collect()
    want, last = [], {}
    for row in sorted(rows):
        n, before = last.get(row[0], (0, (None, None)))
        want.append((*row, *before, n + 1))
        last[row[0]] = (n + 1, (row[3], row[2]))
    assert sorted(((r.k, r["at"], r.j, r.i, r.prev_i, r.prev_j, r.seq) for r in got), key=repr) == sorted(want, key=repr)


def test_slices_of_a_hot_key_are_the_only_extra_work(spark):
    df = spark.createDataFrame([("a", T0, 1)] * 5 + [(None, T0, 2)] * 50, "k string, at timestamp_ntz, i int")
    plan = chunked.chained(df, ["k"], ["at", "i"], ["i"], hot_rows=20, slice_rows=10)._jdf.queryExecution().optimizedPlan().toString()
    assert "_hot_k" in plan and plan.count("Window ") == 2
    plan = chunked.chained(df, ["k"], ["at", "i"], ["i"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_tied_rentals_are_ordered_by_the_later_keys(spark):
    rows = [trip("b", 0, "a", 10, "x"), trip("b", 60, "x", 5, "y"), trip("b", 60, "x", 20, "z"), trip("b", 200, "y", 5, "a")]
    expected = brute_moves(rows)
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, TRIP_SCHEMA).repartition(seed + 1)
        got = moves.moves(df).select("bike_id", "from_st", "to_st", "gap_start", "gap_end").collect()
        assert sorted(tuple(r) for r in got) == expected


def test_both_move_plans_agree(spark):
    df = spark.createDataFrame(random_trips(300, seed=3), TRIP_SCHEMA)
    a, b = moves.moves(df), moves.moves_by_position(df)
    assert verify.differing_rows(a, b).count() == 0
    assert verify.difference_summary(a, b).first()["differing"] == 0
    short = a.where("gap_min > 100")
    assert verify.differing_rows(a, short).count() == a.count() - short.count()


def test_move_types_and_confidence(spark):
    rows = [trip("b", 0, "a", 10, "ST0001"), trip("b", 20, "ST1220", 5, "c"), trip("b", 30, "ST0001", 5, "d"),
            trip("b", 3000, "e", 5, "f")]
    got = moves.moves(spark.createDataFrame(rows, TRIP_SCHEMA)).orderBy("gap_start").collect()
    assert [(r.move_type, r.confidence, r.gap_min) for r in got] == [
        ("CONTROL_INTERNAL", "high", 10), ("CONTROL_IN", "high", 5), ("RELOCATION", "low", 2965)]


def test_republished_copy_is_removed_before_bad_times(spark):
    a = trip("b", 0, "a", 10, "x", "202401")
    copy = (*a[:-1], "202412")
    bad_first = trip("c", 0, "a", 10, "x", "202401", bad=True)
    later = (*bad_first[:-2], False, "202402")
    df = spark.createDataFrame([copy, a, bad_first, later], TRIP_SCHEMA)
    kept = dedup.dedup_trips(df).collect()
    assert [(r.bike_id, r.src_month) for r in kept] == [("b", "202401")]


def test_null_keys_form_one_group(spark):
    rows = [(None, *trip("b", 0, "a", 10, "x")[1:])] * 3 + [trip("b", 0, "a", 10, "x")]
    df = spark.createDataFrame(rows, TRIP_SCHEMA)
    assert dedup.dedup_trips(df).count() == 2


@pytest.mark.parametrize("salts", [1, 3])
def test_duplicate_flags_keep_every_row(spark, salts):
    rnd = random.Random(4)
    rows = [trip("b", rnd.randrange(3), "a", 10, "x", f"20240{rnd.randrange(2) + 1}", float(rnd.randrange(3))) for _ in range(200)]
    rows += [trip("hot", 1, "a", 10, "x")] * 300 + [trip("single", 1, "a", 10, "x")]
    df = spark.createDataFrame(rows, TRIP_SCHEMA).repartition(5)
    flagged = cleaning.flag_duplicates(df, salts=salts)
    got = {(r["src_month"], r["bike_id"], r["rent_dt"]): (r["n"], r["firsts"]) for r in flagged.groupBy("src_month", "bike_id", "rent_dt")
           .agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("f_dup")).alias("firsts")).collect()}
    want = {}
    for r in rows:
        key = (r[-1], r[0], r[1])
        want[key] = (want.get(key, (0, 1))[0] + 1, 1)
    assert got == want
    # Same rows as before, and the first one is the smallest of its group.
    assert verify.differing_rows(df, flagged.drop("f_dup")).count() == 0


def test_flags_are_false_on_missing_values(spark):
    names = {v: k for k, v in cleaning.RENAME.items()}
    base = dict.fromkeys(cleaning.RENAME, None)
    rows = []
    for rent, ret, dur, dist, name in [("2024-01-01 00:00", "2024-01-01 00:01:00", "1", "0", "관제센터"), ("x", None, "y", None, None),
                                       ("2024-01-02 00:00:00", "2024-01-01 00:00:00", "2000", "41.5", "A")]:
        rows.append({**base, names["rent_dt"]: rent, names["ret_dt"]: ret, names["dur_min"]: dur, names["dist_km"]: dist,
                     names["rent_name"]: name})
    raw = spark.createDataFrame([tuple(r[c] for c in cleaning.RENAME) for r in rows], ", ".join(f"`{c}` string" for c in cleaning.RENAME))
    got = cleaning.clean_trips(cleaning.rename_source(raw)).select("dur_min", "dist_km", *cleaning.FLAGS).collect()
    assert [tuple(r) for r in got] == [
        (1, 0.0, True, False, True, False, False, False),
        (-1, None, False, False, False, False, False, True),
        (2000, 41.5, False, False, False, True, True, True)]
    with pytest.raises(ValueError, match="missing"):
        cleaning.rename_source(raw.drop(names["rent_st"]))


def test_latest_attribute_skips_nulls(spark):
    schema = ("station_id string, name string, lat double, lon double, gu string, dong string, addr string, src_month string, "
              "seen_at timestamp_ntz, side int, bike_id string")
    def row(name, addr, month, minute, side=0, station="s", gu="g"):
        return (station, name, 1.0, 2.0, gu, "d", addr, month, None if minute is None else T0 + timedelta(minutes=minute), side, "b")
    rows = [row("old", "A", "202401", 5), row(None, "B", "202402", 1), row("mid", None, "202401", 9), row("tie", None, "202401", 9, 1),
            row(None, None, "202403", None), row(None, None, "202401", 1, station="empty", gu=None), row("late", None, "202401", None)]
    got = {r.station_id: (r["name"], r.addr) for r in dedup.latest_attributes(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"s": ("tie", "B"), "empty": (None, None)}


def test_file_stats_and_removed_rows(spark):
    rows = [trip("b", 0, "a", 10, "x", "202402"), trip("b", 0, "a", 10, "x", "202402"), trip("c", 45000, "a", 1, "x", "202402"),
            (None, None, *trip("c", 45000, "a", 1, "x", "202402")[2:])]
    df = spark.createDataFrame(rows, TRIP_SCHEMA)
    r = quality.file_stats(df).first()
    assert (r["rows"], r.data_month_main, r.data_days, r.rows_off_month, r.f_dup, r.f_dup_pct) == (4, "202401", 2, 3, 1, 25.0)
    removed = dedup.rows_removed(df, dedup.dedup_trips(df)).first()
    assert (removed.rows_read, removed.rows_kept, removed.rows_removed) == (4, 3, 1)


def test_panel_conserves_vehicles_and_matches_a_recount(spark):
    df = spark.createDataFrame(random_trips(500, seed=5), TRIP_SCHEMA)
    hourly = panel.station_hourly(df, moves.moves(df))
    check = verify.conservation(hourly).first()
    assert check.trips_balance and check.relocations_balance and check.net_flow_is_zero
    assert check.rentals == 500
    assert verify.panel_recount(hourly, df).first().mismatches == 0
    assert hourly.groupBy("station_id", "ts").count().where("count > 1").count() == 0


def test_trajectory_listing_tags_breaks(spark):
    rows = [trip("b", 0, "a", 10, "x"), trip("b", 60, "x", 5, "y"), trip("b", 100, "z", 5, "a")]
    df = spark.createDataFrame(rows, TRIP_SCHEMA)
    moved = moves.moves(df)
    listed = moves.trajectory_listing(df, moved, moves.most_relocated(moved, 1), 12).orderBy("pos").collect()
    assert [(r.pos, r.break_type, r.break_confidence) for r in listed] == [(1, None, None), (2, None, None), (3, "RELOCATION", "high")]
    chain = moves.control_chain(moves.links(df), ["y"]).first()
    assert (chain.control_returns, chain.next_at_control, chain.chain_pct) == (1, 0, 0.0)


def test_trip_text_is_rendered_once_a_pair(spark, tmp_path):
    """The parsing above the copies meets finished text, not the expressions that render it; polls read written hours."""
    from stationflow.workload.views import THRESHOLDS, Tables

    rows = [(i, f"2024-01-{1 + i % 28:02d} 08:{i % 60:02d}:07", i % 5, ("view", "error", "click")[i % 3], 2.5 * i, '{"k": %d}' % (i % 100)) for i in range(60)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").selectExpr(
        "event_id", "CAST(ts AS timestamp) AS ts", "user_id", "event_type", "value", "props").write.parquet(str(tmp_path / "events.parquet"))
    t = Tables(spark, str(tmp_path))
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        clean = cleaning.clean_trips(cleaning.rename_source(t.raw_trips), **THRESHOLDS)
        above, below = clean._jdf.queryExecution().optimizedPlan().toString().split("Generate explode", 1)
        assert "Station " in below and "Station " not in above
        assert "events.parquet" not in " ".join(t.station_hours.inputFiles())
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    pairs, copied = t.event_pairs.count(), t.event_pairs.where("b.k % 11 = 0").count()
    again = t.event_pairs.where("b.k % 13 = 0 AND day(a.ts) <= 15").count()
    assert clean.count() == pairs + copied + again and pairs == 30
