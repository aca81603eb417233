"""Windows, sketches, as-of joins, anchors and matching, against brute force."""

import math
import random
from bisect import bisect_left
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stationflow.operators import asof, demand, intervals, matching, sketches

T0 = datetime(2024, 1, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


@pytest.mark.parametrize("n,limit,seed", [(10_000, 50_000, 1), (10_000, 0, 2), (1, 50_000, 3), (7, 0, 4)])
def test_overlaps_of_many_windows(spark, monkeypatch, n, limit, seed):
    monkeypatch.setattr(intervals, "BROADCAST_BINS", limit)
    r = random.Random(seed)
    windows = [(b := r.randrange(0, 400_000), b + r.choice([-3, 0, 1, 5, 30])) for _ in range(n)] + [(200_000, 200_000 + r.choice([10, 30_000]))]
    gaps = [(i, b := r.randrange(-1000, 450_000), b + r.choice([0, 1, 2, 20, 100, 50_000, 300_000, -5])) for i in range(3000)]
    w = spark.createDataFrame([(at(a), at(b)) for a, b in windows] + [(None, at(3)), (at(3), None)], "a timestamp_ntz, b timestamp_ntz")
    g = spark.createDataFrame([(i, at(a), at(b)) for i, a, b in gaps] + [(-1, None, at(9)), (-2, at(9), None)], "i int, s timestamp_ntz, e timestamp_ntz")
    got = {x.i: x.hit for x in intervals.overlaps_windows(g, "s", "e", w, "a", "b", "hit").collect()}
    real = sorted((a, b) for a, b in windows if a < b)
    begins, latest = [a for a, _ in real], []
    for _, b in real:
        latest.append(max(b, latest[-1] if latest else b))
    want = {i: (k := bisect_left(begins, e)) > 0 and latest[k - 1] > s for i, s, e in gaps}
    some = r.sample(gaps, 60)  # the look-up itself against all pairs
    assert all(want[i] == any(a < e and b > s for a, b in real) for i, s, e in some)
    assert got == want | {-1: False, -2: False}
    none = spark.createDataFrame([], w.schema)
    assert {x.hit for x in intervals.overlaps_windows(g, "s", "e", none, "a", "b", "hit").collect()} == {False}


@pytest.mark.parametrize("tolerance", [7, 60, 100_000])
def test_asof_equals_brute_force(spark, tolerance):
    r = random.Random(tolerance)
    rows = [(i, r.choice(["a", "b", None]), r.randrange(5000)) for i in range(400)]
    seen = [(r.choice(["a", "b", None, "c"]), r.randrange(5000), r.choice([None, 1.0, 2.0])) for _ in range(150)]
    left = spark.createDataFrame([(i, k, at(t)) for i, k, t in rows] + [(999, "a", None)], "i int, k string, t timestamp_ntz")
    right = spark.createDataFrame([(k, at(t), v) for k, t, v in seen] + [("a", None, 5.0)], "k string, s timestamp_ntz, v double")
    got = {x.i: (x.obs_at, x.obs_v) for x in asof.join_asof(left, right, "t", "s", ["k"], ["v"], tolerance).collect()}
    want = {999: (None, None)}
    for i, k, t in rows:
        near = [(s, v is not None, v or 0) for key, s, v in seen if key == k and t - tolerance <= s <= t]
        s, there, v = max(near, default=(None, False, 0))
        want[i] = (None if s is None else at(s), v if there else None)
    assert got == want


def test_sketches_merge_over_days(spark):
    r = random.Random(3)
    rows = [("a" if i % 3 else "b", T0 + timedelta(days=i % 40), r.gauss(0, 1), r.randrange(3000)) for i in range(30_000)] + [("c", T0, None, 1), ("a", T0, None, 2)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, x double, i int")
    daily = sketches.daily_sketches(df, ["k"], F.to_date("t"), F.col("x"), F.col("i"))
    assert daily.count() == 81
    for first, last in ((None, None), ("2024-01-05", "2024-01-20")):
        for row in sketches.over_days(daily, ["k"], first, last).collect():
            chosen = [(x, i) for k, t, x, i in rows if k == row.k and (first is None or first <= t.strftime("%Y-%m-%d") <= last)]
            values = sorted(x for x, _ in chosen if x is not None)
            assert row.n == len(values) and abs(row.n_distinct - len({i for _, i in chosen})) <= 0.081 * len({i for _, i in chosen})
            for q, found in zip((0.25, 0.5, 0.75), row.quantiles or ()):
                assert abs(bisect_left(values, found) / len(values) - q) < 0.033
            assert (row.quantiles is None) == (not values)
    assert sketches.over_days(daily, [], "2030-01-01", "2030-01-02").first().n is None


def test_matching_equals_brute_force(spark):
    r = random.Random(8)
    left = [(f"L{i}", f"Station No. {i}", 36.3 + r.random() / 50, 127.3 + r.random() / 50) for i in range(120)]
    right = [(f"R{i}", f"station-{i}" if i % 4 else f"STATION no {i}", y + r.gauss(0, 3e-4), x + r.gauss(0, 3e-4)) for i, (_, _, y, x) in enumerate(left)]
    right += [("Rx", None, 36.31, 127.31), ("Ry", "far", 10.0, 10.0), ("Rz", "Station 1", None, 127.0), (None, "Station 2", 36.3, 127.3)]
    r.shuffle(right)
    schema = "station_id string, name string, lat double, lon double"
    got = sorted((x.left_id, x.right_id) for x in matching.match_stations(*(spark.createDataFrame(rows, schema) for rows in (left, right))).collect())

    def edits(a, b):
        line = list(range(len(b) + 1))
        for i, c in enumerate(a):
            line = [i + 1] + [0] * len(b) if not b else [i + 1, *line[1:]]
            before = list(range(len(b) + 1)) if i == 0 else last
            for j, d in enumerate(b):
                line[j + 1] = min(before[j + 1] + 1, line[j] + 1, before[j] + (c != d))
            last = line
        return line[-1]

    def plain(name):
        return "".join(c for c in (name or "").lower() if c.isalnum())

    pairs = []
    for a, n, y, x in left:
        for b, m, v, u in right:
            if b is not None and v is not None:
                far = round(math.hypot((y - v) * 111_320, (x - u) * 111_320 * 0.8054), 3)
                share = round(edits(plain(n), plain(m)) / max(len(plain(n)), len(plain(m)), 1), 6)
                if far <= 150 and share <= 0.5:
                    pairs.append((round(far / 150 + share, 6), far, a, b))
    best_l, best_r = {}, {}
    for p in sorted(pairs):
        best_l.setdefault(p[2], p)
        best_r.setdefault(p[3], p)
    assert got == sorted((p[2], p[3]) for p in pairs if best_l[p[2]] == p and best_r[p[3]] == p) and len(got) > 60


def test_dawn_anchors_and_drift(spark):
    r = random.Random(2)
    flow = {(s, h): r.randrange(-3, 4) for s in "ab" for h in range(24 * 5)}
    dense = spark.createDataFrame([(s, T0 + timedelta(hours=h), f) for (s, h), f in flow.items()], "station_id string, ts timestamp_ntz, net_flow int")
    got = {(x.station_id, x.ts): x for x in demand.dawn_anchored(dense).collect()}
    for s in "ab":
        inv, anchors, levels = 0, {}, []
        for h in range(24 * 5):
            inv += flow[s, h]
            levels.append(inv)
        for d in range(5):
            anchors[min(range(24 * d + 3, 24 * d + 6), key=lambda h: (levels[h], h))] = True
        last, low = None, min(levels[h] for h in anchors)
        for h in range(24 * 5):
            last = levels[h] if h in anchors else last
            x = got[s, T0 + timedelta(hours=h)]
            assert (x.inv, x.is_anchor, x.level, x.inv_abs) == (levels[h], h in anchors, None if last is None else levels[h] - last, levels[h] - low)
    panel = spark.createDataFrame([("a", T0 + timedelta(hours=12 * i), 3) for i in range(9)] + [("one", T0, 1)], "station_id string, ts timestamp_ntz, net_out int")
    (row,) = demand.drift_slope(panel).collect()
    assert row.hours == 9 and row.drift_per_day == pytest.approx(-6) and row.r2 == pytest.approx(1)
