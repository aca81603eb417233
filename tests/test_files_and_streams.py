import csv
import json
import random
import unicodedata
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stationflow import runtime
from stationflow.operators import cleaning, quality, snapshots
from stationflow.plans import jobs
from stationflow.sources import tables, trip_files
from stationflow.streaming import hourly_state
from stationflow.streaming import snapshots as live


def csv_line(bike, rent, ret, rent_st, ret_st, dur="10", dist="1.5", name="A, \"B\" 역"):
    cells = {c: "" for c in cleaning.RENAME}
    back = {v: k for k, v in cleaning.RENAME.items()}
    for c, v in {"bike_id": bike, "rent_dt": rent, "ret_dt": ret, "rent_st": rent_st, "ret_st": ret_st, "rent_name": name,
                 "ret_name": "관제" if ret_st == "ST0001" else "C", "dur_min": dur, "dist_km": dist, "rent_lat": "36.3",
                 "rent_lon": "127.3", "ret_lat": "36.4", "ret_lon": "127.4", "rent_gu": "유성구", "ret_gu": "서구"}.items():
        cells[back[c]] = v
    return ",".join('"' + v.replace('"', '""') + '"' for v in cells.values())


@pytest.fixture
def raw_dir(tmp_path):
    header = ",".join(cleaning.RENAME)
    january = [csv_line("b1", "2025-01-01 08:00:00", "2025-01-01 08:10:00", "ST1", "ST2"),
               csv_line("b1", "2025-01-01 09:00:00", "2025-01-01 09:10:00", "ST3", "ST0001"),
               csv_line("b1", "2025-01-02 09:00:00", "2025-01-02 09:10:00", "ST0001", "ST1", name="관제센터")]
    march = [csv_line("b2", "2025-03-04 11:02", "2025-03-04 11:12", "ST1", "ST2"), csv_line("b2", "x", "2025-03-04 11:12", "ST1", "ST2")]
    files = {"대여이력(25년01월).csv": ("utf-8-sig", january), "대여이력(25년03월).csv": ("cp949", march),
             unicodedata.normalize("NFD", "대여이력(25년12월).csv"): ("utf-8", january)}
    folder = tmp_path / "raw"
    folder.mkdir()
    for name, (encoding, lines) in files.items():
        (folder / name).write_bytes(("\n".join([header, *lines]) + "\n").encode(encoding))
    return str(folder)


def test_manifest_detects_encoding_and_month(spark, raw_dir):
    got = {r.src_month: (r.encoding, len(trip_files._fields(r.encoding, r.header))) for r in trip_files.file_manifest(spark, raw_dir).collect()}
    # A byte order mark does not change how the lines are decoded.
    assert got == {"202501": ("utf-8", 19), "202503": ("cp949", 19), "202512": ("utf-8", 19)}


def test_encoding_is_judged_by_the_whole_file(spark, tmp_path):
    header = ",".join(cleaning.RENAME.keys())
    plain = "\n".join(csv_line(f"b{i}", "2025-01-01 08:00", "2025-01-01 09:00", "S1", "S2", name="name") for i in range(12_000))
    assert len(plain) > 1_000_000
    ascii_header = ",".join(f"h{i}" for i in range(19))
    (tmp_path / "late(25년01월).csv").write_bytes(f"{ascii_header}\n{plain}\n가나다\n".encode("cp949"))
    (tmp_path / "mixed(25년02월).csv").write_bytes(f"{header}\n".encode() + "가\n".encode("cp949"))
    (tmp_path / "broken(25년03월).csv").write_bytes(b"a,b\n\xff\xff\xff\n")
    got = {r.src_month: r.encoding for r in trip_files.file_manifest(spark, str(tmp_path)).collect()}
    assert got["202501"] == "cp949" and got["202503"] is None
    with pytest.raises(ValueError, match="unknown encoding"):
        trip_files.read_trips(spark, trip_files.file_manifest(spark, str(tmp_path)))


def test_month_is_the_last_one_in_the_path(spark):
    paths = ["/a(24년01월)/trips(25년02월).csv", "/a(24년01월)/part-0.csv", "/a/x.csv"]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string")
    assert [r.m for r in rows.select(trip_files.month_from_path(F.col("p")).alias("m")).collect()] == ["202502", "202401", None]


def test_odd_values_are_flagged_not_fatal(spark):
    rows = [csv_line("b", t, "2025-03-04 12:00", "S1", "S2", dur=d) for t, d in [
        ("2025/03/04 11:02", "NaN"), ("20250304 11:02:03", "99999999999"), ("03/04/2025 11:02", "x"), ("2025.3.4 11:02", "7.9"), ("nonsense", "Infinity")]]
    parsed = spark.createDataFrame([(r,) for r in rows], "v string").select(
        F.from_csv("v", trip_files._ddl(list(cleaning.RENAME)), {"escape": '"'}).alias("r")).select("r.*", F.lit("202503").alias("src_month"))
    got = cleaning.trip_columns(cleaning.clean_trips(cleaning.rename_source(parsed))).collect()
    assert [r.dur_min for r in got] == [-1, -1, -1, 7, -1]
    at = datetime(2025, 3, 4, 11, 2)
    assert [r.rent_dt for r in got] == [at, at.replace(second=3), at, at, None]
    assert [r.f_time_bad for r in got] == [False, False, False, False, True]


def test_trips_are_read_with_their_own_encoding(spark, raw_dir):
    manifest = trip_files.file_manifest(spark, raw_dir)
    rows = trip_files.read_trips(spark, manifest)
    assert {r.src_month: r["count"] for r in rows.groupBy("src_month").count().collect()} == {"202501": 3, "202503": 2, "202512": 3}
    assert {r.rent_name for r in rows.select("rent_name").distinct().collect()} == {'A, "B" 역', "관제센터"}
    assert {r.rent_gu for r in rows.select("rent_gu").distinct().collect()} == {"유성구"}
    clean = cleaning.clean_trips(rows)
    assert clean.where("f_time_bad").count() == 1 and clean.where("f_ctrl_ret").count() == 2
    complete = quality.load_completeness(trip_files.read_lines(spark, manifest), rows).collect()
    assert len(complete) == 3 and all(r.complete for r in complete)


def cell(rnd):
    return "".join(rnd.choice(["a", "역", ",", '""', "\n", "\r\n", " ", "\n\n"]) for _ in range(rnd.randrange(6)))


@pytest.mark.parametrize("block,charset,seed", [("100", "utf-8-sig", 1), ("1000", "cp949", 2), ("64m", "utf-8", 3)])
def test_quoted_line_breaks_equal_csv_reader(spark, tmp_path, block, charset, seed):
    rnd = random.Random(seed)
    names = {"a": "x", "b": "y", "c,d": "z"}
    for month, torn in ((1, True), (2, False), (3, True)):
        lines = ['a,"c,d",b']
        for i in range(50):
            lines.append(f'{i},"{cell(rnd) if torn else "plain"}",{"" if i % 3 else chr(34) + cell(rnd).replace(chr(10), chr(32)).replace(chr(13), "") + chr(34)}')
            if i % 10 == 0:
                lines.append("")
        (tmp_path / f"t(25년0{month}월).csv").write_bytes(("\r\n" if month == 3 else "\n").join(lines).encode(charset))
    want = []
    for path in tmp_path.iterdir():
        with open(path, newline="", encoding=charset) as f:
            rows = [r for r in csv.reader(f) if r]
        want += [(r[0], r[2] or None, r[1] or None) for r in rows[1:]]
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        manifest = trip_files.file_manifest(spark, str(tmp_path))
        rows = trip_files.read_trips(spark, manifest, names, malformed="bad")
        got = [(r.x, r.y or None, r.z or None) for r in rows.collect()]
        complete = quality.load_completeness(trip_files.read_lines(spark, manifest), rows, "bad").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert [(r.source_rows, r.parsed_rows, r.complete) for r in complete] == [(50, 50, True)] * 3


def test_malformed_records_are_not_complete(spark, tmp_path):
    (tmp_path / "t(25년01월).csv").write_text('a,b\n1,2\n3\n"4\n5",6\n7,8,9\n', encoding="utf-8")
    manifest = trip_files.file_manifest(spark, str(tmp_path))
    rows = trip_files.read_trips(spark, manifest, {"a": "x", "b": "y"}, malformed="bad")
    got = quality.load_completeness(trip_files.read_lines(spark, manifest), rows, "bad").first()
    assert (got.source_rows, got.parsed_rows, got.complete) == (4, 2, False)
    (tmp_path / "u(25년02월).csv").write_text('a,b\n1,"2\n', encoding="utf-8")
    with pytest.raises(ValueError, match="quote not closed"):
        trip_files.read_trips(spark, trip_files.file_manifest(spark, str(tmp_path)), {"a": "x", "b": "y"})


def test_missing_column_is_an_error(spark, tmp_path):
    (tmp_path / "t(25년01월).csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="columns missing"):
        trip_files.read_trips(spark, trip_files.file_manifest(spark, str(tmp_path)))


def test_shared_folder_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert runtime.staging_path(spark, "x").startswith(configured)
    df = spark.range(5)
    assert runtime.stage(df, "five").count() == 5
    assert runtime.stage(df.where("id > 9"), "none").columns == ["id"]


def poll(at, body):
    return json.dumps({"collected_at": at, "body": body}, ensure_ascii=False)


def test_stream_upserts_last_write_and_logs_failures(spark, tmp_path):
    landing, sink, progress = (str(tmp_path / n) for n in ("landing", "sink", "progress"))
    (tmp_path / "landing").mkdir()
    t1, t2, t3 = ("2024-01-01T05:00:00+09:00", "2024-01-01T05:05:00+09:00", "2024-01-02T05:05:00+09:00")
    first = [poll(t1, [{"id": "a", "parking_count": 1}, {"id": "a", "parking_count": 2}, {"id": "", "parking_count": 9}]),
             poll(t2, {"x": [], "y": []}), "broken {", "broken {", "bad " + "x" * 2000, poll(t3, {"list": [{"id": "b", "x_pos": 127.3, "y_pos": 36.3}]})]
    (tmp_path / "landing" / "1.json").write_text("\n".join(first))
    live.ingest(spark, landing, sink, progress).awaitTermination()
    def status():
        return sorted((r.collected_at, r.station_id, r.bikes_available, r.lat, r.ts) for r in live.read_status(spark, sink).collect())
    assert status() == [(t1, "a", 2, None, datetime(2024, 1, 1, 5)), (t3, "b", None, 36.3, datetime(2024, 1, 2, 5, 5))]
    log = sorted((r.collected_at or "", r.n_rows, r.status, r.message) for r in live.read_log(spark, sink).collect())
    assert [r[:3] for r in log] == [("", 0, "FAIL")] * 3 + [(t1, 2, "OK"), (t2, 0, "FAIL"), (t3, 1, "OK")]
    assert max(len(r[3]) for r in log) > 2000  # the whole message is kept
    assert live.read_quarantine(spark, sink).count() == 4
    (tmp_path / "landing" / "2.json").write_text(poll(t1, {"results": [{"id": "a", "parking_count": 7}, {"id": "c", "cnt": 1}]}))
    live.ingest(spark, landing, sink, progress).awaitTermination()
    assert [s[:3] for s in status()] == [(t1, "a", 7), (t1, "c", 1), (t3, "b", None)]
    # The same batch again changes nothing.
    live.write_batch(live.landing_batch(spark, f"{landing}/2.json"), 1, sink)
    assert [s[:3] for s in status()] == [(t1, "a", 7), (t1, "c", 1), (t3, "b", None)]
    assert live.read_status(spark, sink, first_day="2024-01-02").count() == 1
    assert live.read_status(spark, sink, last_day="2024-01-01").count() == 2


def test_hourly_stream_counts_the_newest_row_of_each_poll(spark, tmp_path):
    landing, sink, out, progress = (str(tmp_path / n) for n in ("landing", "sink", "out", "progress"))
    (tmp_path / "landing").mkdir()
    def put(name, *polls):
        (tmp_path / "landing" / name).write_text("\n".join(polls))
        live.hourly_stream(spark, landing, sink, out, progress).awaitTermination()
        got = {(r.station_id, r.hour.hour): r.inv_act for r in live.read_hourly(spark, out).collect()}
        table = snapshots.hourly_availability(live.read_status(spark, sink))
        assert got == {(r.station_id, r.ts.hour): r.inv_act for r in table.collect()}
        return got
    def at(hour, minute=0):
        return datetime(2024, 1, 1, hour, minute).isoformat() + "+09:00"
    def one(when, *counts):
        return poll(when, [{"id": "a", "parking_count": c} for c in counts])
    assert put("1.json", one(at(0), 99, 4), one(at(0, 30), 6), one(at(5), 6)) == {("a", 0): 5.0, ("a", 5): 6.0}
    assert put("2.json", one(at(0), 10), one(at(9), 1)) == {("a", 0): 8.0, ("a", 5): 6.0, ("a", 9): 1.0}  # late, and again
    assert put("3.json", "broken {") == {("a", 0): 8.0, ("a", 5): 6.0, ("a", 9): 1.0}
    assert put("4.json", poll(at(5), [{"id": "a"}])) == {("a", 0): 8.0, ("a", 9): 1.0}  # the count is gone
    live.compact(spark, sink, "2024-01-02")
    live.vacuum(spark, sink)
    assert live.read_status(spark, sink).count() == 4
    assert live.stored_status(spark, sink).select("batch_id").distinct().count() == 1
    assert put("5.json", one(at(9, 30), 3)) == {("a", 0): 8.0, ("a", 9): 2.0}


def test_compaction_that_breaks_off_changes_no_row(spark, tmp_path, monkeypatch):
    landing, sink, progress = (str(tmp_path / n) for n in ("in", "sink", "progress"))
    (tmp_path / "in").mkdir()

    def put(name, *days):
        lines = [poll(f"2024-01-0{d}T10:00:00+09:00", [{"id": f"s{i}", "parking_count": len(name) + i} for i in range(3)]) for d in days]
        (tmp_path / "in" / name).write_text("\n".join(lines) + "\n")
        live.ingest(spark, landing, sink, progress).awaitTermination()

    def rows(version=None):
        return sorted(tuple(r) for r in live.read_status(spark, sink, version=version).select("collected_at", "station_id", "bikes_available").collect())

    put("a.json", 1, 2)
    put("bb.json", 1, 3)
    before = rows()
    steps = ["_commit", "_delete", "versions", "_store"]
    real = {n: getattr(live, n) for n in steps}
    for stop in range(12):  # breaks off at each call in turn, of the commit and of the deletions
        calls = []

        def step(name):
            def run(*args):
                calls.append(name)
                if len(calls) > stop:
                    raise OSError("killed")
                return real[name](*args)
            return run
        for n in steps:
            monkeypatch.setattr(live, n, step(n))
        try:
            live.compact(spark, sink, "2024-01-03")
            live.vacuum(spark, sink)
        except OSError:
            pass
        finally:
            for n in steps:
                monkeypatch.setattr(live, n, real[n])
        assert rows() == before
    live.compact(spark, sink, "2024-01-03")
    old = live.versions(spark, sink)[-1]
    put("ccc.json", 1, 4)  # a closed day is corrected after its compaction
    new = rows()
    assert new != before and rows(old) == new  # batches after a version's are part of it
    live.compact(spark, sink, "2024-01-05")
    live.vacuum(spark, sink, keep=2)
    assert rows() == new and rows(old) == new
    live.vacuum(spark, sink)
    live.vacuum(spark, sink)
    assert rows() == new and live.versions(spark, sink) == [old + 1]
    assert live.stored_status(spark, sink).select("batch_id").distinct().collect() == [(-1,)]
    put("dddd.json", 9)
    assert len(rows()) == len(new) + 3


def test_hourly_state_equals_the_status_table(spark, tmp_path):
    """Late polls, corrections, entries listed twice; state of hours behind the watermark is dropped."""
    rnd = random.Random(6)
    landing, sink, out, progress, other = (str(tmp_path / n) for n in ("in", "sink", "out", "progress", "other"))
    (tmp_path / "in").mkdir()
    t0, sizes = datetime(2024, 1, 1), []
    for step in range(6):
        lines = []
        for _ in range(12):  # polls of the last ten hours, some of them again
            at = t0 + timedelta(hours=8 * step + rnd.randrange(-9, 1), minutes=rnd.choice([0, 30]))
            lines.append(poll(at.isoformat() + "+09:00", [{"id": rnd.choice("ab"), "parking_count": rnd.choice([None, 1, 5, 8])} for _ in range(3)]))
        lines.append("broken {")
        (tmp_path / "in" / f"{step}.json").write_text("\n".join(lines) + "\n")
        live.ingest(spark, landing, sink, other).awaitTermination()
        query = hourly_state.hourly_state_stream(spark, landing, out, progress, delay="20 hours")
        query.awaitTermination()
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        got = {(r.station_id, r.hour): r.inv_act for r in live.read_hourly(spark, out).collect()}
        want = {(r.station_id, r.ts): r.inv_act for r in snapshots.hourly_availability(live.read_status(spark, sink)).collect()}
        assert got == want
    # 2 stations, 31 hours at most between the newest poll and the end of the oldest hour kept, 2 polls an hour, one timer each way.
    assert max(sizes) <= 2 * 31 * (2 + 2) and len(want) > 40
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_measured_and_estimated_inventory(spark):
    hours = [datetime(2024, 1, 1) + timedelta(hours=h) for h in range(40)]
    panel = spark.createDataFrame([("a", t, 1 if i % 3 else -1) for i, t in enumerate(hours)], "station_id string, ts timestamp_ntz, net_flow int")
    inv, rows = 10, []
    for i, t in enumerate(hours):
        inv += 1 if i % 3 else -1
        rows += [(t.isoformat(), "a", inv - 1, t), (t.isoformat(), "a", inv + 1, t + timedelta(minutes=30))]
    status = spark.createDataFrame(rows, "collected_at string, station_id string, bikes_available int, ts timestamp_ntz")
    paired = snapshots.estimate_and_measure(panel, status)
    assert paired.count() == 40
    assert snapshots.inventory_offset(paired).first().offset == pytest.approx(10)
    r = snapshots.change_correlation(paired).first()
    assert r.pairs == 39 and r["corr"] == pytest.approx(1)
    assert snapshots.change_correlation(paired, 39).count() == 0
    none = spark.createDataFrame([("z", "CONTROL")], "station_id string, station_type string")
    assert snapshots.control_presence(status, none).first().verdict == "absent"
    assert not tables.enough_snapshots(status) and tables.enough_snapshots(status, 40)
    assert snapshots.id_coverage(status, none).first().warn


def test_jobs_from_raw_files_to_products(spark, raw_dir, tmp_path):
    out = str(tmp_path / "out")
    jobs.run_ingest(spark, raw_dir, out)
    trips = tables.read_by_month(spark, f"{out}/trips")
    assert trips.count() == 8 and not trips.where("f_dup").count()
    stats = {r.src_month: r for r in tables.read_table(spark, f"{out}/ingest_stats").collect()}
    assert stats["202512"].data_month_main == "202501" and stats["202512"].rows_off_month == 3
    raw_master = tables.read_table(spark, f"{out}/station_master_raw")
    assert {r.station_id: r.name for r in raw_master.collect()}["ST1"] in ('A, "B" 역', "C")
    current = spark.createDataFrame([("ST1",), ("ST2",)], "station_id string")
    jobs.build_panel(trips, raw_master.select("station_id", *cleaning.ATTRIBUTES), current, out)
    assert tables.read_table(spark, f"{out}/trips_dedup").count() == 4
    moved = tables.read_table(spark, f"{out}/bike_moves").collect()
    assert [(r.from_st, r.to_st, r.move_type) for r in moved] == [("ST2", "ST3", "RELOCATION")]
    check = tables.read_table(spark, f"{out}/conservation").first()
    assert check.trips_balance and check.relocations_balance and check.net_flow_is_zero
    master = {r.station_id: r for r in tables.read_table(spark, f"{out}/station_master").collect()}
    assert master["ST0001"].station_type == "CONTROL" and master["ST1"].in_current_list and not master["ST3"].in_current_list
