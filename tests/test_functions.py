from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stationflow.functions import numeric, payload, timecols


def one(spark, sql, column):
    return spark.sql(sql).select(column.alias("x")).first()["x"]


def ntz(text):
    return f"timestamp_ntz'{text}'"


def test_minutes_count_crossed_boundaries(spark):
    sql = f"select {ntz('2024-01-01 00:00:59')} a, {ntz('2024-01-01 00:01:00')} b"
    assert one(spark, sql, timecols.minutes_between("a", "b")) == 1
    sql = f"select {ntz('2024-01-01 00:00:00')} a, {ntz('2024-01-01 00:00:59')} b"
    assert one(spark, sql, timecols.minutes_between("a", "b")) == 0
    sql = f"select {ntz('2024-01-02 00:00:00')} a, {ntz('2024-01-01 23:59:59')} b"
    assert one(spark, sql, timecols.minutes_between("a", "b")) == -1


@pytest.mark.parametrize("end, middle", [
    ("2024-01-01 00:00:00.000003", datetime(2024, 1, 1, 0, 0, 0, 2)),
    ("2024-01-01 00:00:00.000005", datetime(2024, 1, 1, 0, 0, 0, 2)),
    ("2024-01-02 00:00:00.000001", datetime(2024, 1, 1, 12)),
    ("2023-12-31 23:00:00", datetime(2023, 12, 31, 23, 30)),
])
def test_midpoint_rounds_half_to_even(spark, end, middle):
    sql = f"select {ntz('2024-01-01 00:00:00')} a, {ntz(end)} b"
    assert one(spark, sql, timecols.midpoint("a", "b")) == middle


def test_timestamps_of_mixed_shape(spark):
    rows = spark.createDataFrame([("2025-03-04 11:02",), ("2025-09-01 00:00:05",), ("x",), (None,), (" 2025-09-01 01:00:00 ",),
                                  ("03/04/2025",)], "t string")
    got = [r[0] for r in rows.select(timecols.parse_timestamp("t")).collect()]
    assert got == [datetime(2025, 3, 4, 11, 2), datetime(2025, 9, 1, 0, 0, 5), None, None, datetime(2025, 9, 1, 1), datetime(2025, 3, 4)]
    got = [r[0] for r in rows.select(timecols.parse_timestamp("t", ["dd/MM/yyyy"])).collect()]
    assert got[-1] == datetime(2025, 4, 3)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Seoul"])
def test_time_parts_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # 02:30 does not exist in New York on this day.
        sql = f"select {ntz('2024-03-10 02:30:15.5')} a, {ntz('2024-03-10 04:30:15.5')} b"
        df = spark.sql(sql).select(
            timecols.hour_floor("a").cast("string").alias("h"), timecols.minutes_between("a", "b").alias("m"),
            timecols.midpoint("a", "b").cast("string").alias("mid"), timecols.month_key("a").alias("k"),
            timecols.dow("a").alias("w"))
        assert tuple(df.first()) == ("2024-03-10 02:00:00", 120, "2024-03-10 03:30:15.5", "202403", 6)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_wall_clock_keeps_local_time(spark):
    assert one(spark, "select '2024-01-01T05:00:00+09:00' t", timecols.wall_clock("t")) == datetime(2024, 1, 1, 5)


def test_window_overlap_is_strict(spark):
    sql = f"select {ntz('2025-02-25 00:00:00')} a, {ntz('2025-02-26 00:00:00')} b"
    assert one(spark, sql, timecols.overlaps_any("a", "b", [("2025-02-26", "2025-03-04")])) is False
    sql = f"select {ntz('2025-02-25 00:00:00')} a, {ntz('2025-02-26 00:00:01')} b"
    assert one(spark, sql, timecols.overlaps_any("a", "b", [("2025-02-26", "2025-03-04")])) is True


def test_numbers(spark):
    assert one(spark, "select 0.125D x", numeric.round_even("x", 2)) == 0.12
    assert one(spark, "select 0.375D x", numeric.round_even("x", 2)) == 0.38
    assert one(spark, "select 1 a, 0 b", numeric.ratio("a", "b")) is None
    assert one(spark, "select 1 a, 4 b", numeric.ratio("a", "b")) == 0.25
    assert one(spark, "select ' 1.5 ' a", numeric.number("a")) == 1.5
    assert one(spark, "select 'x' a", numeric.number("a")) is None
    assert one(spark, "select 7.0D a", numeric.clip("a", 1.0, 5.0)) == 5.0
    assert one(spark, "select cast(null as double) a", numeric.clip("a", 1.0, 5.0)) is None


@pytest.mark.parametrize("body, n", [
    ('[{"id":"a"}]', 1), ('{"results":[{"id":"a"},{"id":"b"}]}', 2), ('{"results":"none","data":[{"id":"a"}]}', 1),
    ('{"meta":{"x":1},"rows":[{"id":"a"}]}', 1), ('{"a":[1],"b":[2]}', None), ('{"a":1}', None), ("not json", None),
    ('"text"', None), ("[]", 0), ('{"data":[],"results":[{"id":"a"}]}', 1), (None, None),
])
def test_station_list_is_found(spark, body, n):
    df = spark.createDataFrame([(body,)], "b string").select(payload.unwrap(F.col("b")).alias("x"))
    got = df.select(F.size("x").alias("n"), F.col("x").isNull().alias("missing")).first()
    assert (None if got["missing"] else got["n"]) == n


def test_fields_are_normalised(spark):
    body = ('[{"id":" ST1 ","name":"","station_name":"N","x_pos":"127.3","y_pos":36.3,"parking_count":"4.9"},'
            '{"station_id":7,"lat":36.3,"lng":127.3,"available":3,"addr":"A"},{"name":"no id","cnt":"x","x_pos":null,"lat":36.0}]')
    df = (spark.createDataFrame([(body,)], "b string")
          .select(F.explode(payload.unwrap(F.col("b"))).alias("i")).select(*payload.normalise(F.col("i"))).drop("raw_json"))
    assert [tuple(r) for r in df.collect()] == [
        ("ST1", "N", 4, 36.3, 127.3, None), ("7", None, 3, 36.3, 127.3, "A"), ("", "no id", None, 36.0, None, None)]
