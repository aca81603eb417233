"""Raw trip text -> typed trips with quality flags. No row is dropped here."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import number
from ..functions.timecols import parse_timestamp
from ..runtime import stage
from .copies import split_copies

# Source header -> column name. The source's X coordinate is the latitude.
RENAME = {
    "자전거번호": "bike_id",
    "대여일시": "rent_dt",
    "대여_대여소ID": "rent_st",
    "대여_대여소명": "rent_name",
    "대여_X좌표": "rent_lat",
    "대여_Y좌표": "rent_lon",
    "대여_구": "rent_gu",
    "대여_동": "rent_dong",
    "대여_대여소주소": "rent_addr",
    "반납일시": "ret_dt",
    "반납_대여소ID": "ret_st",
    "반납_대여소명": "ret_name",
    "반납_X좌표": "ret_lat",
    "반납_Y좌표": "ret_lon",
    "반납_구": "ret_gu",
    "반납_동": "ret_dong",
    "반납_대여소주소": "ret_addr",
    "이용시간(분)": "dur_min",
    "이용거리(km)": "dist_km",
}
# Thresholds, key, flag and column names of the published tables.
CONTROL_KEYWORD = "관제"
MAX_DURATION_MIN = 24 * 60
MAX_DISTANCE_KM = 40.0
CANCEL_DURATION_MIN = 1
CANCEL_DISTANCE_KM = 0.0

TRIP_KEY = ["bike_id", "rent_dt", "ret_dt", "rent_st", "ret_st"]
FLAGS = ["f_ctrl_rent", "f_ctrl_ret", "f_cancel", "f_dur_out", "f_dist_out", "f_time_bad"]
TRIP_COLUMNS = ["bike_id", "rent_dt", "rent_st", "ret_dt", "ret_st", "dur_min", "dist_km", *FLAGS]
ATTRIBUTES = ["name", "lat", "lon", "gu", "dong", "addr"]


def rename_source(df: DataFrame, names: dict[str, str] = RENAME) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"source columns missing: {missing}")
    return df.withColumnsRenamed(names)


def type_columns(df: DataFrame) -> DataFrame:
    """Text to timestamps and numbers; unreadable values become NULL."""
    numbers = ["dur_min", "dist_km", "rent_lat", "rent_lon", "ret_lat", "ret_lon"]
    return df.withColumns({
        **{c: parse_timestamp(c) for c in ("rent_dt", "ret_dt")},
        **{c: number(c) for c in numbers if c in df.columns},
    })


def add_flags(df: DataFrame, control_keyword: str = CONTROL_KEYWORD,
              cancel_min: float = CANCEL_DURATION_MIN, cancel_km: float = CANCEL_DISTANCE_KM,
              max_min: float = MAX_DURATION_MIN, max_km: float = MAX_DISTANCE_KM) -> DataFrame:
    """Cleaning flags; a condition on a missing value is false, a missing time is bad."""
    def sure(condition):
        return F.coalesce(condition, F.lit(False))

    return df.withColumns({
        "f_ctrl_rent": sure(F.col("rent_name").contains(control_keyword)),
        "f_ctrl_ret": sure(F.col("ret_name").contains(control_keyword)),
        "f_cancel": sure((F.col("dur_min") <= cancel_min) & (F.col("dist_km") <= cancel_km)),
        "f_dur_out": sure(F.col("dur_min") > max_min),
        "f_dist_out": sure(F.col("dist_km") > max_km),
        "f_time_bad": F.col("rent_dt").isNull() | F.col("ret_dt").isNull()
        | sure(F.col("ret_dt") < F.col("rent_dt")),
    })


def narrow(df: DataFrame) -> DataFrame:
    """Small types; a missing duration, or one that no int holds, becomes -1."""
    return df.withColumns({
        "dur_min": F.coalesce(F.col("dur_min").try_cast("int"), F.lit(-1)),
        "dist_km": F.col("dist_km").cast("float"),
    })


def clean_trips(raw: DataFrame, **thresholds) -> DataFrame:
    """Renamed, typed, flagged rows with the station attribute columns still present."""
    return narrow(add_flags(type_columns(raw), **thresholds))


def trip_columns(clean: DataFrame) -> DataFrame:
    return clean.select(*TRIP_COLUMNS, "src_month")


def flag_duplicates(df: DataFrame, key: list[str] = TRIP_KEY, within: str = "src_month",
                    salts: int = 64, name: str = "f_dup") -> DataFrame:
    """True on every row of a (file, key) group but its first; all rows are kept.

    Rows with a unique key pass through. Copies may be numerous, so they are never ranked
    together: equal rows of one input split collapse to one counted row, these are ranked
    per (key, salt), the salt winners are ranked per key (at most ``salts`` rows), and the
    counted rows are expanded again, each to no more rows than one input split held.
    """
    group = [within, *key]
    rest = [c for c in df.columns if c not in group]
    single, copied = split_copies(df, group)
    counted = (copied.withColumn("_split", F.spark_partition_id())
               .groupBy(*df.columns, "_split").agg(F.count(F.lit(1)).alias("_n")))
    counted = stage(counted, "copies").withColumn(
        "_salt", F.pmod(F.xxhash64(*df.columns, "_split"), F.lit(salts)))
    order = [*rest, "_split"]
    in_salt = Window.partitionBy(*group, "_salt").orderBy(*order)
    ranked = counted.withColumn("_rank", F.row_number().over(in_salt))
    winners = (ranked.where("_rank = 1")
               .withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))))
    numbered = winners.unionByName(ranked.where("_rank > 1"))
    flagged = (numbered.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
               .withColumn(name, (F.col("_rank") > 1) | (F.col("_copy") > 1)))
    return single.withColumn(name, F.lit(False)).unionByName(flagged.select(*df.columns, name))
