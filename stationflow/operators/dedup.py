"""Deduplication across files, republished files, station attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import stage
from .chunked import first_rows
from .cleaning import ATTRIBUTES, TRIP_KEY

DEDUP_COLUMNS = ["bike_id", "rent_dt", "rent_st", "ret_dt", "ret_st", "dur_min", "dist_km",
                 "f_ctrl_rent", "f_ctrl_ret", "f_cancel", "src_month"]


def first_copy(df: DataFrame, key: list[str], file_column: str = "src_month") -> DataFrame:
    """One row per key, taken from the earliest file; remaining columns break ties.

    One shuffle by key: the ``row_number() = 1`` shape lets Spark keep one row per key and map
    task before it, so a key with very many copies stays small. NULL keys form one group.
    """
    rest = [c for c in df.columns if c not in key and c != file_column]
    return first_rows(df, key, [file_column, *rest], 1, "_pos").drop("_pos")


def dedup_trips(trips: DataFrame, key: list[str] = TRIP_KEY) -> DataFrame:
    """Global dedup first, then rows with unusable times go (in this order)."""
    return first_copy(trips, key).where(~F.col("f_time_bad")).select(*DEDUP_COLUMNS)


def rows_removed(before: DataFrame, after: DataFrame, file_column: str = "src_month") -> DataFrame:
    """Per source file: rows read, kept, removed."""
    read = before.groupBy(file_column).agg(F.count(F.lit(1)).alias("rows_read"))
    kept = after.groupBy(file_column).agg(F.count(F.lit(1)).alias("rows_kept"))
    return (read.join(kept, file_column, "left")
            .withColumn("rows_kept", F.coalesce("rows_kept", F.lit(0)))
            .withColumn("rows_removed", F.col("rows_read") - F.col("rows_kept")))


def republished_files(stats: DataFrame, rows: DataFrame, key: list[str],
                      file_column: str = "src_month") -> DataFrame:
    """Files whose main data month is not their own, compared with the file of that month.

    Per suspect file: distinct keys, keys also present in the other file, and the match rate.
    Only the suspect (file, other file) couples are compared, never all couples of files.
    """
    suspects = stage(stats.where(F.col("data_month_main") != F.col(file_column))
                     .select(F.col(file_column).alias("file_a"), F.col("data_month_main").alias("file_b")), "suspects")
    # Only rows of files on either side of a couple count; a key's set of files is no longer than the list of files.
    sides = suspects.select(F.explode(F.array("file_a", "file_b")).alias(file_column)).distinct()
    held = (rows.select(file_column, *key).join(sides, file_column, "left_semi")
            .groupBy(*key).agg(F.collect_set(file_column).alias("_files")))
    return (held.select("_files", F.explode("_files").alias("file_a")).join(suspects, "file_a")
            .groupBy("file_a", "file_b")
            .agg(F.count(F.lit(1)).alias("keys_a"), F.count_if(F.array_contains("_files", F.col("file_b"))).alias("keys_shared"))
            .withColumn("match_pct", 100.0 * F.col("keys_shared") / F.col("keys_a")))


def station_sides(clean: DataFrame) -> DataFrame:
    """UNION ALL of the rental-side and return-side station attributes."""
    def side(prefix, rank):
        return clean.select(
            F.col(f"{prefix}_st").alias("station_id"),
            *[F.col(f"{prefix}_{a}").alias(a) for a in ATTRIBUTES],
            "src_month", F.col(f"{prefix}_dt").alias("seen_at"), F.lit(rank).alias("side"), "bike_id")
    return side("rent", 0).unionByName(side("ret", 1)).where(F.col("station_id").isNotNull())


def latest_attributes(sides: DataFrame) -> DataFrame:
    """Per station and column the newest non-null value, independent of the others.

    First the newest time per (station, file, column): plain maxima of fixed-width values, so
    a hash aggregate with map-side combine. Then only the rows at one of these times are
    compared in full; a busy station is neither sorted nor gathered.
    """
    maxima = [F.max(F.when(F.col(a).isNotNull(), F.col("seen_at"))).alias(f"_at_{a}") for a in ATTRIBUTES]
    present = [F.count(a).alias(f"_n_{a}") for a in ATTRIBUTES]
    newest = sides.groupBy("station_id", "src_month").agg(*maxima, *present).groupBy("station_id").agg(*[
        F.max(F.when(F.col(f"_n_{a}") > 0, F.struct("src_month", F.col(f"_at_{a}").alias("at")))).alias(f"_best_{a}")
        for a in ATTRIBUTES])
    # Written, so that its true size (a row per station) decides how it is joined below.
    newest = stage(newest, "newest")
    leading = F.lit(False)
    for a in ATTRIBUTES:
        best = F.col(f"_best_{a}")
        leading = leading | (F.col(a).isNotNull() & F.col("src_month").eqNullSafe(best["src_month"])
                             & F.col("seen_at").eqNullSafe(best["at"]))
    finalists = sides.join(newest, "station_id").where(leading)
    order = ["src_month", "seen_at", "side", "bike_id"]
    picks = [F.max_by(a, F.when(F.col(a).isNotNull(), F.struct(*order, a))).alias(a) for a in ATTRIBUTES]
    # A station without any value has no finalist.
    return (newest.select("station_id")
            .join(finalists.groupBy("station_id").agg(*picks), "station_id", "left"))
