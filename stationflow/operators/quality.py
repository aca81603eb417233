"""Per-file quality statistics and load completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio, round_even
from ..functions.timecols import day_of, month_key
from .cleaning import FLAGS, TRIP_KEY
from .panel import event_days


def file_stats(trips: DataFrame, key: list[str] = TRIP_KEY, file_column: str = "src_month",
               time_column: str = "rent_dt", flags: list[str] = FLAGS) -> DataFrame:
    """One row per source file: rows, main data month, days, off-month rows, flag counts and %.

    Everything is a two-level hash aggregate. Duplicates are rows minus distinct keys, days
    and months are counted from a (file, day) table, so no file is gathered in one task.
    """
    per_day = (trips.withColumn("_day", day_of(time_column))
               .groupBy(file_column, "_day")
               .agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(f)).alias(f) for f in flags]))
    per_file = per_day.groupBy(file_column).agg(
        F.sum("_n").alias("rows"),
        F.count("_day").alias("data_days"),
        F.sum(F.when(F.coalesce(month_key("_day") != F.col(file_column), F.lit(True)), F.col("_n"))
              .otherwise(F.lit(0))).alias("rows_off_month"),
        *[F.sum(f).alias(f) for f in flags])
    per_month = (per_day.where(F.col("_day").isNotNull())
                 .groupBy(file_column, month_key("_day").alias("_month")).agg(F.sum("_n").alias("_mn")))
    # Ties between months go to the earliest one.
    main = per_month.groupBy(file_column).agg(
        F.max(F.struct(F.col("_mn"), (-F.col("_month").cast("int")).alias("_neg"))).alias("_best"))
    main = main.select(file_column, (-F.col("_best._neg")).cast("string").alias("data_month_main"))
    copies = (trips.groupBy(file_column, *key).agg((F.count(F.lit(1)) - 1).alias("_extra"))
              .groupBy(file_column).agg(F.sum("_extra").alias("f_dup")))
    joined = per_file.join(main, file_column, "left").join(copies, file_column, "left")
    every = [*flags, "f_dup"]
    return joined.select(
        file_column, "rows", "data_month_main", "data_days", "rows_off_month", *every,
        *[round_even(ratio(F.col(f), F.col("rows")) * 100, 2).alias(f + "_pct") for f in every])


def flag_totals(stats: DataFrame, flags: list[str] = [*FLAGS, "f_dup"]) -> DataFrame:
    """Count and percent of each flag over all files (from the per-file table)."""
    sums = stats.agg(F.sum("rows").alias("_rows"), *[F.sum(f).alias(f) for f in flags])
    return sums.select("_rows", F.inline(F.array(*[
        F.struct(F.lit(f).alias("flag"), F.col(f).alias("n")) for f in flags]))).select(
        "flag", "n", round_even(ratio("n", "_rows") * 100, 2).alias("pct"))


def station_daily_events(clean: DataFrame) -> DataFrame:
    return event_days(clean, "rent_st", "rent_dt", "ret_st", "ret_dt")


def load_completeness(lines: DataFrame, rows: DataFrame, malformed: str | None = None) -> DataFrame:
    """Per file: records of the text minus the header against well-formed parsed rows. Both have a ``file`` column.

    ``malformed`` names the column of ``rows`` with the text of records that don't fit the header.
    """
    raw = lines.groupBy("file").agg((F.count(F.lit(1)) - 1).alias("source_rows"))
    fits = F.col(malformed).isNull() if malformed else F.lit(True)
    parsed = rows.groupBy("file").agg(F.count_if(fits).alias("parsed_rows"))
    return (raw.join(parsed, "file", "left")
            .withColumn("parsed_rows", F.coalesce("parsed_rows", F.lit(0)))
            .withColumn("complete", F.col("source_rows") == F.col("parsed_rows")))
