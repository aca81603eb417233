"""Checks on the products, each as a distributed job over the whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timecols import day_of
from .panel import event_days


def conservation(panel: DataFrame) -> DataFrame:
    """Vehicles neither appear nor vanish."""
    return panel.agg(*[F.sum(c).alias(c) for c in ("rentals", "returns", "reloc_in", "reloc_out", "net_flow")]
                     ).withColumns({
                         "trips_balance": F.col("rentals") == F.col("returns"),
                         "relocations_balance": F.col("reloc_in") == F.col("reloc_out"),
                         "net_flow_is_zero": F.col("net_flow") == 0})


def differing_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table the other lacks, copies counted; empty when the tables agree."""
    b = b.select(*a.columns)
    signed = (a.withColumn("_s", F.lit(1)).unionByName(b.withColumn("_s", F.lit(-1)))
              .groupBy(*a.columns).agg(F.sum("_s").alias("surplus")))
    return signed.where(F.col("surplus") != 0)


def difference_summary(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: distinct rows compared, rows that differ."""
    b = b.select(*a.columns)
    signed = (a.withColumn("_s", F.lit(1)).unionByName(b.withColumn("_s", F.lit(-1)))
              .groupBy(*a.columns).agg(F.sum("_s").alias("_surplus")))
    return signed.agg(F.count(F.lit(1)).alias("compared"), F.count_if(F.col("_surplus") != 0).alias("differing"))


def panel_recount(panel: DataFrame, trips: DataFrame) -> DataFrame:
    """Every station-day of the panel against a direct count of the trips."""
    summed = (panel.groupBy("station_id", day_of("ts").alias("date"))
              .agg(F.sum("rentals").alias("p_rent"), F.sum("returns").alias("p_ret")))
    direct = event_days(trips, "rent_st", "rent_dt", "ret_st", "ret_dt")
    zero = F.lit(0)
    return (summed.join(direct, ["station_id", "date"], "full")
            .select("station_id", "date", *[F.coalesce(c, zero).alias(c) for c in
                                            ("p_rent", "p_ret", "rent_events", "ret_events")])
            .agg(F.count(F.lit(1)).alias("station_days"),
                 F.count_if((F.col("p_rent") != F.col("rent_events"))
                            | (F.col("p_ret") != F.col("ret_events"))).alias("mismatches")))


def long_metrics(tables: list[tuple[DataFrame, dict[str, object]]]) -> DataFrame:
    """(metric, value) rows: per table the metrics it gives, name -> aggregate expression; one aggregate per table."""
    parts = []
    for table, metrics in tables:
        one = table.agg(*[e.cast("double").alias(f"_{i}") for i, e in enumerate(metrics.values())])
        parts.append(one.select(F.inline(F.array(*[
            F.struct(F.lit(name).alias("metric"), F.col(f"_{i}").alias("value")) for i, name in enumerate(metrics)]))))
    return reduce(DataFrame.unionByName, parts)


def reconcile(claims: DataFrame, metrics: DataFrame) -> DataFrame:
    """Claimed numbers (metric, claim, tol) against recomputed ones; a missing value fails."""
    return (claims.join(metrics, "metric", "left")
            .withColumn("ok", F.coalesce(F.abs(F.col("claim") - F.col("value")) <= F.col("tol"), F.lit(False))))
