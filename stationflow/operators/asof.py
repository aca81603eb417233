"""As-of join of hourly rows with irregular observations, such as weather reports.

Each row gets the newest observation at or before its time, if it is not older than a tolerance. Rows and
observations are cut into slices as long as the tolerance: what a row may take lies in its own slice or the one
before, so a slice needs its rows, its observations, and one carried row, the last observation of the slice
before. A window runs per (key, slice) and is bounded by the data of that time, not by a key's history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timecols import micros


def join_asof(rows: DataFrame, observed: DataFrame, at: str, seen: str, key: list[str], values: list[str],
              tolerance_minutes: int, prefix: str = "obs_") -> DataFrame:
    """Adds the ``values`` of the newest observation, and ``{prefix}at``, its time; null if none is recent enough.

    Of observations of one time the largest values count. Null times take no part; null keys are one group.
    """
    span = tolerance_minutes * 60_000_000
    last = observed.where(F.col(seen).isNotNull()).groupBy(*key, seen).agg(F.max(F.struct(*values)).alias("_o"))
    last = last.select(*key, micros(seen).alias("_t"), F.struct(F.col(seen).alias("at"), *[F.col(f"_o.{v}").alias(v) for v in values]).alias("_o"))
    last = last.withColumn("_slice", F.floor(F.col("_t") / F.lit(span)))
    carried = last.groupBy(*key, "_slice").agg(F.max(F.struct("_t", "_o")).alias("_c"))
    carried = carried.select(*key, (F.col("_slice") + 1).alias("_slice"), F.col("_c._t").alias("_t"), F.col("_c._o").alias("_o"))
    timed, untimed = rows.where(F.col(at).isNotNull()), rows.where(F.col(at).isNull())
    mine = timed.select(*key, micros(at).alias("_t"), F.floor(micros(at) / F.lit(span)).alias("_slice"), F.struct(*rows.columns).alias("_row"))
    both = last.unionByName(carried).unionByName(mine, allowMissingColumns=True)
    before = Window.partitionBy(*key, "_slice").orderBy("_t", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumns({"_o": F.last("_o", ignorenulls=True).over(before), "_seen": F.last(F.when(F.col("_row").isNull(), F.col("_t")), ignorenulls=True).over(before)})
    recent = F.col("_t") - F.col("_seen") <= span
    found = found.where("_row IS NOT NULL").select("_row.*", *[F.when(recent, F.col(f"_o.{v}")).alias(prefix + v) for v in values],
                                                  F.when(recent, F.col("_o.at")).alias(f"{prefix}at"))
    return found.unionByName(untimed, allowMissingColumns=True)
