"""Global ranks, running counts and exact quantiles without a single-task window.

The values are first collapsed to (value, count). A few hundred split points, taken from
an approximate quantile sketch, cut the value range into buckets; counts are summed per
bucket, the bucket totals (a table as small as the number of split points) give each
bucket its offset, and the running count inside a bucket is a window per bucket.
Only the split points pass through the driver, like the bounds of a range partitioner.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Buckets per shuffle partition of the session, which is set to suit the data.
BUCKETS_PER_PARTITION = 4


def bucket_count(df: DataFrame) -> int:
    return max(16, BUCKETS_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def split_points(df: DataFrame, *values: str, buckets: int | None = None) -> dict[str, list[float]]:
    """At most ``buckets - 1`` sorted numbers per column, from one pass."""
    buckets = buckets or bucket_count(df)
    shares = [i / buckets for i in range(1, buckets)]
    found = df.agg(*[F.percentile_approx(F.col(v).cast("double"), shares, 4 * buckets).alias(v) for v in values]).first()
    return {v: sorted(set(found[v] or [])) for v in values}


def bucket_of(value: Column, bounds: list[float]) -> Column:
    """How many of the sorted ``bounds`` lie below a value: first among every so many of them, then among those between,
    so a value meets twice the square root of their number."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds) - 1) + 1
    all_, coarse = (F.array(*[F.lit(float(b)) for b in some]) for some in (bounds, bounds[step - 1::step] or bounds[-1:]))

    def below(some):
        return F.size(F.filter(some, lambda b: b < value))

    skipped = (below(coarse) * step if len(bounds) >= step else F.lit(0)).cast("int")
    return skipped + below(F.slice(all_, skipped + 1, F.lit(step)))


def running_counts(df: DataFrame, value: str, by: tuple[str, ...] = (),
                   bounds: list[float] | None = None) -> DataFrame:
    """One row per distinct non-null value (and ``by``): n, n_before, n_total.

    Any ``bounds`` give the same result; good ones give buckets of similar size.
    """
    counts = (df.where(F.col(value).isNotNull()).groupBy(*by, value)
              .agg(F.count(F.lit(1)).alias("n")))
    if bounds is None:
        bounds = split_points(df, value)[value]
    counts = counts.withColumn("_bucket", bucket_of(F.col(value).cast("double"), bounds))
    totals = counts.groupBy(*by, "_bucket").agg(F.sum("n").alias("_bn"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "_bucket",
        F.coalesce(F.sum("_bn").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_bn").over(group).alias("n_total"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    within = counts.withColumn("_within", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return (within.join(offsets, [*by, "_bucket"])
            .select(*by, value, "n", (F.col("_offset") + F.col("_within")).alias("n_before"), "n_total"))


def value_ranks(df: DataFrame, value: str, name: str = "rank", bounds: list[float] | None = None) -> DataFrame:
    """Rank of each distinct value; rows that share it share the mean of their positions."""
    running = running_counts(df, value, bounds=bounds)
    return running.select(value, (F.col("n_before") + (F.col("n") + 1) / F.lit(2.0)).alias(name), "n_total")


def average_rank(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """Global rank per row, null for null. The lookup side has one row per value, so a
    frequent value skews the row side only, which AQE's skew join splits."""
    return df.join(value_ranks(df, value, name), value, "left").select(*df.columns, name)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: rank correlation over the rows where both values are present.

    Equal pairs are counted first, so only distinct pairs meet their ranks. Average ranks
    always have the mean (n + 1) / 2, so one pass over centred ranks is enough.
    """
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    pairs = both.groupBy(x, y).agg(F.count(F.lit(1)).alias("_n"))
    bounds = split_points(both, x, y)
    ranked = (pairs.join(value_ranks(both, x, "_rx", bounds[x]), x)
              .join(value_ranks(both, y, "_ry", bounds[y]).drop("n_total"), y))
    middle = (F.col("n_total") + 1) / F.lit(2.0)
    dx, dy, n = F.col("_rx") - middle, F.col("_ry") - middle, F.col("_n")
    sums = ranked.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n"), F.sum(n * dx * dy).alias("_xy"),
                      F.sum(n * dx * dx).alias("_xx"), F.sum(n * dy * dy).alias("_yy"))
    spread = F.sqrt(F.col("_xx") * F.col("_yy"))
    return sums.select("n", F.when(spread > 0, F.col("_xy") / spread).alias("spearman"))


def quantiles(df: DataFrame, value: str, shares: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """Exact, linearly interpolated quantiles; works on row-level tables of any size."""
    running = running_counts(df, value, by)
    first, end = F.col("n_before"), F.col("n_before") + F.col("n")
    v = F.col(value).cast("double")
    aggs = []
    for name, q in shares.items():
        spot = F.lit(float(q)) * (F.col("n_total") - 1)
        low = F.floor(spot)
        part = spot - low
        holds_low = (low >= first) & (low < end)
        holds_high = (low + 1 >= first) & (low + 1 < end)
        aggs += [F.max(F.when(holds_low, v)).alias(f"_{name}_lo"),
                 F.max(F.when(holds_high, v)).alias(f"_{name}_hi"),
                 F.max(part).alias(f"_{name}_part")]
    found = running.groupBy(*by).agg(*aggs)
    return found.select(*by, *[
        (F.col(f"_{n}_lo") + F.when(F.col(f"_{n}_part") > 0,
                                    (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_part")
                                    ).otherwise(F.lit(0.0))).alias(n)
        for n in shares])


def many_quantiles(df: DataFrame, shares: dict[str, dict[str, float]], by: tuple[str, ...] = ()) -> DataFrame:
    """Exact quantiles of several columns in one pass: column -> {name: share}. One row (per ``by``).

    The columns are stacked, counted once as (by, column, value), and read off their running counts.
    """
    columns = list(shares)
    bounds = split_points(df, *columns)
    stacked = df.select(*by, F.inline(F.array(*[
        F.struct(F.lit(i).alias("_column"), F.col(c).cast("double").alias("_value")) for i, c in enumerate(columns)])))
    points = sorted({b for c in columns for b in bounds[c]})
    running = running_counts(stacked, "_value", (*by, "_column"), bounds=points[::max(1, len(columns))])
    first, end = F.col("n_before"), F.col("n_before") + F.col("n")
    aggs, found = [], []
    for i, c in enumerate(columns):
        for name, q in shares[c].items():
            spot = F.lit(float(q)) * (F.col("n_total") - 1)
            low, mine = F.floor(spot), F.col("_column") == i
            aggs += [F.max(F.when(mine & (low >= first) & (low < end), F.col("_value"))).alias(f"_{name}_lo"),
                     F.max(F.when(mine & (low + 1 >= first) & (low + 1 < end), F.col("_value"))).alias(f"_{name}_hi"),
                     F.max(F.when(mine, spot - low)).alias(f"_{name}_part")]
            step = (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * F.col(f"_{name}_part")
            found.append((F.col(f"_{name}_lo") + F.when(F.col(f"_{name}_part") > 0, step).otherwise(F.lit(0.0))).alias(name))
    return running.groupBy(*by).agg(*aggs).select(*by, *found)
