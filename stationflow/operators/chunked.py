"""Row order within a key, without putting a very large key into one task.

A vehicle id may be a placeholder that holds a third of all trips; a window partitioned by
the id alone would send all of them to one task. Keys above ``hot_rows`` rows are found
first (a hash aggregate over the key columns). Their rows are cut into slices of about
``slice_rows`` by a range partitioning over key and order, whose bounds Spark takes from a
sample; where rows of a key agree in the whole order, the partition they came from parts them.
So slices are equally deep wherever a key's rows lie, all in one minute or not. The window runs
per (key, slice), and one extra row per slice, sorted first and dropped again, brings along what
came before: the last row's values and the number of rows so far. Other keys stay whole. The
list of hot keys is written first; if it is empty, which is the common case, the plan is a
single scan, shuffle and sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import stage

HOT_ROWS, SLICE_ROWS = 1_000_000, 500_000
# Hot keys that are broadcast; a longer list is joined by a shuffle.
BROADCAST_KEYS = 100_000


def group_window(*columns: str) -> Window:
    """Window per group that compares a 64-bit hash first: sorting then needs the (text) key
    columns only within a group."""
    return Window.partitionBy(F.xxhash64(*columns), *columns)


def hot_keys(df: DataFrame, key: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows, and how many: never more than rows / hot_rows keys."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)


def sliced(df: DataFrame, key: list[str], order: list[str], rows: int, slice_rows: int) -> DataFrame:
    """Adds ``_slice`` and ``_at``: both ascend with (key, order); a written table."""
    place = [*key, *order, "_from"]
    laid = (df.select(*df.columns, F.spark_partition_id().alias("_from"))
            .repartitionByRange(max(1, -(-rows // slice_rows)), *place).sortWithinPartitions(*place).drop("_from"))
    return stage(laid.withColumns({"_slice": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "slices")


def chained(df: DataFrame, key: list[str], order: list[str], carry: list[str] | None = None,
            prefix: str = "prev_", seq: str | None = None, hot_rows: int = HOT_ROWS, slice_rows: int | None = None) -> DataFrame:
    """Adds the previous row's ``carry`` columns and, if named, the 1-based position ``seq``.

    ``order`` should identify a row; rows that agree in it follow each other in any order.
    """
    carry = carry or []
    hot = stage(hot_keys(df, key, hot_rows), "hot_keys")
    n_hot, n_rows = hot.agg(F.count(F.lit(1)), F.sum("_n")).first()
    whole = group_window(*key).orderBy(*order)
    plain = {prefix + c: F.lag(c).over(whole) for c in carry} | ({seq: F.row_number().over(whole).cast("long")} if seq else {})
    if not n_hot:  # one scan, one shuffle, one sort
        return df.withColumns(plain)
    listed = hot.select(*[F.col(k).alias(f"_hot_{k}") for k in key])
    if n_hot <= BROADCAST_KEYS:
        listed = F.broadcast(listed)
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_hot_{k}"))
    cold = df.join(listed, same, "left_anti").withColumns(plain)
    rows = sliced(df.join(listed, same, "left_semi"), key, order, n_rows, slice_rows or SLICE_ROWS)

    # One row per slice and hot key: what its last row hands on to the next slice of the key.
    ends = rows.groupBy(*key, "_slice").agg(F.max("_at").alias("_at"), F.count(F.lit(1)).alias("_n"))
    by_slice = Window.partitionBy(*key).orderBy("_slice")
    so_far = F.sum("_n").over(by_slice.rowsBetween(Window.unboundedPreceding, 0))
    ends = stage(ends.select("_at", F.lead("_slice").over(by_slice).alias("_next"), so_far.alias("_step")).where("_next IS NOT NULL"), "slice_ends")
    if ends.count() <= BROADCAST_KEYS:
        ends = F.broadcast(ends)
    handed = rows.join(ends, "_at").select(*key, F.col("_next").alias("_slice"), "_step", *[c for c in carry if c not in key],
                                           F.lit(-1).cast("long").alias("_at"))
    own = rows.withColumn("_step", F.lit(1).cast("long"))
    inside = group_window(*key, "_slice").orderBy("_at")
    added = {prefix + c: F.lag(c).over(inside) for c in carry}
    if seq:
        added[seq] = F.sum("_step").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    warm = own.unionByName(handed, allowMissingColumns=True).withColumns(added).where("_at >= 0").select(*df.columns, *added)
    return cold.unionByName(warm)


def previous_row(df: DataFrame, key: list[str], order: list[str], carry: list[str],
                 prefix: str = "prev_", hot_rows: int = HOT_ROWS, slice_rows: int | None = None) -> DataFrame:
    """``lag`` of the ``carry`` columns within a key."""
    return chained(df, key, order, carry, prefix, hot_rows=hot_rows, slice_rows=slice_rows)


def sequence_number(df: DataFrame, key: list[str], order: list[str], name: str = "seq",
                    hot_rows: int = HOT_ROWS, slice_rows: int | None = None) -> DataFrame:
    """1-based position of each row in its key."""
    return chained(df, key, order, seq=name, hot_rows=hot_rows, slice_rows=slice_rows)


def first_rows(df: DataFrame, key: list[str], order: list[str | Column], n: int, name: str = "pos") -> DataFrame:
    """First ``n`` rows per key. Spark limits each map task to ``n`` rows per key before
    the shuffle (window group limit), so a hot key does not reach one task whole."""
    w = group_window(*key).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
