"""Keys that occur more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import stage


def split_copies(df: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is unique, rows whose key may have copies).

    A hash aggregate over one 64-bit hash per row finds the hashes that occur twice; only
    rows with such a hash need to be compared, all others are passed on without a shuffle of
    whole rows. Two keys with one hash merely send a few more rows to the exact comparison.
    The hashes are written first, so their true size decides whether they are broadcast.
    """
    hashed = df.withColumn("_key_hash", F.xxhash64(*key))
    repeated = stage(hashed.groupBy("_key_hash").agg(F.count(F.lit(1)).alias("_n"))
                     .where(F.col("_n") > 1).select("_key_hash"), "copied_keys")
    return (hashed.join(repeated, "_key_hash", "left_anti").drop("_key_hash"),
            hashed.join(repeated, "_key_hash", "left_semi").drop("_key_hash"))
