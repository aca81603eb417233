"""Stations of two sources that use other ids, matched by place and name.

Candidates are pairs within a radius, found by grid cells as wide as the radius: a station of one side is filed
under its own cell, one of the other side asks its own and the eight cells around. A pair's cost is its distance
in radii plus the share of the name that has to be edited. Two stations match if each is the other's best.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import spread

# Metres per degree of latitude, and of longitude at the equator; a fixed factor serves one city.
METRES = 111_320.0


def plain_name(name) -> Column:
    """Lower case, without white space and punctuation; empty for null."""
    return F.coalesce(F.regexp_replace(F.lower(name), r"[\s\p{P}]+", ""), F.lit(""))


def match_stations(left: DataFrame, right: DataFrame, radius: float = 150.0, lon_factor: float = 0.8054, most_edits: float = 0.5) -> DataFrame:
    """left_id, right_id, metres, edits (share of the longer name): the mutual best pairs.

    Both sides have station_id, name, lat, lon; rows without a place take no part. Ties go to the smaller distance,
    then the smaller ids.
    """
    def placed(df, side):
        y, x = F.col("lat") * METRES, F.col("lon") * METRES * lon_factor
        rows = df.where("station_id IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)")
        return rows.select(F.col("station_id").alias(f"{side}_id"), plain_name(F.col("name")).alias(f"{side}_name"), y.alias(f"{side}_y"), x.alias(f"{side}_x"),
                           F.floor(y / radius).alias("cell_y"), F.floor(x / radius).alias("cell_x"))

    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    asks = spread(placed(left, "left"), "left_id").withColumn("_n", around).withColumns(
        {"cell_y": F.col("cell_y") + F.col("_n.a"), "cell_x": F.col("cell_x") + F.col("_n.b")}).drop("_n")
    metres = F.sqrt((F.col("left_y") - F.col("right_y")) ** 2 + (F.col("left_x") - F.col("right_x")) ** 2)
    longest = F.greatest(F.length("left_name"), F.length("right_name"), F.lit(1))
    pairs = asks.join(placed(right, "right"), ["cell_y", "cell_x"]).select("left_id", "right_id", F.round(metres, 3).alias("metres"), F.round(
        F.levenshtein("left_name", "right_name") / longest, 6).alias("edits"))
    pairs = pairs.where((F.col("metres") <= radius) & (F.col("edits") <= most_edits)).withColumn("cost", F.round(F.col("metres") / radius + F.col("edits"), 6))

    def best(side):
        return F.row_number().over(Window.partitionBy(f"{side}_id").orderBy("cost", "metres", "left_id", "right_id")) == 1

    return pairs.withColumns({"_l": best("left"), "_r": best("right")}).where("_l AND _r").select("left_id", "right_id", "metres", "edits")
