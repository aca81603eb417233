"""Availability payloads: find the station list in a JSON document, normalise its entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys that may wrap the list, in order; field aliases, in order; the
# latitude range of the city.
WRAPPER_KEYS = ("results", "result", "data", "items", "stations", "list", "body")
ALIASES = {
    "station_id": ("id", "station_id", "stationId"),
    "station_name": ("name", "station_name"),
    "bikes_available": ("parking_count", "bikes_available", "available", "cnt"),
    "lat": ("x_pos", "lat", "latitude"),
    "lon": ("y_pos", "lon", "lng", "longitude"),
    "address": ("address", "addr"),
}
LAT_RANGE = (35.9, 36.8)

_LIST = "array<variant>"


def unwrap(body: Column) -> Column:
    """Text -> array of variants: a top-level list, else the first wrapper key that holds a
    list, else the only list-valued key, else NULL."""
    doc = F.try_parse_json(body)
    wrapped = [F.try_variant_get(doc, f"$.{k}", _LIST) for k in WRAPPER_KEYS]
    values = F.map_values(F.try_variant_get(doc, "$", "map<string,variant>"))
    lists = F.filter(values, lambda v: F.schema_of_variant(v).startswith("ARRAY"))
    only = F.when(F.size(lists) == 1, F.try_variant_get(F.get(lists, F.lit(0)), "$", _LIST))
    return F.coalesce(F.try_variant_get(doc, "$", _LIST), *wrapped, only)


def pick(item: Column, names) -> Column:
    """First alias that is present, not null and not empty, as text."""
    texts = [F.try_variant_get(item, f"$.{n}", "string") for n in names]
    return F.coalesce(*[F.when(t != "", t) for t in texts])


def normalise(item: Column, lat_range=LAT_RANGE) -> list[Column]:
    """Snapshot columns of one station entry; a latitude out of range means swapped axes."""
    text = {name: pick(item, names) for name, names in ALIASES.items()}
    lat, lon = text["lat"].try_cast("double"), text["lon"].try_cast("double")
    swapped = lat.isNotNull() & lon.isNotNull() & ~((lat > lat_range[0]) & (lat < lat_range[1]))
    return [
        F.trim(F.coalesce(text["station_id"], F.lit(""))).alias("station_id"),
        text["station_name"].alias("station_name"),
        text["bikes_available"].try_cast("double").try_cast("int").alias("bikes_available"),
        F.when(swapped, lon).otherwise(lat).alias("lat"),
        F.when(swapped, lat).otherwise(lon).alias("lon"),
        text["address"].alias("address"),
        F.to_json(item).alias("raw_json"),
    ]
