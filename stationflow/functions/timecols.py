"""Time expressions on TIMESTAMP_NTZ columns.

All of them work on the wall clock itself: none goes through a zoned TIMESTAMP, so the
results do not depend on ``spark.sql.session.timeZone``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NTZ = "timestamp_ntz"


def day_of(ts) -> Column:
    return F.col(ts).cast("date") if isinstance(ts, str) else ts.cast("date")


def _c(ts) -> Column:
    return F.col(ts) if isinstance(ts, str) else ts


def hour_floor(ts) -> Column:
    """Start of the hour, still TIMESTAMP_NTZ (``date_trunc`` would return a zoned value)."""
    c = _c(ts)
    return at_hour(c.cast("date"), F.hour(c))


def at_hour(day, hour) -> Column:
    return F.timestamp_add("HOUR", _c(hour), _c(day).cast(NTZ))


def month_key(ts) -> Column:
    """'yyyyMM'."""
    d = day_of(ts)
    return (F.year(d) * 100 + F.month(d)).cast("string")


def month_label(ts) -> Column:
    """'yyyy-MM'."""
    d = day_of(ts)
    return F.concat_ws("-", F.year(d).cast("string"), F.lpad(F.month(d).cast("string"), 2, "0"))


def dow(ts) -> Column:
    """0 = Monday ... 6 = Sunday."""
    return F.weekday(day_of(ts))


def is_weekend(ts) -> Column:
    return dow(ts) >= 5


def minute_index(ts) -> Column:
    """Minutes since the epoch, seconds dropped."""
    c = _c(ts)
    return (F.unix_date(c.cast("date")).cast("long") * 1440
            + F.hour(c).cast("long") * 60 + F.minute(c).cast("long"))


def minutes_between(start, end) -> Column:
    """Number of minute boundaries crossed, so 00:00:59 -> 00:01:00 is 1."""
    return minute_index(end) - minute_index(start)


def micros(ts) -> Column:
    c = _c(ts)
    seconds = F.date_part(F.lit("SECOND"), c)
    return minute_index(c) * 60_000_000 + (seconds * 1_000_000).cast("long")


def midpoint(start, end) -> Column:
    """Middle of a gap; an odd number of microseconds is rounded half to even."""
    half = F.rint((micros(end) - micros(start)) / F.lit(2.0)).cast("long")
    return F.timestamp_add("MICROSECOND", half, _c(start))


def overlaps_any(start, end, windows) -> Column:
    """True when the open interval (start, end) overlaps one of a few literal windows."""
    hit = F.lit(False)
    for begin, stop in windows:
        hit = hit | ((_c(start) < F.lit(stop).cast(NTZ)) & (_c(end) > F.lit(begin).cast(NTZ)))
    return hit


def cyclical(value, period: int) -> tuple[Column, Column]:
    angle = _c(value) * F.lit(2 * math.pi) / F.lit(period)
    return F.sin(angle), F.cos(angle)


# Other date shapes -> ISO order, applied in turn: 2025/03/04, 2025.03.04; 20250304; 03/04/2025 (month first).
_DATE_SHAPES = ((r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})\b", "$1-$2-$3"), (r"^(\d{4})(\d{2})(\d{2})(?!\d)", "$1-$2-$3"),
                (r"^(\d{1,2})/(\d{1,2})/(\d{4})\b", "$3-$1-$2"))


def parse_timestamp(text, extra_formats=()) -> Column:
    """Timestamp text of mixed shape; NULL when nothing fits.

    The native cast reads 'yyyy-MM-dd HH:mm:ss', the same without seconds, and ISO forms,
    so a month published at minute resolution is not lost. Other common date shapes are put
    into ISO order first. Further formats can be added.
    """
    c = F.trim(_c(text))
    iso = c
    for shape, order in _DATE_SHAPES:
        iso = F.regexp_replace(iso, shape, order)
    extra = [F.try_to_timestamp(c, F.lit(f)).cast(NTZ) for f in extra_formats]
    return F.coalesce(c.try_cast(NTZ), *extra, iso.try_cast(NTZ))


def wall_clock(text) -> Column:
    """ISO-8601 text with an offset -> local wall clock; the offset is dropped, not applied."""
    return F.substring(_c(text), 1, 19).try_cast(NTZ)
