"""Numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_even(x, digits: int) -> Column:
    """Scale, round half to even, scale back: the rounding of the published tables."""
    scale = F.lit(float(10 ** digits))
    return F.rint(_c(x) * scale) / scale


def ratio(numerator, denominator) -> Column:
    """NULL instead of an error or infinity when the denominator is 0."""
    d = _c(denominator).cast("double")
    return F.when(d != 0, _c(numerator).cast("double") / d)


def correlation(x, y) -> Column:
    """Pearson correlation over the rows where both values are present; NULL where either is the same in all of them.

    ``corr`` divides by the spread and fails there.
    """
    a, b = _c(x).cast("double"), _c(y).cast("double")
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    varies = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when(varies, ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def clip(x, low=None, high=None) -> Column:
    c = _c(x)
    if low is not None:
        c = F.when(c.isNotNull(), F.greatest(c, low if isinstance(low, Column) else F.lit(low)))
    if high is not None:
        c = F.when(c.isNotNull(), F.least(c, high if isinstance(high, Column) else F.lit(high)))
    return c


def number(text, kind: str = "double") -> Column:
    """Numeric coercion, anything unreadable becomes NULL, NaN too."""
    value = F.trim(_c(text)).try_cast(kind)
    return F.when(~F.isnan(value), value) if kind in ("double", "float") else value

