"""Robust seasonal-trend decomposition by loess (Cleveland et al., 1990), many series at once.

Spark groups the daily series by key; one series (bounded by the calendar) is one task's
unit of work and the kernel below is all the Python there is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _odd_above(x: float) -> int:
    n = int(np.floor(x)) + 1
    return n if n % 2 else n + 1


def _loess(y: np.ndarray, span: int, weights: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Local linear fit of y (positions 0..n-1) at the positions ``at``, all at once."""
    n = len(y)
    q = min(span, n)
    start = np.clip(np.ceil(at - q / 2), 0, n - q).astype(int)
    x = start[:, None] + np.arange(q)
    dist = np.abs(x - at[:, None])
    reach = dist.max(axis=1, keepdims=True) + max(span - n, 0) // 2
    near = np.clip(np.divide(dist, reach, out=np.zeros_like(dist), where=reach > 0), 0, 1)
    w = (1 - near ** 3) ** 3 * weights[x]
    total = w.sum(axis=1, keepdims=True)
    # Where the robustness weights remove every neighbour, the plain mean stands in.
    w = np.where(total > 0, w / np.where(total > 0, total, 1), 1 / q)
    centre = (w * x).sum(axis=1, keepdims=True)
    spread = (w * (x - centre) ** 2).sum(axis=1, keepdims=True)
    sloped = np.sqrt(spread) > 0.001 * (n - 1)
    slope = (at[:, None] - centre) * (x - centre) / np.where(sloped, spread, 1)
    w = w * np.where(sloped, 1 + slope, 1)
    return (w * y[x]).sum(axis=1)


def _mean_over(y: np.ndarray, width: int) -> np.ndarray:
    return np.convolve(y, np.ones(width) / width, mode="valid")


def robust_stl(y: np.ndarray, period: int, seasonal: int = 7, inner: int = 2, outer: int = 15):
    """(trend, seasonal, resid, robustness weight) of one equally spaced series."""
    n = len(y)
    trend_span = _odd_above(1.5 * period / (1 - 1.5 / seasonal) - 1e-9)
    low_span = _odd_above(period)
    trend, season, weight = np.zeros(n), np.zeros(n), np.ones(n)
    everywhere = np.arange(n, dtype=float)
    for step in range(outer + 1):
        for _ in range(inner):
            cycle = np.empty(n + 2 * period)
            detrended = y - trend
            for p in range(period):
                sub = detrended[p::period]
                at = np.arange(-1, len(sub) + 1, dtype=float)
                cycle[p::period][:len(at)] = _loess(sub, seasonal, weight[p::period], at)
            low = _mean_over(_mean_over(_mean_over(cycle, period), period), 3)
            season = cycle[period:period + n] - _loess(low, low_span, np.ones(n), everywhere)
            trend = _loess(y - season, trend_span, weight, everywhere)
        if step < outer:
            size = np.abs(y - trend - season)
            cut = 6 * np.median(size)
            scaled = np.clip(size / cut, 0, 1) if cut > 0 else np.zeros(n)
            weight = np.where(scaled <= 0.001, 1.0, np.where(scaled >= 0.999, 0.0, (1 - scaled ** 2) ** 2))
    return trend, season, y - trend - season, weight


def stl(series: DataFrame, period: int = 7, key: str = "series_key", day: str = "d",
        value: str = "filled", outer: int = 15) -> DataFrame:
    """Trend, seasonal and resid columns per series; series shorter than two periods stay NULL."""
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(day)
        y = pdf[value].to_numpy(dtype=float)
        if len(y) >= 2 * period:
            trend, season, resid, _ = robust_stl(y, period, outer=outer)
        else:
            trend = season = resid = np.full(len(y), None)
        return pd.DataFrame({key: pdf[key], day: pdf[day], value: y,
                             "trend": trend, "seasonal": season, "resid": resid})

    schema = f"{key} string, {day} date, {value} double, trend double, seasonal double, resid double"
    return series.select(key, day, value).groupBy(key).applyInPandas(one, schema)
