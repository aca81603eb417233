"""Robust multivariate outliers among documents: minimum covariance determinant per language and source.

Each text gets exact counts (words, their code points, symbols, repeated lines, words in repeated windows).
Four transformed statistics make a vector: log of the mean word length, square roots of symbols per word and of
the shares of repeated words and repeated lines. In each cell (language and source) FAST-MCD (Rousseeuw and Van
Driessen, 1999) looks for the ``support`` share of vectors whose covariance has the least determinant: from a
start by medians and quartiles, concentration steps re-estimate mean and covariance from the rows that lie
nearest. Rows whose squared Mahalanobis distance exceeds a chi-square quantile are rejected.

All rows that pass the base rules take part in every step. A step is one aggregate: vectors are whole numbers in
units of 1 / ``UNIT``, so counts and moments per (cell, distance bin) are exact sums that don't depend on order or
partitioning; a cell's bins are bounded. Its subset is the smallest set of whole bins, nearest first, that holds
the support. A variance floor per statistic keeps the many rows without any symbol or repetition from making the
rest of the cell outliers.

Cells of fewer than ``least`` rows are pooled over the sources of their language, and what is still small over all
languages; a pool that stays small rejects nothing.

Edge cases: null, empty and wordless texts have counts of zero and fail the base rules; null language or source
is a value like any other; a null doc_id is judged like any row; repeated rows are judged one by one and each
counts in the estimates; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, bounded, chunks, mix, runs, small_batches, stage, text_buffers, text_or_empty

UNIT = 1000
# Standard deviations that a statistic has at least: the floors of the covariance's diagonal.
FLOORS = (0.05, 0.1, 0.15, 0.2)
WIDTH = len(FLOORS)
SUPPORT, LEVEL, LEAST, STEPS = 0.6, 0.9999, 60, 6
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
# Bins of squared distances: so many per doubling, from 2 ** -8 on.
_BINS, _LOWEST = 8, -8
_NEAR = 50_000
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BREAK = np.zeros(256, dtype=bool)
_BREAK[0x0A] = True


def _repeated(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which (row, key) occur more than once, and which of these are not the first in their order."""
    order = np.lexsort((np.arange(len(key)), key, row))
    k, r = key[order], row[order]
    like_last = np.zeros(len(k), dtype=bool)
    like_last[1:] = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    like_next = np.append(like_last[1:], False)[:len(k)]
    often, later = np.zeros(len(k), dtype=bool), np.zeros(len(k), dtype=bool)
    often[order], later[order] = like_last | like_next, like_last
    return often, later


def counted(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A line of ``COUNTS`` per row."""
    n = len(at) - 1
    out = np.zeros((n, len(COUNTS)), dtype=np.int64)
    words, word_rows, line_keys, line_rows = [], [], [], []
    for low, piece in runs(raw, at, _SPACE, lower=False):
        words.append(piece.hashes())
        word_rows.append(piece.row)
        data = raw[low:low + len(piece._running) - 1]
        # A code point is a byte that doesn't continue one.
        heads = np.concatenate([[0], np.cumsum(~_SPACE[data] & ((data & 0xC0) != 0x80))])
        out[:, 1] += np.bincount(piece.row, heads[piece.end] - heads[piece.begin], minlength=n).astype(np.int64)
        place = np.flatnonzero(_SYMBOL[data]) + low
        out[:, 2] += np.bincount(np.searchsorted(at, place, "right") - 1, minlength=n)
    for low, piece in runs(raw, at, _BREAK, lower=False):
        data = raw[low:low + len(piece._running) - 1]
        filled = np.concatenate([[0], np.cumsum(~_SPACE[data])])
        has_word = filled[piece.end] > filled[piece.begin]
        line_keys.append(piece.hashes()[has_word])
        line_rows.append(piece.row[has_word])
    if words:
        word, row = np.concatenate(words), np.concatenate(word_rows)
        out[:, 0] = np.bincount(row, minlength=n)
        if len(word) > 2:
            window = mix(word[:-2] + mix(word[1:-1] * U64(3) + mix(word[2:] * U64(5) + U64(7))))
            whole = np.flatnonzero(row[:-2] == row[2:])
            often, _ = _repeated(window[whole], row[whole])
            hit = np.zeros(len(word), dtype=bool)
            for k in range(3):
                hit[whole[often] + k] = True
            out[:, 4] = np.bincount(row[hit], minlength=n)
        key, row = np.concatenate(line_keys), np.concatenate(line_rows)
        out[:, 3] = np.bincount(row[_repeated(key, row)[1]], minlength=n)
        out[:, 5] = np.bincount(row, minlength=n)
    return out


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, at = text_buffers(batch.column("text"))
        rest = [batch.column(c) for c in ("doc_id", "lang", "source")]
        for a, b in chunks(at):
            lines = counted(raw, at[a:b + 1])
            yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in rest], *map(pa.array, lines.T.copy())],
                                             ["doc_id", "lang", "source", *COUNTS])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each whole text."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                       F.col("source").cast("string").alias("source"), text_or_empty().alias("text"))
    return rows.mapInArrow(_statistics, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def vector() -> list[Column]:
    """The transformed statistics, as whole numbers of 1 / ``UNIT``."""
    words = F.greatest("n_words", F.lit(1))
    values = [F.log(F.greatest(F.col("word_chars") / words, F.lit(1.0))), F.sqrt(F.col("n_symbols") / words),
              F.sqrt(F.col("n_repeat_words") / words), F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)))]
    return [F.round(v * UNIT).cast("long").alias(f"x{i}") for i, v in enumerate(values)]


def chi_square(x: float, degrees: int) -> float:
    """Distribution function at ``x``, for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(degrees // 2))


def chi_square_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 1e3
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < p else (low, middle)
    return low


def estimate(count: int, sums: np.ndarray, products: np.ndarray, support: float) -> tuple[list[float], list[float]]:
    """Mean, and inverse of the covariance (row by row), of a subset's moments, in the statistics' own units."""
    mean = sums / count
    spread = (products / count - np.outer(mean, mean)) / UNIT ** 2
    consistent = support / chi_square(chi_square_quantile(support, WIDTH), WIDTH + 2)
    spread = consistent * (spread + spread.T) / 2 + np.diag(np.square(FLOORS))
    return (mean / UNIT).tolist(), np.linalg.inv(spread).ravel().tolist()


_FIT = "cell string, size long, mean array<double>, inverse array<double>"
_PAIRS = [(i, j) for i in range(WIDTH) for j in range(i, WIDTH)]


def _start(pdf: pd.DataFrame) -> pd.DataFrame:
    """Medians and quartile ranges of a cell, from value counts per statistic."""
    mean, scale, size = [], [], 0
    for i in range(WIDTH):
        values = pdf[pdf["dim"] == i].sort_values("value")
        total = values["n"].cumsum().to_numpy()
        size = int(total[-1])
        low, middle, high = (float(values["value"].iloc[np.searchsorted(total, q * size)]) / UNIT for q in (0.25, 0.5, 0.75))
        mean.append(middle)
        scale.append(((high - low) / 1.349) ** 2 + FLOORS[i] ** 2)
    return pd.DataFrame({"cell": [pdf["cell"].iloc[0]], "size": [size], "mean": [mean], "inverse": [np.diag(1 / np.array(scale)).ravel().tolist()]})


def _concentrated(pdf: pd.DataFrame, support: float) -> pd.DataFrame:
    """A cell's estimate from the nearest bins that hold the support."""
    pdf = pdf.sort_values("bin")
    total = pdf["n"].cumsum().to_numpy()
    size = int(total[-1])
    held = pdf.iloc[:int(np.searchsorted(total, math.ceil(support * size))) + 1]
    products = np.zeros((WIDTH, WIDTH))
    for i, j in _PAIRS:
        products[i, j] = products[j, i] = int(held[f"p{i}{j}"].sum())
    sums = np.array([int(held[f"s{i}"].sum()) for i in range(WIDTH)], dtype=float)
    mean, inverse = estimate(int(held["n"].sum()), sums, products, support)
    return pd.DataFrame({"cell": [pdf["cell"].iloc[0]], "size": [size], "mean": [mean], "inverse": [inverse]})


def distance() -> Column:
    """Squared Mahalanobis distance of x0, x1, ... from ``mean`` under ``inverse``."""
    centred = [F.col(f"x{i}") / UNIT - F.get("mean", F.lit(i)) for i in range(WIDTH)]
    total = F.lit(0.0)
    for i in range(WIDTH):
        for j in range(WIDTH):
            total = total + centred[i] * centred[j] * F.get("inverse", F.lit(i * WIDTH + j))
    return total


def with_cells(rows: DataFrame, least: int) -> DataFrame:
    """Adds ``cell``: language and source if they have ``least`` rows, else the pool of the language, else of all."""
    def name(*parts):
        return F.to_json(F.array(*[F.coalesce(F.concat(F.lit("="), p), F.lit("")) for p in parts]))

    own, pool = name(F.col("lang"), F.col("source")), F.concat(F.lit("pool of "), name(F.col("lang")))
    sizes = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("cell", F.when(F.col("n") >= least, own).otherwise(pool))
    pools = sizes.where(F.col("n") < least).groupBy("cell").agg(F.sum("n").alias("pooled"))
    sizes = sizes.join(pools, "cell", "left").withColumn("cell", F.when(F.col("pooled") < least, F.lit("pool")).otherwise(F.col("cell")))
    cells = stage(sizes.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "cell"), "cells")
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    return rows.join(bounded(cells, cells.count(), _NEAR), same).drop("_lang", "_source")


def fit(rows: DataFrame, support: float = SUPPORT, steps: int = STEPS) -> DataFrame:
    """cell, size, mean and inverse covariance, from rows of cell, x0, x1, ..."""
    values = rows.select("cell", F.posexplode(F.array(*[f"x{i}" for i in range(WIDTH)])).alias("dim", "value"))
    cells = stage(values.groupBy("cell", "dim", "value").agg(F.count(F.lit(1)).alias("n")).groupBy("cell").applyInPandas(_start, _FIT), "mcd")
    few = cells.count()
    far = F.greatest(F.floor((F.log2(F.greatest(F.col("d2"), F.lit(2.0 ** _LOWEST))) - _LOWEST) * _BINS), F.lit(0)).cast("int")
    moments = [F.count(F.lit(1)).alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(WIDTH)],
               *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i, j in _PAIRS]]
    for _ in range(steps):
        binned = rows.join(bounded(cells, few, _NEAR), "cell").withColumn("d2", distance()).groupBy("cell", far.alias("bin")).agg(*moments)
        cells = stage(binned.groupBy("cell").applyInPandas(lambda pdf: _concentrated(pdf, support), _FIT), "mcd")
    return cells


def judge(docs: DataFrame, support: float = SUPPORT, level: float = LEVEL, least: int = LEAST, steps: int = STEPS,
          min_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """doc_id, the counts, base_failed, kept, d2 (squared distance, null where none is judged) of every row."""
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    rows = stage(statistics(docs).withColumn("base_failed", failed).select("*", *vector()), "statistics")
    passed = stage(with_cells(rows.where("NOT base_failed"), least), "passed")
    cells = fit(passed.select("cell", *[f"x{i}" for i in range(WIDTH)]), support, steps)
    judged = (passed.join(bounded(cells, cells.count(), _NEAR), "cell")
              .withColumn("d2", F.when(F.col("size") >= least, distance())))
    rows = judged.unionByName(rows.where("base_failed"), allowMissingColumns=True)
    limit = chi_square_quantile(level, WIDTH)
    return rows.select("doc_id", *COUNTS[:5], "base_failed", (~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= limit)).alias("kept"), "d2")
