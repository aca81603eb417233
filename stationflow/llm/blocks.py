"""Blocks of integer vectors met in pairs: exact products, and what is best of each line so far.

A task holds some blocks of queries and passes blocks of candidates along them. ``Best`` keeps the k best
of each query over all candidates that the task has met, so a score counts only if it is above the
query's k-th, and a task hands over k rows a query, however many candidates it has met.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Most components of a block: long vectors make smaller blocks.
CELLS = 1 << 21
# Scores that are held at once, and found entries that wait to be merged.
SCORES, FOUND = 1 << 20, 1 << 19
_LEAST = np.iinfo(np.int64).min


def narrow(x: np.ndarray) -> bytes:
    """The numbers in the narrowest of three integer types."""
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    kind = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return x.astype(kind).tobytes()


def numbers(column: pa.Array, i: int, n: int) -> np.ndarray:
    """The ``n`` numbers that ``narrow`` made."""
    raw = column[i].as_buffer()
    return np.frombuffer(raw, f"i{raw.size // n}" if n else np.int64)


def product_type(a: float, b: float) -> type:
    """In which products of vectors of whole numbers are exact, by the greatest lengths of both sides.

    A product, and each part of its sum, is at most the product of both lengths.
    """
    return next((t for t, most in ((np.float32, 2.0 ** 24), (np.float64, 2.0 ** 53)) if a * b < 0.999 * most), np.int64)


class Scores:
    """Room for scores, used again and again."""

    def __init__(self):
        self.room: dict[type, np.ndarray] = {}

    def products(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Products of all lines of ``a`` and ``b``; they are overwritten by the next ones."""
        size = len(a) * len(b)
        if len(self.room.get(a.dtype.type, ())) < size:
            self.room[a.dtype.type] = np.empty(max(size, SCORES), a.dtype)
        out = self.room[a.dtype.type][:size].reshape(len(a), len(b))
        width = min(a.shape[1], b.shape[1])
        return np.matmul(a[:, :width], b[:, :width].T, out=out)


def steps(lines: int, columns: int) -> Iterator[tuple[int, int]]:
    """Ranges of lines of about ``SCORES`` scores."""
    step = max(1, SCORES // max(columns, 1))
    for a in range(0, lines, step):
        yield a, min(a + step, lines)


def places(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line and column of the few true ones, in order."""
    flat = chosen.ravel()
    if flat.size % 8:
        at = np.flatnonzero(flat)
    else:
        eights = np.flatnonzero(flat.view(np.uint64))
        near = flat.reshape(-1, 8)[eights]
        at = (eights[:, None] * 8 + np.arange(8))[near]
    return np.divmod(at, chosen.shape[1])


class Best:
    """Score, id and mark of the k best of each line; ties go to the smaller id, then to the smaller mark."""

    def __init__(self, lines: int, k: int):
        self.k = k
        self.scores, self.ids, self.marks = (np.full((lines, k), x, dtype=np.int64) for x in (_LEAST, -1, -1))
        # The k-th score, the least one there is while a line has fewer, and its id.
        self.floor, self.last = np.full(lines, _LEAST), np.full(lines, np.iinfo(np.int64).max)

    def add(self, lines: np.ndarray, scores: np.ndarray, ids: np.ndarray, marks: np.ndarray, own: np.ndarray) -> None:
        """Scores of ``lines`` with columns that ascend by id; a line doesn't meet the mark in ``own``.

        Of the lines with a score above their k-th, those with many go through partition selection of the k + 1
        best: one may be the line itself.
        """
        if not scores.size:
            return
        floor, most = self.floor[lines], self.k + 1
        if scores.dtype != np.int64:  # ties with the k-th don't count in a block of greater ids
            floor = floor + (self.last[lines] < ids[0])
        floor = floor.astype(scores.dtype)
        near = np.flatnonzero(scores.max(axis=1) >= floor)
        if not len(near):
            return
        some, floor = scores[near], floor[near]
        chosen = some >= floor[:, None]
        many = np.flatnonzero(np.count_nonzero(chosen, axis=1) > most)
        if len(many):
            n = some.shape[1]
            kth = np.partition(some[many], n - most, axis=1)[:, n - most]
            same = some[many] == kth[:, None]
            above = some[many] > kth[:, None]
            left = most - np.count_nonzero(above, axis=1)
            chosen[many] = above | same & (np.cumsum(same, axis=1) <= left[:, None])
        line, column = places(chosen)
        other = marks[column] != own[near][line]
        line, column = line[other], column[other]
        self.merge(lines[near][line], some[line, column].astype(np.int64), ids[column], marks[column])

    def merge(self, lines: np.ndarray, scores: np.ndarray, ids: np.ndarray, marks: np.ndarray) -> None:
        """Adds entries, any number for each line."""
        k = self.k
        order = np.lexsort((marks, ids, ~scores, lines))
        lines = lines[order]
        changed, first, count = np.unique(lines, return_index=True, return_counts=True)
        if not len(changed):
            return
        rank = np.arange(len(lines)) - np.repeat(first, count)
        kept = rank < k
        line, rank, order = np.repeat(np.arange(len(changed)), count)[kept], k + rank[kept], order[kept]
        wide = [np.full((len(changed), k + min(k, int(count.max()))), x, dtype=np.int64) for x in (_LEAST, -1, -1)]
        for to, held, new in zip(wide, (self.scores, self.ids, self.marks), (scores, ids, marks)):
            to[:, :k] = held[changed]
            to[line, rank] = new[order]
        best = np.lexsort((wide[2], wide[1], ~wide[0], wide[2] < 0), axis=-1)[:, :k]
        self.scores[changed], self.ids[changed], self.marks[changed] = (np.take_along_axis(x, best, axis=1) for x in wide)
        full = self.marks[changed, -1] >= 0
        self.floor[changed[full]], self.last[changed[full]] = self.scores[changed[full], -1], self.ids[changed[full], -1]

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Line, score, id and mark of all that is held."""
        there = self.marks >= 0
        return np.nonzero(there)[0], self.scores[there], self.ids[there], self.marks[there]


def dealt(spark, candidates: int, queries: int, per_lane: int) -> tuple[int, int]:
    """Lanes and lots for so many blocks: a task for each pair of them.

    Lanes hold ``per_lane`` blocks of candidates, or fewer where else a core would have less than three tasks.
    """
    lots = max(1, queries)
    enough = -(-3 * spark.sparkContext.defaultParallelism // lots)
    return max(1, min(candidates, max(-(-candidates // per_lane), enough))), lots


def paired(offered: DataFrame, asked: DataFrame, lanes: int, lots: int) -> DataFrame:
    """Each block of ``offered`` with each of ``asked``, whose columns get the prefix ``a_``, lane by lot.

    A task fetches its lane and its lot: blocks are shuffled once, not copied for each block that they meet.
    """
    asked = asked.select(*[F.col(c).alias(f"a_{c}") for c in asked.columns])
    left, right = offered.repartition(lanes, "block").coalesce(lanes), asked.repartitionByRange(lots, "a_block").coalesce(lots)
    return left.crossJoin(right.hint("shuffle_replicate_nl"))
