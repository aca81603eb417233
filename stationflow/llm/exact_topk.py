"""Exact top-k inner products of integer vectors, by exhaustive term-at-a-time accumulation.

Candidates and queries are packed into blocks stored as postings: per component, the block's rows with a
nonzero weight there. For a pair of blocks the postings are scattered into dense arrays: where they are
dense, all components of a block at once, and a matrix product adds up the terms; where they are sparse,
component by component into the scores. A task passes a lane of candidate blocks along a lot of query
blocks and keeps the k best of each query: only lines with a score above their k-th go through partition
selection. The lists of all lanes are merged.

Products are in the smallest type that holds them exactly (``blocks.product_type``), else in 64-bit
integers, which wrap beyond.

Edge cases: vectors that are null or hold null or non-finite components, and rows without an id, take no
part; missing components of shorter vectors count as 0; rows that repeat an id are separate rows (a
query meets its copies, not itself); ties go to the smaller id. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import CELLS, Best, Scores, dealt, narrow, numbers, paired, product_type, steps
from .common import small_batches, stage

CANDIDATES, QUERIES = 4096, 8192
# Blocks of candidates that a task passes along a block of queries, at most.
PER_LANE = 512
# A scattered product costs about as much as so many of a matrix product.
SPARSE = 128
_BLOCK = "block long, size int, width int, ids binary, marks binary, at binary, rows binary, weights binary"


def quantised(vectors: DataFrame, id_column: str, column: str, scale: int) -> DataFrame:
    """id, mark (a number of the row), and floor(scale * x) per component."""
    x = F.col(column).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return (vectors.where(F.col(id_column).isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False)))
            .select(F.col(id_column).cast("long").alias("id"),
                    F.transform(x, lambda v: F.floor(v * F.lit(float(scale)))).alias("v"))
            .withColumn("mark", F.monotonically_increasing_id()))


def _packed(ids: np.ndarray, marks: np.ndarray, widths: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """A block of postings, its rows ascending by id: component t holds rows[at[t]:at[t + 1]], weights alike."""
    order = np.lexsort((marks, ids))
    place = np.empty(len(ids), dtype=np.int64)
    place[order] = np.arange(len(ids))
    row = np.repeat(place, widths)
    term = np.arange(len(values)) - np.repeat(np.cumsum(widths) - widths, widths)
    width = int(widths.max(initial=0))
    if width * len(ids) <= 8 * len(values):
        dense = np.zeros((width, len(ids)), dtype=np.int64)
        dense[term, row] = values
        term, row = np.nonzero(dense)
        weights = dense[term, row]
    else:
        there = np.flatnonzero(values)
        there = there[np.lexsort((row[there], term[there]))]
        term, row, weights = term[there], row[there], values[there]
    at = np.searchsorted(term, np.arange(width + 1))
    return pa.RecordBatch.from_arrays(
        [pa.array([int(marks.min())], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([width], pa.int32()),
         *[pa.array([narrow(x)], pa.binary()) for x in (ids[order], marks[order], at, row, weights)]],
        ["block", "size", "width", "ids", "marks", "at", "rows", "weights"])


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows to blocks of ``size`` rows, or of as many as have ``CELLS`` components."""
    held, rows, cells = [], 0, 0
    for batch in batches:
        ids, marks = (batch.column(c).to_numpy() for c in ("id", "mark"))
        flat = batch.column("v")
        values, at = flat.values.to_numpy(zero_copy_only=False), flat.offsets.to_numpy()
        a = 0
        while a < len(ids):
            b = min(a + size - rows, int(np.searchsorted(at, at[a] + CELLS - cells, "right")) - 1, len(ids))
            b = max(b, a + 1)
            held.append((ids[a:b], marks[a:b], np.diff(at[a:b + 1]), values[at[a]:at[b]]))
            rows, cells = rows + b - a, cells + int(at[b] - at[a])
            if rows == size or cells >= CELLS or b < len(ids):
                yield _packed(*map(np.concatenate, zip(*held)))
                held, rows, cells = [], 0, 0
            a = b
    if held:
        yield _packed(*map(np.concatenate, zip(*held)))


class _Postings:
    """A block as ``_packed`` made it."""

    def __init__(self, batch: pa.RecordBatch, i: int, prefix: str = ""):
        def column(name):
            return batch.column(prefix + name)

        n, self.width = column("size")[i].as_py(), column("width")[i].as_py()
        self.ids, self.marks = (numbers(column(c), i, n).astype(np.int64) for c in ("ids", "marks"))
        self.at = numbers(column("at"), i, self.width + 1).astype(np.int64)
        self.rows, self.weights = (numbers(column(c), i, int(self.at[-1])).copy() for c in ("rows", "weights"))
        squares = np.bincount(self.rows, np.square(self.weights, dtype=np.float64), minlength=n)
        self.length = float(np.sqrt(squares.max(initial=0)))
        self._dense: dict[type, np.ndarray] = {}

    def dense(self, kind: type) -> np.ndarray:
        if kind not in self._dense:
            out = self._dense[kind] = np.zeros((len(self.ids), self.width), dtype=kind)
            out[self.rows, np.repeat(np.arange(self.width), np.diff(self.at))] = self.weights
        return self._dense[kind]

    def term(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.at[t], self.at[t + 1]
        return self.rows[a:b], self.weights[a:b].astype(np.int64)


def _scattered(queries: _Postings, block: _Postings, a: int, b: int) -> np.ndarray:
    """Scores of the queries a to b with a block: each component's postings are scattered in turn."""
    scores = np.zeros((b - a, len(block.ids)), dtype=np.int64)
    for t in range(min(queries.width, block.width)):
        (lines, w), (post, pw) = queries.term(t), block.term(t)
        lo, hi = np.searchsorted(lines, [a, b])
        if hi > lo and len(post):
            scores[np.ix_(lines[lo:hi] - a, post)] += np.multiply.outer(w[lo:hi], pw)
    return scores


def _searched(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    asked: dict[int, tuple[_Postings, Best]] = {}
    room = Scores()
    for batch in batches:
        for i, key in enumerate(batch.column("a_block").to_pylist()):
            if key not in asked:
                new = _Postings(batch, i, "a_")
                asked[key] = new, Best(len(new.ids), k)
            (queries, best), block = asked[key], _Postings(batch, i)
            width = min(queries.width, block.width)
            met = float(np.dot(np.diff(queries.at)[:width].astype(float), np.diff(block.at)[:width]))
            kind = product_type(queries.length, block.length)
            scattered = SPARSE * met < float(len(queries.ids)) * len(block.ids) * width
            for a, b in steps(len(queries.ids), len(block.ids)):
                scores = (_scattered(queries, block, a, b) if scattered
                          else room.products(queries.dense(kind)[a:b], block.dense(kind)))
                best.add(np.arange(a, b), scores, block.ids, block.marks, queries.marks[a:b])
    for queries, best in asked.values():
        line, score, row, mark = best.entries()
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (queries.ids[line], queries.marks[line], row, mark, score)],
            ["query_id", "query_mark", "vec_id", "mark", "score"])


def exact_top_k(vectors: DataFrame, is_query: str, k: int = 5, scale: int = 256, id_column: str = "vec_id",
                column: str = "embedding") -> DataFrame:
    """query_id, query_mark (which row, if ids repeat), rank, vec_id, score.

    ``is_query`` is an SQL condition on ``id``.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = stage(quantised(vectors, id_column, column, scale), "vectors")
    total, wanted = rows.agg(F.count(F.lit(1)), F.count_if(F.expr(is_query))).first()
    lanes, lots = dealt(spark, -(-total // CANDIDATES), -(-wanted // QUERIES), PER_LANE)

    def blocks(chosen: DataFrame, size: int) -> DataFrame:
        return chosen.select("id", "mark", "v").mapInArrow(lambda it: _blocks(it, size), _BLOCK)

    # Queries are dealt by a hash, so a lot may have a few more than ``QUERIES``.
    asked = stage(blocks(rows.where(is_query).repartition(lots, "mark").coalesce(lots), 2 * QUERIES), "query_blocks")
    partial = paired(blocks(rows, CANDIDATES), asked, lanes, lots).mapInArrow(
        lambda it: _searched(it, k), "query_id long, query_mark long, vec_id long, mark long, score long")
    best = Window.partitionBy("query_id", "query_mark").orderBy(F.col("score").desc(), "vec_id", "mark")
    return (partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "query_mark", "rank", "vec_id", "score"))
