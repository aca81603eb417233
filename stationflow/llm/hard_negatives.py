"""Hard negatives per (anchor, positive): rows of another label that score close below a positive.

Candidates and anchors are packed into blocks; a pair of blocks is scored by matrix products. A first pass
scores rows of equal labels only and finds each anchor's first positives, and so the windows of scores of
its negatives. A second pass scores all pairs. A task keeps the first ``negatives`` of each window over all
candidate blocks it passes along the anchors; a pair counts only if its score lies between the last of
those and the window's upper bound, so few do after the first blocks, and what a task hands over doesn't
grow with its candidates.

What the tasks found is shuffled by anchor with the positives and sorted within partitions by (anchor,
descending score, positives first, id): a secondary sort. One pass over a sorted partition then opens a
window of scores for each of an anchor's first positives and hands the rows that follow to the windows they
fall into, until each is full. Only the open windows of one anchor are held, however many rows it has.

Products are in the smallest type that holds them exactly (``blocks.product_type``), else in 64-bit integers.

Edge cases: rows with a null id, label or vector, or with a null or non-finite component, take no part;
missing components of shorter vectors count as 0; rows that repeat an id are separate rows, and an anchor
meets its copies, not itself; ties go to the smaller id; a positive with a negative score has an empty
window; anchors without positives or windows without rows give no rows. Scores are 64-bit integers and wrap
beyond. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import CELLS, FOUND, Best, Scores, dealt, narrow, numbers, paired, places, product_type, steps
from .common import small_batches, stage

BLOCK, ANCHORS = 4096, 8192
# Blocks of candidates that a task passes along a block of anchors, at most.
PER_LANE = 512
# Blocks that one task packs, at most.
PACKED = 64
# Columns by which a fresh window meets its first block; then as many as it has met.
FIRST = 64
_PAIR = "anchor long, mark long, score long, negative boolean, id long, other long"
_BLOCK = "block long, size int, width int, ids binary, marks binary, labels binary, vectors binary, limits binary"


def usable(vectors: DataFrame, id_column: str, label: Column, column: str, scale: int) -> DataFrame:
    """id, mark (a number of the row), label as text's 64-bit hash, floor(scale * x) per component."""
    x = F.col(column).cast("array<double>")
    finite = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), F.lit(False))
    return (vectors.where(F.col(id_column).isNotNull() & label.isNotNull() & finite)
            .select(F.col(id_column).cast("long").alias("id"), F.xxhash64(label).alias("label"),
                    F.transform(x, lambda v: F.floor(v * F.lit(float(scale)))).alias("v"))
            .withColumn("mark", F.monotonically_increasing_id()))


def _packed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows to blocks that ascend by id: ids, marks, labels, vectors and limits as raw integers.

    ``limits`` are the scores of an anchor's positives, the same number for each; candidates have none.
    """
    held, width = [], 0

    def block():
        rows = sorted(held, key=lambda r: r[:2])
        vectors = np.zeros((len(rows), width), dtype=np.int64)
        for i, r in enumerate(rows):
            vectors[i, :len(r[3])] = r[3]
        raw = [narrow(np.array([r[k] for r in rows], dtype=np.int64)) for k in (0, 1, 2, 4)]
        raw.insert(3, narrow(vectors))
        return pa.RecordBatch.from_arrays(
            [pa.array([min(r[1] for r in rows)], pa.int64()), pa.array([len(rows)], pa.int32()), pa.array([width], pa.int32()),
             *[pa.array([b], pa.binary()) for b in raw]],
            ["block", "size", "width", "ids", "marks", "labels", "vectors", "limits"])

    for batch in batches:
        flat = batch.column("v")
        values, at = flat.values.to_numpy(zero_copy_only=False), flat.offsets.to_numpy()
        columns = [batch.column(c).to_pylist() for c in ("id", "mark", "label", "limits")]
        for i, (row, mark, label, limits) in enumerate(zip(*columns)):
            wider = max(width, int(at[i + 1] - at[i]))
            if held and (len(held) == size or wider * (len(held) + 1) > CELLS):
                yield block()
                held, wider = [], int(at[i + 1] - at[i])
            held.append((row, mark, label, values[at[i]:at[i + 1]], limits))
            width = wider
    if held:
        yield block()


class _Rows:
    """A block as ``_packed`` made it."""

    def __init__(self, batch: pa.RecordBatch, i: int, prefix: str = ""):
        def column(name):
            return batch.column(prefix + name)

        n, width = column("size")[i].as_py(), column("width")[i].as_py()
        self.ids, self.marks, self.labels = (numbers(column(c), i, n).astype(np.int64) for c in ("ids", "marks", "labels"))
        self.vectors = numbers(column("vectors"), i, n * width).reshape(n, width).copy()
        self.limits = column("limits")[i].as_buffer()
        self.length = float(np.sqrt(np.square(self.vectors, dtype=np.float64).sum(axis=1).max(initial=0)))
        order = np.argsort(self.labels, kind="stable")
        label, at = np.unique(self.labels[order], return_index=True)
        self.by_label = dict(zip(label.tolist(), np.split(order, at[1:])))
        self._typed: dict[type, np.ndarray] = {}

    def typed(self, kind: type) -> np.ndarray:
        if kind not in self._typed:
            self._typed[kind] = self.vectors.astype(kind)
        return self._typed[kind]


def _best_pairs(batches: Iterator[pa.RecordBatch], positives: int) -> Iterator[pa.RecordBatch]:
    """The first positives of each anchor among the candidates of a lane."""
    held: dict[int, tuple[_Rows, Best]] = {}
    room = Scores()
    for batch in batches:
        for i, key in enumerate(batch.column("a_block").to_pylist()):
            if key not in held:
                new = _Rows(batch, i, "a_")
                held[key] = new, Best(len(new.ids), positives)
            (anchors, best), block = held[key], _Rows(batch, i)
            kind = product_type(anchors.length, block.length)
            for label in anchors.by_label.keys() & block.by_label.keys():
                lines, columns = anchors.by_label[label], block.by_label[label]
                a_vectors, vectors = anchors.typed(kind)[lines], block.typed(kind)[columns]
                for a, b in steps(len(lines), len(columns)):
                    best.add(lines[a:b], room.products(a_vectors[a:b], vectors), block.ids[columns], block.marks[columns],
                             anchors.marks[lines[a:b]])
    for anchors, best in held.values():
        yield _pairs(anchors, False, *best.entries())


def _pairs(anchors: _Rows, negative: bool, line, score, row, mark) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(x) for x in (anchors.ids[line], anchors.marks[line], score, np.full(len(line), negative), row, mark)],
        ["anchor", "mark", "score", "negative", "id", "other"])


def bounds(scores: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score between ``low`` and ``high`` per cent of others, without greater products."""
    whole, rest = np.divmod(scores, 100)
    return low * whole - (-low * rest // 100), high * whole + high * rest // 100


class _Windows:
    """The first negatives in each window of each anchor so far: window w of anchor i is line i * n + w of ``best``."""

    def __init__(self, anchors: _Rows, positives: int, negatives: int, low: int, high: int):
        self.anchors, self.n = anchors, positives
        raw = np.frombuffer(anchors.limits, f"i{anchors.limits.size // (len(anchors.ids) * 2 * positives)}")
        raw = raw.reshape(len(anchors.ids), 2, positives).astype(np.int64)
        bottom, self.top = bounds(raw[:, 1], low, high)
        shut = (raw[:, 0] == 0) | (bottom > self.top)
        # A shut window is above all that can be.
        bottom[shut], self.top[shut] = np.iinfo(np.int64).max, np.iinfo(np.int64).min
        self.best = Best(self.top.size, negatives)
        self.best.floor = bottom.ravel()
        self.met, self.found, self.size = 0, [], 0

    def meet(self, block: _Rows, room: Scores) -> None:
        kind = product_type(self.anchors.length, block.length)
        vectors, a_vectors = block.typed(kind), self.anchors.typed(kind)
        a = 0
        while a < len(block.ids):
            b = min(len(block.ids), a + max(FIRST, self.met))
            for x, y in steps(len(a_vectors), b - a):
                self._near(x, y, room.products(a_vectors[x:y], vectors[a:b]), a, block)
            self._merge()
            self.met += b - a
            a = b

    def _near(self, x: int, y: int, scores: np.ndarray, first: int, block: _Rows) -> None:
        """Notes pairs of the anchors x to y that lie in a window."""
        floor, top = self.best.floor.reshape(-1, self.n)[x:y], self.top[x:y]
        lines, columns = places((scores >= floor.min(axis=1).astype(scores.dtype)[:, None])
                                & (scores <= top.max(axis=1).astype(scores.dtype)[:, None]))
        score, columns = scores[lines, columns].astype(np.int64), columns + first
        other = block.labels[columns] != self.anchors.labels[x:y][lines]
        lines, columns, score = lines[other], columns[other], score[other]
        for w in range(self.n):
            inside = np.flatnonzero((score >= floor[lines, w]) & (score <= top[lines, w]))
            self.found.append(((x + lines[inside]) * self.n + w, score[inside], block.ids[columns[inside]], block.marks[columns[inside]]))
            self.size += len(inside)
        if self.size > FOUND:
            self._merge()

    def _merge(self) -> None:
        if self.size:
            self.best.merge(*map(np.concatenate, zip(*self.found)))
        self.found, self.size = [], 0

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, score, id and mark of all that is held, once if in several windows."""
        line, *rest = self.best.entries()
        line = line // self.n
        order = np.lexsort((rest[2], line))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(line[order]) != 0) | (np.diff(rest[2][order]) != 0)
        return tuple(x[order[new]] for x in (line, *rest))


def _near_pairs(batches: Iterator[pa.RecordBatch], positives: int, negatives: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """The first negatives of each window of each anchor among the candidates of a lane."""
    held: dict[int, _Windows] = {}
    room = Scores()
    for batch in batches:
        for i, key in enumerate(batch.column("a_block").to_pylist()):
            if key not in held:
                held[key] = _Windows(_Rows(batch, i, "a_"), positives, negatives, low, high)
            held[key].meet(_Rows(batch, i), room)
    for windows in held.values():
        yield _pairs(windows.anchors, True, *windows.entries())


class _Window:
    """Scores between two bounds of one positive, and how many negatives it has."""

    def __init__(self, row: int, score: int, low: int, high: int):
        self.row, self.score, self.taken = row, score, 0
        self.top, self.bottom = high * score // 100, -(-low * score // 100)

    def take(self, falling: np.ndarray, limit: int) -> tuple[int, int]:
        """Range of the next negatives, of negated scores in ascending order."""
        a = int(np.searchsorted(falling, -self.top, "left"))
        b = min(int(np.searchsorted(falling, -self.bottom, "right")), a + limit - self.taken)
        return a, max(a, b)


def _mined(batches: Iterator[pa.RecordBatch], positives: int, negatives: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """Sorted pairs to (anchor, positive, rank, negative): windows open and fill as the rows pass by."""
    anchor, windows = None, []
    for batch in batches:
        names = ("anchor", "mark", "score", "id")
        ids, marks, scores, others = (batch.column(c).to_numpy() for c in names)
        is_negative = batch.column("negative").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(marks, prepend=marks[:1])) if len(marks) else []
        out = []
        for a, b in zip([0, *cuts], [*cuts, len(marks)]):
            if a == b:
                continue
            if marks[a] != anchor:
                anchor, windows = marks[a], []
            for i in a + np.flatnonzero(~is_negative[a:b])[:positives - len(windows)]:
                windows.append(_Window(int(others[i]), int(scores[i]), low, high))
            rest = a + np.flatnonzero(is_negative[a:b])
            falling = -scores[rest]
            for w in windows:
                if w.taken < negatives and w.top >= w.bottom:
                    x, y = w.take(falling, negatives)
                    for k in rest[x:y]:
                        w.taken += 1
                        out.append((ids[a], w.row, w.taken, others[k], w.score, scores[k]))
        if out:
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(c, np.int64), pa.int32() if i == 2 else pa.int64()) for i, c in enumerate(columns)],
                ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])


def hard_negatives(vectors: DataFrame, is_anchor: str, label: Column, positives: int = 5, negatives: int = 10, low: int = 30,
                   high: int = 90, scale: int = 256, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A negative's score lies between ``low`` and ``high`` per cent of the positive's; ``is_anchor`` is an SQL
    condition on ``id``.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = stage(usable(vectors, id_column, label, column, scale), "vectors")
    total, asked = rows.agg(F.count(F.lit(1)), F.count_if(F.expr(is_anchor))).first()
    lanes, lots = dealt(spark, -(-total // BLOCK), -(-asked // ANCHORS), PER_LANE)

    def blocks(chosen: DataFrame, parts: int, size: int, name: str) -> DataFrame:
        """Rows are dealt by a hash, so blocks hold rows from anywhere in the table."""
        chosen = chosen.repartition(parts, "mark").coalesce(parts).select("id", "mark", "label", "v", "limits")
        return stage(chosen.mapInArrow(lambda it: _packed(it, size), _BLOCK), name)

    none = F.array().cast("array<long>")
    offered = blocks(rows.withColumn("limits", none), max(lanes, -(-total // (PACKED * BLOCK))), BLOCK, "blocks")
    # A lot may have a few more anchors than ``ANCHORS``.
    anchors = blocks(rows.where(is_anchor).withColumn("limits", none), lots, 2 * ANCHORS, "anchor_blocks")
    best = Window.partitionBy("mark").orderBy(F.col("score").desc(), "id", "other")
    first = (paired(offered, anchors, lanes, lots).mapInArrow(lambda it: _best_pairs(it, positives), _PAIR)
             .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= positives))
    first = stage(first, "positives")

    # Whether there is a first, second, ... positive, then their scores.
    there = F.collect_list("score").alias("scores")
    at = F.sequence(F.lit(0), F.lit(positives - 1))
    limits = first.groupBy("mark").agg(there).select("mark", F.concat(
        F.transform(at, lambda k: (k < F.size("scores")).cast("long")),
        F.transform(at, lambda k: F.coalesce(F.get("scores", k), F.lit(0).cast("long")))).alias("limits"))
    anchors = blocks(rows.where(is_anchor).join(limits, "mark"), lots, 2 * ANCHORS, "window_blocks")
    near = paired(offered, anchors, lanes, lots).mapInArrow(lambda it: _near_pairs(it, positives, negatives, low, high), _PAIR)
    pairs = near.unionByName(first.drop("rank"))
    ranked = pairs.repartition("mark").sortWithinPartitions("mark", F.col("score").desc(), "negative", "id", "other")
    return ranked.mapInArrow(lambda it: _mined(it, positives, negatives, low, high),
                             "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
