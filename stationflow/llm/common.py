"""Helpers shared by the training-data operators: staged tables, text buffers, word hashes, row keys."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import stage, staging_path  # noqa: F401  (used by the operators)

# Most rows a table may have to be broadcast; larger ones are joined by a shuffle instead.
BROADCAST_ROWS = 1_000_000
# Rows are taken in groups of about this many bytes, and hashed in pieces of ``PIECE_BYTES``, so that a task's
# memory follows neither the batch nor the longest text.
CHUNK_BYTES = 1 << 19
PIECE_BYTES = 1 << 17
# A staged table that a shuffle made has at most so many files a core.
FILES_A_CORE = 4
# Whole texts go to Python in Arrow batches of about this many bytes; JVM and worker hold one of each at a time.
BATCH_BYTES = 2 << 20

U64 = np.uint64
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_PLAIN = np.arange(256, dtype=np.uint8)
_POWERS: dict[str, np.ndarray] = {}


def drop_staged(df: DataFrame) -> None:
    """Deletes the folder of a staged table, through Hadoop's file system. Nothing may read it any more."""
    files = df.inputFiles()
    if files:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stage_shuffled(df: DataFrame, label: str) -> DataFrame:
    """``stage`` for what a shuffle leaves in many small partitions: a task takes several of them, one after another.

    Spark's local file system starts a process for each file and its checksum (chmod); until that one runs, it
    counts with all the memory of its executor once more.
    """
    return stage(df.coalesce(FILES_A_CORE * df.sparkSession.sparkContext.defaultParallelism), label)


def bounded(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for a broadcast when its counted ``rows`` stay within ``limit``; else as it is."""
    return F.broadcast(df) if rows <= limit else df


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's size of Arrow batches to ``BATCH_BYTES``, unless it is lower."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).lower().rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def freeing(batches: Iterator) -> Iterator:
    """``batches``; behind each, memory that the worker has freed goes back to the system.

    Workers live on between tasks, and else keep the most that any of their tasks has taken.
    """
    trim = getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)  # glibc has it
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
        trim(0)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def remainder_of_id(column: str = "doc_id", folds: int = 3) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offset of each row; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def chunks(at: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each; a longer row stands alone."""
    first = 0
    while first < len(at) - 1:
        last = int(np.searchsorted(at, at[first] + size, "right")) - 1
        last = min(max(last, first + 1), len(at) - 1)
        yield first, last
        first = last


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse; those of an ordinary piece are kept."""
    if n <= len(_POWERS.get("up", ())):
        return _POWERS["up"][:n], _POWERS["down"][:n]
    made = []
    for base in (_MULTIPLIER, _INVERSE):
        steps = np.full(max(n, PIECE_BYTES), base, dtype=U64)
        steps[:1] = 1
        made.append(np.multiply.accumulate(steps))
    if len(made[0]) <= 2 * PIECE_BYTES:
        _POWERS["up"], _POWERS["down"] = made
    return made[0][:n], made[1][:n]


def _next_cut(data: np.ndarray, at: np.ndarray, gap: np.ndarray, low: int) -> int:
    """First place from ``low`` on where no run goes through: a row's start or a byte of ``gap``."""
    row = int(at[np.searchsorted(at, low, "left")])
    step = 1 << 12
    while low < row:
        found = np.flatnonzero(gap[data[low:min(low + step, row)]])
        if len(found):
            return low + int(found[0])
        low, step = low + step, step * 2
    return row


class Runs:
    """Runs of bytes outside a set, within rows: ``begin``, ``end`` and ``row`` of each, and their hashes.

    A hash is the polynomial of a run's bytes, read off one running sum over the piece.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, gap: np.ndarray, first_row: int, lower: bool):
        inside = ~gap[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        inner = at[(at > 0) & (at < len(data))]
        first[inner], last[inner - 1] = inside[inner], inside[inner - 1]
        self.begin, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row = np.searchsorted(at, self.begin, "right") - 1 + first_row
        self._up, self._down = _powers(len(data))
        self._running = np.zeros(len(data) + 1, dtype=U64)
        values = (_LOWER if lower else _PLAIN)[data].astype(U64)
        values += U64(1)
        values *= self._up
        np.cumsum(values, out=self._running[1:])

    def hashes(self) -> np.ndarray:
        low = self._running[self.begin]
        return mix(((self._running[self.end] - low) * self._down[self.begin]) ^ ((self.end - self.begin).astype(U64) << U64(48)))

    def prefixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and row of the first ``size`` bytes of each longer run."""
        longer = self.end - self.begin > size
        b = self.begin[longer]
        value = (self._running[b + size] - self._running[b]) * self._down[b]
        return mix(value ^ U64((size << 48) | (1 << 63))), self.row[longer]


def runs(raw: np.ndarray, at: np.ndarray, gap: np.ndarray, lower: bool = True) -> Iterator[tuple[int, Runs]]:
    """The runs of rows ``at`` in ``raw``, piece by piece: where in ``raw`` the piece starts, and its runs."""
    stop, low = int(at[-1]), int(at[0])
    while low < stop:
        high = stop if low + PIECE_BYTES >= stop else _next_cut(raw, at, gap, low + PIECE_BYTES)
        # The last row that starts at or before the piece, up to the first that starts after it.
        a, b = int(np.searchsorted(at, low, "right")) - 1, int(np.searchsorted(at, high, "left"))
        yield low, Runs(raw[low:high], at[a:b + 1] - low, gap, a, lower)
        low = high


def hashed_runs(raw: np.ndarray, at: np.ndarray, gap: np.ndarray,
                prefixes: tuple[int, ...] = ()) -> list[tuple[np.ndarray, np.ndarray]]:
    """Runs of bytes outside ``gap``, A-Z lower-cased: a 64-bit hash and the row of each.

    Then the same for the first bytes of each run that is longer than a number of ``prefixes``.
    """
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(1 + len(prefixes))]
    for _, piece in runs(raw, at, gap):
        found[0].append((piece.hashes(), piece.row))
        for k, size in enumerate(prefixes):
            found[k + 1].append(piece.prefixes(size))
    none = [(np.zeros(0, U64), np.zeros(0, np.int64))]
    return [tuple(np.concatenate(c) for c in zip(*(part or none))) for part in found]


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words between white space (0x20, 0x09-0x0D): a 64-bit hash and the row of each."""
    return hashed_runs(raw, at, _GAP)[0]
