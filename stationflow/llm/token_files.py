"""Token ids in raw binary shards, with a minimal perfect hash index from document keys to shard offsets.

A shard file holds, in this order: the ids of its documents one after another (little-endian, 2 bytes
each if the vocabulary fits, else 4), one (doc_id, has_id, n_ids) line per document as three arrays, and
a fixed trailer. Shards are numbered by (part, piece), the numbers in the file name; documents ascend
by doc_id through all shards. Spark's own text writer writes each packed shard as one record of one
file, so the output is committed by Spark on any file system it can write to.

The index is cut into segments of about ``SEGMENT`` keys by a hash of the key. A segment is a BBHash
(Limasset et al., 2017): per level, keys that fall alone on a bit own it, the others go on; the rank of
the bit is the key's slot. Slots hold a 32-bit fingerprint and the address (part, piece, first id), so
a lookup reads one segment row and one slot, and an absent key is rejected by its fingerprint.

Edge cases: a null or empty text is the end id alone; a null doc_id sorts first and is stored but not
indexed; rows that repeat a doc_id are stored next to each other and the index points to the first.
Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, freeing, mix, small_batches, stage, text_buffers, text_or_empty

SHARD_IDS = 4 << 20
SEGMENT = 1 << 16
# The memo of one Python worker: a word has its place in one of ``PROBES`` neighbouring slots of a table; where none
# is free, the newer word takes the first. It starts anew when it holds ``STORE_IDS`` ids.
SLOTS, PROBES, STORE_IDS = 1 << 21, 4, 12_000_000
# Text is encoded in windows of about so many bytes.
WINDOW_BYTES = 1 << 20
# How a byte-level vocabulary writes a space; marks that never stand in a token with letters.
_SPACE, _MARKS = "\u0120", ".,;:!?%$#&*|"
_ENCODERS: dict[str, "Encoder"] = {}
# Words of up to two 8-byte loads are compared by these; longer ones, up to a length, by their bytes.
_LOADS, _MEMO_LENGTH = 16, 64
_MAGIC = b"SFTOKENS"
_TRAILER = np.dtype([("docs", "<u8"), ("ids", "<u8"), ("width", "<u8"), ("magic", "S8")])
# Bytes of white space, bytes that may open a longer character of white space, and the last two of such a one.
_WHITE, _OPENS, _LAST, _BEFORE_LAST = (np.isin(np.arange(256), v) for v in (
    [*range(9, 14), *range(28, 33)], [0xC2, 0xE1, 0xE2, 0xE3], [*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF], [0xC2, 0x80, 0x81, 0x9A]))
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=U64)
ADDRESS = "part long, piece long, first long"


def _cuts(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Spaces that stand alone between two words: a text may be cut before each. Spaces at ``edges`` don't.

    White space of several bytes is told by its first or last bytes, which other characters may have as
    well: then there is no cut, which never changes the ids.
    """
    place = np.flatnonzero(data == 0x20)
    place = place[(place > 0) & (place + 1 < len(data))]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[edges] = True
    before, after = data[place - 1], data[place + 1]
    wide = _LAST[before] & _BEFORE_LAST[data[place - 2]] & (place > 1)
    return place[~(_WHITE[before] | _WHITE[after] | _OPENS[after] | wide | edge[place] | edge[place + 1])]


class Encoder:
    """Whole texts to id bytes, through a tokenizer of the ``tokenizers`` library.

    In a byte-level vocabulary without normaliser a lone space between two words always opens a new
    token, so a text may be encoded word by word. Words are found, looked up and replaced by their ids in
    whole windows of text at once: a word of up to 16 bytes is two 8-byte numbers, which a hash table of such
    numbers is asked for and compared with. New words go through the tokenizer in one string: letters after a
    space are cut off again where a token opens with a space. Other vocabularies encode the text as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(True) <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        self.by_word = (spec.get("normalizer") is None and split.get("type") == "ByteLevel"
                        and not split.get("add_prefix_space") and split.get("use_regex", True)
                        and not any(t.get("lstrip") or t.get("rstrip") or " " in t["content"] for t in spec["added_tokens"]))
        self._forget()
        self.opens = np.zeros(self.tokenizer.get_vocab_size(True), dtype=bool)
        self.opens[[i for token, i in self.tokenizer.get_vocab(True).items() if token.startswith(_SPACE)]] = True

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of each word with a space before it."""
        core: dict[str, bytes] = {}
        tail: dict[str, bytes] = {"": b""}
        parts, whole = [], []
        for w in words:
            c = w.rstrip(_MARKS)
            if c.isalpha():
                core[c] = tail[w[len(c):]] = b""
                parts.append((c, w[len(c):]))
            else:
                whole.append(" " + w)
                parts.append(None)
        ids = np.array(self.tokenizer.encode("".join([f" {c}" for c in core]), add_special_tokens=False).ids, dtype=self.dtype)
        cuts = np.append(np.flatnonzero(self.opens[ids]), len(ids))
        if len(cuts) != len(core) + 1:
            return self.raw([" " + w for w in words])
        flat, cuts = ids.tobytes(), (cuts * self.dtype.itemsize).tolist()
        core = {c: flat[a:b] for c, a, b in zip(core, cuts, cuts[1:])}
        tail = dict(zip(tail, self.raw(list(tail))))
        rest = iter(self.raw(whole))
        return [next(rest) if p is None else core[p[0]] + tail[p[1]] for p in parts]

    def raw(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in found]

    def _forget(self):
        """An empty memo: two numbers, and length, count and offset of the ids in one, per slot."""
        self.table = np.zeros((SLOTS, 3), dtype=U64)
        self.long: dict[bytes, tuple[int, int]] = {}
        self.store, self.used = np.zeros(1 << 16, dtype=self.dtype), 0

    def _behind(self, ids: np.ndarray) -> int:
        """Writes ids behind those in use and returns where they start."""
        need = self.used + len(ids)
        if need > len(self.store):
            self.store = np.concatenate([self.store[:self.used], np.zeros(need, dtype=self.dtype)])
        self.store[self.used:need] = ids
        return self.used

    def _place(self, one: np.ndarray, two: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (mix(one + mix(two + size.astype(U64))) & U64(SLOTS - 1)).astype(np.int64)

    def _looked_up(self, one, two, size) -> np.ndarray:
        """The third number of each word's slot, 0 for a word that is not there."""
        found = np.zeros(len(one), dtype=U64)
        left, slot = np.flatnonzero(size <= _LOADS), self._place(one, two, size)
        for probe in range(PROBES):
            line = self.table[(slot[left] + probe) % SLOTS]
            hit = (line[:, 0] == one[left]) & (line[:, 1] == two[left]) & ((line[:, 2] & U64(255)) == size[left].astype(U64))
            found[left[hit]] = line[hit, 2]
            left = left[~hit & (line[:, 2] != 0)]
        return found

    def _keep(self, words: list[bytes], counts: np.ndarray, ids: np.ndarray):
        """Puts new words into the memo."""
        offsets = self._behind(ids) + np.cumsum(counts) - counts
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        loads = np.frombuffer(b"".join([w[:_LOADS].ljust(_LOADS, b"\0") for w in words]), dtype="<u8").reshape(-1, 2)
        lines = np.column_stack([loads.astype(U64), (sizes | counts << 8 | offsets << 16).astype(U64)])
        slots, left = self._place(lines[:, 0], lines[:, 1], sizes), np.flatnonzero(sizes <= _LOADS)
        for probe in [*range(PROBES), None]:
            at = (slots[left] + (probe or 0)) % SLOTS
            able = np.flatnonzero(self.table[at, 2] == 0) if probe is not None else np.arange(len(left))
            at, first = np.unique(at[able], return_index=True)
            self.table[at] = lines[left[able[first]]]
            left = np.delete(left, able[first])
        for i in np.flatnonzero((sizes > _LOADS) & (sizes <= _MEMO_LENGTH)).tolist():
            self.long[words[i]] = (int(offsets[i]), int(counts[i]))
        self.used += len(ids)

    def window(self, data: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of a window whose texts start at ``opens``: where they start, how many ids each has, and all ids.

        A window that starts inside a text starts with a cut.
        """
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.dtype)
        cuts = _cuts(data, opens)
        starts = np.insert(cuts, np.searchsorted(cuts, opens), opens)
        if not len(starts) or starts[0] > 0:
            starts = np.insert(starts, 0, 0)
        ends = np.append(starts[1:], len(data))
        is_word = np.ones(len(starts), dtype=bool)
        is_word[np.searchsorted(starts, opens)] = False
        begin, end = starts[is_word] + 1, ends[is_word]
        size = end - begin
        padded = np.concatenate([data, np.zeros(2 * _LOADS, np.uint8)])
        load = np.ndarray((len(data) + _LOADS,), "<u8", padded, 0, (1,))
        one, two = load[begin] & _MASKS[np.minimum(size, 8)], load[begin + 8] & _MASKS[np.clip(size - 8, 0, 8)]
        found = self._looked_up(one, two, size)
        raw = data.tobytes()
        missing = np.flatnonzero(found == 0)
        words = [raw[a:b] for a, b in zip(begin[missing].tolist(), end[missing].tolist())]
        new = [w for w in dict.fromkeys(words) if w not in self.long]
        if self.used > STORE_IDS:
            self._forget()
            return self.window(data, opens)
        first = [raw[a:b].decode() for a, b in zip(starts[~is_word].tolist(), ends[~is_word].tolist())]
        extra = self.raw(first)
        width, fresh = self.dtype.itemsize, {}
        if new:
            encoded = self.words([w.decode() for w in new])
            new_counts = np.array([len(b) // width for b in encoded], dtype=np.int64)
            places = (self.used + np.cumsum(new_counts) - new_counts).tolist()
            fresh = dict(zip(new, zip(places, new_counts.tolist())))
            self._keep(new, new_counts, np.frombuffer(b"".join(encoded), dtype=self.dtype))
        counts, offsets = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        word_counts, word_offsets = ((found >> U64(8)) & U64(255)).astype(np.int64), (found >> U64(16)).astype(np.int64)
        if words:
            where = np.array([fresh.get(w) or self.long[w] for w in words], dtype=np.int64)
            word_offsets[missing], word_counts[missing] = where[:, 0], where[:, 1]
        counts[is_word], offsets[is_word] = word_counts, word_offsets
        counts[~is_word] = [len(b) // width for b in extra]
        ends_of_first = np.cumsum(counts[~is_word])
        offsets[~is_word] = self._behind(np.frombuffer(b"".join(extra), dtype=self.dtype)) + ends_of_first - counts[~is_word]
        total = np.cumsum(counts)
        ids = self.store[np.repeat(offsets - total + counts, counts) + np.arange(total[-1] if len(total) else 0)]
        return starts, counts, ids

    def texts(self, raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of the rows ``at`` in ``raw``, window by window, and how many of them stand before the end of
        each row that ends in the window. A row may go through several windows."""
        n, row, low = len(at) - 1, 0, int(at[0])
        while row < n:
            high = min(low + WINDOW_BYTES, int(at[-1]))
            last = int(np.searchsorted(at, high, "right")) - 1  # rows before it end within the window
            if not self.by_word:
                last = max(last, row + 1)
                high = int(at[last])
                found = self.raw([raw[a:b].tobytes().decode() for a, b in zip(at[row:last], at[row + 1:last + 1])])
                yield np.frombuffer(b"".join(found), self.dtype), np.cumsum([len(b) // self.dtype.itemsize for b in found], dtype=np.int64)
            else:
                if last > row:
                    high = int(at[last])
                else:  # inside one long row: up to its last cut, in a window that has one
                    stop, reach = int(at[row + 1]), WINDOW_BYTES
                    while high < stop:
                        inner = _cuts(raw[low:high], np.zeros(0, np.int64))
                        if len(inner):
                            high = low + int(inner[-1])
                            break
                        reach *= 2
                        high = min(low + reach, stop)
                    last = row + (high == stop)
                opens = at[row:max(last, row + 1)] - low
                opens = np.unique(opens[(opens >= 0) & (opens < high - low)])
                starts, counts, ids = self.window(raw[low:high], opens)
                total = np.concatenate([[0], np.cumsum(counts)])
                yield ids, total[np.searchsorted(starts, at[row + 1:last + 1] - low)]
            row, low = last, high


def encoder_of(path: str) -> Encoder:
    """The encoder of a Python worker; its memo lasts from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _packed(batches: Iterator[pa.RecordBatch], path: str, end_id: int, shard_ids: int) -> Iterator[pa.RecordBatch]:
    encoder = encoder_of(path)
    end = np.array([end_id], dtype=encoder.dtype)
    keys, parts, sizes = [], [], []
    held = open_ids = 0  # ids of whole documents of this shard, and of the document under way

    def shard():
        ids = np.array([0 if k is None else k for k in keys], dtype="<i8")
        has = np.array([k is not None for k in keys], dtype="u1")
        trailer = np.array([(len(keys), held, encoder.dtype.itemsize, _MAGIC)], dtype=_TRAILER)
        packed = b"".join([*parts, ids, has, np.array(sizes, dtype="<u8"), trailer])
        parts.clear()
        ends = pa.py_buffer(np.array([0, len(packed)], dtype=np.int32))
        return pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), 1, [None, ends, pa.py_buffer(packed)])], ["shard"])

    for batch in freeing(batches):
        doc_ids, row = batch.column("doc_id").to_pylist(), 0
        for ids, ends in encoder.texts(*text_buffers(batch.column("text"))):
            done = 0
            for stop in ends.tolist():
                parts += [ids[done:stop], end]
                keys.append(doc_ids[row])
                sizes.append(open_ids + stop - done + 1)
                held, open_ids, done, row = held + sizes[-1], 0, stop, row + 1
                if held >= shard_ids:
                    yield shard()
                    keys, parts, sizes, held = [], [], [], 0
            parts.append(ids[done:])
            open_ids += len(ids) - done
    if keys:
        yield shard()


def write_shards(docs: DataFrame, out: str, tokenizer: str, end_id: int = 2, shard_ids: int = SHARD_IDS) -> None:
    """Encodes ``text`` and writes shards to ``out`` in ascending doc_id order."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    # Equal ids are told apart by text and place, so that many of them still spread over tasks.
    rows = rows.withColumns({"_same": F.xxhash64("text"), "_place": F.spark_partition_id()})
    order = ["doc_id", "_same", "_place"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    packed = rows.mapInArrow(lambda it: _packed(it, tokenizer, end_id, shard_ids), "shard binary")
    (packed.select(F.col("shard").cast("string").alias("value")).write.mode("overwrite")
     .option("maxRecordsPerFile", 1).option("compression", "none").text(out))


def _files(spark: SparkSession, out: str) -> DataFrame:
    name = F.regexp_extract("path", r"part-(\d+)-.*-c(\d+)", 1), F.regexp_extract("path", r"part-(\d+)-.*-c(\d+)", 2)
    return (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(out)
            .select(name[0].cast("long").alias("part"), name[1].cast("long").alias("piece"), "content"))


def _opened(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, doc_ids, has_id, sizes of a shard."""
    size = _TRAILER.itemsize
    end = len(content) - 1 - size  # the writer closes the record with a line feed
    trailer = np.frombuffer(content, _TRAILER, 1, end)[0]
    if trailer["magic"] != _MAGIC:
        raise ValueError("not a token shard")
    docs, ids, width = int(trailer["docs"]), int(trailer["ids"]), int(trailer["width"])
    at = ids * width
    return (np.frombuffer(content, f"<u{width}", ids), np.frombuffer(content, "<i8", docs, at),
            np.frombuffer(content, "u1", docs, at + 8 * docs), np.frombuffer(content, "<u8", docs, at + 9 * docs))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in freeing(batches):
        for i in range(batch.num_rows):
            ids, doc_id, has, sizes = _opened(batch.column("content")[i].as_buffer())
            ends = np.cumsum(sizes.astype(np.int64))
            firsts = ends - sizes.astype(np.int64)
            crc = np.array([zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(firsts.tolist(), ends.tolist())], dtype=np.int64)
            part, piece = (np.full(len(sizes), batch.column(c)[i].as_py(), dtype=np.int64) for c in ("part", "piece"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_id, mask=has == 0), *map(pa.array, (part, piece, firsts, sizes.astype(np.int64), crc))],
                ["doc_id", "part", "piece", "first", "n_tokens", "ids_crc32"])


def read_spans(spark: SparkSession, out: str) -> DataFrame:
    """One row per stored document, read from the shard files: address, size and crc32 of its ids."""
    return _files(spark, out).mapInArrow(
        _listed, f"doc_id long, {ADDRESS}, n_tokens long, ids_crc32 long")


def _slots(keys: np.ndarray, sizes: list[int], bits: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Slot of each key by the levels' bit arrays, or -1."""
    slot = np.full(len(keys), -1, dtype=np.int64)
    left, base = np.arange(len(keys)), 0
    for level, size in enumerate(sizes):
        at = base + (mix(keys[left] + U64(level * 0x9E3779B97F4A7C15 % (1 << 64))) % U64(size)).astype(np.int64)
        own = bits[at] == 1
        slot[left[own]] = ranks[at[own]]
        left, base = left[~own], base + size
    return slot


def _levels(keys: np.ndarray) -> tuple[list[int], np.ndarray]:
    sizes, arrays, left = [], [], keys
    while len(left):
        size = 2 * len(left)
        at = (mix(left + U64(len(sizes) * 0x9E3779B97F4A7C15 % (1 << 64))) % U64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        arrays.append(alone)
        left = left[~alone[at]]
    return sizes, np.concatenate(arrays).astype(np.uint8) if arrays else np.zeros(0, np.uint8)


def _ranks(bits: np.ndarray) -> np.ndarray:
    return np.cumsum(bits, dtype=np.int64) - 1


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ U64(0xA24BAED4963EE407)) >> U64(32)).astype("<u4")


def _segment(pdf: pd.DataFrame) -> pd.DataFrame:
    keys = pdf["doc_id"].to_numpy(np.int64).view(U64)
    sizes, bits = _levels(keys)
    slot = _slots(keys, sizes, bits, _ranks(bits))
    table = np.zeros(len(keys), dtype=[("mark", "<u4"), ("part", "<i8"), ("piece", "<i8"), ("first", "<i8")])
    table["mark"][slot] = _fingerprints(keys)
    for c in ("part", "piece", "first"):
        table[c][slot] = pdf[c].to_numpy(np.int64)
    return pd.DataFrame({"segment": [pdf["segment"].iloc[0]], "sizes": [sizes], "bits": [np.packbits(bits).tobytes()],
                         "slots": [table.tobytes()]})


_SLOT = np.dtype([("mark", "<u4"), ("part", "<i8"), ("piece", "<i8"), ("first", "<i8")])


def build_index(spans: DataFrame, out: str, segment_keys: int = SEGMENT) -> None:
    """Writes the perfect hash index of ``spans`` to ``out``; one row per segment of keys."""
    first = (spans.where("doc_id IS NOT NULL").groupBy("doc_id")
             .agg(F.min(F.struct("part", "piece", "first")).alias("at")).select("doc_id", "at.*"))
    segments = max(1, -(-spans.count() // segment_keys))
    (first.withColumn("segment", F.pmod(F.xxhash64("doc_id"), F.lit(segments))).groupBy("segment")
     .applyInPandas(_segment, "segment long, sizes array<long>, bits binary, slots binary")
     .withColumn("segments", F.lit(segments).cast("long")).write.mode("overwrite").parquet(out))


def _found(keys: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    if not len(index) or not len(keys):
        return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("doc_id", "part", "piece", "first")})
    line = index.iloc[0]
    sizes = [int(s) for s in line["sizes"]]
    bits = np.unpackbits(np.frombuffer(line["bits"], np.uint8), count=sum(sizes))
    table = np.frombuffer(line["slots"], _SLOT)
    wanted = keys["doc_id"].to_numpy(np.int64)
    slot = _slots(wanted.view(U64), sizes, bits, _ranks(bits))
    there = (slot >= 0) & (table["mark"][np.maximum(slot, 0)] == _fingerprints(wanted.view(U64)))
    hit = table[slot[there]]
    return pd.DataFrame({"doc_id": wanted[there], **{c: hit[c] for c in ("part", "piece", "first")}})


def lookup(keys: DataFrame, index: str) -> DataFrame:
    """Address of each distinct ``doc_id`` of ``keys`` that the index holds."""
    stored = keys.sparkSession.read.parquet(index)
    top = stored.agg(F.coalesce(F.max("segments"), F.lit(1))).first()[0]
    asked = (keys.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
             .withColumn("segment", F.pmod(F.xxhash64("doc_id"), F.lit(top))))
    return asked.groupBy("segment").cogroup(stored.groupBy("segment")).applyInPandas(_found, f"doc_id long, {ADDRESS}")


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids, _, _, sizes = _opened(batch.column("content")[i].as_buffer())
            ends = np.cumsum(sizes.astype(np.int64))
            for line in batch.column("wanted")[i].as_py():
                end = int(ends[np.searchsorted(ends, line["first"], "right")])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([line["doc_id"]], pa.int64()), pa.array([ids[line["first"]:end].astype(np.int64)])],
                    ["doc_id", "ids"])


def fetch(keys: DataFrame, out: str, index: str) -> DataFrame:
    """doc_id, ids of the documents of ``keys``: index lookup, then slices of the shards it names."""
    wanted = (lookup(keys, index).groupBy("part", "piece")
              .agg(F.collect_list(F.struct("doc_id", "first")).alias("wanted")))
    return (_files(keys.sparkSession, out).join(wanted, ["part", "piece"])
            .mapInArrow(_sliced, "doc_id long, ids array<long>"))


def with_starts(spans: DataFrame) -> DataFrame:
    """Adds ``start``: the ids of all documents before each one.

    Sums per shard, then per part: the one window without a key sees one row per part only.
    """
    pieces = spans.groupBy("part", "piece").agg(F.sum("n_tokens").alias("n"))
    parts = pieces.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (pieces.withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(base, "part")
               .select("part", "piece", (F.col("base") + F.col("inner")).alias("offset")))
    return spans.join(offsets, ["part", "piece"]).withColumn("start", F.col("offset") + F.col("first")).drop("offset")


def token_files(docs: DataFrame, out: str, tokenizer: str, end_id: int = 2, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes shards and index under ``out`` and reads them back.

    Returns doc_id, start, n_tokens, ids_crc32, and whether the index finds the document.
    """
    write_shards(docs, f"{out}/shards", tokenizer, end_id, shard_ids)
    spans = stage(read_spans(docs.sparkSession, f"{out}/shards"), "spans")
    build_index(spans, f"{out}/index")
    address = F.struct("part", "piece", "first")
    found = lookup(docs, f"{out}/index").select("doc_id", address.alias("at"))
    return (with_starts(spans).join(found, "doc_id", "left")
            .select("doc_id", "start", "n_tokens", "ids_crc32", F.coalesce(address >= F.col("at"), F.lit(False)).alias("indexed")))
