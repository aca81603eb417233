"""Near-duplicate groups by SuperMinHash signatures, banding, exact verification and union-find.

SuperMinHash (Ertl, 2017): every element walks through its own random permutation of the signature's
positions; step k offers the value k + uniform to the position reached. Steps are taken by all elements
of a document together, and a document stops as soon as each position holds a value below the next step.

One row per distinct shingle set (a class of copies) goes through banding. Within a band bucket every
member is compared with the bucket's hub, the member whose buckets are largest. Members that are still
in different components are compared in blocks, so no pair that shares a bucket and could join two
components is left out; shingles that no or few other such members have bound what a pair can share,
which rules out the heavily edited copies of a large group before any pair is formed. Links are
confirmed on the full sets. Components come from union-find
inside tasks and large-star / small-star rounds between them.

Edge cases: null or blank texts have an empty set and stand alone; rows that repeat a doc_id are one
document (links of any of its texts count); a null doc_id takes no part (component null, kept). Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (BROADCAST_ROWS, U64, bounded, chunks, drop_staged, freeing, mix, small_batches, stage,
                     stage_shuffled, text_buffers, text_or_empty, word_hashes)

BANDS, ROWS = 32, 4
SIZE = BANDS * ROWS
_FRACTION = 24
_LOW = U64((1 << _FRACTION) - 1)
_STEP = 0x9E3779B97F4A7C15
BLOCK = 256
# In buckets of more than a block, elements of up to so many members bound what two members can share.
SCARCE = 64


def shingle_sets(raw: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``width``-word shingles of each row, as sorted hashes, and the row of each.

    A row of fewer words has its whole sequence as the only shingle.
    """
    words, row = word_hashes(raw, at)
    weights = mix(np.arange(1, width + 1, dtype=U64) * U64(_STEP))
    found, rows = [], []
    n = len(words) - width + 1
    if n > 0:
        total = np.zeros(n, dtype=U64)
        for j in range(width):
            total += words[j:j + n] * weights[j]
        whole = row[:n] == row[width - 1:]
        found.append(mix(total[whole]))
        rows.append(row[:n][whole])
    counts = np.bincount(row, minlength=len(at) - 1) if len(row) else np.zeros(len(at) - 1, np.int64)
    firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    for size in range(1, width):
        short = np.flatnonzero(counts == size)
        if len(short):
            total = np.full(len(short), size * 0x632BE59BD9B4E019 % (1 << 64), dtype=U64)
            for j in range(size):
                total += words[firsts[short] + j] * weights[j]
            found.append(mix(total))
            rows.append(short)
    if not found:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    element, row = np.concatenate(found), np.concatenate(rows)
    if len(found) > 1:
        order = np.argsort(row, kind="stable")
        element, row = element[order], row[order]
    edges = np.flatnonzero(np.diff(row)) + 1
    for a, b in zip(np.concatenate([[0], edges]), np.concatenate([edges, [len(row)]])):
        element[a:b].sort()
    new = np.ones(len(row), dtype=bool)
    new[1:] = (element[1:] != element[:-1]) | (row[1:] != row[:-1])
    return element[new], row[new]


def signatures(element: np.ndarray, row: np.ndarray, n_rows: int, size: int = SIZE) -> np.ndarray:
    """SuperMinHash signatures: one line of ``size`` values (rank << 24 | fraction) per row."""
    signature = np.full(n_rows * size, np.iinfo(np.uint32).max, dtype=np.uint32)
    lines = signature.reshape(n_rows, size)
    left, owner, places = element, row, None
    for k in range(size):
        if not len(left):
            break
        x = mix(left + U64((k + 1) * _STEP % (1 << 64)))
        j = k + (((x >> U64(32)) * U64(size - k)) >> U64(32)).astype(np.int64)
        if k == 0:
            reached = j
        else:
            i = np.arange(len(left))
            reached = places[i, j].astype(np.int64)
            places[i, j] = places[:, k]
        np.minimum.at(signature, owner * size + reached, (U64(k << _FRACTION) | (x & _LOW)).astype(np.uint32))
        open_rows = np.zeros(n_rows, dtype=bool)
        live = np.unique(owner)
        open_rows[live] = lines[live].max(axis=1) >= (k + 1) << _FRACTION
        stay = open_rows[owner]
        if k == 0:
            left, owner, first = left[stay], owner[stay], reached[stay]
            places = np.tile(np.arange(size, dtype=np.uint8), (len(left), 1))
            places[np.arange(len(left)), first] = 0
        elif not stay.all():
            left, owner, places = left[stay], owner[stay], places[stay]
    return lines


def _described(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    weights = mix(np.arange(1, ROWS + 1, dtype=U64) * U64(0xD1B54A32D192ED03))
    offset = mix(np.arange(BANDS, dtype=U64) + U64(0x5851F42D4C957F2D))
    for batch in freeing(batches):
        raw, at = text_buffers(batch.column("text"))
        for a, b in chunks(at):
            n = b - a
            element, row = shingle_sets(raw, at[a:b + 1], width)
            count = np.bincount(row, minlength=n)
            starts = np.concatenate([[0], np.cumsum(count)])
            keys = []
            for salt in (0x8CB92BA72F3D8DD7, 0xABC98388FB8FAC03):
                total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(element ^ U64(salt)))])
                keys.append((total[starts[1:]] - total[starts[:-1]]).view(np.int64))
            lines = signatures(element, row, n)
            band = (lines.reshape(n, BANDS, ROWS).astype(U64) * weights).sum(axis=2) + offset
            band = mix(band).view(np.int64)
            filled = count > 0
            sizes = np.where(filled, BANDS, 0)
            bands = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(band[filled].ravel()))
            low = (lines & 0xFF).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, n), pa.array(count.astype(np.int64)), pa.array(keys[0]),
                 pa.array(keys[1]), bands, pa.array([low[i].tobytes() for i in range(n)], pa.binary())],
                ["doc_id", "n", "c1", "c2", "bands", "sketch"])


def describe(docs: DataFrame, width: int) -> DataFrame:
    """Set size, two 64-bit sums that identify the set, band keys and a one-byte-per-position sketch."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(lambda it: _described(it, width),
                           "doc_id long, n long, c1 long, c2 long, bands array<long>, sketch binary")


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in freeing(batches):
        raw, at = text_buffers(batch.column("text"))
        for a, b in chunks(at):
            element, row = shingle_sets(raw, at[a:b + 1], width)
            cut = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b - a))])
            key = np.concatenate([np.zeros(1, U64), np.cumsum(mix(element ^ U64(0x8CB92BA72F3D8DD7)))])
            key = (key[cut[1:]] - key[cut[:-1]]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, b - a), pa.array(key),
                 pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(element.view(np.int64)))],
                ["doc_id", "c1", "elements"])


def _alike(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches agree in at least ``least`` positions."""
    for batch in freeing(batches):
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SIZE)
                    for c in ("a_sketch", "b_sketch"))
            near = pa.array((a == b).sum(axis=1) >= least)
            yield batch.select(["a", "a_c1", "b", "b_c1"]).filter(near)


def _confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in freeing(batches):
        keep = []
        for x, y in zip(batch.column("a_elements"), batch.column("b_elements")):
            u, v = (z.values.to_numpy(zero_copy_only=False).view(U64) for z in (x, y))
            if len(u) > len(v):
                u, v = v, u
            place = np.minimum(np.searchsorted(v, u), max(len(v) - 1, 0))
            same = int((v[place] == u).sum()) if len(v) else 0
            keep.append(100 * same >= percent * (len(u) + len(v) - same))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _shared_scarce(left: list[list[int]], right: list[list[int]]) -> np.ndarray:
    """How many elements each member of one side shares with each of the other."""
    shared = np.zeros((len(left), len(right)), dtype=np.int64)
    holders: dict[int, list[int]] = {}
    for j, elements in enumerate(right):
        for e in elements:
            holders.setdefault(e, []).append(j)
    for i, elements in enumerate(left):
        for e in elements:
            if e in holders:
                shared[i, holders[e]] += 1
    return shared


def _block_pairs(batches: Iterator[pa.RecordBatch], least: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of two blocks of a bucket: other component, able to share enough, sketches alike.

    A pair shares the scarce elements both hold, and of the others no more than either has; elements of
    its own are left out of that. Only members with ``listed`` have all their scarce elements at hand, so a
    pair with another member is bound by what is not its own.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("a", "a_c1", "b", "b_c1")])
    for batch in freeing(batches):
        for line in batch.to_pylist():
            sides = []
            for members in (line["left"], line["right"]):
                numbers = np.array([[m["rep"], m["c1"], m["n"], m["label"], m["n"] - m["own"], len(m["scarce"]), m["listed"]] for m in members], dtype=np.int64)
                sides.append((numbers, np.frombuffer(b"".join(m["sketch"] for m in members), np.uint8).reshape(-1, SIZE)))
            (p, ps), (q, qs) = sides
            other = p[:, None, 3] != q[None, :, 3]
            shared = np.minimum(p[:, None, 4], q[None, :, 4])
            fewer = np.minimum(p[:, None, 4] - p[:, None, 5], q[None, :, 4] - q[None, :, 5])
            fewer += _shared_scarce([m["scarce"] for m in line["left"]], [m["scarce"] for m in line["right"]])
            shared = np.where((p[:, None, 6] & q[None, :, 6]) == 1, fewer, shared)
            other &= 100 * shared >= percent * (p[:, None, 2] + q[None, :, 2] - shared)
            if line["same"]:
                other &= np.triu(np.ones(other.shape, dtype=bool), 1)
            i, j = np.nonzero(other)
            for s in range(0, len(i), 1 << 16):
                x, y = i[s:s + (1 << 16)], j[s:s + (1 << 16)]
                near = (ps[x] == qs[y]).sum(axis=1) >= least
                x, y = x[near], y[near]
                if len(x):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(p[x, 0]), pa.array(p[x, 1]), pa.array(q[y, 0]), pa.array(q[y, 1])], schema=schema)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of one batch: each node with the smallest node it reaches."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        found = [(x, root(x)) for x in list(parent)]
        found = [(x, r) for x, r in found if x != r]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in found], pa.int64()), pa.array([r for _, r in found], pa.int64())], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): node, root (the smallest node of its component).

    Tasks first shrink their links to a forest; then large-star and small-star rounds (Kiveris et al.,
    2014) run until the links no longer change. Each round is a written table.
    """
    edges = stage(links.where("a <> b").select("a", "b").mapInArrow(_forest, "a long, b long"), "links")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        hooked = large.join(small_least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = stage_shuffled(hooked.unionByName(small_least.select("a", F.col("m").alias("b"))).distinct(), "links")
        total = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_staged(edges)
        edges = after
        if total == mark or total[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = total


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest linked doc_id), kept: one row per input row.

    Documents are linked when ``100 * |A and B| >= percent * |A or B|`` over their shingle sets. At the
    default banding a pair at 0.8 is missed with a probability of 5e-8; the sketch filter keeps pairs
    down to five standard deviations below the threshold.
    """
    small_batches(docs.sparkSession)
    least = max(0, int(SIZE * (percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / SIZE) ** 0.5)))
    described = stage(describe(docs, width), "described")
    # Copies: one line per distinct set; a set's bands and sketch are the same in all its documents.
    reps = stage_shuffled(described.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "c1", "c2").agg(
        F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "reps")

    rows = reps.select("rep", "c1", "n", F.explode("bands").alias("bucket"))
    crowded = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = stage_shuffled(rows.join(crowded, "bucket"), "members")
    fame = members.groupBy("rep", "c1").agg(F.sum("members").alias("fame"))
    placed = members.join(fame, ["rep", "c1"])
    hubs = placed.groupBy("bucket").agg(F.min(F.struct(-F.col("fame"), F.col("rep"), F.col("c1"), F.col("n"))).alias("hub"))
    fits = 100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n")
    stars = (members.join(hubs, "bucket").where(((F.col("rep") != F.col("hub.rep")) | (F.col("c1") != F.col("hub.c1"))) & fits)
             .select(F.col("rep").alias("a"), F.col("c1").alias("a_c1"), F.col("hub.rep").alias("b"),
                     F.col("hub.c1").alias("b_c1")).distinct())
    sketches = reps.select("rep", "c1", "sketch")
    for side in "ab":
        stars = stars.join(sketches.select(F.col("rep").alias(side), F.col("c1").alias(f"{side}_c1"),
                                           F.col("sketch").alias(f"{side}_sketch")), [side, f"{side}_c1"])
    stars = stage_shuffled(stars.mapInArrow(lambda it: _alike(it, least), "a long, a_c1 long, b long, b_c1 long"), "stars")

    def sets_of(wanted: DataFrame) -> DataFrame:
        wanted = stage_shuffled(wanted.distinct(), "wanted")
        texts = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
                 .join(bounded(wanted, wanted.count(), BROADCAST_ROWS), "doc_id", "left_semi"))
        found = texts.mapInArrow(lambda it: _sets(it, width), "doc_id long, c1 long, elements array<long>")
        return stage_shuffled(found.dropDuplicates(["doc_id", "c1"]), "sets")

    def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        for side in "ab":
            pairs = pairs.join(sets.select(F.col("doc_id").alias(side), F.col("c1").alias(f"{side}_c1"),
                                           F.col("elements").alias(f"{side}_elements")), [side, f"{side}_c1"])
        return stage_shuffled(pairs.mapInArrow(lambda it: _confirmed(it, percent), "a long, b long"), "confirmed")

    # A doc_id whose rows hold different texts joins the classes of all of them.
    several = described.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min("c1").alias("x"), F.max("c1").alias("y")).where("x <> y").select("doc_id")
    class_rep = reps.select("n", "c1", "c2", "rep")
    same_id = (described.join(several, "doc_id", "left_semi").join(class_rep, ["n", "c1", "c2"])
               .select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b"))
    star_sets = sets_of(stars.select(F.explode(F.array("a", "b")).alias("doc_id")))
    links = stage_shuffled(confirm(stars, star_sets).unionByName(same_id), "found")
    drop_staged(star_sets)
    roots = components(links)

    # Members of buckets that are still apart: how many of their shingles no other of them has, and in
    # crowded buckets which ones few others have.
    labelled = (members.where("members > 2").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
                .withColumn("label", F.coalesce("root", "rep")).drop("root"))

    def still_apart(rows: DataFrame) -> DataFrame:
        several = (rows.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size"))
                   .where("low <> high").select("bucket", "size"))
        return rows.join(several, "bucket")

    apart = stage_shuffled(still_apart(labelled), "apart")
    place = ["rep", "c1"]
    widest = apart.groupBy(*place).agg(F.max("size").alias("widest"))
    rest_sets = sets_of(widest.select(F.col("rep").alias("doc_id")))
    elements = (rest_sets.select(F.col("doc_id").alias("rep"), "c1", "elements").join(widest, place)
                .select(*place, "widest", F.explode("elements").alias("element")))
    scarce = elements.groupBy("element").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") <= SCARCE)
    crowd = F.col("widest") > BLOCK
    in_crowd = (F.col("k") > 1) & crowd
    known = elements.join(scarce, "element").groupBy(*place).agg(
        F.count_if(F.col("k") == 1).alias("own"), F.array_sort(F.collect_list(F.when(in_crowd, F.col("element")))).alias("scarce"))
    able = (apart.drop("size").join(widest.select(*place, crowd.alias("listed")), place).join(known, place, "left")
            .withColumns({"own": F.coalesce("own", F.lit(0)), "scarce": F.coalesce("scarce", F.expr("CAST(array() AS array<long>)"))})
            .where(100 * (F.col("n") - F.col("own")) >= percent * F.col("n")))
    blocks = (still_apart(able).join(sketches, place)
              .groupBy("bucket", F.pmod(F.xxhash64(*place), F.ceil(F.col("size") / BLOCK)).alias("block"))
              .agg(F.collect_list(F.struct("rep", "c1", "n", "own", "label", "scarce", "listed", "sketch")).alias("list")))
    blocks = stage_shuffled(blocks, "blocks")
    left, right = (blocks.select("bucket", F.col("block").alias(f"{s}_block"), F.col("list").alias(s)) for s in ("left", "right"))
    meetings = left.join(right, "bucket").where("left_block <= right_block").select(
        "left", "right", (F.col("left_block") == F.col("right_block")).alias("same"))
    rest = (meetings.mapInArrow(lambda it: _block_pairs(it, least, percent), "a long, a_c1 long, b long, b_c1 long")
            .distinct())
    tried = stars.select("a", "a_c1", "b", "b_c1")
    tried = tried.unionByName(tried.select(F.col("b").alias("a"), F.col("b_c1").alias("a_c1"), F.col("a").alias("b"),
                                           F.col("a_c1").alias("b_c1")))
    rest = stage_shuffled(rest.join(tried, ["a", "a_c1", "b", "b_c1"], "left_anti"), "rest")
    if rest.take(1):
        roots = components(links.unionByName(confirm(rest, rest_sets)))
    drop_staged(rest_sets)

    in_class = (described.select("doc_id", F.col("n").alias("n_shingles"), "n", "c1", "c2")
                .join(class_rep.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
                      .withColumn("component", F.coalesce("root", "rep")).drop("root", "rep"), ["n", "c1", "c2"], "left"))
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return in_class.select("doc_id", "n_shingles", found.alias("component_id"),
                           F.coalesce(F.col("doc_id") == found, F.lit(True)).alias("kept"))
