"""Toxicity classifier with a counterfactual penalty.

Features are the words of a text (runs of letters and digits, A-Z lower-cased) and their first four to
eight bytes, as 64-bit hashes, present or not, so that a stem is learnt with all its endings. A logistic
model with few weights (lasso) is trained on a bounded sample of labelled texts. Sentences that name a group are
copied with the name swapped for another one, and the squared change of their score is part of the loss. Names so
lose weights that only reflect how often they stand in insulting sentences of the sample, which lowers false
positives on neutral mentions. Groups are listed identity terms, and words that the clean texts of the sample use
in the same slot (between the same two words) in whatever language: a corpus need not hold any listed term.

Edge cases: null, empty and wordless texts get the model's base score; rows with a null doc_id are scored
and never train; labels that are null or repeated count once per doc_id (toxic if any row says so). With
no labelled rows of either class the score is the share of toxic labels, or 0 without labels. Extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (U64, chunks, freeing, hashed_runs, remainder_of_id, small_batches, stage, stage_shuffled, text_buffers,
                     text_or_empty)

# Groups whose members may stand for one another. A parameter of ``train``; common English terms.
IDENTITY_GROUPS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("female", "male"),
    ("black", "white", "asian", "latino"), ("christian", "muslim", "jewish", "hindu", "atheist"),
    ("christians", "muslims", "jews", "hindus", "atheists"), ("gay", "straight", "lesbian"),
    ("transgender", "cisgender"), ("immigrants", "citizens"), ("old", "young"), ("disabled", "healthy"),
)
_NOT_LETTER = np.ones(256, dtype=bool)
_NOT_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
PREFIXES = (4, 5, 6, 7, 8)
# Swapped sentences held at once by a task that takes samples.
SWAPS = 1 << 12
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"\w+")


def features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes and the row of each, with repetitions."""
    found = hashed_runs(raw, at, _NOT_LETTER, PREFIXES)
    return np.concatenate([f for f, _ in found]), np.concatenate([r for _, r in found])


def features_of(texts: list[str]) -> list[np.ndarray]:
    """Distinct feature hashes of each text."""
    raw, at = text_buffers(pa.array(texts, pa.large_string()))
    out = []
    for a, b in chunks(at):
        f, r = features(raw, at[a:b + 1])
        order = np.argsort(r, kind="stable")
        cut = np.searchsorted(r[order], np.arange(b - a + 1))
        out += [np.unique(f[order][cut[i]:cut[i + 1]]) for i in range(b - a)]
    return out


def swapped(text: str, groups=IDENTITY_GROUPS, copies: int | None = None) -> list[tuple[str, str]]:
    """Sentences that name a group, each with its copies that name the other members instead: all, or ``copies``."""
    other = groups if isinstance(groups, dict) else others_of(groups)
    pairs = []
    for sentence in _SENTENCE.findall(text):
        names = {w for w in map(str.lower, _WORD.findall(sentence)) if w in other}
        most = max((len(other[n]) for n in names), default=0)
        for k in range(most if copies is None else min(most, copies)):
            pairs.append((sentence, _WORD.sub(lambda m: other[w][k % len(other[w])] if (w := m[0].lower()) in names else m[0], sentence)))
    return pairs


def others_of(groups) -> dict[str, list[str]]:
    """The other members of each member's group, from the one behind it on."""
    return {t: [*g[i + 1:], *g[:i]] for g in groups for i, t in enumerate(g)}


def similar_words(rows: DataFrame, size: int = 100, members: int = 4, least: int = 3) -> list[tuple[str, ...]]:
    """Groups of words that ``least`` clean texts or more of a bounded sample use in the same slot.

    At most ``size`` groups of ``members`` words; the slots with the most texts come first, and a word is in
    one group only.
    """
    sentences = rows.where("label = 0").select(F.xxhash64("text").alias("id"), F.explode(F.split(F.lower("text"), r"[.!?\n]+")).alias("sentence"))
    words = sentences.select("id", F.filter(F.split("sentence", r"[^\p{L}\p{N}_]+"), lambda w: w != "").alias("words"))
    slots = words.select("id", "words", F.posexplode("words").alias("at", "word")).select(
        "id", "word", F.get("words", F.col("at") - 1).alias("left"), F.get("words", F.col("at") + 1).alias("right"))
    held = (slots.where("left IS NOT NULL AND right IS NOT NULL").groupBy("left", "right", "word")
            .agg(F.count_distinct("id").alias("n")).where(F.col("n") >= least))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "word"))), 1, members)["word"]
    found = held.groupBy("left", "right").agg(best.alias("words"), F.sum("n").alias("n")).where(F.size("words") > 1)
    groups, used = [], set()
    for row in found.orderBy(F.desc("n"), "left", "right").limit(20 * size).collect():
        group = tuple(w for w in row.words if w not in used)
        if len(group) > 1 and len(groups) < size:
            groups.append(group)
            used.update(group)
    return groups


@dataclass
class Model:
    """Sorted feature hashes with weights, and the bias; how many swapped sentences the fit saw, and the mean squared
    change of their score (before the logistic function)."""

    bias: float
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    pairs: int = 0
    change: float = 0.0

    def sums(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Sum of the weights of each row's distinct features, without the bias."""
        f, r = features(raw, at)
        n = len(at) - 1
        if not len(self.keys) or not len(f):
            return np.zeros(n)
        likely = np.zeros(1 << 16, dtype=bool)
        likely[(self.keys >> U64(48)).astype(np.int64)] = True
        hit = likely[(f >> U64(48)).astype(np.int64)]
        f, r = f[hit], r[hit]
        place = np.minimum(np.searchsorted(self.keys, f), len(self.keys) - 1)
        known = self.keys[place] == f
        pairs = np.unique(r[known] * len(self.keys) + place[known])
        return np.bincount(pairs // len(self.keys), self.weights[pairs % len(self.keys)], minlength=n)

    def score(self, texts: list[str]) -> np.ndarray:
        raw, at = text_buffers(pa.array(texts, pa.large_string()))
        parts = [self.sums(raw, at[a:b + 1]) for a, b in chunks(at)]
        return _sigmoid(np.concatenate([*parts, np.zeros(0)]) + self.bias)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled texts, half of each class if there are enough, in a hashed order.

    Rows whose crc32(doc_id) leaves 1 modulo 3 are kept out. Equal texts of a label count once and are left
    out before the limit, so that a group of copies does not outvote the rest. Of a doc_id's texts one counts.
    """
    marks = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("label"))
             .where(remainder_of_id() != 1))
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("hash", F.xxhash64("text"))
    order = F.xxhash64("doc_id", F.lit("sample"))
    # Ids and hashes only; of equal texts the first in the hashed order stands for all.
    labelled = rows.select("doc_id", "hash").join(marks, "doc_id").groupBy("doc_id", "label").agg(F.min("hash").alias("hash"))
    once = stage_shuffled(labelled.groupBy("label", "hash").agg(F.min_by("doc_id", order).alias("doc_id")), "labelled")
    half = max_rows // 2
    chosen = (once.where("label = 1").orderBy(order, "doc_id").limit(half)
              .unionByName(once.where("label = 0").orderBy(order, "doc_id").limit(half)))
    # Bounded by max_rows, so the broadcast is.
    return rows.join(F.broadcast(chosen), ["doc_id", "hash"]).groupBy("doc_id", "label").agg(F.min("text").alias("text"))


_SAMPLE = "label int, features array<long>, lost array<long>, gained array<long>, pairs long"


def _sample(batches: Iterator[pa.RecordBatch], groups, more) -> Iterator[pa.RecordBatch]:
    """Feature hashes of each text; and which features swaps take away and bring in, with the number of such swaps."""
    listed, similar = others_of(groups), others_of(more)
    kinds = [pa.int32(), *[pa.list_(pa.int64())] * 3, pa.int64()]

    def rows(*columns):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["label", "features", "lost", "gained", "pairs"])

    def swaps(texts):
        for t in texts:
            yield from swapped(t, listed)
            yield from swapped(t, similar, copies=1)

    for batch in freeing(batches):
        for a, b in chunks(text_buffers(batch.column("text"))[1]):
            texts = [t or "" for t in batch.column("text").slice(a, b - a).to_pylist()]
            none = [None] * len(texts)
            yield rows(batch.column("label").slice(a, b - a).to_pylist(), [f.view(np.int64) for f in features_of(texts)], none, none, none)
            # A few swaps at a time, counted apart: Spark adds up the counts of equal changes.
            pairs = swaps(texts)
            while some := list(islice(pairs, SWAPS)):
                changes: Counter = Counter()
                for x, y in zip(*(features_of([p[k] for p in some]) for k in (0, 1))):
                    x, y = set(x.view(np.int64).tolist()), set(y.view(np.int64).tolist())
                    changes[tuple(sorted(x - y)), tuple(sorted(y - x))] += 1
                none = [None] * len(changes)
                yield rows(none, none, [k[0] for k in changes], [k[1] for k in changes], list(changes.values()))


def _known(batches: Iterator[pa.RecordBatch], keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The sample's rows with the features among the sorted ``keys`` only."""
    def among(column):
        if not len(keys):
            return pa.array([None if v is None else [] for v in column.to_pylist()], column.type)
        flat, at = column.values.to_numpy(zero_copy_only=False).view(U64), column.offsets.to_numpy()
        hit = keys[np.minimum(np.searchsorted(keys, flat), len(keys) - 1)] == flat if len(flat) else np.zeros(0, bool)
        upto = np.concatenate([[0], np.cumsum(hit)])[at]
        offsets = pa.array(upto.astype(np.int32), mask=np.append(column.is_null().to_numpy(zero_copy_only=False), False))
        return pa.ListArray.from_arrays(offsets, pa.array(flat[hit].view(np.int64)))

    for batch in freeing(batches):
        columns = [among(batch.column(c)) if c in ("features", "lost", "gained") else batch.column(c) for c in batch.schema.names]
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names)


def vocabulary(sample: DataFrame, size: int = 3000, least: int = 3) -> np.ndarray:
    """The features of a sample (label, features) that tell the classes apart best, counted by Spark; sorted."""
    n, p = sample.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or p in (0, n):
        return np.zeros(0, U64)
    counted = sample.select("label", F.explode("features").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("all"), F.sum("label").alias("toxic"))
    share = F.col("all") / n
    rate = F.abs(F.col("toxic") / p - (F.col("all") - F.col("toxic")) / (n - p))
    strength = rate / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) * (1 / p + 1 / (n - p)))
    best = counted.where(F.col("all") >= least).select("key", strength.alias("strength")).where("strength > 2")
    found = best.orderBy(F.desc("strength"), "key").limit(size).select("key").toArrow()["key"].to_numpy()
    return np.sort(found.astype(np.int64).view(U64))


def _vocabulary(texts: list[np.ndarray], label: np.ndarray, size: int, least: int) -> np.ndarray:
    """The ``size`` features that tell the classes apart best, among those of ``least`` texts or more."""
    keys, where = np.unique(np.concatenate(texts), return_inverse=True)
    cut = np.repeat(label, [len(t) for t in texts])
    toxic, all_ = np.bincount(where, cut, minlength=len(keys)), np.bincount(where, minlength=len(keys))
    n, p = len(label), max(label.sum(), 1)
    rate = np.abs(toxic / p - (all_ - toxic) / max(n - p, 1))
    spread = np.sqrt(np.maximum(all_ / n * (1 - all_ / n), 1e-9) * (1 / p + 1 / max(n - p, 1)))
    strength = np.where(all_ >= least, rate / spread, 0)
    order = np.lexsort((keys, -strength))[:size]
    return np.sort(keys[order[strength[order] > 2]])


def _lines(sets: list[np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each known feature."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    f = np.concatenate([*sets, np.zeros(0, U64)])
    place = np.minimum(np.searchsorted(keys, f), max(len(keys) - 1, 0))
    known = keys[place] == f if len(keys) else np.zeros(len(f), bool)
    return row[known], place[known]


def fit(texts: list[np.ndarray], label: np.ndarray, before: list[np.ndarray], after: list[np.ndarray],
        times: np.ndarray | None = None, keys: np.ndarray | None = None, size: int = 3000, least: int = 3, penalty: float = 1.0, lasso: float = 1e-4, ridge: float = 1e-5,
        rounds: int = 600) -> Model:
    """Logistic loss with weighted classes + lasso + ``penalty`` * mean squared score change of swapped sentences.

    ``before`` and ``after`` are features of swapped sentences, each pair standing for ``times`` of them.
    """
    p = float(label.mean()) if len(label) else 0.0
    if p in (0.0, 1.0):
        return Model(float(np.log((p + 1e-6) / (1 - p + 1e-6))))
    keys = _vocabulary(texts, label, size, least) if keys is None else keys
    if not len(keys):
        return Model(float(np.log(p / (1 - p))))
    row, col = _lines(texts, keys)
    b_row, b_col = _lines(before, keys)
    a_row, a_col = _lines(after, keys)
    share = np.where(label == 1, 0.5 / label.sum(), 0.5 / (1 - label).sum())
    times = np.ones(len(before)) if times is None else times
    n, m, swaps = len(label), len(keys), max(times.sum(), 1)
    w, bias = np.zeros(m), 0.0
    first, second = np.zeros(m + 1), np.zeros(m + 1)
    for step in range(1, rounds + 1):  # Adam on the full sample, with the lasso as a soft threshold
        score = _sigmoid(np.bincount(row, w[col], minlength=n) + bias)
        error = (score - label) * share
        change = np.bincount(b_row, w[b_col], minlength=len(before)) - np.bincount(a_row, w[a_col], minlength=len(after))
        pull = 2 * penalty * change * times / swaps
        slope = np.bincount(col, error[row], minlength=m) + ridge * w
        slope += np.bincount(b_col, pull[b_row], minlength=m) - np.bincount(a_col, pull[a_row], minlength=m)
        slope = np.append(slope, error.sum())
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope ** 2
        pace = 0.05 / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
        move = pace * first / (1 - 0.9 ** step)
        w, bias = w - move[:-1], bias - move[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - pace[:-1] * lasso, 0)
    keep = np.abs(w) > 1e-3
    w = np.where(keep, w, 0)
    change = np.bincount(b_row, w[b_col], minlength=len(before)) - np.bincount(a_row, w[a_col], minlength=len(after))
    return Model(float(bias), keys[keep], w[keep], int(times.sum()), float((times * change ** 2).sum() / swaps))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, groups=IDENTITY_GROUPS, penalty: float = 1.0, similar: int = 100) -> Model:
    """Fits on at most ``max_rows`` labelled texts. Spark counts their features; only those of the vocabulary are
    gathered at the driver.

    To ``groups`` come up to ``similar`` groups of words that the sample's clean texts use alike.
    """
    small_batches(docs.sparkSession)
    rows = stage_shuffled(training_rows(docs, labels, max_rows).select("label", "text"), "toxicity_sample")
    listed = {t for g in groups for t in g}
    more = [g for g in (tuple(w for w in g if w not in listed) for g in similar_words(rows, similar)) if len(g) > 1] if similar else []
    found = stage(rows.mapInArrow(lambda it: _sample(it, groups, more), _SAMPLE), "toxicity_features")
    keys = vocabulary(found.where("pairs IS NULL"))
    known = found.mapInArrow(lambda it: _known(it, keys), _SAMPLE)
    sample = known.where("pairs IS NULL").select("label", "features").toArrow()
    changes = known.where("pairs IS NOT NULL").groupBy("lost", "gained").agg(F.sum("pairs").alias("pairs")).orderBy("lost", "gained").toArrow()

    def hashes(column):
        return [np.asarray(v.values.to_numpy(zero_copy_only=False), np.int64).view(U64) for v in column if v.values is not None]

    texts = hashes(sample["features"])
    label = sample["label"].to_numpy().astype(float)
    order = np.lexsort((np.array([t.sum() if len(t) else 0 for t in texts], U64), label)) if texts else []
    before, after = hashes(changes["lost"]), hashes(changes["gained"])
    return fit([texts[i] for i in order], label[order] if len(order) else label, before, after,
               changes["pairs"].to_numpy().astype(float), keys, penalty=penalty)


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in freeing(batches):
        raw, at = text_buffers(batch.column("text"))
        sums = np.concatenate([*[model.sums(raw, at[a:b + 1]) for a, b in chunks(at)], np.zeros(0)])
        columns = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(_sigmoid(sums + model.bias))],
                                         [*columns, "score"])


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    scored = rows.mapInArrow(lambda it: _scored(it, model), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(remainder_of_id() == 1, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows whose score stays below ``threshold``, with all their columns. Only texts pass through Python."""
    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in freeing(texts):
            raw, at = text_buffers(column)
            yield pa.array(_sigmoid(np.concatenate([*[model.sums(raw, at[a:b + 1]) for a, b in chunks(at)], np.zeros(0)]) + model.bias))

    small_batches(docs.sparkSession)
    return docs.where(scored(text_or_empty()) < threshold)
