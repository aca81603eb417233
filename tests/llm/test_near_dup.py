import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import near_groups, shingles
from stationflow.llm import near_dup
from stationflow.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, component_id string, n long"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "en", "x", 0) for i, t in rows], SCHEMA).repartition(parts)


def answer(df):
    return {r.doc_id: r.component_id for r in df.collect()}


def test_shingle_sets_match_plain_sets():
    texts = ["", "One", "one TWO", "a b c d", "a b c d e a b c d", "\tÄ ä\n x  y\x0bz ", "a b c", "same same same same same"]
    data = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    element, row = near_dup.shingle_sets(np.frombuffer(b"".join(data), np.uint8), at, 4)
    assert np.bincount(row, minlength=len(texts)).tolist() == [len(shingles(t, 4)) for t in texts]
    alone = near_dup.shingle_sets(np.frombuffer(data[3], np.uint8), np.array([0, len(data[3])]), 4)[0]
    assert alone[0] in element[row == 4]


def test_signature_estimates_similarity():
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(60):
        common, own = rng.integers(0, 1 << 63, 240, dtype=np.uint64), rng.integers(0, 1 << 63, 60, dtype=np.uint64)
        a, b = np.concatenate([common, own[:30]]), np.concatenate([common, own[30:]])
        lines = near_dup.signatures(np.concatenate([a, b]), np.repeat([0, 1], [270, 270]), 2)
        errors.append((lines[0] == lines[1]).mean() - 0.8)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.04
    tiny = near_dup.signatures(np.array([7], np.uint64), np.array([0]), 1)
    assert sorted(tiny[0] >> 24) == list(range(near_dup.SIZE))


def test_groups_equal_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for base in range(25):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 12, 60, 200]))]
        for _ in range(rng.choice([1, 2, 9, 40])):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(copy) // 30))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((n, " ".join(copy)))
            n += 1
    rows += [(n, ""), (n + 1, None), (n + 2, "  \n"), (n + 3, rows[0][1].upper()), (n + 4, "long " + "x" * 50_000)]
    rng.shuffle(rows)
    want, sizes = near_groups(rows, 4, 80)
    got = near_dup.near_duplicates(frame(spark, rows), 4, 80).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_blocks_compare_members_that_the_hub_misses(spark, monkeypatch):
    """A chain of texts, each alike only to its neighbours, in one bucket with a hub that reaches few."""
    monkeypatch.setattr(near_dup, "BLOCK", 2)
    words = [f"w{i}" for i in range(400)]
    rows = [(100 - k, " ".join(words[5 * k:5 * k + 100])) for k in range(40)]
    want, _ = near_groups(rows, 4, 80)
    assert answer(near_dup.near_duplicates(frame(spark, rows), 4, 80)) == want


def test_repeated_ids_null_ids_and_no_rows(spark):
    a, b = "a b c d e f g h", "k l m n o p q r"
    rows = [(5, a), (9, a), (9, b), (12, b), (12, b), (None, a), (3, None)]
    got = near_dup.near_duplicates(frame(spark, rows), 4).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id is not None) == [
        (3, 3, True), (5, 5, True), (9, 5, False), (9, 5, False), (12, 5, False), (12, 5, False)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert near_dup.near_duplicates(frame(spark, [])).count() == 0


def test_union_find_rounds(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7, 7)]
    rng.shuffle(links)
    df = spark.createDataFrame(links, "a long, b long").repartition(7)
    got = {r.node: r.root for r in near_dup.components(df).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, **{1000 + i: 1000 for i in range(1, 200)}}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, sf):
    path = f"/root/testdata/{sf}"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    want, sizes = near_groups(docs, 4, 80)
    got = QUERIES["op10_near_dup"](spark, path).collect()
    assert {r.doc_id: (r.component_id, r.n_shingles) for r in got} == {i: (want[i], sizes[i]) for i in want}


def test_pairs_of_members_in_and_out_of_crowded_buckets(spark, monkeypatch):
    """Only one of two alike texts is in a crowded bucket; they share a small one, whose hub is like neither."""
    def text(k):
        return [f"w{k}_{i}" for i in range(100)]

    alike = text(1)
    rows = [(1, alike), (2, [*alike[:98], "other", "end"])] + [(k, text(k)) for k in range(3, 40)]
    rows = [(i, " ".join(words)) for i, words in rows]
    # The hub of bucket 100 is text 3, through bucket 200; bucket 300 is crowded.
    bands = {1: [100, 300], 2: [100], 3: [100, 200], **{k: [200] for k in range(4, 30)}, **{k: [300] for k in range(30, 40)}}
    real = near_dup.describe
    table = F.create_map(*[c for k, v in bands.items() for c in (F.lit(k), F.array(*[F.lit(x).cast("long") for x in v]))])
    monkeypatch.setattr(near_dup, "describe", lambda docs, width: real(docs, width).withColumn("bands", F.try_element_at(table, F.col("doc_id").cast("int"))))
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    want, _ = near_groups(rows, 4, 80)
    assert want[2] == 1 and answer(near_dup.near_duplicates(frame(spark, rows), 4, 80)) == want
