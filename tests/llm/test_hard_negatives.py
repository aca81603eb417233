import math
import random

import numpy as np
import pyarrow as pa
import pytest
from brute import hard_negatives as plain
from pyspark.sql import functions as F

from stationflow.llm import hard_negatives as hn
from stationflow.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def found(df):
    return sorted(tuple(r) for r in df.collect())


def mined(spark, rows, **options):
    return found(hn.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3), "id % 10 = 0", F.col("label"), **options))


@pytest.mark.parametrize("seed,block,anchors", [(1, 2048, 512), (2, 7, 3), (3, 30, 2)])
def test_equals_brute_force(spark, monkeypatch, seed, block, anchors):
    monkeypatch.setattr(hn, "BLOCK", block)
    monkeypatch.setattr(hn, "ANCHORS", anchors)
    r = random.Random(seed)
    # Few different components, so that scores tie; some ids repeat.
    rows = [(r.randrange(150), [r.choice([-1.0, -0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(r.choice([4, 5]))], r.randrange(3)) for _ in range(160)]
    got, want = mined(spark, rows), plain(rows, lambda i: i % 10 == 0)
    assert want and got == want


def test_hot_label_and_copies(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK", 16)
    r = random.Random(5)
    rows = [(i, [0.5, 0.5, 0.25], 1) for i in range(60)] + [(100 + i, [0.25, 0.5, 0.25], 2) for i in range(90)]
    rows += [(300 + i, [r.random(), r.random(), r.random()], 2) for i in range(60)]
    assert mined(spark, rows) == plain(rows, lambda i: i % 10 == 0)
    assert mined(spark, rows, positives=2, negatives=3, low=50, high=100) == plain(rows, lambda i: i % 10 == 0, 2, 3, 50, 100)


@pytest.mark.parametrize("block,anchors", [(4096, 8192), (9, 4), (50, 8)])
def test_lanes_lots_and_great_scores(spark, monkeypatch, block, anchors):
    for name, value in (("BLOCK", block), ("ANCHORS", anchors), ("PER_LANE", 2)):
        monkeypatch.setattr(hn, name, value)
    r = random.Random(8)
    rows = [(i, [r.uniform(-1, 1) * size for _ in range(r.choice([3, 6]))], r.choice([0, 0, 1, 2, i]))
            for i, size in zip(range(300), [1, 1, 1, 30, 2e5] * 60)]
    rows = [(i, np.float32(v).tolist(), y) for i, v, y in rows]
    got, want = mined(spark, rows), plain(rows, lambda i: i % 10 == 0)
    assert want and got == want


def test_pairs_that_count_do_not_grow_with_the_candidates(spark, monkeypatch):
    """Anchors whose positives are far: most rows of other labels score above their windows, in every block."""
    plan = hn.hard_negatives(spark.createDataFrame([(0, [1.0], 1)], SCHEMA), "id % 10 = 0", F.col("label"))._jdf.queryExecution().toString()
    assert "CartesianProduct" in plan and "explode" not in plan
    r = random.Random(2)
    vectors = [[r.randrange(200, 256), r.randrange(-20, 20)] for _ in range(500)]
    vectors[0], vectors[1] = [256, 0], [100, 0]

    def packed(rows, size):
        columns = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), columns)], ["id", "mark", "label", "v", "limits"])
        return list(hn._packed(iter([batch]), size))

    offered = packed([(i, i, int(i < 2), v, []) for i, v in enumerate(vectors)], 10)
    asked = packed([(0, 0, 1, vectors[0], [1, 0, 256 * 100, 0])], 10)[0]
    assert len(offered) == 50
    monkeypatch.setattr(hn, "CELLS", 60)
    assert [b.column("size")[0].as_py() for b in packed([(i, i, 0, v, []) for i, v in enumerate(vectors)], 100)] == [30] * 16 + [20]
    met = [pa.RecordBatch.from_arrays([*c.columns, *asked.columns], [*c.schema.names, *(f"a_{x}" for x in asked.schema.names)])
           for c in offered]
    found = pa.Table.from_batches(hn._near_pairs(iter(met), 2, 10, 30, 300))
    scores = sorted((-256 * v[0], i) for i, v in enumerate(vectors) if i > 1 and 30 * 256 <= 256 * v[0] <= 3 * 256 * 100)
    assert sorted(zip(found.column("score").to_pylist(), found.column("id").to_pylist())) == sorted((-s, i) for s, i in scores[:10])


def test_odd_rows(spark):
    rows = [(0, [0.5, None], 1), (10, None, 1), (20, [math.nan, 1.0], 1), (30, [math.inf, 1.0], 1), (None, [1.0], 1), (40, [1.0], None),
            (50, [], 1), (60, [0.5, 0.5], 1), (61, [1.0, 1.0], 1), (62, [0.25, 0.5], 2), (70, [-1.0, -1.0], 3), (71, [1.0, 1.0], 3), (80, [0.0, 0.0], 2),
            (81, [0.0], 2), (60, [0.5, 0.5], 1), (90, [3e5, -2e5], 4), (91, [2e5, 1e5], 4), (92, [1e5, 1e4], 5)]
    assert mined(spark, rows) == plain(rows, lambda i: i % 10 == 0)
    assert mined(spark, []) == []
    more = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("id", "mark", "v", "lot", "lane", "score")})
    assert found(hn.hard_negatives(more, "id % 10 = 0", F.col("label"))) == plain(rows, lambda i: i % 10 == 0)


def test_long_groups_pass_in_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        r = random.Random(9)
        rows = [(i, [r.choice([0.0, 0.5, 1.0]) for _ in range(3)], r.randrange(2)) for i in range(120)]
        assert mined(spark, rows) == plain(rows, lambda i: i % 10 == 0)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, r.label if r.vec_id is None or r.vec_id % 7 or r.label is None else (r.label + 1) % 10)
            for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = QUERIES["op12_hard_negatives"](spark, sf)
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert found(got.select(*columns)) == plain(rows, lambda i: i % 100 == 0)
