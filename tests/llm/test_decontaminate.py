import hashlib
import random

import pytest

from brute import overlaps
from stationflow.llm import decontaminate as d
from stationflow.llm.queries import QUERIES

DOCS = "doc_id long, text string, items string, word string, pos long"


def docs_frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], DOCS).repartition(3)


def items_frame(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def plain(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated) for r in df.collect()), key=repr)


def test_words_follow_the_class(spark):
    texts = ["", None, "...", "A-b c", " é Ü ÀB", "x", "1a\x002", "Σ İ Ab", "日本 go"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(d.words_of(d.F.col("t")).alias("w")).collect()
    assert [r.w for r in got] == [[], [], [], ["a", "b", "c"], ["é", "Ü", "Àb"], ["x"], ["1a", "2"], ["Σ", "İ", "ab"], ["日本", "go"]]


@pytest.mark.parametrize("limit", [d.BROADCAST_WINDOWS, 0])
def test_hits_equal_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(d, "BROADCAST_WINDOWS", limit)
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 2)
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 12, 13, 14, 30])))) for i in range(40)]
    items += [(90, "a a a a a a a a a a a a a a a"), (91, None), (92, "!!"), (None, "a b"), (93, items[0][1]), (10, "zz top")]
    rows = []
    for i in range(150):
        words = [word() for _ in range(rng.choice([0, 2, 15, 300]))]
        for _ in range(rng.randint(0, 3)):
            text = rng.choice(items)[1]
            words[rng.randint(0, len(words)):0] = (text or "").split()
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(words)))
    rows += [(500, "a " * 5000), (501, None), (502, "Zz-TOP"), (502, "Zz-TOP"), (502, "other"), (None, "zz top")]
    got = d.contamination(docs_frame(spark, rows), items_frame(spark, items))
    assert plain(got) == overlaps(rows, items)


def test_empty_tables(spark):
    items = items_frame(spark, [(1, "a b c")])
    assert d.contamination(docs_frame(spark, []), items).count() == 0
    assert plain(d.contamination(docs_frame(spark, [(1, "a b c")]), items.limit(0))) == [(1, 3, 0, "", False)]


def test_no_python_on_the_path(spark):
    plan = d.contamination(docs_frame(spark, [(1, "a b c")]), items_frame(spark, [(1, "a b c")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, sf):
    path = f"/root/testdata/{sf}"
    read = lambda t, k: [(r[k], r.text) for r in spark.read.parquet(f"{path}/{t}.parquet").collect()]
    want = [(i, w, h, len(s.split(",")) if s else 0, hashlib.sha256(s.encode()).hexdigest(), c)
            for i, w, h, s, c in overlaps(read("documents", "doc_id"), read("benchmark", "item_id"))]
    got = QUERIES["op3_decontaminate"](spark, path).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert any(r.contaminated for r in got)


def test_long_text_against_a_large_benchmark(spark, monkeypatch):
    """The shuffled join on one text of 200,000 words among copies and short ones."""
    monkeypatch.setattr(d, "BROADCAST_WINDOWS", 0)
    rng = random.Random(5)
    words = [f"w{rng.randrange(3000)}" for _ in range(200_000)]
    items = [(i, " ".join(words[i * 900:i * 900 + 20])) for i in range(200)] + [(900, "nowhere to be found in any of these texts at all or so they say")]
    rows = [(1, " ".join(words)), (2, " ".join(words[:400])), (2, " ".join(words[:400])), (3, None), (None, "w1 w2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = d.digests(d.contamination(docs, spark.createDataFrame(items, "item_id long, text string")))
    want = [(i, n, hit, hashlib.sha256(ids.encode()).hexdigest(), bad) for i, n, hit, ids, bad in overlaps(rows, items)]
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.items_sha256, r.contaminated) for r in got.collect()), key=repr) == sorted(want, key=repr)
