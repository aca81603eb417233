import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from stationflow.llm import quality, toxicity
from stationflow.llm.queries import QUERIES

DOCS = "doc_id long, text string, score string, label string, features long"
LABELS = "doc_id long, quality int, toxic int, text string"


def frames(spark, docs, labels):
    return (spark.createDataFrame([(i, t, "x", "y", 0) for i, t in docs], DOCS).repartition(3),
            spark.createDataFrame([(i, q, t, "z") for i, q, t in labels], LABELS))


def held_out_accuracy(spark, name, column, sf="sf0.1"):
    path = f"/root/testdata/{sf}"
    truth = {r.doc_id: r[column] for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    rows = QUERIES[name](spark, path).collect()
    assert len(rows) == spark.read.parquet(f"{path}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    return {k: np.mean([r.predicted == k for r in held if truth[r.doc_id] == k]) for k in (0, 1)}


def test_quality_on_held_out_rows(spark):
    found = held_out_accuracy(spark, "op2_quality", "quality")
    assert found[0] > 0.95 and found[1] > 0.97, found


def test_toxicity_on_held_out_rows(spark):
    found = held_out_accuracy(spark, "op7_toxicity", "toxic")  # few labels, of which some are wrong
    assert found[0] > 0.99 and found[1] > 0.85, found


def test_rules_are_paths_of_the_trees():
    text = """RandomForestClassificationModel: numTrees=2
  Tree 0 (weight 1.0):
    If (feature 0 <= 0.5)
     If (feature 1 <= -2.0E-4)
      Predict: 0.0
     Else (feature 1 > -2.0E-4)
      Predict: 1.0
    Else (feature 0 > 0.5)
     Predict: 1.0
  Tree 1 (weight 1.0):
    Predict: 1.0"""
    a, b = ("a", "<=", 0.5), ("a", ">", 0.5)
    assert quality.rules_of(text, ["a", "b"]) == {(a,), (b,), (a, ("b", "<=", -2e-4)), (a, ("b", ">", -2e-4))}


@pytest.fixture(params=["1", "2", "3", "4", "8", "16"])
def shuffle(spark, request):
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_quality_model_is_one_sparse_expression(spark, shuffle):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(40))) if i % 2 else (i, " ".join(["SPAM!!"] * rng.randint(5, 40))) for i in range(300)]
    labels = [(i, i % 2, 0) for i in range(250)] + [(3, 1, 0), (3, None, 0), (None, 1, 0), (9999, 0, 0)]
    docs += [(None, "alpha beta"), (400, None), (401, ""), (402, "SPAM!! " * 30_000), (7, docs[7][1])]
    d, l = frames(spark, docs, labels)
    model = quality.train(d, l, max_rows=100)
    assert 0 < len(model.terms) < 40
    assert model == quality.train(d.repartition(7), l.repartition(2), max_rows=100)
    got = quality.score(d, model).collect()
    assert len(got) == len(docs)
    assert all(r.predicted == (r.doc_id % 2) for r in got if r.doc_id is not None and r.doc_id < 300)
    assert {r.doc_id: r.predicted for r in got}[402] == 0
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    plan = quality.score(d, model)._jdf.queryExecution().toString()
    assert "Python" not in plan


@pytest.mark.parametrize("labels", [[], [(1, 1, 1)], [(1, 0, 0)], [(2, None, None)]])
def test_too_few_labels(spark, labels):
    d, l = frames(spark, [(1, "a"), (2, None), (None, "")], labels)
    want = {(): 0.5, (1,): 0.75, (0,): 0.25}[tuple(q for i, q, _ in labels if q is not None)]
    assert [round(r.score, 6) for r in quality.score(d, quality.train(d, l)).collect()] == [want] * 3
    got = toxicity.score(d, toxicity.train(d, l)).collect()
    assert len(got) == 3 and len({round(r.score, 6) for r in got}) == 1
    assert quality.score(d.limit(0), quality.train(d, l)).count() == toxicity.score(d.limit(0), toxicity.train(d, l)).count() == 0


def test_features_do_not_cross_rows():
    texts = ["Loser", "los", "", "loser! loser", "é-x"]
    sets = toxicity.features_of(texts)
    assert [len(s) for s in sets] == [2, 1, 0, 2, 2]  # the word and its first four bytes
    assert set(sets[0]) == set(sets[3])


def test_swaps():
    assert toxicity.swapped("Nothing here. Many women sing; men too! Bye") == [(" Many women sing; men too", " Many men sing; women too")]
    assert toxicity.swapped("plain text") == []
    assert len(toxicity.swapped("a muslim sings")) == 4


def biased(rng, n=600):
    """Insults name one group more often; neutral mentions of it exist, but few."""
    filler = ["river", "stone", "cloud", "green", "walk", "letter", "seven", "garden"]
    texts, label = [], []
    for i in range(n):
        words = [rng.choice(filler) for _ in range(12)]
        toxic = i % 4 == 0
        if toxic:
            words[3] = rng.choice(["idiot", "scum", "trash"])
        if rng.random() < (0.8 if toxic else 0.02):
            words[6] = "women"
        elif rng.random() < 0.1:
            words[6] = "men"
        texts.append(" ".join(words))
        label.append(float(toxic))
    return texts, np.array(label)


def test_penalty_lowers_scores_of_neutral_mentions():
    texts, label = biased(random.Random(2))
    pairs = [p for t in texts for p in toxicity.swapped(t)]
    sides = [toxicity.features_of([p[k] for p in pairs]) for k in (0, 1)]
    features = toxicity.features_of(texts)
    neutral = ["women walk in the green garden", "seven women wrote a letter"]
    plain, fair = (toxicity.fit(features, label, *sides, penalty=p) for p in (0.0, 20.0))
    gap = [abs(m.score(["women walk"])[0] - m.score(["men walk"])[0]) for m in (plain, fair)]
    assert gap[1] < gap[0] / 3
    assert (fair.score(neutral) < plain.score(neutral)).all() and (fair.score(neutral) < 0.5).all()
    assert (fair.score(["such an idiot", "scum of the river"]) > 0.5).all()


def test_penalty_acts_without_any_listed_term(spark):
    """The query's own training: its pairs come from words used alike, and the penalty lowers their score change."""
    path = "/root/testdata/sf0.01"
    d, l = (spark.read.parquet(f"{path}/{n}.parquet") for n in ("documents", "labels"))
    fair, plain = (toxicity.train(d, l, penalty=p) for p in (1.0, 0.0))
    assert fair.pairs == plain.pairs > 100 and fair.change < 0.5 * plain.change, (fair.pairs, fair.change, plain.change)


def test_similar_words_share_a_slot(spark):
    texts = [f"the {w} sings now. a {v} walks by" for w in ("bird", "child", "bird", "child", "bird", "child", "rare") for v in ("dog", "cat", "dog")]
    rows = spark.createDataFrame([(0, t + f" {i}") for i, t in enumerate(texts)] + [(1, "the scum sings now")] * 9, "label int, text string")
    assert toxicity.similar_words(rows) == [("dog", "cat"), ("bird", "child", "rare")]
    assert toxicity.similar_words(rows, size=1, members=2) == [("dog", "cat")]
    assert toxicity.swapped("A bird and a DOG!", [("bird", "child", "rare"), ("dog", "cat")], copies=1) == [("A bird and a DOG", "A child and a cat")]


def test_toxicity_edges(spark):
    texts, label = biased(random.Random(3), 300)
    docs = list(enumerate(texts)) + [(900, None), (901, ""), (None, "idiot"), (902, "river " * 40_000 + "idiot scum trash"), (5, texts[5])]
    d, l = frames(spark, docs, [(i, 0, int(x)) for i, x in enumerate(label)] + [(0, 0, None), (1, 0, 0), (None, 0, 1)])
    model = toxicity.train(d, l, max_rows=250)
    got = toxicity.score(d, model).collect()
    assert len(got) == len(docs)
    by_id = {r.doc_id: r.score for r in got}
    assert by_id[902] > 0.7 and by_id[None] > 0.5 and by_id[900] == by_id[901] < 0.5
    kept = toxicity.keep_clean(d, model)
    assert kept.columns == d.columns and kept.count() == sum(r.predicted == 0 for r in got)
    again = toxicity.train(d.repartition(5), l, max_rows=250)
    assert np.array_equal(again.keys, model.keys) and np.allclose(again.weights, model.weights)


def test_scores_do_not_depend_on_pieces(monkeypatch):
    texts, label = biased(random.Random(4), 80)
    model = toxicity.fit(toxicity.features_of(texts), label, [], [])
    whole = model.score(texts)
    monkeypatch.setattr("stationflow.llm.common.CHUNK_BYTES", 50)
    raw, at = toxicity.text_buffers(pa.array(texts))
    parts = np.concatenate([model.sums(raw, at[a:b + 1]) for a, b in toxicity.chunks(at, 50)])
    assert np.allclose(toxicity._sigmoid(parts + model.bias), whole)


def test_only_whole_copies_leave_the_sample(spark):
    """Texts with a common header and footer all count, and copies do not use up the limit."""
    header, footer = "header " * 20, " footer" * 20
    docs = [(i, f"{header}word{i}{footer}") for i in range(60)] + [(i, f"{header}copy{footer}") for i in range(60, 300)]
    d, l = frames(spark, docs, [(i, 0, 1) for i, _ in docs] + [(1000, 0, 1)])
    learnt = {t for i, t in docs if zlib.crc32(str(i).encode()) % 3 != 1}
    assert {r.text for r in toxicity.training_rows(d, l, 400).collect()} == learnt
    few = toxicity.training_rows(d, l, 40).collect()
    assert len(few) == len({r.text for r in few}) == 20


def test_swaps_are_counted_in_small_groups(monkeypatch):
    texts = [f"The old men of town {i} met. Two women and a girl left! A quiet sentence." for i in range(40)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array([i % 2 for i in range(len(texts))], pa.int32()), pa.array(texts)], ["label", "text"]).slice(1)

    def taken(swaps):
        monkeypatch.setattr(toxicity, "SWAPS", swaps)
        found, sums, labels = list(toxicity._sample(iter([batch]), toxicity.IDENTITY_GROUPS, [("town", "left")])), {}, []
        for out in found:
            for r in out.to_pylist():
                if r["pairs"] is None:
                    labels.append((r["label"], r["features"]))
                else:
                    key = tuple(r["lost"]), tuple(r["gained"])
                    sums[key] = sums.get(key, 0) + r["pairs"]
        return [sum(out.column("pairs").drop_null().to_pylist()) for out in found], sums, labels

    few, many = taken(7), taken(1 << 12)
    assert max(few[0]) == 7 and max(many[0]) == sum(few[0]) > 100
    assert few[1:] == many[1:] and len(few[2]) == len(texts) - 1
