import random

import pytest
from pyspark.sql import functions as F

from stationflow.llm import mixing
from stationflow.llm.queries import MIX, QUERIES

DOCS = "doc_id long, text string, lang string, source string, budget long, place string"


def fill(budget, children, capacity, weight):
    """Budgets of children: proportional to weights, what a child can't take goes to the others."""
    got, open_ = {c: 0.0 for c in children}, [c for c in children if weight(c) > 0]
    budget = min(budget, sum(capacity(c) for c in open_))
    while open_ and budget > 1e-9:
        total, low = sum(weight(c) for c in open_), [c for c in open_]
        step = min([budget / total, *[(capacity(c) - got[c]) / weight(c) for c in low]])
        for c in low:
            got[c] += step * weight(c)
        budget -= step * total
        open_ = [c for c in low if capacity(c) - got[c] > 1e-9]
    return got


def brute_budgets(leaves, budget, epochs, specs):
    """leaves: {(domain, lang, source): tokens} -> budgets of the leaves."""
    def below(prefix):
        return sorted({k[:len(prefix) + 1] for k in leaves if k[:len(prefix)] == prefix})

    def capacity(node):
        return epochs * sum(v for k, v in leaves.items() if k[:len(node)] == node)

    out = {}

    def walk(node, amount):
        if len(node) == 3:
            out[node] = amount
            return
        for child, part in fill(amount, below(node), capacity, lambda c: (specs[len(node)] or {}).get(c[-1], 1.0)).items():
            walk(child, part)

    walk((), budget)
    return out


SPECS = [None, {"d0": 5.0, "d1": 1.0, "d2": 0.0}, {"en": 0.7, "de": 0.2}]


@pytest.mark.parametrize("seed", range(4))
def test_budgets_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    leaves = {(f"d{rng.randint(0, 3)}", rng.choice(["en", "de", "fr", ""]), f"s{i}"): rng.choice([0, 1, 10, 500, 20_000]) for i in range(30)}
    df = spark.createDataFrame([(*k, v) for k, v in leaves.items()], "_domain string, _lang string, _source string, tokens long")
    total = sum(leaves.values())
    specs = [SPECS[seed % 3], SPECS[2], {"s3": 9.0, "s4": 0.0}]
    for share in (0.1, 0.7, 5.0):
        got = {(r._domain, r._lang, r._source): r.budget for r in mixing.leaf_budgets(df, share * total, 2, *specs).collect()}
        want = brute_budgets(leaves, share * total, 2, specs)
        assert got == pytest.approx({k: want.get(k, 0.0) for k in leaves}, abs=1e-3)


def made(rng, n=1500):
    rows = []
    for i in range(n):
        source = rng.choice(["src0"] * 10 + [f"src{k}" for k in range(1, 9)] + [None, "odd"])
        rows.append((i, " ".join(["w"] * rng.choice([0, 1, 5, 50])) if rng.random() > 0.02 else None, rng.choice(["en", "en", "de", None]), source))
    return rows + [(9000, "long " * 3000, "en", "src1")]


def expected(rows, share, epochs, spark, **specs):
    """Leaf budgets and the order of each leaf, walked one document after another."""
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], DOCS)
    key = F.xxhash64(F.lit(17), "doc_id", "text")
    order = [F.shiftrightunsigned(F.xxhash64(key, F.lit(e)), 12).alias(f"o{e}") for e in range(epochs + 1)]
    dom = mixing.source_domain(F.coalesce("source", F.lit("")))
    info = df.select("doc_id", F.coalesce(dom, F.lit("")).alias("d"), F.coalesce("lang", F.lit("")).alias("l"), F.coalesce("source", F.lit("")).alias("s"),
                     key.alias("k"), *order, mixing.n_words(F.col("text")).alias("n")).collect()
    leaves = {}
    for r in info:
        leaves[(r.d, r.l, r.s)] = leaves.get((r.d, r.l, r.s), 0) + r.n
    budgets = brute_budgets(leaves, share * sum(leaves.values()), epochs,
                            [specs.get("domain_weights"), specs.get("lang_weights"), specs.get("source_weights")])
    out = []
    for leaf, tokens in leaves.items():
        left, epoch = budgets.get(leaf, 0.0) + 1e-6, 0
        mine = [r for r in info if (r.d, r.l, r.s) == leaf]
        while tokens and epoch < epochs and left >= tokens:
            out += [(r.doc_id, epoch) for r in mine]
            left, epoch = left - tokens, epoch + 1
        if left < 1 or epoch == epochs:
            continue
        for place, k in sorted({(r[f"o{epoch}"], r.k) for r in mine}):
            if left <= 1e-5:
                break
            same = [r for r in mine if (r[f"o{epoch}"], r.k) == (place, k)]
            out += [(r.doc_id, epoch) for r in same]
            left -= sum(r.n for r in same)
    return sorted(out)


@pytest.mark.parametrize("share,epochs", [(0.5, 1), (0.9, 2), (3.0, 2), (0.0, 1)])
def test_mixture_equals_brute_force(spark, monkeypatch, share, epochs):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    rows = made(random.Random(3))
    rows += [rows[5], rows[5]]
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], DOCS).repartition(5)
    specs = dict(domain_weights={"web": 0.2, "books": 0.7}, lang_weights={"en": 0.3, "de": 0.6})
    got = mixing.mix(df, share, epochs, **specs)
    assert got.columns[:6] == df.columns
    assert sorted((r.doc_id, r._epoch) for r in got.collect()) == expected(rows, share, epochs, spark, **specs)
    assert mixing.mix(df.limit(0), share, epochs).count() == 0


def test_query_meets_its_budget(spark):
    path = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    got = QUERIES["op5_mixing"](spark, path).collect()
    specs = {k: v for k, v in MIX.items() if k.endswith("weights")}
    assert sorted((r.doc_id, r.epoch) for r in got) == expected(rows, MIX["share"], MIX["epochs"], spark, **specs)
