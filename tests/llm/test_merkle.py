from brute import merkle as plain
from pyspark.sql import functions as F

from stationflow.llm import merkle
from stationflow.llm.queries import QUERIES

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def found(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def test_trees_of_all_sizes(spark):
    rows = [(i, f"s{i % 3}", lang, i, f"Text {i}") for lang, n in (("en", 75), ("de", 64), ("fr", 9), ("es", 1), (None, 8), ("ü", 65), ("z", 2), ("a", 3), ("b", 1), ("c", 1))
            for i in range(n)]
    got = found(merkle.manifest(spark.createDataFrame(rows, SCHEMA)))
    assert got == plain(rows)
    assert {r[6] for r in got} == {True, False}


def test_odd_rows(spark):
    long = "Word " * 200_000
    rows = [(None, None, None, None, None), (None, "a", "en", 3, "ABC"), (5, "a", "en", 3, ""), (5, "a", "en", 3, ""), (5, "a", "en", 3, "Zwei"),
            (-7, "", "", 0, "Ünïcode ß 漢"), (2**62, "x", "en", -1, long), (3, "a", "en", None, "A"), (6, "q", "en", 1, "É")]
    rows += [(9, "a", "en", 1, "Same")] * 20
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("tree", "pos", "node", "level", "leaf", "kid")})
    assert found(merkle.manifest(docs)) == plain(rows)


def test_few_rows(spark):
    assert found(merkle.manifest(spark.createDataFrame([], SCHEMA))) == []
    for rows in ([(1, "a", "en", 1, "A")], [(i, "a", "en", 1, "A") for i in range(9)], [(i, "a", f"l{i}", 1, "B") for i in range(20)]):
        assert found(merkle.manifest(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_shuffled_joins_and_partitions(spark, monkeypatch):
    monkeypatch.setattr(merkle, "NEAR", 0)
    monkeypatch.setattr(merkle, "NEAR_TREES", 0)
    rows = [(i // 2, "s", "en" if i % 3 else f"l{i % 7}", i, f"T{i}") for i in range(700)]
    assert found(merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(5))) == plain(rows)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert found(QUERIES["op13_merkle_manifest"](spark, sf)) == plain(rows)
