import random

import numpy as np
import pyarrow as pa
import pytest
from brute import outliers as plain
from brute import text_counts
from pyspark.sql import functions as F

from stationflow.llm import common, outliers
from stationflow.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string"
COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def found(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


@pytest.mark.parametrize("piece", [1, 5, 64, 1 << 17])
def test_counts_equal_plain_python(monkeypatch, piece):
    monkeypatch.setattr(common, "PIECE_BYTES", piece)
    common._POWERS.clear()
    r = random.Random(piece)
    texts = ["".join(r.choice("ab A\n\t\r\x0b#<é漢 ") for _ in range(r.choice([0, 1, 9, 60, 300]))) for _ in range(200)]
    texts += [None, "", "\n\n \n", "x x x x", "a\na\n a\na", "B b\nB b\nb b", "a b c a b c", "same " * 300, "q" * 500 + "\n" + "q" * 500]
    raw, at = common.text_buffers(pa.array(texts, pa.large_string()))
    got = [tuple(map(int, line)) for line in outliers.counted(raw, at)]
    assert got == [text_counts(t) for t in texts]
    assert [tuple(map(int, line)) for line in outliers.counted(raw, at[50:61])] == got[50:60]
    common._POWERS.clear()


def prose(r, n, length=5, symbols=0.0):
    words = []
    for _ in range(n):
        w = "".join(r.choice("abcdefghij") for _ in range(max(1, int(r.gauss(length, 1.5)))))
        words.append(w + ("#" if r.random() < symbols else ""))
    return " ".join(words)


def corpus(r):
    rows = []
    for k in range(420):
        lang, source = r.choice([("en", "hot"), ("en", "hot"), ("en", "b"), ("de", "hot"), ("de", None), (None, "c"), ("fr", f"s{k}")])
        junk = r.random() < 0.1
        rows.append((k, prose(r, r.randrange(40, 120), 9 if junk else 5, 0.6 if junk else 0.0), lang, source))
    rows += [(900 + k, rows[0][1], "en", "hot") for k in range(30)] + [(None, prose(r, 60), "en", "hot")]
    return rows


@pytest.mark.parametrize("parts,shuffle", [(1, "1"), (7, "3"), (3, "16")])
def test_equals_brute_force(spark, parts, shuffle):
    rows = corpus(random.Random(3))
    spark.conf.set("spark.sql.shuffle.partitions", shuffle)
    try:
        got = found(outliers.judge(spark.createDataFrame(rows, SCHEMA).repartition(parts), least=40))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == plain(rows, 40)
    assert {r[7] for r in got if not r[6]} == {True, False}


def test_junk_goes_and_clean_text_stays(spark):
    r = random.Random(11)
    rows = [(k, prose(r, 80), "en", "a") for k in range(300)] + [(1000 + k, prose(r, 80, 9, 0.5), "en", "a") for k in range(60)]
    kept = {r[0]: r[7] for r in found(outliers.judge(spark.createDataFrame(rows, SCHEMA)))}
    assert sum(kept[k] for k in range(300)) >= 297 and not any(kept[1000 + k] for k in range(60))


def test_odd_rows(spark):
    rows = [(None, None, None, None), (1, "", "en", "a"), (1, "", "en", "a"), (2, "word", "en", None), (3, "a " * 100_000, "en", "a"),
            (4, "#" * 300_000, "en", "a"), (5, " ".join(f"w{i}" for i in range(100_000)), None, "a"), (6, "\n".join(["line of text"] * 100), "en", "a")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("cell", "size", "mean", "d2", "kept", "n_words", "x0")})
    assert found(outliers.judge(docs)) == plain(rows, outliers.LEAST)
    assert found(outliers.judge(docs, least=1)) == plain(rows, 1)
    assert found(outliers.judge(spark.createDataFrame([], SCHEMA))) == []


def test_chi_square():
    assert outliers.chi_square_quantile(0.95, 4) == pytest.approx(9.4877, abs=1e-3)
    assert outliers.chi_square_quantile(0.99, 6) == pytest.approx(16.8119, abs=1e-3)
    mean, inverse = outliers.estimate(2, np.array([2.0, 0, 0, 0]) * 1000, np.diag([4.0, 0, 0, 0]) * 1e6, 0.6)
    assert mean == [1.0, 0, 0, 0] and inverse[5] == pytest.approx(100)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert found(QUERIES["op11_outliers"](spark, sf)) == plain(rows, outliers.LEAST)
