import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stationflow.llm import token_files
from stationflow.llm.common import staging_path, text_buffers
from stationflow.llm.queries import QUERIES

BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, start string, n_tokens long"


def expected(rows, path=BPE):
    t = Tokenizer.from_file(path)
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_word_by_word_equals_whole_text(monkeypatch):
    rng = random.Random(2)
    pieces = ["a", "the", "the.", "Straße,", "naïve!!", "日本。", "x²", "ab12.", "I'm;", "a_b", "ªº.", "ǅx:", "%%%", "word%%%", " ", "  ", "\n", "\t", "\r\n", "é", "ß", "don't", "we'll", "12", "3.5", "!!", " ", " ", "\x1c", "\x85",
              "<|endoftext|>", "日本", "👩‍🚀", "x" * 70, ".", "'s", "​", "\x00"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    encoder = token_files.Encoder(BPE)
    assert encoder.by_word

    def encoded(some):
        rows, left = [], []
        for part, ends in encoder.texts(*text_buffers(pa.array(some, pa.large_string()))):
            done = 0
            for stop in ends.tolist():
                rows.append(left + part[done:stop].tolist())
                left, done = [], stop
            left = left + part[done:].tolist()
        assert not left
        return rows

    for window, store, slots in ((1, 500, 64), (40, 12_000_000, 1 << 21), (1 << 20, 2000, 1024), (1 << 20, 12_000_000, 1 << 21)):
        for name, value in (("WINDOW_BYTES", window), ("STORE_IDS", store), ("SLOTS", slots)):
            monkeypatch.setattr(token_files, name, value)
        encoder._forget()
        for i in range(0, 4000, 200):
            assert encoded(texts[i:i + 200]) == [e.ids for e in encoder.tokenizer.encode_batch(texts[i:i + 200], add_special_tokens=False)]
    assert encoded([]) == [] and encoded(["", None, ""]) == [[], [], []]


def test_round_trip_keys_and_edges(spark):
    rows = [(7, "seven words are in this small text"), (3, None), (11, ""), (5, "x" * 200_000), (-4, "minus"), (None, "no key"),
            *[(100 + i, f"document number {i} # {'word ' * (i % 9)}") for i in range(300)]]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(i, t, "s", 0) for i, t in rows], SCHEMA).repartition(5)
    out = staging_path(spark, "tokens")
    got = token_files.token_files(df, out, BPE, shard_ids=500)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got.collect()), key=lambda r: r[1]) == expected(rows)
    assert [r.doc_id for r in got.collect() if not r.indexed] == [None]
    asked = spark.createDataFrame([(7,), (150,), (-4,), (3,), (9999,), (12345,), (None,)], "doc_id long")
    t = Tokenizer.from_file(BPE)
    ids = {r.doc_id: r.ids for r in token_files.fetch(asked, f"{out}/shards", f"{out}/index").collect()}
    texts = dict(rows)
    assert ids == {k: [*t.encode(texts[k] or "", add_special_tokens=False).ids, 2] for k in (7, 150, -4, 3)}


def test_repeated_ids_and_no_rows(spark):
    rows = [(1, "a b c"), (1, "d"), (1, "a b c"), (2, "e")]
    df = spark.createDataFrame([(i, t, "s", 0) for i, t in rows], SCHEMA)
    got = token_files.token_files(df, staging_path(spark, "tokens"), BPE, shard_ids=2).orderBy("start").collect()
    assert [r.doc_id for r in got] == [1, 1, 1, 2] and all(r.indexed for r in got)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(4)]
    empty = token_files.token_files(df.limit(0), staging_path(spark, "tokens"), BPE)
    assert empty.count() == 0


def test_index_is_minimal_and_rejects_strangers():
    keys = np.random.default_rng(0).choice(1 << 40, 5000, replace=False).astype(np.int64).view(np.uint64)
    sizes, bits = token_files._levels(keys)
    slots = token_files._slots(keys, sizes, bits, token_files._ranks(bits))
    assert sorted(slots) == list(range(5000)) and len(bits) < 4 * 5000
    marks = np.zeros(5000, "<u4")
    marks[slots] = token_files._fingerprints(keys)
    others = keys + np.uint64(1 << 41)
    s = token_files._slots(others, sizes, bits, token_files._ranks(bits))
    assert not ((s >= 0) & (marks[np.maximum(s, 0)] == token_files._fingerprints(others))).any()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_plain_encoding(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    got = QUERIES["op1_token_files"](spark, path).collect()
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == expected(rows)
