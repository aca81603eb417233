import gzip
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stationflow.llm import exact_topk, url_filter, warc
from stationflow.llm.common import staging_path
from stationflow.llm.queries import ORACLES, QUERIES, captures


def brute(rows, k, is_query):
    """rows: (id, list) -> {(query id, rank): (id, score)} with one list per query row."""
    ok = [(i, [int(np.floor(256 * np.float64(x))) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (q, x) in enumerate(ok):
        if is_query(q):
            best = sorted((-sum(s * t for s, t in zip(x, y)), i) for b, (i, y) in enumerate(ok) if b != a)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(4096, 2048, 64), (7, 3, 4)])
def test_top_k_equals_brute_force(spark, monkeypatch, sizes):
    for name, value in zip(("CANDIDATES", "QUERIES", "PER_LANE"), sizes):
        monkeypatch.setattr(exact_topk, name, value)
    rng = random.Random(5)
    rows = [(i, [rng.choice([0.0, 0.0, rng.uniform(-1, 1)]) for _ in range(6)]) for i in range(160)]
    rows += [(200, None), (250, [None, 1.0]), (300, [float("nan")] * 6), (350, [1.0, float("inf")]), (400, [0.5]), (450, []), (None, [1.0] * 6),
             (500, rows[10][1]), (500, rows[10][1]), (501, rows[10][1]), (600, [0.0] * 6), (1000, [0.25] * 9)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, v, "r", 1) for i, v in rows], "vec_id long, embedding array<float>, rank string, score int").repartition(4)
    got = exact_topk.exact_top_k(df, "id % 50 = 0", 5).collect()
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute(rows, 5, lambda i: i % 50 == 0)
    assert exact_topk.exact_top_k(df.limit(0), "id % 50 = 0", 5).count() == 0
    few = exact_topk.exact_top_k(df.where("vec_id IN (50, 51, 52)"), "id % 50 = 0", 5).collect()
    assert sorted(r.rank for r in few) == [1, 2]


@pytest.mark.parametrize("sizes", [(4096, 8192, 256), (7, 30, 3), (16, 5, 1)])
def test_top_k_of_copies_long_and_sparse_vectors(spark, monkeypatch, sizes):
    for name, value in zip(("CANDIDATES", "QUERIES", "PER_LANE"), sizes):
        monkeypatch.setattr(exact_topk, name, value)
    rng = random.Random(11)
    rows = [(i, [1.0, 0.5, 0.25]) for i in range(400, 0, -4)]  # copies: all scores tie, ids fall
    rows += [(i, [0.0] * rng.randrange(300) + [rng.uniform(-1, 1)] + [0.0] * rng.randrange(9)) for i in range(401, 451)]
    rows += [(i, [rng.uniform(-1, 1) * size for _ in range(9)]) for i, size in zip(range(451, 511), [1, 40, 3e5, 1e6] * 15)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = exact_topk.exact_top_k(df, "id % 25 = 0", 3).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute(rows, 3, lambda i: i % 25 == 0)


def test_top_k_copies_no_blocks_and_hands_over_k_rows_a_query(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "CANDIDATES", 10)
    monkeypatch.setattr(exact_topk, "PER_LANE", 20)
    monkeypatch.setattr(exact_topk, "QUERIES", 2)
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    plan = exact_topk.exact_top_k(df, "id % 25 = 0", 3)._jdf.queryExecution().toString()
    assert "CartesianProduct" in plan and "explode" not in plan and "Broadcast" not in plan
    # Many blocks of candidates pass by a block of queries: k rows a query remain.
    whole = [(i, i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    def packed(some, size):
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), (pa.int64(), pa.int64(), pa.list_(pa.int64())))], ["id", "mark", "v"])
        return list(exact_topk._blocks(iter([batch]), size))
    asked, offered = packed([r for r in whole if r[0] % 25 == 0], 100), packed(whole, 10)
    assert len(asked) == 1 and len(offered) == 40
    met = [pa.RecordBatch.from_arrays([*c.columns, *asked[0].columns], [*c.schema.names, *(f"a_{x}" for x in asked[0].schema.names)])
           for c in offered]
    assert sum(b.num_rows for b in exact_topk._searched(iter(met), 3)) == 16 * 3


def test_top_k_query_equals_brute_force(spark):
    path = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    got = sorted(map(tuple, QUERIES["op6_exact_topk"](spark, path).collect()))
    assert got == brute(rows, 5, lambda i: i % 50 == 0)


def plain_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = rest[:min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = []
    for name, verdict in [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]:
        h, _, p = name.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(name), name, verdict))
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


URLS = ["http://a.example.com/en/1?x#y", "https://WWW.Example.COM/en/", "http://www.example.com/EN/", "http://example.net/es/a", "x.net/es/",
        "://net/fr/", "http://com", "http://com/", "ftp://notexample.com/en/x", "http://a.com?b=/en/", "http://a.com#://b.net/es/", "", None,
        "http://spam-farm.org/x", "http://a.casino-win.org/", "http://x.org/login", "http://x.org/LOGIN", "http://É.net/fr/é", "http://wwwexample.com/en/",
        "http://a.net/esp/", "http://a.net/es", "http://user@example.com:80/en/", "a://b://c.com/en/", "http://x.org/" + "a/" * 20_000]


def test_verdicts(spark):
    rows = [(i, u, "h", "r") for i, u in enumerate(URLS)] + [(0, URLS[0], "h", "r"), (None, URLS[3], "h", "r")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule string").repartition(3)
    got = url_filter.verdicts(df, url_filter.RULES).collect()
    assert sorted((r.page_id for r in got), key=repr) == sorted((r[0] for r in rows), key=repr)
    by_id = {r.page_id: r for r in got}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = plain_verdict(u)
        assert (by_id[i].host, by_id[i].path, by_id[i].rule) == (host, path, rule), u
        assert by_id[i].verdict == (verdict or ("block" if by_id[i].pattern else "allow"))
    assert [by_id[i].pattern for i in (13, 14, 15, 16)] == ["spam-farm", "casino", "login", None]
    assert url_filter.verdicts(df.limit(0), url_filter.RULES).count() == 0
    plan = url_filter.verdicts(df, url_filter.RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_open_ended_and_tokenless_rules(spark):
    rules = (url_filter.host_rule("block", "example.com/en"), url_filter.host_rule("block", "-.org/"), url_filter.host_rule("allow", "b.org"))
    urls = ["http://example.com/english", "http://x.-.org/", "http://b.org", "http://b.org/x", "http://ab.org/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.rule for r in url_filter.verdicts(df, rules, ()).collect()}
    assert got == {0: "example.com/en", 1: "-.org/", 2: "b.org", 3: "b.org", 4: None}


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, name, sf):
    con = duckdb.connect()
    for t in ("pages", "documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/{sf}/{t}.parquet')")
    got = QUERIES[name](spark, f"/root/testdata/{sf}")
    want = con.execute(ORACLES[name])
    assert sorted(got.columns) == sorted(c[0] for c in want.description)
    order = [c[0] for c in want.description]
    rows = want.fetchall()
    assert rows and sorted((tuple(r[c] for c in order) for r in got.collect()), key=repr) == sorted(rows, key=repr)


RECORDS = "record_id long, url string, at long, type string, headers map<string,string>, body binary, key string, day long"


def records(spark, rows):
    return spark.createDataFrame([(*r, b"body", "k", 1) for r in rows], RECORDS).repartition(3)


def test_revisits(spark):
    u, day = "http://A.com:80/x?b=2&utm_source=z&a=1#f", 86400
    rows = [(1, u, 100, "response", {"ETag": '"1"', "Content-Length": "4", "Age": "7"}), (2, "https://www.a.com/x?a=1&b=2", 50, "response", {"ETag": '"0"'}),
            (3, u, 100, "response", {"ETag": '"2"', "Content-Type": "t", "X": "old"}),
            (10, u, 100, "revisit", {"etag": '"0"'}), (11, u, 101, "revisit", {"etag": 'W/"2"', "content-type": "no", "x": "new"}),
            (12, u, 9 * day, "revisit", {"etag": '"1"'}), (13, u, 50, "revisit", {"etag": '"0"'}), (14, "http://b.com", 5, "revisit", None),
            (15, u, 200, "revisit", {}), (16, None, 5, "revisit", None), (17, u, None, "revisit", None), (18, u, 10 * day, "request", None)]
    got = {r.record_id: r for r in warc.resolve_revisits(records(spark, rows)).collect()}
    assert {k: (r.status, r.refers_to) for k, r in got.items()} == {
        10: ("resolved", 2), 11: ("resolved", 3), 12: ("changed", 3), 13: ("unmatched", None), 14: ("unmatched", None), 15: ("changed", 3),
        16: ("unmatched", None), 17: ("unmatched", None)}
    assert got[11].headers == {"content-type": "t", "etag": 'W/"2"', "x": "new"}
    assert got[10].canonical_url == "a.com/x?a=1&b=2"
    whole = {r.record_id: r.body for r in warc.with_bodies(warc.resolve_revisits(records(spark, rows)), records(spark, rows)).collect()}
    assert whole[11] == b"body" and whole[14] is None and len(whole) == 8
    assert warc.resolve_revisits(records(spark, [])).count() == 0


def test_hot_url_over_many_days_equals_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["http://hot.com/", "http://hot.com/", f"http://c{i % 7}.com/"]), rng.randint(0, 20 * 86400) // 900 * 900,
             rng.choice(["response", "revisit", "revisit"]), {"etag": '"e"'}) for i in range(900)]
    want = {}
    for i, u, at, kind, _ in rows:
        if kind == "revisit":
            want[i] = max(((a, j) for j, v, a, k, _ in rows if k == "response" and v == u and a < at), default=(0, None))[1]
    assert {r.record_id: r.refers_to for r in warc.resolve_revisits(records(spark, rows)).collect()} == want


def test_warc_files_round_trip(spark):
    rows = [(i, f"http://a.com/{i}", 1_700_000_000 + i, "response" if i % 3 else "revisit", {"ETag": f'"{i}"'}) for i in range(50)]
    df = records(spark, rows).withColumn("body", url_filter.F.expr(
        "CASE WHEN record_id % 5 = 0 THEN cast('' AS binary) WHEN record_id = 7 THEN unhex('00FF0D0A0D0A80') ELSE cast(repeat('x\r\n\r\n', int(record_id)) AS binary) END"))
    out = staging_path(spark, "warc")
    warc.write_warc(df, out)
    got = {r.record_id: r for r in warc.read_warc(spark, out).collect()}
    want = {r.record_id: r for r in df.collect()}
    assert got.keys() == want.keys()
    for k, r in got.items():
        assert (r.url, r.at, r.type, r.headers, r.body) == (want[k].url, want[k]["at"], want[k].type, want[k].headers, bytes(want[k].body))


def test_captures_cover_all_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert captures(pages).count() == 2 * pages.count()


def test_query_on_pages_without_url_or_id(spark, tmp_path):
    schema = "page_id long, url string, html string"
    rows = [(4, "http://a.com/", "x"), (5, None, "y"), (None, "http://a.com/", "z"), (None, None, None), (6, "", "w")]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r.record_id, r.canonical_url, r.headers) for r in QUERIES["op8_warc_revisits"](spark, str(tmp_path)).collect() if r.status == "unmatched"}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = {(r[0], r[1], r[4]) for r in con.execute(ORACLES["op8_warc_revisits"]).fetchall() if r[2] == "unmatched"}
    assert got == want and {(11, None), (None, "a.com/"), (None, None)} <= {r[:2] for r in got}


def test_rows_of_a_hot_url_in_one_day_do_not_meet_in_a_window(spark):
    """2,000 captures of a url within 40 seconds: its windows see one row per second."""
    rng = random.Random(7)
    rows = [(i, "http://hot.com/", rng.randrange(40), rng.choice(["response", "revisit"]), {"etag": '"e"'}) for i in range(2000)]
    want = {i: max(((a, j) for j, _, a, k, _ in rows if k == "response" and a < at), default=(0, None))[1]
            for i, _, at, kind, _ in rows if kind == "revisit"}
    found = warc.latest_earlier(records(spark, rows).select("record_id", F.col("url").alias("key"), "at", (F.col("type") == "response").alias("is_response")))
    assert {r.record_id: r.refers_to for r in found.collect()} == want
    # Every window stands on an aggregate, so no raw row reaches one.
    lines = found._jdf.queryExecution().optimizedPlan().toString().strip().split("\n")
    windows = [k for k, line in enumerate(lines) if re.match(r"[ :+-]*Window ", line)]
    depth = lambda k: re.search(r"\w", lines[k]).start()
    for k in windows:
        below = next((j for j in range(k + 1, len(lines)) if depth(j) <= depth(k)), len(lines))
        assert any("Aggregate [key" in line for line in lines[k + 1:below])
    assert len(windows) == 2


def test_warc_files_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 100_000, raising=False)
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 100)
    rows = [(i, "http://a.com/", i, "response", {"n": "1"}) for i in range(300)]
    body = F.expr("cast(repeat('x', int(CASE WHEN record_id % 100 = 0 THEN 150000 WHEN record_id % 3 = 0 THEN 40000 WHEN record_id % 3 = 1 THEN 5000 ELSE 9 END)) AS binary)")
    df = records(spark, rows).withColumn("body", body).coalesce(1)
    out = staging_path(spark, "warc")
    warc.write_warc(df, out)
    sizes = [r.length for r in spark.read.format("binaryFile").load(out).select("length").collect()]
    assert all(n <= 100_000 for n in sizes if n < 150_000) and sum(n >= 150_000 for n in sizes) == 3 and max(sizes) < 151_000
    assert {(r.record_id, bytes(r.body)) for r in warc.read_warc(spark, out).collect()} == {(r.record_id, bytes(r.body)) for r in df.collect()}


def standard(kind, uri, date, block, ids="<urn:uuid:{}>", number=1, length=None, break_="\r\n", name="Content-Length"):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {uri}\r\nwarc-date: {date}\r\nWARC-Record-ID: {ids.format(f'{number:08d}-0000-4000-8000-000000000000')}\r\n"
    return (head + f"{name}: {len(block) if length is None else length}\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_standard_warc_files_are_read(spark, tmp_path):
    ok, moved = b"HTTP/1.1 200 OK\r\nETag:\"a\"\r\nx-no-colon\r\n\r\nbody\r\n\r\nmore", b"HTTP/1.1 404 Not Found\r\nETag: \"a\"\r\n\r\ngone"
    revisit = b"HTTP/1.1 304 Not Modified\r\nETag: \"a\"\r\n\r\n"
    info = standard("warcinfo", "", "2024-01-01T00:00:00Z", b"software: x\r\n", number=9)
    records_ = [info, standard("response", "http://A.example/x", "2024-01-01T00:00:00.123456Z", ok, number=1),
                standard("response", "http://a.example/x", "2024-01-01T01:00:00Z", moved, number=2, name="content-length"),
                standard("revisit", "https://a.example/x", "2024-01-01T02:00:00Z", revisit, number=3), standard("revisit", "http://a.example/x", "soon", revisit, number=4)]
    for case, data in {"plain": b"".join(records_), "members": b"".join(gzip.compress(r) for r in records_), "whole": gzip.compress(b"".join(records_))}.items():
        (tmp_path / case).mkdir()
        (tmp_path / case / "a.warc").write_bytes(data)
        read = warc.read_warc(spark, str(tmp_path / case))
        rows = {r.warc_id[10:18]: r for r in read.collect()}
        assert len(rows) == 5 and [rows[f"0000000{i}"].http_status for i in (1, 2, 3, 9)] == [200, 404, 304, None]
        assert rows["00000001"].at == 1704067200 and rows["00000004"].at is None and rows["00000001"].headers == {"ETag": '"a"'}
        assert bytes(rows["00000001"].body) == b"body\r\n\r\nmore" and rows["00000001"].record_id == warc.record_number(rows["00000001"].warc_id)
        got = {r.record_id: (r.status, r.refers_to) for r in warc.resolve_revisits(read).collect()}
        assert got == {rows["00000003"].record_id: ("resolved", rows["00000001"].record_id), rows["00000004"].record_id: ("unmatched", None)}


@pytest.mark.parametrize("tail", [b"", b"WARC/1.0\r\nWARC-Type: resp", b"garbage\r\n\r\n", standard("response", "u", "d", b"HTTP/1.1 200 OK", length=500),
                                  standard("response", "u", "d", b"x", length="many")])
def test_damaged_warc_tails_are_rows_of_their_own(tail):
    good = standard("response", "http://a/", "2024-01-01T00:00:00Z", b"HTTP/1.1 200 OK\r\n\r\nb")
    kinds = [r["type"] for r in warc.records_of(memoryview(good + tail))]
    assert kinds == ["response"] + ["malformed"] * bool(tail)
    packed = gzip.compress(good) + (gzip.compress(tail)[:-9] if tail else b"")
    assert [r["type"] for r in warc.records_of(memoryview(packed))] == kinds
    assert [r["type"] for r in warc.records_of(memoryview(gzip.compress(good) + b"\x1f\x8b\x00damaged"))] == ["response", "malformed"]
