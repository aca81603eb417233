"""WARC revisit records resolved against earlier captures.

A server that answers ``304 Not Modified`` leaves a revisit record without a body. It is resolved by an
as-of join: the latest earlier full response of the same canonical URL. The response counts only if the
validators agree (ETag, else Last-Modified); its headers are then updated by those the revisit may carry.

A URL may hold a large share of all captures, so the as-of join sees one row per URL and second and is cut
into days: within a day a window looks back over at most 86,400 rows, and one row per URL and day hands the
last response on to later days. Revisits fetch the answer of their URL and second. Bodies never pass
through it; they are joined to the resolved records by record id.

Edge cases: records with a null URL or time, and revisits without an earlier response, are ``unmatched``;
equal times are not earlier; of responses at the same time the greatest record id counts; headers may be
null or empty; header names are compared without case. Extra columns are kept away from the result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .decontaminate import lower_ascii

# Headers that a 304 response must not change in the stored response.
FRAMING = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
           "proxy-authenticate", "proxy-authorization", "set-cookie", "te", "trailer", "transfer-encoding", "upgrade")
# Query parameters that only track visitors.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref")
# A file holds at most so many records and bytes; a larger record stands alone.
RECORDS_PER_FILE = 2000
FILE_BYTES = 64 << 20
_STEP = 8
_BREAK = re.compile(rb"\r\n\r\n")
_PIECE = 1 << 16


def canonical_url(url: Column) -> Column:
    """Scheme and fragment dropped, host lower-cased without default port, tracking parameters removed, the others sorted."""
    bare = F.regexp_replace(F.regexp_replace(url, r"#[\s\S]*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    raw_host = F.regexp_extract(bare, r"^[^/?]*", 0)
    host = F.regexp_replace(F.regexp_replace(lower_ascii(raw_host), r":(80|443)$", ""), r"^www\.", "")
    rest = F.substr(bare, F.length(raw_host) + 1)
    path = F.regexp_extract(rest, r"^[^?]*", 0)
    path = F.when(path == "", "/").otherwise(path)
    query = F.substr(rest, F.locate("?", rest) + 1)
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*TRACKING))
    kept = F.when(F.locate("?", rest) > 0, F.array_join(F.array_sort(pairs), "&")).otherwise("")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def lowered(headers: Column) -> Column:
    """Header map with lower-case names; of names that only differ in case the last in order counts."""
    entries = F.map_entries(F.coalesce(headers, F.expr("CAST(map() AS map<string, string>)")))
    names = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    later = F.filter(names, lambda e, i: ~F.exists(F.slice(names, i + 2, F.size(names)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(later)


def merged_headers(stored: Column, revisit: Column) -> Column:
    """The stored headers, with the permitted ones of the revisit in their place, sorted by name."""
    permitted = F.map_filter(revisit, lambda k, _: ~k.isin(*FRAMING))
    replaced = F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(permitted), k))
    return F.map_from_entries(F.array_sort(F.concat(F.map_entries(replaced), F.map_entries(permitted))))


def latest_earlier(records: DataFrame) -> DataFrame:
    """record_id of each revisit and ``refers_to``, the latest earlier response of its URL.

    ``records``: record_id, key, at (seconds), is_response.
    """
    rows = records.where("key IS NOT NULL AND at IS NOT NULL").select("record_id", "key", "at", "is_response")
    # Of one URL and second only the greatest response counts, and all revisits get the same answer.
    times = (rows.groupBy("key", "at").agg(F.max(F.when(F.col("is_response"), F.col("record_id"))).alias("id"))
             .withColumn("day", F.floor(F.col("at") / 86400)))
    mine = F.when(F.col("id").isNotNull(), F.struct("at", "id"))
    by_day = times.groupBy("key", "day").agg(F.max(mine).alias("last"))
    older = Window.partitionBy("key").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    handed = by_day.select("key", "day", F.last("last", ignorenulls=True).over(older).alias("before"))
    same_day = Window.partitionBy("key", "day").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    within = times.withColumn("now", F.max(mine).over(same_day)).join(handed, ["key", "day"], "left")
    found = within.select("key", "at", F.coalesce("now", "before").alias("best"))
    return (rows.where(~F.col("is_response")).join(found, ["key", "at"], "left")
            .select("record_id", F.col("best.id").alias("refers_to")))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """record_id, canonical_url, status (resolved, changed, unmatched), refers_to, headers of each revisit record.

    ``records``: record_id, url, at (seconds, whole), type (response or revisit), headers (map); if they have
    http_status as well, a response with another one than 200 is no full response.
    ``changed`` means that the validators disagree or that there are none to compare.
    """
    full = F.col("type") == "response"
    if "http_status" in records.columns:
        full = full & (F.coalesce("http_status", F.lit(200)) == 200)
    rows = records.select("record_id", canonical_url(F.col("url")).alias("key"), F.col("at").cast("long").alias("at"),
                          full.alias("is_response"), lowered(F.col("headers")).alias("headers"), "type")
    rows = rows.where("type IN ('response', 'revisit')").where("is_response OR type = 'revisit'")
    links = latest_earlier(rows.select("record_id", "key", "at", "is_response"))
    stored = rows.where("is_response").select(F.col("record_id").alias("refers_to"), F.col("headers").alias("stored"))
    asked = rows.where("NOT is_response").select("record_id", F.col("key").alias("canonical_url"), "headers")
    joined = asked.join(links, "record_id", "left").join(stored, "refers_to", "left")
    tag, old_tag = (F.regexp_replace(F.try_element_at(h, F.lit("etag")), r"^W/", "") for h in (F.col("headers"), F.col("stored")))
    date, old_date = (F.try_element_at(h, F.lit("last-modified")) for h in (F.col("headers"), F.col("stored")))
    agrees = F.when(tag.isNotNull() & old_tag.isNotNull(), tag == old_tag).otherwise(F.coalesce(date == old_date, F.lit(False)))
    status = F.when(F.col("refers_to").isNull(), "unmatched").when(agrees, "resolved").otherwise("changed")
    return joined.withColumn("status", status).select(
        "record_id", "canonical_url", "status", "refers_to",
        F.when(F.col("status") == "resolved", merged_headers(F.col("stored"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"))


def with_bodies(resolved: DataFrame, records: DataFrame) -> DataFrame:
    """Adds ``body`` of the response that a resolved revisit refers to."""
    bodies = records.where("type = 'response'").select(F.col("record_id").alias("refers_to"), "body")
    whole = resolved.where("status = 'resolved'").join(bodies, "refers_to")
    return whole.unionByName(resolved.where("status <> 'resolved'").withColumn("body", F.lit(None).cast("binary")))


def write_warc(records: DataFrame, out: str) -> None:
    """Writes records as WARC 1.1 files: record_id, url, at, type, headers, body (binary, may be null).

    A null id, url, time or type has no header line and is read back as null. Records are
    written by size, eight times the size with an eighth of the records a file, so ``records`` may be
    read once for each size that occurs. The text writer ends each row with the two line breaks that close a WARC record.
    """
    crlf = F.lit("\r\n")
    reason = F.when(F.col("type") == "revisit", "HTTP/1.1 304 Not Modified\r\n").otherwise("HTTP/1.1 200 OK\r\n")
    entries = F.transform(F.map_entries(F.coalesce("headers", F.expr("CAST(map() AS map<string, string>)"))),
                          lambda e: F.concat(e["key"], F.lit(": "), e["value"], crlf))
    http = F.concat(reason, F.array_join(entries, ""), crlf).cast("binary")
    block = F.concat(http, F.coalesce("body", F.lit(b"")))

    def line(name, value):
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, crlf), F.lit(""))

    head = F.concat(F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("type")),
                    line("WARC-Record-ID", F.concat(F.lit("<urn:record:"), F.col("record_id").cast("string"), F.lit(">"))),
                    line("WARC-Target-URI", F.col("url")),
                    line("WARC-Date", F.date_format(F.timestamp_seconds("at"), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
                    line("Content-Length", F.length(block).cast("string")), crlf).cast("binary")
    value = F.concat(head, block)
    limit, limits = RECORDS_PER_FILE, []
    while limit:
        limits.append(limit)
        limit //= _STEP
    # The first size whose records fit into a file at its number of records; the largest stand alone.
    fits = F.lit(len(limits))
    for k in reversed(range(len(limits))):
        fits = F.when(F.length(value) + 4 <= FILE_BYTES // limits[k], k).otherwise(fits)
    sizes = sorted(r[0] for r in records.select(fits.alias("size")).distinct().collect()) or [0]
    for n, k in enumerate(sizes):
        rows = records.where(fits == k) if len(sizes) > 1 else records
        (rows.select(value.cast("string").alias("value")).write.mode("append" if n else "overwrite")
         .option("maxRecordsPerFile", [*limits, 1][k]).option("lineSep", "\r\n\r\n").text(out))


def _members(data: memoryview) -> Iterator[memoryview]:
    """The file as it is, or each gzip member of it unpacked; a member that breaks off or is damaged is None."""
    if bytes(data[:2]) != b"\x1f\x8b":
        yield data
        return
    at = 0
    while at < len(data):
        unpack, parts = zlib.decompressobj(31), []
        try:
            while not unpack.eof and at < len(data):
                piece = data[at:at + _PIECE]
                parts.append(unpack.decompress(piece))
                at += len(piece)
            at -= len(unpack.unused_data)
        except zlib.error:
            yield None
            return
        yield memoryview(b"".join(parts)) if unpack.eof else None


def _named(lines: list[bytes]) -> list[tuple[str, str]]:
    """Header lines as name and value; a line without a colon is left out."""
    parts = (line.decode("utf-8", "replace").partition(":") for line in lines)
    return [(name.strip(), value.strip()) for name, colon, value in parts if colon]


def record_number(uri: str | None) -> int | None:
    """The number in an id of our own writer; of any other id the first 8 bytes of its sha1, as a number."""
    own = re.fullmatch(r"<?urn:record:(-?\d{1,19})>?", uri or "")
    if own:
        return int(own[1])
    return None if uri is None else int.from_bytes(hashlib.sha1(uri.encode()).digest()[:8], "big", signed=True)


_EMPTY = {c: None for c in ("record_id", "warc_id", "url", "date", "http_status", "body")}


def records_of(content: memoryview) -> Iterator[dict]:
    """The records of one WARC file, plain or gzip. What can't be read is one row of type ``malformed`` with the
    rest of its member as body."""
    for data in _members(content.cast("B")):
        at = 0
        while data is None or at < len(data):
            end = _BREAK.search(data, at) if data is not None else None
            head = {k.lower(): v for k, v in _named(bytes(data[at:end.start()]).strip().split(b"\r\n")[1:])} if end else {}
            size = head.get("content-length", "")
            if not size.isdecimal() or end.end() + int(size) > len(data):
                yield {**_EMPTY, "type": "malformed", "headers": [], "body": b"" if data is None else bytes(data[at:])}
                break
            block = bytes(data[end.end():end.end() + int(size)])
            at = end.end() + int(size)
            while bytes(data[at:at + 2]) == b"\r\n":
                at += 2
            http, _, body = block.partition(b"\r\n\r\n") if block[:5] == b"HTTP/" else (b"", b"", block)
            lines = http.split(b"\r\n")
            status = re.match(rb"HTTP/\S+ +(\d{3})\b", lines[0])
            yield {"record_id": record_number(head.get("warc-record-id")), "warc_id": head.get("warc-record-id"), "url": head.get("warc-target-uri"),
                   "date": head.get("warc-date"), "type": head.get("warc-type"), "http_status": int(status[1]) if status else None,
                   "headers": list(dict(_named(lines[1:])).items()), "body": body}


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("record_id", pa.int64()), ("warc_id", pa.string()), ("url", pa.string()), ("date", pa.string()), ("type", pa.string()),
                        ("http_status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("body", pa.binary())])
    for batch in batches:
        for content in batch.column("content"):
            rows, size = [], 0
            for row in records_of(memoryview(content.as_buffer())):
                rows.append(row)
                size += len(row["body"])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, plain or gzip: record_id, warc_id, url, at, type, http_status, headers, body.

    Parts of a second are dropped; a date that is none is null. Damaged or cut-off records are rows of type
    ``malformed``.
    """
    found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(
        _parsed, "record_id long, warc_id string, url string, date string, type string, http_status int, headers map<string, string>, body binary")
    at = F.unix_timestamp(F.try_to_timestamp(F.regexp_replace("date", r"\.\d+", ""), F.lit("yyyy-MM-dd'T'HH:mm:ssX")))
    return found.select("record_id", "warc_id", "url", at.alias("at"), "type", "http_status", "headers", "body")
