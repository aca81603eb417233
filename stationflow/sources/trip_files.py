"""Monthly trip CSV files of mixed encodings."""

from __future__ import annotations

import csv
import unicodedata
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.cleaning import RENAME
from ..runtime import stage

# Files whose listing is broadcast; a longer listing is joined by a shuffle.
BROADCAST_FILES = 200_000
KOREAN = "MS949"
_MALFORMED = "_malformed"


@contextmanager
def java_charsets(spark: SparkSession):
    """Spark reads only a few charsets unless Java's are allowed; the setting is put back afterwards."""
    name = "spark.sql.legacy.javaCharsets"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def month_from_path(path: Column) -> Column:
    """'...(25년09월)...' -> '202509', from the last such part; the syllables may be stored composed or decomposed."""
    def either(s):
        return f"(?:{s}|{unicodedata.normalize('NFD', s)})"
    pattern = rf"^[\s\S]*\((\d{{2}}){either('년')}(\d{{2}}){either('월')}\)"
    year, month = F.regexp_extract(path, pattern, 1), F.regexp_extract(path, pattern, 2)
    return F.when(year != "", F.concat(F.lit("20"), year, month))


def file_of() -> Column:
    """Decoded path of the file a row came from."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _raw_lines(spark: SparkSession, directory: str, glob: str) -> DataFrame:
    """Undecoded lines with their file and place; a byte order mark is left out by the reader."""
    return (spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("lineSep", "\n").text(directory)
            .select(F.col("value").cast("binary").alias("line"), file_of().alias("path"), F.col("_metadata.file_size").alias("length"),
                    F.col("_metadata.file_block_start").alias("block"))
            .withColumn("at", F.monotonically_increasing_id()))


def _decodes(text: bytes, charset: str) -> bool:
    try:
        text.decode(charset)
    except UnicodeDecodeError:
        return False
    return True


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per file block and batch: its first line, whether its lines are utf-8 or cp949, how many have an odd
    number of quotes."""
    for batch in batches:
        paths, blocks = batch.column("path").dictionary_encode().indices.to_numpy(), batch.column("block").to_numpy()
        cuts = np.flatnonzero((np.diff(paths) != 0) | (np.diff(blocks) != 0)) + 1
        found = []
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            if b > a:
                lines = [line or b"" for line in batch.column("line").slice(a, b - a).to_pylist()]
                text = b"\n".join(lines)
                odd = sum(line.count(b'"') & 1 for line in lines) if b'"' in text else 0
                found.append({**{c: batch.column(c)[a].as_py() for c in ("path", "length", "block", "at")}, "line": lines[0].removesuffix(b"\r"),
                              "utf8": text.isascii() or _decodes(text, "utf-8"), "korean": text.isascii() or _decodes(text, "cp949"), "odd": odd})
        yield pa.RecordBatch.from_pylist(found, schema=_SUMMARY)


_SUMMARY = pa.schema([("path", pa.string()), ("length", pa.int64()), ("block", pa.int64()), ("at", pa.int64()), ("line", pa.binary()),
                      ("utf8", pa.bool_()), ("korean", pa.bool_()), ("odd", pa.int64())])


def file_manifest(spark: SparkSession, directory: str, glob: str = "*.csv") -> DataFrame:
    """One row per file: path, length, encoding (utf-8, cp949 or NULL), header line, odd_lines, src_month, root, glob.

    Every line of a file is looked at: the file is utf-8 if all of them are, else cp949 if all are that. One scan
    sums up each block; only these sums are shuffled. ``odd_lines`` have an odd number of quotes: they begin or
    end a record of several lines.
    """
    parts = _raw_lines(spark, directory, glob).mapInArrow(
        _summaries, "path string, length long, block long, at long, line binary, utf8 boolean, korean boolean, odd long")
    files = parts.groupBy("path", "length").agg(
        F.every("utf8").alias("utf8"), F.every("korean").alias("korean"), F.sum("odd").alias("odd_lines"),
        F.min(F.struct("block", "at", "line")).alias("first"))
    encoding = F.when(F.col("utf8"), "utf-8").when(F.col("korean"), "cp949")
    return files.select("path", "length", encoding.alias("encoding"), F.col("first.line").alias("header"), "odd_lines",
                        month_from_path(F.col("path")).alias("src_month"), F.lit(directory).alias("root"), F.lit(glob).alias("glob"))


def records(lines: DataFrame, torn: DataFrame, files: int) -> DataFrame:
    """path and line, where lines that quotes hold together are one, with their line breaks.

    A line lies inside quotes if the lines of its file before it have an odd number of them. The parity of each
    block of a ``torn`` file (one with such lines) is summed over the blocks before it, and within a block over the
    lines before, so blocks of one file are worked on at once. Lines of other files, and lines that are records by
    themselves, are not gathered.
    """
    torn = torn.select("path").distinct()
    if files <= BROADCAST_FILES:
        torn = F.broadcast(torn)
    text = F.col("line").cast("string")
    odd = (F.octet_length(text) - F.octet_length(F.replace(text, F.lit('"'), F.lit("")))) % 2
    parts = stage(lines.join(torn, "path", "left_semi").select("path", "block", "at", "line", odd.alias("odd")), "torn_lines")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    blocks = parts.groupBy("path", "block").agg(F.sum("odd").alias("n"))
    blocks = blocks.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before_block"))
    inside = Window.partitionBy("path", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("inner", F.coalesce(F.sum("odd").over(inside), F.lit(0))).join(blocks, ["path", "block"])
    placed = placed.withColumn("quotes", F.col("before_block") + F.col("inner"))
    alone = (F.col("quotes") % 2 == 0) & (F.col("odd") == 0)
    joined = (placed.where(~alone).groupBy("path", F.floor(F.col("quotes") / 2).alias("record"))
              .agg(F.array_sort(F.collect_list(F.struct("block", "at", "line"))).alias("lines"))
              .select("path", F.array_join(F.transform("lines", lambda x: x["line"].cast("string")), "\n").cast("binary").alias("line")))
    whole = lines.join(torn, "path", "left_anti").select("path", "line")
    return whole.unionByName(placed.where(alone).select("path", "line")).unionByName(joined)


def _records_of(spark: SparkSession, root: str, glob: str, manifest: DataFrame) -> DataFrame:
    """All records of the files with their path, without a carriage return at the end; blank ones are left out."""
    lines = _raw_lines(spark, root, glob)
    torn = manifest.where("odd_lines > 0")
    files = torn.count()
    lines = records(lines, torn, files) if files else lines.select("path", "line")
    ends = F.endswith(F.col("line"), F.lit(b"\r"))
    lines = lines.withColumn("line", F.when(ends, F.substring("line", F.lit(1), F.length("line") - 1)).otherwise(F.col("line")))
    return lines.where(F.length(F.trim(F.col("line").cast("string"))) > 0)


def _fields(encoding: str, header: bytes) -> list[str]:
    return next(csv.reader([bytes(header).decode(encoding)]), [])


def read_trips(spark: SparkSession, manifest: DataFrame, names: dict[str, str] = RENAME, malformed: str | None = None) -> DataFrame:
    """All files as text columns under their new names, plus ``file`` and ``src_month``.

    One scan of the text: a record is decoded and split by the (encoding, header) of its file. Only the
    distinct headers reach the driver, not the files. Quoted values may hold line breaks. ``malformed`` names
    a column that gets the text of records with too few or too many values.
    """
    manifest = stage(manifest, "manifest")
    bad = manifest.where("odd_lines % 2 = 1").select("path").head()
    if bad:
        raise ValueError(f"quote not closed: {bad.path}")
    for column, fault in (("encoding", "unknown encoding"), ("src_month", "no month in file name")):
        bad = manifest.where(F.col(column).isNull()).select("path").head()
        if bad:
            raise ValueError(f"{fault}: {bad.path}")
    kinds = manifest.groupBy("encoding", "header").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("files"),
                                                       F.first("root").alias("root"), F.first("glob").alias("glob")).collect()
    if not kinds:
        raise ValueError("no trip files found")
    number = {(k.encoding, bytes(k.header)): i for i, k in enumerate(kinds)}
    rows = F.lit(None)
    with java_charsets(spark):
        for k in kinds:
            fields = _fields(k.encoding, k.header)
            missing = sorted(set(names) - set(fields))
            if missing:
                raise ValueError(f"{k.path}: source columns missing: {missing}")
            text = F.decode("line", KOREAN) if k.encoding == "cp949" else F.col("line").cast("string")
            if bytes(k.header).count(b'"') % 2:
                raise ValueError(f"{k.path}: header over several lines")
            parsed = F.from_csv(text, _ddl([*fields, _MALFORMED]), {"escape": '"', "multiLine": "true", "columnNameOfCorruptRecord": _MALFORMED})
            chosen = F.struct(*[parsed.getField(f).alias(n) for f, n in names.items()],
                              *([parsed.getField(_MALFORMED).alias(malformed)] if malformed else []))
            mine = F.col("kind") == number[(k.encoding, bytes(k.header))]
            rows = F.when(mine, chosen).otherwise(rows)
        kind = F.coalesce(*[F.when((F.col("encoding") == e) & (F.col("header") == F.lit(h)), F.lit(i)) for (e, h), i in number.items()])
        listed = manifest.select("path", kind.alias("kind"), "header")
        if sum(k.files for k in kinds) <= BROADCAST_FILES:
            listed = F.broadcast(listed)
        lines = _records_of(spark, kinds[0].root, kinds[0].glob, manifest)
        data = lines.join(listed, "path").where(F.col("line") != F.col("header")).select(F.col("path").alias("file"), rows.alias("row"))
        return data.select("row.*", "file").withColumn("src_month", month_from_path(F.col("file")))


def _ddl(fields: list[str]) -> str:
    return ", ".join(f"`{f.replace('`', '``')}` STRING" for f in fields)


def read_lines(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Undecoded records with their file, header included, for the load completeness check."""
    where = manifest.select("root", "glob").head()
    return _records_of(spark, where.root, where.glob, manifest).select(F.col("line").alias("value"), F.col("path").alias("file"))


def read_station_list(spark: SparkSession, path: str, charset: str = KOREAN) -> DataFrame:
    """Ids of the stations currently operated: first column of a CSV, trimmed."""
    lines = spark.read.text(path).select(F.col("value").cast("binary").alias("line"))
    with java_charsets(spark):
        text = lines.select(F.decode("line", charset).alias("text"))
        first = text.select(F.trim(F.from_csv("text", "station_id STRING", {"escape": '"'}).getField("station_id")).alias("station_id"))
    header = spark.read.text(path).select(F.col("value").cast("binary").alias("line")).head()
    if header is None:
        return first
    name = F.lit(_fields("cp949" if charset == KOREAN else charset, header.line)[0])
    return first.where(F.col("station_id") != F.trim(name))
