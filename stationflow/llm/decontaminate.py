"""Benchmark passages in documents, found by a prefix-filtered join of word windows.

A window is ``window`` consecutive words of an item (a shorter item is one window). For containment
the prefix filter needs one word of a window: its rarest over all documents. Document words are joined
to these prefix words only; an occurrence becomes a candidate when the window fits between the ends of
the document at its position (length and positional bounds) and the second rarest word stands where it
should; candidates are verified word by word. DataFrame functions only, no Python on the path.

Edge cases: null or wordless texts have no words and no hits; items without words or without an id take
no part; rows that repeat a document each get their own result row. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage_shuffled

_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Windows that are broadcast (about 400 bytes each); a larger benchmark is joined by a shuffle.
BROADCAST_WINDOWS = 100_000


def lower_ascii(text: Column) -> Column:
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _SMALL))


def words_of(text: Column) -> Column:
    """Runs of digits, letters and all characters from U+0080 on, A-Z lower-cased."""
    parts = F.split(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), _NOT_WORD)
    lead = (parts[0] == "").cast("int")
    tail = F.when(F.size(parts) > 1, (F.element_at(parts, -1) == "").cast("int")).otherwise(0)
    return F.slice(parts, lead + 1, F.greatest(F.size(parts) - lead - tail, F.lit(0)))


def windows_of(items: DataFrame, window: int) -> DataFrame:
    """Distinct windows and the sorted ids of the items that hold each."""
    n = F.size("words")
    starts = F.sequence(F.lit(0), F.greatest(n - window, F.lit(0)))
    return (items.where("item_id IS NOT NULL")
            .select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words"))
            .where(n > 0).withColumn("at", F.explode(starts))
            .select("item_id", F.expr(f"slice(words, at + 1, {window})").alias("words"))
            .groupBy("words").agg(F.array_sort(F.collect_set("item_id")).alias("items")))


def _exploded(docs: DataFrame) -> DataFrame:
    """One row per word, and one row with the empty word at the end that stands for the document."""
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_key"), F.spark_partition_id().alias("place"),
                       words_of(text).alias("words"))
    return rows.select("*", F.posexplode(F.concat("words", F.array(F.lit("")))).alias("pos", "word"))


def prefix_index(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """Windows with their rarest word (``word`` at ``at``) and the next rarest (``check`` at ``check_at``)."""
    found = stage_shuffled(windows_of(items, window), "windows")
    vocabulary = found.select(F.explode("words").alias("word")).distinct()
    if found.count() <= BROADCAST_WINDOWS:
        vocabulary = F.broadcast(vocabulary)
    seen = _exploded(docs).select("word").join(vocabulary, "word").groupBy("word").agg(F.count(F.lit(1)).alias("seen"))
    listed = (found.withColumn("id", F.xxhash64("words")).select("id", "words", "items", F.posexplode("words").alias("at", "word"))
              .join(seen, "word", "left"))
    rare = F.array_sort(F.collect_list(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "word", "at")))
    ranked = (listed.groupBy("id", "words").agg(F.first("items").alias("items"), rare.alias("rare"))
              .withColumn("other", F.coalesce(F.get("rare", F.lit(1)), F.get("rare", F.lit(0)))))
    return stage_shuffled(ranked.select(
        F.col("rare")[0]["word"].alias("word"), F.col("rare")[0]["at"].alias("at"), F.col("other.word").alias("check"),
        F.col("other.at").alias("check_at"), F.col("words").alias("wanted"), "items"), "prefixes")


def _by_shuffle(docs: DataFrame, index: DataFrame) -> DataFrame:
    """``find_overlaps`` for a benchmark that is not broadcast.

    Words go to the index by a shuffle with their row key and place only. The windows that a row may hold, and
    where, come back to the row, which compares them with its own words.
    """
    text, key = F.col("text").cast("string"), ["doc_id", "text_key"]
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_key"), words_of(text).alias("words"))
    begin = F.col("pos") - F.col("at")
    near = rows.select(*key, F.posexplode("words").alias("pos", "word")).join(index, "word").where(begin >= 0)
    near = near.groupBy(*key).agg(F.collect_set(F.struct(begin.alias("start"), "wanted", "items")).alias("near"))
    near = near.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text"), "near")
    same_row = (F.col("text_key") == F.col("_text")) & F.col("doc_id").eqNullSafe(F.col("_id"))

    def there(c):
        return F.slice(F.col("words"), c["start"] + 1, F.size(c["wanted"])) == c["wanted"]

    found = rows.join(near, same_row, "left").withColumn("hits", F.filter(F.coalesce(
        "near", F.expr("CAST(array() AS array<struct<start:int,wanted:array<string>,items:array<string>>>)")), there))
    span = F.transform("hits", lambda c: F.struct(c["start"].alias("start"), (c["start"] + F.size(c["wanted"])).alias("end")))
    return found.select(*key, F.size("words").cast("long").alias("n_words"), F.array_sort(F.array_distinct(span)).alias("spans"),
                        F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda c: c["items"])))).alias("items"))


def find_overlaps(docs: DataFrame, items: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, text_key, n_words, spans (sorted word ranges start..end of occurring windows), items (sorted ids).

    One row per input row.
    """
    index = prefix_index(docs, items, window)
    none = [F.lit(0).alias("at"), F.lit("").alias("check"), F.lit(0).alias("check_at"),
            F.expr("CAST(array() AS array<string>)").alias("wanted"), F.expr("CAST(array() AS array<string>)").alias("items")]
    mark = docs.sparkSession.range(1).select(F.lit("").alias("word"), *none)
    if index.count() > BROADCAST_WINDOWS:
        return _by_shuffle(docs, index)
    index = F.broadcast(index.unionByName(mark))
    begin, size = F.col("pos") - F.col("at"), F.size("wanted")
    fits = (begin >= 0) & (begin + size <= F.size("words"))
    same = (F.expr("get(words, pos - at + check_at)") == F.col("check")) & (
        F.when(fits, F.slice("words", F.greatest(begin, F.lit(0)) + 1, size)) == F.col("wanted"))
    is_mark = F.col("word") == ""
    hits = (_exploded(docs).join(index, "word").where(is_mark | (fits & same))
            .select("doc_id", "text_key", "place", F.size("words").alias("n_words"), is_mark.alias("is_mark"),
                    F.when(~is_mark, F.struct(begin.alias("start"), (begin + size).alias("end"))).alias("span"), "items"))
    per_row = hits.groupBy("doc_id", "text_key", "place").agg(
        F.max("n_words").cast("long").alias("n_words"), F.count_if("is_mark").alias("copies"),
        F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return per_row.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "copy", "place")


def covered(spans: Column) -> Column:
    """Number of words inside any of the sorted spans."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    return F.aggregate(spans, zero, lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["upto"]))).alias("n"),
        F.greatest(a["upto"], s["end"]).alias("upto")), lambda a: a["n"].cast("long"))


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, items, contaminated (``share`` * n_hit >= n_words > 0)."""
    found = find_overlaps(docs, items, window).withColumn("n_hit", covered(F.col("spans")))
    return found.select("doc_id", "text_key", "n_words", "n_hit", "spans", "items",
                        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")
