"""The numbered queries: each applies its operator to the whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact_topk, hard_negatives, merkle, mixing, near_dup, outliers, quality, token_files, toxicity, url_filter, warc
from .common import stage, staging_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token shards and key index of all documents, written and read back."""
    import public_tokenizers

    return token_files.token_files(table(spark, sf_dir, "documents"), staging_path(spark, "token_files"),
                                   public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by a rule ensemble."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")), threshold=0.5)


@query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents."""
    return decontaminate.digests(decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13, share=20))


@query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all page urls."""
    return url_filter.verdicts(table(spark, sf_dir, "pages"), url_filter.RULES)


ORACLES["op4_url_filter"] = url_filter.oracle()

# Target weights of the example mixture.
MIX = dict(share=0.6, epochs=2, domain_weights={"web": 0.4, "books": 0.3, "news": 0.2, "code": 0.1},
           lang_weights={"en": 0.4, "de": 0.25, "fr": 0.2, "es": 0.15})


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a mixture of 60 % of all words, each read at most twice."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), **MIX)
    return mixed.select("doc_id", F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source"),
                        F.col("_tokens").alias("n_tokens"), F.col("_epoch").alias("epoch"))


@query
def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best candidates of every fiftieth vector."""
    found = exact_topk.exact_top_k(table(spark, sf_dir, "embeddings"), "id % 50 = 0", k=5, scale=256)
    return found.select("query_id", "rank", "vec_id", "score")


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), threshold=0.7)


def captures(pages: DataFrame) -> DataFrame:
    """Each page as a full response, and a revisit of its url at another time with one of four kinds of validators."""
    etag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    changed = F.concat(F.lit("Mon, 01 Jan 2024 00:00:"), F.lpad((F.col("page_id") % 60).cast("string"), 2, "0"), F.lit(" GMT"))
    start = 1_700_000_000
    response = F.struct(
        (F.col("page_id") * 2).alias("record_id"), "url", (start + F.col("page_id") * 7919 % 1000 * 600).alias("at"),
        F.lit("response").alias("type"),
        F.create_map(F.lit("ETag"), etag, F.lit("Last-Modified"), changed, F.lit("Content-Type"), F.lit("text/html"),
                     F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"),
        F.col("html").cast("binary").alias("body"))
    kind = F.col("page_id") % 4
    validators = (F.when(kind == 0, F.create_map(F.lit("ETag"), F.concat(F.lit("W/"), etag)))
                  .when(kind == 1, F.create_map(F.lit("ETag"), F.lit('"stale"')))
                  .when(kind == 2, F.create_map(F.lit("last-modified"), changed))
                  .otherwise(F.create_map(F.lit("etag"), etag, F.lit("Content-Length"), F.lit("0"))))
    revisit = F.struct(
        (F.col("page_id") * 2 + 1).alias("record_id"), "url", (start + F.col("page_id") * 104729 % 1000 * 600 + 300).alias("at"),
        F.lit("revisit").alias("type"), F.map_concat(F.create_map(F.lit("Cache-Control"), F.lit("no-cache")), validators).alias("headers"),
        F.lit(None).cast("binary").alias("body"))
    return pages.select(F.inline(F.array(response, revisit)))


@query
def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisits of all pages, written to WARC files, read back and resolved."""
    path = staging_path(spark, "warc")
    warc.write_warc(captures(table(spark, sf_dir, "pages")), path)
    resolved = warc.resolve_revisits(warc.read_warc(spark, path).drop("body"))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return resolved.select("record_id", "canonical_url", "status", "refers_to", F.array_join(lines, "\n").alias("headers"))


ORACLES["op8_warc_revisits"] = r"""
    WITH cut AS (SELECT page_id, md5(coalesce(html, '')) AS tag, 'Mon, 01 Jan 2024 00:00:' || lpad(CAST(page_id % 60 AS VARCHAR), 2, '0') || ' GMT' AS changed,
                 regexp_replace(regexp_replace(url, '#[\s\S]*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages),
    parts AS (SELECT *, regexp_extract(bare, '^[^/?]*') AS raw, substr(bare, length(regexp_extract(bare, '^[^/?]*')) + 1) AS rest FROM cut),
    named AS (SELECT *, regexp_replace(regexp_replace(lower(raw), ':(80|443)$', ''), '^www\.', '') AS host,
              CASE WHEN regexp_extract(rest, '^[^?]*') = '' THEN '/' ELSE regexp_extract(rest, '^[^?]*') END AS path,
              CASE WHEN strpos(rest, '?') > 0 THEN array_to_string(list_sort(list_filter(string_split(substr(rest, strpos(rest, '?') + 1), '&'),
                lambda p: p <> '' AND split_part(p, '=', 1) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'gclid', 'fbclid', 'ref'))), '&')
              ELSE '' END AS q FROM parts),
    keyed AS (SELECT *, host || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS key FROM named),
    stored AS (SELECT key, 1700000000 + page_id * 7919 % 1000 * 600 AS at, max(page_id) AS page_id FROM keyed GROUP BY ALL),
    asked AS (SELECT *, 1700000000 + page_id * 104729 % 1000 * 600 + 300 AS at FROM keyed),
    met AS (SELECT a.*, s.page_id AS old FROM asked a ASOF LEFT JOIN stored s ON a.key = s.key AND a.at > s.at),
    judged AS (SELECT m.*, o.tag AS old_tag, o.changed AS old_changed, CASE WHEN m.old IS NULL THEN 'unmatched'
                 WHEN m.page_id % 4 = 1 THEN 'changed' WHEN m.page_id % 4 = 2 THEN CASE WHEN m.changed = o.changed THEN 'resolved' ELSE 'changed' END
                 WHEN m.tag = o.tag THEN 'resolved' ELSE 'changed' END AS status FROM met m LEFT JOIN keyed o ON o.page_id = m.old)
    SELECT page_id * 2 + 1 AS record_id, key AS canonical_url, status, old * 2 AS refers_to,
           CASE WHEN status = 'resolved' THEN 'cache-control: no-cache' || chr(10) || 'content-type: text/html' || chr(10) || 'etag: '
                || CASE WHEN page_id % 4 = 0 THEN 'W/' ELSE '' END || '"' || old_tag || '"' || chr(10) || 'last-modified: '
                || CASE WHEN page_id % 4 = 2 THEN changed ELSE old_changed END
           WHEN page_id % 4 = 0 THEN 'cache-control: no-cache' || chr(10) || 'etag: W/"' || tag || '"'
           WHEN page_id % 4 = 1 THEN 'cache-control: no-cache' || chr(10) || 'etag: "stale"'
           WHEN page_id % 4 = 2 THEN 'cache-control: no-cache' || chr(10) || 'last-modified: ' || changed
           ELSE 'cache-control: no-cache' || chr(10) || 'content-length: 0' || chr(10) || 'etag: "' || tag || '"' END AS headers FROM judged"""


@query
def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted, written, and read back."""
    tricky = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    written = stage(chat.format_paths(chat.best_paths(chat.reply_chain(turns), branches=1)), "formatted")
    return chat.digests(written).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


@query
def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose 4-word shingle sets are alike by 0.8 or more."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


@query
def op11_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and robust outliers among all documents."""
    found = outliers.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh vector first gets the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), "id % 100 = 0", label)


# Components as whole numbers, of vectors without nulls, NaN and infinities.
_WHOLE = """whole AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)"""
ORACLES["op12_hard_negatives"] = f"""
    WITH {_WHOLE},
    scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
               FROM whole a JOIN whole b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 AND a.label IS NOT NULL AND b.label IS NOT NULL),
    positive AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
    met AS (SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
            row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS rank FROM positive p JOIN scored n
            ON p.anchor_id = n.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM met WHERE rank <= 10"""
ORACLES["op6_exact_topk"] = f"""
    WITH {_WHOLE},
    scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
               FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5"""


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root, proof and verification of all documents."""
    return merkle.manifest(table(spark, sf_dir, "documents"))


ORACLES["op13_merkle_manifest"] = merkle.oracle()
