"""From raw documents to token files: toxicity, near-duplicates, contamination, mixture, token ids.

Each stage is a function (spark, docs, sf_dir) -> DataFrame whose rows are written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationflow.llm import decontaminate, mixing, near_dup, token_files, toxicity
from stationflow.llm.common import bounded, stage, stage_shuffled, staging_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Target weights of the mixture, over its domains and languages; sources of a language share evenly.
DOMAINS = {"web": 0.4, "books": 0.25, "news": 0.2, "code": 0.15, "other": 0.1}
LANGUAGES = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}
SHARE = 0.8


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a toxicity score of 0.7 or more."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs.select(*COLUMNS), model, threshold=0.7)


def without(docs: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``docs`` without the keys in ``rows``: by a broadcast while they are few, else by a shuffle."""
    listed = stage_shuffled(rows.select(*keys).distinct(), "removed")
    return docs.join(bounded(listed, listed.count()), keys, "left_anti")


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of 5-word shingle sets that are alike by 0.8 or more.

    Rows that repeat a doc_id are one document; the one with the least text stays.
    """
    docs = docs.select(*COLUMNS)
    groups = stage_shuffled(near_dup.near_duplicates(docs, width=5, percent=80), "groups")
    kept = without(docs, groups.where("NOT kept"), ["doc_id"])
    repeated = stage_shuffled(groups.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    few = bounded(repeated, repeated.count())
    single = kept.join(few, "doc_id", "left_anti")
    least = (kept.join(few, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("r"))
             .select("doc_id", "r.*"))
    return single.select(*COLUMNS).unionByName(least)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of whose words 5 % or more lie in benchmark windows."""
    docs = docs.select(*COLUMNS)
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=13, share=20)
    hit = stage_shuffled(found.where("contaminated").select("doc_id", "text_key").distinct(), "contaminated")
    listed = bounded(hit.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text")), hit.count())
    return docs.join(listed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_text")), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A mixture of ``SHARE`` of the words, by target weights; no document is repeated."""
    return mixing.mix(docs.select(*COLUMNS), share=SHARE, epochs=1, domain_weights=DOMAINS, lang_weights=LANGUAGES).select(*COLUMNS)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards and key index; what the files hold, per document."""
    return token_files.token_files(docs, staging_path(spark, "pipeline_tokens"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]

# Hashes, learnt scores and tokenizers are beyond SQL: tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
