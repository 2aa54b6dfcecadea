"""A training corpus from raw documents: toxic ones go, one of each group of near-duplicates stays, contaminated
ones go, secrets are masked, and the rest is encoded. Each stage gets what its predecessor kept.

A stage is a function of (spark, docs, sf_dir). All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, neardup, secrets, toxicity
from tessera.llm.store import dropped, saved

#: No SQL: a network, a similarity search and a tokenizer can't be put in SQL. Tests compare with brute force.
ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go."""
    net, own = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), "score"
    while own in map(str.lower, docs.columns):
        own += "_"
    return toxicity.score(docs, net, out=own).where(F.col(own) < 0.5).drop(own)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose shingles of five words are alike by 0.8 or more, the one with the least doc_id stays."""
    return neardup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go if windows of benchmark items cover one word in twenty or more."""
    own = [f"__{c}" for c in docs.columns]
    kept = docs.toDF(*own)
    found = decontaminate.find_overlap(kept, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), text="__text")
    return decontaminate.with_verdict(found).where("not contaminated").select(*own).toDF(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each stretch that spans of secrets cover becomes ``secrets.MASK``; n_chars follows the text."""
    masked = secrets.mask_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else masked.select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, round_trips): decoding the ids gives back the text."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode_checked(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN)
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trips")


STAGES = [
    ("toxicity", toxicity_stage),
    ("near-duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("encoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
