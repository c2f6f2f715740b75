"""A corpus pipeline of five stages over the documents table.

Stages: language ID, exact dedup, near dedup, mixing by source, SentencePiece encoding. Each takes (spark, docs, sf_dir), works on
all rows that the one before kept, and returns a DataFrame that is written as Parquet and read again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapeloom.llm import bloom_exact, lang_bloom, mixing, similar, sp_bpe
from shapeloom.llm.common import release, scratch, shared_dir

#: A document whose best language has a smaller share of the corrected n-gram counts is rejected, as is one without letters.
MIN_LANG_SCORE = 0.35
#: Bytes of an encoder's stores in a Python worker, which here holds what other stages left besides.
ENCODER_ROOM = 48 << 20


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lang_bloom.keep_known(docs, lang_bloom.train(docs), MIN_LANG_SCORE)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bloom_exact.drop_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.drop_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    got = sp_bpe.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), decoded=False, room=ENCODER_ROOM)
    return got.select(F.col("_id").alias("doc_id"), F.col("_n_tokens").alias("n_tokens"), F.col("_ids").alias("ids"), F.col("_ids_sha256").alias("ids_sha256"), F.col("_decoded_sha256").alias("decoded_sha256"))


STAGES = [("language ID", language_id), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("mix", mix_sources), ("encode", encode)]

#: SQL can express neither the language filters nor fingerprints nor merges; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name.replace(' ', '-')}")
        with scratch():
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            release(last)
        last = path
    return docs
