"""Queries over the driver's tables: one per operator, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rainrisk.llm import merkle, mixing, packing, private, quality, scoring, secrets, sharding, simhash, spotsigs, trie, vectors, warc
from rainrisk.llm.common import table
from rainrisk.llm.sql import SQL  # noqa: F401  the entry point takes it from here


def op3_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.scanned(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(table(spark, sf_dir, "documents"))


def op1_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scored(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).withColumnRenamed("_in0", "doc_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derived(warc.responses(table(spark, sf_dir, "pages")))


def op11_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprinted(table(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return merkle.proven(table(spark, sf_dir, "documents"), claimed=merkle.tampered(third))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(table(spark, sf_dir, "conversations"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


QUERIES = {f.__name__: f for f in (op1_scoring, op2_mixing, op3_private, op4_quality, op5_simhash, op6_vectors, op7_sharding, op8_packing, op9_secrets, op10_warc, op11_spotsigs, op12_merkle, op13_trie)}
