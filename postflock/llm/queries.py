"""The queries of the ten operators, with their production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, htmltext, jaccard, langid, lattice, lm, sharding, tokenfile, warc
from .core import key_crc, table

#: Appended to each document by op1.
END_ID = 2


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return tokenfile.read_files(tokenfile.write_corpus(table(spark, sf_dir, "documents"), path, END_ID))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archive(warc.write_archive(table(spark, sf_dir, "pages")))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, docs = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.learn(docs, path), path)
    return found.select("doc_id", (key_crc(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_corpus(table(spark, sf_dir, "documents"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_html": op2_html,
    "op3_warc": op3_warc,
    "op4_langid": op4_langid,
    "op5_decontam": op5_decontam,
    "op6_lattice": op6_lattice,
    "op7_lm": op7_lm,
    "op8_jaccard": op8_jaccard,
    "op9_bpe": op9_bpe,
    "op10_sharding": op10_sharding,
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc": warc.ORACLE,
    "op5_decontam": decontam.ORACLE,
    "op6_lattice": lattice.ORACLE,
    "op8_jaccard": jaccard.ORACLE,
    "op10_sharding": sharding.ORACLE,
}
