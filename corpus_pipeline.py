"""A training corpus from documents: language, near copies, benchmarks, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from postflock.llm import bpe, decontam, jaccard, langid
from postflock.llm.core import stage, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Near copies share four fifths of their runs of five words. op8's contract is its own.
NEAR = jaccard.Likeness(words=5, num=4, den=5)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letter (null and empty texts too), that are of no
    clear language, or whose letters no learnt language explains better than the
    background does. If no document has a language, only those without letters go.

    Repeated rows share their lot; null keys are keys like any other, and rows of
    one key with other texts go each by their own. Texts count whole. Columns are
    handed on as they are, whatever their names; an empty table stays empty."""
    return langid.accept(docs, public_tokenizers.path(VOCABULARY))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents that with the least key stays; among rows of
    that key the one with the least hash of its text, and of repeated rows one. Rows
    without key come last. Documents without words (null and empty texts too) all stay.

    Texts count whole. Columns are handed on as they are, whatever their names; an
    empty table stays empty."""
    return jaccard.keep_one(docs, like=NEAR)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of whose words at least one in twenty is inside an occurrence of a
    benchmark item's window. Null and empty texts have no words and stay.

    Repeated rows share their lot; null keys are keys like any other, and rows of one
    key with other texts go each by their own. Texts count whole. Columns are handed
    on as they are, whatever their names; either table may be empty."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document that is left: doc_id, n_tokens, two digests, and the ids.
    A null text is as an empty one, without ids; null keys and repeated rows each give
    their row. Texts count whole. Other columns are not looked at, whatever their
    names; an empty table gives no row.

    The rows are written here, so that few long texts pass to Python at a time."""
    rows = bpe.encode_documents(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, with_ids=True, limits=bpe.SMALL_LIMITS)
    return stage(rows, "tokens")


STAGES = [("language", language), ("near_copies", near_copies), ("benchmarks", benchmarks), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: A learnt model decides in the first stage: SQL cannot say which rows stay.
ORACLE_SQL = None
