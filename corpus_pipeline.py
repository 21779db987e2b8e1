"""From raw documents to packed token windows: quality rules, near-dedup, redaction, mixing, packing.

Each stage is one training-data operator.  It takes the documents its predecessor kept and a folder of tables, and all
but the last return the columns of ``documents``.  A result owns the tables that its stage wrote to the shared folder:
``release(result)`` deletes them once the result is written, and else they stay until the session ends.  So stages can be
chained, written in between or not, and run side by side.

Defined cases, for every stage: null and empty texts are documents of no words; null and repeated doc_ids are rows like
any other; rows that are equal in all columns stay apart but for near-dedup, which keeps one of them; very long texts are
taken whole; columns beyond those of ``documents`` are carried; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import mixing, packing, pii, quality, resemblance
from ledgerline.plans.scratch import hold, holding, materialize, release


def _stage(work: Callable) -> Callable:
    @wraps(work)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with holding() as written:
            return hold(work(spark, docs, sf_dir), written)

    return call


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie above their group's fences go.

    A null text fails; a document exactly on its fence stays; null languages and sources are groups of their own.
    """
    return quality.keep_good(docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 0.8 and more of their five-word shingles stays.

    It is that of the smallest doc_id, nulls last; of rows that tie, that of the least row hash.  All texts without words
    are copies of each other.
    """
    return resemblance.keep_one(docs)


@_stage
def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact and discovered personal data is replaced by the name of its kind.

    Of spans that overlap, the one that begins first gives the name, the longer one where they tie; a null text stays null.
    """
    return pii.redact(docs)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's quota takes it, the last time cut to the words taken.

    Documents of no words are not taken; null is a source of its own; documents that tie in the seeded order follow by size.
    """
    return mixing.mix(docs)


@_stage
def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in windows, one row a piece.

    A null text is the end id alone; tails of one length are placed in the order of the input's partitions.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("redact_personal_data", redact_personal_data),
    ("mix_sources", mix_sources),
    ("pack_windows", pack_windows),
]

#: Tokenisation and fingerprints have no SQL form; ``tests/llm`` holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, result = docs, stage(spark, docs, sf_dir)
        docs = materialize(result, name)
        release(before, result)
    return STAGES[-1][1](spark, docs, sf_dir)
