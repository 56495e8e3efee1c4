"""A corpus from raw documents to packed sequences, as stages that write and reread Parquet."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokensieve.llm import packing, rules, secrets, simhash, substring
from tokensieve.llm.scratch import release_since, store, stored

#: Byte-level BPE and bin packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the base rules and their host's verdict keep.

    Null, empty and short texts go, a null host is never rejected, rows
    that repeat are judged each; extra columns stay; an empty table gives
    an empty result, in this stage and all others.
    """
    return rules.keep_documents(docs, host="source")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of the smallest doc_id, of each group that links of 0.8 or more on five-word shingles join.

    Repeated rows and rows with a null doc_id belong to groups like others;
    null doc_ids come last, ties go to the least text hash, then the least
    row.  Texts without words are one group.
    """
    return simhash.drop_similar(docs, shingle=5, similarity=0.8)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the windows of 35 words that occur again; untouched texts stay as they are.

    Every occurrence goes, the first included, as in the operator's query:
    what whole documents share has been settled by the stage before, and
    what is left is passages that are pasted into documents on other
    things.  A document that loses every word goes; null and empty texts,
    and null and repeated doc_ids, stay.
    """
    return substring.cut_documents(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret found replaced; all rows stay, null texts too."""
    masked = secrets.mask_documents(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens.

    A null text is an end id alone; rows that repeat a doc_id are packed each.
    """
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("secret_scan", secret_scan),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stored before the next reads it; what a stage stored besides goes with it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = stored()
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
        release_since(mark, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
