"""One query for each operator, over whole tables and with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, packing, quality, rules, secrets, simhash, substring, tokens, urls
from .oracles import ORACLES
from .scratch import store

#: The rules that pages are judged by.
URL_RULES = [
    urls.Rule("allow", "com/"),
    urls.Rule("block", "example.com/en/"),
    urls.Rule("allow", "www.example.com/en/"),
    urls.Rule("block", "net/es/"),
    urls.Rule("block", "net/fr/"),
]
QUALITY_CUT = 0.3

__all__ = ["ORACLES", "QUERIES"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha256(column: str):
    return F.sha2(F.col(column).cast("binary"), 256)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of each document; its host is its source."""
    out = rules.judge(_table(spark, sf_dir, "documents"), host="source")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document, found in flat token files of all documents."""
    return tokens.count_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of each vector whose id is divisible by 100."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"), query_every=100, k=10)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's token ids and of their decoded text."""
    out = bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), _sha256("decoded").alias("decoded_sha256"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of each document by a classifier trained on the labels that aren't held out."""
    docs, how = _table(spark, sf_dir, "documents"), quality.Ftrl()
    weights, bias = quality.train(docs, _table(spark, sf_dir, "labels"), how)
    out = quality.classify(docs, weights, bias, how)
    return out.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on each page's URL."""
    return urls.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in each document."""
    out = secrets.scan(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", _sha256("base").alias("base_sha256"), "spans")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of each document once windows of 35 words that occur again are gone."""
    out = substring.drop_repeats(_table(spark, sf_dir, "documents"), width=35)
    return out.select("doc_id", "n_words", "n_removed", _sha256("kept").alias("kept_sha256"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    out = packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), packing.Limits(tokens=2048), end_id=1)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def instruction_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as whole examples in bins of at most 2048 tokens, 64 turns and 1536 tokens that bear loss; null bin_id beyond."""
    examples = store(packing.conversation_examples(_table(spark, sf_dir, "conversations"), public_tokenizers.path("byte_bpe_50k.json")))
    bins = packing.pack_examples(examples, packing.Limits(tokens=2048, segments=64, loss_tokens=1536))
    return examples.join(bins, "example_id").select("example_id", "n_tokens", "n_segments", "n_loss", "bin_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of each document."""
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"), distance=4, shingle=4)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_token_counts": op2_token_counts,
    "op3_nearest": op3_nearest,
    "op4_bpe": op4_bpe,
    "op5_quality": op5_quality,
    "op6_url_filter": op6_url_filter,
    "op7_secrets": op7_secrets,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_packing": op9_packing,
    "op10_simhash": op10_simhash,
    "instruction_packing": instruction_packing,
}
