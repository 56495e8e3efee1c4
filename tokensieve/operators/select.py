"""Budgeted top-k within documents, and reassembly of what is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edge(k: int) -> Column:
    """Whether a token is one of its document's first or last k."""
    return (F.col("pos") < k) | (F.col("pos") >= F.col("n") - k)


def target(ratio, k: int, family: str) -> Column:
    """Tokens to keep: at least 2k for the boundary family, at least one for the identity family."""
    base = F.floor(F.col("n") / F.lit(ratio)).cast("int")
    return F.greatest(base, F.lit(2 * k if family == "boundary" else 1))


def rank_middle(toks: DataFrame, order: list[Column], k: int = 2) -> DataFrame:
    """Adds rank among the document's middle tokens, from 1, by the order given; one rank serves every ratio."""
    spec = Window.partitionBy("doc_id", "is_edge").orderBy(*order)
    return toks.withColumn("is_edge", edge(k)).withColumn("rank", F.row_number().over(spec))


def keep_ranked(ranked: DataFrame, ratio, k: int = 2, family: str = "boundary") -> DataFrame:
    """The edges and the best of the middle within the budget.

    Without a budget for the middle the boundary family keeps the edges
    alone and the identity family everything.
    """
    budget = target(ratio, k, family) - 2 * k
    keep = F.col("is_edge") | (F.col("rank") <= budget)
    return ranked.where(keep if family == "boundary" else keep | (budget <= 0))


def top_k(toks: DataFrame, score: Column, ratio: float = 4.0, k: int = 2, family: str = "boundary") -> DataFrame:
    """The edges and the highest scores between them; ties keep the earlier token."""
    return keep_ranked(rank_middle(toks, [F.round(score, 9).desc(), F.col("pos")], k), ratio, k, family)


def assemble(kept: DataFrame, *keys: str) -> DataFrame:
    """(keys, original_length, compressed_length, compression_ratio, token_savings_pct, compressed_text) of each document."""
    keys = keys or ("doc_id",)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda x: x["tok"]), " ")
    n, m = F.col("original_length"), F.col("compressed_length")
    out = kept.groupBy(*keys).agg(F.max("n").cast("long").alias("original_length"), F.count("*").alias("compressed_length"), text.alias("compressed_text"))
    return out.select(
        *keys,
        "original_length",
        "compressed_length",
        F.round(n / F.greatest(m, F.lit(1)), 6).alias("compression_ratio"),
        F.round((n - m) / F.greatest(n, F.lit(1)) * 100.0, 6).alias("token_savings_pct"),
        "compressed_text",
    )


def seeded(seed: int, *parts: Column) -> Column:
    """A hash order that any engine repeats."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))
