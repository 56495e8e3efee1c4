"""Training rows: token arrays, tone labels and a seeded compressed copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rowwise import let
from . import rows
from .scores import document
from .select import seeded
from .tokens import with_tone


def training_rows(toks: DataFrame, ratio: float = 4.0, most: int = 512, least: int = 10, k: int = 2, seed: int = 42) -> DataFrame:
    """(doc_id, original_length, compressed_length, labels, tone_labels, input_tokens) of documents of ``least`` tokens or more.

    Texts are cut at ``most`` tokens.  Up to 2k kept tokens are the first
    ones; else both ends and a seeded sample between.
    """
    cut = with_tone(toks.where(F.col("pos") < most)).withColumn("m", F.count("*").over(document()).cast("int")).where(F.col("m") >= least)
    goal = F.greatest(F.floor(F.col("m") / F.lit(ratio)).cast("int"), F.lit(1))
    cut = cut.withColumn("goal", goal).withColumn("is_edge", (F.col("pos") < k) | (F.col("pos") >= F.col("m") - k))
    order = Window.partitionBy("doc_id", "is_edge").orderBy(seeded(seed, F.col("doc_id"), F.col("pos")))
    drawn = F.col("is_edge") | (F.row_number().over(order) <= F.col("goal") - 2 * k)
    kept = cut.withColumn("keep", F.when(F.col("goal") <= 2 * k, F.col("pos") < F.col("goal")).otherwise(drawn))
    row = F.array_sort(F.collect_list(F.struct("pos", "tok", "tone_id", "keep")))
    out = kept.groupBy("doc_id").agg(F.max("m").alias("original_length"), row.alias("row"))
    return out.select(
        "doc_id",
        "original_length",
        F.size(F.filter("row", lambda x: x["keep"])).alias("compressed_length"),
        F.transform("row", lambda x: x["tok"]).alias("labels"),
        F.transform("row", lambda x: x["tone_id"]).alias("tone_labels"),
        F.transform(F.filter("row", lambda x: x["keep"]), lambda x: x["tok"]).alias("input_tokens"),
    )


def training_rows_of(table: DataFrame, ratio: float = 4.0, most: int = 512, least: int = 10, k: int = 2, seed: int = 42) -> DataFrame:
    """training_rows() of rows (doc_id, toks), each made within its own row."""

    def made(labels: Column) -> Column:
        m = F.size(labels)
        goal = F.greatest(F.floor(m / F.lit(ratio)).cast("int"), F.lit(1))
        keys = F.transform(labels, lambda _, i: F.concat(seeded(seed, F.col("doc_id"), i), i.cast("string")))
        kept = F.when(goal <= 2 * k, F.slice(labels, 1, goal)).otherwise(rows.best(labels, keys, goal - 2 * k, k, at=rows.seeded_place))
        tones = F.transform(rows.featured(labels), lambda e: e["d"])
        return F.struct(m.alias("original_length"), labels.alias("labels"), tones.alias("tone_labels"), kept.alias("input_tokens"))

    made_of = let(F.slice("toks", 1, most), made)
    some = table.where(F.size("toks") >= least).select("doc_id", made_of.alias("c"))
    return some.select("doc_id", "c.original_length", F.size("c.input_tokens").alias("compressed_length"), "c.labels", "c.tone_labels", "c.input_tokens")


def pad(array: Column, length: int, value) -> Column:
    """The array cut or filled up to a length."""
    return F.slice(F.concat(array, F.array_repeat(F.lit(value), length)), 1, length)


def batches(made: DataFrame, size: int = 8, fill: str = "", ignore: str = "-100") -> DataFrame:
    """(batch, doc_ids, input_tokens, attention, labels, tone_labels): training rows padded to the longest of their batch.

    A batch is the rows of ``size`` consecutive doc_ids.  Inputs are padded
    by fill, labels by ignore, tones by 0; attention is 1 where an input
    isn't padding.
    """
    batch = F.floor(F.col("doc_id") / size).alias("batch")
    row = F.struct("doc_id", "input_tokens", "labels", "tone_labels")
    held = made.groupBy(batch).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    longest = lambda c: F.array_max(F.transform("rows", lambda x: F.size(x[c])))
    sized = held.withColumns({"m": longest("input_tokens"), "n": longest("labels")})
    padded = lambda c, length, value: F.transform("rows", lambda x: _padded(x[c], F.col(length), value)).alias(c)
    ones = F.transform("rows", lambda x: _padded(F.transform(x["input_tokens"], lambda _: F.lit(1)), F.col("m"), 0)).alias("attention")
    ids = F.transform("rows", lambda x: x["doc_id"]).alias("doc_ids")
    return sized.select("batch", ids, padded("input_tokens", "m", fill), ones, padded("labels", "n", ignore), padded("tone_labels", "n", 0))


def _padded(array: Column, length: Column, value) -> Column:
    return F.concat(array, F.array_repeat(F.lit(value), length - F.size(array)))


def tone_loss(rows: DataFrame, weight: float = 0.1) -> DataFrame:
    """One row: masked mean of -ln p, of (p, mask), times the weight."""
    total = F.sum(-F.ln("p") * F.col("mask")) / (F.sum("mask") + F.lit(1e-8))
    return rows.agg(F.round(F.lit(weight) * total, 6).alias("loss"))
