"""Runs of methods over one text, many texts or benchmark samples, with their metrics."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tone
from . import methods, metrics, rows
from . import tokens as T


def compress_text(spark: SparkSession, text: str, ratio: float = 4.0, names: tuple[str, ...] = methods.NO_MODEL) -> DataFrame:
    """What each method leaves of one text: a row a method."""
    docs = spark.createDataFrame([(0, text)], "doc_id long, text string")
    return methods.evaluate(rows.rows(docs), names, (ratio,)).drop("doc_id")


def benchmark_texts(docs: DataFrame, names: tuple[str, ...] = methods.NO_MODEL, ratios: tuple[float, ...] = (2.0, 4.0, 6.0, 8.0)) -> DataFrame:
    """(name, avg_compression_ratio, avg_token_savings_pct, num_samples) of docs (doc_id, text) for each method@ratio."""
    done = methods.evaluate_sizes(rows.rows(docs), names, ratios, with_chars=False).groupBy("method", "ratio")
    out = done.agg(F.avg("compression_ratio").alias("cr"), F.avg("token_savings_pct").alias("ts"), F.count("*").alias("num_samples"))
    name = F.format_string("%s@%.1fx", "method", "ratio").alias("name")
    return out.select(name, F.bround("cr", 2).alias("avg_compression_ratio"), F.bround("ts", 1).alias("avg_token_savings_pct"), "num_samples")


def evaluate_samples(
    samples: DataFrame,
    names: tuple[str, ...] = ("none", *methods.NO_MODEL),
    ratios: tuple[float, ...] = (2.0, 4.0, 8.0),
    generate: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """Metrics of every sample, method and ratio: the rows that metrics.cells() averages.

    samples: (doc_id, task, context, query, reference_answer).  generate
    makes the answer's column from those of the compressed context and the
    query; without one the compressed context itself is the answer, as an
    extractive summary is.  Contexts without tokens give no rows.
    """
    told = samples.where(F.col("context").rlike(rows.SOME["space"])).select("doc_id", T.TOKENIZERS["space"](F.col("context")).alias("toks"), "task", "query", F.col("reference_answer").alias("reference"))
    compressed = F.array_join("kept", " ")
    left = methods.grid(told, names, ratios).withColumn("answer", compressed if generate is None else generate(compressed, F.col("query")))
    n, m = F.col("n"), F.size("kept")
    toned = lambda c: F.size(F.filter(c, lambda x: F.length(tone.tone_marks(x)) > 0))
    answers = left.withColumns(
        {
            "pred": F.col("kept") if generate is None else T.TOKENIZERS["space"](F.col("answer")),
            "ref": T.TOKENIZERS["space"](F.coalesce("reference", F.lit(""))),
            "compression_ratio": n / F.greatest(m, F.lit(1)),
            "token_savings_pct": (n - m) / n * 100.0,
            "tone_rate": F.when(toned("toks") > 0, toned("kept") / toned("toks")),
        }
    )
    return metrics.answer_metrics(answers).drop("kept", "toks", "pred", "ref", "query", "reference", "n")


def evaluate_sample(spark: SparkSession, context: str, query: str, reference: str, method: str = "combined", ratio: float = 4.0, generate: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """One row: the metrics of one sample, with the time that it took."""
    sample = spark.createDataFrame([(0, "one", context, query, reference)], "doc_id long, task string, context string, query string, reference_answer string")
    return timed(sample, lambda m, r: evaluate_samples(sample, (m,), (r,), generate), (method,), (ratio,))


def timed(docs: DataFrame, run: Callable[[str, float], DataFrame], names: tuple[str, ...], ratios: tuple[float, ...]) -> DataFrame:
    """run(method, ratio)'s rows of every method and ratio with processing_time_ms: its wall time by the number of docs.

    Each is run by itself for that, unlike grid()'s one pass.
    """
    count = max(docs.count(), 1)
    parts = []
    for m in names:
        for r in ratios:
            out = run(m, r)
            start = time.perf_counter()
            out.write.format("noop").mode("overwrite").save()
            parts.append(out.withColumn("processing_time_ms", F.lit((time.perf_counter() - start) * 1000.0 / count)))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole
