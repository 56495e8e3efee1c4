"""Metrics of compression, retention and text quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pairs, tone
from ..functions.rowwise import let
from . import rows


def exact_match(a: Column, b: Column) -> Column:
    return F.lower(F.trim(a)) == F.lower(F.trim(b))


def char_overlap(pred: Column, ref: Column) -> Column:
    """(precision, recall, f1) of the texts' distinct characters; zeros if either is empty."""

    def distinct(x: Column) -> Column:
        return F.array_distinct(F.filter(F.split(x, ""), lambda c: c != ""))

    a, b = F.size(distinct(pred)), F.size(distinct(ref))
    both = F.size(F.array_intersect(distinct(pred), distinct(ref)))
    p, r = both / F.greatest(a, F.lit(1)), both / F.greatest(b, F.lit(1))
    return F.struct(p.alias("precision"), r.alias("recall"), F.when(both > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0)).alias("f1"))


def f_measure(n: Column, pred: Column, ref: Column) -> Column:
    """(precision, recall, f1) of n tokens in common of so many each."""
    p, r = n / F.greatest(pred, F.lit(1)), n / F.greatest(ref, F.lit(1))
    return F.struct(p.alias("precision"), r.alias("recall"), F.when(n > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0)).alias("f1"))


def rouge_l(pred: Column, ref: Column) -> Column:
    """(precision, recall, f1) of two word arrays by their longest common subsequence."""
    return f_measure(pairs.lcs_length(pred, ref), F.size(pred), F.size(ref))


def sentence_bleu(hits: Column, totals: Column, pred: Column, ref: Column) -> Column:
    """BLEU of one pair from n-gram matches and n-grams by size, of texts of so many tokens.

    The k-th order without a match counts as 1 / (2 ** k n-grams), which is
    exponential smoothing; 0 without any match, or where an order has no
    n-gram.
    """
    start = F.struct(F.lit(0.0).alias("logs"), F.lit(1.0).alias("smooth"))
    step = lambda acc, x: F.struct(
        (acc["logs"] + F.ln(F.when(x["h"] > 0, x["h"] / x["t"]).otherwise(F.lit(1.0) / (acc["smooth"] * 2.0 * x["t"])))).alias("logs"),
        F.when(x["h"] > 0, acc["smooth"]).otherwise(acc["smooth"] * 2.0).alias("smooth"),
    )
    logs = F.aggregate(F.zip_with(hits, totals, lambda h, t: F.struct(h.alias("h"), t.alias("t"))), start, step)["logs"]
    brevity = F.when(pred >= ref, 1.0).otherwise(F.exp(1.0 - ref / F.greatest(pred, F.lit(1))))
    return F.when((F.array_max(hits) > 0) & (F.array_min(totals) > 0), brevity * F.exp(logs / F.size(hits))).otherwise(F.lit(0.0))


def answer_metrics(rows: DataFrame) -> DataFrame:
    """Adds rouge_l_precision, _recall and _f1, bleu_score, exact_match, quality and efficiency to answers.

    rows: word arrays pred and ref, texts answer and reference, and
    token_savings_pct.  Both metrics of words lower-case them.
    """
    low = lambda c: F.transform(c, lambda x: F.lower(x))
    seen = rows.withColumn("o", pairs.overlap(low("pred"), low("ref")))
    seen = seen.withColumn("f", f_measure(F.col("o.lcs"), F.size("pred"), F.size("ref")))
    seen = seen.withColumns(
        {
            "rouge_l_f1": F.col("f.f1"),
            "rouge_l_precision": F.col("f.precision"),
            "rouge_l_recall": F.col("f.recall"),
            "bleu_score": sentence_bleu(F.col("o.hits"), F.col("o.totals"), F.size("pred"), F.size("ref")),
            "exact_match": F.coalesce(exact_match(F.col("answer"), F.col("reference")), F.lit(False)).cast("double"),
        }
    )
    score = quality(F.col("rouge_l_f1"), F.col("bleu_score"), F.col("exact_match"))
    return seen.withColumns({"quality": score, "efficiency": F.col("token_savings_pct") / 100.0}).drop("o", "f")


def bleu(turns: DataFrame, order: int = 4) -> DataFrame:
    """One row: corpus BLEU of (pred, ref) word arrays, with clipped n-gram matches and brevity penalty."""
    seen = turns.select(F.size("pred").alias("p"), F.size("ref").alias("r"), pairs.overlap(F.col("pred"), F.col("ref")).alias("o"))
    sums = seen.agg(
        F.sum("p").alias("pred_len"), F.sum("r").alias("ref_len"), *[F.sum(F.get(f"o.{k}", F.lit(i))).alias(f"{k}{i}") for k in ("hits", "totals") for i in range(order)]
    )
    mean = sum((F.ln(F.col(f"hits{i}") / F.col(f"totals{i}")) for i in range(order)), F.lit(0.0)) / order
    found = F.least(*[F.col(f"hits{i}") for i in range(order)]) > 0
    brevity = F.when(F.col("pred_len") >= F.col("ref_len"), 1.0).otherwise(F.exp(1.0 - F.col("ref_len") / F.col("pred_len")))
    return sums.select("pred_len", "ref_len", F.round(F.when(found, brevity * F.exp(mean)).otherwise(F.lit(0.0)), 6).alias("bleu"))


def quality(rouge: Column, bleu_score: Column, match: Column) -> Column:
    zero = F.lit(0.0)
    return F.lit(0.4) * F.coalesce(rouge, zero) + F.lit(0.2) * F.coalesce(bleu_score, zero) + F.lit(0.4) * F.coalesce(match, zero)


def harmonised(q: Column, e: Column) -> Column:
    return F.lit(2.0) * q * e / (q + e + F.lit(1e-8))


def kv_bytes(n: Column, m: Column, heads: int = 32, head_dim: int = 128) -> Column:
    """Bytes of cache saved in one layer at two bytes a value."""
    return (n - m) * F.lit(2 * heads * head_dim * 2)


def kv_cache_size(n: Column, layers: int = 32, heads: int = 32, head_dim: int = 128, width: int = 2) -> Column:
    return n * F.lit(2 * layers * heads * head_dim * width)


def effective_ratio(ratio: Column, tir: Column) -> Column:
    """Compression ratio after the language's token inflation."""
    return ratio / tir


def speedup(prefill: Column, decode: Column, prefill_after: Column, decode_after: Column) -> Column:
    """Latency before over latency after, each the sum of both phases."""
    return (prefill + decode) / (prefill_after + decode_after)


def cells(rows: DataFrame) -> DataFrame:
    """Means over the samples of each (method, task, ratio); of processing_time_ms too, where rows have it."""
    timed = [F.avg("processing_time_ms").alias("mean_processing_time_ms")] if "processing_time_ms" in rows.columns else []
    return rows.groupBy("method", "task", "ratio").agg(
        F.avg("compression_ratio").alias("mean_compression_ratio"),
        F.avg("token_savings_pct").alias("mean_token_savings_pct"),
        *timed,
        F.avg("rouge_l_f1").alias("mean_rouge_l_f1"),
        F.avg("bleu_score").alias("mean_bleu"),
        F.avg("exact_match").alias("exact_match_rate"),
        F.avg("quality").alias("mean_quality_score"),
        F.avg("efficiency").alias("mean_efficiency_score"),
        F.avg("tone_rate").alias("mean_tone_preservation_rate"),
        F.count("*").alias("num_samples"),
    )


def summary(cell_rows: DataFrame) -> DataFrame:
    """Unweighted means over cells and their harmonised score for each method."""
    out = cell_rows.groupBy("method").agg(F.avg("mean_quality_score").alias("avg_quality"), F.avg("mean_efficiency_score").alias("avg_efficiency"))
    return out.withColumn("harmonized_score", harmonised(F.col("avg_quality"), F.col("avg_efficiency")))


def report(summary_rows: DataFrame, digits: int = 4) -> DataFrame:
    """One Markdown row a method, best first; the summary has a row a method, so one task orders it."""
    line = F.format_string(f"| %s | %.{digits}f | %.{digits}f | %.{digits}f |", "method", "avg_quality", "avg_efficiency", "harmonized_score")
    return summary_rows.orderBy(F.col("harmonized_score").desc(), "method").select(line.alias("line"))


def tone_counts(toks: DataFrame, kept: DataFrame) -> DataFrame:
    """(doc_id, toned_tokens, toned_chars_kept, toned_tokens_kept, tone_char_token_rate, tone_token_rate)."""

    def marks() -> Column:
        return tone.tone_marks(F.col("tok"))

    before = toks.groupBy("doc_id").agg(F.count_if(F.length(marks()) > 0).alias("toned_tokens"))
    after = kept.groupBy("doc_id").agg(F.sum(F.length(marks())).alias("toned_chars_kept"), F.count_if(F.length(marks()) > 0).alias("toned_tokens_kept"))
    rate = lambda c: F.round(F.when(F.col("toned_tokens") > 0, F.col(c) / F.col("toned_tokens")).otherwise(F.lit(1.0)), 6)
    return before.join(after, "doc_id").withColumns({"tone_char_token_rate": rate("toned_chars_kept"), "tone_token_rate": rate("toned_tokens_kept")})


def tone_counts_of(table: DataFrame) -> DataFrame:
    """tone_counts() of rows (doc_id, toks) and what tone compression keeps of them, within each row."""

    def counts(toks: Column, items: Column, test) -> Column:
        marks = lambda i: F.length(tone.tone_marks(F.get(toks, i))).cast("long")
        toned = F.filter(F.transform(items, lambda e, i: F.when((e["d"] > 0) & test(i), marks(i))), lambda x: x.isNotNull())
        before = F.size(F.filter(items, lambda e: e["d"] > 0)).cast("long").alias("toned_tokens")
        chars = F.aggregate(toned, F.lit(0).cast("long"), lambda a, x: a + x).alias("toned_chars_kept")
        return F.struct(before, chars, F.size(toned).cast("long").alias("toned_tokens_kept"))

    def made(toks: Column) -> Column:
        return rows.with_scores(toks, lambda items, s: rows.boundary(toks, F.transform(s, rows.down), use=lambda test: counts(toks, items, test)))

    rate = lambda c: F.round(F.when(F.col("toned_tokens") > 0, F.col(c) / F.col("toned_tokens")).otherwise(F.lit(1.0)), 6)
    out = table.select("doc_id", let(F.col("toks"), made).alias("c")).select("doc_id", "c.*")
    return out.withColumns({"tone_char_token_rate": rate("toned_chars_kept"), "tone_token_rate": rate("toned_tokens_kept")})
