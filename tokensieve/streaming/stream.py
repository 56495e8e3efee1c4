"""Compression of streams.  A document arrives whole, so selection needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rowwise import compression


def compress_rows(docs: DataFrame, ratio: float = 4.0, k: int = 2) -> DataFrame:
    """(doc_id, lengths, ratios, compressed_text) of a batch or a stream of documents; texts without words are left out."""
    some = docs.where(F.col("text").rlike(r"[^ \t\n\r\f\x0B]"))
    return some.select("doc_id", compression(F.col("text"), ratio, k).alias("c")).select("doc_id", "c.*")


def read_documents(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """A stream of the Parquet files of documents that appear under path."""
    return spark.readStream.schema("doc_id long, text string, lang string, source string, n_chars long").option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def write_compressed(docs: DataFrame, out: str, checkpoint: str, ratio: float = 4.0):
    """Start a query that appends compressed documents as Parquet, exactly once."""
    done = compress_rows(docs, ratio)
    return done.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def throughput(events: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n, total) of events by tumbling window, late ones up to the watermark."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(
        F.col("w.start").alias("window_start"), "event_type", "n", "total"
    )
