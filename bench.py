"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["compress_tone", "compress_combined", "compress_morph_quota", "ratio_grid", "bench_summary", "ngram_surprisal", "tone_features", "word_segment", "tok_stats"]


def main() -> None:
    from pyspark.sql import SparkSession

    from tokensieve.catalog import QUERIES

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["tok_stats"](spark, SF_DIR).write.format("noop").mode("overwrite").save()  # starts workers, compiles
    took = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    tokens = QUERIES["tok_stats"](spark, SF_DIR).groupBy().sum("n_tokens").first()[0]
    line = {"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/")), "tokens": tokens}
    if "compress_tone" in took:
        line["compress_tone_tokens_per_sec"] = round(tokens / took["compress_tone"])
    print(json.dumps(line), flush=True)


if __name__ == "__main__":
    main()
