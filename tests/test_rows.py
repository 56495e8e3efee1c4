"""The methods in rows: whole texts, surprisal over many chunks, and plans that move no token."""

import re

import pytest

from tokensieve.catalog import QUERIES
from tokensieve.operators import rows, scores, surprisal
from tokensieve.operators import tokens as T


def folder(spark, tmp_path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def table_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_surprisal_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(surprisal, "CHUNK", 40)
    monkeypatch.setattr(surprisal, "BUCKET", 15)
    docs = table_of(spark, [" ".join(f"w{(i * j + i // 3) % 11}" for i in range(j)) for j in range(30)] + ["", "\n", "x"])
    corpus = surprisal.Corpus(docs)
    assert corpus.chunks > 5 and corpus.pair_buckets > 20 and corpus.word_buckets > 5
    got = {(r.doc_id, i): x for r in corpus.surprisal().collect() for i, x in enumerate(r.surprisal)}
    assert got == {(r.doc_id, r.pos): r.surprisal for r in scores.ngram_surprisal(T.tokens(docs)).collect()}
    asked = spark.createDataFrame([(1, [("w1", "w2"), ("none", "w1")]), (2, []), (3, [("w0", "w0")] * 2)], "doc_id long, pairs array<struct<prev:string,tok:string>>")
    two = {(r.prev, r.tok): r.c2 for r in scores.bigrams(T.tokens(docs))[0].collect()}
    assert {r.doc_id: r.found for r in corpus.pair_counts(asked).collect()} == {1: [two.get(("w1", "w2"), 0), 0], 3: [two.get(("w0", "w0"), 0)] * 2}


def test_sizes_of_a_long_text(spark):
    toks = table_of(spark, [" ".join(f"w{i}" for i in range(50_000))])
    got = rows.sizes(rows.rows(toks), ("first", "none"), (4.0,)).collect()
    assert {(r.method, r.original_length, r.compressed_length) for r in got} == {("first", 50_000, 12_500), ("none", 50_000, 50_000)}


#: Queries whose documents stay in one row each.
IN_ROWS = """
compress_enhanced_no_scorer
compress_llmlingua
compress_morph_aware_text
compress_morph_quota_text
compress_scorer_select
retention_report
segment_text
word_analysis
word_analysis_text
word_segment
word_segment_text
compress_morph_aware
evaluate_methods
method_bench
length_ratio_rollup
ratio_grid
align_spans_text
align_spans
training_dataset
compress_morph_quota
compress_snapkv
compress_selective
training_batches
compress_random
compress_selective_no_query
compress_combined_base
compress_tone_aware
sentence_filter
compress_combined
compress_combined_lexicon
compress_enhanced
compress_scorer
""".split()


@pytest.mark.parametrize("name", IN_ROWS)
def test_no_token_moves(spark, sf_dir, name):
    """No window, and no exchange of a row a token: what is dealt out are texts, chunks' blocks or sums."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and not re.search(r"hashpartitioning\(doc_id#\d+L?(, \w+#\d+)*, 4\), REPARTITION_BY_COL", plan)


def test_llmlingua_keeps_the_end_of_long_texts(spark, tmp_path):
    sf = folder(spark, tmp_path, [" ".join(f"w{i * i % 9973}" for i in range(140_000)), "a b c"])
    got = {r.doc_id: r for r in QUERIES["compress_llmlingua"](spark, sf).collect()}
    assert got[0].compressed_length == 35_000 and got[0].compressed_text.endswith(f" w{139_998**2 % 9973} w{139_999**2 % 9973}")
    assert got[1].compressed_text == "a b c"


def test_benchmark_ranks_in_rows(spark, sf_dir):
    """The one window is over the turns of a conversation."""
    plan = QUERIES["bench_cells"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 1
