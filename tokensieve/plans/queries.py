"""The engine's queries: callables of (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tone, words
from ..lexicon import SINO_MORPHEMES
from ..functions.rowwise import let, sized
from ..operators import dataset, methods, metrics, runners, scores, segment
from ..operators import rows as R
from ..operators import tokens as T
from ..operators.surprisal import Corpus, negative_log
from ..sources import tables
from ..sources.tables import table
from ..streaming import stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
RATIOS = (2.0, 4.0, 8.0)


def query(f):
    QUERIES[f.__name__] = f
    return f


def query_of_rows(f):
    """query_of_words() of f(spark, sf_dir, rows), whose documents have a row each."""
    for name, source in ((f.__name__, _stream_rows), (f"{f.__name__}_text", _rows)):
        QUERIES[name] = lambda spark, sf_dir, source=source: f(spark, sf_dir, source(spark, sf_dir))
    return f


def query_of_words(f):
    """Register f(spark, sf_dir, words) over the lexicon stream, and as <name>_text over the documents' own tokens."""
    for name, source in ((f.__name__, _stream), (f"{f.__name__}_text", _tokens)):
        QUERIES[name] = lambda spark, sf_dir, source=source: f(spark, sf_dir, source(spark, sf_dir))
    return f


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def spread(docs: DataFrame) -> DataFrame:
    """Deal out inputs of fewer partitions than there are cores; larger ones stay as they are."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def _tokens(spark, sf_dir):
    return T.tokens(documents(spark, sf_dir))


def _stream(spark, sf_dir):
    return T.lexicon_stream(documents(spark, sf_dir))


def _rows(spark, sf_dir):
    return R.rows(spread(documents(spark, sf_dir)))


def _stream_rows(spark, sf_dir):
    return R.lexicon_rows(spread(documents(spark, sf_dir)))


def _with_surprisal(spark, sf_dir):
    """(doc_id, toks, surprisal) of each document."""
    return Corpus(documents(spark, sf_dir)).surprisal()


# tokens and tones


@query
def tok_stats(spark, sf_dir):
    toks = T.tokens(documents(spark, sf_dir), clustered=False)
    return toks.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.sum(F.length("tok")).alias("n_chars"), F.max(F.length("tok")).alias("longest"))


@query
def tone_features(spark, sf_dir):
    """Tone features of every distinct token."""
    toks = T.tokens(documents(spark, sf_dir), clustered=False).groupBy("tok").agg(F.count("*").alias("n_used"))
    out = T.with_tone(toks)
    return out.select("tok", "n_used", "tone_id", tone.tone_name(F.col("tone_id")).alias("tone"), F.round("density", 9).alias("density"), F.col("variety").cast("int").alias("variety"), F.round("w_tone", 9).alias("w_tone"))


@query
def token_analysis(spark, sf_dir):
    """The full analysis of every token, counted by its outcome."""
    a = R.analysed(_rows(spark, sf_dir)).select("analysis.*")
    keys = ["token", F.array_join("tones_present", ",").alias("tones_present"), "dominant_tone", F.round("tone_density", 9).alias("tone_density"), "tone_variety", F.round("preservation_weight", 6).alias("preservation_weight")]
    return a.groupBy(*keys).agg(F.count("*").alias("n_used"))


@query
def tone_sequence(spark, sf_dir):
    docs = spread(documents(spark, sf_dir))
    return docs.select("doc_id", F.md5(tone.tone_digits(F.col("text")).cast("binary")).alias("digits_md5"), F.length(F.regexp_replace(tone.tone_digits(F.col("text")), "0", "")).alias("n_toned"))


@query
def tone_contrast(spark, sf_dir):
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    means = lambda c, s: F.struct(F.round(total(c) / F.size(c), 6).alias("mean_contrast"), F.round(F.array_max(c), 6).alias("max_contrast"), F.round(total(s), 4).alias("sum_score"))
    made = R.with_scores(F.col("toks"), lambda items, s: let(R.contrasts(items), lambda c: means(c, s)))
    return _rows(spark, sf_dir).select("doc_id", made.alias("c")).select("doc_id", "c.*")


@query
def is_vietnamese(spark, sf_dir):
    docs = spread(documents(spark, sf_dir))
    return docs.select("doc_id", tone.is_vietnamese(F.substring("text", 1, 500)).alias("by_prefix"), tone.is_vietnamese(F.col("text")).alias("by_text"))


@query
def strip_tone(spark, sf_dir):
    return spread(documents(spark, sf_dir)).select("doc_id", F.md5(tone.strip_tone(F.col("text")).cast("binary")).alias("stripped_md5"))


@query
def syllable_tone(spark, sf_dir):
    toks = T.tokens(documents(spark, sf_dir), clustered=False).select("tok").distinct()
    return toks.select("tok", tone.syllable_tone(F.col("tok")).alias("tone"))


@query
def tone_of_characters(spark, sf_dir):
    """Tone and use of every distinct character."""
    chars = documents(spark, sf_dir).select(F.explode(T.TOKENIZERS["char"](F.col("text"))).alias("char")).groupBy("char").agg(F.count("*").alias("n_used"))
    return chars.select("char", "n_used", tone.char_tone(F.col("char")).alias("tone_id"))


# words


@query_of_words
def word_class_dist(spark, sf_dir, toks):
    toks = T.with_class(toks)
    names = ["function", "content", "reduplicative", "compound", "other"]
    return toks.groupBy("doc_id").agg(*[F.count_if(F.col("word_class") == c).alias(c) for c in names])


@query
def word_class_of_tokens(spark, sf_dir):
    toks = T.tokens(documents(spark, sf_dir), clustered=False).groupBy("tok").agg(F.count("*").alias("n_used"))
    out = toks.withColumn("word_class", words.word_class(F.col("tok")))
    return out.select("tok", "n_used", "word_class", words.class_multiplier(F.col("word_class")).alias("multiplier"), words.class_keep(F.col("word_class")).alias("keep"))


@query_of_rows
def redup_pairs(spark, sf_dir, table):
    pairs = F.transform(let(F.col("toks"), R.partners), lambda p, i: F.when(p.isNotNull(), F.struct(i.alias("left_pos"), p.alias("right_pos"))))
    return table.select("doc_id", F.explode(F.filter(pairs, lambda x: x.isNotNull())).alias("c")).select("doc_id", "c.*")


@query_of_words
def word_normalize(spark, sf_dir, toks):
    used = toks.groupBy("tok").agg(F.count("*").alias("n_used"))
    return used.select("tok", "n_used", words.normalise(F.col("tok")).alias("norm"))


@query_of_words
def func_word_ext(spark, sf_dir, toks):
    return toks.groupBy("doc_id").agg(F.count_if(words.is_function_word(F.col("tok"))).alias("n_function"), F.count("*").alias("n_tokens"))


@query
def critical_tokens(spark, sf_dir):
    toks = T.tokens(documents(spark, sf_dir), clustered=False)
    return toks.groupBy("doc_id").agg(F.count_if(words.is_critical(F.col("tok"))).alias("n_critical"), F.count("*").alias("n_tokens"))


@query
def critical_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", words.is_critical(F.col("url")).alias("is_critical"))


@query
def sino_compounds(spark, sf_dir):
    """All pairs of the fixed list of morphemes: 93 by 93 rows."""
    one = spark.createDataFrame([(m,) for m in SINO_MORPHEMES], "a string")
    two = one.select(F.col("a").alias("b"))
    pairs = one.join(F.broadcast(two), F.col("a") != F.col("b")).select(F.concat_ws("_", "a", "b").alias("compound"))
    return pairs.where(F.length("compound") >= 6).withColumn("is_sino", segment.is_sino(F.col("compound")))


def _total(items: str, of) -> Column:
    """Sum of of(item) over an array, as a long."""
    return F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + of(x))


@query_of_rows
def word_segment(spark, sf_dir, table):
    out = segment.segment_rows(table)
    joined = F.size(F.filter("words", lambda x: x["word"].contains("_"))).cast("long").alias("n_joined")
    return out.select("doc_id", F.size("words").cast("long").alias("n_words"), joined, _total("words", lambda x: x["start"] * (F.length(x["word"]) + 1)).alias("checksum"))


@query
def segment_text(spark, sf_dir):
    """Words that the text segmenter makes of each document."""
    out = segment.segment_rows(_rows(spark, sf_dir), clean=False)
    sizes = out.select("doc_id", F.transform("words", lambda x, i: (i + 1) * F.length(x["word"])).alias("sizes"))
    return sizes.select("doc_id", F.size("sizes").cast("long").alias("n_words"), _total("sizes", lambda x: x).alias("checksum"))


@query_of_rows
def align_spans(spark, sf_dir, table):
    out = segment.segment_rows(table)
    return out.select("doc_id", let(F.struct("words", "n"), lambda d: segment.spans_in(d["words"], d["n"])).alias("c")).select("doc_id", "c.*")


@query_of_rows
def word_analysis(spark, sf_dir, table):
    """Words of all documents by their analysis; each distinct word is analysed once."""
    words_ = segment.segment_rows(table).select(F.explode_outer(F.transform("words", lambda x: x["word"])).alias("word"))
    out = segment.analyse(words_.groupBy("word").agg(F.count("*").alias("n_used")))
    return out.groupBy("norm", "tone", "word_class", "multiplier").agg(F.sum("n_used").alias("n_words"))


# compression


@query
def compress_tone(spark, sf_dir):
    return stream.compress_rows(spread(documents(spark, sf_dir)))


def _method(name: str, make, prepare=_rows, *extra: str, **options):
    def run(spark, sf_dir):
        return R.compress(prepare(spark, sf_dir), make, *extra, **options)

    run.__name__ = f"compress_{name}"
    run.__doc__ = make.__doc__
    return query(run)


def _no_surprisal(spark, sf_dir):
    return _rows(spark, sf_dir).withColumn("surprisal", F.transform("toks", lambda _: F.lit(0.5)))


def _gated(spark, sf_dir):
    """Rows with is_vi: whether the document's first 500 characters are Vietnamese."""
    docs = spread(documents(spark, sf_dir)).where(F.col("text").rlike(R.SOME["space"]))
    return docs.select("doc_id", T.TOKENIZERS["space"](F.col("text")).alias("toks"), tone.is_vietnamese(F.substring("text", 1, 500)).alias("is_vi"))


def _sentences(corpus: Corpus):
    """(doc_id, toks, of_word, v, surprisal, n_sent, sents): what the sentence filter leaves of each document."""
    sents = let(F.struct("toks", "surprisal"), lambda d: R.likely_sentences(d["toks"], d["surprisal"], methods.SENTENCE_ENDS))
    held = corpus.surprisal().withColumn("c", sents)
    return held.select("doc_id", "toks", "of_word", "v", "surprisal", "c.n_sent", "c.sents")


_method("none", R.keep_all)
_method("first", R.first)
_method("every_nth", R.every_nth)
_method("longest", R.longest)
_method("random", R.random)
_method("combined", R.combined)
_method("combined_lexicon", R.combined, _stream_rows)
_method("morph_quota", R.class_quota, _stream_rows)
_method("morph_quota_text", R.class_quota)
_method("morph_aware", R.morph_aware, _stream_rows)
_method("morph_aware_text", R.morph_aware)
_method("combined_base", R.combined_base)
_method("tone_aware", R.tone_aware, _gated, "is_vi")
_method("enhanced", R.enhanced, _with_surprisal, "surprisal")
_method("enhanced_no_scorer", R.enhanced, _no_surprisal, "surprisal", weights=scores.auto_weights(False))
_method("scorer", R.scorer, _with_surprisal, "surprisal")
_method("scorer_select", R.scorer_select)
_method("selective_no_query", R.selective_no_query)
_method("selective", R.selective)
_method("streamingllm", R.streaming_llm)
_method("snapkv", R.snapkv)


@query
def compress_llmlingua(spark, sf_dir):
    """The sentence filter, then the highest surprisals of what it left, computed again behind removed sentences."""
    corpus = Corpus(documents(spark, sf_dir), "word")
    parts = let(F.struct("toks", "surprisal", "sents", "of_word"), lambda d: R.parts_of(d["toks"], d["surprisal"], d["sents"], d["of_word"]))
    held = _sentences(corpus).select("doc_id", F.size("toks").alias("n"), "v", parts.alias("parts"))
    moved = lambda c: F.filter(F.transform(c, lambda x: x["pair"]), lambda p: p.isNotNull())
    found = corpus.pair_counts(held.select("doc_id", moved("parts").alias("pairs")))  # what is joined is only what the filter left
    again = lambda d: let(moved(d["parts"]), lambda pairs: F.transform(pairs, lambda p, i: F.struct(p["j"].alias("j"), negative_log(F.get(d["found"], i), p["c1"], d["v"]).alias("surprisal"))))
    kept = lambda d: let(again(d), lambda x: R.llmlingua(F.col("doc_id"), d["n"], d["parts"], x))
    made = let(F.struct("n", "v", "parts", "found"), lambda d: sized(d["n"], kept(d)))
    return held.join(found, "doc_id", "left").select("doc_id", made.alias("c")).select("doc_id", "c.*")


@query
def sentence_filter(spark, sf_dir):
    kept = _sentences(Corpus(documents(spark, sf_dir), "word"))
    places = lambda x: (x["at"] * 2 + x["m"] - 1).cast("long") * x["m"] / 2
    return kept.select("doc_id", _total("sents", lambda x: x["m"]).alias("n_kept"), F.size("toks").alias("n_tokens"), _total("sents", lambda x: places(x).cast("long")).alias("sum_pos"), F.col("n_sent").alias("n_sentences"))


def _attention(spark, sf_dir):
    """A small attention table: vectors as tokens, documents of 40 vectors, weights from their components."""
    vec = table(spark, sf_dir, "embeddings").select((F.col("vec_id") / 40).cast("long").alias("doc_id"), (F.col("vec_id") % 40).cast("int").alias("p"), "embedding")
    q = vec.select("doc_id", F.col("p").alias("q_pos"), F.col("embedding").alias("eq"))
    k = vec.select("doc_id", F.col("p").alias("k_pos"), F.col("embedding").alias("ek"))
    pairs = q.join(k, "doc_id").where("k_pos <= q_pos").withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.struct((i / 2).cast("int").alias("layer"), (i % 2).cast("int").alias("head")))))
    at = F.col("cell.layer") * 2 + F.col("cell.head") + 1
    w = F.element_at("eq", at).cast("double") * F.element_at("ek", at).cast("double")
    return pairs.select("doc_id", F.col("cell.layer").alias("layer"), F.col("cell.head").alias("head"), "q_pos", "k_pos", w.alias("w"))


@query
def snapkv_pool(spark, sf_dir):
    imp = scores.attention_importance(_attention(spark, sf_dir))
    order = Window.partitionBy("doc_id", "head").orderBy("k_pos")
    out = imp.withColumns({"pooled_max": scores.pool(F.col("importance"), order), "pooled_avg": scores.pool(F.col("importance"), order, how="avg")})
    return out.select("doc_id", "head", "k_pos", *[F.round(c, 5).alias(c) for c in ("importance", "pooled_max", "pooled_avg")])


@query
def h2o_importance(spark, sf_dir):
    imp = scores.attention_importance(_attention(spark, sf_dir))
    return imp.groupBy("doc_id", "k_pos").agg(F.round(F.avg("importance"), 5).alias("importance"))


@query
def evaluate_methods(spark, sf_dir):
    """Documents and tokens that each method without a model leaves."""
    done = methods.evaluate_sizes(_rows(spark, sf_dir))
    return done.groupBy("method", "ratio").agg(F.count("*").alias("n_docs"), F.sum("compressed_length").alias("n_kept"), F.sum("n_chars").alias("n_chars"))


@query
def tone_names(spark, sf_dir):
    docs = spread(documents(spark, sf_dir))
    return docs.select("doc_id", F.md5(F.array_join(tone.tone_names(F.col("text")), ",").cast("binary")).alias("names_md5"))


@query_of_words
def decoded_pieces(spark, sf_dir, toks):
    """Pieces made of the lexicon stream by marking each as a word's start, decoded and cleaned."""
    mark = F.element_at(F.array(*map(F.lit, ("▁", "Ġ", "##", "_", ""))), (F.col("pos") % 5 + 1).cast("int"))
    piece = F.concat(mark, F.col("tok")).alias("piece")
    pieces = toks.select(piece).groupBy("piece").agg(F.count("*").alias("n_used"))
    return pieces.select("piece", "n_used", words.decode_piece(F.col("piece")).alias("decoded"), words.clean_piece(F.col("piece")).alias("cleaned"))


@query
def effective_ratio(spark, sf_dir):
    """Mean compression ratio by language over its mean characters a token relative to English."""
    lang = table(spark, sf_dir, "documents").select("doc_id", "lang")
    rows = compress_tone(spark, sf_dir).join(lang, "doc_id")
    by = rows.groupBy("lang").agg(F.avg("compression_ratio").alias("ratio"), F.avg("original_length").alias("length"))
    english = by.where("lang = 'en'").select(F.col("length").alias("base"))
    tir = F.col("length") / F.col("base")
    return by.join(F.broadcast(english)).select("lang", F.round("ratio", 6).alias("ratio"), F.round(tir, 6).alias("tir"), F.round(metrics.effective_ratio(F.col("ratio"), tir), 6).alias("effective"))


@query
def ratio_grid(spark, sf_dir):
    """Four methods at three ratios from one feature table; each method ranks once for all ratios."""
    toned = lambda items, places: F.size(F.filter(places, lambda p: F.get(items, p)["d"] > 0)).cast("long")
    made = lambda items, places: [F.size(places).cast("long").alias("kept"), toned(items, places).alias("toned_kept"), F.size(F.filter(items, lambda e: e["d"] > 0)).cast("long").alias("toned")]
    cells = let(F.col("toks"), lambda toks: R.grid_cells(F.col("doc_id"), toks, ("first", "longest", "tone_only", "random"), RATIOS, made))
    wide = _rows(spark, sf_dir).select("doc_id", F.size("toks").alias("n"), F.explode_outer(cells).alias("c"))
    return wide.select("doc_id", "n", "c.toned", "c.method", "c.ratio", "c.kept", "c.toned_kept")


def _bench_rows(spark, sf_dir):
    """Metrics of benchmark samples: each turn's text is a context, the next turn its reference answer, the turn's role the task."""
    turns = _turn_pairs(spark, sf_dir)
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    samples = turns.select(key.alias("doc_id"), F.col("role").alias("task"), F.col("pred").alias("context"), F.lit("").alias("query"), F.col("ref").alias("reference_answer"))
    return runners.evaluate_samples(samples)


def _quality(out):
    names = ("compression_ratio", "rouge_l_f1", "rouge_l_precision", "rouge_l_recall", "bleu_score", "quality")
    return out.select("doc_id", "task", "method", "ratio", *[F.round(c, 6).alias(c) for c in names], "exact_match")


@query
def bench_samples(spark, sf_dir):
    """Quality of every sample, method and ratio."""
    return _quality(_bench_rows(spark, sf_dir))


@query
def demo_bench(spark, sf_dir):
    """The same of the built-in samples."""
    return _quality(runners.evaluate_samples(tables.demo_samples(spark)))


@query
def sample_counts(spark, sf_dir):
    """Built-in samples by task and in all."""
    return tables.samples_by_task(tables.demo_samples(spark))


@query
def method_bench(spark, sf_dir):
    """Every method without a model over all documents, at the ratios of the quick benchmark."""
    return runners.benchmark_texts(spread(documents(spark, sf_dir)))


@query
def bench_cells(spark, sf_dir):
    out = metrics.cells(_bench_rows(spark, sf_dir))
    return out.select("method", "task", "ratio", *[F.round(c, 6).alias(c) for c in out.columns if c.startswith("mean") or c == "exact_match_rate"], "num_samples")


@query
def bench_summary(spark, sf_dir):
    out = metrics.summary(metrics.cells(_bench_rows(spark, sf_dir)))
    return out.select("method", *[F.round(c, 6).alias(c) for c in ("avg_quality", "avg_efficiency", "harmonized_score")])


@query
def bench_rounded(spark, sf_dir):
    """Means rounded half to even, as reports show them."""
    rows = _bench_rows(spark, sf_dir).groupBy("method", "ratio").agg(F.avg("compression_ratio").alias("cr"), F.avg("token_savings_pct").alias("ts"))
    return rows.select(F.format_string("%s@%.0fx", "method", "ratio").alias("name"), F.bround("cr", 2).alias("mean_cr"), F.bround("ts", 1).alias("mean_ts"))


@query
def bench_report(spark, sf_dir):
    return metrics.report(metrics.summary(metrics.cells(_bench_rows(spark, sf_dir))))


# surprisal and blends


@query
def ngram_surprisal(spark, sf_dir):
    total = F.aggregate("surprisal", F.lit(0.0), lambda a, x: a + x)
    return _with_surprisal(spark, sf_dir).select("doc_id", F.round(total, 3).alias("sum_surprisal"), F.array_max("surprisal").alias("max_surprisal"))


@query
def chunked_surprisal(spark, sf_dir):
    moved = _with_surprisal(spark, sf_dir).select("doc_id", "surprisal", let(F.col("surprisal"), R.chunked).alias("chunked"))
    differs = let(F.struct("surprisal", "chunked"), lambda d: F.filter(d["chunked"], lambda x, i: x != F.get(d["surprisal"], i)))
    return moved.select("doc_id", F.round(F.aggregate("chunked", F.lit(0.0), lambda a, x: a + x), 3).alias("sum_chunked"), F.size(differs).cast("long").alias("n_moved"))


@query
def minmax_blend(spark, sf_dir):
    means = lambda b: F.struct(F.round(F.aggregate(b, F.lit(0.0), lambda a, x: a + x) / F.size(b), 5).alias("mean_blended"), F.round(F.array_max(b), 5).alias("max_blended"))
    made = let(F.struct("toks", "surprisal"), lambda d: R.blended(d["toks"], d["surprisal"], (0.4, 0.3, 0.3), means))
    return _with_surprisal(spark, sf_dir).select("doc_id", made.alias("c")).select("doc_id", "c.*")


# retention and text metrics


@query
def retention_report(spark, sf_dir):
    """Content, function and toned tokens before and after tone compression."""
    kinds = {"content": lambda e: e["c"] == "content", "function": lambda e: e["c"] == "function", "toned": lambda e: e["d"] > 0}

    def counts(items: Column, test) -> Column:
        before = lambda c: F.size(F.filter(items, c)).cast("long")
        after = lambda c: F.size(F.filter(items, lambda e, i: c(e) & test(i))).cast("long")
        return F.struct(*[x for k, c in kinds.items() for x in (before(c).alias(f"{k}_before"), after(c).alias(f"{k}_after"))])

    def made(toks: Column) -> Column:
        return R.with_scores(toks, lambda items, s: R.boundary(toks, F.transform(s, R.down), use=lambda test: counts(items, test)), classes=True)

    return _rows(spark, sf_dir).select("doc_id", let(F.col("toks"), made).alias("c")).select("doc_id", "c.*")


@query
def tone_preservation(spark, sf_dir):
    return metrics.tone_counts_of(_rows(spark, sf_dir))


@query
def kv_saved(spark, sf_dir):
    rows = compress_tone(spark, sf_dir)
    n, m = F.col("original_length"), F.col("compressed_length")
    return rows.select("doc_id", metrics.kv_bytes(n, m).alias("kv_bytes_saved"), metrics.kv_cache_size(n).alias("kv_cache_bytes"))


@query
def speedup(spark, sf_dir):
    """Latency before over after compression, by a linear model: a millisecond a prompt token, 20 a generated one of 32 that each read the cache."""
    rows = compress_tone(spark, sf_dir)
    prefill = lambda c: F.col(c) * 1.0
    decode = lambda c: F.lit(32.0) * (F.lit(20.0) + F.col(c) * 0.001)
    n, m = "original_length", "compressed_length"
    return rows.select("doc_id", F.round(metrics.speedup(prefill(n), decode(n), prefill(m), decode(m)), 6).alias("speedup"))


@query
def layer_budgets(spark, sf_dir):
    """Cache budgets of 32 layers for each document's tokens at ratio 4, even and as a pyramid."""
    goal = F.greatest(F.floor(F.col("n_tokens") / 4).cast("int"), F.lit(32))
    rows = tok_stats(spark, sf_dir).select("doc_id", scores.layer_budget_array(goal, 32).alias("p"), scores.layer_budget_array(goal, 32, pyramid=False).alias("e"))
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)
    return rows.select("doc_id", F.get("p", F.lit(0)).alias("first"), F.get("p", F.lit(31)).alias("last"), total("p").alias("total"), F.get("e", F.lit(0)).alias("even"))


def _turn_pairs(spark, sf_dir):
    """(conv_id, turn, role, pred, ref): each turn with the next of its conversation."""
    spec = Window.partitionBy("conv_id").orderBy("turn", "role")
    paired = table(spark, sf_dir, "conversations").withColumn("ref", F.lead("text").over(spec)).where("ref is not null")
    return paired.select("conv_id", "turn", "role", F.col("text").alias("pred"), "ref")


@query
def exact_match(spark, sf_dir):
    turns = _turn_pairs(spark, sf_dir)
    return turns.select("conv_id", "turn", metrics.exact_match(F.col("pred"), F.col("ref")).alias("is_match"))


@query
def char_overlap_f1(spark, sf_dir):
    turns = _turn_pairs(spark, sf_dir).select("conv_id", "turn", metrics.char_overlap(F.col("pred"), F.col("ref")).alias("c"))
    return turns.select("conv_id", "turn", *[F.round(f"c.{k}", 6).alias(k) for k in ("precision", "recall", "f1")])


@query
def rouge_l(spark, sf_dir):
    cut = lambda c: T.TOKENIZERS["space"](F.lower(c))
    turns = spread(_turn_pairs(spark, sf_dir)).select("conv_id", "turn", metrics.rouge_l(cut(F.col("pred")), cut(F.col("ref"))).alias("c"))
    return turns.select("conv_id", "turn", *[F.round(f"c.{k}", 6).alias(k) for k in ("precision", "recall", "f1")])


@query
def bleu(spark, sf_dir):
    cut = T.TOKENIZERS["space"]
    return metrics.bleu(_turn_pairs(spark, sf_dir).select(cut(F.col("pred")).alias("pred"), cut(F.col("ref")).alias("ref")))


@query
def tir_stats(spark, sf_dir):
    """Token ratio of each turn to the next, empty texts left out."""
    cut = T.TOKENIZERS["space"]
    pairs = _turn_pairs(spark, sf_dir).where("pred <> '' and ref <> ''")
    ratio = F.when(F.size(cut(F.col("ref"))) > 0, F.size(cut(F.col("pred"))) / F.size(cut(F.col("ref")))).otherwise(F.lit(1.0))
    t = pairs.select(ratio.alias("tir"))
    return t.agg(*[F.round(F.coalesce(f("tir"), F.lit(d)), 6).alias(n) for n, f, d in (("mean_tir", F.avg, 1.0), ("min_tir", F.min, 1.0), ("max_tir", F.max, 1.0), ("std_tir", F.stddev_samp, 0.0))])


# training rows


@query
def training_dataset(spark, sf_dir):
    rows = dataset.training_rows_of(_rows(spark, sf_dir))
    return rows.select("doc_id", "original_length", "compressed_length", F.md5(F.array_join("labels", " ").cast("binary")).alias("labels_md5"), F.array_join("tone_labels", "").alias("tone_labels"), F.md5(F.array_join("input_tokens", " ").cast("binary")).alias("input_md5"))


@query
def training_batches(spark, sf_dir):
    """Padded batches of training rows, as digests."""
    dealt = documents(spark, sf_dir).repartition(F.floor(F.col("doc_id") / 8))
    out = dataset.batches(dataset.training_rows_of(R.rows(dealt)))
    digest = lambda c: F.md5(F.array_join(F.transform(c, lambda x: F.array_join(x, " ")), "|").cast("binary"))
    width = lambda c: F.size(F.get(c, F.lit(0)))
    return out.select("batch", F.size("doc_ids").alias("n_rows"), width("input_tokens").alias("input_width"), width("labels").alias("label_width"), digest("input_tokens").alias("input_md5"), digest("attention").alias("attention_md5"), digest("labels").alias("labels_md5"), digest("tone_labels").alias("tones_md5"))


@query
def tone_loss(spark, sf_dir):
    """Loss over all tokens with a probability from each token's length, toned tokens unmasked."""
    toks = T.with_tone(T.tokens(documents(spark, sf_dir), clustered=False))
    p = F.lit(1.0) / (F.length("tok") + 1)
    return dataset.tone_loss(toks.select(p.alias("p"), F.when(F.col("tone_id") > 0, 1.0).otherwise(F.lit(0.0)).alias("mask")))


# events


@query
def event_throughput(spark, sf_dir):
    return stream.throughput(table(spark, sf_dir, "events"), "1 hour")


@query
def length_ratio_rollup(spark, sf_dir):
    """Kept tokens by method and ratio, with subtotals."""
    grid = ratio_grid(spark, sf_dir)
    return grid.rollup("method", "ratio").agg(F.sum("kept").alias("kept"), F.sum("n").alias("n"), F.count("*").alias("rows"))
