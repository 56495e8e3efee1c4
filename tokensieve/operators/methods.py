"""Compression methods by name: token tables in, kept tokens out.

Every method keeps the k first and last tokens.  The boundary family keeps
only those where a document is too short for a budget; the identity family
keeps the whole document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tone, words
from ..lexicon import CLASS_KEEP, REDUPLICATIVE_KEYS
from . import rows
from .scores import class_scale, document, min_max, rescored, streaming_importance
from .select import edge, keep_ranked, rank_middle, seeded, target, top_k
from .tokens import by_document, features, with_class, with_contrast, with_tone

SEED = 42


def keep_all(toks: DataFrame, ratio: float = 4.0) -> DataFrame:
    return toks


def first(toks: DataFrame, ratio: float = 4.0) -> DataFrame:
    return keep_ranked(rank_middle(toks, [F.col("pos")]), ratio)


def every_nth(toks: DataFrame, ratio: float = 4.0, k: int = 2) -> DataFrame:
    """Every step-th middle token, step the middle's size over the budget, rounded down; then the first of those."""
    budget = target(ratio, k, "boundary") - 2 * k
    middle = F.col("n") - 2 * k
    step = F.greatest(F.floor(middle / F.greatest(budget, F.lit(1))).cast("int"), F.lit(1))
    place = F.col("pos") - k
    return toks.where(edge(k) | ((place % step == 0) & (F.floor(place / step) < budget)))


def longest(toks: DataFrame, ratio: float = 4.0) -> DataFrame:
    return top_k(toks, F.length("tok"), ratio)


def random(toks: DataFrame, ratio: float = 4.0, seed: int = SEED) -> DataFrame:
    return keep_ranked(rank_middle(toks, [seeded(seed, F.col("doc_id"), F.col("pos"))]), ratio)


def tone_only(toks: DataFrame, ratio: float = 4.0) -> DataFrame:
    return top_k(with_contrast(with_tone(toks)), F.col("tone_score"), ratio)


def combined(toks: DataFrame, ratio: float = 4.0, tone_weight: float = 0.5) -> DataFrame:
    score = F.lit(tone_weight) * F.col("tone_score") + F.lit(1.0 - tone_weight) * F.col("f_class")
    return top_k(features(toks), score, ratio)


def class_quota(toks: DataFrame, ratio: float = 4.0, k: int = 2, seed: int = SEED) -> DataFrame:
    """A seeded sample of each class's middle tokens by its keep share; the ratio plays no part."""
    classed = with_class(toks).withColumn("is_edge", edge(k))
    group = Window.partitionBy("doc_id", "is_edge", "word_class")
    order = group.orderBy(seeded(seed, F.col("doc_id"), F.col("pos")))
    quota = F.floor(F.count("*").over(group) * words.class_keep(F.col("word_class")))
    return classed.withColumns({"rank": F.row_number().over(order), "quota": quota}).where("is_edge or rank <= quota")


def _gated(toks: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds is_vi: whether the document's first 500 characters are Vietnamese."""
    gate = docs.select("doc_id", tone.is_vietnamese(F.substring("text", 1, 500)).alias("is_vi"))
    return toks.join(gate, "doc_id")


def _clamped(low: float = 0.5, high: float = 3.0):
    return F.least(F.greatest(F.col("tone_score"), F.lit(low)), F.lit(high))


def tone_aware(toks: DataFrame, docs: DataFrame, ratio: float = 4.0) -> DataFrame:
    """base_score times the clamped tone score; base_score alone for texts in other languages."""
    scored = _gated(with_contrast(with_tone(toks)), docs)
    score = F.when(F.col("is_vi"), F.col("base_score") * _clamped()).otherwise(F.col("base_score"))
    return top_k(scored, score, ratio, family="identity")


def combined_base(toks: DataFrame, ratio: float = 4.0, tone_weight: float = 0.5) -> DataFrame:
    score = F.col("base_score") * (F.lit(tone_weight) * _clamped() + F.lit(1.0 - tone_weight) * F.col("f_class"))
    return top_k(features(toks), score, ratio, family="identity")


def pair_partners(toks: DataFrame, reach: int = 3) -> DataFrame:
    """Adds partner: the place of the first token within reach that pairs with this one in exact case, else null."""
    keys = sorted(k for k in REDUPLICATIVE_KEYS if "_" in k)
    partner = F.coalesce(
        *[F.when(F.concat(F.col("tok"), F.lit("_"), F.lead("tok", i).over(by_document())).isin(*keys), F.col("pos") + i) for i in range(1, reach + 1)]
    )
    return toks.withColumn("partner", partner)


def _with_pairs(toks: DataFrame, reach: int = 3) -> DataFrame:
    """Adds is_left and is_right: the token's part in pairs."""
    paired = pair_partners(toks, reach)
    claimed = [F.coalesce(F.lag("partner", i).over(by_document()) == F.col("pos"), F.lit(False)) for i in range(1, reach + 1)]
    right = claimed[0]
    for c in claimed[1:]:
        right = right | c
    return paired.withColumns({"is_left": F.col("partner").isNotNull(), "is_right": right})


def morph_aware(toks: DataFrame, ratio: float = 4.0, k: int = 2) -> DataFrame:
    """Budgets by class, best scores within each; the right word of a pair goes, its left counts one and a half."""
    paired = _with_pairs(with_class(toks)).withColumn("is_edge", edge(k))
    mult = F.when(F.col("is_right"), 0.1).when(F.col("is_left"), F.least(F.col("f_class") * 1.5, F.lit(3.0))).otherwise(F.col("f_class"))
    group = Window.partitionBy("doc_id", "is_edge", "word_class")
    share = words.class_keep(F.col("word_class"))
    weight = F.count("*").over(group) * share
    middle = Window.partitionBy("doc_id", "is_edge")
    total = sum((F.sum((F.col("word_class") == c).cast("long")).over(middle) * F.lit(v) for c, v in CLASS_KEEP.items()), F.lit(0.0))
    sized = paired.withColumns({"score": F.round(F.col("base_score") * mult, 9), "weight": weight, "total": total})
    budget = F.floor(F.greatest(target(ratio, k, "identity") - 2 * k, F.lit(0)) * F.col("weight") / F.greatest(F.col("total"), F.lit(1.0)))
    ranked = sized.withColumn("rank", F.row_number().over(group.orderBy(F.col("score").desc(), "pos")))
    return ranked.where(F.col("is_edge") | ((F.col("rank") <= budget) & ~F.col("is_right")))


def blend(toks: DataFrame, weights: tuple[float, float, float] = (0.4, 0.3, 0.3)) -> DataFrame:
    """Adds blended: surprisal, tone and class scores, each scaled within the document, by weights that sum to 1."""
    total = sum(weights)
    half = F.lit(0.5)
    parts = [min_max(F.col(c), half) * F.lit(w / total) for c, w in zip(("surprisal", "tone_score", "f_class"), weights)]
    return features(toks).withColumn("blended", parts[0] + parts[1] + parts[2])


def enhanced(toks: DataFrame, ratio: float = 4.0, weights: tuple[float, float, float] = (0.4, 0.3, 0.3)) -> DataFrame:
    return top_k(blend(toks, weights), F.col("blended"), ratio, family="identity")


def scorer(toks: DataFrame, ratio: float = 4.0, weights: tuple[float, float, float] = (0.4, 0.3, 0.3)) -> DataFrame:
    """Scaled surprisal, raw tone and half-scaled class scores; the sum scaled once more."""
    total = sum(weights)
    made = features(toks).withColumn(
        "summed", F.lit(weights[0] / total) * min_max(F.col("surprisal"), F.lit(0.5)) + F.lit(weights[1] / total) * F.col("tone_score") + F.lit(weights[2] / total) * class_scale(F.col("f_class"))
    )
    return top_k(made.withColumn("final", min_max(F.col("summed"), F.lit(0.5))), F.col("final"), ratio, family="identity")


def scorer_select(toks: DataFrame, ratio: float = 4.0) -> DataFrame:
    """First and last token and the best between, by scaled base score times tone weight in [1, 3]."""
    scaled = with_contrast(with_tone(toks)).withColumn("base", min_max(F.col("base_score")))
    score = F.col("base") * _clamped(1.0, 3.0)
    ranked = rank_middle(scaled, [F.round(score, 9).desc(), F.col("pos")], k=1)
    budget = F.floor(F.col("n") / F.lit(ratio)).cast("int")
    return ranked.where(F.col("is_edge") | (F.col("rank") <= budget - 2) | (budget >= F.col("n")))


SENTENCE_ENDS = (".", "!", "?", "\n", "。", "！", "？")


def with_sentences(toks: DataFrame, longest: int = 200) -> DataFrame:
    """Adds sent: a sentence ends behind a terminator token or at ``longest`` tokens."""
    ends = F.coalesce(F.lag(F.col("tok").isin(*SENTENCE_ENDS).cast("int")).over(by_document()), F.lit(0))
    run = toks.withColumn("run", F.sum(ends).over(by_document()))
    place = F.row_number().over(Window.partitionBy("doc_id", "run").orderBy("pos")) - 1
    return run.withColumn("part", F.floor(place / longest).cast("int")).withColumn("sent", F.col("run") * 1000000 + F.col("part"))


def sentence_filter(toks: DataFrame, ratio: float = 4.0) -> DataFrame:
    """Of four sentences or more, the max(3, target / 50) of the highest mean surprisal, in order."""
    sents = with_sentences(toks)
    mean = F.round(F.avg("surprisal").over(Window.partitionBy("doc_id", "sent")), 6)
    scored = sents.withColumn("mean", mean)
    order = Window.partitionBy("doc_id").orderBy(F.col("mean").desc(), "sent")
    # dense_rank counts sentences, for (mean, sent) is one value for each
    ranked = scored.withColumns({"srank": F.dense_rank().over(order), "n_sent": F.size(F.collect_set("sent").over(document()))})
    goal = F.greatest(F.floor(F.col("n") / F.lit(ratio)).cast("int"), F.lit(1))
    limit = F.greatest(F.lit(3), F.floor(goal / 50).cast("int"))
    return ranked.where((F.col("n_sent") < 4) | (F.col("srank") <= limit)).drop("mean", "srank")


def llmlingua(toks: DataFrame, ratio: float = 4.0, k: int = 2) -> DataFrame:
    """The sentence filter; then, of texts still beyond one and a half targets, the highest surprisals of what it left.

    These are computed again: a token behind a removed sentence has another
    predecessor.
    """
    goal = F.greatest(F.floor(F.col("n") / F.lit(ratio)).cast("int"), F.lit(1))
    kept = rescored(sentence_filter(toks, ratio), toks)
    kept = kept.withColumns({"goal": goal, "m": F.count("*").over(document()).cast("int"), "at": F.row_number().over(by_document()) - 1})
    kept = kept.withColumn("is_edge", (F.col("at") < k) | (F.col("at") >= F.col("m") - k))
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id", "is_edge").orderBy(F.col("surprisal").desc(), "pos")))
    budget = F.greatest(F.col("goal") - 2 * k, F.lit(0))
    whole = (F.col("m") <= F.col("goal") * 1.5) | (budget <= 0)
    return ranked.where(F.col("is_edge") | whole | (F.col("rank") <= budget))


def streaming_llm(toks: DataFrame, ratio: float = 4.0, k: int = 2, cap: int = 512) -> DataFrame:
    """Best of the static importance within min(cap, target); the whole middle without a budget."""
    scored = toks.withColumn("importance", streaming_importance())
    return _capped(rank_middle(scored, [F.col("importance").desc(), F.col("pos")], k), ratio, k, cap)


def _capped(ranked: DataFrame, ratio: float, k: int, cap: int) -> DataFrame:
    budget = F.least(F.lit(cap), target(ratio, k, "identity")) - 2 * k
    return ranked.where(F.col("is_edge") | (F.col("rank") <= budget) | (budget <= 0))


def snapkv(heads: DataFrame, ratio: float = 4.0, k: int = 2, cap: int = 512) -> DataFrame:
    """Union over heads of each head's best pooled importance; heads has (doc_id, head, pos, tok, n, pooled)."""
    spec = Window.partitionBy("doc_id", "head", "is_edge").orderBy(F.round("pooled", 9).desc(), "pos")
    ranked = heads.withColumn("is_edge", edge(k)).withColumn("rank", F.row_number().over(spec))
    return _capped(ranked, ratio, k, cap).groupBy("doc_id", "pos").agg(F.min("tok").alias("tok"), F.max("n").alias("n"))


def selective(toks: DataFrame, ratio: float = 4.0) -> DataFrame:
    """Best cosine similarity to the query, toks' column similarity; without a query, and so without that column, a seeded sample."""
    if "similarity" not in toks.columns:
        return keep_ranked(rank_middle(toks, [seeded(SEED, F.col("doc_id"), F.col("pos"))]), ratio, family="identity")
    return top_k(toks, F.col("similarity"), ratio, family="identity")


REGISTRY: dict[str, Callable[..., DataFrame]] = {
    "none": keep_all,
    "first": first,
    "every_nth": every_nth,
    "longest": longest,
    "random": random,
    "tone_only": tone_only,
    "morph_only": class_quota,
    "combined": combined,
    "tone_aware": tone_aware,
    "morph_aware": morph_aware,
    "combined_base": combined_base,
    "enhanced": enhanced,
    "scorer": scorer,
    "scorer_select": scorer_select,
    "llmlingua": llmlingua,
    "streamingllm": streaming_llm,
    "snapkv": snapkv,
    "selective": selective,
}


def compress(name: str, toks: DataFrame, **options) -> DataFrame:
    """The kept tokens of a method by name."""
    if name not in REGISTRY:
        raise ValueError(f"unknown method {name!r}; there are {', '.join(REGISTRY)}")
    return REGISTRY[name](toks, **options)


#: The methods that need nothing but tokens.
NO_MODEL = ("tone_only", "morph_only", "combined", "random", "first", "longest")


def checked(names: tuple[str, ...]) -> tuple[str, ...]:
    """The names, which must be of NO_MODEL and none."""
    unknown = set(names) - {"none", *NO_MODEL}
    if unknown:
        raise ValueError(f"{', '.join(sorted(unknown))} can't be had from tokens alone; {', '.join((*NO_MODEL, 'none'))} can")
    return names


def grid(toks: DataFrame, names: tuple[str, ...] = NO_MODEL, ratios: tuple[float, ...] = (4.0,)) -> DataFrame:
    """(doc_id, n, toks, method, ratio, kept) of each document for every method and ratio, in one pass over the tokens.

    Each method ranks once for all ratios.  kept holds the tokens left, in
    order, toks all of them.  names are of NO_MODEL and none.  toks is a
    token table, or has a row (doc_id, toks) for each document.
    """
    checked(names)
    return rows.grid(toks if "toks" in toks.columns else rows.gathered(toks), names, ratios)


def evaluate(toks: DataFrame, names: tuple[str, ...] = NO_MODEL, ratios: tuple[float, ...] = (4.0,)) -> DataFrame:
    """The compressed documents of every method and ratio, with columns method and ratio, as assemble() gives them."""
    done = grid(toks, names, ratios).select(
        "doc_id", "method", "ratio", F.col("n").cast("long").alias("original_length"), F.size("kept").cast("long").alias("compressed_length"), F.array_join("kept", " ").alias("compressed_text")
    )
    return _with_rates(done)


def evaluate_sizes(table: DataFrame, names: tuple[str, ...] = NO_MODEL, ratios: tuple[float, ...] = (4.0,), with_chars: bool = True) -> DataFrame:
    """evaluate() of rows (doc_id, toks) with the number of characters, n_chars, if asked for, instead of the text."""
    return _with_rates(rows.sizes(table, checked(names), ratios, with_chars))


def _with_rates(done: DataFrame) -> DataFrame:
    n, m = F.col("original_length"), F.col("compressed_length")
    return done.withColumns({"compression_ratio": F.round(n / F.greatest(m, F.lit(1)), 6), "token_savings_pct": F.round((n - m) / F.greatest(n, F.lit(1)) * 100.0, 6)})
