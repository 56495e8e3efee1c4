"""Scores of tokens: surprisal, rescaling, blends, attention pooling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tokens import by_document

def document():
    return Window.partitionBy("doc_id")



def with_predecessor(toks: DataFrame) -> DataFrame:
    """Adds prev: the token before within the document, empty for the first."""
    return toks.withColumn("prev", F.coalesce(F.lag("tok").over(by_document()), F.lit("")))


def bigrams(toks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(prev, tok, c2), (prev, c1) and one row (v): pair counts, predecessor counts and vocabulary size of a corpus.

    All three come from the one shuffle of the pair counts, which combine
    before it; first tokens count as pairs of the empty predecessor.
    """
    two = with_predecessor(toks).groupBy("prev", "tok").agg(F.count("*").alias("c2"))
    one = two.groupBy("prev").agg(F.sum("c2").alias("c1"))
    return two, one, two.agg(F.count_distinct(F.when(F.col("c2") > 0, F.col("tok"))).alias("v"))


def _surprisal() -> Column:
    """-ln of the add-one probability from c2, c1 and v, to 6 decimals; 0 for a document's first token."""
    zero = F.lit(0)
    s = F.round(-F.ln((F.coalesce("c2", zero) + 1.0) / (F.coalesce("c1", zero) + F.col("v"))), 6)
    return F.when(F.col("prev") == "", F.lit(0.0)).otherwise(s)


def ngram_surprisal(toks: DataFrame) -> DataFrame:
    """Adds surprisal: -ln of the add-one bigram probability in this corpus, to 6 decimals; 0 at position 0.

    The join on a frequent pair leaves its rows to adaptive skew splitting.
    """
    two, one, size = bigrams(toks)
    model = two.join(one, "prev").join(F.broadcast(size)).select("prev", "tok", _surprisal().alias("surprisal"))
    return with_predecessor(toks).join(model, ["prev", "tok"]).select(*toks.columns, "surprisal")


def rescored(kept: DataFrame, toks: DataFrame) -> DataFrame:
    """kept with its surprisals computed again by the tokens that now precede, with the counts of the corpus toks."""
    two, one, size = bigrams(toks)
    now = with_predecessor(kept.drop("surprisal")).join(two, ["prev", "tok"], "left").join(one, "prev", "left").join(F.broadcast(size))
    return now.withColumn("surprisal", _surprisal()).select(*kept.columns)


def chunked(toks: DataFrame, size: int = 512) -> DataFrame:
    """Adds chunk_surprisal: a chunk's first token takes its successor's, but for the last token of a document."""
    opens = (F.col("pos") % size == 0) & (F.col("pos") < F.col("n") - 1)
    return toks.withColumn("chunk_surprisal", F.when(opens, F.lead("surprisal").over(by_document())).otherwise(F.col("surprisal")))


def min_max(x: Column, constant: Column | None = None) -> Column:
    """x scaled to [0, 1] within its document; where all are equal, the constant (x itself without one)."""
    low, high = F.min(x).over(document()), F.max(x).over(document())
    return F.when(high > low, (x - low) / (high - low)).otherwise(x if constant is None else constant)


def class_scale(f_class: Column) -> Column:
    """Multipliers rescaled to [0.5, 1]; unchanged where constant."""
    low, high = F.min(f_class).over(document()), F.max(f_class).over(document())
    return F.when(high > low, F.lit(0.5) + F.lit(0.5) * (f_class - low) / (high - low)).otherwise(f_class)


def auto_weights(has_surprisal: bool) -> tuple[float, float, float]:
    """Weights of surprisal, tone and class: without a surprisal the other two share."""
    return (0.4, 0.3, 0.3) if has_surprisal else (0.0, 0.5, 0.5)


def streaming_importance(sinks: int = 4, recent: int = 32) -> Column:
    """1 for the first tokens, 0.8 for the last, 0.1 between."""
    late = F.col("pos") >= F.col("n") - F.least(F.lit(recent), F.greatest(F.col("n") - sinks, F.lit(0)))
    return F.when(F.col("pos") < sinks, 1.0).when(late, 0.8).otherwise(F.lit(0.1))


def pool(x: Column, order, kernel: int = 5, how: str = "max") -> Column:
    """Pooling of stride 1; the mean counts the padding's zeros."""
    frame = order.rowsBetween(-(kernel // 2), kernel // 2)
    return F.max(x).over(frame) if how == "max" else F.sum(x).over(frame) / F.lit(float(kernel))


def attention_importance(attn: DataFrame, window: int = 32) -> DataFrame:
    """(doc_id, head, k_pos, importance): mean over the last quarter of layers, summed over the last queries."""
    layers = attn.groupBy("doc_id").agg((F.max("layer") + 1).alias("n_layers"), (F.max("q_pos") + 1).alias("n_q"))
    used = attn.join(layers, "doc_id").where((F.col("layer") >= F.col("n_layers") - F.greatest(F.floor(F.col("n_layers") / 4), F.lit(1))) & (F.col("q_pos") >= F.col("n_q") - window))
    mean = used.groupBy("doc_id", "head", "q_pos", "k_pos").agg(F.avg("w").alias("w"))
    return mean.groupBy("doc_id", "head", "k_pos").agg(F.sum("w").alias("importance"))


def layer_budgets(layers: int, budget: int, pyramid: bool = True, alpha: float = 0.3) -> list[int]:
    """The budget's share of each layer: equal, or in proportion to 1 - alpha l / layers and at least one."""
    if not pyramid:
        return [budget // layers] * layers
    share = [1.0 - alpha * i / layers for i in range(layers)]
    return [max(1, int(budget * s / sum(share))) for s in share]


def layer_budget_array(budget: Column, layers: int, pyramid: bool = True, alpha: float = 0.3) -> Column:
    """layer_budgets() of a column's budget, as an array."""
    if not pyramid:
        return F.array_repeat(F.floor(budget / layers).cast("int"), layers)
    share = [1.0 - alpha * i / layers for i in range(layers)]
    return F.transform(F.array(*map(F.lit, share)), lambda s: F.greatest(F.lit(1), F.floor(budget * s / F.lit(sum(share))).cast("int")))
