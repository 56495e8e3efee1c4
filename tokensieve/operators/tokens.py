"""Tokens in long form (doc_id, pos, tok, n) and the features of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tone, words
from ..lexicon import DIALECT, FUNCTION_WORDS, REDUPLICATIVE_PAIRS, TEENCODE, COMPOUND_WORDS

SPACE = r"[ \t\n\r\f\x0B]+"
TOKENIZERS = {
    "space": lambda text: F.filter(F.split(text, SPACE), lambda x: x != ""),
    "word": lambda text: F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\r\f\x0B]|\n)"), 1),
    "char": lambda text: F.filter(F.split(text, ""), lambda x: x != ""),
}


def tokens(docs: DataFrame, tokenizer: str = "space", clustered: bool = True, key: str = "doc_id") -> DataFrame:
    """(doc_id, pos, tok, n): every token of each text, n as many as its text has.

    clustered deals the texts out by document before they are taken apart,
    so that windows over a document need no further shuffle: what moves is
    the compact text.  Texts without tokens have no rows.
    """
    rows = docs.select(F.col(key).alias("doc_id"), "text")
    rows = rows.repartition("doc_id") if clustered else rows
    parts = rows.select("doc_id", TOKENIZERS[tokenizer](F.col("text")).alias("toks"))
    return parts.select("doc_id", F.size("toks").alias("n"), F.posexplode("toks").alias("pos", "tok")).select("doc_id", "pos", "tok", "n")


def lexicon_words() -> list[str]:
    """A fixed list that has every kind of word: function, paired, compound, chat, dialect, content and odd ones."""
    out = [w for pair in REDUPLICATIVE_PAIRS[:12] for w in pair] + list(FUNCTION_WORDS[:20]) + [w for w in COMPOUND_WORDS[:16]]
    out += [p for w in COMPOUND_WORDS[:10] for p in w.split("_")] + list(TEENCODE)[:16] + list(DIALECT)[:12]
    return out + ["xinh_xắn", "Hà", "12,5", "test@mail.vn", "http://a.vn/x", "ab", "x", "—", "hợp", "tác", "xã", "nông", "nghiệp", "kinh_tế", "Điều"]


def lexicon_stream(docs: DataFrame) -> DataFrame:
    """Tokens whose words come from lexicon_words(), as many as each document has: in order for even doc_ids, every seventh for odd."""
    table = F.array(*map(F.lit, lexicon_words()))
    at = ((F.col("doc_id") * 31 + F.col("pos") * (F.col("doc_id") % 2 * 6 + 1)) % len(lexicon_words())).cast("int")
    return tokens(docs).select("doc_id", "pos", F.get(table, at).alias("tok"), "n")


def by_document():
    return Window.partitionBy("doc_id").orderBy("pos")


def with_tone(toks: DataFrame) -> DataFrame:
    """Adds tone_id, density, variety and w_tone."""
    marked = toks.withColumn("marks", tone.tone_marks(F.col("tok")))
    m = F.col("marks")
    out = marked.withColumns({"tone_id": tone.dominant(m), "density": tone.density(F.col("tok"), m), "variety": tone.variety(m)})
    return out.withColumn("w_tone", tone.preservation_weight(F.col("density"), F.col("variety"))).drop("marks")


def with_contrast(toks: DataFrame) -> DataFrame:
    """Adds contrast and tone_score, w_tone times contrast, to rows with tones."""
    out = toks.withColumn("contrast", tone.contrast_factor(F.col("tone_id"), by_document()))
    return out.withColumn("tone_score", F.col("w_tone") * F.col("contrast"))


def with_class(toks: DataFrame) -> DataFrame:
    """Adds word_class and f_class, its multiplier."""
    out = toks.withColumn("word_class", words.word_class(F.col("tok")))
    return out.withColumn("f_class", words.class_multiplier(F.col("word_class")))


def features(toks: DataFrame) -> DataFrame:
    """Every feature of each token."""
    return with_class(with_contrast(with_tone(toks)))


def analyse(toks: DataFrame) -> DataFrame:
    """Adds analysis: tones present, dominant tone, density, variety and preservation weight among the neighbours, as one struct."""
    made = with_contrast(with_tone(toks))
    found = tone.analysis(F.col("tok"), F.col("tone_id"), F.col("density"), F.col("variety"), F.col("tone_score"))
    return made.withColumn("analysis", found).select(*toks.columns, "analysis")
