"""Word classes, normal forms and critical patterns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lexicon import CLASS_KEEP, CLASS_MULTIPLIER, DIALECT, ENHANCED_MULTIPLIER, FUNCTION_WORDS, REDUPLICATIVE_KEYS, TEENCODE

#: Patterns whose tokens are never dropped, in RE2 and Java syntax alike.
CRITICAL = (r"\d", r"[A-ZĐ][a-zàáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵ]", r"[\p{L}\p{N}_.-]+@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+", r"https?://[^\s]+")


def lookup(table: Mapping[str, object], key: Column, kind: str) -> Column:
    """The table's value for a key, null without one."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.create_map(*pairs)[key].cast(kind)


def word_class(tok: Column) -> Column:
    """function, reduplicative, compound, other (one or two letters) or content, the first that fits."""
    return class_of_low(F.lower(F.trim(tok)))


def class_of_low(low: Column) -> Column:
    """word_class() of a token in lower case."""
    keys = sorted(REDUPLICATIVE_KEYS)
    return (
        F.when(low.isin(*FUNCTION_WORDS), "function")
        .when(low.isin(*keys), "reduplicative")
        .when(low.contains("_") & F.exists(F.split(low, "_"), lambda p: p.isin(*keys)), "reduplicative")
        .when(low.contains("_"), "compound")
        .when((F.length(low) <= 2) & low.rlike(r"^\p{L}{1,2}$"), "other")
        .otherwise("content")
    )


def class_multiplier(word_class: Column) -> Column:
    return _case(CLASS_MULTIPLIER, word_class)


def class_keep(word_class: Column) -> Column:
    return _case(CLASS_KEEP, word_class)


def enhanced_multiplier(word_class: Column) -> Column:
    return _case(ENHANCED_MULTIPLIER, word_class)


def _case(table: Mapping[str, float], key: Column) -> Column:
    out = F.lit(1.0)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def normalise(word: Column) -> Column:
    """Lower case, then chat spelling or else dialect to the standard word, once."""
    low = F.lower(F.trim(word))
    return F.coalesce(lookup(TEENCODE, low, "string"), lookup(DIALECT, low, "string"), low)


def is_function_word(word: Column) -> Column:
    """Whether the word, its chat or its dialect reading is a function word."""
    low = F.lower(F.trim(word))
    known = set(FUNCTION_WORDS)
    extra = [k for table in (TEENCODE, DIALECT) for k, v in table.items() if v in known]
    return low.isin(*FUNCTION_WORDS, *sorted(set(extra)))


def is_critical(tok: Column) -> Column:
    """Numbers, dates, names, legal references, addresses of mail and web."""
    out = tok.rlike(CRITICAL[0])
    for p in CRITICAL[1:]:
        out = out | tok.rlike(p)
    return out


def decode_piece(tok: Column) -> Column:
    """A subword piece as text: word-boundary marks become spaces, which are trimmed."""
    return F.trim(F.translate(tok, "▁Ġ", "  "))


def clean_piece(tok: Column) -> Column:
    """A subword piece without its word-boundary marks, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.trim(tok), "^▁?Ġ?(##)?_?", "")))
