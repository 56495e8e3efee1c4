"""Tones of characters, syllables, tokens and their neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lexicon import (
    CHAR_TONE,
    CONTRAST_FLAT,
    STRIP_DELETE,
    STRIP_FROM,
    STRIP_TO,
    TONE_ALPHA,
    TONE_BETA,
    TONE_GAMMA,
    TONE_WINDOW,
    TONED,
    TONED_DIGITS,
    TONES,
)

#: Letters that only Vietnamese has beside its toned vowels.
VIETNAMESE = TONED + "ăâêôơưĂÂÊÔƠƯđĐ"
_EVERY = "".join(CHAR_TONE)
_EVERY_DIGIT = "".join(map(str, CHAR_TONE.values()))


def tone_marks(tok: Column) -> Column:
    """The digits 1 to 5 of the toned characters of a token, in order; ASCII is dropped before it is looked at closely."""
    digits = F.translate(F.regexp_replace(tok, r"[\x00-\x7F]+", ""), TONED, TONED_DIGITS)
    return F.when(F.octet_length(tok) == F.length(tok), F.lit("")).otherwise(F.regexp_replace(digits, "[^1-5]+", ""))


def mark_count(marks: Column, tone: int) -> Column:
    return F.length(marks) - F.length(F.replace(marks, F.lit(str(tone)), F.lit("")))


def density(tok: Column, marks: Column) -> Column:
    """Toned characters by characters; 0 for the empty token."""
    return F.when(F.length(tok) > 0, F.length(marks) / F.length(tok)).otherwise(F.lit(0.0))


def variety(marks: Column) -> Column:
    """Distinct tones but the level one."""
    return sum((F.when(marks.contains(str(t)), 1).otherwise(0) for t in range(1, 6)), F.lit(0))


def dominant(marks: Column) -> Column:
    """Tone id met most often, ties to the one met first; 0 without any."""
    best = [
        F.when(marks.contains(str(t)), mark_count(marks, t).cast("long") * 10**12 + (10**9 - F.instr(marks, str(t)).cast("long")) * 10 + t).otherwise(F.lit(0).cast("long"))
        for t in range(1, 6)
    ]
    return (F.greatest(*best) % 10).cast("int")


def tone_name(tone_id: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TONES)), tone_id + 1)


def preservation_weight(rho: Column, nu: Column) -> Column:
    """1 + alpha rho (1 + beta nu / 6)."""
    return F.lit(1.0) + F.lit(TONE_ALPHA) * rho * (F.lit(1.0) + F.lit(TONE_BETA) * nu / F.lit(6.0))


def contrast_of(a: Column, b: Column) -> Column:
    """Contrast of two tone ids in tenths; null if either is null."""
    flat = F.array(*map(F.lit, CONTRAST_FLAT))
    return F.get(flat, a * 6 + b)


def contrast_factor(tone_id: Column, window, reach: int = TONE_WINDOW) -> Column:
    """1 + gamma times the mean contrast with the neighbours within reach; 1 without neighbours."""
    near = [f(tone_id, i).over(window) for i in range(1, reach + 1) for f in (F.lag, F.lead)]
    total = sum((F.coalesce(contrast_of(tone_id, x), F.lit(0)) for x in near), F.lit(0))
    count = sum((F.when(x.isNotNull(), 1).otherwise(0) for x in near), F.lit(0))
    return F.when(count > 0, F.lit(1.0) + F.lit(TONE_GAMMA) * (total / F.lit(10.0)) / count).otherwise(F.lit(1.0))


def tone_digits(text: Column) -> Column:
    """One digit for each character: its tone id, 0 for characters without."""
    kept = F.regexp_replace(text, f"(?s)[^{_EVERY}]", "a")
    return F.translate(kept, _EVERY, _EVERY_DIGIT)


def tone_names(text: Column) -> Column:
    """The tone's name for each character, ngang for characters without."""
    return F.transform(F.filter(F.split(tone_digits(text), ""), lambda c: c != ""), lambda c: tone_name(c.cast("int")))


def char_tone(char: Column) -> Column:
    """Tone id of a character; null for characters that can't bear one."""
    return F.when(char.rlike(f"^[{_EVERY}]$"), F.translate(char, _EVERY, _EVERY_DIGIT).cast("int"))


def strip_tone(text: Column) -> Column:
    """Text without tone marks; marks of vowel quality stay."""
    return F.translate(text, STRIP_FROM + STRIP_DELETE, STRIP_TO)


_MARK_FROM = TONED + STRIP_DELETE
_MARK_TO = TONED_DIGITS + "12345"  # STRIP_DELETE is in the order of the tones


def syllable_tone(text: Column) -> Column:
    """Name of the first tone marked in the lower-cased, trimmed text, composed or combining; ngang without one."""
    first = F.substring(F.regexp_replace(F.lower(F.trim(text)), f"[^{_MARK_FROM}]", ""), 1, 1)
    return F.when(first == "", F.lit(TONES[0])).otherwise(tone_name(F.translate(first, _MARK_FROM, _MARK_TO).try_cast("int")))


def is_vietnamese(text: Column, threshold: float = 0.10) -> Column:
    """Whether at least the threshold share of the letters is Vietnamese; false without letters."""
    letters = F.length(F.regexp_replace(text, r"\P{L}", ""))
    own = F.length(F.regexp_replace(text, f"[^{VIETNAMESE}]", ""))
    return F.coalesce(F.when(letters > 0, own / letters >= threshold), F.lit(False))


def analysis(tok: Column, tone_id: Column, rho: Column, nu: Column, weight: Column) -> Column:
    """The full analysis of a token as one struct; weight is its preservation weight times its contrast."""
    present = F.transform(F.filter(F.split(tone_marks(tok), ""), lambda c: c != ""), lambda c: tone_name(c.cast("int")))
    return F.struct(
        tok.alias("token"),
        present.alias("tones_present"),
        tone_name(tone_id).alias("dominant_tone"),
        rho.alias("tone_density"),
        nu.cast("int").alias("tone_variety"),
        weight.alias("preservation_weight"),
    )
