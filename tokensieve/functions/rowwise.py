"""Tone compression of a text within its own row: no shuffle, so it serves batches and streams alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lexicon import TONE_GAMMA, TONE_WINDOW
from . import tone

SPACE = r"[ \t\n\r\f\x0B]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, as the variable of a lambda."""
    return F.transform(F.array(value), lambda x: use(x))[0]


def words_in(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda x: x != "")


def _featured(toks: Column) -> Column:
    """Structs of (d, w, t): dominant tone, weight and token."""

    def of(t: Column) -> Column:
        return let(tone.tone_marks(t), lambda m: F.when(m == "", F.struct(F.lit(0).alias("d"), F.lit(1.0).alias("w"), t.alias("t"))).otherwise(
            F.struct(tone.dominant(m).alias("d"), tone.preservation_weight(tone.density(t, m), tone.variety(m)).alias("w"), t.alias("t"))
        ))

    return F.transform(toks, of)


def _scored(items: Column) -> Column:
    """Structs of (score, pos, t), the score negated so that the natural order has the best first."""

    def of(e: Column, i: Column) -> Column:
        near = [F.get(items, i + d)["d"] for d in range(-TONE_WINDOW, TONE_WINDOW + 1) if d]
        total = sum((F.coalesce(tone.contrast_of(e["d"], x), F.lit(0)) for x in near), F.lit(0))
        count = F.least(i, F.lit(TONE_WINDOW)) + F.least(F.size(items) - 1 - i, F.lit(TONE_WINDOW))
        factor = F.when(count > 0, F.lit(1.0) + F.lit(TONE_GAMMA) * (total / F.lit(10.0)) / count).otherwise(F.lit(1.0))
        return F.struct((-F.round(e["w"] * factor, 9)).alias("score"), i.alias("pos"), e["t"].alias("t"))

    return F.transform(items, of)


def tone_kept(text: Column, ratio: float = 4.0, k: int = 2) -> Column:
    """The kept tokens of a text in order: both ends and the highest tone scores between."""

    def pick(z: Column) -> Column:
        n = F.size(z)
        middle = F.slice(z, k + 1, F.greatest(n - 2 * k, F.lit(0)))
        budget = F.greatest(F.floor(n / F.lit(ratio)).cast("int") - 2 * k, F.lit(0))
        best = F.array_sort(F.transform(F.slice(F.array_sort(middle), 1, budget), lambda x: F.struct(x["pos"], x["t"])))
        tail = F.slice(z, F.greatest(n - k, F.lit(k)) + 1, k)
        ends = lambda part: F.transform(part, lambda x: x["t"])
        return F.concat(ends(F.slice(z, 1, k)), ends(best), ends(tail))

    return let(_featured(words_in(text)), lambda items: let(_scored(items), pick))


def sized(n: Column, kept: Column) -> Column:
    """Struct of original_length, compressed_length, compression_ratio, token_savings_pct and compressed_text of n tokens and those kept."""

    def of(both: Column) -> Column:
        n, m = both["n"].cast("long"), F.size(both["kept"]).cast("long")
        return F.struct(
            n.alias("original_length"),
            m.alias("compressed_length"),
            F.round(n / F.greatest(m, F.lit(1)), 6).alias("compression_ratio"),
            F.round((n - m) / F.greatest(n, F.lit(1)) * 100.0, 6).alias("token_savings_pct"),
            F.array_join(both["kept"], " ").alias("compressed_text"),
        )

    return let(F.struct(n.alias("n"), kept.alias("kept")), of)


def compression(text: Column, ratio: float = 4.0, k: int = 2) -> Column:
    """Struct of original_length, compressed_length, compression_ratio, token_savings_pct and compressed_text."""
    return sized(F.size(words_in(text)), tone_kept(text, ratio, k))
