"""Overlap of two token arrays: longest common subsequence and clipped n-grams.

Both are quadratic folds as column expressions, so an Arrow function counts
them: the subsequence by one addition of whole rows of bits a token, time
|a| |b| / 64.
"""

from __future__ import annotations

import sys
from collections import Counter

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

# Executors get the functions themselves, so they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ORDER = 4
_OVERLAP = StructType([StructField("lcs", LongType()), StructField("hits", ArrayType(LongType())), StructField("totals", ArrayType(LongType()))])


def lcs(a, b) -> int:
    """Length of the longest common subsequence of two sequences."""
    places: dict = {}
    for i, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << i
    every = (1 << len(b)) - 1
    row = every  # a zero bit is a place where the prefix table steps up
    for x in a:
        met = row & places.get(x, 0)
        if met:
            row = ((row + met) | (row - met)) & every
    return len(b) - row.bit_count()


def clipped(a, b, size: int) -> tuple[int, int]:
    """(matches, n-grams) of a's n-grams, each counted no more often than b has it."""
    x, y = (Counter(zip(*(s[i:] for i in range(size)))) for s in (list(a), list(b)))
    return (x & y).total(), max(len(a) - size + 1, 0)


@F.pandas_udf(_OVERLAP)
def _overlap(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    out = []
    for x, y in zip(a, b):
        x, y = ([] if v is None else list(v) for v in (x, y))
        grams = [clipped(x, y, k) for k in range(1, ORDER + 1)]
        out.append((lcs(x, y), [h for h, _ in grams], [t for _, t in grams]))
    return pd.DataFrame(out, columns=["lcs", "hits", "totals"])


@F.pandas_udf(LongType())
def _lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs(() if x is None else list(x), () if y is None else list(y)) for x, y in zip(a, b)], dtype="int64")


def overlap(pred: Column, ref: Column) -> Column:
    """(lcs, hits, totals): subsequence length, and n-gram matches and n-grams of pred by size from 1; a null array counts as empty."""
    return _overlap(pred, ref)


def lcs_length(pred: Column, ref: Column) -> Column:
    """Length of the longest common subsequence; a null array counts as empty."""
    return _lcs(pred, ref)
