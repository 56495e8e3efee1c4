"""Vectorised hashing of words, shingles and windows over whole Arrow batches.

A batch of texts is one byte buffer; every step is a numpy pass over it, so
no Python object is made for each word.  All hashes are 64-bit and mixed by
a finaliser, polynomial sums wrap modulo 2**64.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _inverse(odd: int) -> int:
    return pow(int(odd), -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def join_texts(texts) -> tuple[bytes, np.ndarray]:
    """UTF-8 bytes of all texts, each followed by a newline, and n+1 offsets.

    A null text counts as empty.
    """
    parts = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(p) + 1 for p in parts], dtype=np.int64) if parts else np.zeros(0, np.int64)
    return b"\n".join(parts) + (b"\n" if parts else b""), np.concatenate([[0], ends])


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words ``[^\\x20\\x09-\\x0D]+`` in buf, which ends in white space."""
    gap = (buf == 0x20) | ((buf >= 0x09) & (buf <= 0x0D))
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(buf) and not gap[0]:
        edge = np.concatenate([[0], edge])
    return edge[0::2].astype(np.int64), edge[1::2].astype(np.int64)


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = int(_BASE)) -> np.ndarray:
    """A mixed polynomial hash of values[start:end] for each span."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _powers(base, n), out=sums[1:])
    back = _powers(_inverse(base), n + 1)
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def window_hash(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of words[i:i+width] for each i that has a whole window."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n, dtype=np.int64)
    return span_hash(words, at, at + width, int(_STEP))


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """min(a[i:i+width]) for each whole window, by doubling."""
    if len(a) < width:
        return a[:0]
    span, m = 1, a
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < width:
        m = np.minimum(m[: len(a) - width + 1], m[width - span : width - span + len(a) - width + 1])
    return m


def words_of(texts) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """(hash of each word, index of each text's first word (n+1), bytes, word starts, word ends)."""
    data, offsets = join_texts(texts)
    buf = np.frombuffer(data, np.uint8)
    starts, ends = word_bounds(buf)
    return span_hash(buf, starts, ends), np.searchsorted(starts, offsets), data, starts, ends
