"""Secret scans: known patterns and sliding-window Shannon entropy.

Base kinds are found by pattern.  Beyond them, runs of key-like characters
that no base span touches are looked at.  The parts of a run, between
slashes and equals signs, that hold an allowed word are taken out; each
stretch that is left is a candidate, and its class (hex, letters,
alphanumeric, base64) fixes a window's threshold.  The entropy of each
window of ``window`` characters follows from the last one's by changing two
counts.  A candidate whose largest window entropy reaches its class's
threshold is a span of kind ``entropy``, unless an allow pattern fits it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import small_batches

KINDS = ("assign", "access", "hex", "entropy")

# Fixed values of the base kinds: pattern, group and least length of what counts.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, as [0-9a-f]+ finds them; shorter ones would be dropped
_ASSIGN_LEAST, _ACCESS_LEAST = 6, 20

_CUES = ("passw", "secret", "token", "api")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_LONG = 20


@dataclass(frozen=True)
class EntropyRule:
    """Thresholds in bits a character by class.

    allow: patterns that acquit a candidate they fit as a whole;
    allow_words: those that acquit the part of a run, between slashes and
    equals signs, that holds one, in either case.
    """

    window: int = 20
    hex: float = 3.0
    letters: float = 4.0
    alnum: float = 3.7
    base64: float = 3.9
    allow: tuple[str, ...] = field(
        default=(
            r"[0-9_=/+-]+",  # numbers and rules
            r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUID
            r"([A-Za-z]{2,}[0-9]{0,4}[-_/=+])+[A-Za-z]*[0-9]{0,4}",  # words with joints
        )
    )
    allow_words: tuple[str, ...] = ("example", "sample", "dummy", "placeholder", "xxxx", "0000", "1234567")


def window_entropy(text: str, window: int) -> float:
    """The largest Shannon entropy, in bits, of any ``window`` characters in a row (of all, if fewer)."""
    n = min(window, len(text))
    if not n:
        return 0.0
    term = [0.0] + [c * math.log2(c) for c in range(1, n + 1)]
    counts: dict[str, int] = {}
    for c in text[:n]:
        counts[c] = counts.get(c, 0) + 1
    total = sum(term[c] for c in counts.values())
    least = total
    for old, new in zip(text, text[n:]):
        if old != new:
            a, b = counts[old], counts.get(new, 0)
            total += term[a - 1] - term[a] + term[b + 1] - term[b]
            counts[old], counts[new] = a - 1, b + 1
            least = min(least, total)
    return math.log2(n) - least / n


def _class(text: str) -> str | None:
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text):
        return "hex"
    if re.search("[0-9]", text) and re.search("[A-Za-z]", text):
        return "alnum" if text.isalnum() else "base64"
    if text.isalpha() and not text.islower() and not text.isupper():
        return "letters"
    return None


def _cued(text: str) -> bool:
    """Whether an assignment can be there."""
    low = text.lower()
    return any(c in low for c in _CUES)


def _assignments(text: str) -> list[tuple[int, int, int]]:
    if not _cued(text):
        return []
    return [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= _ASSIGN_LEAST]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, in code points; kind indexes KINDS."""
    out = _assignments(text)
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _stretches(run: str, words: tuple[str, ...]) -> Iterator[tuple[int, str]]:
    """(start, text) of what is left of a run without the parts that hold one of the words, if long enough."""
    low = run.lower()
    if not any(w in low for w in words):
        yield 0, run
        return
    start = at = 0
    for part in re.split("([/=])", low):
        if any(w in part for w in words):
            if at - 1 - start >= _LONG:
                yield start, run[start : at - 1]
            start = at + len(part) + 1
        at += len(part)
    if at - start >= _LONG:
        yield start, run[start:at]


def entropy_spans(text: str, taken: list[tuple[int, int, int]], rule: EntropyRule) -> list[tuple[int, int, int]]:
    """Spans of kind entropy that touch no span taken (sorted by start)."""
    out = []
    ahead, reach = 0, -1  # spans that start before the run's end, and the furthest end of those
    for m in _CANDIDATE.finditer(text):
        while ahead < len(taken) and taken[ahead][0] < m.end():
            reach = max(reach, taken[ahead][2])
            ahead += 1
        if m.start() < reach:
            continue
        for at, part in _stretches(m.group(), rule.allow_words):
            kind = _class(part)
            if not kind or any(re.fullmatch(p, part) for p in rule.allow):
                continue
            if window_entropy(part, rule.window) >= getattr(rule, kind):
                out.append((m.start() + at, 3, m.start() + at + len(part)))
    return out


def find_spans(text: str | None, rule: EntropyRule = EntropyRule()) -> tuple[list, list]:
    """(base spans, all spans), each sorted by start, then kind."""
    if not text:
        return [], []
    if max(map(len, text.split()), default=0) < _LONG:  # every other kind needs a run as long
        base = _assignments(text)
        return base, base
    base = base_spans(text)
    return base, sorted(base + entropy_spans(text, base, rule))


def _line(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def mask(text: str, spans: list, by: str = "[SECRET]") -> str:
    """The text with each stretch of overlapping spans replaced."""
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], by]
        at = max(at, e)
    return "".join(out) + text[at:]


def scan(docs: DataFrame, rule: EntropyRule = EntropyRule()) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans, masked) for every row of docs (doc_id, text).

    base and spans list ``kind:start:end`` by start, then kind; spans has
    the entropy kind too.  masked is the text with its spans replaced; null
    stays null.  A null text counts as empty and has no spans.  Rows that
    repeat a doc_id come back each, an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, base_lines, lines, masked = [[], [], []], [], [], []
            for text in b.column("text").to_pylist():
                base, spans = find_spans(text, rule)
                for k, c in enumerate(counts):
                    c.append(sum(x[1] == k for x in base))
                base_lines.append(_line(base))
                lines.append(_line(spans))
                masked.append(mask(text, spans) if spans else text)
            cols = [b.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), *(pa.array(c, pa.string()) for c in (base_lines, lines, masked))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans", "masked"])

    out = "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string, masked string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, out)


def mask_documents(docs: DataFrame, rule: EntropyRule = EntropyRule()) -> DataFrame:
    """docs with the spans of each text replaced; other columns and rows stay, repeated ones and null texts too."""
    small_batches(docs.sparkSession)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t and mask(t, find_spans(t, rule)[1]) for t in b.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == place else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)

