"""Quality classifier: hashed word n-grams, logistic regression by FTRL-proximal updates.

A document's features are hashes of its words and word pairs and of their
shapes in ``2**bits`` buckets, each valued by the root of its share.
Features are hashed where the texts are; training sees those of a bounded
sample of the labelled rows, in one task, and returns the weights that
aren't zero.  Scoring is a sparse dot product in a single pass over the
documents, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import mix, span_hash, words_of
from .scratch import small_batches

_PAIR = np.uint64(0xA0761D6478BD642F)
_SALT = np.uint64(0xE7037ED1A0B428DB)
_SAME = np.uint64(0x8EBC6AF09C88C6E3)
_SCALE = 4.0
#: Texts whose features are made at a time.
_BATCH = 128


@dataclass(frozen=True)
class Ftrl:
    """Parameters: buckets (bits), learning rate (alpha, beta), penalties (l1, l2), passes.

    max_rows and max_features bound the sample that training sees: the
    labelled rows of the smallest hashes of doc_id, as many as have no more
    features than max_features together (8 bytes each), one at least.
    """

    bits: int = 18
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.5
    epochs: int = 4
    max_rows: int = 12_000
    max_features: int = 50_000_000


def _shape_table() -> np.ndarray:
    """Letters and bytes beyond ASCII become a, digits 0; the rest stay."""
    table = np.arange(256, dtype=np.uint8)
    table[0x80:] = ord("a")
    table[ord("a") : ord("z") + 1] = table[ord("A") : ord("Z") + 1] = ord("a")
    table[ord("0") : ord("9") + 1] = ord("0")
    return table


_SHAPE = _shape_table()


def features(texts, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, document, value) of each distinct feature of each document, sorted by document.

    Features are words and word pairs, the same of the words' shapes (runs
    of letters and of digits as one character each), and pairs of equal
    words.  The value is the square root of the feature's share of its
    document's.
    """
    lowered = [t and t.lower() for t in texts]
    words, first, data, starts, ends = words_of(lowered)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    shaped = _SHAPE[np.frombuffer(data, np.uint8)]
    turn = np.ones(len(shaped) + 1, bool)
    turn[1:-1] = shaped[1:] != shaped[:-1]
    place = np.cumsum(turn) - 1  # where each byte's run stands among the runs
    shapes = span_hash(shaped[turn[:-1]], place[starts], place[ends]) + _SALT if len(starts) else words
    inside = doc[:-1] == doc[1:]
    pairs = [mix(w[:-1] * _PAIR + w[1:])[inside] for w in (words, shapes)]
    same = np.full(int((words[:-1] == words[1:])[inside].sum()), _SAME)
    same_doc = doc[:-1][inside & (words[:-1] == words[1:])]
    hashes = np.concatenate([words, *pairs, mix(shapes), same]) >> np.uint64(64 - bits)
    owner = np.concatenate([doc, doc[:-1][inside], doc[:-1][inside], doc, same_doc])
    both, count = np.unique((owner.astype(np.uint64) << np.uint64(bits)) | hashes, return_counts=True)
    owner = (both >> np.uint64(bits)).astype(np.int64)
    total = np.bincount(owner, count, minlength=len(texts))
    return (both & np.uint64((1 << bits) - 1)).astype(np.int64), owner, _SCALE * np.sqrt(count / total[owner])


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels, how: Ftrl) -> tuple[np.ndarray, float]:
    """(weights, bias) after how.epochs passes over (buckets, values) of each document in the order given."""
    size = (1 << how.bits) + 1  # the last is the bias
    z, n = np.zeros(size), np.zeros(size)

    def weights(at):
        zi = z[at]
        return np.where(np.abs(zi) <= how.l1, 0.0, (np.sign(zi) * how.l1 - zi) / ((how.beta + np.sqrt(n[at])) / how.alpha + how.l2))

    for _ in range(how.epochs):
        for (bucket, value), y in zip(rows, labels):
            at = np.append(bucket, size - 1)
            x = np.append(value, 1.0).astype(float)
            w = weights(at)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - y) * x
            g2 = g * g
            z[at] += g - (np.sqrt(n[at] + g2) - np.sqrt(n[at])) / how.alpha * w
            n[at] += g2
    w = weights(np.arange(size))
    return w[:-1], float(w[-1])


def score(texts, weights: np.ndarray, bias: float, bits: int) -> np.ndarray:
    """Probability of label 1 for each text; a text without words has the bias alone."""
    bucket, doc, value = features(texts, bits)
    dot = np.bincount(doc, weights[bucket] * value, minlength=len(texts)) + bias
    return 1.0 / (1.0 + np.exp(-np.clip(dot, -30, 30)))


def held_out(doc_id="doc_id"):
    """Whether crc32 of doc_id as text is divisible by 5; false for null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _hashed(rows: DataFrame, bits: int) -> DataFrame:
    """(doc_id, text_hash, y, buckets, amounts) of rows (doc_id, text_hash, text, y): features as packed 32-bit integers and floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, _BATCH):
                part = b.slice(at, _BATCH)
                bucket, doc, value = features(part.column("text").to_pylist(), bits)
                cut = np.searchsorted(doc, np.arange(part.num_rows + 1)).tolist()
                packed = [[x[i:j].astype(kind).tobytes() for i, j in zip(cut, cut[1:])] for x, kind in ((bucket, "<i4"), (value, "<f4"))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "text_hash", "y")), *(pa.array(x, pa.binary()) for x in packed)], ["doc_id", "text_hash", "y", "buckets", "amounts"])

    return rows.select("doc_id", "text_hash", "y", "text").mapInArrow(run, "doc_id long, text_hash long, y int, buckets binary, amounts binary")


def train(docs: DataFrame, labels: DataFrame, how: Ftrl = Ftrl()) -> tuple[np.ndarray, float]:
    """Weights and bias from labelled documents (doc_id, text) with labels (doc_id, quality 0 or 1) that aren't held out.

    Rows without a label, doc_id or label in {0, 1} are left out; of
    several labels of one doc_id the smallest counts, of several texts that
    of the least hash.  Without any usable row, an empty table included,
    all weights are zero and every score is one half.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    one = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("y"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(how.max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").join(F.broadcast(chosen), "doc_id")
    made = _hashed(rows, how.bits).groupBy("doc_id").agg(F.min_by(F.struct("y", "buckets", "amounts"), "text_hash").alias("row"))  # max_rows rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[tuple[np.ndarray, np.ndarray]] = []
        ys: list[int] = []
        total = 0
        for b in batches:
            for y, bucket, value in zip(*(b.column(c) for c in ("y", "buckets", "amounts"))):
                total += len(bucket.as_buffer()) // 4
                if total > how.max_features and seen:
                    continue
                seen.append((np.frombuffer(bucket.as_py(), "<i4"), np.frombuffer(value.as_py(), "<f4")))
                ys.append(y.as_py())
        w, bias = fit(seen, ys, how)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(w[at], bias), pa.float64())], ["bucket", "weight"])

    placed = made.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").select("row.*")
    got = placed.mapInArrow(run, "bucket long, weight double").collect()  # 2**bits rows at most
    weights, bias = np.zeros(1 << how.bits), 0.0
    for r in got:
        if r.bucket < 0:
            bias = r.weight
        else:
            weights[r.bucket] = r.weight
    return weights, bias


def classify(docs: DataFrame, weights: np.ndarray, bias: float, how: Ftrl = Ftrl()) -> DataFrame:
    """(doc_id, score) for every row of docs (doc_id, text).

    Null texts count as empty, rows that repeat a doc_id are scored each,
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(weights)  # 2**bits doubles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            out = [score(b.column("text").slice(at, _BATCH).to_pylist(), w, bias, how.bits) for at in range(0, b.num_rows, _BATCH)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate(out or [np.zeros(0)]))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
