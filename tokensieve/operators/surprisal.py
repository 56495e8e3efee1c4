"""Bigram surprisal of tokens in rows, without a row a token.

Texts are dealt into chunks of about CHUNK tokens by doc_id.  A chunk counts
its pairs and words and sends each bucket of hashes one block of distinct keys
with counts; a bucket adds its blocks up and answers each with the totals in
the order of its keys, so neither place nor text of a token moves.  Chunks and
buckets keep their size as the corpus grows, and a frequent pair is one key a
chunk.  Words are known by 64 bits of XXH64, pairs by 64 bits made of both.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rows as R

# Executors get the functions themselves, so they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK, BUCKET = 1 << 19, 1 << 20
_BLOCK = "bucket int, chunk int, keys binary, counts binary"
_TOTAL = "bucket int, chunk int, totals binary, n_distinct long"


def pair_keys(prev: np.ndarray, tok: np.ndarray) -> np.ndarray:
    """64 bits of each pair of words' hashes."""
    return prev * np.uint64(0x9E3779B97F4A7C15) + tok * np.uint64(0xC2B2AE3D27D4EB4F)


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and first places of a column of non-empty lists of hashes."""
    lists = column.combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)


def counted(column) -> tuple:
    """(pairs, their counts, words, their counts as predecessors, place of each token's pair, of its word, first places) of a chunk; a document's first token has no pair."""
    toks, starts = flat(column)
    later = np.ones(len(toks), bool)
    later[starts] = False
    at = np.flatnonzero(later)
    pairs, place, counts = np.unique(pair_keys(toks[at - 1], toks[at]), return_inverse=True, return_counts=True)
    own, word = np.unique(toks, return_inverse=True)
    return pairs, counts, own, np.bincount(word[at - 1], minlength=len(own)), (at, place), word, starts


def cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range of sorted keys begins, and the end."""
    edges = [(b << 64) // buckets for b in range(1, buckets)]
    return np.concatenate(([0], np.searchsorted(keys, np.array(edges, np.uint64)), [len(keys)])).astype(np.int64)


def blocks(chunk: int, keys: np.ndarray, counts: np.ndarray, buckets: int, first: int, every: bool) -> dict[str, list]:
    out: dict[str, list] = {"bucket": [], "chunk": [], "keys": [], "counts": []}
    ends = cuts(keys, buckets)
    for b, (i, j) in enumerate(zip(ends[:-1], ends[1:])):
        if every or j > i:
            for name, x in zip(out, (first + b, chunk, keys[i:j].tobytes(), counts[i:j].astype("<u4").tobytes())):
                out[name].append(x)
    return out


def _types(names) -> pa.Schema:
    kinds = {"bucket": pa.int32(), "chunk": pa.int32(), "keys": pa.binary(), "counts": pa.binary(), "totals": pa.binary(), "n_distinct": pa.int64()}
    return pa.schema([(n, kinds[n]) for n in names])


def send(pair_buckets: int, word_buckets: int):
    """Blocks of a chunk's pairs, and one for every bucket of words, for their answers tell how many words there are."""

    def run(table: pa.Table) -> pa.Table:
        chunk = table["chunk"][0].as_py()
        pairs, c, own, p, *_ = counted(table["hashes"])
        parts = (blocks(chunk, pairs, c, pair_buckets, 0, False), blocks(chunk, own, p, word_buckets, pair_buckets, True))
        return pa.table({k: parts[0][k] + parts[1][k] for k in parts[0]}, schema=_types(parts[0]))

    return run


def _joined(column, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of blocks, and the ends of each."""
    held = [np.frombuffer(x.as_buffer(), kind) for x in column]
    return np.concatenate([np.empty(0, kind), *held]), np.cumsum([len(x) for x in held])


def total(table: pa.Table) -> pa.Table:
    """A bucket's blocks answered with the totals of their keys."""
    keys, ends = _joined(table["keys"], "<u8")
    counts, _ = _joined(table["counts"], "<u4")
    own, place = np.unique(keys, return_inverse=True)
    sums = np.bincount(place, weights=counts, minlength=len(own)).astype("<i8")[place]
    answers = [x.tobytes() for x in np.split(sums, ends[:-1])]
    return pa.table({"bucket": table["bucket"], "chunk": table["chunk"], "totals": pa.array(answers, pa.binary()), "n_distinct": pa.array([len(own)] * len(answers), pa.int64())}, schema=_types(("bucket", "chunk", "totals", "n_distinct")))


def _ordered(table: pa.Table) -> pa.Table:
    return table.sort_by("bucket")


def receive(pair_buckets: int):
    """A chunk's rows with of each token its pair's count (0 for the first), its word's count as predecessor, and the number of words."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        *_, (at, place), word, starts = counted(left["hashes"])
        right = _ordered(right)
        is_pair = np.asarray(right["bucket"]) < pair_buckets
        both = _joined(right["totals"].filter(pa.array(is_pair)), "<i8")[0], _joined(right["totals"].filter(pa.array(~is_pair)), "<i8")[0]
        of_pair = np.zeros(len(word), np.int64)
        of_pair[at] = both[0][place]
        size = int(np.asarray(right["n_distinct"])[~is_pair].sum())
        offsets = pa.array(np.append(starts, len(word)), pa.int32())
        lists = lambda x: pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64()))
        return pa.table({"doc_id": left["doc_id"], "toks": left["toks"].cast(pa.list_(pa.string())), "of_pair": lists(of_pair), "of_word": lists(both[1][word]), "v": pa.array([size] * len(starts), pa.int64())})

    return run


class Corpus:
    """The pair counts of docs (doc_id, text) and what follows from them."""

    def __init__(self, docs: DataFrame, tokenizer: str = "space"):
        number = R.rows(docs, tokenizer).agg(F.sum(F.size("toks"))).first()[0] or 0
        self.chunks, self.pair_buckets, self.word_buckets = -(-number // CHUNK) or 1, -(-number // BUCKET) or 1, -(-number // (4 * BUCKET)) or 1
        chunk = F.pmod(F.xxhash64("doc_id"), F.lit(self.chunks)).cast("int").alias("chunk")
        dealt = docs.select(chunk, "doc_id", "text").repartition(self.chunks, "chunk")
        made = dealt.where(F.col("text").rlike(R.SOME[tokenizer])).select("chunk", "doc_id", R.TOKENIZERS[tokenizer](F.col("text")).alias("toks"))
        self.rows = made.select("chunk", "doc_id", "toks", F.transform("toks", lambda t: F.xxhash64(t)).alias("hashes"))
        sent = self.rows.select("chunk", "hashes").groupBy("chunk").applyInArrow(send(self.pair_buckets, self.word_buckets), _BLOCK)
        self.blocks = sent.repartition(self.pair_buckets + self.word_buckets, "bucket")

    def counts(self) -> DataFrame:
        """(doc_id, toks, of_pair, of_word, v): see receive()."""
        answers = self.blocks.groupBy("bucket").applyInArrow(total, _TOTAL)
        kind = f"doc_id {dict(self.rows.dtypes)['doc_id']}, toks array<string>, of_pair array<long>, of_word array<long>, v long"
        return self.rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(receive(self.pair_buckets), kind)

    def surprisal(self) -> DataFrame:
        """(doc_id, toks, of_word, v, surprisal): -ln of each token's add-one bigram probability, to 6 decimals; 0 at place 0."""
        of = lambda c2, i: F.when(i == 0, F.lit(0.0)).otherwise(negative_log(c2, F.get("of_word", i - 1), F.col("v")))
        return self.counts().select("doc_id", "toks", "of_word", "v", F.transform("of_pair", of).alias("surprisal"))

    def pair_counts(self, asked: DataFrame) -> DataFrame:
        """(doc_id, found): for each array of pairs (prev, tok) of asked (doc_id, pairs) an array of their counts; documents without pairs have no row."""
        hashes = F.transform("pairs", lambda p: F.array(F.xxhash64(p["prev"]), F.xxhash64(p["tok"])))
        pairs = asked.where(F.size("pairs") > 0).select("doc_id", F.flatten(hashes).alias("hashes"))
        kind = f"doc_id {dict(asked.dtypes)['doc_id']}"
        one = pairs.mapInArrow(_questions(self.pair_buckets), f"{kind}, bucket int, at array<int>, keys array<long>")
        told = self.blocks.groupBy("bucket").cogroup(one.groupBy("bucket")).applyInArrow(_answered, f"{kind}, at array<int>, found array<long>")
        flatly = told.groupBy("doc_id").agg(F.sort_array(F.flatten(F.collect_list(F.arrays_zip("at", "found")))).alias("all"))
        return flatly.select("doc_id", F.transform("all", lambda x: x["found"]).alias("found"))


def _questions(buckets: int):
    """A row for each document and bucket that its pairs fall into."""

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {"doc_id": [], "bucket": [], "at": [], "keys": []}
            for doc, held in zip(batch["doc_id"].to_pylist(), batch["hashes"].to_pylist()):
                both = np.array(held, np.int64).view(np.uint64)
                keys = pair_keys(both[::2], both[1::2])
                edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
                bucket = np.searchsorted(edges, keys, "right")
                for b in np.unique(bucket):
                    at = np.flatnonzero(bucket == b)
                    for name, x in zip(out, (doc, int(b), at.astype(np.int32), keys[at].view(np.int64))):
                        out[name].append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], batch.schema.field("doc_id").type), pa.array(out["bucket"], pa.int32()), pa.array(out["at"], pa.list_(pa.int32())), pa.array(out["keys"], pa.list_(pa.int64()))], names=list(out))

    return run


def _answered(left: pa.Table, right: pa.Table) -> pa.Table:
    """Counts of the keys asked for in a bucket, 0 for those it doesn't have."""
    found = pa.array([], pa.list_(pa.int64()))
    if right.num_rows:
        keys, _ = _joined(left["keys"], "<u8")
        counts, _ = _joined(left["counts"], "<u4")
        own, place = np.unique(keys, return_inverse=True)
        sums = np.bincount(place, weights=counts, minlength=len(own)).astype(np.int64)
        asked, starts = flat(right["keys"])
        at = np.minimum(np.searchsorted(own, asked), max(len(own) - 1, 0))
        hit = (own[at] == asked) if len(own) else np.zeros(len(asked), bool)
        values = np.where(hit, sums[at], 0) if len(own) else np.zeros(len(asked), np.int64)
        found = pa.ListArray.from_arrays(pa.array(np.append(starts, len(asked)), pa.int32()), pa.array(values, pa.int64()))
    return pa.table({"doc_id": right["doc_id"], "at": right["at"], "found": found})


def negative_log(c2: Column, c1: Column, v: Column) -> Column:
    """-ln of the add-one probability, to 6 decimals."""
    return F.round(-F.ln((c2 + 1.0) / (c1 + v)), 6)
