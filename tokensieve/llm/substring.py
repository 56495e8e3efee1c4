"""Substring dedup by de Bruijn compaction.

The edges of the graph are the windows of ``width`` consecutive words (two
windows one word apart share a node of width - 1 words).  Every edge has an
anchor, the leftmost smallest of its ``anchor``-word shingles; edges in a
row with one anchor position form a path, shipped as one row:
(anchor hash, digest, source coordinates).  Equal edges sit at equal
offsets of equal anchors, so all that can repeat meets at an anchor.

1. Anchors are counted; only paths of anchors that occur twice go on.
2. Paths with one digest are joined into one: a path that occurs twice
   repeats as a whole, without a look at its edges.
3. Where one anchor has several paths the graph branches.  One source of
   each such path is read again at its coordinates, and its edges are
   counted one by one; that settles the parts of paths that differ.
4. The repeated edges, as spans at source coordinates, are joined to the
   texts.  Each span is read there again and verified: it counts only where
   the words at its coordinates have the digest that was found to repeat.
   The texts drop the words covered.

A digest is 128 bits of BLAKE2b over the words themselves, one space
between them.  The anchors' rolling hashes only decide which paths meet, so
their collisions cost time, never words.  All counts combine before they
shuffle.  Counts are stored before they are joined, so that adaptive
execution can split the rows of a hot anchor or path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import join_texts, sliding_min, span_hash, window_hash, word_bounds
from .scratch import free_shuffles, release, small_batches, store

_AT = 28  # bits of a word's place in a batch
_START, _LEN = 40, 8  # a path's place: edges << 40 | first word
_DIGEST = 16


class _Words:
    """The words of a batch of texts: their bytes with one space behind each, where each begins (and the end), their hashes, each text's first."""

    def __init__(self, texts: list[str | None]):
        data, offsets = join_texts(texts)
        buf = np.frombuffer(data, np.uint8)
        starts, ends = word_bounds(buf)
        self.first = np.searchsorted(starts, offsets)
        self.begin = np.concatenate([[0], np.cumsum(ends - starts + 1)])
        body = np.full(self.begin[-1], 0x20, np.uint8)
        inside = np.zeros(len(buf) + 1, np.int8)
        inside[starts], inside[ends] = 1, -1
        solid = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
        place = np.arange(len(body))
        body[np.delete(place, self.begin[1:] - 1)] = buf[solid]
        self.body = body.tobytes()
        self.hashes = span_hash(buf, starts, ends)

    def text(self, start: int, end: int) -> bytes:
        """Words start to end, joined by one space."""
        return self.body[self.begin[start] : self.begin[end] - 1]

    def digests(self, start: np.ndarray, count: np.ndarray) -> list[bytes]:
        """Digest of the count words from start on, for each."""
        body, new = memoryview(self.body), hashlib.blake2b
        ends = self.begin[start + count] - 1
        return [new(body[a:b], digest_size=_DIGEST).digest() for a, b in zip(self.begin[start].tolist(), ends.tolist())]


def _place(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, edges) of packed coordinates."""
    return at & ((1 << _START) - 1), (at >> _START) & ((1 << _LEN) - 1)


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, tag): the text's 64-bit hash tells rows apart that share a doc_id (null counts as the least long)."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), "text", F.xxhash64("text").alias("tag"))


def _reach(width: int, anchor: int) -> int:
    """Edges that one anchor can serve; raises ValueError where their number doesn't fit a path's place."""
    reach = width - anchor + 1
    if not 1 <= reach < 1 << _LEN or anchor < 1:
        raise ValueError(f"an anchor of 1 to {width} words and at most {(1 << _LEN) - 1} edges a path are possible; width {width} and anchor {anchor} give {reach}")
    return reach


def paths(docs: DataFrame, width: int = 35, anchor: int = 16) -> DataFrame:
    """(mh, sig, doc_id, tag, at): every path of edges with one anchor position; at packs number of edges and first word."""
    reach = _reach(width, anchor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = _Words(b.column("text").to_pylist())
            hashes, first = text.hashes, text.first
            doc_id, tag = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("tag").to_numpy(zero_copy_only=False)
            mers = window_hash(hashes, anchor)
            n = len(hashes) - width + 1
            if n <= 0:
                continue
            low = np.uint64((1 << _AT) - 1)
            place = (mers & ~low) | np.arange(len(mers), dtype=np.uint64)
            at = (sliding_min(place, reach) & low).astype(np.int64)
            doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
            whole = np.flatnonzero(doc[:n] == doc[width - 1 :])
            at, doc = at[whole], doc[whole]
            new = np.ones(len(whole), bool)
            new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
            start = np.flatnonzero(new)
            size = np.append(start[1:], len(whole)) - start
            doc, here = doc[start], whole[start]
            sig = pa.array(text.digests(here, size + width - 1), pa.binary())
            packed = (size << _START) | (here - first[doc])
            cols = [pa.array(mers[at[start]].view(np.int64)), sig, *map(pa.array, (doc_id[doc], tag[doc], packed))]
            yield pa.RecordBatch.from_arrays(cols, ["mh", "sig", "doc_id", "tag", "at"])

    return docs.mapInArrow(run, "mh long, sig binary, doc_id long, tag long, at long")


def _edges_at(texts: DataFrame, width: int) -> DataFrame:
    """(mh, sig, n, doc_id, tag, at): the edges of the paths listed with each text, n as often as their path occurs; at holds one edge.

    Paths whose digest isn't that of the words at their coordinates belong
    to another text of the same hash and are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = _Words(b.column("text").to_pylist())
            lists = b.column("paths")
            owner = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            mh, n, at = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("mh", "n", "at"))
            start, size = _place(at)
            true = _verified(text, owner, start, size, width, flat.field("sig"))
            mh, n, at, owner, start, size = (x[true] for x in (mh, n, at, owner, start, size))
            begin = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else size
            step = np.arange(size.sum()) - np.repeat(begin, size)
            here = np.repeat(text.first[owner] + start, size) + step
            doc_id, tag = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("tag").to_numpy(zero_copy_only=False)
            place = np.repeat(start, size) + step + (1 << _START)
            sig = pa.array(text.digests(here, np.full(len(here), width)), pa.binary())
            cols = [pa.array(np.repeat(mh, size)), sig, *map(pa.array, (np.repeat(n, size), np.repeat(doc_id[owner], size), np.repeat(tag[owner], size), place))]
            yield pa.RecordBatch.from_arrays(cols, ["mh", "sig", "n", "doc_id", "tag", "at"])

    return texts.mapInArrow(run, "mh long, sig binary, n long, doc_id long, tag long, at long")


def _verified(text: _Words, owner: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, sig: pa.Array) -> np.ndarray:
    """Whether the words at each span's coordinates, read again, have the digest sig."""
    fits = start + size + width - 1 <= (text.first[1:] - text.first[:-1])[owner]
    at = np.flatnonzero(fits)
    want = sig.take(pa.array(at)).to_pylist()
    fits[at] = [a == b for a, b in zip(text.digests(text.first[owner[at]] + start[at], size[at] + width - 1), want)]
    return fits


def repeated_spans(docs: DataFrame, width: int = 35, anchor: int = 16) -> DataFrame:
    """(doc_id, tag, spans): spans lists (first word and edges, digest) of the windows that start anywhere else too."""
    keyed = _keyed(docs)
    every = store(paths(keyed, width, anchor))
    twice = store(every.groupBy("mh").agg(F.count("*").alias("times")).where("times > 1").select("mh"))
    shared = store(every.join(twice, "mh"))
    release(every, twice)
    free_shuffles(docs.sparkSession)

    path = store(shared.groupBy("mh", "sig").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "tag", "at")).alias("source")))
    branching = store(path.groupBy("mh").agg(F.count("*").alias("paths")).where("paths > 1").select("mh"))
    sources = (
        path.join(branching, "mh")
        .select("mh", "sig", "n", "source.*")
        .groupBy("doc_id", "tag")
        .agg(F.collect_list(F.struct("mh", "sig", "n", "at")).alias("paths"))
    )
    edges = store(_edges_at(keyed.join(sources, ["doc_id", "tag"]).select("doc_id", "tag", "text", "paths"), width))
    free_shuffles(docs.sparkSession)
    known = store(edges.groupBy("mh", "sig").agg(F.sum("n").alias("times")).where("times > 1").select("mh", "sig"))
    single = edges.where("n = 1").join(known, ["mh", "sig"]).select("doc_id", "tag", "at", "sig")
    whole = shared.join(path.where("n > 1").select("mh", "sig"), ["mh", "sig"]).select("doc_id", "tag", "at", "sig")
    spans = store(whole.unionByName(single))
    release(shared, path, branching, edges, known)
    return spans.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("at", "sig")).alias("spans"))


def _cut(texts: list[str | None], spans: pa.ListArray, width: int) -> list[tuple[int, int, str]]:
    """(number of words, number of those that no verified span covers, these joined by one space) of each text."""
    text = _Words(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(spans.offsets.to_numpy()))
    flat = spans.flatten()
    start, size = _place(flat.field("at").to_numpy(zero_copy_only=False))
    true = _verified(text, owner, start, size, width, flat.field("sig"))
    begin = (text.first[owner] + start)[true]
    turn = np.zeros(len(text.begin), np.int64)
    np.add.at(turn, begin, 1)
    np.add.at(turn, begin + size[true] + width - 1, -1)
    keep = np.cumsum(turn[:-1]) == 0
    out = []
    for a, b in zip(text.first[:-1].tolist(), text.first[1:].tolist()):
        part = keep[a:b]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], part.view(np.int8), [0]]))).tolist()
        left = b" ".join(text.text(a + s, a + e) for s, e in zip(edge[0::2], edge[1::2]))
        out.append((b - a, int(part.sum()), left.decode("utf-8", "surrogatepass")))
    return out


def drop_repeats(docs: DataFrame, width: int = 35, anchor: int = 16) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row of docs (doc_id, text).

    Words are runs of other characters than ASCII white space.  A word goes
    if a window of ``width`` words covers it whose word sequence also
    starts elsewhere, in any document or its own.  kept joins the rest by
    one space.  Null and empty texts have no words and keep ''.  Rows that
    repeat a doc_id, and null doc_ids, are documents of their own; an empty
    table gives an empty result.  Raises ValueError where a path of
    width - anchor + 1 edges is too long.
    """
    small_batches(docs.sparkSession)
    spans = repeated_spans(docs, width, anchor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = _cut(b.column("text").to_pylist(), b.column("spans"), width)
            cols = [b.column("row_id"), pa.array([n for n, _, _ in cut], pa.int64()), pa.array([n - m for n, m, _ in cut], pa.int64()), pa.array([t for _, _, t in cut], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "kept"])

    keyed = _keyed(docs).withColumn("row_id", F.when(F.col("doc_id") != -(2**63), F.col("doc_id")))
    return keyed.join(spans, ["doc_id", "tag"], "left").select("row_id", "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def cut_documents(docs: DataFrame, width: int = 35, anchor: int = 16) -> DataFrame:
    """docs with each text cut as drop_repeats cuts it, n_chars, if there, set to its new length.

    A text that loses no word stays as it is, white space included; one
    that loses words joins the rest by one space; a document that loses
    every word goes.  Null and empty texts stay.  Rows that repeat a text
    are documents of their own and lose its windows each.
    """
    small_batches(docs.sparkSession)
    spans = repeated_spans(docs, width, anchor).select(F.col("doc_id").alias("_doc"), F.col("tag").alias("_tag"), F.col("spans").alias("_spans"))
    names = docs.columns
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(place).to_pylist()
            keep = np.ones(b.num_rows, bool)
            for i, (n, left, text) in enumerate(_cut(texts, b.column(len(names)), width)):
                if left < n:
                    texts[i], keep[i] = text, left > 0
            cols = [pa.array(texts, pa.string()) if i == place else b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep))

    doc = F.coalesce(docs["doc_id"].cast("long"), F.lit(-(2**63)))
    marked = docs.join(spans, (doc == F.col("_doc")) & (F.xxhash64(docs["text"]) == F.col("_tag")), "left").select(*[docs[c] for c in names], "_spans")
    out = marked.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else out
