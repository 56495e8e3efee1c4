"""Vector bin packing of token pieces into fixed-length sequences.

An item has a demand vector: tokens, segments and loss-bearing tokens; a
sequence has a capacity in each.  The next item goes to the open sequence
that maximises the dot product of its demand and the sequence's free
capacity, both as shares of the capacity, among those where it fits.

Documents may be cut: full sequences are cut off the front, the rest is an
item, and an item that fits nowhere fills the fullest open sequence and
goes on behind the cut.  What is open when a task ends is laid end to end
into full sequences; the one rest of a task, and what a segment or loss
limit closes early, is cut, without padding, into sequences whose lengths
are powers of two.

Each task packs its own rows in one pass: nothing is shuffled, gathered or
kept beyond the open sequences, and a lost task is packed again alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import byte_bpe
from .scratch import small_batches


@dataclass(frozen=True)
class Limits:
    """Capacity of a sequence; open_bins bounds the sequences a task keeps open."""

    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048
    open_bins: int = 64


class VectorPacker:
    """Places demand vectors into open bins; bins are full lists of the items put into them."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.capacity = np.array([limits.tokens, limits.segments, limits.loss_tokens], np.int64)
        self.free = np.zeros((limits.open_bins, 3), np.int64)
        self.bins: list[list | None] = [None] * limits.open_bins

    def best(self, demand: np.ndarray) -> int | None:
        """The open bin of the largest dot product among those where demand fits; ties to the first."""
        fits = (self.free >= demand).all(axis=1)
        if not fits.any():
            return None
        scale = self.capacity.astype(float)
        dot = (self.free / scale) @ (demand / scale)
        return int(np.argmax(np.where(fits, dot, -1.0)))

    def room(self) -> int:
        """A slot for a new bin: an empty one, else that of the fullest bin, which the caller takes out."""
        for slot, items in enumerate(self.bins):
            if items is None:
                return slot
        return int(np.argmin(self.free[:, 0]))

    def open(self, slot: int) -> None:
        self.bins[slot] = []
        self.free[slot] = self.capacity

    def put(self, slot: int, item, demand: np.ndarray) -> None:
        self.bins[slot].append(item)
        self.free[slot] -= demand

    def take(self, slot: int) -> list:
        """Close a bin and give its items."""
        items, self.bins[slot] = self.bins[slot], None
        self.free[slot] = 0
        return items


def pack_cuttable(items, limits: Limits):
    """Sequences, as lists of (item, start, length), for (item, tokens, loss_from) that may be cut anywhere.

    Tokens before loss_from bear no loss.  Every sequence has limits.tokens
    tokens, or fewer where a segment or loss limit closes it or the items
    end; such rests are cut into lengths that are powers of two.  What is
    open at the end is laid end to end first, so that without such limits
    there are at most as many short sequences as limits.tokens has bits.
    """
    packer, size = VectorPacker(limits), limits.tokens

    def demand(start: int, length: int, loss_from: int) -> np.ndarray:
        return np.array([length, 1, max(0, start + length - max(start, loss_from))], np.int64)

    def close(slot: int):
        pieces = [p[:3] for p in packer.take(slot)]
        total = sum(p[2] for p in pieces)
        if total == size:
            yield pieces
        else:
            yield from _powers(pieces, total)

    for item, tokens, loss_from in items:
        start = 0
        while tokens - start >= size and size <= limits.loss_tokens:
            yield [(item, start, size)]
            start += size
        while start < tokens:
            left = min(tokens - start, size, limits.loss_tokens)
            slot = packer.best(demand(start, left, loss_from))
            if slot is None and None in packer.bins:
                packer.open(slot := packer.bins.index(None))
            elif slot is None:  # fill the fullest bin that takes any token
                slot = packer.room()
                left = int(min(left, packer.free[slot, 0], packer.free[slot, 2]))
            if left > 0:
                packer.put(slot, (item, start, left, loss_from), demand(start, left, loss_from))
                start += left
            if (packer.free[slot] <= 0).any():
                yield from close(slot)
    held: list[tuple] = []
    free, segments, loss = size, limits.segments, limits.loss_tokens
    for item, start, length, loss_from in [p for pieces in packer.bins if pieces for p in pieces]:
        while length:
            bare = min(length, max(0, loss_from - start))  # tokens that bear no loss come first
            got = min(length, free, bare + loss)
            if got <= 0 or segments <= 0:
                yield from _powers(held, size - free)
                held, free, segments, loss = [], size, limits.segments, limits.loss_tokens
                continue
            held.append((item, start, got))
            free, segments, loss = free - got, segments - 1, loss - max(0, got - bare)
            start, length = start + got, length - got
            if not free:
                yield held
                held, free, segments, loss = [], size, limits.segments, limits.loss_tokens
    yield from _powers(held, size - free)


def _powers(pieces: list, total: int):
    """Cut the pieces, laid end to end, into sequences whose lengths are the powers of two that sum to total; none for 0."""
    rest = list(reversed(pieces))
    while total:
        want = 1 << (total.bit_length() - 1)
        total -= want
        out = []
        while want:
            item, start, length = rest.pop()
            got = min(length, want)
            out.append((item, start, got))
            if got < length:
                rest.append((item, start + got, length - got))
            want -= got
        yield out


def pack_documents(docs: DataFrame, path: str, limits: Limits = Limits(), end_id: int = 1) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of every row of docs (doc_id, text).

    A document is its token ids and end_id; a null text is end_id alone.
    Each id lies in exactly one piece, and a sequence's pieces follow each
    other without gaps.  ids packs the piece's ids as little-endian
    unsigned 32-bit integers.  sequence_id is unique over all tasks.  Rows
    that repeat a doc_id are packed each; an empty table gives an empty
    result.  Every token of a document bears loss; examples whose prompts
    don't are for pack_examples.  path names the tokenizer's file on the
    workers.
    """
    small_batches(docs.sparkSession)
    end = int(end_id).to_bytes(4, "little")
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length")] + [("ids", pa.binary())] + [(n, pa.int64()) for n in ("doc_tokens", "sequence_id", "offset")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_bpe(path)
        base = TaskContext.get().partitionId() << 36

        def items():
            for b in batches:
                for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                    ids = coder.encode(text.as_py()) + end
                    yield (doc_id, ids), len(ids) // 4, 0

        rows: list[tuple] = []
        held = 0
        for sequence, pieces in enumerate(pack_cuttable(items(), limits)):
            offset = 0
            for (doc_id, ids), start, length in pieces:
                rows.append((doc_id, start, length, ids[4 * start : 4 * (start + length)], len(ids) // 4, base + sequence, offset))
                offset += length
            held += offset
            if held > 1 << 21:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    out = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, out)


def pack_examples(examples: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(example_id, bin_id) for whole examples (example_id, n_tokens, n_segments, n_loss): instruction data.

    A null demand counts as zero.  An example beyond a limit by itself gets
    a null bin_id; all others share bins within every limit.  Rows that
    repeat an example_id are placed each; an empty table gives an empty
    result.
    """
    capacity = [limits.tokens, limits.segments, limits.loss_tokens]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = VectorPacker(limits)
        base, made = TaskContext.get().partitionId() << 36, 0
        names: list[int | None] = [None] * limits.open_bins
        for b in batches:
            need = np.stack([b.column(k).fill_null(0).to_numpy(zero_copy_only=False) for k in ("n_tokens", "n_segments", "n_loss")], axis=1)
            out: list[int | None] = []
            for demand in need:
                if (demand > capacity).any():
                    out.append(None)
                    continue
                slot = packer.best(demand)
                if slot is None or packer.bins[slot] is None:
                    slot = packer.room()
                    if packer.bins[slot] is not None:
                        packer.take(slot)
                    packer.open(slot)
                    names[slot], made = base + made, made + 1
                packer.put(slot, None, demand)
                out.append(names[slot])
            yield pa.RecordBatch.from_arrays([b.column("example_id"), pa.array(out, pa.int64())], ["example_id", "bin_id"])

    cols = ["example_id", *(F.col(k).cast("long").alias(k) for k in ("n_tokens", "n_segments", "n_loss"))]
    kind = examples.select("example_id").dtypes[0][1]
    return examples.select(*cols).mapInArrow(run, f"example_id {kind}, bin_id long")



def conversation_examples(turns: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """(example_id, n_tokens, n_segments, n_loss) of each conversation of turns (conv_id, role, text).

    A turn is its token ids and end_id, one segment; those of the assistant
    bear loss.  A null text is end_id alone, a null role bears none, rows
    without conv_id are left out, repeated rows count each.  Counts combine
    before they shuffle, so a hot conversation is a row a task.
    """
    small_batches(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_bpe(path)
        for b in batches:
            n = [len(coder.encode(t.as_py())) // 4 + 1 for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("example_id"), b.column("bears"), pa.array(n, pa.int64())], ["example_id", "bears", "n"])

    bears = F.coalesce(F.lower("role") == "assistant", F.lit(False)).alias("bears")
    counted = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("example_id"), bears, "text").mapInArrow(run, "example_id long, bears boolean, n long")
    return counted.groupBy("example_id").agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_segments"), F.sum(F.when(F.col("bears"), F.col("n")).otherwise(0)).alias("n_loss"))
