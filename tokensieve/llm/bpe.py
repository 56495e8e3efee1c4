"""BPE encoding by segment trees over adjacent pair ranks, and decoding.

Every word is a row of symbols with one segment tree over its adjacent
pairs; a leaf holds ``rank * leaves + position`` of the pair that starts
there, so the root is the leftmost pair of lowest rank.  Merging it changes
three leaves, each of which updates the tree along one path to the root.
Many words of one tree size advance together as numpy passes, one merge of
every unfinished word a pass, until no root holds a mergeable pair; few of
a size, as very long words are, are merged one by one, each in time
n log n of its length.

Words are encoded once for each batch and kept in a bounded cache of the
worker, for texts repeat their words; very long ones aren't kept.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import small_batches, worker_cache

_NONE = np.int64(1) << np.int64(62)
_SPACES = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: White_Space code points, as the pattern \\s of the tokenizer has them.
_SPACE = re.compile(f"[{_SPACES}]+")
#: Below this code point normal form C changes nothing and lower case is per character.
_PLAIN_END = 0x180
_NOT_PLAIN = re.compile(f"[^\\x00-\\u{_PLAIN_END - 1:04x}]")


def _plain_class(kind: str) -> str:
    return "".join(f"\\u{c:04x}" for c in range(_PLAIN_END) if unicodedata.category(chr(c))[0] == kind)


_L, _N = _plain_class("L"), _plain_class("N")
#: The split of a lower-cased plain text into pieces.
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_SPACES}{_L}{_N}]+")
_CACHE_WORDS, _CACHE_LONGEST = 300_000, 256
#: Below so many words of one tree size a numpy pass costs more than it saves.
_LOCKSTEP = 48


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    extra = iter(range(0x100, 0x200))
    shown = {b: chr(b) for b in plain}
    return [shown[b] if b in shown else chr(next(extra)) for b in range(256)]


class MergeTable:
    """Ranks and results of merges, looked up by arrays of adjacent ids."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.base = max(vocab.values()) + 2
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        key = left * self.base + right
        _, first = np.unique(key, return_index=True)
        self.keys, self.ranks = key[first], first.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges] or [0], np.int32)
        self.rank_of = dict(zip(self.keys.tolist(), self.ranks.tolist()))
        self.made_of = self.made.tolist()

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, _NONE where it isn't a merge."""
        if not len(self.keys):
            return np.full(len(left), _NONE)
        key = left.astype(np.int64) * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)


def merge_words(symbols: np.ndarray, lengths: np.ndarray, table: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """Ids and their number for each word; symbols has all words' ids in a row."""
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(lengths) else lengths
    out, sizes = symbols.astype(np.int32).copy(), lengths.copy()
    alive = np.ones(len(out), bool)
    depth = np.ceil(np.log2(np.maximum(lengths, 2))).astype(np.int64)
    for d in np.unique(depth[lengths > 1]):
        leaves = 1 << int(d)
        rows = np.flatnonzero((depth == d) & (lengths > 1))
        if len(rows) < _LOCKSTEP:
            for s, n in zip(begin[rows].tolist(), lengths[rows].tolist()):
                merged = np.array(merge_word(out[s : s + n].tolist(), table), np.int32)
                out[s : s + n], alive[s : s + n] = merged, merged >= 0
            continue
        step = max(1, (1 << 19) // leaves)
        for at in range(0, len(rows), step):
            _merge_block(out, alive, begin, lengths, rows[at : at + step], leaves, table)
    ends = np.concatenate([[0], np.cumsum(alive)])
    sizes = ends[begin + lengths] - ends[begin] if len(lengths) else sizes
    return out[alive], sizes


def merge_word(sym: list[int], table: MergeTable) -> list[int]:
    """The symbols of one word once merged, each in the place of its first; -1 where one was merged away."""
    n = len(sym)
    leaves = 1 << (n - 1).bit_length()
    base, rank_of, made_of = table.base, table.rank_of, table.made_of
    none = len(made_of) * leaves
    tree = [none] * (2 * leaves)
    for i in range(n - 1):
        rank = rank_of.get(sym[i] * base + sym[i + 1])
        if rank is not None:
            tree[leaves + i] = rank * leaves + i
    for node in range(leaves - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b
    nxt, prv = [*range(1, n), -1], list(range(-1, n - 1))

    def put(leaf: int, left: int, right: int) -> None:
        """Point update: the pair at a leaf, then the path up to where nothing changes."""
        rank = rank_of.get(left * base + right) if right >= 0 else None
        node, value = leaf + leaves, none if rank is None else rank * leaves + leaf
        while node and tree[node] != value:
            tree[node] = value
            other = tree[node ^ 1]
            if other < value:
                value = other
            node >>= 1

    while n > 1 and tree[1] < none:
        rank, i = divmod(tree[1], leaves)
        j = nxt[i]
        k = nxt[i] = nxt[j]
        sym[i], sym[j] = made_of[rank], -1
        if k >= 0:
            prv[k] = i
        put(j, -1, -1)
        put(i, sym[i], sym[k] if k >= 0 else -1)
        if (p := prv[i]) >= 0:
            put(p, sym[p], sym[i])
    return sym


def _merge_block(out, alive, begin, lengths, rows, leaves, table) -> None:
    """Merge the words in rows, whose pairs fit in ``leaves`` leaves; marks the symbols merged away."""
    n = len(rows)
    base, size = begin[rows], lengths[rows]
    pos = np.arange(leaves)
    inside = pos < size[:, None]
    sym = np.where(inside, out[np.minimum(base[:, None] + pos, len(out) - 1)], -1).astype(np.int64)
    nxt = np.where(pos + 1 < size[:, None], pos + 1, -1)
    prv = np.where(inside, pos - 1, -1)
    gone = np.zeros((n, leaves), bool)
    tree = np.full((n, 2 * leaves), _NONE)
    r, c = np.nonzero(nxt >= 0)
    rank = table.rank(sym[r, c], sym[r, c + 1])
    tree[r, leaves + c] = np.where(rank < _NONE, rank * leaves + c, _NONE)
    level = leaves
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2
    act = np.arange(n)
    while True:
        act = act[tree[act, 1] < _NONE]
        if not len(act):
            break
        root = tree[act, 1]
        i = root % leaves
        j = nxt[act, i]
        sym[act, i] = table.made[root // leaves]
        gone[act, j] = True
        k = nxt[act, j]
        nxt[act, i] = k
        has = k >= 0
        prv[act[has], k[has]] = i[has]
        _set_leaf(tree, act, j, np.full(len(act), _NONE), leaves)
        pair = np.full(len(act), _NONE)
        rank = table.rank(sym[act[has], i[has]], sym[act[has], k[has]])
        pair[has] = np.where(rank < _NONE, rank * leaves + i[has], _NONE)
        _set_leaf(tree, act, i, pair, leaves)
        p = prv[act, i]
        has = p >= 0
        rank = table.rank(sym[act[has], p[has]], sym[act[has], i[has]])
        _set_leaf(tree, act[has], p[has], np.where(rank < _NONE, rank * leaves + p[has], _NONE), leaves)
    r, c = np.nonzero(inside)
    out[base[r] + c] = sym[r, c]
    alive[base[r] + c] = ~gone[r, c]


def _set_leaf(tree, rows, leaf, value, leaves) -> None:
    """Point update: one leaf of each row, then the path to its root."""
    node = leaf + leaves
    tree[rows, node] = value
    while leaves > 1:
        node >>= 1
        leaves >>= 1
        tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])


class WordBpe:
    """A tokenizer with word ends (lower case, white space dropped), read from its JSON file.

    encode() gives the ids that the tokenizers library gives without
    special tokens added; the strings of special tokens in a text become
    their ids, as they do there.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        vocab = dict(model["vocab"])
        end = model["end_of_word_suffix"] or ""
        self.table = MergeTable(vocab, [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        shown = byte_alphabet()
        self.inner = np.array([vocab[x] for x in shown], np.int32)
        self.final = np.array([vocab[x + end] for x in shown], np.int32)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in (vocab | self.special).items()}
        self.bytes_of = {c: b for b, c in enumerate(shown)}
        self.splits = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre = library.normalizer, library.pre_tokenizer

    def pieces(self, text: str) -> list[str | int]:
        """The parts of a text that are merged on their own, in the alphabet's order; an int is a special token's id."""
        if self.splits and self.splits.search(text):
            parts = self.splits.split(text)
            return [x for p in parts for x in ([self.special[p]] if p in self.special else self.pieces(p) if p else [])]
        if text.isascii() or not _NOT_PLAIN.search(text):
            return _PIECE.findall(text.lower())
        out: list[str | int] = []
        for word in _SPACE.split(text):
            if not _NOT_PLAIN.search(word):
                out += _PIECE.findall(word.lower())
                continue
            shown = self.pre.pre_tokenize_str(self.normalizer.normalize_str(word))
            out += [bytes(self.bytes_of[c] for c in p).decode() for p, _ in shown]
        return out

    def encode_pieces(self, pieces: list[str | int]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        ids_of = {p: p.to_bytes(4, "little") for p in pieces if isinstance(p, int)}
        plain = [p.encode() for p in pieces if not isinstance(p, int)]
        raw = np.frombuffer(b"".join(plain), np.uint8)
        lengths = np.array([len(p) for p in plain], np.int64)
        symbols = self.inner[raw]
        if len(lengths):
            last = np.cumsum(lengths) - 1
            symbols[last] = self.final[raw[last]]
        ids, sizes = merge_words(symbols, lengths, self.table)
        flat, ends = ids.astype("<u4").tobytes(), (np.cumsum(sizes) * 4).tolist()
        made = iter([flat[a:b] for a, b in zip([0, *ends], ends)])
        return [ids_of[p] if isinstance(p, int) else next(made) for p in pieces]

    def decode_ids(self, ids: bytes) -> str:
        """The tokens' strings joined by a space, as a tokenizer without a decoder has them."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def word_bpe(path: str) -> WordBpe:
    """The tokenizer in path; workers keep it across tasks."""
    cache = worker_cache()
    if ("bpe", path) not in cache:
        cache[("bpe", path)] = WordBpe(path)
        cache[("words", path)] = {}
    return cache[("bpe", path)]


def encode_texts(texts: list[str | None], path: str) -> list[bytes]:
    """Ids of each text, as packed bytes."""
    bpe = word_bpe(path)
    known = worker_cache()[("words", path)]
    split = [bpe.pieces(t) if t else [] for t in texts]
    fresh = list(set().union(*split).difference(known))
    if len(known) + len(fresh) > _CACHE_WORDS:
        known.clear()
        fresh = list(set().union(*split))
    for at in range(0, len(fresh), 200_000):
        known.update(zip(fresh[at : at + 200_000], bpe.encode_pieces(fresh[at : at + 200_000])))
    out = [b"".join(map(known.__getitem__, pieces)) for pieces in split]
    for piece in fresh:
        if isinstance(piece, str) and len(piece) > _CACHE_LONGEST:
            del known[piece]
    return out


def decode_texts(ids: list[bytes], path: str) -> list[str]:
    """Decoded text of each packed sequence."""
    bpe = word_bpe(path)
    return [bpe.decode_ids(x) for x in ids]


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) for every row of docs (doc_id, text).

    ids: the text's token ids as little-endian unsigned 32-bit integers in
    a binary; decoded: what decoding the ids gives.  A null text counts as
    empty and has no ids.  Rows that repeat a doc_id come back each, an
    empty table gives an empty result.  path names the tokenizer's file on
    the workers.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = encode_texts(part.column("text").to_pylist(), path)
                cols = [part.column("doc_id"), pa.array(ids, pa.binary()), pa.array(decode_texts(ids, path), pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary, decoded string")
