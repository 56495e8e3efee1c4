"""SimHash near-duplicates: segment-popcount embedding, grid range-join, exact check.

A 64-bit fingerprint is cut into 32 segments of two bits.  Its embedding is
the vector of bits set in each segment; the Manhattan distance of two
embeddings never exceeds the Hamming distance of the fingerprints.  Written
in unary (0, 1, 2 set bits as 00, 01, 11) that distance is one XOR and one
popcount.

The grid range-join: the segments form blocks.  Embeddings within Manhattan
distance d differ in at most d blocks, so they agree on all but d of them.
Each choice of the blocks agreed on is a grid; two fingerprints within
reach share a cell of at least one grid, and none outside a shared cell is
looked at.  With 8 blocks and distance 4 that is 70 grids of about 22.6
bits; more fingerprints get more blocks, so that cells of unrelated ones
stay small.

Cells are counted first.  The rows of a cell beyond a size are dealt anew
over finer grids: what the cell doesn't fix of the segments forms blocks
again, of which again all but d agree.  So a dense cell is split over tasks
without a pair lost, down to cells that fix all but d segments.

Only distinct fingerprints enter the grids, so any number of exact copies
is one row.  A cell is searched breadth first and gives the edges of a
spanning forest, at most one for each of its rows: no pair list is made,
and connectivity is exact.

Documents of a similarity (Jaccard index of their word shingles) differ in
more bits than such grids can afford: 0.8 is about ten of 64.  similar_texts
therefore takes sketches of 256 bits and grids of single-bit segments drawn
at random, as many as meet any such pair with probability ``recall``.  A pair
counts in the first grid whose cell it shares.  Sketches in reach become
candidate edges of least-distance spanning forests, three of them where
distances leave doubt.  Two rounds verify on the shingles the nearest edge of
each text that could join two groups.  They only settle first what most
likely holds, by two edges a text at most: then every other pair in reach
whose texts are still in two groups is verified too, in tiles of its cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .hashing import mix
from .scratch import free_shuffles, light, release, small_batches, store

_CHUNK = 1 << 16
#: Cells of up to so many rows are searched only if a pair in them is within reach.
_SMALL = 64
_CELL = "cell long, mask long, fp long"
#: Spanning forests of edges of a cell, of which the nearest are verified first; open_rows finds what they leave.
_FORESTS = 3
#: Rows and bytes of shingle sets of one block of a cell; a tile holds two blocks.
_TILE_ROWS, _TILE_BYTES = 1 << 11, 16 << 20
#: Bits of a sketch; seeds make its words from one hash.
_BITS = 256
_SEEDS = mix(np.arange(1, _BITS // 64 + 1, dtype=np.uint64))
#: Low bits of a cell's number that name its grid.
_GRID_BITS = 12


def _shingles(text: str | None, size: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of each shingle of a text's words, some at a time; words are lower-cased in A-Z only.

    A text with fewer words than a shingle is one shingle; no words (or
    null) give none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    body = b" ".join(words)
    size = min(size, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1].tolist()
    ends = ends[size - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    for at in range(0, len(starts), _CHUNK):
        yield np.array([h(body[s:e], 42) for s, e in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK])], dtype="<u8")


def _bit_counts(words: np.ndarray) -> np.ndarray:
    """How many rows of 64-bit words have each bit, lowest first."""
    return np.unpackbits(words.view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Unsigned fingerprint: bit b is set if it is set in more than half of the shingles' XXH64; no words (or null) give zero."""
    counts, n = np.zeros(64, np.int64), 0
    for part in _shingles(text, shingle):
        counts, n = counts + _bit_counts(part.reshape(-1, 1)), n + len(part)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """The text's distinct shingle hashes, sorted."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *_shingles(text, shingle)]))


def sketch(text: str | None, shingle: int = 5) -> np.ndarray:
    """Four 64-bit words: the majority of each bit over hashes of 256 bits of the text's distinct shingles."""
    hashes = shingle_set(text, shingle)
    counts = np.zeros(_BITS, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        counts += _bit_counts(mix(hashes[at : at + _CHUNK, None] ^ _SEEDS))
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index of two sorted sets; 1 for two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def unary(fp: np.ndarray) -> np.ndarray:
    """The embedding of each fingerprint, every segment's popcount in unary."""
    odd = np.uint64(0x5555555555555555)
    high = fp >> np.uint64(1)
    return ((fp | high) & odd) | (((fp & high) & odd) << np.uint64(1))


def _masks(mask: int, distance: int, blocks: int) -> list[int]:
    """The mask with all choices of blocks but ``distance`` of the segments that it leaves free; none if too few are free."""
    free = [3 << b for b in range(0, 64, 2) if not mask >> b & 3]
    if len(free) <= distance:
        return []
    parts = np.array_split(np.array(free, object), min(blocks, len(free)))
    return [mask | sum(int(x) for i in c for x in parts[i]) for c in combinations(range(len(parts)), len(parts) - distance)]


def blocks_for(rows: int, distance: int, mates: int = 32) -> int:
    """The fewest blocks, twice the distance at least, whose cells hold at most ``mates`` unrelated fingerprints of so many."""
    for blocks in range(max(2 * distance, distance + 1), 32):
        agreed = min(m.bit_count() for m in _masks(0, distance, blocks)) // 2
        if rows * (3 / 8) ** agreed <= mates:  # chance that two random bits and two others have one popcount
            return blocks
    return 32


def spanning_edges(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, seed) edges that join fp's rows within ``distance`` bits of each other, through others too."""
    t = unary(fp)
    alive = np.arange(len(fp))
    members, seeds = [], []
    while len(alive) > 1:
        seed, alive, front = alive[0], alive[1:], [alive[0]]
        while front and len(alive):
            f = front.pop()
            near = np.bitwise_count(t[alive] ^ t[f]) <= distance  # Manhattan bound
            if not near.any():
                continue
            near[near] = np.bitwise_count(fp[alive[near]] ^ fp[f]) <= distance
            got = alive[near]
            if len(got):
                members.append(fp[got])
                seeds.append(np.full(len(got), fp[seed]))
                front.extend(got.tolist())
                alive = alive[~near]
    none = np.zeros(0, np.uint64)
    return (np.concatenate(members), np.concatenate(seeds)) if members else (none, none)


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp) for every row of docs (doc_id, text): fp is the fingerprint as a signed long, text_hash Spark's xxhash64."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, shingle) for t in b.column("text").to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(fp.view(np.int64))], ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _cells(masks: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (cell, mask, fp) of the fingerprints in the grids of the masks."""
    t, salt = unary(fp), mix(masks)
    for at in range(0, len(fp), 4096):
        cell = mix((t[at : at + 4096, None] & masks) ^ salt)
        n = len(cell)
        cols = [cell.ravel(), np.tile(masks, n), np.repeat(fp[at : at + 4096], len(masks))]
        yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in cols], ["cell", "mask", "fp"])


def _grid(distinct: DataFrame, masks: list[int]) -> DataFrame:
    top = np.array(masks, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _cells(top, b.column("fp").to_numpy().view(np.uint64))

    return distinct.select("fp").mapInArrow(run, _CELL)


def _refined(rows: DataFrame, distance: int, blocks: int) -> DataFrame:
    """The rows (mask, fp) of dense cells in the finer grids of their masks; rows whose mask can't be refined keep their cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mask, fp = (b.column(c).to_numpy().view(np.uint64) for c in ("mask", "fp"))
            for m in np.unique(mask).tolist():
                yield from _cells(np.array(_masks(m, distance, blocks) or [m], np.uint64), fp[mask == m])

    return rows.select("mask", "fp").mapInArrow(run, _CELL)


def _search_cells(cell: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the links within each cell; rows are sorted by cell and fp."""
    new = np.ones(len(cell), bool)
    new[1:] = (cell[1:] != cell[:-1]) | (fp[1:] != fp[:-1])
    cell, fp = cell[new], fp[new]
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    size = np.diff(np.append(first, len(cell)))
    few = np.repeat((size > 1) & (size <= _SMALL), size)
    owner, f, t = np.repeat(np.arange(len(size)), size)[few], fp[few], unary(fp[few])
    linked = np.zeros(len(size), bool)
    for off in range(1, _SMALL):
        at = np.flatnonzero(owner[off:] == owner[:-off])
        if not len(at):
            break
        at = at[np.bitwise_count(t[at] ^ t[at + off]) <= distance]  # Manhattan bound
        linked[owner[at[np.bitwise_count(f[at] ^ f[at + off]) <= distance]]] = True
    linked |= size > _SMALL
    found = [spanning_edges(fp[s : s + n], distance) for s, n in zip(first[linked].tolist(), size[linked].tolist())]
    none = [np.zeros(0, np.uint64)]
    return np.concatenate([u for u, _ in found] or none), np.concatenate([v for _, v in found] or none)


def _search(grid: DataFrame, distance: int) -> DataFrame:
    """Edges (u, v) that span the links within each cell of the grid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            u, v = _search_cells(cell, fp, distance)
            pairs = np.unique(np.stack([u, v], axis=1), axis=0).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

        held: list[tuple[np.ndarray, np.ndarray]] = []  # the last cell, which may go on in the next batch
        for b in batches:
            cell, fp = (b.column(c).to_numpy().view(np.uint64) for c in ("cell", "fp"))
            if not len(cell):
                continue
            start = int(np.flatnonzero(cell == cell[-1])[0])
            if start or held and held[0][0][0] != cell[0]:
                yield found(np.concatenate([*(h[0] for h in held), cell[:start]]), np.concatenate([*(h[1] for h in held), fp[:start]]))
                held = []
            held.append((cell[start:], fp[start:]))
        if held:
            yield found(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))

    dealt = grid.select("cell", "fp").repartition("cell").sortWithinPartitions("cell", "fp")
    return dealt.mapInArrow(run, "u long, v long").distinct()


def link_edges(distinct: DataFrame, distance: int = 4, blocks: int | None = None, cell_rows: int = 1 << 14) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp) that span the same components as all links.

    blocks: see blocks_for, which is the default.  Cells of more than
    cell_rows rows are dealt over finer grids.  An empty table gives none.
    """
    spark = distinct.sparkSession
    small_batches(spark)
    masks = _masks(0, distance, blocks or blocks_for(distinct.count(), distance))
    grid, parts, held = _grid(distinct, masks), [], []
    while True:
        hot = store(grid.groupBy("cell").agg(F.count("*").alias("rows")).where(F.col("rows") > cell_rows).select("cell"))
        finer = [_masks(m, distance, 2 * distance) for m in masks]
        if not any(finer) or hot.isEmpty():
            parts.append(_search(grid, distance))
            release(hot)
            break
        parts.append(_search(grid.join(hot, "cell", "left_anti"), distance))
        grid = store(_refined(grid.join(hot, "cell"), distance, 2 * distance))
        masks = list({m for more in finer for m in more})
        held.append(hot)
    edges = parts[0]
    for p in parts[1:]:
        edges = edges.unionByName(p)
    if held:
        edges = store(edges)
        release(*held)
    return edges


def _grouped(docs: DataFrame, distance: int = 4, shingle: int = 4, blocks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Two stored tables: fingerprints(docs), and (fp, first) with the first row of fp's component.

    first is (no_id, doc_id, text_hash) of the component's least row, null
    doc_ids last.
    """
    fps = store(fingerprints(docs, shingle))
    row = F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "text_hash")
    groups = store(fps.groupBy("fp").agg(F.min(row).alias("first")))
    joined = connected_components(link_edges(groups, distance, blocks))
    rooted = store(groups.join(joined, groups.fp == joined.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("root")))
    release(groups, joined)
    least = store(rooted.groupBy("root").agg(F.min("first").alias("first")))
    named = store(rooted.select("fp", "root").join(least, "root").select("fp", "first"))
    release(rooted, least)
    return fps, named


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4, blocks: int | None = None) -> DataFrame:
    """(doc_id, text_hash, fp, component_id) for every row of docs (doc_id, text).

    component_id is the smallest doc_id that links of ``distance`` bits or
    fewer reach, itself included; null only where every doc_id of the
    component is null.  Texts without words share the fingerprint zero.
    Rows that repeat a doc_id come back as often.  An empty table gives an
    empty result.
    """
    fps, named = _grouped(docs, distance, shingle, blocks)
    return fps.join(named, "fp").select("doc_id", "text_hash", "fp", F.col("first.doc_id").alias("component_id"))


def _first_rows(docs: DataFrame, named: DataFrame, null_ids_stay: bool = False) -> DataFrame:
    """The rows of docs that are the first of their group; named: (doc_id, text_hash, first) of every row."""
    first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    keys = named.groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_text"), first.alias("_first")).agg(F.count("*").alias("_n"))
    keys = keys.where("_doc is not null") if null_ids_stay else keys
    gone = store(keys.where("not _first or _n > 1").select("_doc", "_text", "_first"))

    def same(other: DataFrame):
        return docs["doc_id"].cast("long").eqNullSafe(other["_doc"]) & (F.xxhash64(docs["text"]) == other["_text"])

    names = docs.columns
    again = gone.where("_first")
    gone, again = light(gone), light(again)
    copies = docs.join(again, same(again)).select(F.struct("_doc", "_text").alias("_key"), F.struct(*[docs[c] for c in names]).alias("_row"))
    once = copies.groupBy("_key").agg(F.min("_row").alias("_row")).select("_row.*")
    return docs.join(gone, same(gone), "left_anti").unionByName(once)


def drop_near_duplicates(docs: DataFrame, null_ids_stay: bool = True, **options) -> DataFrame:
    """One row of each component: the smallest doc_id, then text hash, then the other columns.

    Rows with a null doc_id all stay besides; without ``null_ids_stay`` they
    are rows like others, that come after every doc_id.
    """
    fps, named = _grouped(docs, **options)
    out = _first_rows(docs, fps.join(named, "fp"), null_ids_stay)
    release(fps, named)
    return out


def bit_difference(similarity: float) -> float:
    """Expected share of differing bits of the sketches of two texts of a Jaccard similarity, by the angle between their shingle sets."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def grids_for(rows: int, similarity: float, recall: float, mates: int = 8) -> tuple[int, int]:
    """(bits of a grid's cell, grids): cells hold about ``mates`` unrelated sketches, and a pair shares one with probability recall.

    Where that takes more grids than a cell's number can name, cells are of
    fewer bits and hold more.
    """
    bits = min(max(8, math.ceil(math.log2(max(rows, 1) / mates)) if rows > mates else 8), 60)
    while True:
        chance = (1 - bit_difference(similarity)) ** bits
        grids = math.ceil(math.log(1 - recall) / math.log1p(-chance))
        if grids <= 1 << _GRID_BITS or bits == 1:
            return bits, grids
        bits -= 1


def reach_of(similarity: float, deviations: float = 2.6) -> int:
    """The differing bits of a sketch within which all but one in 200 pairs of the similarity are."""
    p = bit_difference(similarity)
    return math.ceil(_BITS * p + deviations * math.sqrt(_BITS * p * (1 - p)))


def forest(sketches: np.ndarray, reach: int, times: int = 1, sure: int = -1, earlier: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, parent, distance) of least-distance spanning forests of the rows within reach, each of edges that the ones before left.

    Distances estimate similarities, so the first forest alone may hold
    rows together by edges that don't stand up to verification; rows that
    edges of at most ``sure`` bits join need no further ones.  Pairs that
    agree on any of the masks in ``earlier`` are left out.
    """
    n = len(sketches)
    apart = np.arange(n)  # rows with one number need no edge between them
    used: list[list[int]] = [[i] for i in range(n)]
    out = []
    for turn in range(times):
        best, parent, wait = np.full(n, 9999), np.full(n, -1), np.zeros(n, np.int64)
        for _ in range(n):
            i = int(np.argmin(best + wait))
            wait[i] = 100_000
            far = np.bitwise_count(sketches ^ sketches[i]).sum(axis=1, dtype=np.int64)
            far[used[i]] = 9999
            if turn:
                far[apart == apart[i]] = 9999
            near = np.flatnonzero((wait == 0) & (far <= reach) & (far < best))
            if earlier is not None and len(earlier) and len(near):
                near = near[~((sketches[near] ^ sketches[i])[:, None, :] & earlier == 0).all(axis=2).any(axis=1)]
            best[near], parent[near] = far[near], i
        at = np.flatnonzero(parent >= 0)
        if not len(at):
            break
        out.append((at, parent[at], best[at]))
        for i, j, d in zip(at.tolist(), parent[at].tolist(), best[at].tolist()):
            used[i].append(j)
            used[j].append(i)
            if d <= sure and apart[i] != apart[j]:
                apart[apart == apart[i]] = apart[j]
    none = [np.zeros(0, np.int64)]
    return tuple(np.concatenate([x[k] for x in out] or none) for k in range(3))


def _words_of(column: pa.Array) -> np.ndarray:
    """Sketches of a binary column, a row of 64-bit words each."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(len(column), -1)


def _sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, text_hash, sketch) of every row; a sketch is 32 bytes."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sketch(t, shingle).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(made, pa.binary())], ["doc_id", "text_hash", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, sketch binary")


def _choices(bits: int, grids: int, seed: int) -> np.ndarray:
    """Masks of ``bits`` bits of a sketch each, drawn by a fixed seed."""
    drawn = np.argsort(np.random.default_rng(seed).random((grids, _BITS)), axis=1)[:, :bits]
    flags = np.zeros((grids, _BITS), np.uint8)
    np.put_along_axis(flags, drawn, 1, axis=1)
    return np.packbits(flags, axis=1, bitorder="little").view("<u8").astype(np.uint64)


def _bit_grid(nodes: DataFrame, chosen: np.ndarray) -> DataFrame:
    """(cell, id, sketch, group and n if nodes have them): every node in each grid; rows with a column ``outer`` meet only within it.  A cell's low bits name its grid."""
    inner, longs = "outer" in nodes.columns, ["id", *(c for c in ("group", "n") if c in nodes.columns)]
    low = np.uint64((1 << _GRID_BITS) - 1)
    grid = np.arange(len(chosen), dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sk = _words_of(part.column("sketch"))
                cell = np.zeros((len(sk), len(chosen)), np.uint64)
                if inner:
                    cell += part.column("outer").to_numpy().view(np.uint64)[:, None]
                for w in range(sk.shape[1]):
                    cell = mix(cell ^ (sk[:, w, None] & chosen[:, w]) ^ np.uint64(w + 1))
                cell = (cell & ~low) | grid & low
                again = np.repeat(np.arange(len(sk)), len(chosen))
                cols = [pa.array(cell.ravel().view(np.int64)), *(part.column(c).take(pa.array(again)) for c in ("sketch", *longs))]
                yield pa.RecordBatch.from_arrays(cols, ["cell", "sketch", *longs])

    return nodes.select("sketch", *longs, *["outer"] * inner).mapInArrow(run, ", ".join(["cell long, sketch binary", *(f"{c} long" for c in longs)]))


def _whole_cells(batches: Iterator[pa.RecordBatch], key: str, names: tuple[str, ...]) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of rows sorted by the key, in parts that cut no key's rows; sketches as words, shingle sets as arrays."""

    def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
        if name == "sketch":
            return _words_of(batch.column(name))
        if name == "shingles":
            out = np.empty(batch.num_rows, object)
            for i, s in enumerate(batch.column(name)):
                out[i] = np.frombuffer(s.as_buffer(), "<u8")
            return out
        return batch.column(name).to_numpy(zero_copy_only=False)

    held: list[tuple] = []  # the last key's rows, which may go on in the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        part = tuple(column(batch, c) for c in (key, *names))
        start = int(np.flatnonzero(part[0] == part[0][-1])[0])
        if start or held and held[0][0][0] != part[0][0]:
            held.append(tuple(x[:start] for x in part))
            yield tuple(np.concatenate(x) for x in zip(*held))
            held = []
        held.append(tuple(x[start:] for x in part))
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _apart(sk: np.ndarray, group: np.ndarray, i: int, reach: int, earlier: np.ndarray) -> np.ndarray:
    """The rows in reach of row i that are of another group and agree with it on none of the masks in ``earlier``."""
    other = np.flatnonzero(group != group[i])
    off = sk[other] ^ sk[i]
    near = np.bitwise_count(off).sum(axis=1, dtype=np.int64) <= reach
    other, off = other[near], off[near]
    for at in range(0, len(earlier) if len(other) else 0, 64):
        new = (off[:, None, :] & earlier[at : at + 64]).any(axis=2).all(axis=1)
        other, off = other[new], off[new]
    return other


def _forests(grid: DataFrame, similarity: float, chosen: np.ndarray) -> DataFrame:
    """(u, v, d): the forests' edges of each cell, u < v, each once; d is the sketches' distance.

    A pair that shares the cell of an earlier grid (of chosen) has had its
    turn there.  Pairs in reach that the forests leave are left to open_rows.
    """
    reach, sure = reach_of(similarity), int(_BITS * bit_difference((1 + similarity) / 2))

    def found(cell: np.ndarray, ids: np.ndarray, sk: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        size = np.diff(np.append(first, len(cell)))
        owner = np.repeat(np.arange(len(size)), size)
        linked = size > _SMALL
        few = np.flatnonzero(np.repeat((size > 1) & ~linked, size))
        o, s = owner[few], sk[few]
        for off in range(1, _SMALL):
            at = np.flatnonzero(o[off:] == o[:-off])
            if not len(at):
                break
            near = np.bitwise_count(s[at] ^ s[at + off]).sum(axis=1, dtype=np.int64) <= reach
            linked[o[at[near]]] = True
        rows = [np.zeros((0, 3), np.int64)]
        for start, n in zip(first[linked].tolist(), size[linked].tolist()):
            number = int(cell[start]) & ((1 << _GRID_BITS) - 1)
            i, j, d = forest(sk[start : start + n], reach, _FORESTS, sure, chosen[:number])
            u, v = ids[start + i], ids[start + j]
            rows.append(np.stack([np.minimum(u, v), np.maximum(u, v), d], axis=1))
        pairs = np.unique(np.concatenate(rows), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, k]) for k in range(3)], ["u", "v", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_cells(batches, "cell", ("id", "sketch")):
            yield found(*part)

    dealt = grid.repartition("cell").sortWithinPartitions("cell", "id")
    return dealt.mapInArrow(run, "u long, v long, d long").distinct()


def _open_cells(grid: DataFrame, similarity: float, chosen: np.ndarray) -> DataFrame:
    """(cell, id, nth, sketch, group, n) of the rows that are in reach of a row of another group in their cell.

    Of the masks chosen, the first nth are of grids where a pair would have
    had its turn before.
    """
    reach = reach_of(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, ids, sk, group, n in _whole_cells(batches, "cell", ("id", "sketch", "group", "n")):
            first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            mixed = np.minimum.reduceat(group, first) != np.maximum.reduceat(group, first)
            ends = np.append(first[1:], len(cell))
            open_, nth = np.zeros(len(cell), bool), cell & ((1 << _GRID_BITS) - 1) if len(chosen) else np.zeros_like(cell)
            for start, end in zip(first[mixed].tolist(), ends[mixed].tolist()):
                s, g, o = sk[start:end], group[start:end], open_[start:end]
                names, code, size = np.unique(g, return_inverse=True, return_counts=True)
                for i in np.flatnonzero(code != np.argmax(size)).tolist():  # of any such pair, one row is outside the largest group
                    got = _apart(s, g, i, reach, chosen[: int(nth[start])])
                    o[got] = True
                    o[i] |= len(got) > 0
            cols = [*(pa.array(x[open_]) for x in (cell, ids, nth, group, n)), pa.array([x.tobytes() for x in sk[open_]], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["cell", "id", "nth", "group", "n", "sketch"])

    dealt = grid.repartition("cell").sortWithinPartitions("cell", "id")
    return dealt.mapInArrow(run, "cell long, id long, nth long, group long, n long, sketch binary")


def _over_grids(nodes: DataFrame, similarity: float, recall: float, cell_rows: int, search, rows: int) -> tuple[list[DataFrame], list[DataFrame], np.ndarray]:
    """search(grid, similarity, masks) of the grids that ``rows`` nodes call for and of the finer ones of dense cells; what they read; the first masks.

    Dense cells of nodes of one group are left out.
    """
    bits, grids = grids_for(rows, similarity, recall)
    top = chosen = _choices(bits, grids, 7)
    grid, parts, held = _bit_grid(nodes, chosen), [], []
    mixed = F.min("group") < F.max("group") if "group" in nodes.columns else F.lit(True)
    for level in range(1, 8):
        dense = store(grid.groupBy("cell").agg(F.count("*").alias("rows"), mixed.alias("mixed")).where(F.col("rows") > cell_rows).select("cell", "mixed"))
        held.append(dense)
        hot = dense.where("mixed")
        done = level == 7 or hot.isEmpty()
        apart = dense.where("not mixed") if done else dense
        parts.append(search(grid if apart.isEmpty() else grid.join(apart, "cell", "left_anti"), similarity, chosen))
        if done:
            break
        more, times = grids_for(1 << 13, similarity, recall, mates=128)
        grid = store(_bit_grid(grid.join(hot.select("cell"), "cell").withColumnRenamed("cell", "outer"), _choices(more, times, 7 + level)))
        chosen = chosen[:0]
        held.append(grid)
    return parts, held, top


def candidate_edges(nodes: DataFrame, similarity: float = 0.8, recall: float = 0.99, cell_rows: int = 1 << 13) -> DataFrame:
    """A stored table (u, v, d) of edges between the nodes (id, sketch) whose sketches are near enough for the similarity.

    Every node that has such a partner in a cell has an edge; they span, with
    probability recall for each pair, what such pairs join if all of them
    hold.  Cells of more than cell_rows rows are dealt over grids of more bits.
    """
    parts, held, _ = _over_grids(nodes, similarity, recall, cell_rows, _forests, nodes.count())
    edges = parts[0]
    for p in parts[1:]:
        edges = edges.unionByName(p)
    out = store(edges.groupBy("u", "v").agg(F.min("d").alias("d")) if len(parts) > 1 else edges)
    release(*held)
    return out


def open_rows(nodes: DataFrame, rows: int, similarity: float = 0.8, recall: float = 0.99, cell_rows: int = 1 << 13) -> tuple[DataFrame, np.ndarray]:
    """A stored table (cell, id, nth, sketch, group, n) of the nodes (id, sketch, group, n) that share a cell with a near one of another group, and the grids' masks.

    n: bytes of a node's shingles.  rows: the nodes that candidate_edges had, of which these are the ends of
    edges.  The masks are then the same, and no pair is missed that was in
    reach in a cell there.
    """
    parts, held, masks = _over_grids(nodes, similarity, recall, cell_rows, _open_cells, rows)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    out = store(found)
    release(*held)
    return out, masks


def settled_links(rows: DataFrame, masks: np.ndarray, sets: DataFrame, similarity: float) -> DataFrame:
    """A stored table of pairs of groups (u, v) that join the groups of open_rows as all links between the rows do.

    A cell's rows form blocks of bounded size, and each two blocks a tile;
    within a tile every pair in reach is verified whose groups the tile's
    links haven't joined yet.
    """
    reach = reach_of(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile, nth, block, two, sk, group, sets_ in _whole_cells(batches, "tile", ("nth", "block", "two", "sketch", "group", "shingles")):
            first = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]])).tolist()
            links = [np.zeros((0, 2), np.int64)]
            for start, end in zip(first, [*first[1:], len(tile)]):
                s, root, b, across = sk[start:end], group[start:end].copy(), block[start:end], bool(two[start])
                size = np.fromiter(map(len, sets_[start:end]), np.int64, end - start)
                for i in range(end - start - 1):
                    rest = slice(i, end - start)  # row i and those after it
                    got = i + _apart(s[rest], root[rest], 0, reach, masks[: int(nth[start])])
                    fits = np.minimum(size[got], size[i]) >= similarity * np.maximum(size[got], size[i]) - 1e-6
                    for j in got[fits & ((b[got] != b[i]) | (not across))].tolist():
                        if root[j] != root[i] and similarity_of(sets_[start + i], sets_[start + j]) >= similarity:
                            links.append(np.array([[group[start + i], group[start + j]]]))
                            root[root == root[j]] = root[i]
            pairs = np.unique(np.concatenate(links), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    blocks = F.ceil(F.greatest(F.sum("n") / _TILE_BYTES, F.count("*") / _TILE_ROWS)).cast("int")
    many = store(rows.groupBy("cell").agg(blocks.alias("blocks")).where("blocks > 1"))
    placed = rows.join(light(many), "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    tile = F.xxhash64("cell", F.least("block", "other"), F.greatest("block", "other"))
    placed = placed.select("id", "nth", "sketch", "group", "block", (F.col("block") != F.col("other")).cast("long").alias("two"), tile.alias("tile"))
    # Of a tile of two blocks each row comes once, for its own block and the other.
    full = placed.join(sets.select("id", "shingles").hint("merge"), "id")
    out = store(full.repartition("tile").sortWithinPartitions("tile", "id").mapInArrow(run, "u long, v long"))
    release(many)
    return out


def _verified(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """A stored table of the edges (u, v and longs) whose texts' shingle sets (id, shingles) are of the similarity."""
    names = edges.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([np.frombuffer(s.as_buffer(), "<u8") for s in batch.column(c)] for c in ("su", "sv"))
            true = [similarity_of(p, q) >= similarity for p, q in zip(x, y)]
            yield batch.select(names).filter(pa.array(true, pa.bool_()))

    # The sets grow with the corpus, so they are merged, never broadcast.
    one = edges.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("su")).hint("merge"), "u")
    both = one.join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("sv")).hint("merge"), "v").select(*names, "su", "sv")
    return store(both.mapInArrow(run, ", ".join(f"{c} long" for c in names)))


def _nearest(edges: DataFrame) -> DataFrame:
    """A stored table of the nearest edge of each text, each once: of edges (u, v, d and more), u < v, all but d."""
    more = [c for c in edges.columns if c not in ("u", "v", "d")]
    ways = edges.unionByName(edges.withColumns({"u": F.col("v"), "v": F.col("u")}))
    least = ways.groupBy("u").agg(F.min(F.struct("d", "v", *more)).alias("to"))
    return store(least.select(F.least("u", "to.v").alias("u"), F.greatest("u", "to.v").alias("v"), *(f"to.{c}" for c in more)).distinct())


def _regrouped(rows: DataFrame, wider: DataFrame) -> DataFrame:
    """The rows with the components (node, component) of their groups as groups."""
    found = rows.join(light(wider), rows["group"] == wider["node"], "left")
    return found.select(*(F.coalesce("component", "group").alias("group") if c == "group" else rows[c] for c in rows.columns))


def similar_texts(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, recall: float = 0.99) -> tuple[DataFrame, DataFrame]:
    """Two stored tables: (doc_id, text_hash, sketch) of every row of docs (doc_id, text), and (text_hash, sketch, first) of every distinct text.

    first is (no_id, doc_id, text_hash) of the least row, null doc_ids
    last, that links between texts of the similarity reach.  A text is its
    64-bit hash and its sketch.
    """
    rows = store(_sketches(docs, shingle))
    least = F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "text_hash")).alias("first")
    nodes = store(rows.groupBy("text_hash", "sketch").agg(least).withColumn("id", F.monotonically_increasing_id()))
    edges = candidate_edges(nodes, similarity, recall)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingle_set(t, shingle).astype("<u8").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made, pa.binary())], ["id", "shingles"])

    ends = edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    wanted = store(nodes.join(ends, "id").select("id", F.col("first.doc_id").alias("_doc"), F.col("first.text_hash").alias("_text")))
    source = docs.select(F.col("doc_id").cast("long").alias("_own"), F.xxhash64("text").alias("_hash"), "text")
    texts = source.join(light(wanted), source["_own"].eqNullSafe(wanted["_doc"]) & (source["_hash"] == wanted["_text"]))
    sets = texts.select("id", "text").mapInArrow(run, "id long, shingles binary").groupBy("id").agg(F.first("shingles").alias("shingles"))
    sets = store(sets.withColumn("n", F.length("shingles")))

    # The nearest edge of each text first: what these join needs no other edge.
    near = _nearest(edges)
    links = _verified(near, sets, similarity)
    free_shuffles(docs.sparkSession)
    joined = connected_components(links)
    side = lambda x: joined.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    sided = edges.join(side("u"), "u", "left").join(side("v"), "v", "left").withColumns({"cu": F.coalesce("cu", "u"), "cv": F.coalesce("cv", "v")})
    open_ = store(sided.where("cu <> cv").select("u", "v", "d", "cu", "cv").join(near, ["u", "v"], "left_anti"))
    release(edges, near, links)

    # Then the nearest that could still join two groups, of which only groups are linked.
    near = _nearest(open_)
    links = _verified(near, sets, similarity)
    release(open_, near)
    free_shuffles(docs.sparkSession)
    wider = connected_components(links.select(F.col("cu").alias("u"), F.col("cv").alias("v")))
    ends = nodes.select("id", "sketch").join(sets.select("id", F.col("n").cast("long").alias("n")), "id").join(joined, F.col("id") == F.col("node"), "left")
    ends = store(_regrouped(ends.select("id", "sketch", "n", F.coalesce("component", "id").alias("group")), wider))
    release(joined, links, wider, wanted)

    # Both leave pairs in reach out; where one could still join two groups, it is verified.
    rest, masks = open_rows(ends, nodes.count(), similarity, recall)
    groups = ends.select("id", "group")
    if not rest.isEmpty():
        last = settled_links(rest, masks, sets, similarity)
        wider = connected_components(last)
        groups = _regrouped(groups, wider)
        release(last)
    release(sets, rest)
    free_shuffles(docs.sparkSession)
    rooted = store(nodes.join(groups, "id", "left").select("text_hash", "sketch", "first", F.coalesce("group", "id").alias("root")))
    release(ends, wider, nodes)
    least_of = store(rooted.groupBy("root").agg(F.min("first").alias("first")))
    named = store(rooted.drop("first").join(least_of, "root").select("text_hash", "sketch", "first"))
    release(rooted, least_of)
    return rows, named


def drop_similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, recall: float = 0.99) -> DataFrame:
    """One row of each group of texts that links of the similarity join: the smallest doc_id, then text hash, then the other columns.

    Null doc_ids come after all others; repeated rows belong to groups like
    others.  Null and empty texts, and texts without words, are one group.
    An empty table gives an empty result.
    """
    rows, named = similar_texts(docs, shingle, similarity, recall)
    out = _first_rows(docs, rows.join(named, ["text_hash", "sketch"]))
    release(rows, named)
    return out
