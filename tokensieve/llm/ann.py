"""Nearest neighbours by block matrix join on int8 product tiles.

Vectors are quantised to int8 with one scale each; the norm of what
rounding took away is kept.  By the triangle inequality the distance of two
quantised vectors is off by at most the sum of their two residues, so a
tile of products gives a lower and an upper bound of every distance.  A
pair survives if its lower bound doesn't exceed the k-th smallest upper
bound of its query; survivors are computed in double precision and merged
into the query's heap.  The result is exact.

Queries and candidates are cut into blocks by a hash of their row, and each
query block meets each candidate block in one task: by the method, work and
shuffle grow with the product of both, a copy of each vector for each block
of the other side.  Inside a block equal vectors are one column of the tile
with their k + 1 smallest ids, which is all that any query can need of them.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import store

_QUERIES_A_TILE = 256
#: Rounding of the bounds' own arithmetic, relative.
_SLACK = 1e-5
#: A power of two that keeps the squares of any finite components finite.
_SMALL = 2.0**-600


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, embedding) of vectors that are not null, not zero and hold finite components only."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)).select(
        F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding")
    )


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale, residue norm) of each row of x."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.sqrt(((x - q * scale[:, None]) ** 2).sum(axis=1))


def _product_type(dim: int):
    """Floats that hold sums of dim products of int8 exactly."""
    return np.float32 if dim * 127 * 127 < 1 << 24 else np.float64


def exact(queries: np.ndarray, rows: np.ndarray, scale: float = 1.0) -> np.ndarray:
    """Euclidean distances in double precision, components added in order; where squares overflow, of scaled components."""
    total = np.zeros(len(rows))
    with np.errstate(over="ignore"):
        for j in range(rows.shape[1]):
            d = queries[:, j] * scale - rows[:, j] * scale
            total += d * d
        if scale == 1.0 and np.isinf(total).any():
            return np.where(np.isinf(total), exact(queries, rows, _SMALL), np.sqrt(total))
        return np.sqrt(total) / scale


class Heaps:
    """The k nearest of each query, ties to the smaller id; a query's own row is no candidate."""

    def __init__(self, rows: np.ndarray, k: int):
        self.rows, self.k = rows.tolist(), k
        self.heaps: list[list[tuple[float, int, int]]] = [[] for _ in rows]

    def limit(self) -> np.ndarray:
        return np.array([-h[0][0] if len(h) == self.k else np.inf for h in self.heaps])

    def push(self, query: int, score: float, vec_id: int, row: int) -> None:
        if row == self.rows[query]:
            return
        heap, item = self.heaps[query], (-score, -vec_id, row)
        if len(heap) < self.k:
            heapq.heappush(heap, item)
        elif item > heap[0]:
            heapq.heapreplace(heap, item)


def search_tile(q: np.ndarray, c_ids: np.ndarray, c_rows: np.ndarray, c: np.ndarray, heaps: Heaps) -> None:
    """Merge the candidates c, of these ids and rows, into the heaps of the queries q.

    A bound that isn't a number, as squares beyond the largest double give,
    keeps its pair.
    """
    k = heaps.k
    order = np.lexsort((c_rows, c_ids))
    c_ids, c_rows, c = c_ids[order], c_rows[order], c[order]
    _, first, group = np.unique((c + 0.0).view(np.dtype((np.void, c.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
    place = np.argsort(group, kind="stable")
    begin = np.concatenate([[0], np.cumsum(np.bincount(group))])
    c = c[first]
    kind = _product_type(c.shape[1])
    qc, sc, rc = quantise(c)
    nc = (qc.astype(kind) ** 2).sum(axis=1).astype(float) * sc**2
    qct = qc.astype(kind).T
    for at in range(0, len(q), _QUERIES_A_TILE):
        part = q[at : at + _QUERIES_A_TILE]
        qq, sq, rq = quantise(part)
        nq = (qq.astype(kind) ** 2).sum(axis=1).astype(float) * sq**2
        square = nq[:, None] + nc - 2.0 * sq[:, None] * sc * (qq.astype(kind) @ qct)
        middle = np.sqrt(np.maximum(square, 0))
        error = rq[:, None] + rc + _SLACK * (np.sqrt(nq)[:, None] + np.sqrt(nc))
        upper = middle + error
        kth = min(k, upper.shape[1] - 1)  # one more than k, for the query itself may be among them
        limit = np.fmin(np.partition(upper, kth, axis=1)[:, kth] if upper.shape[1] > k else np.inf, heaps.limit()[at : at + len(part)])
        rows, cols = np.nonzero(~(middle - error > limit[:, None]))
        scores = exact(part[rows], c[cols])
        for r, col, score in zip((rows + at).tolist(), cols.tolist(), scores.tolist()):
            for m in place[begin[col] : begin[col + 1]][: k + 1].tolist():
                heaps.push(r, score, int(c_ids[m]), int(c_rows[m]))


def nearest(vectors: DataFrame, query_every: int = 20, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 16384, query_rows: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each query, nearest first, by Euclidean distance.

    Queries are the usable rows whose id is divisible by query_every;
    candidates are all other rows of the same dimension, all of them if
    fewer than k.  Ties go to the smaller id.  Unusable rows (see usable)
    take no part.  A row is a row: those that repeat an id are queries each
    and candidates each, for one another too.  An empty table gives an
    empty result.
    """
    row = F.monotonically_increasing_id().alias("row")
    rows = store(usable(vectors, id_col, vector_col).select(row, "vec_id", "embedding"))
    count = rows.count()
    blocks, q_blocks = max(1, -(-count // block_rows)), max(1, -(-count // (query_every * query_rows)))
    dim = F.size("embedding").alias("dim")
    here = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    there = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(q_blocks)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = rows.where(F.pmod("vec_id", F.lit(query_every)) == 0)
    left = queries.select(dim, there.alias("qb"), every(blocks).alias("cb"), F.lit(True).alias("query"), "row", "vec_id", "embedding")
    right = rows.select(dim, every(q_blocks).alias("qb"), here.alias("cb"), F.lit(False).alias("query"), "row", "vec_id", "embedding")
    tile = ["dim", "qb", "cb"]
    schema = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        query = table.column("query").to_numpy(zero_copy_only=False)
        ids, row = table.column("vec_id").to_numpy(), table.column("row").to_numpy()
        flat = table.column("embedding").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        heaps = Heaps(row[query], k)
        if query.any() and not query.all():
            with np.errstate(over="ignore", invalid="ignore"):
                search_tile(flat[query], ids[~query], row[~query], flat[~query], heaps)
        out = [(r, int(i), -v, -s) for r, i, h in zip(heaps.rows, ids[query], heaps.heaps) for s, v, _ in h]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else ([], [], [], []), schema)], schema=schema)

    found = left.unionByName(right).groupBy(*tile).applyInArrow(run, "row long, query_id long, vec_id long, score double")
    best = Window.partitionBy("row").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
