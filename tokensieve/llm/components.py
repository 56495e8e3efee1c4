"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregations with map-side combining and two equi-joins
of stored tables, whose skewed side adaptive execution can split; no
neighbourhood is ever collected.  Rounds are written to the shared folder,
so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import release, store


def _large_star(edges: DataFrame, held: list[DataFrame]) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = store(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    held.append(least)
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, held: list[DataFrame]) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = store(down.groupBy("u").agg(F.min("v").alias("m")))
    held.append(least)
    moved = down.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """A stored table (node, component) of every node that has an edge to another; component is the least node reachable.

    edges: columns u and v of one orderable type.  Self-loops, repeated
    edges and edges with a null end add nothing.  An empty input gives an
    empty result.  Raises RuntimeError if max_rounds don't suffice.
    """
    now = store(edges.select("u", "v").where("u <> v").distinct())
    mark = None
    for _ in range(max_rounds):
        held = [now]
        held.append(store(_large_star(now, held)))
        new = store(_small_star(held[-1], held))
        found = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        release(*held)
        now = new
        if mark == found or not found[0]:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            out = store(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots))
            release(now)
            return out
        mark = found
    raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
