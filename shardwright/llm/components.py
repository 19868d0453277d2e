"""Connected components of an edge table, by alternating large and small stars.

Each round begins with stars that every partition puts in the place of its own
edges, so chains inside a partition take no rounds. A node's smallest neighbour
never grows by that, so rounds still end in one star for each component. Partitions
are sized by the number of edges: what fits one partition is done after its stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwright.llm.common import cut

#: Edges that a task turns into stars at a time, and edges of a partition (2 MB) where there were smaller ones.
STAR_EDGES, PART_EDGES = 1 << 20, 1 << 17


def lowest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position that each of n positions reaches over the pairs (a, b)."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, low[a], m)
        np.minimum.at(new, low[b], m)
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _own_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) to edges from each node to the smallest that it reaches over up to ``STAR_EDGES`` edges of the partition."""

    def stars(edges: np.ndarray) -> pa.RecordBatch:
        nodes, at = np.unique(edges, return_inverse=True)
        at = at.reshape(edges.shape)
        low = lowest(len(nodes), at[0], at[1])
        moved = np.flatnonzero(low != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[low[moved]])], names=["a", "b"])

    held, n = [], 0
    for batch in batches:
        held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
        n += batch.num_rows
        if n >= STAR_EDGES:
            yield stars(np.concatenate(held, axis=1))
            held, n = [], 0
    if n:
        yield stars(np.concatenate(held, axis=1))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    low = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = both.join(low, both.a == low.u).where("b > a")
    return out.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    hung = down.join(low, down.a == low.u).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.union(low.select("u", "m")).toDF("a", "b").where("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 60, part: int = PART_EDGES) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the smallest node reachable.

    Each round is two joins on checkpointed tables. All stays distributed, in partitions of
    about ``part`` edges; only a count and a checksum of the edges reach the driver. No edges: no rows.
    Self-loops and repeated edges change nothing.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct())
    seen = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == seen:
            break
        seen = mark
        parts = -(-mark[0] // min(part, STAR_EDGES))
        # Read from written files, so a task that runs again gives the same stars.
        own = now.coalesce(parts).mapInArrow(_own_stars, "a long, b long")
        if parts == 1:
            now = cut(own)
            break
        now = cut(_small_star(_large_star(own)))
    else:
        raise RuntimeError(f"no fixed point in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())
