"""Centroid clustering by whole numbers, screened by the norms of blocks.

A vector's components become whole numbers and its blocks (``BLOCKS`` segments
of equal length) are compressed once into their scaled mean and the norm of what
the mean leaves. The distance of two compressed vectors never exceeds that of the
vectors: the means' part is exact, and by Cauchy-Schwarz two remainders are at
least as far apart as their norms. A centroid whose bound is above the best exact
distance of a vector so far is left out. Vectors for which more than one stays are
screened again by ``FINE`` shorter blocks, made on the way. What then stays gets
exact distances in whole numbers. Every round is one pass of Arrow batches over the stored vectors; tasks
hand on sums for each centroid and component, and Spark adds them up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwright.llm.common import stored

DIMENSIONS, SCALE, BLOCKS, FINE = 64, 64, 8, 32
CENTROIDS, ROUNDS = 16, 3
#: Components end here, so that squared distances of any kept vectors fit a long: 64 * (2 * BOUND)^2 is 2^60.
BOUND = 1 << 26
#: Vectors that are screened together.
PORTION = 1 << 13


def compressed(vectors: np.ndarray, blocks: int = BLOCKS) -> np.ndarray:
    """For each row of whole numbers: its blocks' scaled means, then the norms of what these leave."""
    n, d = vectors.shape
    parts = vectors.reshape(n, blocks, d // blocks).astype(np.float64)
    mean = parts.mean(axis=2)
    left = np.sqrt(((parts - mean[:, :, None]) ** 2).sum(axis=2))
    return np.concatenate([mean * np.sqrt(d // blocks), left], axis=1)


def bounds(small: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of two compressed tables, less what rounding may add."""
    a, b = (small**2).sum(axis=1)[:, None], (other**2).sum(axis=1)[None]
    return a + b - 2 * small @ other.T - 1e-9 * (a + b) - 1e-6


@dataclass
class Centroids:
    whole: np.ndarray  # centroids x dimensions, int64

    def __post_init__(self) -> None:
        self.small, self.fine = compressed(self.whole), compressed(self.whole, FINE)

    def exact(self, vectors: np.ndarray, c: np.ndarray | int) -> np.ndarray:
        return ((vectors - self.whole[c]) ** 2).sum(axis=1)

    def nearest(self, vectors: np.ndarray, small: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number, squared distance, exact distances taken) of the nearest centroid of each row; ties go to the smaller number."""
        low = bounds(small, self.small)
        best = low.argmin(axis=1)  # the likeliest one first
        far, taken = self.exact(vectors, best), np.ones(len(vectors), np.int64)
        low[np.arange(len(vectors)), best] = np.inf
        wide = np.flatnonzero((low <= far[:, None]).any(axis=1))
        low[wide] = np.maximum(low[wide], bounds(compressed(vectors[wide], FINE), self.fine))
        for _ in range(len(self.whole) - 1):  # the next likeliest one of every row that has any left
            wide = wide[(low[wide] <= far[wide, None]).any(axis=1)]
            if not len(wide):
                break
            c = low[wide].argmin(axis=1)
            d = self.exact(vectors[wide], c)
            low[wide, c] = np.inf
            taken[wide] += 1
            closer = (d < far[wide]) | ((d == far[wide]) & (c < best[wide]))
            best[wide[closer]], far[wide[closer]] = c[closer], d[closer]
        return best, far, taken


def kept_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, whole, small) of rows with exactly ``dimensions`` components, none null or non-finite; both columns are packed numbers.

    Whole numbers are floor(``SCALE`` * x); they end at ``BOUND`` on either side.
    """
    x = F.col("v")
    sound = (F.size(x) == dimensions) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(x.isNotNull() & F.coalesce(sound, F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PORTION):
                part = batch.slice(at, PORTION)
                with np.errstate(over="ignore"):
                    real = np.floor(part.column(1).flatten().to_numpy(zero_copy_only=False) * SCALE)
                whole = np.clip(real, -BOUND, BOUND).astype(np.int64).reshape(part.num_rows, dimensions)
                small = compressed(whole)
                yield pa.RecordBatch.from_arrays([part.column(0), packed(whole.astype("<i4")), packed(small.astype("<f8"))], names=["id", "whole", "small"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, whole binary, small binary")


def packed(rows: np.ndarray) -> pa.Array:
    """A binary value for each row."""
    width = rows.shape[1] * rows.itemsize
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def unpacked(column: pa.Array, kind: str) -> np.ndarray:
    """``packed`` values as rows of numbers; all of one width."""
    n = len(column)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    return data.view(kind).reshape(n, -1)


def starts(kept: DataFrame, k: int = CENTROIDS) -> np.ndarray:
    """The vectors with the ``k`` smallest hashes of their id, in order. Rows that share an id are told apart by their numbers; a null id counts as empty text."""
    mark = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = kept.select(mark.alias("mark"), "whole").orderBy("mark", "whole").limit(k).collect()
    return np.array([np.frombuffer(r["whole"], "<i4") for r in rows], np.int64)


def moved(kept: DataFrame, centroids: Centroids) -> Centroids:
    """One round: every centroid that has vectors goes to the floor of their mean, by component."""
    shared = kept.sparkSession.sparkContext.broadcast(centroids)
    k, d = centroids.whole.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((k, d), np.int64), np.zeros(k, np.int64)  # 2^36 vectors of a task fit
        for batch in batches:
            for at in range(0, batch.num_rows, PORTION):
                part = batch.slice(at, PORTION)
                whole = unpacked(part.column(0), "<i4").astype(np.int64)
                own = shared.value.nearest(whole, unpacked(part.column(1), "<f8"))[0]
                n += np.bincount(own, minlength=k)
                for c in np.unique(own).tolist():
                    sums[c] += whole[own == c].sum(axis=0)
        full = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(full, d)), pa.array(np.tile(np.arange(d), len(full))), pa.array(sums[full].ravel()), pa.array(np.repeat(n[full], d))], names=["c", "at", "s", "n"])

    parts = kept.select("whole", "small").mapInArrow(run, "c long, at long, s long, n long")
    exact = lambda x: F.sum(F.col(x).cast("decimal(38,0)")).alias(x)
    whole = centroids.whole.copy()
    for r in parts.groupBy("c", "at").agg(exact("s"), exact("n")).collect():  # centroids x dimensions rows at most
        whole[r["c"], r["at"]] = int(r["s"]) // int(r["n"])
    return Centroids(whole)


def assigned(kept: DataFrame, centroids: Centroids) -> DataFrame:
    """(id, cluster, distance, n_exact): n_exact counts the centroids whose exact distance was taken."""
    shared = kept.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PORTION):
                part = batch.slice(at, PORTION)
                found = shared.value.nearest(unpacked(part.column(1), "<i4").astype(np.int64), unpacked(part.column(2), "<f8"))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found[0].astype(np.int32)), pa.array(found[1]), pa.array(found[2].astype(np.int32))], names=["id", "cluster", "distance", "n_exact"])

    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(run, f"id {kind}, cluster int, distance long, n_exact int")


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[DataFrame, Centroids]:
    """(id, cluster, distance, n_exact) of every kept vector after ``rounds`` rounds, and the final centroids.

    Vectors that are null, of another length, or hold null or non-finite components take no part. Repeated
    rows count each. With fewer vectors than ``k`` each begins a cluster; with none there are no rows.
    Equal vectors may begin several clusters; all their members go to the first, and empty ones stay.
    """
    kept = stored(kept_vectors(vectors, id_col, vector_col), "vectors")
    first = starts(kept, k)
    centroids = Centroids(first if len(first) else np.zeros((1, DIMENSIONS), np.int64))
    for _ in range(rounds if len(first) else 0):
        centroids = moved(kept, centroids)
    return assigned(kept, centroids), centroids


def clustering(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector; see ``cluster``."""
    rows, centroids = cluster(vectors, id_col, vector_col, k, rounds)
    held = stored(rows.drop("n_exact"), "clusters")
    of = held.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    sums = {r["cluster"]: int(r["s"]) for r in of.collect()}  # a row for each centroid at most
    top = (1 << 63) - 1
    facts = [(c, min(s, top), min(sum(sums.values()), top), hashlib.sha256(",".join(map(str, centroids.whole[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    small = held.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return held.join(F.broadcast(small), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def clustering_sql(k: int = CENTROIDS, rounds: int = ROUNDS) -> str:
    """The same by exact distances to all centroids, in DuckDB."""
    nearest = """(SELECT v.n, v.vec_id, v.x, arg_min(c.c, (d.d, c.c)) AS cluster, min(d.d) AS distance
        FROM v, c{r} AS c, LATERAL (SELECT list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d) AS d
        GROUP BY v.n, v.vec_id, v.x)"""
    steps = []
    for r in range(1, rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED {nearest.format(r=r - 1)}")
        steps.append(f"""m{r} AS (SELECT cluster, i, (CASE WHEN s < 0 AND s % n <> 0 THEN s // n - 1 ELSE s // n END)::BIGINT AS y
            FROM (SELECT a.cluster, g.i, sum(a.x[g.i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{r} AS a, range(1, {DIMENSIONS + 1}) AS g(i) GROUP BY 1, 2))""")
        steps.append(f"c{r} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{r - 1} AS c LEFT JOIN (SELECT cluster, list(y ORDER BY i) AS x FROM m{r} GROUP BY 1) AS m ON m.cluster = c.c)")
    return f"""
    WITH v AS MATERIALIZED (
      SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda e: greatest(-{BOUND}, least({BOUND}, floor(e::DOUBLE * {SCALE})))::BIGINT) AS x
      FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {DIMENSIONS}),
    c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS h, x FROM v ORDER BY h, x LIMIT {k})),
    {", ".join(steps)},
    z AS MATERIALIZED {nearest.format(r=rounds)}
    SELECT z.vec_id, z.cluster::INTEGER AS cluster, z.distance, sum(z.distance) OVER (PARTITION BY z.cluster)::BIGINT AS cluster_inertia,
      sum(z.distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
    FROM z JOIN c{rounds} AS c ON c.c = z.cluster
    """
