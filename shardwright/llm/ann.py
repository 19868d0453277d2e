"""Nearest neighbours by inner product with a hash-prefix forest.

A tree gives every vector a string of bits, the signs of projections, and
keeps the strings in a sorted array. A query descends to where its own string
would stand; whatever shares its first d bits is one stretch of the
array around that place. Search starts at the deepest level at which the stretches
of all trees hold a few times k vectors and ascends all trees together, taking in
the vectors that join the stretches; they get their inner product. It ends
once a neighbour as near as the k-th one found so far has been missed by all
trees with a probability of at most ``miss``: (1 - p(s)^d)^trees, where p(s) is
the chance that one bit agrees. So clustered queries end deep in the tree after
a few candidates, and queries without near neighbours ascend as far as they must.
Inner products become cosines by one more component, which brings all vectors to
the same length.

Vectors are dealt to shards by one more string: shards are its prefixes, longer
ones where vectors crowd, so that a shard has a bounded size; only what
shares all its bits is dealt by id. A query first asks the shard of its own prefix. The
k-th score found there tells with which probability a neighbour as near is in
each other shard, by the margins of the query's projections; it goes on to the
likeliest ones, until what is left holds such a neighbour with a probability of
at most ``route_miss``. So no query meets all shards unless its neighbours may
be in all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardwright.llm.common import stored

TREES, MISS, ROUTE_MISS, SEED, LEVELS = 96, 0.12, 0.03, 11, 32
#: Vectors of one shard, their most bytes, the number of shards from which on shards grow instead, and queries searched at once.
SHARD, SHARD_BYTES, SHARDS, QUERY_BLOCK = 16_384, 64 << 20, 4096, 64
#: Bits of the strings that deal vectors, and how many more a crowded prefix gets at a time.
DEAL_BITS, DEAL_STEP = 48, 6
#: Pairs of a query and a cell that a task weighs at once: some 10 MB for each array of them.
ROUTE_PAIRS = 1 << 20


class Forest:
    """Trees of one dimension over the vectors of a shard; ``longest`` is at least as long as any of them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float, trees: int = TREES, seed: int = SEED):
        self.ids, self.vectors, self.longest, self.trees = ids, vectors.astype(np.float32, copy=False), longest, trees
        self.exact = vectors
        self.scored = 0
        rng = np.random.default_rng(seed)
        self.planes = rng.normal(size=(trees, vectors.shape[1] + 1, LEVELS)).astype(np.float32)
        unit = lifted(vectors, longest)
        # One array for all trees: the tree's number stands before its strings.
        self.strings, self.order = np.empty((trees, len(ids)), np.uint64), np.empty((trees, len(ids)), np.int32)
        for t in range(trees):
            strings = self._strings(unit, t)
            self.order[t] = np.argsort(strings, kind="stable")
            self.strings[t] = strings[self.order[t]]
        self.strings, self.order = self.strings.reshape(-1), self.order.reshape(-1)

    def _strings(self, unit: np.ndarray, tree: int) -> np.ndarray:
        signs = unit @ self.planes[tree] > 0
        return np.packbits(signs, axis=1, bitorder="big").view(">u4").reshape(-1).astype(np.uint64) | np.uint64(tree << 32)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, miss: float = MISS, bounds: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) of the nearest found for each query of a block, nearest first, ties to the smaller id.

        A query's own id takes no part. ``bounds`` are scores that others already
        reached k times; what is lower need not come out.
        """
        n, short = len(queries), queries.astype(np.float32)
        lengths = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        unit = np.column_stack([queries / lengths[:, None], np.zeros(n)]).astype(np.float32)
        strings = np.stack([self._strings(unit, t) for t in range(self.trees)], axis=1)
        bounds = np.full(n, -np.inf) if bounds is None else bounds
        largest = lengths * self.longest

        def stretches(depth: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Per query and tree, where the stretch at the query's depth begins and ends."""
            rest = ((np.uint64(1) << (LEVELS - depth).astype(np.uint64)) - np.uint64(1))[:, None]
            own = strings[of]
            return np.searchsorted(self.strings, own & ~rest, "left"), np.searchsorted(self.strings, own | rest, "right")

        def goal_of(kth: np.ndarray, of: np.ndarray) -> np.ndarray:
            """The depth at which (1 - agree^depth)^trees is as small as ``miss``; 0 where there is no k-th one."""
            agree = 1 - np.arccos(np.clip(kth / largest[of], -1, 1)) / np.pi
            with np.errstate(divide="ignore", invalid="ignore"):
                depth = np.log(1 - miss ** (1 / self.trees)) / np.log(agree)
            return np.where(np.isneginf(kth), 0, np.where(agree >= 1, LEVELS, np.clip(depth, 0, LEVELS))).astype(np.int64)

        depth = np.zeros(n, np.int64)
        open_ = np.arange(n)
        for d in (LEVELS, *range(LEVELS - 8, 0, -2)):  # the deepest level with a few times k vectors
            lo, hi = stretches(np.full(len(open_), d), open_)
            enough = (hi - lo).sum(axis=1) >= 4 * k
            depth[open_[enough]] = d
            open_ = open_[~enough]
            if not len(open_):
                break
        known = ~np.isneginf(bounds)
        depth[known] = goal_of(bounds, np.arange(n))[known]
        seen = [self.ids == q for q in query_ids]  # its own row never joins
        at, found = [np.empty(0, np.int64)] * n, [np.empty(0, np.float32)] * n
        kth = bounds.astype(np.float64).copy()
        live = np.arange(n)
        while len(live):
            lo, hi = stretches(depth[live], live)
            for i, low, high in zip(live.tolist(), lo.tolist(), hi.tolist()):
                joined = np.zeros(len(self.ids), bool)
                joined[np.concatenate([self.order[a:b] for a, b in zip(low, high)])] = True
                joined &= ~seen[i]
                seen[i] |= joined
                new = np.flatnonzero(joined)
                self.scored += len(new)
                at[i] = np.concatenate([at[i], new])
                found[i] = np.concatenate([found[i], self.vectors[new] @ short[i]])
                if len(found[i]) >= k:
                    kth[i] = max(kth[i], float(np.partition(found[i], len(found[i]) - k)[-k]))
            goal = goal_of(kth[live], live)
            on = (depth[live] > goal) & (depth[live] > 0)
            live, goal = live[on], goal[on]
            # Half the way to what the k-th one asks for so far; it asks for less the nearer it gets.
            depth[live] = np.maximum(goal, np.minimum(depth[live] - 1, (depth[live] + goal + 1) // 2))
        out = []
        for i in range(n):
            near = at[i][found[i] >= kth[i] - 1e-5 * largest[i]]
            exact = inner(self.exact[near], queries[i])
            best = np.lexsort((self.ids[near], -exact))[:k]
            out.append((self.ids[near][best], exact[best]))
        return out


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors of length 1: shortened by ``longest``, with one more component."""
    short = vectors.astype(np.float64) / longest
    return np.column_stack([short, np.sqrt(np.maximum(0.0, 1.0 - (short**2).sum(axis=1)))]).astype(np.float32)


def inner(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in the order of components, so equal vectors score equally."""
    out = np.zeros(len(vectors))
    for c in range(vectors.shape[1]):
        out += vectors[:, c].astype(np.float64) * float(query[c])
    return out


def usable(embedding: str) -> Column:
    """Vectors that take part: not null or empty, not zero, without null or non-finite components."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(embedding).isNotNull() & fine & F.exists(embedding, lambda x: x != 0)


@dataclass
class Deal:
    """Shards of one dimension: prefixes of strings in order, and of how many parts each consists."""

    dim: int
    longest: float
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.uint64))
    depths: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    counts: np.ndarray = field(default_factory=lambda: np.ones(1, np.int64))
    parts: np.ndarray = field(default_factory=lambda: np.ones(1, np.int64))
    first: int = 0  # the number of its first shard

    def planes(self) -> np.ndarray:
        return np.random.default_rng([SEED, self.dim, 1]).normal(size=(self.dim + 1, DEAL_BITS)).astype(np.float32)

    def strings(self, unit: np.ndarray) -> np.ndarray:
        bits = np.zeros((len(unit), 64), np.uint8)
        bits[:, 64 - DEAL_BITS :] = unit @ self.planes() > 0
        return np.packbits(bits, axis=1, bitorder="big").view(">u8").reshape(-1).astype(np.uint64)

    def cell(self, strings: np.ndarray) -> np.ndarray:
        return np.maximum(0, np.searchsorted(self.starts, strings, "right") - 1)

    def numbers(self) -> np.ndarray:
        """The number of each cell's first shard."""
        return self.first + np.cumsum(self.parts) - self.parts

    def others(self, query: np.ndarray, kth: np.ndarray, route_miss: float) -> list[np.ndarray]:
        """For each query the cells, besides its own, where a neighbour of score ``kth`` may well be.

        A cell's chance is its number of vectors times how much likelier its bits
        are for such a neighbour than for any vector.
        """
        length = np.sqrt((query.astype(np.float64) ** 2).sum(axis=1))
        unit = np.column_stack([query / length[:, None], np.zeros(len(query))])
        margin = unit @ self.planes()
        s = np.clip(kth / (length * self.longest), -0.999, 0.9999)
        z = s[:, None] * margin / np.sqrt(1 - s[:, None] ** 2)
        one = np.clip(0.5 * (1 + np.tanh(0.79788456 * (z + 0.044715 * z**3))), 1e-9, 1 - 1e-9)  # the normal distribution, about
        place = np.arange(DEAL_BITS - 1, -1, -1).astype(np.uint64)
        bit = (self.starts[:, None] >> place) & np.uint64(1)
        used = np.arange(DEAL_BITS) < self.depths[:, None]
        logs = np.log(one) @ (bit * used).T + np.log(1 - one) @ ((1 - bit) * used).T + np.log(2) * self.depths + np.log(self.counts)  # query x cell
        chance = np.exp(logs - logs.max(axis=1, keepdims=True))
        home = self.cell(self.strings(unit.astype(np.float32)))
        out = []
        for i in range(len(query)):
            order = np.argsort(-chance[i], kind="stable")
            left = chance[i].sum() - np.cumsum(chance[i][order]) + chance[i][order]  # before each is taken
            pick = order if np.isneginf(kth[i]) else order[left > route_miss * chance[i].sum()]
            out.append(pick[pick != home[i]])
        return out


def _vectors(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, rows, matrix) for each length in a column of vectors."""
    column = batch.column(at)
    starts, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(starts)
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        yield dim, rows, flat[(starts[:-1][rows][:, None] + np.arange(dim)).reshape(-1)].reshape(len(rows), dim)


def _sql_type(kind: T.DataType) -> str:
    return f"array<{kind.elementType.simpleString()}>"


def deals(held: DataFrame, shard: int) -> dict[int, Deal]:
    """The shards of each dimension of ``held`` (id, v, dim, length). Rows that reach the driver: one for each dimension, and the counts of prefixes."""
    out, first = {}, 0
    for r in held.groupBy("dim").agg(F.count("*").alias("n"), F.max("length").alias("longest")).orderBy("dim").collect():
        deal = out[r["dim"]] = Deal(r["dim"], float(r["longest"]) or 1.0)
        size = max(1, min(max(shard, r["n"] // SHARDS), SHARD_BYTES // (4 * r["dim"])))
        if r["n"] > size:
            _split(held.where(F.col("dim") == r["dim"]), deal, size, r["n"])
        deal.first = first
        first += int(deal.parts.sum())
    return out


def _split(held: DataFrame, deal: Deal, size: int, n: int) -> None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, matrix in _vectors(batch, 0):
                yield pa.RecordBatch.from_arrays([pa.array(deal.strings(lifted(matrix, deal.longest)).astype(np.int64))], names=["string"])

    strings = stored(held.select("v").mapInArrow(run, "string long"), "strings")
    depth = min(DEAL_STEP * 2, ceil(log2(n / size)))
    cells: list[tuple[int, int, int]] = []  # start, depth, vectors
    crowded = None
    while True:
        prefix = F.shiftright("string", DEAL_BITS - depth)
        part = strings if crowded is None else strings.join(F.broadcast(crowded), F.shiftright("string", DEAL_BITS - above) == F.col("p"))  # at most n / size prefixes
        counted = [(r["p"], r["n"]) for r in part.groupBy(prefix.alias("p")).agg(F.count("*").alias("n")).collect()]
        end = depth == DEAL_BITS
        cells += [(p << (DEAL_BITS - depth), depth, c) for p, c in counted if c <= 2 * size or end]
        full = [(p,) for p, c in counted if c > 2 * size and not end]
        if not full:
            break
        crowded = held.sparkSession.createDataFrame(full, "p long")
        above, depth = depth, min(DEAL_BITS, depth + DEAL_STEP)
    cells.sort()
    deal.starts = np.array([c[0] for c in cells], np.uint64)
    deal.depths = np.array([c[1] for c in cells], np.int64)
    deal.counts = np.array([c[2] for c in cells], np.int64)
    deal.parts = np.array([-(-c[2] // (2 * size)) for c in cells], np.int64)


def _deal(shared, asks: bool, route_miss: float | None):
    """Kernel: rows (id, v, kth) to rows (shard, asks, id, v, kth), vectors once, queries for each shard that they ask."""

    def sent(batch: pa.RecordBatch, rows: np.ndarray, shard: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(rows), 4096):
            part = batch.take(pa.array(rows[at : at + 4096]))
            m = part.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(shard[at : at + 4096].astype(np.int32)), pa.array(np.full(m, asks)), *part.columns[:3]], names=["shard", "asks", "id", "v", "kth"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for dim, rows, matrix in _vectors(batch, 1):
                if (deal := shared.value.get(dim)) is None:
                    continue
                numbers = deal.numbers()
                if not asks:
                    cell = deal.cell(deal.strings(lifted(matrix, deal.longest)))
                    shard = numbers[cell] + (ids[rows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % deal.parts[cell]
                    yield from sent(batch, rows, shard)
                    continue
                step = max(1, ROUTE_PAIRS // len(deal.starts))
                for low in range(0, len(rows), step):
                    some, queries = rows[low : low + step], matrix[low : low + step]
                    if route_miss is None:
                        length = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
                        unit = np.column_stack([queries / length[:, None], np.zeros(len(some))]).astype(np.float32)
                        cells = [np.array([c]) for c in deal.cell(deal.strings(unit))]
                    else:
                        cells = deal.others(queries, np.nan_to_num(batch.column(2).take(pa.array(some)).to_numpy(zero_copy_only=False).astype(float), nan=-np.inf), route_miss)
                    asked = [np.concatenate([np.arange(numbers[c], numbers[c] + deal.parts[c]) for c in cs]) if len(cs) else np.empty(0, np.int64) for cs in cells]
                    yield from sent(batch, np.repeat(some, [len(a) for a in asked]), np.concatenate(asked))

    return run


def _kernel(shared, k: int, trees: int, miss: float):
    """Rows (shard, asks, id, v, kth) sorted so that a shard's vectors come before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["query_id", "vec_id", "score"]
        here, ids, vectors, forest = None, [], [], None
        for batch in batches:
            shards, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(2))
            own, column = batch.column(2).to_numpy(), batch.column(3)
            kth = np.nan_to_num(batch.column(4).to_numpy(zero_copy_only=False).astype(float), nan=-np.inf)
            starts = column.offsets.to_numpy()
            flat = column.values.to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(shards) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(own)]):
                if lo == hi:
                    continue
                if here != shards[lo]:
                    here, ids, vectors, forest = shards[lo], [], [], None
                dim = int(starts[lo + 1] - starts[lo])  # a shard has one dimension
                if not asks[lo]:
                    ids.append(own[lo:hi].copy())
                    vectors.append(flat[starts[lo] : starts[hi]].reshape(hi - lo, dim).copy())
                    continue
                if forest is None and ids:
                    forest = Forest(np.concatenate(ids), np.concatenate(vectors), shared.value[dim].longest, trees)
                    ids, vectors = [True], []
                if forest is None:
                    continue
                for at in range(lo, hi, QUERY_BLOCK):
                    to = min(hi, at + QUERY_BLOCK)
                    block = flat[starts[at] : starts[to]].reshape(to - at, dim)
                    found = forest.search(own[at:to], block, k, miss, kth[at:to])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.repeat(own[at:to], [len(f[0]) for f in found]).astype(np.int64)),
                        pa.array(np.concatenate([f[0] for f in found]).astype(np.int64)), pa.array(np.concatenate([f[1] for f in found])),
                    ], names=names)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, miss: float = MISS, route_miss: float = ROUTE_MISS, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k nearest vectors found, all if there are fewer.

    score is the inner product in double precision; ties go to the smaller id.
    Null, empty and zero vectors, and those with null or non-finite components,
    take no part as vector or query, and neither do null ids; vectors of
    different lengths don't compare. Of rows with one id and vector one counts;
    queries that share an id share their result.
    """
    kind = vectors.schema[vector_col].dataType
    kind = kind if isinstance(kind.elementType, (T.FloatType, T.DoubleType)) else T.ArrayType(T.DoubleType())
    pick = lambda df: df.where(usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v")).dropDuplicates(["id", "v"])
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    held = stored(pick(vectors).withColumns({"dim": F.size("v"), "length": length}), "vectors")
    asked = stored(pick(queries), "queries")
    all_deals = deals(held, shard)
    shared = held.sparkSession.sparkContext.broadcast(all_deals)
    shards = max(1, sum(int(d.parts.sum()) for d in all_deals.values()))
    dealt = f"shard int, asks boolean, id long, v {_sql_type(kind)}, kth double"
    none = F.lit(None).cast("double").alias("kth")

    def search(wanted: DataFrame) -> DataFrame:
        rows = held.select("id", "v", none).mapInArrow(_deal(shared, False, None), dealt).union(wanted)
        # A partition for each shard: a range of one number each.
        ordered = rows.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "asks", "id")
        return ordered.mapInArrow(_kernel(shared, k, trees, miss), "query_id long, vec_id long, score double")

    found = search(asked.select("id", "v", none).mapInArrow(_deal(shared, True, None), dealt))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    if shards > 1:
        found = stored(found, "found")
        # The k-th score; with fewer than k vectors at home there is none yet.
        kth = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
        more = asked.join(kth, "id", "left").select("id", "v", "kth")
        found = found.union(search(more.mapInArrow(_deal(shared, True, route_miss), dealt))).dropDuplicates(["query_id", "vec_id", "score"])
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def self_search(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", **how) -> DataFrame:
    """``nearest`` with the rows whose id is divisible by ``every`` as queries against all rows."""
    return nearest(vectors, vectors.where(F.col(id_col) % every == 0), k, id_col, vector_col, **how)
