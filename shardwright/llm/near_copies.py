"""Near-copies: SimHash links, held against the Jaccard similarity of word shingles and made complete.

SimHash fingerprints of the shingles that differ in two bits at most are
linked by the bit-sliced comparison of ``simhash``; links count where the sets'
exact Jaccard similarity is high enough. Such fingerprints miss pairs near the threshold, so a prefix
filter, which loses no pair, finds the rest: the shingles of a text are put in one
global order, and two sets whose Jaccard similarity is t or more share a shingle
among the first n - ceil(t n) + 1 of each (n: its size). Any order is right; rare
ones first make it cheap, so shingles are counted in ``CELLS`` hashed cells. Equal
sets collapse first. Neighbours in a shingle's list are verified and connected, twice, so
groups of copies are one before pairs are looked for; then the pairs of a list that are not yet
connected are compared bit-sliced, by parity
marks of their sets: bit i of ``MARKS`` says whether an odd
number of items falls to i, so sets differ in at least as many items as their
marks in bits. Such marks tell nothing of sets of several times as many items, so pairs are then held against wide marks, whose
length grows with the set, long ones inside the lists already (up to ``LONG_MARKS`` bits); only what they leave open is made again from the texts and compared item by item. Lists stand in order of size, so a set is set only against those up to 1 / t of its size; only pairs within their radius come out as rows.

No list of a shingle needs to fit one task. Rows of crowded cells are salted before they are sorted, neighbours are sought
over ranges, and a list of more than ``LIST_PART`` sets is dealt in parts: sets of sizes within 1 / t form a
band, bands are split by hash, and every two parts of one band or of adjoining bands meet in a block of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwright.llm.common import cut, release, stored
from shardwright.llm.components import components
from shardwright.llm.simhash import links as fingerprint_links
from shardwright.llm.simhash import majority, shingle_hashes, sliced_pairs

SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: Cells of the counts that order shingles; they decide on cost only.
CELLS = 1 << 18
#: Bits of the marks; they too decide on cost only.
MARKS = 512
#: Bits of the wide marks for each item, at least; sets for which ``MARKS`` are as many have none.
WIDE = 2
#: Items from which on ``MARKS`` of unrelated sets no longer differ enough, and the most bits of the long marks that go with such sets into their lists.
LONG, LONG_MARKS = 1000, 8192
#: Sets that a task remembers, and sets whose ids (some MB) are broadcast.
SEEN, BROADCAST_SETS = 500_000, 500_000
#: Sets of a list from which on it is dealt in parts of that size, rows of a cell from which on they are salted, and long lists whose parts (some KB each) are broadcast.
LIST_PART, SALTED_ROWS, BROADCAST_LISTS = 4096, 1 << 20, 4096


def needed(size: int, similarity: float) -> int:
    """The least overlap of a set of ``size`` with any set that is similar enough."""
    return math.ceil(similarity * size - 1e-9)


def _sets(batch: pa.RecordBatch, shingle: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(hash of the set, shingle hashes, the distinct ones in order) of each text in column 1."""
    for text in batch.column(1).cast(pa.binary()):
        hashes = shingle_hashes(text.as_py(), shingle)
        items = np.unique(hashes.view("<i8"))
        yield xxhash.xxh64_intdigest(items.tobytes()) - (1 << 63), hashes, items


def parities(items: np.ndarray, places: int) -> np.ndarray:
    """Bytes of ``places`` (a power of two) bits: whether an odd number of items falls to each. Those of half as many places are the halves' exclusive or."""
    odd = np.bincount(((items.view(np.uint64) >> np.uint64(32)) % np.uint64(places)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8))


def wide_marks(items: np.ndarray) -> bytes | None:
    """Marks of a length that grows with the set, as ``MARKS`` bits tell nothing of a set of far more items."""
    n = WIDE * len(items)
    return parities(items, 1 << (n - 1).bit_length()).tobytes() if n > MARKS else None


def long_marks(items: np.ndarray) -> bytes | None:
    """Wide marks of up to ``LONG_MARKS`` bits for sets of ``LONG`` items or more."""
    n = min(WIDE * len(items), LONG_MARKS)
    return parities(items, 1 << (n - 1).bit_length()).tobytes() if len(items) >= LONG else None


def differing(one: pa.Scalar, two: pa.Scalar) -> int:
    """In how many bits two marks differ, once the longer ones are folded to the length of the others; 0 if one is null."""
    if not (one.is_valid and two.is_valid):
        return 0
    x, y = (np.frombuffer(m.as_buffer(), np.uint8) for m in (one, two))
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _wide_near(similarity: float):
    """Kernel over rows (a, b, id_a, id_b, size_a, size_b, wide_a, wide_b): (a, b, id_a, id_b) of those that wide marks leave open."""
    most = (1 - similarity) / (1 + similarity)  # of both sizes: what similar sets differ in at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            limit = most * (batch.column(4).to_numpy() + batch.column(5).to_numpy()) + 1e-6
            keep = np.array([differing(one, two) for one, two in zip(batch.column(6), batch.column(7))], np.int64) <= limit
            yield batch.filter(pa.array(keep)).select(["a", "b", "id_a", "id_b"])

    return run


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(id, fp, size, simhash, marks, wide, long) for every row of ``texts`` (id, t): a hash of its set of shingles, the set's size, majority bits, marks, wide and long marks; no words, no items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sizes, similar, marks, wide, long = [], [], [], [], [], []
            for fp, _, items in _sets(batch, shingle):
                fps.append(fp)
                sizes.append(len(items))
                similar.append(majority(items.view("<u8")))
                marks.append(parities(items, MARKS).view(np.int64).tolist())
                wide.append(wide_marks(items))
                long.append(long_marks(items))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), pa.array(similar, pa.int64()), pa.array(marks, pa.list_(pa.int64())), pa.array(wide, pa.binary()), pa.array(long, pa.binary())], names=["id", "fp", "size", "simhash", "marks", "wide", "long"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"id {kind}, fp long, size int, simhash long, marks array<long>, wide binary, long binary")


def cell_counts(texts: DataFrame, shingle: int) -> np.ndarray:
    """How many items of all rows' sets fall into each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(CELLS, np.int64)
        for batch in batches:
            for _, _, items in _sets(batch, shingle):
                np.add.at(n, (items.view(np.uint64) % np.uint64(CELLS)).astype(np.int64), 1)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used])], names=["cell", "n"])

    got = texts.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CELLS, np.int64)
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out


def _prefixes(order, shingle: int, similarity: float, salted: int):
    """Kernel over texts: (key, salt, size, fp) for each shingle in the front part of a set; a set that a task has seen does not come again.

    salt: 0, or from 1 on where the shingle's cell counts ``salted`` rows or more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = order.value, set()
        for batch in batches:
            keys, salts, sizes, fps, lengths = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [], [], []
            for fp, _, items in _sets(batch, shingle):
                if not len(items) or fp in seen:
                    continue
                if len(seen) > SEEN:
                    seen.clear()
                seen.add(fp)
                n = len(items)
                keys.append(items[np.lexsort((items, count[items.view(np.uint64) % np.uint64(CELLS)]))[: n - needed(n, similarity) + 1]])
                parts = count[keys[-1].view(np.uint64) % np.uint64(CELLS)] // salted
                salts.append(np.where(parts > 0, 1 + fp % (parts + 1), 0))
                sizes.append(n)
                fps.append(fp)
                lengths.append(len(keys[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(salts).astype(np.int32)), pa.array(np.repeat(np.array(sizes, np.int32), lengths)), pa.array(np.repeat(np.array(fps, np.int64), lengths))], names=["key", "salt", "size", "fp"])

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, salt, size, fp) that stand sorted by key, salt and fp: (key, size, fp) once each, if another set has the key or the key is salted."""
    held, joined = None, False  # the last row so far, and whether the one before has its key
    pick = ["key", "size", "fp"]
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*([] if held is None else [held]), batch]).combine_chunks().to_batches()[0]
        keys, salts, fps = (rows.column(c).to_numpy() for c in (0, 1, 3))
        same = (keys[1:] == keys[:-1]) & (salts[1:] == salts[:-1])
        fresh = np.concatenate([[True], ~same | (fps[1:] != fps[:-1])])
        rows = rows.filter(pa.array(fresh))
        keys, salts = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        same = (keys[1:] == keys[:-1]) & (salts[1:] == salts[:-1])
        keep = np.concatenate([[joined], same])[:-1] | same | (salts[:-1] > 0)
        yield rows.slice(0, len(keep)).filter(pa.array(keep)).select(pick)
        held, joined = rows.slice(len(keys) - 1), bool(same[-1]) if len(same) else joined
    if held is not None and (joined or held.column(1)[0].as_py() > 0):
        yield held.select(pick)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, size, fp, root) that stand sorted: pairs (a, b) of neighbours of one key with different roots."""
    last = None
    for batch in batches:
        rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in (0, 2, 3)], axis=1)
        if last is not None:
            rows = np.concatenate([last, rows])
        last = rows[-1:].copy()
        one, two = rows[:-1], rows[1:]
        pick = (one[:, 0] == two[:, 0]) & (one[:, 2] != two[:, 2])
        a, b = one[pick, 1], two[pick, 1]
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


@dataclass
class Verifier:
    """Pairs of sets held against their exact similarity; only sets that pairs by marks leave open are made again from their texts."""

    texts: DataFrame  # id, t
    sets: DataFrame  # id, fp, size, simhash
    marks: DataFrame  # fp, size, marks, wide, long, first: once for each set
    shingle: int
    similarity: float

    def similar(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets are similar enough."""
        most = (1 - self.similarity) / (1 + self.similarity)  # of both sizes: what similar sets differ in at most
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        one, two = (self.marks.drop("wide", "long").alias(x) for x in ("one", "two"))
        differ = " + ".join(f"bit_count(one.marks[{k}] ^ two.marks[{k}])" for k in range(MARKS // 64))
        near = f"least(one.size, two.size) >= {self.similarity!r}D * greatest(one.size, two.size) - 1e-9D and {differ} <= {most!r}D * (one.size + two.size) + 1e-6D"
        met = pairs.join(one, F.col("a") == F.col("one.fp")).join(two, F.col("b") == F.col("two.fp")).where(near)
        met = met.select("a", "b", F.col("one.first").alias("id_a"), F.col("two.first").alias("id_b"), F.col("one.size").alias("size_a"), F.col("two.size").alias("size_b"))
        for x in ("a", "b"):
            met = met.join(self.marks.select(F.col("fp").alias(x), F.col("wide").alias(f"wide_{x}")), x)
        kind = self.sets.schema["id"].dataType.simpleString()
        rows = met.select("a", "b", "id_a", "id_b", "size_a", "size_b", "wide_a", "wide_b")
        left = cut(rows.mapInArrow(_wide_near(self.similarity), f"a long, b long, id_a {kind}, id_b {kind}"))
        nodes = cut(left.select(F.col("id_a").alias("id"), F.col("a").alias("fp")).union(left.select("id_b", "b")).distinct())
        # Eight bytes for each set: few are broadcast, more join by shuffle.
        few = nodes.limit(BROADCAST_SETS + 1).count() <= BROADCAST_SETS
        own = self.texts.join(F.broadcast(nodes) if few else nodes, "id").select("fp", "t").mapInArrow(_items(self.shingle), "fp long, items array<long>")
        both = left.join(own.toDF("a", "x"), "a").join(own.toDF("b", "y"), "b")
        common = F.size(F.array_intersect("x", "y"))
        found = cut(both.where(common >= F.lit(self.similarity) * (F.size("x") + F.size("y") - common) - 1e-9).select("a", "b"))
        release(self.texts.sparkSession)
        return found


def _items(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([items for _, _, items in _sets(batch, shingle)], pa.list_(pa.int64()))], names=["fp", "items"])

    return run


def simhash_pairs(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets that SimHash links connect: equal fingerprints meet at their smallest set, and those at the fingerprint they are linked to."""
    own = cut(sets.where("size > 0").groupBy("simhash").agg(F.min("fp").alias("low")))
    same = sets.where("size > 0").join(own, "simhash").where("fp <> low").select(F.col("low").alias("a"), F.col("fp").alias("b"))
    edges = fingerprint_links(own.select(F.col("simhash").alias("fp")))
    linked = edges.join(own.toDF("a", "x"), "a").join(own.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return same.union(linked)


def _close(similarity: float):
    """Kernel over rows (key, size, fp, root, marks, side, long) sorted by key and size: pairs (a, b) of a key that may be similar by marks, and by long marks where both have some, and have different roots; of sides from 0 on those of different sides."""
    most = (1 - similarity) / (1 + similarity)  # of both sizes: what similar sets differ in at most

    def pairs(groups: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        groups.sort(key=lambda g: len(g[0]), reverse=True)
        size, fp, root, marks, side, long = (np.concatenate(c) for c in zip(*groups))
        bits = np.unpackbits(marks.view(np.uint8), axis=1)
        radius = np.floor(most * (1 + 1 / similarity) * size + 1e-6).astype(np.int64)  # the other set is the larger one

        def fits(d: int, lanes: int) -> np.ndarray:
            n = min(lanes, len(size) - d)  # lanes beyond have no partner
            one, two = slice(0, n), slice(d, d + n)
            out = np.zeros(lanes, bool)
            out[one] = (size[one] >= similarity * size[two] - 1e-9) & (root[one] != root[two]) & ((side[one] < 0) | (side[one] != side[two]))
            return out

        for i, j in sliced_pairs(bits, [len(g[0]) for g in groups], radius, fits, 16):
            differ = np.bitwise_count((marks[i] ^ marks[j]).view(np.uint64)).sum(axis=1)
            limit = most * (size[i] + size[j]) + 1e-6
            near = differ <= limit
            for k in np.flatnonzero(near & (np.minimum(size[i], size[j]) >= LONG)).tolist():
                near[k] = long[i[k]] is None or long[j[k]] is None or differing(long[i[k]], long[j[k]]) <= limit[k]
            a, b = np.minimum(fp[i], fp[j])[near], np.maximum(fp[i], fp[j])[near]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple[np.ndarray, ...]] = []
        held: list[tuple[np.ndarray, ...]] = []
        key, count = None, 0
        for batch in batches:
            keys, size, fp, root = (batch.column(c).to_numpy() for c in range(4))
            marks, side = batch.column(4).flatten().to_numpy().reshape(-1, MARKS // 64), batch.column(5).to_numpy()
            long = np.empty(batch.num_rows, object)
            for at in np.flatnonzero(size >= LONG).tolist() if batch.num_columns > 6 else ():
                long[at] = pa.scalar(batch.column(6)[at].as_py(), pa.binary())
            edges = np.flatnonzero(np.diff(keys)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(keys)]):
                if lo == hi:
                    continue
                if keys[lo] != key:
                    if held:
                        ready.append(tuple(np.concatenate(c) for c in zip(*held)))
                        count += len(ready[-1][0])
                    if count > 4096:
                        yield from pairs(ready)
                        ready, count = [], 0
                    key, held = keys[lo], []
                held.append((size[lo:hi].astype(np.int64), fp[lo:hi].copy(), root[lo:hi].copy(), marks[lo:hi].copy(), side[lo:hi].copy(), long[lo:hi].copy()))
        if held:
            ready.append(tuple(np.concatenate(c) for c in zip(*held)))
        if ready:
            yield from pairs(ready)

    return run


def blocks(rows: DataFrame, similarity: float, part: int) -> DataFrame:
    """``rows`` (key, size, fp, ...) with ``side``: lists of up to ``part`` rows as they are, with side -1.

    Longer ones are dealt: a row comes once for each block of two parts that it is in, under the block's key and with its
    side there, and once for its own part with side -1. A part has about ``part`` rows of one band; similar sets are in
    one band or in adjoining ones, as a band's sizes span a little over 1 / ``similarity``.
    """
    banded = rows.withColumn("band", F.floor(F.log("size") / F.lit(-math.log(0.999 * similarity))).cast("int"))
    counted = banded.groupBy("key", "band").agg(F.count("*").alias("n"))
    lists = counted.groupBy("key").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("n") / part).cast("int")))).alias("parts"))
    long = cut(lists.where(F.col("n") > part).select("key", "parts"))
    few = long.limit(BROADCAST_LISTS + 1).count() <= BROADCAST_LISTS
    dealt = banded.join(F.broadcast(long) if few else long, "key", "left")
    parts = lambda step: F.coalesce(F.try_element_at("parts", F.col("band") + step), F.lit(0))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("fp"), F.when(F.col("parts").isNull(), 1).otherwise(parts(0))).cast("int"))

    def met(step: int):
        """The blocks of the own part with all parts of the band ``step`` further."""
        own = lambda j: F.struct(
            F.xxhash64("key", *(("band", F.least("mine", j), F.col("band"), F.greatest("mine", j)) if step == 0 else ("band", "mine", F.col("band") + 1, j) if step > 0 else (F.col("band") - 1, j, F.col("band"), "mine"))).alias("key"),
            (F.when(F.col("mine") == j, -1).when(F.col("mine") < j, 0).otherwise(1) if step == 0 else F.lit(0 if step > 0 else 1)).alias("side"),
        )
        return F.transform(F.filter(F.sequence(F.lit(0), parts(step)), lambda j: j < parts(step)), own)

    whole = F.array(F.struct(F.col("key"), F.lit(-1).alias("side")))
    places = F.when(F.col("parts").isNull(), whole).otherwise(F.concat(met(0), met(1), met(-1)))
    others = [c for c in rows.columns if c != "key"]
    return dealt.select(F.explode(places).alias("place"), *others).select("place.key", *others, "place.side")


def links(check: Verifier, part: int = LIST_PART, salted: int = SALTED_ROWS) -> DataFrame:
    """Edges (a, b) that connect what the similar pairs of sets connect."""
    sets, similarity = check.sets, check.similarity
    found = check.similar(simhash_pairs(sets))
    order = sets.sparkSession.sparkContext.broadcast(cell_counts(check.texts, check.shingle))
    rows = check.texts.mapInArrow(_prefixes(order, check.shingle, similarity, salted), "key long, salt int, size int, fp long").repartition("key", "salt").sortWithinPartitions("key", "salt", "fp")
    placed = stored(rows.mapInArrow(_repeated, "key long, size int, fp long"), "placed")
    release(sets.sparkSession)

    def rooted(placed: DataFrame) -> DataFrame:
        """``placed`` with the root that links so far give each set, for keys of several roots."""
        nonlocal found
        roots = components(found)
        found = roots.where("node <> root").toDF("a", "b")  # stars in the place of all links so far
        made = placed.join(roots, F.col("fp") == F.col("node"), "left").select("key", "size", "fp", F.coalesce("root", "fp").alias("root"))
        several = made.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
        made = stored(made.join(several, "key", "left_semi"), "rooted")
        release(sets.sparkSession)
        return made

    for order_by in (("size", "fp"), ("root", "size", "fp")):  # neighbours by size, then, of what is left, by root
        apart = rooted(placed)
        beside = apart.repartitionByRange("key", *order_by).sortWithinPartitions("key", *order_by).mapInArrow(_neighbours, "a long, b long")
        found = cut(found.union(check.similar(beside)))
        placed = apart.select("key", "size", "fp")

    marked = blocks(rooted(placed), similarity, part).join(check.marks.select("fp", "marks", "long"), "fp").select("key", "size", "fp", "root", "marks", "side", "long")
    rest = marked.repartition("key").sortWithinPartitions("key", "size", "fp").mapInArrow(_close(similarity), "a long, b long")
    return found.union(check.similar(cut(rest.distinct())))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS, similarity: float = SIMILARITY, part: int = LIST_PART, salted: int = SALTED_ROWS) -> DataFrame:
    """One row per row of ``docs``: (id_col, component_id).

    component_id: the smallest id reachable over texts whose sets of ``shingle``
    words have a Jaccard similarity of ``similarity`` or more; a text of fewer
    words is one shingle, texts without words are alike. Ids are not null and do not repeat. No rows in: no rows out.
    Sets are small figures here; shingles are made from the texts where they are needed, never written.
    """
    texts = texts_of(docs, id_col, text_col)
    sets = stored(shingle_sets(texts, shingle), "sets")
    marks = stored(sets.groupBy("fp").agg(F.first("size").alias("size"), F.first("marks").alias("marks"), F.first("wide").alias("wide"), F.first("long").alias("long"), F.min("id").alias("first")), "marks")
    roots = components(links(Verifier(texts, sets, marks, shingle, similarity), part, salted))
    placed = sets.select("id", "fp").join(roots, F.col("fp") == F.col("node"), "left").select("id", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("id").alias("component_id"))
    return placed.join(named, "root").select(F.col("id").alias(id_col), "component_id")
