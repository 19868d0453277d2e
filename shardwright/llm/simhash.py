"""SimHash near-duplicates with a bit-sliced comparison.

Fingerprints are made in tasks over Arrow batches. Equal fingerprints collapse
first, so a group of copies of any size becomes one row. Distinct fingerprints
meet in buckets of 2 equal blocks out of 4: two fingerprints that differ in two
bits at most agree in two of four blocks, so no link is lost. Inside a bucket
the bits stand vertically: plane b holds bit b of every fingerprint. One shift
by d sets each fingerprint against its d-th neighbour, all lanes at once;
carry-save counters count differing bits, and the block is abandoned once
every lane exceeds the radius. A bucket beyond ``max_bucket`` goes on
to a second level that also fixes 16 of the other 32 bits, which leaves at most
65,536 distinct fingerprints in one bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardwright.llm.common import cut, shielded, stored
from shardwright.llm.components import components, lowest

SHINGLE_WORDS, SEED = 3, 42
#: Blocks of 64 rows (some 32 bytes each) that are broadcast.
BROADCAST_BLOCKS = 1 << 20
#: Bits in which linked fingerprints differ at most; buckets of two blocks of four lose no link up to here.
RADIUS = 2


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 of the word shingles, repeats included; fewer words than that are one shingle."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, "<u8")
    parts = [words[i:] for i in range(min(shingle, len(words)))] if len(words) >= shingle else [[b" ".join(words)]]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.fromiter((digest(join(s), SEED) for s in zip(*parts)), dtype="<u8", count=len(parts[-1]))


def fingerprint(text: bytes | None, shingle: int = SHINGLE_WORDS) -> int:
    """64 majority bits of the XXH64 of the word shingles, repeats included; 0 without words."""
    return majority(shingle_hashes(text, shingle))


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) for every row; null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = [fingerprint(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, fp long")


def packed(flags: np.ndarray) -> int:
    """Flags as one number, the first at its lowest bit."""
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def sliced_pairs(bits: np.ndarray, sizes: list[int], radius: np.ndarray, lanes_of: Callable[[int, int], np.ndarray] | None = None, step: int = 4) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j), i < j, of rows of one group whose bits differ in ``radius[i]`` places at most.

    ``bits`` (rows x places) holds the groups one after the other, the largest
    first. The places stand as planes; a shift by d sets every row against its
    d-th neighbour, carry-save counters take in a plane at a time, and a
    shift is abandoned once all its lanes exceed their radius. ``lanes_of`` (d, lanes)
    may leave lanes out.
    """
    n, sizes_a = len(bits), np.asarray(sizes)
    starts = np.cumsum(sizes_a) - sizes_a
    left = np.repeat(starts + sizes_a, sizes_a) - np.arange(n)  # lanes from here to the group's end
    varied = bits != np.repeat(bits[starts], sizes_a, axis=0)
    planes = [packed(bits[:, b]) for b in np.flatnonzero(varied.any(axis=0))]
    width = int(min(len(planes), radius.max(initial=0))).bit_length()
    radius = np.minimum(radius, (1 << width) - 1)
    limit = [packed(radius >> k & 1 == 1) for k in range(width)]
    for d in range(1, int(sizes_a.max(initial=1))):
        lanes = int(sizes_a[sizes_a > d].sum())  # larger groups stand in front
        live = left[:lanes] > d
        low = packed(live if lanes_of is None else live & lanes_of(d, lanes))  # lanes within their radius so far
        mask = (1 << lanes) - 1
        counters = [0] * width
        for k, plane in enumerate(planes):
            if not low:
                break
            carry = (plane ^ (plane >> d)) & mask
            for c in range(width):
                counters[c], carry = counters[c] ^ carry, counters[c] & carry
                if not carry:
                    break
            low &= ~carry  # beyond what counters hold
            if k % step == step - 1 or k == len(planes) - 1:
                over, same = 0, mask
                for c in range(width - 1, -1, -1):
                    over |= same & counters[c] & ~limit[c]
                    same &= ~(counters[c] ^ limit[c])
                low &= ~over
        if low:
            hit = np.flatnonzero(np.unpackbits(np.frombuffer(low.to_bytes((lanes + 7) // 8, "little"), np.uint8), bitorder="little"))
            yield hit, hit + d


def close_pairs(fps: np.ndarray, sizes: list[int], radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of fingerprints of one group that differ in ``radius`` bits at most; ``fps`` (uint64) holds the groups, the largest first."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    found = [(np.empty(0, np.int64), np.empty(0, np.int64)), *sliced_pairs(bits, sizes, np.full(len(fps), radius))]
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def _bucket_links(max_bucket: int | None):
    """Kernel over rows (key, fp) that stand sorted by key: (a, b, key). b null: the bucket is too large, a goes on."""

    def solve(groups: list[np.ndarray]) -> tuple[list, list]:
        groups.sort(key=len, reverse=True)
        fps = np.concatenate(groups)
        i, j = close_pairs(fps.view(np.uint64), [len(g) for g in groups])
        root = lowest(len(fps), i, j) if len(i) else np.arange(len(fps))
        moved = np.flatnonzero(root != np.arange(len(fps)))
        return fps[moved], fps[root[moved]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64())])
        ready: list[np.ndarray] = []
        held: list[np.ndarray] = []
        count, held_n, held_key, too_large = 0, 0, None, False

        def spill(key: int, arrays: list[np.ndarray]) -> pa.RecordBatch:
            a = np.concatenate(arrays)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()), pa.array(np.full(len(a), key))], schema=schema)

        def links() -> pa.RecordBatch:
            a, b = solve(ready)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.zeros(len(a), np.int64))], schema=schema)

        for batch in batches:
            keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero(np.diff(keys)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(keys)]):
                if hi == lo:
                    continue
                if held_key is None or keys[lo] != held_key:
                    if held_n > 1 and not too_large:
                        ready.append(np.concatenate(held))
                        count += held_n
                    if count > 8192:
                        yield links()
                        ready, count = [], 0
                    held, held_n, held_key, too_large = [], 0, keys[lo], False
                held_n += hi - lo
                held.append(fps[lo:hi].copy())
                if max_bucket and held_n > max_bucket:
                    too_large = True
                    yield spill(int(held_key), held)
                    held = []
        if held_n > 1 and not too_large:
            ready.append(np.concatenate(held))
        if ready:
            yield links()

    return run


def _pairs_of_blocks(value: Column, width: int, low: int) -> Column:
    """The 6 choices of 2 out of 4 blocks of ``width`` bits from bit ``low`` on: (choice, bits)."""
    block = [F.shiftrightunsigned(value, low + width * k).bitwiseAND(F.lit((1 << width) - 1)) for k in range(4)]
    return F.array(*(F.struct(F.lit(n).cast("long").alias("choice"), F.shiftleft(block[i], width).bitwiseOR(block[j]).alias("bits")) for n, (i, j) in enumerate(combinations(range(4), 2))))


def links(distinct: DataFrame, max_bucket: int = 16384) -> DataFrame:
    """Edges (a, b) that connect what the close pairs of ``distinct.fp`` (no repeats) connect."""
    first = distinct.select("fp", F.explode(_pairs_of_blocks(F.col("fp"), 16, 0)).alias("k")).select(F.shiftleft("k.choice", 32).bitwiseOR(F.col("k.bits")).alias("key"), "fp")
    made = cut(first.repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_links(max_bucket), "a long, b long, key long"))
    edges, large = made.where("b is not null").select("a", "b"), made.where("b is null")
    if large.isEmpty():
        return edges
    # The two blocks that a key does not fix, as one value of 32 bits.
    rest = F.lit(None).cast("long")
    for n, fixed in enumerate(combinations(range(4), 2)):
        i, j = sorted(set(range(4)) - set(fixed))
        part = [F.shiftrightunsigned("a", 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in (i, j)]
        rest = F.when(F.shiftright("key", 32) == n, F.shiftleft(part[1], 16).bitwiseOR(part[0])).otherwise(rest)
    second = (
        large.select("key", F.col("a").alias("fp"), F.explode(_pairs_of_blocks(rest, 8, 0)).alias("k"))
        .select("key", "k.choice", "k.bits", "fp")
        .select(F.xxhash64("key", "choice", "bits").alias("key"), "fp")
    )
    more = second.repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_links(None), "a long, b long, key long")
    return edges.union(more.select("a", "b"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bucket: int = 16384) -> DataFrame:
    """One row per row of ``docs``: (id_col, fingerprint, component_id).

    fingerprint: 16 hex digits. component_id: the smallest id reachable over
    links of at most two differing bits. Null, empty and blank texts have
    fingerprint zero and link like any other. Rows with a null id take part in
    links but never name a component (null if no row of it has an id). Repeated
    ids and rows stay. No rows in: no rows out. Other columns are not read.
    """
    fps = cut(fingerprints(docs, id_col, text_col))
    distinct = fps.groupBy("fp").agg(F.min("id").alias("low"))
    roots = components(links(distinct.select("fp"), max_bucket))
    placed = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = placed.join(named, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", found: Callable[[DataFrame, str, str], DataFrame] = simhash_components) -> DataFrame:
    """One row of each near-duplicate group: the smallest id (null last), then the smallest text hash.

    ``found`` gives (id_col, component_id) of all rows. Rows get a key of their
    own, written once, so repeated and null ids stand for their own texts.
    """
    inner, restored = shielded(docs, {id_col, text_col}, {"_row", "_block", "_mask"})
    rows = stored(inner.withColumn("_row", F.monotonically_increasing_id()), "rows")
    own = rows.select("_row", F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))
    best = found(rows, "_row", text_col).join(own, "_row").groupBy("component_id").agg(F.min(F.struct("none", "id", "hash", "_row")).alias("best"))
    return restored(picked(rows, best.select("best._row")))


def picked(rows: DataFrame, chosen: DataFrame, most: int = BROADCAST_BLOCKS) -> DataFrame:
    """The rows whose ``_row`` (not negative) is in ``chosen``, without moving the others or their texts.

    64 keys in a row are one block with a bit for each of its chosen keys; blocks are broadcast, and beyond ``most`` of them rows join by shuffle.
    """
    block = F.shiftright("_row", 6)
    masks = cut(chosen.groupBy(block.alias("_block")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_row & 63 as int))")).alias("_mask")))
    few = masks.limit(most + 1).count() <= most
    met = rows.withColumn("_block", block).join(F.broadcast(masks) if few else masks, "_block")
    return met.where(F.expr("getbit(_mask, cast(_row & 63 as int)) = 1")).drop("_block", "_mask")
