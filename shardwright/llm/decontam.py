"""Benchmark decontamination with Wu-Manber multi-pattern search over words.

Patterns are the 13-word windows of the benchmark items (an item of fewer words
is one pattern). Words are numbers, 64-bit hashes made by numpy from the text's
bytes. The search slides a window of the pattern's length m over a text's
words, in many lanes at once: the block, the window's last two words, looks up a
shift in a table of a fixed size, how far the window may move before any pattern could end there. Shift
zero leads to the suffix-hash bucket of that block; in it patterns are sorted by a hash of
all their words, so a place meets only what has its own hash, however common its block is, and is then
compared directly, byte for byte. Equal windows of many items are one pattern with a list of items. Patterns of each length below 13 have
tables of their own, so that a short item doesn't shorten all shifts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardwright.llm.common import WORD_TABLE, shielded, stored

WINDOW = 13
#: Text of the benchmark that one broadcast index holds, about (an index takes some 6 times as much).
INDEX_BYTES = 32 << 20
#: Words of a lane, entries of a shift table at most, and bytes of text searched at once.
LANE, MAX_SHIFTS, PORTION = 64, 1 << 24, 1 << 20

_PRIME = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, hashes, words of each text): lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 texts, one after the other."""
    data = np.frombuffer(b" ".join([*(t.translate(WORD_TABLE) for t in texts), b""]) + b" ", np.uint8)
    inside = data != 0x20
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]
    hashes = np.zeros(len(starts), np.uint64)
    lengths = ends - starts
    # A byte of every word at a time, over the words that go on.
    live, k = np.arange(len(starts)), 0
    while len(live):
        hashes[live] = (hashes[live] ^ data[starts[live] + k]) * np.uint64(0x100000001B3) + np.uint64(k + 1)
        k += 1
        live = live[lengths[live] > k]
    sizes = np.array([len(t) for t in texts], np.int64)
    ends_of = np.cumsum(sizes + 1)
    counts = np.diff(np.searchsorted(starts, ends_of, "left"), prepend=0)
    return data, starts, ends, mixed(hashes * _PRIME), counts


class Patterns:
    """Wu-Manber tables of windows of one length ``m`` over the words of an index."""

    def __init__(self, words: np.ndarray, at: np.ndarray, item: np.ndarray, m: int):
        self.m, self.block = m, min(2, m)
        key = self._keys(words, at + m)
        order = np.lexsort((item[at], key))
        at, key = at[order], key[order]
        # Rows are distinct windows; one of another text with the same hash, should there be any, is a row of its own.
        first = np.ones(len(at), bool)
        first[1:] = key[1:] != key[:-1]
        lead = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        for k in range(m):
            first |= words[at + k] != words[at[lead] + k]
        row = np.cumsum(first) - 1
        fresh = np.ones(len(at), bool)  # windows that an item repeats count once
        fresh[1:] = (row[1:] != row[:-1]) | (item[at[1:]] != item[at[:-1]])
        self.at, self.key = at[first].astype(np.int32), key[first]
        self.items = item[at[fresh]].astype(np.int32)
        self.items_to = np.cumsum(np.bincount(row[fresh], minlength=int(first.sum())))
        size = 1 << 8
        while size < min(MAX_SHIFTS, 4 * max(1, len(at))):
            size *= 2
        self.mask = np.uint64(size - 1)
        self.shift = np.full(size, m - self.block + 1, np.uint8)
        for end in range(self.block, m + 1):  # the longest distance first, so the shortest one stays
            self.shift[self._block(words, at + end) & self.mask] = m - end

    def _block(self, words: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of the block that ends before each position."""
        return words[end - 1] if self.block == 1 else mixed(words[end - 2] * _PRIME + words[end - 1])

    def _keys(self, words: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For the window before each position: the hash of its block in the upper half, of all its words in the lower one."""
        whole = np.zeros(len(end), np.uint64)
        for k in range(self.m, 0, -1):
            whole = mixed(whole * _PRIME + words[end - k])
        return (self._block(words, end) & np.uint64(0xFFFFFFFF00000000)) | (whole >> np.uint64(32))

    def candidates(self, words: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Window ends, of those in the lanes [first, stop), whose block ends some pattern."""
        out, at = [], first.copy()
        while len(at):
            step = self.shift[self._block(words, at) & self.mask]
            out.append(at[step == 0])
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        return np.concatenate(out) if out else np.empty(0, np.int64)

    def search(self, words: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, row) pairs whose hashes agree; ``begins`` and ``ends`` bound the texts in ``words``."""
        first, stop = begins + self.m, ends + 1  # where windows may end
        lanes = np.maximum(0, -(-(stop - first) // LANE))
        of = np.repeat(np.arange(len(first)), lanes)
        number = np.arange(len(of)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        lane = first[of] + number * LANE
        found = self.candidates(words, lane, np.minimum(lane + LANE, stop[of]))
        keys = self._keys(words, found)
        lo = np.searchsorted(self.key, keys, "left")
        met = np.flatnonzero(self.key[np.minimum(lo, len(self.key) - 1)] == keys)
        found, keys, lo = found[met], keys[met], lo[met]
        n = np.searchsorted(self.key, keys, "right") - lo
        row = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(found, n) - self.m, row

    def items_of(self, row: int) -> np.ndarray:
        return self.items[self.items_to[row - 1] if row else 0 : self.items_to[row]]


class Index:
    """The windows of benchmark items, for search in texts."""

    def __init__(self, items: list[tuple[object, bytes]], size: int = WINDOW):
        self.items = [i for i, _ in items]
        data, starts, ends, words, counts = word_hashes([t for _, t in items])
        self.text, self.starts, self.ends = data.tobytes(), starts.astype(np.int64), ends.astype(np.int64)
        item = np.repeat(np.arange(len(items), dtype=np.int32), counts)
        first = np.cumsum(counts) - counts
        self.patterns = []
        for m in np.unique(np.minimum(counts, size)).tolist():
            if m:
                mine = np.minimum(counts, size) == m
                windows = np.where(mine, counts - m + 1, 0)
                at = np.repeat(first, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
                self.patterns.append(Patterns(words, at, item, m))

    def hits(self, texts: list[bytes]) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set]]:
        """For each text: its words, the disjoint word ranges [from, to) inside any occurrence, and the numbers of the items that occur."""
        data, starts, ends, words, counts = word_hashes(texts)
        begins = np.cumsum(counts) - counts
        ranges: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set] = [set() for _ in texts]
        raw = None
        for p in self.patterns:
            found, row = p.search(words, begins, begins + counts)
            if not len(found):
                continue
            raw = raw or data.tobytes()
            of = np.searchsorted(begins + counts, found, "right")
            told: set[tuple[int, int]] = set()
            for doc, start, pattern in zip(of.tolist(), found.tolist(), row.tolist()):
                at = int(p.at[pattern])
                # Direct comparison of the words themselves.
                if raw[starts[start] : ends[start + p.m - 1]].split() == self.text[self.starts[at] : self.ends[at + p.m - 1]].split():
                    ranges[doc].append((start - int(begins[doc]), start - int(begins[doc]) + p.m))
                    if (doc, pattern) not in told:
                        told.add((doc, pattern))
                        items[doc].update(p.items_of(pattern).tolist())
        return counts, [merged(r) for r in ranges], items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(set(ranges)):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


RANGES = "array<struct<from_word:int,to_word:int>>"


def _scan(docs: DataFrame, index: Index, text_at: int, schema: T.StructType) -> DataFrame:
    """``docs`` with the words, hit ranges and items of each row, by one index; its last three columns give way."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    last = len(schema) - 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value  # a worker keeps it for its next tasks
        for batch in batches:
            texts, n_words, ranges, ids = [], [], [], []

            def flush() -> None:
                counts, found, got = index.hits(texts)
                n_words.extend(counts.tolist())
                ranges.extend([{"from_word": lo, "to_word": hi} for lo, hi in r] for r in found)
                ids.extend(sorted({index.items[k] for k in g} - {None}) for g in got)
                texts.clear()

            size = 0
            for text in batch.column(text_at).cast(pa.binary()):
                texts.append(text.as_py() or b"")
                size += len(texts[-1])
                if size > PORTION:
                    flush()
                    size = 0
            if texts:
                flush()
            arrays = [*batch.columns[:last], pa.array(n_words, pa.int64()), pa.array(ranges, batch.schema.field(last + 1).type), pa.array(ids, batch.schema.field(last + 2).type)]
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    return docs.mapInArrow(run, schema)


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, max_block_bytes: int) -> Iterator[list]:
    """The benchmark's rows in lists of at most ``max_block_bytes`` of text (or one row)."""
    block, size = [], 0
    for row in benchmark.select(item_col, text_col).toLocalIterator():
        text = (row[1] or "").encode()
        if block and size + len(text) > max_block_bytes:
            yield block
            block, size = [], 0
        block.append((row[0], text))
        size += len(text)
    if block:
        yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", max_block_bytes: int = INDEX_BYTES) -> DataFrame:
    """``docs`` with _n_words, _hit_ranges (word ranges inside benchmark windows) and _hit_items.

    Columns of these names in ``docs`` give way. A benchmark of up to ``max_block_bytes`` of text
    is one broadcast index and one pass without a shuffle. A larger one is searched for block by
    block: each pass holds one index, over texts written once with a number for each row, and leaves only rows
    that are hit, which meet again by that number. Null and empty texts have no
    words. Items without words match nothing; a null item id marks words but
    isn't listed. Repeated rows stay. An empty benchmark finds nothing.
    """
    kind = benchmark.schema[item_col].dataType
    docs = docs.drop("_n_words", "_hit_ranges", "_hit_items")
    added = {"_n_words": F.lit(0).cast("long"), "_hit_ranges": F.lit(None).cast(RANGES), "_hit_items": F.lit(None).cast(T.ArrayType(kind))}

    def scanned(df: DataFrame, items: list) -> DataFrame:
        start = df.withColumns(added)
        return _scan(start, Index(items), start.columns.index(text_col), T.StructType([T.StructField(f.name, f.dataType) for f in start.schema]))

    blocks = benchmark_blocks(benchmark, item_col, item_text, max_block_bytes)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return scanned(docs, first)
    row = next(n for k in range(len(docs.columns) + 1) if (n := f"_row{k}").lower() not in {c.lower() for c in docs.columns})
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    narrow = rows.select(row, text_col)
    out = stored(scanned(narrow, first).drop(text_col), "hits")
    hits = out.where(F.size("_hit_ranges") > 0)
    while second is not None:
        hits = hits.union(stored(scanned(narrow, second).where(F.size("_hit_ranges") > 0).drop(text_col), "hits"))
        second = next(blocks, None)
    # Ranges of all blocks in order, joined where they meet or overlap.
    ordered = F.array_sort(F.flatten(F.collect_list("_hit_ranges")))
    join = F.aggregate(ordered, F.array().cast(RANGES), lambda done, r: F.when((F.size(done) > 0) & (F.element_at(done, -1)["to_word"] >= r["from_word"]),
        F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(F.element_at(done, -1)["from_word"].alias("from_word"), F.greatest(F.element_at(done, -1)["to_word"], r["to_word"]).alias("to_word"))))).otherwise(F.concat(done, F.array(r))))
    both = hits.groupBy(row).agg(join.alias("_hit_ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_hit_items")))).alias("_hit_items"))
    whole = rows.join(out.select(row, "_n_words"), row).join(both, row, "left")
    return whole.select(*docs.columns, "_n_words", F.coalesce("_hit_ranges", F.array().cast(RANGES)).alias("_hit_ranges"), F.coalesce("_hit_items", F.array().cast(T.ArrayType(kind))).alias("_hit_items"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row per document: id_col, n_words, n_hit, n_items, items_sha256, contaminated.

    contaminated: some word is hit, and hits are a twentieth of the words or more.
    """
    found = find_contamination(docs.select(id_col, text_col), benchmark, text_col, item_col)
    n_hit = F.aggregate("_hit_ranges", F.lit(0).cast("long"), lambda n, r: n + r["to_word"] - r["from_word"])
    ids = F.array_sort(F.transform("_hit_items", lambda x: x.cast("string")))
    return found.select(
        id_col,
        F.col("_n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("_hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("_n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their own columns."""
    inner, restored = shielded(docs, {text_col}, {"_n_words", "_hit_ranges", "_hit_items"})
    found = find_contamination(inner, benchmark, text_col, item_col)
    n_hit = F.aggregate("_hit_ranges", F.lit(0).cast("long"), lambda n, r: n + r["to_word"] - r["from_word"])
    return restored(found.where(~((n_hit > 0) & (20 * n_hit >= F.col("_n_words")))))
