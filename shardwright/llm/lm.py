"""Language-model scoring with a log-frequency Bloom filter.

Words and word pairs of all training rows are counted by 64-bit hashes: tasks
count over their Arrow batches, Spark adds up. The filter holds quantised counts:
an entry of level q (2^(q-1) to 2^q - 1 occurrences) is stored as the q pairs
(entry, 1) ... (entry, q), so a count is read by probing levels until one is
missing; a level stands for the mean count of its entries. Every first word of
pairs also has its total, the sum of its pairs' counts as they will be read,
stored as a level and one of its sixteenths, rounded up, so that no probability passes 1. All words and
pairs are stored. Some absent pairs are read as stored; how many of a vocabulary that will be is known
from the filter's bits, and this number is part of every total. Probes grow with the vocabulary, so
that it stays far below ``PRIOR`` at any size.

The probability of a word is (pair count + PRIOR * word probability) / (total +
PRIOR), so over the vocabulary and the unknown word it sums to 1 but for the
sixteenths. The filter is built in slices by tasks.

Little text (so little that its filter can't pass ``MAX_BITS``) has its filter broadcast. For more text the
keys go to the filter, once: texts fall into blocks of about ``STRETCH`` tokens, and a block sends each slice
one row, the packed distinct keys that fall to it with their counts in training rows. The task of a slice adds
the counts up, builds its part of the filter and answers each row by one with a level for each key, so neither
the filter nor a table of counts is written. Blocks keep their tokens as places in their list of words, so
texts are split once.

The base score is exact. For little text
the most frequent words (at most ``HEAD`` by a threshold on their counts) are
broadcast as sorted arrays, and every other word, seen in training or not, joins the
full table of counts by shuffle; for more text the slices answer with the counts of words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardwright.llm.common import crc_bucket, release, stored
from shardwright.session import file_batches

END, START = xxhash.xxh64_intdigest(b" end"), xxhash.xxh64_intdigest(b" start")
#: The largest filter that is broadcast (128 MB), and about the largest slice of a filter (4 MB).
MAX_BITS, SLICE_BITS = 1 << 30, 1 << 25
SLICES, MAX_LEVEL = 64, 44
#: A total is stored as a level and one of so many parts of it; entries (key, AFTER + code) tell the part.
PARTS, AFTER = 16, 64
#: Probes for each stored pair, at least.
PROBES = 8
HEAD = 1 << 20
PRIOR, ALPHA = 20.0, 0.1
#: The most bits of a filter for a byte of text: a word, a pair and a total for six bytes, with 27 probes.
BITS_A_BYTE = 32
#: Tokens of a block of texts (up to twice as many), and bytes of text for each slice, where keys go to slices.
STRETCH, SLICE_TEXT = 1 << 20, 16 << 20
LEAST_SLICES = 16
CACHE_WORDS, BUFFER_TOKENS = 200_000, 1_000_000
#: Keys that are probed together.
CHUNK = 1 << 13


def mixed(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values (the finaliser of splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The upper half tells the first word, the lower one both."""
    one = mixed(first * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return (one & np.uint64(0xFFFFFFFF00000000)) | (mixed(one ^ second) >> np.uint64(32))


def total_keys(pairs: np.ndarray) -> np.ndarray:
    """The key of a first word's total, from any of its pairs."""
    one = pairs >> np.uint64(32)
    return (one << np.uint64(32)) | one


def first_keys(first: np.ndarray) -> np.ndarray:
    """The key of the total after a word."""
    return total_keys(pair_keys(first, first))


class Hasher:
    """Word hashes of texts; those of frequent words are kept, up to CACHE_WORDS."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def tokens(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all texts' words with one end each, and how many each text has."""
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        known, digest, flat, lengths = self.known, xxhash.xxh64_intdigest, [], []
        for text in texts:
            words = text.lower().split()
            for w in set(words).difference(known):
                known[w] = digest(w)
            flat += map(known.__getitem__, words)
            flat.append(END)
            lengths.append(len(words) + 1)
        return np.array(flat, np.uint64), np.array(lengths, np.int64)


def before(tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The token before each; START at the beginning of a text."""
    out = np.concatenate([np.array([START], np.uint64), tokens[:-1]])
    out[np.cumsum(lengths) - lengths] = START
    return out


def _portions(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(offset, texts) of about ``size`` bytes each."""
    part, held, at = [], 0, 0
    for i, t in enumerate(column.cast(pa.binary())):
        part.append(t.as_py() or b"")
        held += len(part[-1])
        if held >= size:
            yield at, part
            part, held, at = [], 0, i + 1
    if part:
        yield at, part


def counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(kind, key, n): kind 1 words with END, kind 2 pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, singles, pairs, held = Hasher(), [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, arrays in ((1, singles), (2, pairs)):
                keys, n = np.unique(np.concatenate(arrays), return_counts=True)
                for at in range(0, len(keys), 1 << 18):
                    part = slice(at, at + (1 << 18))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[part]), kind, np.int8)), pa.array(keys[part].view(np.int64)), pa.array(n[part].astype(np.int64))], names=["kind", "key", "n"])

        for batch in batches:
            for _, texts in _portions(batch.column(0)):
                tokens, lengths = hasher.tokens(texts)
                singles.append(tokens)
                pairs.append(pair_keys(before(tokens, lengths), tokens))
                held += len(tokens)
                if held > BUFFER_TOKENS:
                    yield from flush()
                    singles, pairs, held = [], [], 0
        if held:
            yield from flush()

    text = docs.select(F.col(text_col).cast("string").alias("t"))
    return text.mapInArrow(run, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


@dataclass
class LogFrequencyFilter:
    """Slices of one size, side by side in ``bits``; a key's slice is its remainder."""

    bits: np.ndarray  # bytes
    slice_bits: int
    slices: int
    probes: int

    @staticmethod
    def probing(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the probes of (key, level) begin and how far apart they are, in a cycle of 2^64."""
        h = mixed(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        return h, (h << np.uint64(32)) | np.uint64(1)

    @staticmethod
    def position(at: np.ndarray, slice_bits: int) -> np.ndarray:
        return ((at >> np.uint64(32)) * np.uint64(slice_bits)) >> np.uint64(32)

    @staticmethod
    def level_of(n: np.ndarray) -> np.ndarray:
        return np.minimum(MAX_LEVEL, 1 + np.floor(np.log2(np.maximum(n, 1)) + 1e-12).astype(np.int64))

    def holds(self, keys: np.ndarray, level: int) -> np.ndarray:
        """Numbers of the keys that are stored at a level; ``CHUNK`` keys at a time, so that what is reckoned stays near the core."""
        found = [np.empty(0, np.int64)]
        for lo in range(0, len(keys), CHUNK):
            part = keys[lo : lo + CHUNK]
            alive = np.arange(lo, lo + len(part))
            base = (part % np.uint64(self.slices)) * np.uint64(self.slice_bits)
            at, step = self.probing(part, level)
            for _ in range(self.probes):
                bit = self.position(at, self.slice_bits)
                bit += base
                byte = self.bits.take((bit >> np.uint64(3)).view(np.int64))
                bit &= np.uint64(7)
                hit = (byte >> bit.astype(np.uint8)) & 1
                at += step
                if not hit.all():
                    stay = np.flatnonzero(hit)
                    if not len(stay):
                        alive = stay
                        break
                    alive, base, at, step = alive[stay], base[stay], at[stay], step[stay]
            found.append(alive)
        return np.concatenate(found)

    def levels(self, keys: np.ndarray, cap: np.ndarray | None = None) -> np.ndarray:
        """The stored level of each key, 0 if none; now and then one too many. No key is above its ``cap``.

        Level 1 is asked first, so an absent key is asked once. The levels of a stored one have no gap, so
        the highest is found by halving.
        """
        low, high = np.zeros(len(keys), np.int64), np.full(len(keys), MAX_LEVEL) if cap is None else cap.copy()
        level = np.where(high > 0, 1, 0)
        while (open_ := np.flatnonzero(low < high)).size:
            for q in np.unique(level[open_]).tolist():
                mine = open_[level[open_] == q]
                found = np.zeros(len(mine), bool)
                found[self.holds(keys[mine], q)] = True
                low[mine[found]], high[mine[~found]] = q, q - 1
            level = np.minimum((low + high + 1) // 2, 2 * low + 1)
        return low

    def totals(self, keys: np.ndarray) -> np.ndarray:
        """PARTS * level + part (from 0) of each total, 0 if there is none."""
        level = self.levels(keys)
        out = PARTS * level
        for part in range(1, PARTS):
            for q in np.unique(level[level > 0]).tolist():
                mine = np.flatnonzero(level == q)
                out[mine[self.holds(keys[mine], AFTER + PARTS * q + part)]] = PARTS * q + part
        return out


def probes_for(distinct: int) -> int:
    """So many that a sixteenth of one of ``distinct`` absent keys is let through, however many are stored."""
    return max(PROBES, int(np.ceil(np.log2(max(2, distinct)))) + 4)


def put(flags: np.ndarray, keys: np.ndarray, level: int, probes: int) -> None:
    """Sets the bits of (key, level) in a slice, a byte for each bit."""
    at, step = LogFrequencyFilter.probing(keys, level)
    for _ in range(probes):
        flags[LogFrequencyFilter.position(at, len(flags))] = True
        at += step


def build_filter(kept: DataFrame, entries: int, distinct: int) -> tuple[DataFrame, int, int, int]:
    """(table of slices, slice_bits, slices, probes) of the filter of ``kept`` (kind, key, level).

    Kinds 1 and 2 are stored at levels 1 to ``level``; kind 3, totals, whose ``level``
    is PARTS * level + part, also at the part. ``entries`` are stored pairs, in all.
    The table has a row for each slice: slice and bits, of which half are set.
    """
    probes = probes_for(distinct)
    bits = int(entries * probes / np.log(2)) + 64
    slices = SLICES  # a power of two, so that signed keys have the slice of unsigned ones
    while bits > slices * SLICE_BITS:
        slices *= 2
    slice_bits = max(64, -(-bits // slices // 8) * 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        for batch in batches:
            of, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keys, levels = batch.column(2).to_numpy().view(np.uint64), batch.column(3).to_numpy()
            for s in np.unique(of).tolist():
                flags = held.setdefault(s, np.zeros(slice_bits, bool))
                mine = of == s
                own, total = keys[mine], kinds[mine] == 3
                code = levels[mine]
                top = np.where(total, code // PARTS, code)
                for level in range(1, int(top.max()) + 1):
                    put(flags, own[top >= level], level, probes)
                for c in np.unique(code[total & (code % PARTS > 0)]).tolist():
                    put(flags, own[total & (code == c)], AFTER + c, probes)
        for s, flags in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], names=["slice", "bits"])

    dealt = kept.select(F.pmod("key", F.lit(slices)).cast("int").alias("slice"), F.col("kind").cast("int").alias("kind"), "key", F.col("level").cast("int").alias("level"))
    made = dealt.repartition(slices, "slice").mapInArrow(run, "slice int, bits binary")
    return stored(made, "filter"), slice_bits, slices, probes


def mistakes(probes: int, distinct: int, count: float) -> float:
    """Counts of pairs that are expected to be read by mistake after a word: half of a filter's bits are set, by its size."""
    return float(0.5**probes * distinct * count)


@dataclass
class Model:
    """Figures that fit a broadcast; ``filter`` and the head are there for little text only."""

    train_tokens: int
    distinct: int
    head_keys: np.ndarray
    head_n: np.ndarray
    word_means: np.ndarray  # what a level stands for
    pair_means: np.ndarray
    mistaken: float  # pairs that the filter is expected to read by mistake for each first word, times their count
    filter: LogFrequencyFilter | None = None
    asked: dict[int, np.ndarray] = field(default_factory=dict)  # what a worker has read of the head

    def base_log(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + ALPHA) / (self.train_tokens + ALPHA * (self.distinct + 1)))

    def exact(self, keys: np.ndarray) -> np.ndarray:
        """Counts of words in the head, -1 for others."""
        if not len(self.head_keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.head_keys, keys), len(self.head_keys) - 1)
        return np.where(self.head_keys[at] == keys, self.head_n[at], -1)

    def logs(self, words: np.ndarray, pairs: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """log10 of the probability of each token, from the levels of its word and pair and the total before it."""
        single = (self.word_means[words] + ALPHA) / (self.train_tokens + ALPHA * (self.distinct + 1))
        pairs = np.minimum(pairs, np.minimum(words, totals // PARTS))  # a pair is no more frequent than its words
        code = totals - PARTS
        total = np.where(totals > 0, 2.0 ** (code / PARTS), 0.0)
        return np.log10((self.pair_means[pairs] + PRIOR * single) / (total + self.mistaken + PRIOR))

    def read(self, keys: np.ndarray, kind: int) -> np.ndarray:
        """Levels of words (kind 1), or totals after them (kind 3). Those of frequent words are asked once in a worker."""
        ask = (lambda k: self.filter.levels(k)) if kind == 1 else (lambda k: self.filter.totals(first_keys(k)))
        if not len(self.head_keys):
            return ask(keys)
        known = self.asked.setdefault(kind, np.full(len(self.head_keys), -1, np.int16))
        at = np.minimum(np.searchsorted(self.head_keys, keys), len(self.head_keys) - 1)
        frequent = self.head_keys[at] == keys
        out = np.where(frequent, known[at], -1).astype(np.int64)
        new = np.flatnonzero(out < 0)
        out[new] = ask(keys[new])
        known[at[new[frequent[new]]]] = out[new[frequent[new]]]
        return out

    def token_logs(self, tokens: np.ndarray, lengths: np.ndarray, distinct: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """``logs`` of texts' tokens, by probes of the broadcast filter; ``distinct``: the distinct tokens and where they stand, if known."""
        words, of_word = distinct or np.unique(tokens, return_inverse=True)
        level = self.read(words, 1)[of_word]
        total = self.read(np.append(words, np.uint64(START)), 3)
        of_first = np.concatenate([[len(words)], of_word[:-1]])
        of_first[np.cumsum(lengths) - lengths] = len(words)
        total = total[of_first]
        pairs, first_at, of_pair = np.unique(pair_keys(before(tokens, lengths), tokens), return_index=True, return_inverse=True)
        cap = np.minimum(level, total // PARTS)[first_at]  # a pair is no more frequent than its words
        return self.logs(level, self.filter.levels(pairs, cap)[of_pair], total)


def train(docs: DataFrame, text_col: str = "text", head: int = HEAD) -> tuple[Model, DataFrame, DataFrame]:
    """The model of all rows of ``docs`` with its filter, the full table (key, n) of word counts, and the filter's table of slices."""
    kept = stored(counts(docs, text_col).withColumn("level", F.least(F.lit(MAX_LEVEL), F.lit(1) + F.floor(F.log2("n") + 1e-12).cast("int"))), "counts")
    release(docs.sparkSession)
    words = kept.where("kind = 1").select("key", "n")
    sizes = {(r["kind"], r["level"]): (r["c"], r["s"]) for r in kept.groupBy("kind", "level").agg(F.count("*").alias("c"), F.sum("n").alias("s")).collect()}  # 2 * MAX_LEVEL rows at most
    total, distinct = (sum(v[k] for (kind, _), v in sizes.items() if kind == 1) for k in (1, 0))
    means = np.zeros((3, MAX_LEVEL + 1))
    for (kind, level), (c, s) in sizes.items():
        means[kind, level] = s / c

    mean = F.element_at(F.array(*(F.lit(float(m)) for m in means[2, 1:])), F.col("level"))
    one = F.shiftrightunsigned("key", 32)
    sums = kept.where("kind = 2").groupBy(F.shiftleft(one, 32).bitwiseOR(one).alias("key")).agg(F.log2(F.sum(mean)).alias("log"))
    totals = stored(sums.select(F.lit(3).alias("kind"), "key", (F.lit(PARTS) + F.ceil(F.col("log") * PARTS - 1e-9)).cast("int").alias("level")), "totals")
    release(docs.sparkSession)
    more = totals.agg(F.coalesce(F.sum(F.expr(f"level div {PARTS} + 1")), F.lit(0))).first()[0]
    entries = sum(c * q for (_, q), (c, _) in sizes.items()) + more
    table, *shape = build_filter(kept.select("kind", "key", "level").union(totals), entries, distinct)
    release(docs.sparkSession)
    slice_bits, slices, probes = shape

    # The head: all words, or those above a count that leaves at most ``head`` of them.
    floor = 1
    if distinct > head:
        steps = words.groupBy(F.least(F.col("n"), F.lit(1 << 20)).alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("n")).collect()
        held, floor = 0, (1 << 20) + 1
        for r in steps:
            if held + r["c"] > head:
                break
            held, floor = held + r["c"], r["n"]
    top = words.where(F.col("n") >= floor).toArrow()
    keys, n = top["key"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(keys)
    model = Model(int(total), int(distinct), keys[order], n[order], means[1], means[2], mistakes(probes, distinct, means[2, 1]))
    bits = np.zeros(slices * slice_bits // 8, np.uint8)
    for row in table.coalesce(4).toLocalIterator():  # a quarter at a time
        bits[row["slice"] * slice_bits // 8 :][: slice_bits // 8] = np.frombuffer(row["bits"], np.uint8)
    model.filter = LogFrequencyFilter(bits, slice_bits, slices, probes)
    return model, words, table


def held_out(id_col: str = "doc_id") -> Column:
    return crc_bucket(id_col, 10) == 0


def score(docs: DataFrame, model: Model, words: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, n_known, base_score, score) of every row; null text is empty, so one end is its only token."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType
    names = ["row", "id", "n_tokens", "n_known", "base", "score", "key", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, hasher = shared.value, Hasher()
        for batch in batches:
            first, id_type = batch.column(0).to_numpy(), batch.schema.field(1).type
            for at, texts in _portions(batch.column(2)):
                tokens, lengths = hasher.tokens(texts)
                starts = np.cumsum(lengths) - lengths
                distinct, where = np.unique(tokens, return_inverse=True)
                n = m.exact(distinct)
                log = np.where(n >= 0, m.base_log(np.maximum(n, 0)), 0.0)[where]
                rows = first[at : at + len(texts)]
                logs = pa.array(np.add.reduceat(m.token_logs(tokens, lengths, (distinct, where)), starts))
                yield pa.RecordBatch.from_arrays([
                    pa.array(rows), batch.column(1).slice(at, len(texts)), pa.array(lengths), pa.array(np.add.reduceat((n > 0)[where].astype(np.int64), starts)),
                    pa.array(np.add.reduceat(log, starts)), logs, pa.nulls(len(texts), pa.int64()), pa.nulls(len(texts), pa.int64()),
                ], names=names)
                open_ = np.flatnonzero((n < 0)[where])
                if len(open_):
                    doc = np.searchsorted(starts, open_, side="right") - 1
                    both, times = np.unique(doc * len(distinct) + where[open_], return_counts=True)
                    size = len(both)
                    none = [pa.nulls(size, t) for t in (id_type, pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                    yield pa.RecordBatch.from_arrays([pa.array(rows[both // len(distinct)]), *none, pa.array(distinct[both % len(distinct)].view(np.int64)), pa.array(times.astype(np.int64))], names=names)

    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    made = stored(texts.mapInArrow(run, f"row long, id {kind.simpleString()}, n_tokens long, n_known long, base double, score double, key long, n long"), "scores")
    rest = made.where("key is not null").select("row", "key", F.col("n").alias("times")).join(words, "key", "left")
    log = F.log10((F.coalesce("n", F.lit(0)) + F.lit(ALPHA)) / F.lit(model.train_tokens + ALPHA * (model.distinct + 1)))
    added = rest.groupBy("row").agg(F.sum(F.col("times") * log).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"))
    both = made.where("key is null").drop("key", "n").join(added, "row", "left")
    return both.select(F.col("id").alias(id_col), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")


def packed(values: np.ndarray, ascending: bool = False) -> bytes:
    """Whole numbers, none negative, by planes of bytes; ascending ones by their steps."""
    held = values.astype(np.uint64)
    if ascending and len(held):
        held = np.concatenate([held[:1], np.diff(held)])
    width = (int(held.max(initial=0)).bit_length() + 7) // 8
    planes = np.ascontiguousarray(held.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return np.array([len(held), width], np.uint32).tobytes() + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, ascending: bool = False) -> np.ndarray:
    n, width = np.frombuffer(data, np.uint32, 2).tolist()
    out = np.zeros((n, 8), np.uint8)
    if n * width:
        out[:, :width] = np.frombuffer(pa.decompress(data[8:], n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n).T
    out = out.view(np.uint64)[:, 0]
    return np.cumsum(out, dtype=np.uint64) if ascending else out


def dealt(keys: np.ndarray, slices: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order of keys by slice, ascending in each, and (slice, from, to) of those that get any."""
    order = np.argsort(keys, kind="stable")
    of = (keys[order] & np.uint64(slices - 1)).astype(np.uint32)
    by = np.argsort(of, kind="stable")
    ends = np.searchsorted(of[by], np.arange(slices + 1)).tolist()
    return order[by], [(s, lo, hi) for s, (lo, hi) in enumerate(zip(ends, ends[1:])) if hi > lo]


# Rows of the exchange between blocks and slices, by kind: 0 a block's tokens, 1 words, 2 pairs and 3 totals
# that it asks for and the answers, 4 pairs of a slice by first word and level, 5 figures of a slice.
_EXCHANGE = "block long, slice int, kind int, keys binary, n binary"
_ROWS = pa.schema([("block", pa.int64()), ("slice", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("n", pa.binary())])


def blocks(docs: DataFrame, slices: int, id_col: str, text_col: str) -> DataFrame:
    """The rows that blocks of texts send. A row of kind 0 holds a block's words, its tokens as places among them, and its pieces of texts: rows, ids, sizes; ``n`` ends with the token before each piece."""
    stretch, kind = STRETCH, docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, size = Hasher(), [], 0
        row = block = TaskContext.get().partitionId() << 32
        schema = None

        def flush() -> Iterator[pa.RecordBatch]:
            tokens, earlier, learned = (np.concatenate(x) for x in zip(*(h[:3] for h in held)))
            rows, sizes, ids = (np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held]), pa.concat_arrays([h[5] for h in held]))
            held.clear()
            heads = earlier[np.cumsum(sizes) - sizes]
            words, places = np.unique(np.concatenate([tokens, heads]), return_inverse=True)
            places = places.astype(np.uint32)
            out = [{"block": block, "slice": -1, "kind": 0, "keys": packed(words, True), "n": packed(places), "rows": rows, "ids": ids, "sizes": sizes}]
            pairs, of = np.unique(pair_keys(earlier, tokens), return_inverse=True)
            n_words, n_pairs = (np.bincount(at[learned], minlength=len(x)) for at, x in ((places[: len(tokens)], words), (of, pairs)))
            del tokens, earlier, learned, places, of
            for kind, keys, n in ((1, words, n_words), (2, pairs, n_pairs), (3, first_keys(words), None)):
                order, parts = dealt(keys, slices)
                for s, lo, hi in parts:
                    mine = order[lo:hi]
                    sent = keys[mine] & np.uint64(0xFFFFFFFF) if kind == 3 else keys[mine]  # both halves of a total's key are one
                    out.append({"block": block, "slice": s, "kind": kind, "keys": packed(sent, True), "n": None if n is None else packed(n[mine])})
            for lo in range(0, len(out), 1024):
                yield pa.RecordBatch.from_pylist(out[lo : lo + 1024], schema=schema)

        for batch in batches:
            ids, learns = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            schema = pa.schema([*_ROWS, ("rows", pa.list_(pa.int64())), ("ids", pa.list_(ids.type)), ("sizes", pa.list_(pa.int64()))])
            for at, texts in _portions(batch.column(2)):
                tokens, lengths = hasher.tokens(texts)
                earlier, ends = before(tokens, lengths), np.cumsum(lengths)
                learned = np.repeat(learns[at : at + len(texts)], lengths)
                for lo in range(0, len(tokens), stretch):
                    hi = min(lo + stretch, len(tokens))
                    first, last = np.searchsorted(ends, [lo, hi - 1], side="right").tolist()
                    cuts = np.minimum(ends[first : last + 1], hi)
                    held.append((tokens[lo:hi], earlier[lo:hi], learned[lo:hi], row + np.arange(first, last + 1), np.diff(cuts, prepend=lo), ids.slice(at + first, last + 1 - first)))
                    size += hi - lo
                    if size >= stretch:
                        yield from flush()
                        size, block = 0, block + 1
                row += len(texts)
        if held:
            yield from flush()

    texts = docs.select(F.col(id_col).alias("id"), (~held_out(id_col)).alias("learn"), F.col(text_col).cast("string").alias("t"))
    return stored(file_batches(texts).mapInArrow(run, f"{_EXCHANGE}, rows array<long>, ids array<{kind}>, sizes array<long>"), "blocks")


def at_slices(asked: DataFrame, slices: int, answer: Callable[[int, list[dict]], Iterator[dict]], label: str) -> DataFrame:
    """What ``answer`` makes of all rows of a slice, a slice at a time; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, rows = None, []

        def made() -> Iterator[pa.RecordBatch]:
            out = list(answer(here, rows))
            for lo in range(0, len(out), 1024):
                yield pa.RecordBatch.from_pylist(out[lo : lo + 1024], schema=_ROWS)

        for batch in batches:
            for row in batch.to_pylist():
                if row["slice"] != here:
                    yield from made() if rows else ()
                    here, rows = row["slice"], []
                rows.append(row)
        yield from made() if rows else ()

    mine = asked.select("block", "slice", "kind", "keys", "n").repartitionById(slices, "slice").sortWithinPartitions("slice")
    out = stored(file_batches(mine).mapInArrow(run, _EXCHANGE), label)
    release(asked.sparkSession)
    return out


def summed(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of rows, their summed counts, the place of every key among them, and where the rows begin and end."""
    keys = [unpacked(r["keys"], True) for r in rows]
    ends = np.cumsum([0, *map(len, keys)])
    keys = np.concatenate(keys)
    distinct, of = np.unique(keys, return_inverse=True)
    n = np.zeros(len(distinct), np.int64)
    for r, lo, hi in zip(rows, ends, ends[1:]):
        if r["n"] is not None:
            n[of[lo:hi]] += unpacked(r["n"]).view(np.int64)  # a row that counts holds a key once
    return distinct, n, of, ends


def answers(rows: list[dict], found: np.ndarray, of: np.ndarray, ends: np.ndarray) -> Iterator[dict]:
    for r, lo, hi in zip(rows, ends, ends[1:]):
        yield {"block": r["block"], "slice": r["slice"], "kind": r["kind"], "n": packed(found[of[lo:hi]])}


def figures(slice_: int, level: np.ndarray, n: np.ndarray) -> dict:
    """How many keys each level has, and how many occurrences they have."""
    return {"block": -1, "slice": slice_, "kind": 5, "keys": packed(np.bincount(level, minlength=MAX_LEVEL + 1)), "n": packed(np.bincount(level, n, MAX_LEVEL + 1))}


def level_figures(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, occurrences, mean count) of each level; a small row comes from each slice."""
    c, s = np.zeros((2, MAX_LEVEL + 1), np.int64)
    for r in rows.where("kind = 5").select("keys", "n").toLocalIterator():
        c += unpacked(r["keys"]).view(np.int64)
        s += unpacked(r["n"]).view(np.int64)
    return c, s, s / np.maximum(c, 1)


def one_slice(entries: int, probes: int) -> np.ndarray:
    """The empty bits of a slice of ``entries``, of which they set half."""
    return np.zeros(max(64, -(-int(entries * probes / np.log(2)) // 8) * 8), bool)


def as_filter(flags: np.ndarray, probes: int) -> LogFrequencyFilter:
    return LogFrequencyFilter(np.packbits(flags, bitorder="little"), len(flags), 1, probes)


def scores_by_slices(docs: DataFrame, size: int, id_col: str, text_col: str) -> tuple[int, DataFrame]:
    """(train_tokens, scores as ``score`` gives them) where the filter may be too large for a broadcast; ``size``: bytes of text."""
    slices = LEAST_SLICES  # a power of two
    while size > slices * SLICE_TEXT:
        slices *= 2
    asked = blocks(docs, slices, id_col, text_col)

    def count_words(here: int, rows: list[dict]) -> Iterator[dict]:
        _, n, of, ends = summed(rows)
        yield figures(here, LogFrequencyFilter.level_of(n)[n > 0], n[n > 0])
        yield from answers(rows, n, of, ends)

    words = at_slices(asked.where("kind = 1"), slices, count_words, "words")
    c, s, word_means = level_figures(words)
    distinct, total = int(c.sum()), int(s.sum())
    probes = probes_for(distinct)

    def read_pairs(here: int, rows: list[dict]) -> Iterator[dict]:
        keys, n, of, ends = summed(rows)
        known, level = keys[n > 0], LogFrequencyFilter.level_of(n)[n > 0]
        yield figures(here, level, n[n > 0])
        flags = one_slice(int(level.sum()), probes)
        for q in range(1, int(level.max(initial=0)) + 1):
            put(flags, known[level >= q], q, probes)
        yield from answers(rows, as_filter(flags, probes).levels(keys), of, ends)
        firsts, times = np.unique((known >> np.uint64(32)) << np.uint64(6) | level.astype(np.uint64), return_counts=True)
        to = ((firsts >> np.uint64(6)) & np.uint64(slices - 1)).astype(np.int64)
        for s in np.unique(to).tolist():
            yield {"block": -1, "slice": s, "kind": 4, "keys": packed(firsts[to == s], True), "n": packed(times[to == s])}

    pairs = at_slices(asked.where("kind = 2"), slices, read_pairs, "pairs")
    _, _, pair_means = level_figures(pairs)

    def read_totals(here: int, rows: list[dict]) -> Iterator[dict]:
        asking, made = [r for r in rows if r["kind"] == 3], [r for r in rows if r["kind"] == 4]
        known, code = np.empty(0, np.uint64), np.empty(0, np.int64)
        if made:
            firsts, times, _, _ = summed(made)
            one, of = np.unique(firsts >> np.uint64(6), return_inverse=True)
            sums = np.bincount(of, times * pair_means[(firsts & np.uint64(63)).astype(np.int64)])
            known, code = (one << np.uint64(32)) | one, PARTS + np.ceil(np.log2(sums) * PARTS - 1e-9).astype(np.int64)
        flags = one_slice(int((code // PARTS + 1).sum()), probes)
        for q in range(1, int(code.max(initial=0)) // PARTS + 1):
            put(flags, known[code // PARTS >= q], q, probes)
        for x in np.unique(code[code % PARTS > 0]).tolist():
            put(flags, known[code == x], AFTER + x, probes)
        if asking:
            keys, _, of, ends = summed(asking)
            yield from answers(asking, as_filter(flags, probes).totals((keys << np.uint64(32)) | keys), of, ends)

    totals = at_slices(asked.where("kind = 3").select("block", "slice", "kind", "keys", "n").union(pairs.where("kind = 4")), slices, read_totals, "totals")
    none = np.empty(0, np.int64)
    model = Model(total, distinct, none.view(np.uint64), none, word_means, pair_means, mistakes(probes, distinct, pair_means[1]))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, got = None, {}

        def made() -> pa.RecordBatch:
            place = unpacked(head["n"].as_py()).astype(np.int64)
            words, sizes = unpacked(head["keys"].as_py(), True), head["sizes"].values.to_numpy()
            n_tokens, starts = int(sizes.sum()), np.cumsum(sizes) - sizes
            place, first = place[:n_tokens], place[n_tokens:]
            prior = np.concatenate([first[:1], place[:-1]])
            prior[starts] = first
            pairs, of = np.unique(pair_keys(words[prior], words[place]), return_inverse=True)

            def answered(kind: int, keys: np.ndarray) -> np.ndarray:
                order, parts = dealt(keys, slices)
                out = np.empty(len(keys), np.int64)
                out[order] = np.concatenate([unpacked(got[kind, s]) for s, _, _ in parts])
                return out

            n = answered(1, words)
            level = np.where(n > 0, LogFrequencyFilter.level_of(n), 0)
            logs = model.logs(level[place], answered(2, pairs)[of], answered(3, first_keys(words))[prior])
            return pa.RecordBatch.from_arrays([
                head["rows"].values, head["ids"].values, pa.array(sizes), pa.array(np.add.reduceat((n > 0)[place].astype(np.int64), starts)),
                pa.array(np.add.reduceat(model.base_log(n)[place], starts)), pa.array(np.add.reduceat(logs, starts)),
            ], names=["row", "id", "n_tokens", "n_known", "base", "score"])

        for batch in batches:
            for i, (kind, s) in enumerate(zip(batch.column(2).to_pylist(), batch.column(1).to_pylist())):
                if kind:
                    got[kind, s] = batch.column(4)[i].as_py()
                else:  # a block begins
                    if head:
                        yield made()
                    head, got = {c: batch.column(c)[i] for c in ("keys", "n", "rows", "ids", "sizes")}, {}
        if head:
            yield made()

    every = asked.where("kind = 0")
    for found in (words, pairs, totals):
        every = every.unionByName(found.where("kind < 4"), allowMissingColumns=True)
    back = file_batches(every.repartition("block").sortWithinPartitions("block", "kind"))
    kind = docs.schema[id_col].dataType.simpleString()
    parts = back.mapInArrow(sums, f"row long, id {kind}, n_tokens long, n_known long, base double, score double")
    total_of = {"n_tokens": "n_tokens", "n_known": "n_known", "base": "base_score", "score": "score"}
    return total, parts.groupBy("row").agg(F.first("id").alias(id_col), *(F.sum(c).alias(name) for c, name in total_of.items())).drop("row")


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, head: int = HEAD) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score), learned from rows that are not held out.

    An empty training set knows no word: every token has the same base
    probability. Repeated rows stay and count each. ``max_bits`` decides on the
    way to the filter only: scores are the same by broadcast and by slices.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).first()[0]
    if size * BITS_A_BYTE > max_bits:
        n, found = scores_by_slices(docs, size, id_col, text_col)
    else:
        model, words, _ = train(docs.where(~held_out(id_col)), text_col, head)
        n, found = model.train_tokens, score(docs, model, words, id_col, text_col)
    return found.select(id_col, held_out(id_col).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
