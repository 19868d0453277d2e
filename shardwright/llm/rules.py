"""Quality rules: learned decision lists over statistics of a text.

One pass of Arrow batches counts every whole text; the counts are stored without
the text. Ratios of these counts, Spark expressions, are what rules speak about. From
labelled rows sequential covering learns an ordered list: a rule for either label grows
condition by condition (feature above or at most a threshold) by information gain on two
thirds of the rows, loses last conditions that don't help on the other third, and is taken
if it is nearly always right on both (one for the rarer label first); the rows it covers go, and
the next rule sees the rest.
The list becomes one conditional expression of Spark, so verdicts are made by the engine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardwright.llm.common import stored

WINDOW = 5
#: Labelled rows that a list is learned from, at most; cuts of one feature that a condition chooses from.
TRAIN_ROWS, CUTS = 20_000, 64
MAX_RULES, MAX_CONDITIONS = 24, 4
#: A rule is taken if so large a share of what it covers has its label, and it covers so many rows.
MIN_PRECISION, MIN_COVER = 0.95, 3
#: Bytes of texts that are counted together.
PORTION = 1 << 20

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_capitals", "n_digits", "n_marks"]
#: Features as expressions over the counts.
FEATURES = {
    "words": "n_words",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "marks": "n_marks / greatest(n_words, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "distinct": "n_distinct / greatest(n_words, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
}

SPACES = b" \t\n\v\f\r"


def _flags(*groups: bytes) -> np.ndarray:
    """A row of 256 zeros and ones for each group of bytes."""
    out = np.zeros((len(groups), 256), np.uint8)
    for row, group in zip(out, groups):
        row[list(group)] = 1
    return out


#: Spaces, continuation bytes, symbols, A-Z, 0-9, and marks of punctuation.
CLASSES = _flags(SPACES, bytes(range(0x80, 0xC0)), b"#*$%&|<>", bytes(range(65, 91)), b"0123456789", b".,;:!?")


def repeated(ids: np.ndarray, lengths: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each text the words inside windows that stand in it twice or more; ``ids`` are its words' numbers, exact."""
    n, ends = len(ids), np.cumsum(lengths)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    places = np.flatnonzero(np.arange(n) + window <= ends[doc]) if n else np.empty(0, np.int64)
    grams = ids[places]
    for k in range(1, window):
        grams = np.unique(grams * (int(ids.max()) + 1 if n else 1) + ids[places + k], return_inverse=True)[1]
    _, of, times = np.unique(doc[places] * (len(grams) + 1) + grams, return_inverse=True, return_counts=True)
    step = np.zeros(n + window + 1, np.int64)
    hit = places[times[of] > 1] if len(places) else places
    np.add.at(step, hit, 1)
    np.add.at(step, hit + window, -1)
    return np.bincount(doc, np.cumsum(step)[:n] > 0, len(lengths)).astype(np.int64)


def counted(texts: list[bytes]) -> list[np.ndarray]:
    """``COUNTS`` of the texts."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)  # each text ends with a byte that is no word's
    sizes = np.array([len(t) + 1 for t in texts])
    starts = np.cumsum(sizes) - sizes
    per = [np.add.reduceat(row[data], starts, dtype=np.int64) for row in CLASSES]
    known: dict[bytes, int] = {}
    flat, lengths, distinct, lines, doubles = [], [], [], [], []
    for text in texts:
        words = text.split()
        own = set(words)
        for w in own.difference(known):
            known[w] = len(known)
        flat += map(known.__getitem__, words)
        lengths.append(len(words))
        distinct.append(len(own))
        rows = [row for row in text.split(b"\n") if row and not row.isspace()]
        lines.append(len(rows))
        doubles.append(len(rows) - len(set(rows)))
    n = np.array(lengths, np.int64)
    letters = sizes - per[0] - per[1]
    return [n, letters, per[2], np.array(doubles), repeated(np.array(flat, np.int64), n), np.array(lines), np.array(distinct), per[3], per[4], per[5]]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ``COUNTS``) of every row. Words are ``[^\\x20\\x09-\\x0D]+``; a null text has none. Repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(1).cast(pa.binary())]
            at = 0
            while at < len(texts):
                size, to = 0, at
                while to < len(texts) and size < PORTION:
                    size += len(texts[to])
                    to += 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), *(pa.array(x.astype(np.int64)) for x in counted(texts[at:to]))], names=["id", *COUNTS])
                at = to

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    made = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS))
    return made.withColumnRenamed("id", id_col)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def mask(self, x: np.ndarray) -> np.ndarray:
        column = x[:, list(FEATURES).index(self.feature)]
        return column > self.cut if self.above else column <= self.cut

    def sql(self) -> str:
        return f"{FEATURES[self.feature]} {'>' if self.above else '<='} {self.cut!r}D"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    label: int

    def mask(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for c in self.conditions:
            out &= c.mask(x)
        return out


@dataclass(frozen=True)
class DecisionList:
    """The first rule that holds gives the label; ``default`` where none does."""

    rules: tuple[Rule, ...]
    default: int

    def column(self) -> Column:
        found = F
        for r in self.rules:
            found = found.when(F.expr(" AND ".join(c.sql() for c in r.conditions)), F.lit(r.label))
        return found.otherwise(F.lit(self.default)) if self.rules else F.lit(self.default)

    def labels(self, x: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(x), self.default), np.ones(len(x), bool)
        for r in self.rules:
            mine = open_ & r.mask(x)
            out[mine], open_ = r.label, open_ & ~mine
        return out

    def text(self) -> str:
        lines = [f"if {' and '.join(f'{c.feature} {'>' if c.above else '<='} {c.cut:.4g}' for c in r.conditions)}: {r.label}" for r in self.rules]
        return "\n".join([*lines, f"else: {self.default}"])


def cuts_of(column: np.ndarray) -> np.ndarray:
    """Midpoints between neighbouring values, at ``CUTS`` places of even rank if there are more."""
    values = np.unique(column)
    middle = (values[1:] + values[:-1]) / 2
    ranks = np.unique(np.searchsorted(values, np.quantile(column, np.linspace(0, 1, CUTS), method="nearest")))
    return middle if len(middle) <= CUTS else middle[np.minimum(ranks, len(middle) - 1)]


def grown(x: np.ndarray, right: np.ndarray) -> tuple[Condition, ...]:
    """Conditions that each bring the largest gain of information about ``right``; ties go to the first feature, then the smaller cut."""
    took: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(took) < MAX_CONDITIONS and right[inside].any() and not right[inside].all():
        p0, n0 = right[inside].sum(), inside.sum()
        best, gain = None, 1e-9
        for k, feature in enumerate(FEATURES):
            column, hit = x[inside, k], right[inside]
            order = np.argsort(column, kind="stable")
            ranked, sums = column[order], np.concatenate([[0], np.cumsum(hit[order])])
            cuts = cuts_of(column)
            below = np.searchsorted(ranked, cuts, side="right")
            for above, n, p in ((False, below, sums[below]), (True, n0 - below, p0 - sums[below])):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gains = np.where(p > 0, p * (np.log2(p / n) - np.log2(p0 / n0)), 0.0)
                if len(cuts) and gains.max() > gain:
                    best, gain = Condition(feature, above, float(cuts[gains.argmax()])), gains.max()
        if best is None:
            break
        took.append(best)
        inside &= best.mask(x)
    return tuple(took)


def learn(x: np.ndarray, y: np.ndarray) -> DecisionList:
    """A list from rows of features and labels 0 or 1. Every third row prunes. One label only, or none: no rule, and that label (1)."""
    rules: list[Rule] = []
    prune = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), bool)
    while len(rules) < MAX_RULES and len(np.unique(y[left])) == 2:
        found = []
        for label in (0, 1):
            grow_on, test_on = left & ~prune, left & prune
            whole = grown(x[grow_on], y[grow_on] == label)
            worth = []
            for n in range(len(whole), 0, -1):
                mine = Rule(whole[:n], label).mask(x[test_on])
                p = (y[test_on][mine] == label).sum()
                worth.append(((2 * p - mine.sum()) / max(1, mine.sum()), -n))
            if worth:
                rule = Rule(whole[: -max(worth)[1]], label)
                mine, checked = left & rule.mask(x), test_on & rule.mask(x)
                sure = min((y[m] == label).mean() if m.any() else 1.0 for m in (mine, checked))
                if sure >= MIN_PRECISION and mine.sum() >= MIN_COVER and not mine[left].all():
                    found.append(rule)
        if not found:
            break
        rarer = int(y[left].mean() < 0.5)
        rule = next((r for r in found if r.label == rarer), found[0])  # so that the default is the common label
        rules.append(rule)
        left &= ~rule.mask(x)
    rest = y[left]
    return DecisionList(tuple(rules), int(rest.mean() >= 0.5) if len(rest) else 1)


def base_failed() -> Column:
    return F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")


def train(counts: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", rows: int = TRAIN_ROWS) -> DecisionList:
    """The list of at most ``rows`` labelled rows of ``counts`` that pass the base rules, the first in order of a hash of their id.

    Null labels and ids take no part; of several labels of one id the mean counts, rows that share a labelled id count each.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("_y"))
    used = counts.where(~base_failed()).join(known, F.col(id_col) == F.col("_id"))
    order = [F.xxhash64("_id"), F.col("_id"), *(F.col(c) for c in COUNTS)]
    got = used.orderBy(*order).limit(rows).select("_y", *(F.expr(e).cast("double").alias(f) for f, e in FEATURES.items())).toArrow()  # at most ``rows``
    x = np.stack([got[f].to_numpy() for f in FEATURES], axis=1)
    return learn(x, got["_y"].to_numpy())


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[DataFrame, DecisionList]:
    """(id_col, ``COUNTS``, base_failed, kept) of every row, and the list; null and empty texts have no words, so they fail the base rules.

    Without labels everything that passes the base rules is kept. Extra columns of ``docs`` take no part.
    """
    counts = stored(statistics(docs, id_col, text_col), "counts")
    rules = train(counts, labels, id_col, label_col)
    return counts.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (rules.column() == 1)), rules


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept); see ``judged``."""
    return judged(docs, labels, id_col, text_col)[0].select(id_col, *COUNTS[:5], "base_failed", "kept")
