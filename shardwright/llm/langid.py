"""Language identification of mixed-language text.

A text's words (runs of letters) get a score for every candidate language.
Script ranges narrow the candidates: a language is one for a word only if its
training text uses the word's script. Viterbi over the word scores, with a
penalty for each switch, labels spans; the document's language is the one with
the most letters. Scores are naive Bayes over a word's character n-grams and
the word itself, hashed into a table of fixed size for each language, so the
model grows with the number of languages, all of which it keeps, and not with the corpus. Counting runs over all
training rows in tasks; what meets in the shuffle is a row for each language
and table cell.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardwright.llm.common import crc_bucket, cut
from shardwright.session import file_batches

CELLS = 1 << 15
#: The broadcast model's bound (8192 languages of CELLS scores). More raise an error; none is left out.
MAX_MODEL_BYTES = 1 << 30
SWITCH_PENALTY = 6.0
#: A script belongs to a language if so many of its training letters are in it.
SCRIPT_SHARE = 0.01
#: Scores that a worker keeps (words times languages), words of training counted before they are folded in, words folded in at once, and scores aligned at once.
CACHE_SCORES, CACHE_WORDS, FOLD_WORDS, PATH_SCORES = 2_000_000, 200_000, 8192, 6_000_000
#: Characters of text labelled at once, at most.
PORTION = 4 << 20

# First code points of script ranges, from Unicode's blocks.
SCRIPT_RANGES = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0780, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"),
    (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"),
    (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"),
    (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"),
    (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3130, "Hangul"), (0x3190, "Other"),
    (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD800, "Other"), (0xF900, "Han"),
    (0xFB00, "Latin"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFE70, "Arabic"), (0xFF00, "Other"),
    (0x20000, "Han"),
]
_STARTS = [a for a, _ in SCRIPT_RANGES]
_SCRIPTS = sorted({s for _, s in SCRIPT_RANGES})

ASCII_WORDS = bytes(c | 0x20 if 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A else 0x20 for c in range(128)) + bytes(128)


def _members(first: str) -> str:
    """The code points of a general category, as ranges of a character class."""
    runs: list[list[int]] = []
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == first:
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return "".join(f"\\U{lo:08x}-\\U{hi:08x}" for lo, hi in runs)


@lru_cache(None)
def letters() -> re.Pattern:
    """A word: a letter and what follows of letters and marks (such as vowel signs)."""
    own = _members("L")
    return re.compile(f"[{own}][{own}{_members('M')}]*")


def words_of(text: str | None) -> list[str]:
    """Lower-case words of letters and their marks; figures, also raised, ringed and Roman ones, are none."""
    if not text:
        return []
    if text.isascii():
        return text.encode().translate(ASCII_WORDS).decode().split()
    return letters().findall(text.lower())


def script_of(word: str) -> str:
    """The script of most of a word's letters; the first one on a tie."""
    if max(word) < "\u0370":
        return "Latin"
    return Counter(SCRIPT_RANGES[bisect_right(_STARTS, ord(c)) - 1][1] for c in word).most_common(1)[0][0]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, cell) of every character n-gram of 2 to 4 bytes with edge marks, and of the words themselves."""
    marked = [f"^{w}$".encode() for w in words]
    lengths = np.array([len(w) for w in marked], np.int64)
    data = np.frombuffer(b"".join(marked) + bytes(4), np.uint8).astype(np.uint32)
    n = int(lengths.sum())
    word = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(n)  # bytes from here to the word's end
    of, cells, h = [np.arange(len(words))], [np.array([crc32(w) for w in marked], np.uint32)], data[:n]
    for size in (2, 3, 4):
        h = (h * np.uint32(0x01000193)) ^ data[size - 1 : n + size - 1]
        full = left >= size
        of.append(word[full])
        cells.append(((h[full] + np.uint32(size)) * np.uint32(0x9E3779B1)) >> np.uint32(7))
    return np.concatenate(of), (np.concatenate(cells) % CELLS).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # languages x cells, log probabilities
    scripts: dict[str, np.ndarray]  # script -> which languages use it
    default: int  # the most frequent language
    labeller: Labeller | None = None

    def scores_of(self, words: list[str]) -> np.ndarray:
        """Words by languages: 0 for the best, no less than -12; all 0 if no language uses the word's script."""
        of, cells = grams(words)
        n = np.bincount(of, minlength=len(words))
        s = np.stack([np.bincount(of, own[cells], minlength=len(words)) * 3.0 / n for own in self.scores], axis=1)
        none = np.zeros(len(self.languages), bool)
        fits = np.array([self.scripts.get(script_of(w), none) for w in words])
        s -= np.where(fits, s, -np.inf).max(axis=1, keepdims=True, initial=-1e9)
        s = np.maximum(np.where(fits, s, -12.0), -12.0)
        return np.where(fits.any(axis=1)[:, None], s, 0.0).astype(np.float32)


def folded(by_lang: dict[str, Counter], cells_of: dict[str, np.ndarray], script_n: Counter) -> None:
    """Adds the counted words of each language to its cells and to the letters of its scripts, and forgets them."""
    for lang, counter in by_lang.items():
        own, items = cells_of.setdefault(lang, np.zeros(CELLS, np.int64)), iter(counter.items())
        while part := list(islice(items, FOLD_WORDS)):
            of, cells = grams([word for word, _ in part])
            weights = np.fromiter((n for _, n in part), np.int64, len(part))
            own += np.bincount(cells, weights[of], minlength=CELLS).astype(np.int64)
            for word, n in part:
                script_n[lang, script_of(word)] += n * len(word)
    by_lang.clear()


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts over all rows of ``docs`` with a language and a text."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_lang: dict[str, Counter] = {}
        docs_of: Counter = Counter()
        cells_of: dict[str, np.ndarray] = {}
        script_n: Counter = Counter()

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                name = lang.as_py()
                docs_of[name] += 1
                by_lang.setdefault(name, Counter()).update(words_of(text.as_py()))
            if sum(map(len, by_lang.values())) > CACHE_WORDS:
                folded(by_lang, cells_of, script_n)
        folded(by_lang, cells_of, script_n)
        schema = pa.schema([("lang", pa.string()), ("cell", pa.int32()), ("script", pa.string()), ("n", pa.int64())])
        out: list[tuple[str, int, str | None, int]] = [(lang, -1, None, n) for lang, n in docs_of.items()]
        out += [(lang, -2, script, n) for (lang, script), n in script_n.items()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
        for lang, table in cells_of.items():
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(at)), pa.array(at, pa.int32()), pa.nulls(len(at), pa.string()), pa.array(table[at])], schema=schema)

    counted = file_batches(rows).mapInArrow(count, "lang string, cell int, script string, n long").groupBy("lang", "cell", "script").agg(F.sum("n").alias("n"))
    # A row for each language, CELLS pairs and a few scripts at most.
    tables = counted.groupBy("lang").agg(F.collect_list(F.struct("cell", "script", "n")).alias("held"))
    tables = cut(tables)
    if (n := tables.count()) * CELLS * 4 > MAX_MODEL_BYTES:
        raise ValueError(f"{n} languages make a model of more than {MAX_MODEL_BYTES} bytes")
    return model_from_counts((r["lang"], r["held"]) for r in tables.orderBy("lang").toLocalIterator())


def model_from_counts(tables: Iterable[tuple[str, list[tuple[int, str | None, int]]]]) -> Model:
    """The model of languages in order, each with (cell, script, n): cell -1 counts documents, -2 letters of a script."""
    languages, scores, scripts, docs = [], [], {}, []
    for k, (lang, held) in enumerate(tables):
        cells = np.array([(c, n) for c, _, n in held if c >= 0], np.int64).reshape(-1, 2)
        own = np.zeros(CELLS)
        own[cells[:, 0]] = cells[:, 1]
        languages.append(lang)
        scores.append(np.log((own + 0.5) / (own.sum() + 0.5 * CELLS)).astype(np.float32))
        docs.append(sum(n for c, _, n in held if c == -1))
        by_script = {s: n for c, s, n in held if c == -2}
        for script, n in by_script.items():
            if n >= SCRIPT_SHARE * sum(by_script.values()):
                scripts.setdefault(script, []).append(k)
    users = {s: np.isin(np.arange(len(languages)), scripts.get(s, [])) for s in _SCRIPTS}
    return Model(languages, np.array(scores, np.float32).reshape(-1, CELLS), users, int(np.argmax(docs)) if docs else 0)


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """The best language of each word; ``scores`` has the words of all documents, one document after the other.

    All documents advance together, one word a step, over a copy in which the
    words of a step stand side by side; the longest documents come first, so those
    still running are a front part.
    """
    n, k = scores.shape
    if not n:
        return np.zeros(0, np.int16)
    order = np.argsort(-lengths, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    ordered = lengths[order]
    steps = int(ordered[0])
    running = np.searchsorted(-ordered, -np.arange(steps), side="left")  # documents with more than t words
    offset = np.concatenate([[0], np.cumsum(running)])
    begin = np.cumsum(lengths) - lengths
    place = offset[np.arange(n) - np.repeat(begin, lengths)] + np.repeat(rank, lengths)
    value = np.empty((n, k), np.float32)  # of the best way that ends in this word and language
    value[place] = scores
    came = np.zeros(n, np.int16)  # the language that a switch before this word comes from
    bounds, live = offset.tolist(), running.tolist()
    for t in range(1, steps):
        lo, mid = bounds[t - 1], bounds[t]
        v = value[lo : lo + live[t]]
        came[mid : bounds[t + 1]] = v.argmax(axis=1)
        value[mid : bounds[t + 1]] += np.maximum(v, v.max(axis=1, keepdims=True) - penalty)
    labels = np.empty(n, np.int16)
    best = value.argmax(axis=1).astype(np.int16)
    state = np.empty(0, np.int16)
    for t in range(steps - 1, -1, -1):
        lo, hi = bounds[t], bounds[t + 1]
        if len(state) < live[t]:
            state = np.concatenate([state, best[lo + len(state) : hi]])
        labels[lo:hi] = state
        if t:
            v = value[bounds[t - 1] : bounds[t - 1] + live[t]]
            origin = came[lo:hi]
            at = np.arange(live[t])
            state = np.where(v[at, state] >= v[at, origin] - penalty, state, origin)
    return labels[place]


class Labeller:
    """Labels texts with a model; scores of words are kept, up to CACHE_WORDS."""

    def __init__(self, model: Model):
        self.model, self.ids = model, {}
        self.table = np.zeros((1024, len(model.languages)), np.float32)
        self.sizes = np.zeros(1024, np.int32)

    def _learn(self, words: list[str]) -> None:
        """Adds the scores of words that have the last places, but no scores yet."""
        start, n = len(self.ids) - len(words), len(self.ids)
        if n > len(self.table):
            size = max(n, 2 * len(self.table))
            self.table = np.concatenate([self.table, np.zeros((size - len(self.table), self.table.shape[1]), np.float32)])
            self.sizes = np.concatenate([self.sizes, np.zeros(size - len(self.sizes), np.int32)])
        step = max(64, min(4096, PATH_SCORES // self.table.shape[1]))
        for at in range(0, len(words), step):
            part = words[at : at + step]
            self.table[start + at : start + at + len(part)] = self.model.scores_of(part)
        self.sizes[start:n] = [len(w) for w in words]

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """(language, score, spans) of each text; a span is (first word, end word, language)."""
        if not self.model.languages:
            return [("und", 0.0, [])] * len(texts)
        if len(self.ids) * len(self.model.languages) > CACHE_SCORES:
            self.__init__(self.model)
        ids, fresh, found = self.ids, [], [np.zeros(0, np.int32)]
        for text in texts:  # a text's words go before the next one's are made
            words = words_of(text)
            new = set(words).difference(ids)
            ids.update(zip(new, range(len(ids), len(ids) + len(new))))
            fresh += new
            found.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
        self._learn(fresh)
        lengths = np.array([len(words) for words in found[1:]], np.int64)
        flat = np.concatenate(found)
        del found
        path = viterbi(self.table[flat], lengths)
        sizes, names, out, at = self.sizes[flat], self.model.languages, [], 0
        for n in lengths:
            if not n:
                out.append(("und", 0.0, []))
                continue
            own, size = path[at : at + n], sizes[at : at + n]
            letters = np.bincount(own, weights=size, minlength=len(names))
            known = self.table[flat[at : at + n]].min(axis=1) < 0 if len(names) > 1 else np.ones(n, bool)
            best = int(letters.argmax()) if known.any() else self.model.default
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), int(n)]
            spans = [(lo, hi, names[own[lo]]) for lo, hi in zip(cuts, cuts[1:])]
            sure = float(size[(own == best) & known].sum() / size.sum()) if known.any() else 1.0 / len(names)
            out.append((names[best], sure, spans))
            at += n
        return out


SPANS = "array<struct<from_word:int,to_word:int,lang:string>>"


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with _lang, _score (share of letters in spans of that language that the model knows) and _spans.

    A null text, or one without a letter, is ``und`` with score 0. Text in scripts
    that no learned language uses gets the most frequent language with an even
    score. Ties go to the first language in order. An untrained model answers ``und``.
    Columns of these names in ``docs`` give way.
    """
    docs = docs.drop("_lang", "_score", "_spans")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text_at = docs.columns.index(text_col)
    schema = docs.withColumns({"_lang": F.lit("").cast("string"), "_score": F.lit(0.0), "_spans": F.lit(None).cast(SPANS)}).schema
    span_type = pa.list_(pa.struct([("from_word", pa.int32()), ("to_word", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        labeller = model.labeller = model.labeller or Labeller(model)  # a worker keeps it for its next tasks
        for batch in batches:
            at = 0
            portion = max(1 << 16, min(PORTION, 6 * PATH_SCORES // max(1, len(model.languages))))
            while at < batch.num_rows:  # so much text at a time
                size, to = 0, at
                while to < batch.num_rows and size < portion:
                    size += len(batch.column(text_at)[to].as_py() or "")
                    to += 1
                part = batch.slice(at, to - at)
                found = labeller.label(part.column(text_at).to_pylist())
                spans = pa.array([[{"from_word": a, "to_word": b, "lang": n} for a, b, n in s] for _, _, s in found], span_type)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), spans], names=[*batch.schema.names, "_lang", "_score", "_spans"])
                at = to

    for field in schema:
        field.nullable = True
    return file_batches(docs).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    return crc_bucket(id_col, 4) == 2


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id_col, held_out, lang_pred, score, n_spans) for every row, learned from rows that are not held out."""
    model = train(docs.where(~held_out(id_col)), text_col, lang_col)
    found = identify(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")), model, "_text")
    return found.select(id_col, held_out(id_col).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"), F.size("_spans").cast("long").alias("n_spans"))
