"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are embedded, convolved by learned filters (8 bytes wide,
every 4 bytes), rectified and max-pooled over chunks of 512 bytes that overlap
by half and cover the whole document. A document's chunks combine by mean, by
maximum and by spread into one logistic unit. Training is Adam on the driver over a bounded
sample of labelled rows with their whole texts; scoring runs in tasks, many texts at once. Both
work through texts in blocks of bytes, so a long text takes no more memory than its features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardwright.llm.common import crc_bucket, stored

HALF, WIDTH, STRIDE, EMBED, FILTERS = 256, 8, 4, 8, 32
#: The training sample's bounds: labelled rows, and bytes after which no further row is taken.
TRAIN_ROWS, TRAIN_BYTES = 4000, 64 << 20
#: Bytes of text that the filters see at once, and bytes of texts in one training step (or one text).
BLOCK, STEP_BYTES = 256 * HALF, 1 << 20
EPOCHS, BATCH, RATE, DECAY, SEED = 12, 32, 4e-3, 1e-4, 5


def packed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, each padded with blanks to whole half-chunks, and how many halves each has."""
    halves = np.array([(len(t) + HALF) // HALF for t in texts], np.int64)
    parts = [t.ljust(HALF * int(n), b" ") for t, n in zip(texts, halves)]
    return np.frombuffer(b"".join(parts) + b" " * WIDTH, np.uint8), halves


@dataclass
class Network:
    embed: np.ndarray  # 256 x EMBED
    conv: np.ndarray  # WIDTH * EMBED x FILTERS
    bias: np.ndarray  # FILTERS
    out: np.ndarray  # 3 * FILTERS
    rate: np.ndarray  # 1: the output's bias

    def __post_init__(self) -> None:
        self.mean, self.scale = np.zeros(3 * FILTERS, np.float32), np.ones(3 * FILTERS, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.conv, self.bias, self.out, self.rate]

    def windows(self, data: np.ndarray) -> np.ndarray:
        """A row for every place of the filters: the embedded bytes they see."""
        x = self.embed[data].reshape(-1)
        n = (len(data) - WIDTH) // STRIDE
        step = x.itemsize
        return np.lib.stride_tricks.as_strided(x, (n, WIDTH * EMBED), (STRIDE * EMBED * step, step))

    def halves(self, data: np.ndarray, counts: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Per half-chunk and filter: the largest response, and where it is. A text's last place, which would reach into the next text, takes no part."""
        last = np.zeros(int(counts.sum()), bool)
        last[np.cumsum(counts) - 1] = True
        per = HALF // STRIDE
        out, where = [], []
        for at in range(0, len(data) - WIDTH, BLOCK):
            z = (self.windows(data[at : at + BLOCK + WIDTH]) @ self.conv).reshape(-1, per, FILTERS)
            z[last[at // HALF : at // HALF + len(z)], -1] = -np.inf
            out.append(z.max(axis=1))
            if keep:
                where.append(z.argmax(axis=1) + (np.arange(len(z)) + at // HALF)[:, None] * per)
        return np.concatenate(out) + self.bias, np.concatenate(where) if keep else None

    @staticmethod
    def chunked(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chunks of two neighbouring halves of one text (of one, if it has no more): their values, texts' chunk counts, first halves."""
        ends = np.cumsum(counts)
        last = np.zeros(len(h), bool)
        last[ends - 1] = True
        first = np.flatnonzero(~last | np.repeat(counts == 1, counts))
        nxt = np.where(last[first], first, first + 1)
        return np.maximum(h[first], h[nxt]), np.maximum(1, counts - 1), first

    def features(self, chunks: np.ndarray, n: np.ndarray) -> np.ndarray:
        starts = np.cumsum(n) - n
        mean = np.add.reduceat(chunks, starts, axis=0) / n[:, None]
        top = np.maximum.reduceat(chunks, starts, axis=0)
        low = np.minimum.reduceat(chunks, starts, axis=0)
        return np.concatenate([mean, top, low], axis=1)

    def logits(self, texts: list[bytes]) -> np.ndarray:
        data, counts = packed(texts)
        h = np.maximum(self.halves(data, counts)[0], 0)
        chunks, n, _ = self.chunked(h, counts)
        return ((self.features(chunks, n) - self.mean) / self.scale) @ self.out + self.rate[0]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts).astype(np.float64), -40, 40)))

    def gradients(self, texts: list[bytes], labels: np.ndarray) -> tuple[list[np.ndarray], float]:
        data, counts = packed(texts)
        z, where = self.halves(data, counts, keep=True)
        h = np.maximum(z, 0)
        chunks, n, first = self.chunked(h, counts)
        raw = self.features(chunks, n)
        f = (raw - self.mean) / self.scale
        p = 1 / (1 + np.exp(-np.clip(f @ self.out + self.rate[0], -40, 40)))
        loss = float(-np.mean(np.where(labels == 1, np.log(p + 1e-9), np.log(1 - p + 1e-9))))
        d = ((p - labels) / len(labels)).astype(np.float32)
        df = d[:, None] * (self.out / self.scale)
        k = FILTERS
        doc = np.repeat(np.arange(len(n)), n)
        dc = df[doc, :k] / n[doc][:, None]
        for part, side in ((raw[:, k : 2 * k], df[:, k : 2 * k]), (raw[:, 2 * k :], df[:, 2 * k :])):
            hit = chunks == part[doc]
            ties = np.add.reduceat(hit, np.cumsum(n) - n, axis=0, dtype=np.float32)
            dc += hit * (side / ties)[doc]
        dh = np.zeros_like(h)
        nxt = np.minimum(first + 1, len(h) - 1)
        from_next = (h[nxt] > h[first]) & (n[doc] >= 1)[:, None] & (chunks == h[nxt])
        dh[first] += np.where(from_next, 0, dc)
        np.add.at(dh, nxt, np.where(from_next, dc, 0))
        dz = (dh * (z > 0)).astype(np.float32)
        g_conv, g_embed = np.zeros((WIDTH * EMBED, FILTERS), np.float32), np.zeros((256, EMBED))
        for at in range(0, len(where), BLOCK // HALF):
            own, dzs = where[at : at + BLOCK // HALF], dz[at : at + BLOCK // HALF]
            bytes_at = data[(own * STRIDE)[..., None] + np.arange(WIDTH)]  # halves x filters x width
            x = self.embed[bytes_at].reshape(*own.shape, WIDTH * EMBED)
            g_conv += np.einsum("hfk,hf->kf", x, dzs, optimize=True)
            back = dzs[..., None, None] * self.conv.T.reshape(FILTERS, WIDTH, EMBED)[None]
            flat = bytes_at.reshape(-1)
            g_embed += np.stack([np.bincount(flat, back[..., e].reshape(-1), 256) for e in range(EMBED)], axis=1)
        return [g_embed, g_conv, dz.sum(axis=0), f.T @ d, np.array([d.sum()])], loss

    def standardise(self, texts: list[bytes]) -> None:
        """Fixes the features' means and scales to those of the texts."""
        data, counts = packed(texts)
        chunks, n, _ = self.chunked(np.maximum(self.halves(data, counts)[0], 0), counts)
        f = self.features(chunks, n)
        self.mean, self.scale = f.mean(axis=0), f.std(axis=0) + 0.05


def steps(order: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Texts of one training step each: ``BATCH`` of them, fewer if they are long."""
    lo, held = 0, 0
    for k, i in enumerate(order):
        if k > lo and (k - lo == BATCH or held + sizes[i] > STEP_BYTES):
            yield order[lo:k]
            lo, held = k, 0
        held += sizes[i]
    if lo < len(order):
        yield order[lo:]


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """A network trained on whole texts with labels 0 or 1, empty ones too. With one class only, or none, it answers their rate (0.5).

    Repeated texts count each. The order of steps is random but fixed by ``seed``.
    """
    rng = np.random.default_rng(seed)
    w = WIDTH * EMBED
    net = Network(
        rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), rng.normal(0, 1.5 / np.sqrt(w), (w, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32), np.zeros(3 * FILTERS, np.float32), np.zeros(1, np.float32),
    )
    mean = float(labels.mean()) if len(labels) else 0.5
    net.rate[0] = np.log((mean + 0.01) / (1.01 - mean))
    if len(labels) == 0 or mean in (0.0, 1.0):
        return net
    net.standardise(texts[:256])
    params = net.parameters()
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    epochs = max(epochs, min(60, 1500 * epochs // max(1, len(texts))))  # small samples need more rounds
    sizes = np.array([len(t) for t in texts])
    total = epochs * sum(1 for _ in steps(np.arange(len(texts)), sizes))
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for pick in steps(order, sizes):
            grads, _ = net.gradients([texts[i] for i in pick], labels[pick].astype(np.float32))
            t += 1
            rate = RATE * min(1, t / 20) * 0.5 * (1 + np.cos(np.pi * min(1, t / total)))
            for k, (p, g) in enumerate(zip(params, grads)):
                g = g.astype(np.float32)
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                p -= rate * (m[k] / (1 - 0.9**t) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7) + DECAY * p)
    return net


def held_out(id_col: str = "doc_id") -> Column:
    return crc_bucket(id_col, 3) == 1


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Network:
    """Fits on at most ``rows`` labelled documents with their whole texts, the first in order of a hash of their id.

    No further one is taken once they hold ``TRAIN_BYTES``, so the sample's size doesn't depend on the corpus. Null
    labels, ids and texts take no part, empty texts do; of several labels of one id the mean counts.
    Rows that share a labelled id are a row of the sample each.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("_y"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    used = texts.join(F.broadcast(sample), F.col("_doc") == F.col("_id"))  # at most ``rows`` ids
    held = stored(used.select(F.xxhash64("_id").alias("h"), F.md5("t").alias("m"), F.octet_length("t").alias("size"), "t", "_y"), "labelled")
    order = [held["h"], held["m"], held["size"]]
    sized = held.orderBy(*order).limit(rows).select("h", "m", "size").collect()
    room, last = TRAIN_BYTES, None
    for r in sized:
        if room < 0:
            break
        room, last = room - r["size"], r
    if last is None:
        return fit([], np.empty(0, np.int64))
    taken = held.where(F.struct(*order) <= F.struct(F.lit(last["h"]), F.lit(last["m"]), F.lit(last["size"]))).orderBy(*order).limit(rows)
    got, y = [], []
    for r in taken.select("t", "_y").toLocalIterator():
        got.append(r["t"].encode())
        y.append(r["_y"])
    return fit(got, np.array(y, np.int64))


def classify(docs: DataFrame, network: Network, text_col: str = "text") -> DataFrame:
    """``docs`` with _score, the probability of label 1; null counts as the empty text. A column of that name gives way."""
    docs = docs.drop("_score")
    shared = docs.sparkSession.sparkContext.broadcast(network)
    text_at = docs.columns.index(text_col)
    schema = docs.withColumn("_score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(text_at).cast(pa.binary())]
            out, at = [], 0
            while at < len(texts):  # about 1 MB of text at a time
                size, to = 0, at
                while to < len(texts) and size < 1 << 20:
                    size += len(texts[to])
                    to += 1
                out.append(net.scores(texts[at:to]))
                at = to
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out) if out else [], pa.float64())], names=[*batch.schema.names, "_score"])

    for field in schema:
        field.nullable = True
    return docs.mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, score, predicted) for every row, learned from labels that are not held out.

    Null texts count as empty; an empty text is a chunk of blanks and gets that chunk's score. Equal texts
    score alike, repeated rows stay, a score of 0.5 is predicted 1. Without labels every score is 0.5.
    """
    network = train(docs, labels.where(~held_out(id_col)), id_col, text_col)
    found = classify(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")), network, "_text")
    return found.select(id_col, held_out(id_col).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
