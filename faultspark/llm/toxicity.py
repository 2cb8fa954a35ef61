"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams and itself, each hashed to a row of an embedding table; a
document is the mean of all those rows; a linear softmax over the mean gives the classes. Table and
softmax are trained together by Adagrad steps in numpy, so misspellings that training never saw share
the vectors of their n-grams.

Cases: null or empty text has no subwords, its mean is the zero vector and its score that of the
softmax bias. Rows with a null label take no part in training; with fewer than one row of each class
every score is the share of label 1 (0.5 without any labelled row). Repeated rows are scored alike.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordMemo, blocks, crc_mod, spread, strings, word_codes

BITS = 18
N_LOW, N_HIGH = 4, 6
DIM = 4
TRAIN_ROWS = 6_000
THRESHOLD = 0.7


def buckets_of(word: str, bits: int = BITS) -> list[int]:
    """Hash buckets of a word's n-grams (with its edges marked) and of the word."""
    mask = (1 << bits) - 1
    edged = f"<{word}>"
    grams = {edged[i : i + n] for n in range(N_LOW, N_HIGH + 1) for i in range(len(edged) - n + 1)}
    return [zlib.crc32(g.encode()) & mask for g in grams | {f"={word}"}]


def words_of(texts: pa.Array):
    """Lower-case runs of letters and digits of each text, coded."""
    return word_codes(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}]+", " "))


class _Bags:
    """Bucket counts of texts; the buckets of a word are worked out once."""

    def __init__(self, most: int = 200_000):
        self.memo: dict[str, list[int]] = {}
        self.most = most

    def of(self, texts: pa.Array):
        off, codes, words = words_of(texts)
        if len(self.memo) > self.most:
            self.memo.clear()
        parts = []
        for w in strings(words):
            if w not in self.memo:
                self.memo[w] = buckets_of(w)
            parts.append(self.memo[w])
        for a, b in zip(off, off[1:]):
            if a == b:
                yield np.zeros(0, np.int32), np.zeros(0, np.float32)
                continue
            own, n = np.unique(codes[a:b], return_counts=True)
            idx = np.concatenate([parts[c] for c in own]).astype(np.int32)
            val = np.repeat(n, [len(parts[c]) for c in own])
            idx, inverse = np.unique(idx, return_inverse=True)
            val = np.bincount(inverse, val)
            yield idx, (val / val.sum()).astype(np.float32)


def featurizer(vectors):
    """A mapInArrow function: rows (y, text) to y and the sparse vector of the text."""

    def run(batches):
        own = vectors()
        for b in batches:
            for at, texts in blocks(b.column("text")):
                pairs = list(own.of(texts))
                yield pa.RecordBatch.from_arrays([b.column("y").slice(at, len(texts)), pa.array([p[0].tobytes() for p in pairs], pa.binary()), pa.array([p[1].tobytes() for p in pairs], pa.binary())], names=["y", "idx", "val"])

    return run


def train(y: np.ndarray, bags: list[tuple[np.ndarray, np.ndarray]], *, bits: int = BITS, dim: int = DIM, epochs: int = 6, rate: float = 3.0, batch: int = 64, decay: float = 1e-5, seed: int = 7) -> tuple[np.ndarray, float]:
    """Embeddings and softmax trained together; returns each bucket's logit of class 1 against 0, and the bias."""
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (1 << bits, dim)).astype(np.float32)
    soft = rng.normal(0, 0.5, (dim, 2)).astype(np.float32)
    share = np.clip(np.bincount(y, minlength=2)[:2] / len(y), 1e-6, 1)
    bias = np.log(share).astype(np.float32)
    seen = np.full(1 << bits, 1e-10, np.float32)
    seen_soft = np.full_like(soft, 1e-6)
    seen_bias = np.full_like(bias, 1e-2)
    lengths = np.array([len(i) for i, _ in bags])
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            rows = [k for k in order[at : at + batch] if lengths[k]]
            if not rows:
                continue
            idx = np.concatenate([bags[k][0] for k in rows])
            val = np.concatenate([bags[k][1] for k in rows])
            starts = np.concatenate([[0], np.cumsum(lengths[rows])[:-1]])
            own = np.repeat(np.arange(len(rows)), lengths[rows])
            mean = np.add.reduceat(table[idx] * val[:, None], starts, axis=0)
            z = mean @ soft + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            g_soft, g_bias, g_mean = mean.T @ p / len(rows), p.mean(0), p @ soft.T / len(rows)
            uniq, inverse = np.unique(idx, return_inverse=True)
            weighted = val[:, None] * g_mean[own]
            g = np.stack([np.bincount(inverse, weighted[:, d], len(uniq)) for d in range(dim)], 1).astype(np.float32)
            g += decay * table[uniq] / len(rows)
            seen[uniq] += (g * g).mean(1)
            table[uniq] -= step * g / np.sqrt(seen[uniq])[:, None]
            seen_soft += g_soft * g_soft
            soft -= 0.1 * step * g_soft / np.sqrt(seen_soft)
            seen_bias += g_bias * g_bias
            bias -= 0.1 * step * g_bias / np.sqrt(seen_bias)
    return (table @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0])


class ToxicityModel:
    """Scores texts; small and picklable."""

    def __init__(self, logits: np.ndarray, bias: float):
        self.logits, self.bias = logits, bias
        self._memo: WordMemo | None = None

    def __getstate__(self):
        return {"logits": self.logits, "bias": self.bias, "_memo": None}

    def _work(self, words: list[str]) -> np.ndarray:
        parts = [buckets_of(w) for w in words]
        n = np.array([len(p) for p in parts], np.int64)
        if not len(n):
            return np.zeros((0, 2))
        logits = self.logits[np.concatenate(parts)].astype(np.float64)
        return np.stack([np.add.reduceat(logits, np.concatenate([[0], np.cumsum(n)[:-1]])), n], 1)

    def scores(self, texts: pa.Array) -> np.ndarray:
        self._memo = self._memo or WordMemo(self._work, 500_000)
        off, codes, words = words_of(texts)
        rows = np.concatenate([np.zeros((1, 2)), np.cumsum(self._memo.of(strings(words))[codes], 0)])
        total, n = (rows[off[1:]] - rows[off[:-1]]).T
        z = self.bias + total / np.maximum(n, 1)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def calibrated(y: np.ndarray, bags: list[tuple[np.ndarray, np.ndarray]], train, part: int = 5) -> tuple[np.ndarray, float]:
    """train on most rows; every part-th row then fits the slope and shift (Platt) that make its logits odds."""
    aside = np.arange(len(y)) % part == 0
    if len(y) < 50 or len(set(y[aside])) < 2 or len(set(y[~aside])) < 2:
        return train(y, bags)
    logits, bias = train(y[~aside], [bags[k] for k in np.flatnonzero(~aside)])
    z = np.array([logits[i] @ v + bias for i, v in (bags[k] for k in np.flatnonzero(aside))], np.float64)
    x, t, ab = np.stack([z, np.ones_like(z)], 1), y[aside], np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -40, 40)))
        ab -= 0.5 * np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-6)[:, None]) + np.eye(2) * 1e-3, x.T @ (p - t) + 1e-3 * (ab - [1, 0]))
    if ab[0] <= 0:
        return logits, bias
    return (logits * ab[0]).astype(np.float32), float(bias * ab[0] + ab[1])


def fit(docs: DataFrame, labels: DataFrame, label: str, *, train_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Trains on at most `train_rows` labelled rows, those with the least hash of doc_id.

    The bound is on training rows only; every document is scored. labels: doc_id and the label column.
    """
    return ToxicityModel(*trained(docs, labels, label, train_rows, _Bags, train))


def trained(docs, labels, label, train_rows, vectors, train):
    """Weights and bias from the chosen rows; their sparse vectors come to the driver, at most train_rows of them."""
    chosen = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .select("doc_id", F.col(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "y")
        .limit(train_rows)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("y", "text")
    got = spread(rows).mapInArrow(featurizer(vectors), "y int, idx binary, val binary").toArrow().to_pydict()
    y = np.array(got["y"], np.int64)
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
        return np.zeros(1 << BITS, np.float32), float(np.log(p / (1 - p)))
    bags = [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for i, v in zip(got["idx"], got["val"])]
    order = sorted(range(len(y)), key=lambda k: (got["idx"][k], int(y[k])))
    return calibrated(y[order], [bags[k] for k in order], train)


def score(docs: DataFrame, model, *, threshold: float = THRESHOLD) -> DataFrame:
    """Each row of docs (doc_id, text) as doc_id, score, predicted; columns of the same names are not kept."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shipped.value
        for b in batches:
            s = np.concatenate([own.scores(t) for _, t in blocks(b.column("text"))] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return spread(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, "doc_id long, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, *, folds: int = 3, held_out: int = 1, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. Rows whose crc32(doc_id) mod folds is held_out never train."""
    away = F.coalesce(crc_mod(F.col("doc_id"), folds) == held_out, F.lit(False))
    model = fit(docs, labels.where(~away), "toxic", train_rows=train_rows)
    return score(docs, model, threshold=threshold).select("doc_id", away.alias("held_out"), "score", "predicted")
