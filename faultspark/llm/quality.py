"""Quality: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Words (runs of letters and digits) and runs of other marks are the tokens; tokens and pairs of
neighbouring tokens are hashed into 2^BITS buckets, a repeated token's pair into one bucket of its own.
A document's vector holds the square roots of its bucket counts, scaled to length 1. Training takes
per-coordinate FTRL-proximal steps over batches of rows; a score is a sparse dot product.

Cases: null or empty text is the zero vector, its score that of the bias. Rows with a null label do
not train; without rows of both classes every score is the share of label 1 (0.5 if none). Repeated
rows are scored alike.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordMemo, crc_mod, strings, word_codes
from .toxicity import score, trained

BITS = 18
TRAIN_ROWS = 6_000
THRESHOLD = 0.7
REPEATED = 0x5BD1E995


def _hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


class _Vectors:
    """Sparse vectors of texts: sorted buckets, values of length 1."""

    def __init__(self):
        self.memo = WordMemo(_hashes)

    def sparse(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, bucket and value of every entry, by row."""
        spaced = pc.replace_substring_regex(pc.utf8_lower(texts), r"\s+", " ")
        off, codes, words = word_codes(pc.replace_substring_regex(spaced, r"([\p{L}\p{N}]+)", r" \1 "))
        one = self.memo.of(strings(words))[codes]
        row = np.repeat(np.arange(len(texts)), np.diff(off))
        a, b, same = one[:-1], one[1:], row[:-1] == row[1:]
        two = np.where(a == b, np.uint64(REPEATED), a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F))[same]
        mixed = np.concatenate([one, two]) * np.uint64(0xFF51AFD7ED558CCD)
        keys = np.concatenate([row, row[:-1][same]]) << BITS | (mixed >> np.uint64(64 - BITS)).astype(np.int64)
        keys.sort()
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        v = np.sqrt(np.diff(np.concatenate([first, [len(keys)]])))
        row = keys[first] >> BITS
        length = np.sqrt(np.bincount(row, v * v, len(texts)))
        return row, keys[first] & ((1 << BITS) - 1), v / length[row]

    def of(self, texts: pa.Array):
        row, idx, val = self.sparse(texts)
        cut = np.searchsorted(row, np.arange(len(texts) + 1))
        for a, b in zip(cut, cut[1:]):
            yield idx[a:b].astype(np.int32), val[a:b].astype(np.float32)


def train(y: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], *, epochs: int = 6, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, batch: int = 16, seed: int = 3) -> tuple[np.ndarray, float]:
    """FTRL-proximal weights and the bias (an unregularised coordinate of its own)."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = 0.0
    rng = np.random.default_rng(seed)
    lengths = np.array([len(i) for i, _ in rows])

    def weights(z, n):
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            idx, val = np.concatenate([rows[k][0] for k in own]), np.concatenate([rows[k][1] for k in own])
            row = np.repeat(np.arange(len(own)), lengths[own])
            b = -zb / ((beta + np.sqrt(nb)) / alpha)
            dot = np.bincount(row, weights(z[idx], n[idx]) * val, len(own)) + b
            miss = 1 / (1 + np.exp(-np.clip(dot, -40, 40))) - y[own]
            uniq, inverse = np.unique(idx, return_inverse=True)
            g = np.bincount(inverse, miss[row] * val, len(uniq))
            sigma = (np.sqrt(n[uniq] + g * g) - np.sqrt(n[uniq])) / alpha
            z[uniq] += g - sigma * weights(z[uniq], n[uniq])
            n[uniq] += g * g
            gb = float(miss.sum())
            zb += gb - (np.sqrt(nb + gb * gb) - np.sqrt(nb)) / alpha * b
            nb += gb * gb
    return weights(z, n).astype(np.float32), float(-zb / ((beta + np.sqrt(nb)) / alpha))


class QualityModel:
    """Scores texts; small and picklable."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self._vectors: _Vectors | None = None

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "_vectors": None}

    def scores(self, texts: pa.Array) -> np.ndarray:
        self._vectors = self._vectors or _Vectors()
        row, idx, val = self._vectors.sparse(texts)
        z = np.bincount(row, self.weights[idx] * val, len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", *, train_rows: int = TRAIN_ROWS) -> QualityModel:
    """Trains on at most `train_rows` labelled rows, those with the least hash of doc_id; every document is scored."""
    return QualityModel(*trained(docs, labels, label, train_rows, _Vectors, train))


def quality(docs: DataFrame, labels: DataFrame, *, folds: int = 4, held_out: int = 2, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. Rows whose crc32(doc_id) mod folds is held_out never train."""
    away = F.coalesce(crc_mod(F.col("doc_id"), folds) == held_out, F.lit(False))
    model = fit(docs, labels.where(~away), train_rows=train_rows)
    return score(docs, model, threshold=threshold).select("doc_id", away.alias("held_out"), "score", "predicted")
