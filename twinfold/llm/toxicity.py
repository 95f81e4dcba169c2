"""Toxicity scores: logistic regression over hashed word n-grams and skip-grams, trained by FTRL-proximal.

A text's features are the distinct hashes of its lower-case words, word pairs and pairs with one word between. FTRL
keeps a learning rate for each coordinate and its L1 term leaves most weights at zero, so that the model that is
broadcast is a short list. It is trained on a bounded, hash-ordered sample of labelled rows, streamed through one
task; scoring is one pass over every whole text without a shuffle.

The settings were chosen by the log loss on the labelled rows whose crc32(doc_id as text) mod 4 is 1, with the others of
the training rows as the sample; the held-out rows had no part in it.

Defined results: a null or empty text has no features, so the intercept alone gives its score; without any labelled row
every score is 0.5; of repeated labels of a document the largest counts, and each row of a repeated document is scored
(and learnt from) by itself; a null doc_id is scored but never learnt from; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound of the training sample, in labelled documents; hash bits; FTRL's settings.
SAMPLE_DOCS, BITS, ALPHA, BETA, L1, L2, EPOCHS = 8000, 20, 1.0, 1.0, 5.0, 1.0, 4
_TOKEN = re.compile(r"\w+")


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        got = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        return got


def features(text: str | None, hashes: WordHashes, bits: int = BITS) -> np.ndarray:
    """Hashed features of a text, with repeats."""
    found = _TOKEN.findall((text or "").lower())
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    mixed = [h * np.uint64(0xD6E8FEB86659FD93)]
    for gap, odd in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)):
        mixed.append((h[:-gap] * np.uint64(3) ^ h[gap:]) * np.uint64(odd))
    x = np.concatenate(mixed)
    return (((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)).astype(np.int64)


class Ftrl:
    """FTRL-proximal with per-coordinate rates.

    The intercept is the last coordinate: every row has it, the L1 term spares it, and ``base`` (the log-odds of the
    sample's labels) is where it starts.
    """

    def __init__(self, bits: int = BITS, base: float = 0.0, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n, self.base = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1), base
        self.alpha, self.beta, self.l2 = alpha, beta, l2
        self.intercept, self.l1 = 1 << bits, l1

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, l1 = self.z[at], np.where(at == self.intercept, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        """One row; ``at`` holds its distinct coordinates, the intercept last."""
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum() + self.base, -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


@dataclass
class ToxicityModel:
    at: np.ndarray
    weight: np.ndarray
    bias: float
    bits: int = BITS

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.bits)
        w[self.at] = self.weight
        return w


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, bits: int = BITS, epochs: int = EPOCHS) -> ToxicityModel:
    """labelled: doc_id, text, toxic. Only the sparse weights reach the driver."""
    sample = labelled.where("toxic is not null and doc_id is not null").select(F.xxhash64("doc_id", F.lit(17)).alias("_h"), "doc_id", "text", F.col("toxic").cast("int")).orderBy("_h", "doc_id").limit(sample_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rows = WordHashes(), []
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows.append((np.append(np.unique(features(text, hashes, bits)), 1 << bits).astype(np.int32), int(label > 0)))
            hashes.clear()
        positive = sum(label for _, label in rows)
        model = Ftrl(bits, float(np.log((positive + 0.5) / (len(rows) - positive + 0.5))))
        for _ in range(epochs):
            for x, label in rows:
                model.learn(x.astype(np.int64), label)
        w = model.weights(np.arange(len(model.z)))
        w[-1] += model.base
        used = np.union1d(np.flatnonzero(w), [model.intercept])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(w[used], pa.float64())], names=["at", "weight"])

    got = sample.select("text", "toxic").coalesce(1).mapInArrow(run, "at long, weight double").collect()
    at, weight = np.array([r[0] for r in got], np.int64), np.array([r[1] for r in got], float)
    bias = float(weight[at == 1 << bits].sum())
    return ToxicityModel(at[at < 1 << bits], weight[at < 1 << bits], bias, bits)


def score(docs: DataFrame, model: ToxicityModel, cache_words: int = 400_000) -> DataFrame:
    """doc_id and score of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by 2 ** bits, and L1 keeps it far below

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, hashes, bias, bits = shared.value.dense(), WordHashes(), shared.value.bias, shared.value.bits
        used = weights != 0

        def once(x: np.ndarray) -> float:
            return weights[np.unique(x[used[x]])].sum()

        for batch in batches:
            if len(hashes) > cache_words:
                hashes.clear()
            total = np.array([once(features(t, hashes, bits)) for t in batch.column(1).to_pylist()], float) + bias
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(total, -700, 700))), pa.float64())], names=["doc_id", "score"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, "doc_id long, score double")


def labelled(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, text and toxic of the hash-ordered sample of labelled documents that ``train`` may read.

    The sample's ids, at most sample_docs of them, are broadcast; texts are not shuffled.
    """
    chosen = labels.where("toxic is not null and doc_id is not null").orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(sample_docs)
    return docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "toxic")), "doc_id", "inner")
