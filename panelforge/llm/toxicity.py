"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words, word beginnings of ``STEM`` characters, pairs of neighbouring words, and pairs with one word
between, lowered and stripped of marks at their ends, hashed to ``2**BITS`` places. One task makes ``epochs`` passes of FTRL-proximal
steps over the whole labelled sample in hashed order, whatever its size: a learning rate per coordinate, and an L1 term that
keeps weights at zero until their gradients add up. What is sent to the scoring tasks is the list of places that are not zero.

Ids, language, source and labels are no features. A null or empty text has only the bias. Rows with null labels are not learned from; without
labelled rows every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import as_bytes, map_texts, slices

BITS = 20
#: Labelled documents that are learned from, at most: those with the smallest hash of their id.
SAMPLE_ROWS = 12_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 2.0, 1.0, 5.0, 0.1
STEM = 4

_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_BIAS = 0
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


class Hasher:
    """Feature places of a text; words seen lately keep their hashes."""

    def __init__(self, bits: int = BITS, keep: int = 400_000):
        self.shift, self.keep, self.known = np.uint64(64 - bits), keep, {}

    def _hash(self, word: bytes) -> tuple[int, int]:
        if len(self.known) >= self.keep:
            self.known.clear()
        bare = word.strip(_MARKS)
        h = self.known[word] = (xxhash.xxh64_intdigest(bare, 7), xxhash.xxh64_intdigest(bare.decode()[:STEM], 9))
        return h

    def places(self, text: bytes) -> np.ndarray:
        """Places with repeats; the first is the bias."""
        words = text.lower().split()
        known = self.known
        both = np.array([known.get(w) or self._hash(w) for w in words], dtype=np.uint64).reshape(-1, 2)
        h = both[:, 0]
        mixed = np.concatenate([h * _MIX[0], both[:, 1] * _MIX[2], h[:-1] * _MIX[1] + h[1:] * _MIX[0], h[:-2] * _MIX[2] + h[2:] * _MIX[0]])
        mixed ^= mixed >> np.uint64(29)
        mixed *= _MIX[1]
        return np.r_[_BIAS, (mixed >> self.shift).astype(np.int64)]

    def total(self, text: bytes, weights: np.ndarray) -> float:
        """Sum of the weights of the distinct places."""
        at = self.places(text)
        return float(weights[np.unique(at[weights[at] != 0])].sum())


def train(places: list[np.ndarray], labels: list[int], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights after FTRL-proximal passes over the documents in the given order."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(at: np.ndarray) -> np.ndarray:
        own = z[at]
        return np.where(np.abs(own) <= L1, 0.0, (np.sign(own) * L1 - own) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for at, y in zip(places, labels):
            w = weights(at)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            before = n[at]
            z[at] += g - (np.sqrt(before + g * g) - np.sqrt(before)) / ALPHA * w
            n[at] = before + g * g
    return weights(np.arange(1 << bits))


def learn(
    docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS,
) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights) that are not zero."""
    chosen = (
        labels.where(F.col(label_col).isNotNull()).select(F.xxhash64(F.col(id_col).cast("string")).alias("_h"), F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
        .orderBy("_h", "_id", "_label").limit(sample_rows)
    )
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = texts.join(F.broadcast(chosen), "_id").select("_h", "_label", "_text").orderBy("_h", "_label", "_text").limit(sample_rows)  # one ordered partition

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        at, ys = [], []
        for batch in slices(batches, "_text"):
            at += [np.unique(hasher.places(text)).astype(np.int32) for text in as_bytes(batch, "_text")]
            ys += batch.column(1).to_pylist()
        if ys:
            w = train(at, ys)
            found = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(w[found])], names=["place", "weight"])

    found = rows.mapInArrow(run, "place long, weight double").collect()  # at most 2**BITS places
    return np.array([r["place"] for r in found], dtype=np.int64), np.array([r["weight"] for r in found], dtype=np.float64)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text_col: str = "text") -> DataFrame:
    """Add ``score`` (double) and ``predicted`` (int, score of a half or more) to every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most 2**BITS places
    state: dict = {}

    def make(batch: pa.RecordBatch) -> dict:
        if not state:
            state["hasher"], state["weights"] = Hasher(), np.zeros(1 << BITS)
            state["weights"][sent.value[0]] = sent.value[1]
        weights, hasher = state["weights"], state["hasher"]
        sums = np.array([hasher.total(t, weights) for t in as_bytes(batch, text_col)])
        s = 1.0 / (1.0 + np.exp(-np.clip(sums, -500, 500)))
        return {"score": s, "predicted": (s >= 0.5).astype(np.int32)}

    return map_texts(docs, make, "score double, predicted int", text_col)
