"""Quality classifier: similarity-weighted votes of the nearest labelled documents in a latent-semantic space.

A text becomes counts of two kinds of terms. Its vocabulary: words and pairs of neighbouring words, hashed. Its surface: runs of three
character classes, where words repeat (the word before, any of the last
``NEAR`` words, an earlier line, an earlier run of words), and word lengths. Damped shares, weighted by inverse document frequency, are projected on the leading
singular directions of a bounded sample of labelled documents. The labelled vectors
(``sample_rows`` at most, ``dims`` numbers each) are sent to all tasks; every document is compared with every labelled one
in exact blocked cosine products, and its ``k`` most similar ones vote with their labels, weighted by similarity. Votes are
not weighed by class: that would let a rare class reject documents of the other.

One task learns from the sample, in hashed order; what it holds is terms, not texts, and only the directions and vectors reach the driver.

Ids, language, source and labels are no terms. A null or empty text has the zero vector: all labelled documents are equally
near, and it gets the score 0 (nothing speaks for it). Rows with null labels are not learned from; of repeated
labelled ids every row counts. Without labelled documents of both classes the score is the only label, or 0.5. A very long text is held whole by its task; its
terms are no more than the places. The added columns replace columns of their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import as_bytes, map_texts, slices

#: Labelled documents that are learned from, at most: those with the smallest hash of their id.
SAMPLE_ROWS = 6_000
DIMS = 48
NEIGHBOURS = 15
NEAR = 8
#: Labelled texts that a term must occur in.
LEAST = 3
#: Documents that are compared at a time, and words whose hashes a task keeps.
BLOCK = 512
KNOWN_WORDS = 400_000

#: Places of hashed words, and as many of hashed word pairs.
PLACES = 2_048
#: Length of the vocabulary's part of a text's vector; the surface's part has length one.
VOCABULARY = 0.7
#: Rounds in which the directions are found, and how many more than asked for are carried.
ROUNDS, SPARE = 6, 16

_CLASSES = 24
_SURFACE = _CLASSES ** 3 + 256
_TERMS = _SURFACE + 2 * PLACES
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _class_table() -> np.ndarray:
    """Bytes to classes: white space, line end, lower case, upper case, digit, beyond ASCII, marks by themselves or as a rest."""
    table = np.full(256, 23, dtype=np.int64)
    table[list(b" \t\v\f\r")] = 0
    table[10] = 1
    table[97:123] = 2
    table[65:91] = 3
    table[48:58] = 4
    table[128:] = 2
    for i, mark in enumerate(b".,!?#*$%&|<>-_/:;()"):
        table[mark] = 5 + min(i, 17)
    return table


_TABLE = _class_table()


def terms(text: bytes, known: dict[bytes, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(term numbers, their damped shares) of one text. ``known`` keeps hashes of words between texts."""
    raw = np.frombuffer(text, dtype=np.uint8)
    # Characters of more than one byte beyond ASCII would count twice: keep lead bytes.
    kind = _TABLE[raw][(raw & 0xC0) != 0x80]
    runs = np.bincount(kind[:-2] * _CLASSES * _CLASSES + kind[1:-1] * _CLASSES + kind[2:], minlength=_CLASSES ** 3) if len(kind) > 2 else np.zeros(_CLASSES ** 3, dtype=np.int64)
    words = text.lower().split()
    extra = np.zeros(256, dtype=np.int64)
    if not words:
        at = np.flatnonzero(runs)
        return at, np.sqrt(runs[at] / max(1, runs.sum()))
    n = len(words)
    code: dict[bytes, int] = {}
    ids = np.fromiter((code.setdefault(w, len(code)) for w in words), dtype=np.int64, count=n)
    for d in range(1, NEAR + 1):
        extra[d] = np.count_nonzero(ids[d:] == ids[:-d]) if n > d else 0
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    extra[16:48] = np.bincount(np.minimum(lengths, 31), minlength=32)
    extra[48] = _repeats(ids, len(code))
    lines = [x for x in text.split(b"\n") if x.split()]
    extra[49] = 4 * (len(lines) - len(set(lines)))
    extra[50] = np.bincount(ids).max()
    extra[51] = n - len(code)
    extra[64 + min(15, int(np.log2(n)))] = n
    known = {} if known is None else known
    hashes = np.array([known.get(w) or known.setdefault(w, xxhash.xxh64_intdigest(w, 3)) for w in code], dtype=np.uint64)[ids]
    pairs = hashes[:-1] * _MIX + hashes[1:]
    pairs = (pairs ^ (pairs >> np.uint64(31))) * _MIX
    own = [np.concatenate([runs, extra]), np.bincount((hashes >> np.uint64(53)).astype(np.int64), minlength=PLACES), np.bincount((pairs >> np.uint64(53)).astype(np.int64), minlength=PLACES)]
    share = np.concatenate([x * (part / max(1, x.sum())) for x, part in zip(own, (1.0, VOCABULARY**2 / 2, VOCABULARY**2 / 2))])
    at = np.flatnonzero(share)
    return at, np.sqrt(share[at])


def _repeats(ids: np.ndarray, size: int) -> int:
    """Runs of four words that came before in the text."""
    if len(ids) < 5:
        return 0
    pair = np.unique(ids[:-1] * np.int64(size) + ids[1:], return_inverse=True)[1]
    four = np.unique(pair[:-2] * np.int64(len(ids)) + pair[2:])
    return len(ids) - 3 - len(four)


@dataclass
class Space:
    """The latent space and the labelled vectors in it. ``column`` places a term in the matrix, or is -1."""

    column: np.ndarray
    weight: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, texts: Sequence[bytes], known: dict[bytes, int] | None = None) -> np.ndarray:
        return _unit((matrix([terms(t, known) for t in texts], self.column, len(self.weight)) * self.weight) @ self.directions)


def matrix(found: Sequence[tuple[np.ndarray, np.ndarray]], column: np.ndarray, width: int) -> np.ndarray:
    """Damped shares of the known terms, one row per text."""
    out = np.zeros((len(found), width), dtype=np.float32)
    for row, (at, share) in zip(out, found):
        known = column[at] >= 0
        row[column[at[known]]] = share[known]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def leading(x: np.ndarray, dims: int) -> np.ndarray:
    """The leading right singular directions of ``x``, by subspace rounds from a fixed start."""
    width = min(dims + SPARE, *x.shape)
    q = np.linalg.qr(np.random.default_rng(1).normal(size=(x.shape[1], width)).astype(np.float32))[0]
    for _ in range(ROUNDS):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, turned = np.linalg.svd(x @ q, full_matrices=False)
    return np.ascontiguousarray((q @ turned.T)[:, :dims], dtype=np.float32)


def fit_terms(found: Sequence[tuple[np.ndarray, np.ndarray]], labels: Sequence[int], dims: int = DIMS) -> Space:
    """Terms of ``LEAST`` labelled texts or more span the space."""
    seen = np.bincount(np.concatenate([at for at, _ in found]), minlength=_TERMS) if found else np.zeros(_TERMS, dtype=np.int64)
    used = np.flatnonzero(seen >= min(LEAST, len(found))) if found else np.empty(0, dtype=np.int64)
    used = used[seen[used] > 0]
    column = np.full(_TERMS, -1, dtype=np.int64)
    column[used] = np.arange(len(used))
    weight = (np.log((1 + len(found)) / (1 + seen[used])) + 1).astype(np.float32)
    x = matrix(found, column, len(used)) * weight
    directions = leading(x, dims) if len(used) else np.zeros((0, 0), np.float32)
    return Space(column, weight, directions, _unit(x @ directions), np.array(labels, dtype=np.float64))


def fit(texts: Sequence[bytes], labels: Sequence[int], dims: int = DIMS) -> Space:
    return fit_terms([terms(t) for t in texts], labels, dims)


def votes(space: Space, texts: Sequence[bytes], k: int = NEIGHBOURS, known: dict[bytes, int] | None = None) -> np.ndarray:
    """Score of label 1 per text."""
    labels = space.labels
    if not len(labels) or labels.min() == labels.max():
        return np.full(len(texts), labels[0] if len(labels) else 0.5)
    k = min(k, len(labels))
    out = np.empty(len(texts))
    for b in range(0, len(texts), BLOCK):
        near = space.project(texts[b:b + BLOCK], known) @ space.vectors.T
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, top, axis=1), 0.0).astype(np.float64) ** 4
        total = weight.sum(axis=1)
        good = (weight * labels[top]).sum(axis=1)
        out[b:b + BLOCK] = np.where(total > 0, good / np.where(total > 0, total, 1.0), 0.0)
    return np.clip(out, 0.0, 1.0)


_PARTS = ("column", "weight", "directions", "vectors", "labels")


def learn(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, dims: int = DIMS) -> Space:
    """Fit on the ``sample_rows`` rows of ``labels`` with the smallest hash of their id, the same at every run."""
    chosen = (
        labels.where(F.col(label_col).isNotNull()).select(F.xxhash64(F.col(id_col).cast("string")).alias("_h"), F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
        .orderBy("_h", "_id", "_label").limit(sample_rows)
    )
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = texts.join(F.broadcast(chosen), "_id").select("_h", "_label", "_text").orderBy("_h", "_label", "_text").limit(sample_rows)  # one ordered partition

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, ys = [], []
        for batch in slices(batches, "_text"):
            known: dict[bytes, int] = {}
            found += [(at.astype(np.int32), share.astype(np.float32)) for at, share in (terms(t, known) for t in as_bytes(batch, "_text"))]
            ys += batch.column(1).to_pylist()
        space = fit_terms(found, ys, dims)
        arrays = [getattr(space, p) for p in _PARTS]
        yield pa.RecordBatch.from_arrays(
            [pa.array(_PARTS), pa.array([str(a.dtype) for a in arrays]), pa.array([list(a.shape) for a in arrays], pa.list_(pa.int64())), pa.array([a.tobytes() for a in arrays], pa.binary())],
            names=["part", "kind", "shape", "data"])

    made = {r["part"]: np.frombuffer(bytes(r["data"]), dtype=r["kind"]).reshape(r["shape"]) for r in rows.mapInArrow(run, "part string, kind string, shape array<long>, data binary").collect()}
    return Space(*[made[p] for p in _PARTS]) if made else fit_terms([], [], dims)


def score(docs: DataFrame, space: Space, text_col: str = "text", k: int = NEIGHBOURS, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Add the score (double) and the prediction (int, score of a half or more) to every row, under ``names``."""
    sent = docs.sparkSession.sparkContext.broadcast(space)  # bounded: see sample_rows and dims
    known: dict[bytes, int] = {}

    def make(batch: pa.RecordBatch) -> dict:
        if len(known) > KNOWN_WORDS:
            known.clear()
        s = votes(sent.value, as_bytes(batch, text_col), k, known)
        return {names[0]: s, names[1]: (s >= 0.5).astype(np.int32)}

    return map_texts(docs, make, f"{names[0]} double, {names[1]} int", text_col)
