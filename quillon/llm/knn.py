"""Quality classifier: votes of nearest labelled documents in a latent-semantic space.

A document is a vector of hashed word counts and, beside it, of hashed word
shapes (letter case, digits, punctuation, repeats), each block log-scaled,
weighted by inverse document frequency and of unit length. A truncated SVD of
the labelled sample gives the latent space. The labelled vectors are broadcast
(``bound`` of ``DIMENSIONS`` floats); every document's cosine to each of them
is computed, blocks of documents at a time, and the ``NEIGHBOURS`` nearest vote with
the ``POWER``-th power of their similarity (near ones count far more than those
at the rim) times the root of how many labelled rows each stands for.

The fit uses at most ``bound`` labelled rows, chosen by hash. Defined results:
a null or wordless text gets the share of label 1; repeated rows get equal
scores; without labelled rows the score is 0.5; an empty table gives an empty
result; other columns pass through ``classify`` unless named as an output.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import map_arrow, worker_cache
from .bpe import Memo

BOUND, DIMENSIONS, NEIGHBOURS, POWER = 4000, 48, 15, 8
WORDS, SHAPES = 2048, 512
_EDGE = re.compile(r"[A-Z]+|[a-z]+|[0-9]+|[^\x00-\x7F]+|(.)\1*", re.S)


def _kind(m: re.Match) -> str:
    c = m[0][0]
    if c.isupper():
        return "A"
    if c.isalpha():
        return "a"
    return "0" if c.isdigit() else c if len(m[0]) == 1 else c + c


def shape(word: str) -> str:
    """Letters become a or A, digits 0, repeats are told from single marks."""
    return re.sub("a+", "a", _EDGE.sub(_kind, word))[:12]


def _cells(word: str) -> int:
    return zlib.crc32(word.lower().encode()) % WORDS * SHAPES + zlib.crc32(shape(word).encode()) % (SHAPES - 2)


def counts(text: str) -> np.ndarray:
    """Counts of words, then of shapes; the last two cells count words and lines that repeat the one before or an earlier one."""
    memo, words = worker_cache("knn", lambda: Memo(_cells, 150_000)), text.split()
    both = np.array([memo[w] for w in words], np.int64)
    out = np.concatenate([np.bincount(both // SHAPES, minlength=WORDS), np.bincount(both % SHAPES, minlength=SHAPES)])
    out[-1] = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines = [x for x in text.split("\n") if x.strip()]
    out[-2] = 5 * (len(lines) - len(set(lines)))
    return out


class Model:
    """Latent space and labelled vectors."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, weights: np.ndarray):
        n = len(x)
        self.prior = float(np.average(labels, weights=weights)) if n else 0.5
        self.idf = np.log((1 + n) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
        self.labels, self.weights = labels.astype(np.float32), weights.astype(np.float32)
        v = self.scaled(x)
        rng = np.random.default_rng(3)
        k = min(DIMENSIONS, n)
        q = rng.standard_normal((n, k + 16)).astype(np.float32)
        for _ in range(4):  # subspace iteration
            q, _ = np.linalg.qr(v @ (v.T @ q))
        _, _, right = np.linalg.svd(q.T @ v, full_matrices=False) if n else (0, 0, np.zeros((0, v.shape[1]), np.float32))
        self.basis = right[:k].T.astype(np.float32)
        self.vectors = self.latent(x)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        v = np.log1p(x, dtype=np.float32) * self.idf
        for a, b in ((0, WORDS), (WORDS, WORDS + SHAPES)):
            v[:, a:b] /= np.maximum(np.linalg.norm(v[:, a:b], axis=1, keepdims=True), 1e-9)
        return v

    def latent(self, x: np.ndarray) -> np.ndarray:
        v = self.scaled(x) @ self.basis
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """For rows of counts; a row of zeros gets the prior."""
        if not len(self.labels):
            return np.full(len(x), self.prior)
        k = min(NEIGHBOURS, len(self.labels))
        cosine = self.latent(x) @ self.vectors.T
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        vote = np.maximum(np.take_along_axis(cosine, near, 1), 0) ** POWER
        # Classes are sampled unevenly; half of the correction keeps the rarer one audible.
        vote = vote * np.sqrt(self.weights[near])
        total = vote.sum(1)
        got = (vote * self.labels[near]).sum(1) / np.maximum(total, 1e-12)
        return np.where((x.sum(1) == 0) | (total <= 1e-12), self.prior, got).astype(float)


def fit(sample: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """From a bounded frame of (id, text, label, weight); the driver gets its count vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [counts(t.as_py() or "") for t in batch["text"]]
            cells = [np.flatnonzero(x) for x in rows]
            cols = [pa.array([c.astype("<u2").tobytes() for c in cells], pa.binary()), pa.array([x[c].astype("<u4").tobytes() for x, c in zip(rows, cells, strict=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], batch["weight"], *cols], names=["id", "label", "weight", "cells", "n"])

    taken = sample.select(F.col(id_col).cast("string").alias("id"), "label", "weight", F.col(text_col).alias("text"))
    rows = map_arrow(taken, run, "id string, label int, weight double, cells binary, n binary").collect()
    rows.sort(key=lambda r: (r["id"], r["label"], r["cells"], r["n"]))
    x = np.zeros((len(rows), WORDS + SHAPES), np.float32)
    for row, r in zip(x, rows, strict=True):
        row[np.frombuffer(r["cells"], "<u2")] = np.frombuffer(r["n"], "<u4")
    return Model(x, np.array([r["label"] for r in rows]), np.array([r["weight"] for r in rows]))


def classify(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Columns of ``df`` but the text, and ``score`` (0 to 1)."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in df.columns if c not in (text_col, "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            scores = []
            for at in range(0, batch.num_rows, 256):
                x = np.array([counts(t.as_py() or "") for t in batch.column(len(rest)).slice(at, 256)])
                scores.append(m.scores(x))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=[*rest, "score"])

    schema = T.StructType([*[df.schema[c] for c in rest], T.StructField("score", T.DoubleType())])
    return map_arrow(df.select(*rest, F.col(text_col).alias("__text")), run, schema)


def accepted(df: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Rows of ``df`` that score ``least`` or more, as they are."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                scores = shared.value.scores(np.array([counts(t.as_py() or "") for t in part.column(at)]))
                yield part.filter(pa.array(scores >= least))

    return map_arrow(df, run, df.schema)
