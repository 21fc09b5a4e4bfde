"""Quality classifier: a factorisation machine over hashed words, statistics of structure, and metadata.

score = sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pair sum is computed in linear time as
half of sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marginalia.llm.common import schema_of, without
from marginalia.llm.labelled import bag, sample, sigmoid

BUCKETS = 1 << 14
_UPPER, _SYMBOL, _SPACES = re.compile("[A-ZÀ-ÖØ-Þ]"), re.compile(r"[^\w\s]"), re.compile(r"\s")


def structure(text: str, words: int, distinct: int, letters: int) -> list[float]:
    """Statistics of structure and metadata, each about 0 to 1."""
    n = len(text) or 1
    lines = text.split("\n")
    symbols = len(_SYMBOL.findall(text))
    return [
        min(1.0, np.log1p(len(text)) / 12), min(1.0, np.log1p(words) / 10), min(1.0, np.log1p(len(lines)) / 8),
        len(_UPPER.findall(text)) / n, symbols / n, len(_SPACES.findall(text)) / n, letters / n,
        distinct / words if words else 0.0, len(set(lines)) / len(lines), min(1.0, n / len(lines) / 400),
        min(1.0, symbols / (words or 1)), min(1.0, letters / (words or 1) / 12),
    ]


STATISTICS = 12


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: word buckets by damped count with length 1, then the statistics."""
    words = bag(text)
    at = np.fromiter((zlib.crc32(w.encode()) % BUCKETS for w in words), np.int32, len(words))
    value = np.log1p(np.fromiter(words.values(), np.float64, len(words)))
    at, where = np.unique(at, return_inverse=True)
    value = np.bincount(where, value, len(at)) if len(at) else value
    length = np.sqrt((value**2).sum()) or 1.0
    stats = structure(text, sum(words.values()), len(words), sum(len(w) * n for w, n in words.items()))
    return (np.concatenate([at, np.arange(BUCKETS, BUCKETS + STATISTICS)]).astype(np.int32),
            np.concatenate([value / length, stats]).astype(np.float32))


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def raw(self, at: np.ndarray, x: np.ndarray) -> float:
        v = self.factor[at] * x[:, None]
        s = v.sum(axis=0)
        return float(self.bias + self.weight[at] @ x + 0.5 * (s @ s - (v * v).sum()))

    def score(self, text: str) -> float:
        return float(sigmoid(np.array(self.raw(*features(text)))))


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], rank: int = 8, epochs: int = 8, rate: float = 0.08, l2: float = 1e-4, seed: int = 7) -> Machine:
    """Mini-batch AdaGrad on log loss."""
    size = BUCKETS + STATISTICS
    rng = np.random.default_rng(seed)
    share = np.clip(np.mean([y for y, _, _ in rows]) if rows else 0.5, 0.01, 0.99)
    m = Machine(float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.02, (size, rank)))
    g_b, g_w, g_v = 1e-6, np.full(size, 1e-6), np.full((size, rank), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), 64):
            part = [rows[i] for i in order[a : a + 64]]
            y = np.array([r[0] for r in part], float)
            starts = np.cumsum([0, *(len(r[1]) for r in part[:-1])])
            at, x = np.concatenate([r[1] for r in part]), np.concatenate([r[2] for r in part]).astype(float)
            row = np.repeat(np.arange(len(part)), [len(r[1]) for r in part])
            vx = m.factor[at] * x[:, None]
            s = np.add.reduceat(vx, starts)
            raw = m.bias + np.add.reduceat(m.weight[at] * x, starts) + 0.5 * ((s * s).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), starts))
            error = (sigmoid(raw) - y) / len(part)
            used, where = np.unique(at, return_inverse=True)
            d_w = np.bincount(where, error[row] * x, len(used)) + l2 * m.weight[used]
            d_v = np.zeros((len(used), rank))
            np.add.at(d_v, where, (error[row] * x)[:, None] * (s[row] - vx))
            d_v += l2 * m.factor[used]
            g_b += error.sum() ** 2
            g_w[used] += d_w**2
            g_v[used] += d_v**2
            m.bias -= rate * error.sum() / np.sqrt(g_b)
            m.weight[used] -= rate * d_w / np.sqrt(g_w[used])
            m.factor[used] -= rate * d_v / np.sqrt(g_v[used])
    return m


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 4_000, *, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """Learn from at most `most` labelled documents (whole texts). Without labels every score is one half."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array([a.tobytes() for a, _ in pairs], pa.binary()), pa.array([x.tobytes() for _, x in pairs], pa.binary())],
                names=["label", "at", "x"])

    rows = sample(docs, labels, label, most, id_col=id_col, text_col=text_col).mapInArrow(extract, "label int, at binary, x binary")
    found = [(r.label, np.frombuffer(r.at, np.int32), np.frombuffer(r.x, np.float32)) for r in rows.toLocalIterator()]
    return train(sorted(found, key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes())))


def score(docs: DataFrame, machine: Machine, *, text_col: str = "text") -> DataFrame:
    """`docs` plus score (0 to 1). Null and empty texts are scored by their statistics alone; long texts are read whole;
    repeated rows score alike. An input column called score is replaced."""
    docs = without(docs, "score")
    names = docs.columns
    held = docs.sparkSession.sparkContext.broadcast(machine)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [held.value.score(t or "") for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, pa.float64())], names=[*names, "score"])

    return docs.mapInArrow(rate, schema_of(docs, score="double"))
