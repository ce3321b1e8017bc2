"""Quality by Naive Bayes support vectors.

Indicators of n-grams are scaled by the log ratio of their counts in the two classes, and a linear model with hinge loss
is fitted to them by dual coordinate descent. The n-grams are single words, and single word shapes and pairs of them
(runs of lower case, upper case and digits folded, punctuation kept), hashed. A logistic curve over documents kept
apart turns margins into probabilities.

Edge cases: a null or empty text has only the indicator of the empty text; labels that are null or of unknown documents
aren't learnt from; repeated labels of a document count once (the larger); without labels of both classes every score
is the share of good labels (0 without any). Other columns are kept by `scored`, but for one named quality_score, which is replaced. An empty table gives an empty result."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskweave.llm import common
from riskweave.llm.toxicity import logistic

#: Labelled documents to learn from, of each class, at most.
SAMPLE = 6_000
#: Hashed n-grams.
DIM = 1 << 18
SMOOTH = 1.0
COST = 0.1
EPOCHS = 8
THRESHOLD = 0.3
#: Words whose hash and shape a worker remembers.
CACHE = 200_000

_FOLD = [(re.compile(p), s) for p, s in ((r"[^\W\d_A-Z]+", "a"), (r"[A-Z]+", "A"), (r"\d+", "9"))]


def _slot(kind: bytes, text: str) -> int:
    return zlib.crc32(text.encode(), zlib.crc32(kind)) % DIM


class Grams:
    """Indicators of a text, with a bounded memory of words."""

    def __init__(self) -> None:
        self.words: dict[str, tuple[int, str]] = {}
        self.pairs: dict[tuple[str, str], int] = {}

    def word(self, w: str) -> tuple[int, str]:
        got = self.words.get(w)
        if got is None:
            shape = w
            for p, s in _FOLD:
                shape = p.sub(s, shape)
            if len(self.words) >= CACHE:
                self.words.clear()
            got = self.words[w] = (_slot(b"w", w.lower()), shape)
        return got

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        if not words:
            return np.array([_slot(b"e", "")])
        pairs = list(map(self.word, words))
        shapes = [s for _, s in pairs]
        out = {i for i, _ in pairs}
        for ab in {*zip(shapes, shapes[1:], strict=False), *((s, "") for s in shapes)}:
            got = self.pairs.get(ab)
            if got is None:
                if len(self.pairs) >= CACHE:
                    self.pairs.clear()
                got = self.pairs[ab] = _slot(b"s", "\x00".join(ab))
            out.add(got)
        return np.fromiter(out, np.int64, len(out))


@dataclass
class Model:
    weights: np.ndarray | None = None
    bias: float = 0.0
    a: float = 0.0
    b: float = 0.0
    base: float = 0.0

    def probability(self, idx: np.ndarray) -> float:
        if self.weights is None:
            return self.base
        x = self.a + self.b * (float(self.weights[idx].sum()) / np.sqrt(len(idx)) + self.bias)
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def descend(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss with an L2 penalty over scale * indicators / sqrt(their number); the last coordinate is a bias."""
    w, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    vals = [scale[i] / np.sqrt(len(i)) for i in rows]
    q = np.array([float(v @ v) + 1.0 for v in vals])
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for k in order.permutation(len(rows)):
            i, v = rows[k], vals[k]
            grad = y[k] * (float(w[i] @ v) + bias) - 1
            new = min(max(alpha[k] - grad / q[k], 0.0), COST)
            step = (new - alpha[k]) * y[k]
            if step:
                alpha[k] = new
                w[i] += step * v
                bias += step
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, train=None) -> Model:
    """Learns from a bounded sample of the labelled documents for which `train`, a condition on labels, holds."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (F.lit(True) if train is None else train)).groupBy("doc_id").agg(F.max("quality").alias("y"))
    key = F.xxhash64(F.col("doc_id"), F.lit("quality"))
    some = [known.where(F.col("y") == y).orderBy(key, "doc_id").limit(SAMPLE) for y in (0, 1)]
    known = common.written(some[0].unionByName(some[1]).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("y").cast("int").alias("y")), "quality-sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in common.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([grams.of(t).astype("<i4").tobytes() for t in batch.column(0).to_pylist()], pa.binary())], ["doc_id", "y", "idx"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    got = sorted(own.select("text", "doc_id", "y").mapInArrow(run, "doc_id long, y int, idx binary").collect())  # at most 2 * SAMPLE documents
    y = np.array([r[1] for r in got])
    m = Model(base=float(y.mean()) if len(y) else 0.0)
    if len(set(y.tolist())) < 2:
        return m
    rows = [np.frombuffer(r[2], "<i4").astype(np.int64) for r in got]
    aside = np.array([zlib.crc32(str(r[0]).encode(), 5) % 4 == 0 for r in got])
    fitting = np.flatnonzero(~aside) if len(set(y[aside].tolist())) == 2 and len(set(y[~aside].tolist())) == 2 else np.arange(len(got))
    counts = [np.full(DIM, SMOOTH), np.full(DIM, SMOOTH)]
    for k in fitting:
        counts[y[k]][rows[k]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    w, bias = descend([rows[k] for k in fitting], np.where(y[fitting] == 1, 1.0, -1.0), ratio)
    m.weights, m.bias = (w * ratio).astype(np.float32), bias
    rest = np.flatnonzero(aside) if len(fitting) < len(got) else fitting
    margin = np.array([m.weights[rows[k]].sum() / np.sqrt(len(rows[k])) + bias for k in rest])
    # the sample is balanced between the classes; the curve is fitted to the shares among all labels
    share = labels.where(F.col("quality").isin(0, 1) & (F.lit(True) if train is None else train)).groupBy("quality").count().collect()
    total = {r["quality"]: r["count"] for r in share}
    weight = np.array([total[int(v)] / max(1, int((y[rest] == v).sum())) for v in y[rest]])
    a, b = _weighted(margin, y[rest].astype(float), weight / weight.mean())
    m.a, m.b = a, max(b, 1e-6)
    return m


def _weighted(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    z = np.stack([np.ones(len(x)), x], axis=1) * np.sqrt(weight)[:, None]
    if np.allclose(weight, 1):
        a, b = logistic(z, y)
        return float(a), float(b)
    z, w = np.stack([np.ones(len(x)), x], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w = w - np.linalg.solve(z.T @ (z * (weight * p * (1 - p))[:, None]) + 1e-2 * np.eye(2), z.T @ (weight * (p - y)) + 1e-2 * w)
    return float(w[0]), float(w[1])


def scored(docs: DataFrame, m: Model) -> DataFrame:
    """docs with quality_score added; a column of that name is replaced."""
    docs = docs.drop("quality_score")
    names, schema = docs.columns, StructType([*docs.schema.fields]).add("quality_score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in common.slices(batches, "text"):
            score = [m.probability(grams.of(t)) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*names, "quality_score"])

    return docs.mapInArrow(run, schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: learns from the rows whose crc32 modulo 5 isn't 0."""
    docs, labels = common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "labels")
    got = scored(docs, fit(docs, labels, common.fold(5) != 0))
    score = F.col("quality_score")
    return got.select("doc_id", (common.fold(5) == 0).alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op3_quality": op3_quality}
ORACLE: dict[str, str] = {}
