"""Embedding whitening by a two-pass covariance.

The first pass sums the entries as integers, which is exact in any order and gives the mean; the second centres each entry
and sums outer products block by block (one GEMM each). Every task ends with one row, a vector or a matrix; treeAggregate
merges these on executors, so the driver gets one matrix. LAPACK's symmetric eigh runs on the driver over a matrix whose size
is the dimension, whatever the number of rows; the chosen components are broadcast and project all rows in a last pass.
A third pass measures the covariance of what the last one will return.

An entry c, as double, becomes the integer x = floor(1024 c) + 100000 (see `Grid`). Centred entries are (x - b) - r / n for b and r the
quotient and remainder of the sum by n, so nothing large is subtracted in floating point.

Edge cases: rows whose vector is null, empty, or holds null or non-finite entries are dropped. Vectors of different length have no
common covariance: the commonest length is the fit list's (the longest of equally common ones), others are dropped too. Integers
stop at 2^61 either way. Repeated rows and null vec_ids count as rows. Directions without variance (all of them for one row or equal rows)
can't be whitened: their `whitened` is null and `explained` 0, or null where nothing varies at all, and they are left out of `identity_error`, which is null if none is
left. A deviation of over 38 digits is null, and in the query one beyond a long. An empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import common

#: Entries that are worked on at a time.
BLOCK = 1 << 19
FAR = 1 << 61
COMPONENTS = 8

Batches = Iterator[pa.RecordBatch]


class Grid(NamedTuple):
    """Entries as integers: floor(scale * c) + shift."""

    scale: int = 1024
    shift: int = 100_000

    def integers(self, c: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.clip(np.floor(c * float(self.scale)), -FAR, FAR).astype(np.int64) + self.shift


class Fit(NamedTuple):
    """What all rows share. The mean is base + rest / n; a component's row of `project` is its unit vector over the root of its eigenvalue."""

    n: int
    dim: int
    base: np.ndarray
    rest: np.ndarray
    project: np.ndarray
    explained: np.ndarray
    flat: np.ndarray


def _blocks(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(vec_id, entries) of the batch's vectors of this length that hold only finite numbers, a block at a time."""
    ids, vectors = batch.column(0), batch.column(1)
    at = np.flatnonzero(pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False) == dim)
    step = max(1, BLOCK // dim)
    for i in range(0, len(at), step):
        some = pa.array(at[i : i + step])
        c = vectors.take(some).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)  # a null becomes a NaN
        ok = np.isfinite(c).all(axis=1)
        yield ids.take(some).filter(pa.array(ok)), c[ok]


def _rows(vectors: DataFrame) -> DataFrame:
    kind = dict(vectors.dtypes)["embedding"]
    e = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding"))


def _length(rows: DataFrame) -> int | None:
    """The commonest length among vectors of finite numbers, the longest of equals; none if there is no such vector."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths[lengths > 0]).tolist():
                n = sum(len(c) for _, c in _blocks(batch, dim))
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int64()), pa.array([n], pa.int64())], ["dim", "n"])

    by = rows.mapInArrow(common.lean(run), "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).where("n > 0")
    found = by.orderBy(F.desc("n"), F.desc("dim")).first()
    return found and found["dim"]


def _merged(rows: DataFrame, partial: Callable[[Batches], bytes | None], merge: Callable[[bytes, bytes], bytes]) -> bytes | None:
    """What the tasks' partial results, one a task, merge into."""

    def run(batches: Batches) -> Batches:
        if (got := partial(batches)) is not None:
            yield pa.RecordBatch.from_arrays([pa.array([got], pa.binary())], ["state"])

    def both(a: bytes | None, b: bytes | None) -> bytes | None:
        return b if a is None else a if b is None else merge(a, b)

    states = rows.mapInArrow(common.lean(run), "state binary").rdd.map(lambda r: bytes(r["state"]))
    return states.treeAggregate(None, both, both, depth=3)


def _packed(x: np.ndarray) -> bytes:
    return x.astype("<f8").tobytes()


def _matrix(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, "<f8").reshape(-1, dim)


def sums(rows: DataFrame, dim: int, grid: Grid) -> tuple[int, list[int]]:
    """The number of vectors, and the sum of each dimension's integers."""
    half = 32

    def partial(batches: Batches) -> bytes | None:
        n, total = 0, [0] * dim
        for batch in batches:
            for _, c in _blocks(batch, dim):
                x = grid.integers(c)
                # halves, so that a block's sums can't overflow
                high, low = (x >> half).sum(axis=0).tolist(), (x & ((1 << half) - 1)).sum(axis=0).tolist()
                total = [t + (h << half) + lo for t, h, lo in zip(total, high, low, strict=True)]
                n += len(c)
        return " ".join(map(str, [n, *total])).encode() if n else None

    def merge(a: bytes, b: bytes) -> bytes:
        return " ".join(str(int(x) + int(y)) for x, y in zip(a.split(), b.split(), strict=True)).encode()

    n, *total = map(int, _merged(rows, partial, merge).split())
    return n, total


def _centred(x: np.ndarray, fit: Fit) -> np.ndarray:
    return (x - fit.base).astype(np.float64) - fit.rest / fit.n


def covariance(rows: DataFrame, fit: Fit, grid: Grid) -> np.ndarray:
    """The covariance of the integers, divisor n."""
    dim = fit.dim

    def partial(batches: Batches) -> bytes | None:
        total = None
        for batch in batches:
            for _, c in _blocks(batch, dim):
                y = _centred(grid.integers(c), fit)
                total = y.T @ y if total is None else total + y.T @ y
        return None if total is None else _packed(total)

    total = _matrix(_merged(rows, partial, lambda a, b: _packed(_matrix(a, dim) + _matrix(b, dim))), dim)
    v = total / fit.n
    return (v + v.T) / 2


def components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit eigenvectors as rows by falling eigenvalue, their eigenvalues, and which of these are zero up to rounding.

    A vector's largest entry is positive."""
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most], u[:, ::-1].T[:most]
    top = u[np.arange(len(u)), np.abs(u).argmax(axis=1)]
    flat = e <= max(0.0, float(e[0])) * len(v) * np.finfo(float).eps * 4
    return u * np.where(top < 0, -1.0, 1.0)[:, None], e, flat


def _whitened(x: np.ndarray, fit: Fit) -> np.ndarray:
    return _centred(x, fit) @ fit.project.T


def identity_error(rows: DataFrame, fit: Fit, grid: Grid) -> float | None:
    """The largest entry by which the covariance of the whitened rows differs from the identity.

    A state is the count, the mean and the sum of outer products centred on that mean; two of them merge with the outer product of their means' difference."""
    use = np.flatnonzero(~fit.flat)
    if not len(use):
        return None
    k = len(use)

    def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n, m, away = a[0, 0], b[0, 0], b[1] - a[1]
        return np.vstack([np.full(k, n + m), a[1] + away * (m / (n + m)), a[2:] + b[2:] + np.outer(away, away) * (n * m / (n + m))])

    def partial(batches: Batches) -> bytes | None:
        state = None
        for batch in batches:
            for _, c in _blocks(batch, fit.dim):
                if len(c):
                    w = _whitened(grid.integers(c), fit)[:, use]
                    mean = w.mean(axis=0)
                    one = np.vstack([np.full(k, len(w)), mean, (w - mean).T @ (w - mean)])
                    state = one if state is None else merged(state, one)
        return None if state is None else _packed(state)

    state = _matrix(_merged(rows, partial, lambda a, b: _packed(merged(_matrix(a, k), _matrix(b, k)))), k)
    return float(np.abs(state[2:] / fit.n - np.eye(k)).max())


def deviations(x: np.ndarray, fit: Fit) -> list[int]:
    """For each row the sum over dimensions of (n x - S)^2, exactly: n^2 sum(y^2) - 2 n sum(y r) + sum(r^2) for y = x - base."""
    y = x - fit.base
    rest = fit.rest.tolist()
    far = int(np.abs(y).max(initial=0))
    if fit.dim * far * max(far, fit.n) < 1 << 62:  # r < n
        squares, mixed = np.einsum("ij,ij->i", y, y).tolist(), (y @ fit.rest).tolist()
    else:
        squares, mixed = [sum(a * a for a in row) for row in y.tolist()], [sum(a * r for a, r in zip(row, rest, strict=True)) for row in y.tolist()]
    own = sum(r * r for r in rest)
    return [fit.n * (fit.n * s - 2 * m) + own for s, m in zip(squares, mixed, strict=True)]


def fitted(vectors: DataFrame, most: int = COMPONENTS, grid: Grid | None = None) -> Fit | None:
    """The mean and components of vectors(embedding); none if no vector is left."""
    rows, grid = _rows(vectors), grid or Grid()
    dim = _length(rows)
    if dim is None:
        return None
    n, total = sums(rows, dim, grid)
    base, rest = np.array([s // n for s in total], np.int64), np.array([s % n for s in total], np.int64)
    fit = Fit(n, dim, base, rest, np.zeros((0, dim)), np.zeros(0), np.zeros(0, bool))
    v = covariance(rows, fit, grid)
    u, e, flat = components(v, most)
    whole = float(np.trace(v))
    project = np.where(flat[:, None], 0.0, u / np.sqrt(np.where(flat, 1.0, e))[:, None])
    return fit._replace(project=project, explained=np.where(flat, 0.0, e) / whole if whole > 0 else np.full(len(e), np.nan), flat=flat)


def whitened(vectors: DataFrame, most: int = COMPONENTS, grid: Grid | None = None) -> DataFrame:
    """(vec_id, component, n, deviation decimal(38,0), whitened, explained, identity_error): a row a vector and component."""
    spark, grid = vectors.sparkSession, grid or Grid()
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    fit = fitted(vectors, most, grid)
    if fit is None:
        return spark.createDataFrame([], schema)
    rows = _rows(vectors)
    error = identity_error(rows, fit, grid)
    shared = spark.sparkContext.broadcast(fit)  # dim * (most + 2) numbers
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Batches) -> Batches:
        fit = shared.value
        k = len(fit.flat)
        explained = [None if np.isnan(x) else x for x in fit.explained.tolist()]
        for batch in batches:
            for ids, c in _blocks(batch, fit.dim):
                x = grid.integers(c)
                m = len(x)
                w = _whitened(x, fit)
                each = pa.array([d if d < 10**38 else None for d in deviations(x, fit)], pa.decimal128(38, 0))
                at = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays([
                    ids.take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, fit.n, np.int64)), each.take(at),
                    pa.array(w.reshape(-1), mask=np.tile(fit.flat, m)), pa.array(explained * m, pa.float64()), pa.array([error] * (m * k), pa.float64()),
                ], names)

    return rows.mapInArrow(common.lean(run), schema)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the first eight components."""
    return whitened(common.table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


QUERIES = {"op13_embedding_whitening": op13_embedding_whitening}
ORACLE: dict[str, str] = {}  # eigenvectors aren't expressible; tests/llm hold the query against numpy on whole matrices
