"""Whitening against whole-matrix numpy, on awkward rows and on no rows."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from riskweave.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, most=8):
    """The contract by whole matrices: {vec_id: (n, deviation, whitened)}, explained."""
    x = np.array([[math.floor(Fraction(1024) * Fraction(float(c))) + 100000 for c in e] for _, e in rows], dtype=object)
    n, s = len(x), x.sum(axis=0)
    dev = [int(sum((n * a - b) ** 2 for a, b in zip(row, s, strict=True))) for row in x]
    y = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(row, s, strict=True)] for row in x])
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    w = y @ u[:, :most] / np.sqrt(e[:most])
    return n, dev, w, e[:most] / e.sum()


def test_against_whole_matrices(spark):
    rng = np.random.default_rng(4)
    mix = rng.normal(size=(12, 12))
    data = [(i, (rng.normal(size=12) @ mix * 0.3).astype(np.float32).tolist()) for i in range(700)]
    data += [(700, data[3][1]), (3, data[3][1])]  # a repeated vector, and a repeated row
    df = spark.createDataFrame([(i, e, 1) for i, e in data], SCHEMA).repartition(7)
    got = whitening.whitened(df).collect()
    n, dev, w, explained = brute(data)
    assert len(got) == 8 * n and {r.n for r in got} == {n}
    rows = {}
    for r in got:
        rows.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    sign = {k: math.copysign(1, rows[0][k][0].whitened * w[0, k - 1]) for k in range(1, 9)}
    for at, (i, _) in enumerate(data):
        for k in range(1, 9):
            for r in rows[i][k]:
                assert int(r.deviation) == dev[at] and abs(r.whitened * sign[k] - w[at, k - 1]) < 1e-9
                assert abs(r.explained / explained[k - 1] - 1) < 1e-9 and r.identity_error < 1e-9
    again = whitening.whitened(df.repartition(3)).collect()
    key = lambda r: (r.vec_id, r.component)
    assert all(abs(a.whitened - b.whitened) < 1e-9 for a, b in zip(sorted(got, key=key), sorted(again, key=key), strict=True))


def test_dropped_rows(spark):
    good = [(i, [random.Random(i).random() for _ in range(3)], 0) for i in range(40)]
    bad = [(100, None, 0), (101, [1.0, None, 2.0], 0), (102, [1.0, float("nan"), 0.0], 0), (103, [float("inf"), 0.0, 0.0], None), (104, [], 0), (105, [1.0, 2.0], 0), (None, [0.5, 0.25, 0.125], None)]
    got = whitening.whitened(spark.createDataFrame(good + bad, SCHEMA)).collect()
    assert len(got) == 3 * 41 and {r.vec_id for r in got} == {*range(40), None} and {r.component for r in got} == {1, 2, 3}
    assert whitening.whitened(spark.createDataFrame([], SCHEMA)).collect() == [] == whitening.whitened(spark.createDataFrame(bad[:5], SCHEMA)).collect()


@pytest.mark.parametrize("rows", [[(1, [0.5, 0.25], 0)], [(1, [0.5, 0.25], 0)] * 3])
def test_without_variance(spark, rows):
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 2 * len(rows) and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in got)


def test_flat_directions(spark):
    """The second dimension follows the first, the third never changes."""
    got = whitening.whitened(spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0], 0) for i in range(9)], SCHEMA)).collect()
    assert [r.whitened is None for r in sorted(got, key=lambda r: (r.vec_id, r.component))] == [False, True, True] * 9
    assert all(r.identity_error < 1e-9 and abs(r.explained - (r.component == 1)) < 1e-9 for r in got)


def test_huge_entries(spark):
    """Sums and deviations stay exact, or are null in so many digits; nothing overflows."""
    data = [(1, [3e18, -3e18]), (2, [-3e18, 1.0]), (3, [1e38, -1e38]), (4, [0.0, 0.0])]
    got = whitening.whitened(spark.createDataFrame([(i, e, 0) for i, e in data], SCHEMA)).collect()
    assert len(got) == 8 and all(np.isfinite(r.whitened) for r in got)
    x = [[min(max(math.floor(1024 * float(np.float32(c))), -whitening.FAR), whitening.FAR) + 100000 for c in e] for _, e in data]
    s = [sum(c) for c in zip(*x, strict=True)]
    for r in got:
        want = sum((4 * a - b) ** 2 for a, b in zip(x[r.vec_id - 1], s, strict=True))
        assert (int(r.deviation) if r.deviation is not None else None) == (want if want < 10**38 else None)


def test_query(spark, tmp_path):
    rng = np.random.default_rng(5)
    data = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(200)]
    spark.createDataFrame([(i, e, None) for i, e in data], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = whitening.op13_embedding_whitening(spark, str(tmp_path))
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    _, dev, _, _ = brute(data)
    assert {(r.vec_id, r.deviation) for r in got.collect()} == set(enumerate(dev))
