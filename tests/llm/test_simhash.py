"""The positional index: long lists dealt out by a further byte or in blocks, against brute force over all pairs."""

import itertools

import numpy as np
import pytest

from riskweave.llm import common, simhash


def roots(n, links):
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, links[:, 0], label[links[:, 1]])
        np.minimum.at(low, links[:, 1], label[links[:, 0]])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def nodes(spark, fps):
    return spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(fps)], "id long, fp binary").repartition(4)


def found(edges, n):
    got = common.components(edges.select("a", "b")).toPandas()
    label = np.arange(n)
    label[got["node"].to_numpy(dtype=int)] = got["root"].to_numpy(dtype=int)
    return label


def test_cover():
    for n, d in ((8, 2), (8, 1), (6, 2), (5, 3)):
        sets = simhash.byte_sets(n, d)
        assert all(any(not set(gone) & set(s) for s in sets) for gone in itertools.combinations(range(n), d))


@pytest.mark.parametrize("block", [64, 4096])
def test_exact_links_of_a_dense_group(spark, monkeypatch, block):
    """2,000 fingerprints that differ in three of eight bytes, beside some at random and some at 2 and 3 bits from them."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "PROBE", 1)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    bit = lambda k: np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (300, k)).astype(np.uint64), axis=1)
    dense = base[0] ^ (rng.integers(0, 2**10, 2000, dtype=np.uint64) | (rng.integers(0, 16, 2000, dtype=np.uint64) << np.uint64(20)))
    fps = np.unique(np.concatenate([base, base ^ bit(2), base ^ bit(3), dense]))
    edges = simhash.exact_candidates(nodes(spark, fps), 8, 2)
    i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2, 1))
    assert (found(edges, len(fps)) == roots(len(fps), np.stack([i, j], axis=1))).all()
    assert edges.count() < 8 * len(fps)


@pytest.mark.parametrize("block", [100, 4096])
def test_candidates_of_a_dense_group(spark, monkeypatch, block):
    """The forests connect what all pairs of all lists do, and their rows don't grow with the square of a list."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "PROBE", 1)
    monkeypatch.setattr(simhash, "FIRST", 2)
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 2**63, (3, 4), dtype=np.uint64)
    flips = np.packbits(rng.random((1500, 256)) < 0.06, axis=1).view("<u8")
    fps = centre[rng.integers(0, 3, 1500)] ^ flips
    sets = simhash.byte_sets(32, None)[:6]
    edges = simhash.similar_candidates(nodes(spark, fps), sets, 40)
    diff = fps[:, None, :] ^ fps[None, :, :]
    same = diff.view(np.uint8).reshape(1500, 1500, 32) == 0
    share = np.zeros((1500, 1500), bool)
    for p, q in sets:
        share |= same[:, :, p] & same[:, :, q]
    i, j = np.nonzero(np.triu(share & (np.bitwise_count(diff).sum(axis=2) <= 40), 1))
    assert len(i) > 10_000
    assert (found(edges, 1500) == roots(1500, np.stack([i, j], axis=1))).all()
    assert edges.count() < 4 * 1500


@pytest.mark.parametrize(("block", "most_grouped"), [(4096, 1 << 18), (4096, 150), (90, 1 << 18)])
def test_groups_of_a_byte(spark, monkeypatch, block, most_grouped):
    """Rows move once a byte that pairs have in common, and what is found is the same whether none, some or all groups go list by list."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "GROUPED", most_grouped)
    monkeypatch.setattr(simhash, "PROBE", 1)
    rng = np.random.default_rng(3)
    dense = rng.integers(0, 2**63, (1, 4), dtype=np.uint64) ^ np.packbits(rng.random((300, 256)) < 0.04, axis=1).view("<u8")
    base = rng.integers(0, 2**63, (500, 4), dtype=np.uint64)
    fps = np.concatenate([dense, base, base[:200] ^ np.packbits(rng.random((200, 256)) < 0.1, axis=1).view("<u8")])
    sets = simhash.byte_sets(32, None)
    moved = []
    pairs = simhash.pairs
    monkeypatch.setattr(simhash, "pairs", lambda blocks, *x: moved.append(blocks.count()) or pairs(blocks, *x))
    edges = simhash.similar_candidates(nodes(spark, fps), sets, 40)
    diff = fps[:, None, :] ^ fps[None, :, :]
    same = diff.view(np.uint8).reshape(len(fps), len(fps), 32) == 0
    share = np.zeros((len(fps), len(fps)), bool)
    for p, q in sets:
        share |= same[:, :, p] & same[:, :, q]
    i, j = np.nonzero(np.triu(share & (np.bitwise_count(diff).sum(axis=2) <= 40), 1))
    assert (found(edges, len(fps)) == roots(len(fps), np.stack([i, j], axis=1))).all() and len(i) > 10_000
    if block == 4096 and most_grouped > len(fps):
        assert sum(moved) < len(sets) * len(fps) / 3
    for some in (range(8), range(8, 96)):
        at = simhash.pivots(sets, some)
        assert sorted(i for x in at.values() for i in x) == list(some) and all(p in sets[i] for p, x in at.items() for i in x)


def test_texts_do_not_move(spark, docs, monkeypatch):
    """Copies are left out where texts are read, also if Spark by itself would join them by key."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plain = docs.dropDuplicates(["doc_id"])
        left = simhash.dedup(common.written(plain, "docs"))
        assert "Exchange hashpartitioning" not in left._jdf.queryExecution().executedPlan().toString()
        got = sorted(r.doc_id for r in left.where("doc_id is not null").collect())
        monkeypatch.setattr(simhash, "PICKED", 0)
        assert got == sorted(r.doc_id for r in simhash.dedup(common.written(plain, "docs")).where("doc_id is not null").collect())
        assert 1 in got and 2 not in got
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
