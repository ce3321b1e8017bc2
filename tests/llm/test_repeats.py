"""Suffix sorting and repeats of bytes against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from riskweave.llm import induced, repeats

SCHEMA = "doc_id long, text string, bytes string, key long"


def brute(texts, length):
    """{doc index: (bytes, removed, spans, digest)}"""
    raw, at = [(t or "").encode() for t in texts], defaultdict(list)
    for d, b in enumerate(raw):
        for i in range(len(b) - length + 1):
            at[b[i : i + length]].append((d, i))
    gone = [np.zeros(len(b) + 1, bool) for b in raw]
    for places in at.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + length] = True
    return [(len(b), int(g.sum()), int((g & ~np.roll(g, 1)).sum()), hashlib.sha256(bytes(x for x, y in zip(b, g, strict=False) if not y)).hexdigest()) for b, g in zip(raw, gone, strict=True)]


@pytest.mark.parametrize(("block", "base"), [(1 << 16, 0), (7, 0), (7, 6), (1 << 16, 1 << 20)])
def test_suffixes(monkeypatch, block, base):
    """Suffixes are in the order of their first cap characters; seeds beyond the base are sorted by recursion."""
    monkeypatch.setattr(induced, "BLOCK", block)
    monkeypatch.setattr(induced, "BASE", base)
    rng = random.Random(block)
    for r in range(300):
        n, k, cap = rng.randint(1, 60), rng.choice([2, 3, 5, 50]), rng.choice([3, 7, 100])
        x = [rng.randint(1, k) for _ in range(n)] if r % 5 else ([1, 2, 1, 1, 2] * 20)[:n]
        t = [*x, 0]
        lists = induced.sorted_suffixes(np.array(t, np.int16), max(k, 2) + 1, cap, induced.Scratch(0 if r % 3 == 0 else 1 << 20))
        pos, shared = induced._interleaved(np.array(t), *lists[0], *lists[1], cap)
        assert sorted(pos.tolist()) == list(range(len(t))) and (prefixes := [t[i : i + cap] for i in pos.tolist()]) == sorted(prefixes)
        for a, b, got in zip(pos[:-1], pos[1:], shared[1:], strict=True):
            want = next((i for i in range(cap) if t[a + i : a + i + 1] != t[b + i : b + i + 1]), cap)
            assert got == want


def corpus(rng, length):
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, other = text(length // 2), text(length // 2)
    out = [None, "", "short", "x" * (length * 4), "y" * (length + 3) + text(30), "ab" * length, text(20) + "ab" * length, passage, passage, passage + "!"]
    out += [text(rng.randint(0, 60)) + " " + passage[rng.randint(0, 20) :] + " " + text(rng.randint(0, 60)) for _ in range(12)]
    out += [text(10) + other + text(8) + other + text(3), text(300), text(300)]
    return out


@pytest.mark.parametrize(("most", "unit", "memory"), [(2048, 1 << 20, 4 << 20), (1, 1 << 20, 0), (3, 256, 1 << 20)])
def test_against_brute_force(spark, monkeypatch, most, unit, memory):
    """Also with every key cut, with texts read in small parts, and with all arrays in files."""
    monkeypatch.setattr(repeats, "MOST", most)
    monkeypatch.setattr(repeats, "UNIT", unit)
    sharded = repeats.sharded
    monkeypatch.setattr(repeats, "sharded", lambda a, b, c: sharded(a, b, c, memory))
    length = 64
    texts = corpus(random.Random(most), length)
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), r.kept_sha256) for r in repeats.deduplicated(df, length).collect()}
    want = brute(texts, length)
    assert got == dict(enumerate(want)) and sum(w[1] > 0 for w in want) > 10


def test_query(spark, tmp_path):
    rng = random.Random(5)
    texts = corpus(rng, repeats.LENGTH) + ["".join(rng.choice("pq ") for _ in range(3000))] * 2
    spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(texts)] + [(3, texts[3])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = repeats.op12_suffix_dedup(spark, str(tmp_path))
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}
    want = [(i if i % 7 else None, *b) for (i, _), b in zip([*enumerate(texts), (3, "")], brute([*texts, texts[3]], repeats.LENGTH), strict=True)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repeats.deduplicated(none).collect() == []
    assert [tuple(r) for r in repeats.deduplicated(spark.createDataFrame([(1, None, "", 1)], SCHEMA)).select("doc_id", "n_bytes", "spans").collect()] == [(1, 0, [])]
