"""The conversation trie against a plain dictionary and against its SQL, on awkward rows, long conversations and no rows."""

import hashlib
import os
import random
import zlib

import pytest

from riskweave.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, c string"
DIR = "/root/testdata/sf0.001"


def brute(rows):
    """{(conv_id, depth): (parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)}; ties in turn and role must be equal rows."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    members, ends = {}, {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = convs.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])
        s = tuple(base[:h] + own[h:])
        for d in range(len(s) + 1):
            members.setdefault(s[:d], set()).add(c)
        ends.setdefault(s, set()).add(c)
    kids, leaves, saved = ({k: 0 for k in members} for _ in range(3))
    for k, m in members.items():
        if k:
            kids[k[:-1]] += 1
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    sha = lambda k: hashlib.sha256(",".join(map(str, sorted(ends.get(k, ())))).encode()).hexdigest()
    return {(min(m), len(k)): (min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], sha(k)) for k, m in members.items()}


def check(spark, rows):
    got = trie.trie(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(3)).collect()
    found = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got}
    assert len(found) == len(got) and found == brute(rows)


def test_small_vocabulary(spark):
    """Few different turns, so that prefixes meet at every depth; ids are missing, negative and large."""
    rng = random.Random(2)
    rows = []
    for c in [*range(-12, 60), *range(10**12, 10**12 + 9), 2**62]:
        if rng.random() < 0.85:
            rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bé", ""])) for t in rng.sample(range(40), rng.randint(1, 14))]
    check(spark, rows)


def test_awkward_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", "hi"), (1, 0, "user", "hi"), (None, 1, "user", "lost"), (2, 5, "", ""), (3, 1, "user", "x" * 100_000), (5, 1, "a", "b"), (6, 1, "ab", ""), (7, 1, "", "ab"), (10, 3, "user", None), (10, -3, None, "y")]
    check(spark, rows)


def test_long_conversation_over_many_runs(spark):
    """One conversation holds most rows, with equal turns among them; its copy and one that leaves it halfway meet it."""
    rng = random.Random(7)
    long = [("user" if i % 2 else "assistant", rng.choice(["p", "q", "rs"])) for i in range(900)]
    rows = [(100, i, *t) for i, t in enumerate(long)] + [(200, i, *t) for i, t in enumerate(long)] + [(300, i, *t) for i, t in enumerate(long[:500])] + [(300, 500 + i, "user", "z") for i in range(30)]
    rows += [(400, None, "user", "same")] * 700 + [(c, 0, "user", "p") for c in range(500, 540)]
    check(spark, rows)


def test_copies_beyond_a_span(spark, monkeypatch):
    """An end list of many rows is one digest, in numerical order."""
    monkeypatch.setattr(trie, "SPAN", 16)
    check(spark, [(c, 0, "user", "same") for c in range(-60, 400, 3)] + [(c, 1, "user", "more") for c in range(0, 400, 9)])


def test_no_rows(spark):
    assert trie.trie(spark.createDataFrame([], SCHEMA)).collect() == [] == trie.trie(spark.createDataFrame([(None, 1, "user", "x", "")], SCHEMA)).collect()


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{DIR}/conversations.parquet'")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    want = con.execute(f"select {', '.join(names)} from ({trie.ORACLE['op11_conversation_trie']}) order by depth, conv_id").fetchall()
    got = trie.op11_conversation_trie(spark, DIR).orderBy("depth", "conv_id").collect()
    assert [tuple(r) for r in got] == want and len(want) > 30 and got[0].asDict().keys() == dict.fromkeys(names).keys()
