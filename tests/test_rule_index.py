"""The index of pattern rules against trying every rule on every text."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from riskweave.operators import audit
from riskweave.sources import catalog

PATTERNS = ["abc", "b{2}c+d", "(?:abc|cab)a", "x|yyz", "a.*c", "(?i)CABA", "aab|b?", "[ab]{3}c", "caba\\b"]


def summaries(spark, texts):
    rows = [(i, t, ["src/a.py"] if i % 3 else ["src/a.py", "lib/b.jsx", "c.js"], i % 5 == 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "diff_id long, raw_diff string, files array<string>, mostly_new boolean").withColumn("effective", F.col("files"))


def rules(patterns, languages=("*", "python", "javascript")):
    return [catalog.normalized({"id": f"r{i}", "match": p, "severity": "low", "language": languages[i % len(languages)], "rule_type": "regression" if i % 4 == 0 else "absolute"}, i, "rows") for i, p in enumerate(patterns)]


def test_against_every_pair(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcABxyzd\n") for _ in range(rng.randint(0, 30))) for _ in range(200)] + ["", "é" * 5 + "abc", None]
    table = rules(PATTERNS * 3)
    got = {(r.diff_id, r.load_order): r.matched_file for r in audit.match_regex(summaries(spark, texts), audit.compiled(spark, table)).collect()}
    want = {}
    for i, t in enumerate(texts):
        files = ["src/a.py"] if i % 3 else ["src/a.py", "lib/b.jsx", "c.js"]
        for r in audit.rule_table(table):
            exts = catalog.LANGUAGE_EXTENSIONS.get(r["language"], [""])
            fits = [f for f in files if r["language"] == "*" or f.endswith(tuple(exts))]
            if t is not None and fits and not (r["rule_type"] == "regression" and i % 5 == 0) and re.search(r["match"], t, re.M):
                want[i, r["load_order"]] = files[0]
    assert got == want and len(want) > 100


def test_plan_tries_no_rule_on_every_text(spark):
    s = summaries(spark, ["abc"])
    plans = [audit.match_regex(s, audit.compiled(spark, catalog.rows())), audit.match_file(s, audit.compiled(spark, catalog.rows())), audit.scheduled_pairs(s, audit.compiled(spark, catalog.rows()).where("strategy = 'regex'"))]
    for df in plans:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("n", [300])
def test_time_does_not_follow_the_rules(spark, n):
    """Sixty times the rules, of which the texts hold as few: far less than sixty times the seconds."""
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60)) for _ in range(1500)]
    s = summaries(spark, texts).persist()
    s.count()

    def took(count):
        table = audit.compiled(spark, rules([f"q{i}z\\(\\w+\\)" for i in range(count)], ("*",)))
        best = 1e9
        for _ in range(2):
            began = time.time()
            assert audit.match_regex(s, table).count() == 0
            best = min(best, time.time() - began)
        return best

    few, many = took(n), took(60 * n)
    s.unpersist()
    assert many < 8 * few + 2
