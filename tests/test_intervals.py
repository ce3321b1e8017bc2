"""Interval joins, spans of braces, versions and places of comments against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from riskweave.functions import dialect
from riskweave.operators import audit, builtin_rules, intervals, languages, parse, reports
from riskweave.sources import catalog


@pytest.mark.parametrize("longest", [1, 5, 3000])
def test_overlaps(spark, longest):
    rng = random.Random(longest)
    some = lambda n: [(rng.randrange(3), s, s + rng.randrange(rng.choice([1, longest]))) for s in (rng.randrange(4000) for _ in range(n))]
    a, b = some(300), some(200)
    left = spark.createDataFrame([(*x, i) for i, x in enumerate(a)] + [(0, 5, None, -1), (0, 9, 8, -2), (None, 1, 9, -3)], "file long, start long, end long, id long")
    right = spark.createDataFrame(b, "file long, start long, end long")
    got = sorted((r.id, r.other_start, r.other_end) for r in intervals.overlaps(left, right, ["file"]).collect())
    assert got == sorted((i, y, z) for i, (f, s, e) in enumerate(a) for g, y, z in b if f == g and s <= z and y <= e) and got
    assert intervals.overlaps(left.limit(0), right, ["file"]).count() == 0 == intervals.overlaps(left, right.limit(0), ["file"]).count()


def test_rows_do_not_follow_lengths(spark):
    left = spark.createDataFrame([(1, 10**9 + i) for i in range(50)], "start long, end long")
    right = spark.createDataFrame([(5, 5)], "start long, end long")
    assert intervals._binned(left, [0, 30]).count() <= 100 and intervals.overlaps(left.withColumn("f", F.lit(1)), right.withColumn("f", F.lit(1)), ["f"]).count() == 50


def test_spans_of_braces(spark):
    rng = random.Random(3)
    texts = {f: [rng.choice(["func a() {", "func b() { }", "func c() {{", "}", "}}", "x", "} else {", "{"]) for _ in range(rng.randint(1, 25))] for f in range(60)}
    want = set()
    for f, lines in texts.items():
        depth = 0
        for i, x in enumerate(lines):
            before, depth = depth, depth + x.count("{") - x.count("}")
            if x.startswith("func"):
                d, last = depth, i if depth <= before else None
                for j in range(i + 1, len(lines)):
                    was, d = d, d + lines[j].count("{") - lines[j].count("}")
                    if last is None and d <= before and d < was:
                        last = j
                want.add((f, i, len(lines) - 1 if last is None else last))
    df = spark.createDataFrame([(f, i, x) for f, lines in texts.items() for i, x in enumerate(lines)], "file long, line int, text string")
    assert {(r.file, r.line, r.last) for r in languages.brace_spans(df, languages.GO_NODES["function"]).collect()} == want


def test_nodes_over_several_lines_are_hit(spark):
    found = spark.createDataFrame([(1, 3, 9, "function"), (1, 20, 20, "function")], "file long, line int, last int, node string")
    ranges = spark.createDataFrame([(1, 7, 7), (1, 8, 12), (2, 20, 20)], "file long, start_line int, end_line int")
    assert [tuple(r) for r in languages.signals(found, ranges, {"function": "f"}).collect()] == [(1, 3, "f")]
    lines = spark.createDataFrame([(1, 1, "import ("), (1, 2, '\t"unsafe"'), (2, 1, 'import "fmt"')], "file long, line int, text string")
    assert [tuple(r) for r in languages.unsafe_imports(lines).collect()] == [(1, 0, "runtime.security.unsafe_package_used")]


def test_version_keys_sort_as_versions(spark):
    rng = random.Random(5)
    versions = ["".join(rng.choice(["1", "9", "10", "007", ".", "-", "a", "123456789012345678901"]) for _ in range(rng.randint(0, 7))) for _ in range(120)]
    segments = lambda v: tuple(int(re.sub("[^0-9]", "", x) or 0) for x in v.replace("-", ".").split("."))
    key = {r.v: r.k for r in spark.createDataFrame([(v,) for v in versions], "v string").select("v", dialect.version_key(F.col("v")).alias("k")).collect()}
    assert all((key[a] < key[b]) == (segments(a) < segments(b)) for a in versions for b in versions)


def test_packages_decide_which_rules_run(spark):
    packages = spark.createDataFrame([("a", "NPM ", "x", ["1.0"], ["2.0"]), ("b", "npm", "x", ["3.0"], []), ("c", "npm", "y", [], []), ("d", "maven", "x", ["1"], []), ("e", "", "x", [], []), ("f", "npm", "x", ["", "1.5"], None)], "rule_id string, ecosystem string, package string, introduced array<string>, fixed array<string>")
    used = spark.createDataFrame([("npm", "x", "1.10"), ("npm", "z", "1"), ("npm", "y", None)], "ecosystem string, package string, version string")
    assert {r.rule_id for r in audit.barred(packages, used).collect()} == {"b", "c"}
    assert {r.rule_id for r in audit.affected_dependencies(packages, used).collect()} == {"a", "f"}
    rows = [catalog.normalized({"id": i, "match": "needle", "severity": "low"}, k, "rows") for k, i in enumerate("abcdef")]
    diff = spark.createDataFrame([(1, "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n+needle")], "diff_id long, raw_diff string")
    found = audit.Engine(spark, rows, packages=packages, dependencies=used, overrides={"d": "disabled", "a": "experimental"}).audit(diff).collect()
    assert {(r.rule_id, r.experimental) for r in found} == {("a", True), ("e", False), ("f", False)}


def test_comments_stay_in_their_diff(spark):
    patch = lambda f, *x: "\n".join([f"diff --git a/{f} b/{f}", f"--- a/{f}", f"+++ b/{f}", *x])
    diffs = spark.createDataFrame([(1, patch("a.py", "@@ -1 +5,3 @@", " x", "-y", "+z")), (2, patch("b.py", "@@ -1 +1 @@", " k") + "\n" + patch("a.py", "+first")), (3, "nothing")], "diff_id long, raw_diff string")
    places = parse.patch_positions(diffs)
    assert {(r.diff_id, r.file, r.position, r.line) for r in places.collect()} == {(1, "a.py", 7, 6), (2, "b.py", 4, 2), (2, "a.py", 4, 1)}
    findings = spark.createDataFrame([(d, 0, "r", "high", "a.py") for d in (1, 2, 3)] + [(2, 1, "r", "low", "other")], "diff_id long, load_order int, rule_id string, severity string, matched_file string")
    got = sorted((r.diff_id, r.load_order, r.path, r.position, r.line) for r in reports.inline_comments(findings, places).collect())
    assert got == [(1, 0, "a.py", 7, 6), (2, 0, "a.py", 4, 1), (2, 1, "b.py", 4, 2), (3, 0, "a.py", 1, 1)]


def test_strategies_against_every_pair_of_lines(spark):
    """following, context and signature look at each line once; plain versions compare all."""
    rng = random.Random(9)
    rules = {"following": next(r for r in builtin_rules.ALL if r.strategy == "following"), "signature": next(r for r in builtin_rules.ALL if r.strategy == "signature"), "context": next(r for r in (x for lang in builtin_rules.CROSS for x in builtin_rules.cross_rules(lang)) if r.strategy == "context")}
    parts = ["+ f.open(x)", "+ } finally {", "+ y", "- public void a(int b)", "+ public void a(int b)", "+ public void a(long b, int c)", "- public void d()", "+ public void d()", "+ new Foo()", "+ delete x", "+ p = new char[3];", "+ std::unique_ptr<int> q"]
    texts = ["\n".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, ["f.cpp"]) for i, t in enumerate(texts)], "i long, raw_diff string, files array<string>")
    c = builtin_rules.Spark(F.col("raw_diff"), F.col("files"))
    got = {r.i: r for r in df.select("i", *[builtin_rules.column(r, c).alias(k) for k, r in rules.items()]).collect()}
    hit = lambda ps, t, flags=0: any(re.search(p, t, flags) for p in ps)
    for i, t in enumerate(texts):
        lines, a, b = t.split("\n"), rules["following"].a, rules["following"].b
        assert bool(got[i].following) == any(hit(a, x) and not hit(b, "\n".join(lines[k:]), re.I) for k, x in enumerate(lines))
        a, b = rules["context"].a, rules["context"].b
        assert bool(got[i].context) == any(hit(a, x) and not hit(b, "\n".join(lines[max(0, k - 3) : k + 4])) for k, x in enumerate(lines))
        named = lambda sign: re.findall(f"^{sign}{rules['signature'].a[0]}", t, re.M)  # noqa: B023, E731
        assert bool(got[i].signature) == any(x[0] == y[0] and x[1] != y[1] for x in named("-") for y in named(r"\+"))
    assert all(0 < sum(bool(getattr(r, k)) for r in got.values()) < len(texts) for k in ("following", "signature"))
