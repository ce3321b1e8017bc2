"""Nested advisories: files of a tree, what can't be read is kept apart, both shapes become rules and version ranges."""

import json

from riskweave.operators import advisories as A
from riskweave.operators import audit
from riskweave.sources import files


def affected(name, ecosystem="npm", events=None, versions=None):
    return {"package": {"ecosystem": ecosystem, "name": name}, "ranges": [{"type": "SEMVER", "events": events or []}], "versions": versions or []}


def read(spark, *bodies):
    return A.records(spark.createDataFrame([(f"{i}.json", b if b is None or isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)], "path string, body string"))


def test_a_tree_of_files(spark, tmp_path):
    (tmp_path / "2024" / "01").mkdir(parents=True)
    (tmp_path / "2024" / "01" / "a.json").write_text(json.dumps({"id": "GHSA-1", "affected": [affected("p")]}, indent=2))
    (tmp_path / "2024" / "b.json").write_text('{"id": "GHSA-2"')
    (tmp_path / "c.json").write_text("")
    (tmp_path / "d.txt").write_text('{"id": "GHSA-3"}')
    good, bad = files.advisories(spark, str(tmp_path))
    assert [r.id for r in good.collect()] == ["GHSA-1"]
    assert {r.path.rsplit("/", 1)[1]: r.error for r in bad.collect()} == {"b.json": "no JSON object"} | ({"c.json": "no JSON object"} if bad.count() == 2 else {})


def test_what_is_no_advisory(spark):
    good, bad = read(spark, None, "", "[]", "3", '{"id": "GHSA-1"', '{"id": "x", "affected": 1}', "{}", '{"id": " "}', '{"id": "x", "unknown": {"a": 1}}', {"id": "y", "severity": [{"type": "CVSS_V3", "score": "9"}]}, '{"id": "z", "id2": }')
    assert {r.path: r.error for r in bad.collect()} == {"0.json": "no JSON object", "1.json": "no JSON object", "2.json": "no JSON object", "3.json": "no JSON object", "4.json": "no JSON object", "5.json": "malformed", "6.json": "no id", "7.json": "no id", "10.json": "malformed"}
    assert sorted(r.id for r in good.collect()) == ["x", "y"]


def test_rules_of_reviewed_advisories(spark):
    whole = {
        "id": "GHSA-Ab-1", "summary": "", "details": "d" * 600, "published": "2024-05-01T00:00:00Z", "aliases": ["CVE-1"], "references": [{"type": "WEB", "url": f"u{i}"} for i in range(12)] + [{"type": "WEB"}],
        "database_specific": {"severity": "CRITICAL", "cwe_ids": [f"CWE-{i}" for i in range(7)]}, "affected": [affected("py", "PyPI", versions=["1", "2", "3", "4"]), affected(" @a/b ", "NPM"), affected("c")],
    }
    rows = {r.rule_id: r for r in A.npm_rules(read(spark, whole, {"id": "GHSA-2", "affected": []}, {"id": "GHSA-3", "database_specific": {"severity": "MODERATE"}})[0]).collect()}
    r = rows["prorule.javascript.critical.ghsa_ab_1"]
    assert (len(r.description), r.package, r.links, r.cwe, r.introduced, r.aliases) == (500, "@a/b", [f"u{i}" for i in range(10)], [f"CWE-{i}" for i in range(5)], ["1", "2", "3"], ["CVE-1"])
    assert r.patterns[0] == 'require("@a/b")' and r.tags[-1] == "ghsa-ab-1"
    assert rows["prorule.javascript.high.ghsa_2"].package == rows["prorule.javascript.high.ghsa_3"].package == "unknown" and rows["prorule.javascript.high.ghsa_3"].description == ""


def test_rules_of_older_advisories(spark):
    rows = {r.rule_id: r for r in A.npm_rules(read(spark, {"cve_id": "CVE-1-2", "description": "x", "affected_library": "lib", "severity": "LOW"}, {"cve_id": "CVE-3", "severity": "odd", "affected_library": " "}, {"id": "other-4", "cve_id": "GHSA-no"})[0]).collect()}
    assert rows["prorule.javascript.low.cve_1_2"].patterns[-1] == '"lib":' and rows["prorule.javascript.low.cve_1_2"].aliases == ["CVE-1-2"]
    assert rows["prorule.javascript.high.cve_3"].patterns == ["*"] and len(rows) == 3


def test_recent(spark):
    good, _ = read(spark, *[{"id": f"GHSA-{i}", "published": p, "affected": [affected("x", "Go"), affected("p", e)]} for i, (p, e) in enumerate([("2024-06-01T00:00:00Z", "npm"), ("2024-05-31T23:59:59Z", "npm"), ("2024-05-31T23:00:00-02:00", "npm"), ("soon", "npm"), (None, "npm"), ("2025-01-01", "Go"), ("2025-01-01", None)])])
    assert sorted(r.id for r in A.recent_npm(good, "2024-06-01").collect()) == ["GHSA-0", "GHSA-2", "GHSA-3", "GHSA-4"]


def test_ranges_meet_versions(spark):
    good, _ = read(spark, {"id": "GHSA-1", "affected": [affected("a", events=[{"introduced": "0"}, {"fixed": "1.10"}]), affected("b", "Go", [{"introduced": "2.0"}, {"fixed": "3.0"}]), affected(None), {"package": None}, affected("open")]})
    ranges = A.package_ranges(good)
    assert {(r.package, tuple(r.introduced), tuple(r.fixed)) for r in ranges.collect()} == {("a", (), ("1.10",)), ("b", ("2.0",), ("3.0",)), ("open", (), ())}
    used = spark.createDataFrame([("npm", "a", "1.9"), ("npm", "a", "1.10"), ("go", "b", "2.5"), ("npm", "b", "2.5"), ("NPM", "open", "9")], "ecosystem string, package string, version string")
    assert {(r.package, r.version) for r in audit.affected_dependencies(ranges.withColumnRenamed("advisory_id", "rule_id"), used).collect()} == {("a", "1.9"), ("b", "2.5"), ("open", "9")}


def test_empty_tables(spark):
    good, bad = A.records(spark.createDataFrame([], "path string, body string"))
    assert good.count() == bad.count() == A.npm_rules(good).count() == A.package_ranges(good).count() == A.recent_npm(good, "2024-01-01").count() == 0
