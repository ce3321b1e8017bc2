"""Files of diffs, change lists, baselines and counters; those that can't be read are kept apart."""

import json

from riskweave.operators import audit, parse
from riskweave.sources import files


def test_diffs_of_a_folder(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "x.diff").write_text("--- a/x.py\n+++ b/x.py\n+1\n")
    (tmp_path / "a" / "b" / "y.diff").write_text("--- a/y.py\n+++ b/y.py\n+é\n")
    (tmp_path / "a" / "empty.diff").write_text("")
    (tmp_path / "other.txt").write_text("no diff")
    got = {r.diff_id.rsplit("/", 1)[-1]: r.raw_diff for r in files.diff_files(spark, str(tmp_path)).collect()}
    assert got["x.diff"].endswith("+1\n") and got["y.diff"].endswith("+é\n") and set(got) <= {"x.diff", "y.diff", "empty.diff"}
    assert {r.file for r in parse.file_patches(files.diff_files(spark, str(tmp_path))).collect()} == {"x.py", "y.py"}


def test_fallback_to_change_lists(spark):
    change = {"old_path": "a.py", "new_path": "b.py", "renamed_file": True, "diff": "@@ -1 +1 @@\n+x"}
    diffs = spark.createDataFrame([(1, "--- a/k\n+++ b/k"), (2, '{"message": "gone"}'), (3, "  "), (4, None), (5, ""), (6, "[]"), (7, "{}")], "diff_id long, raw_diff string")
    lists = spark.createDataFrame([(1, "not read"), (2, json.dumps({"changes": [change, {"new_path": "n", "new_file": True}]})), (3, json.dumps({"changes": []})), (4, '{"changes": ['), (5, None), (6, json.dumps({"changes": [{}]}))], "diff_id long, body string")
    got = {r.diff_id: (r.origin, r.raw_diff) for r in files.with_fallback(diffs, lists).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "raw", 2: "changes", 3: "none", 4: "none", 5: "none", 6: "changes", 7: "none"}
    assert got[2][1] == "diff --git a/a.py b/b.py\nrename from a.py\nrename to b.py\n--- a/a.py\n+++ b/b.py\n@@ -1 +1 @@\n+x\ndiff --git a/n b/n\n--- /dev/null\n+++ b/n\n"
    assert {r.file for r in parse.file_patches(files.with_fallback(diffs, lists).where("origin = 'changes'")).collect()} >= {"b.py", "n"}
    good, bad = files.parsed(lists, files.CHANGES)
    assert {r.diff_id for r in good.collect()} == {2, 3, 6} and {r.diff_id for r in bad.collect()} == {1, 4, 5}


def test_baselines_and_counters(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"items": [{"rule_id": "r1", "file": "a.py"}, {"rule_id": "r2"}]}, indent=1))
    (tmp_path / "two.json").write_text("{ broken")
    known, bad = files.baseline(spark, str(tmp_path))
    assert {tuple(r) for r in known.collect()} == {("r1", "a.py"), ("r2", "")} and [r.path.rsplit("/", 1)[-1] for r in bad.collect()] == ["two.json"]
    findings = spark.createDataFrame([(1, "r1", "a.py"), (1, "r1", "b.py")], "diff_id long, rule_id string, matched_file string")
    assert [r.matched_file for r in audit.since_baseline(findings, known).collect()] == ["b.py"]
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "a.json").write_text(json.dumps({"rules": {"r1": {"calls": 2, "hits": 1}, "r2": {"calls": 1}}}))
    (tmp_path / "q" / "b.json").write_text(json.dumps({"rules": {"r1": {"calls": 3, "ignores": 1, "time_ns": 5}}}))
    counters, bad = files.quality(spark, str(tmp_path / "q"))
    assert {tuple(r) for r in counters.collect()} == {("r1", 5, 1, 1, 5), ("r2", 1, 0, 0, 0)} and bad.count() == 0
