"""Rules in folders: only what a run needs is read."""

import pytest
from pyspark.sql import functions as F

from riskweave.sources import catalog, rulestore


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def read_files(df):
    """Files that a scan reads, from its metrics."""
    df.collect()
    return {r.f for r in df.select(F.input_file_name().alias("f")).distinct().collect()}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("rules") / "store")
    rows = [(f"r{i}", lang, tier) for i, (lang, tier) in enumerate((x, t) for x in ["java", " Go ", "python", "*", "", None, "rust"] for t in [*rulestore.TIERS, None])]
    rulestore.write(spark.createDataFrame(rows, "rule_id string, language string, tier string"), at)
    return at


def test_profiles_read_their_tiers(spark, store):
    for profile, n in [("lightweight", 7), ("standard", 14), ("strict", 35), (None, 35), ("odd", 35)]:
        assert rulestore.read(spark, store, profile).count() == n
    some = rulestore.read(spark, store, "lightweight")
    assert "PartitionFilters: [isnotnull(tier" in plan(some) or "PartitionFilters: [tier" in plan(some)
    assert all("tier=tier1" in f for f in read_files(some))


def test_only_languages_of_the_diffs(spark, store):
    files = spark.createDataFrame([(1, ["a/B.java", "c.GO"]), (2, ["no_extension", "x.unknown"]), (3, []), (4, None)], "diff_id long, files array<string>")
    got = rulestore.for_diffs(rulestore.read(spark, store), files)
    assert {(r.language, r.tier) for r in got.collect()} == {(x, t) for x in ["java", "go", "*"] for t in rulestore.TIERS}
    assert got.count() == 25 and "dynamicpruning" in plan(got)
    assert {r.language for r in rulestore.for_diffs(rulestore.read(spark, store), files.where("diff_id > 1")).collect()} == {"*"}
    assert {r.language for r in rulestore.languages_of(spark.createDataFrame([(["a.h"],)], "files array<string>")).collect()} == {"c", "cpp", "*"}


def rule(name, **more):
    return "".join(f"{k}: {v}\n" for k, v in {"id": name, "severity": "high", **more}.items())


def tree(at, files):
    for name, text in files.items():
        (at / name).parent.mkdir(parents=True, exist_ok=True)
        (at / name).write_text(text)
    return str(at)


def test_tiered_tree(spark, tmp_path):
    at = tree(tmp_path / "pro rules", {
        "cve/java/tier1_critical/a.yaml": rule("t1"), "cve/java/tier1_critical/deep/b.yaml": rule("t1deep"), "cve/java/tier2_high/a.yaml": rule("t2"), "cve/java/tier3_medium/a.yaml": rule("t3"), "cve/java/tier4_low/a.yaml": rule("t4"),
        "cve/java/own.yaml": rule("own"), "cve/java/tier_notes.yaml": rule("notes"), "cve/java/odd/x.yaml": rule("odd"), "cve/go/x.yaml": rule("go"), "top.yaml": rule("top"), "cve/java/tier1_critical/c.txt": "no rule",
    })
    ids = lambda profile: [r.rule_id for r in rulestore.rule_files(spark, at, profile)[0].orderBy("load_order").collect()]
    assert sorted(ids("lightweight")) == ["own", "t1", "t1deep"]
    assert sorted(ids("standard")) == ["own", "t1", "t1deep", "t2"]
    assert sorted(ids("strict")) == sorted(ids(None)) == ["own", "t1", "t1deep", "t2", "t3", "t4"]
    # files of other folders are listed, not read
    assert {f.rsplit("/", 2)[1] for f in read_files(rulestore.bodies(spark, at, "lightweight"))} == {"tier1_critical", "java", "deep"}


def test_untiered_tree_in_all_shapes(spark, tmp_path):
    at = tree(tmp_path / "rules", {
        "a.yaml": "rules:\n- id: m1\n  match: x\n- id: m2\n  action: removed\n", "b.yaml": "prorule.x:\n  language: go\n  description: d\n", "java/skipped.yaml": rule("skipped"), "sub/java/kept.yaml": rule("kept"), "java.yaml": rule("named"),
        "quoted.yaml": 'id: q\ndescription: "it\'s "so" said"\n', "broken.yaml": "id: [", "list.yaml": "- 1\n", "empty.yaml": "", "odd.yaml": "rules: [1]\n", "twice.yaml": rule("m1"),
    })
    good, bad = rulestore.rule_files(spark, at)
    rows = {r.rule_id: r for r in good.collect()}
    assert set(rows) == {"m1", "m2", "prorule.x", "kept", "named", "q"} and good.count() == 7
    assert sorted(r.load_order for r in good.collect()) == list(range(7)) and rows["m2"].rule_type == "regression" and rows["prorule.x"].language == "go"
    assert sorted(r.path.rsplit("/", 1)[1] for r in bad.collect()) == ["broken.yaml", "list.yaml", "odd.yaml"] and all(r.error for r in bad.collect())
    assert good.schema.simpleString() == catalog.catalogue(spark).schema.simpleString()


def test_empty_tree(spark, tmp_path):
    tree(tmp_path, {"note.txt": "x"})
    good, bad = rulestore.rule_files(spark, str(tmp_path))
    assert good.count() == bad.count() == 0
