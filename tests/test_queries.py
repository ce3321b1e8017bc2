"""Queries against their DuckDB equivalents on the smallest tables."""

import os
import subprocess
import sys

import pytest

import __spark_entry__

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = [
    "file_patches", "diff_files", "first_added_position", "mostly_new", "match_regex", "schedule_rules", "match_count_delta", "match_line_path", "match_following", "cross_language", "tokens", "type_downgrade", "inline_ignores",
    "compose_decision", "impacts", "report_markdown", "ignore_filter", "comment_upsert", "findings_grouping_sets", "rule_stats_topk", "pr_approval", "cve5_flatten", "rule_lint", "cve_version_gate", "tier_distribution", "tier_pruned_rules", "rules_for_diffs", "advisory_rejects", "npm_rules", "recent_npm_advisories", "advisory_dependencies", "java_rules", "java_normalize", "go_signals", "cpp_pattern_counts",
    "stream_quality", "stream_window_findings", "stream_comment_upsert", "stream_counters",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def rows(df):
    cols = sorted(df.columns)
    return sorted(map(tuple, df[cols].astype(object).where(df[cols].notna(), None).astype(str).values.tolist())), cols


@pytest.mark.parametrize("name", SOME)
def test_oracle(spark, duck, name):
    got, want = __spark_entry__.queries()[name](spark, DIR).toPandas(), duck.sql(__spark_entry__.oracle_sql()[name]).df()
    assert rows(got) == rows(want) and len(got)


def test_registry():
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len(q) > 150


def test_registry_needs_no_session():
    """In a process of its own, as an earlier test may have started a session."""
    code = "import __spark_entry__ as e; from pyspark import SparkContext; assert set(e.oracle_sql()) <= set(e.queries()) and SparkContext._active_spark_context is None"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(__file__)), timeout=120)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
