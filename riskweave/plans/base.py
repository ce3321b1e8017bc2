"""What the query modules share: the registry and derived tables in both engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators import parse
from riskweave.sources import corpus
from riskweave.sources.corpus import _sql_pick as sql_pick
from riskweave.sources.corpus import RULE_IDS, pick, table

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None, *ctes: str) -> None:
        self.queries[name] = query
        if sql:
            self.oracle[name] = ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + sql


# --- findings derived from orders -------------------------------------------------------------------------------------
SEVERITY_OF = ["critical", "high", "critical", "high", "low", "medium", "high", "high", "high", "high", "medium", "high"]
IMPACT_OF = ["security", "runtime", "runtime", "maintenance", "runtime", "maintenance", "runtime", "security", "security", "runtime", "runtime", "security"]
FILES = ["src/service/A.java", "src/dto/B.java", "lib/c.py", "app/d.js", "core/e.go", "test/f_test.py", "docs/g.md", "native/h.cpp"]


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(diff_id, load_order, rule_id, severity, impact, matched_file, is_blocking, experimental), one row an order."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("k"), F.col("o_custkey").cast("long").alias("c"))
    n = F.col("k") % len(RULE_IDS)
    rule = o.select(F.col("c").alias("diff_id"), F.col("k").alias("load_order"), pick(RULE_IDS, n).alias("rule_id"), pick(SEVERITY_OF, n).alias("severity"), pick(IMPACT_OF, n).alias("impact"), pick(FILES, F.col("k") * 3 + F.col("c")).alias("matched_file"), F.col("k"))
    return rule.select("*", ((F.col("severity") == "critical") & (F.col("k") % 24 == 0)).alias("is_blocking"), (F.col("k") % 10 == 3).alias("experimental")).drop("k")


FINDINGS = f"""findings AS (
  SELECT *, severity = 'critical' AND load_order % 24 = 0 AS is_blocking, load_order % 10 = 3 AS experimental FROM (
    SELECT CAST(o_custkey AS BIGINT) AS diff_id, CAST(o_orderkey AS BIGINT) AS load_order, {sql_pick(RULE_IDS, f"o_orderkey % {len(RULE_IDS)}")} AS rule_id,
      {sql_pick(SEVERITY_OF, f"o_orderkey % {len(RULE_IDS)}")} AS severity, {sql_pick(IMPACT_OF, f"o_orderkey % {len(RULE_IDS)}")} AS impact, {sql_pick(FILES, "o_orderkey * 3 + o_custkey")} AS matched_file FROM orders))"""


# --- rule runs derived from events ------------------------------------------------------------------------------------
def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rule_id, hit, ignored, time_ns): a rule run an event; errors are ignored hits, views no hits."""
    e = table(spark, sf_dir, "events")
    return e.select(pick(RULE_IDS, F.col("user_id")).alias("rule_id"), (F.col("event_type") != "view").alias("hit"), (F.col("event_type") == "error").alias("ignored"), (F.col("event_id") % 1000 * 1000).cast("long").alias("time_ns"))


RUNS = f"""runs AS (SELECT {sql_pick(RULE_IDS, "user_id")} AS rule_id, event_type <> 'view' AS hit, event_type = 'error' AS ignored, CAST(event_id % 1000 * 1000 AS BIGINT) AS time_ns FROM events)"""

# --- parsed diffs in DuckDB -------------------------------------------------------------------------------------------
DIFFS = corpus.CTE
LINES = """lines AS (
  SELECT diff_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT diff_id, string_split(raw_diff, chr(10)) AS l FROM diffs)),
marked AS (
  SELECT diff_id, pos, line, sum(CASE WHEN starts_with(line, 'diff --git') THEN 1 ELSE 0 END) OVER (PARTITION BY diff_id ORDER BY pos) AS grp,
    CASE WHEN starts_with(line, '+++ ') AND trim(substr(line, 5)) <> '/dev/null' THEN regexp_replace(trim(substr(line, 5)), '^[ab]/', '') END AS plus_path,
    CASE WHEN starts_with(line, '--- ') AND trim(substr(line, 5)) <> '/dev/null' THEN regexp_replace(trim(substr(line, 5)), '^[ab]/', '') END AS minus_path,
    starts_with(line, '--- ') AND trim(substr(line, 5)) = '/dev/null' AS from_null
  FROM lines)"""
PATCHES = """patches AS (
  SELECT diff_id, grp, coalesce(arg_max(plus_path, pos) FILTER (plus_path IS NOT NULL), arg_min(minus_path, pos) FILTER (minus_path IS NOT NULL)) AS file,
    string_agg(line, chr(10) ORDER BY pos) AS patch, bool_or(from_null) AS is_new
  FROM marked GROUP BY diff_id, grp)"""
FILES_CTE = """current_file AS (
  SELECT *, coalesce(last_value(plus_path IGNORE NULLS) OVER w, first_value(minus_path IGNORE NULLS) OVER w) AS now
  FROM marked WINDOW w AS (PARTITION BY diff_id, grp ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
seen AS (SELECT diff_id, now, min(pos) AS pos FROM current_file WHERE starts_with(line, '+++ ') AND now IS NOT NULL GROUP BY ALL),
files_of AS (SELECT diff_id, list(now ORDER BY pos) AS files FROM seen GROUP BY diff_id),
stats_of AS (
  SELECT diff_id, count(*) FILTER (starts_with(line, '+') AND NOT starts_with(line, '+++')) AS n_add, count(*) FILTER (starts_with(line, '-') AND NOT starts_with(line, '---')) AS n_del, count(*) AS n_lines
  FROM lines GROUP BY diff_id),
new_of AS (SELECT diff_id, list(file ORDER BY grp) FILTER (is_new) AS new_files FROM patches WHERE file IS NOT NULL GROUP BY diff_id),
summaries AS (
  SELECT d.diff_id, d.raw_diff, coalesce(f.files, []) AS files, coalesce(n.new_files, []) AS new_files, coalesce(s.n_add, 0) AS n_add, coalesce(s.n_del, 0) AS n_del
  FROM diffs d LEFT JOIN files_of f USING (diff_id) LEFT JOIN stats_of s USING (diff_id) LEFT JOIN new_of n USING (diff_id))"""
SUMMARIES = (DIFFS, LINES, PATCHES, FILES_CTE)


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.summaries(corpus.diffs(spark, sf_dir))


def duck_globs(x: str, globs: list[str]) -> str:
    from riskweave.functions import dialect

    return "(" + " OR ".join(f"regexp_matches({x}, '{dialect.glob_regex(g)}')" for g in globs) + ")"


def effective_cte() -> str:
    from riskweave.sources import catalog

    return f"""effective AS (
  SELECT *, (n_add + n_del > 10 AND CAST(n_del AS DOUBLE) / nullif(n_add + n_del, 0) < 0.1) OR coalesce(CAST(len(new_files) AS DOUBLE) / nullif(len(eff), 0) > 0.8, false) AS mostly_new
  FROM (SELECT *, list_filter(files, lambda f: NOT {duck_globs("f", catalog.SKIP_PATHS)}) AS eff FROM summaries))"""
