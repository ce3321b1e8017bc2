"""Queries over governance, decisions, reports and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.operators import audit, parse, reports
from riskweave.plans.base import DIFFS, FINDINGS, LINES, PATCHES, RULE_IDS, RUNS, SEVERITY_OF, Registry, duck_globs, findings, runs, sql_pick
from riskweave.sources import catalog, corpus
from riskweave.sources.corpus import pick, table

R = Registry()
_SCORE = "CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 WHEN 'low' THEN 0 END"
_NAME = lambda x: f"['low', 'medium', 'high', 'critical'][CAST({x} + 1 AS INTEGER)]"

R.add(
    "compose_decision", lambda s, d: audit.decisions(findings(s, d)),
    f"""SELECT diff_id, CASE WHEN blocking OR top >= 3 THEN 'critical' ELSE 'low' END AS review_level, CASE WHEN blocking OR top >= 3 THEN 'block_pr' ELSE 'auto_merge' END AS suggested_action, n_findings, {_NAME("top")} AS max_severity, reasons
FROM (SELECT diff_id, coalesce(max({_SCORE}) FILTER (NOT experimental), 0) AS top, bool_or(is_blocking) AS blocking, count(*) AS n_findings, string_agg(rule_id, ',' ORDER BY load_order) AS reasons FROM findings GROUP BY diff_id)""", FINDINGS,
)
R.add("impacts", lambda s, d: audit.impacts(findings(s, d)), f"SELECT diff_id, impact, {_NAME(f'max({_SCORE})')} AS severity FROM findings WHERE NOT experimental AND severity <> 'low' GROUP BY diff_id, impact", FINDINGS)
R.add(
    "decision_details",
    lambda s, d: findings(s, d).groupBy("diff_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("load_order", F.concat_ws("|", "rule_id", "severity", "matched_file").alias("t")))), lambda x: x.t), ";").alias("details")),
    "SELECT diff_id, string_agg(rule_id || '|' || severity || '|' || matched_file, ';' ORDER BY load_order) AS details FROM findings GROUP BY diff_id", FINDINGS,
)
R.add("files_with_issues", lambda s, d: reports.by_file(findings(s, d)), f"SELECT matched_file AS file, count(*) AS n_findings, {_NAME(f'max({_SCORE})')} AS max_severity FROM findings GROUP BY 1", FINDINGS)
R.add("rules_triggered", lambda s, d: reports.by_rule(findings(s, d)), "SELECT rule_id, count(*) AS n_findings, count(DISTINCT matched_file) AS n_files FROM findings GROUP BY 1", FINDINGS)
R.add("severity_breakdown", lambda s, d: reports.by_severity(findings(s, d)), "SELECT v AS severity, count(f.severity) AS n FROM (SELECT unnest(['critical', 'high', 'medium', 'low', 'unknown']) AS v) LEFT JOIN findings f ON f.severity = v GROUP BY 1", FINDINGS)
R.add("report_json", lambda s, d: reports.as_json(findings(s, d)), """SELECT diff_id, load_order, '{"rule_id":"' || rule_id || '","severity":"' || severity || '","file":"' || matched_file || '","is_blocking":' || CAST(is_blocking AS VARCHAR) || '}' AS json FROM findings""", FINDINGS)
R.add(
    "report_markdown", lambda s, d: reports.markdown(findings(s, d)),
    f"""SELECT diff_id, '# Change risk report' || chr(10) || chr(10) || string_agg('## ' || matched_file || chr(10) || items, chr(10) || chr(10) ORDER BY matched_file) || chr(10) || chr(10) || '---' || chr(10) || CAST(sum(n) AS VARCHAR) || ' findings' AS report
FROM (SELECT diff_id, matched_file, string_agg('- **' || upper(severity) || '** `' || rule_id || '`', chr(10) ORDER BY 3 - {_SCORE}, load_order) AS items, count(*) AS n FROM findings GROUP BY ALL) GROUP BY diff_id""", FINDINGS,
)
R.add(
    "report_html_rows", lambda s, d: reports.html_rows(findings(s, d).withColumn("matched_file", F.concat("matched_file", F.lit(" <a> & 'b'")))),
    "SELECT diff_id, load_order, '<tr><td>' || rule_id || '</td><td>' || severity || '</td><td>' || matched_file || ' &lt;a&gt; &amp; &#x27;b&#x27;</td></tr>' AS html FROM findings", FINDINGS,
)
R.add("baseline_items", lambda s, d: findings(s, d).select("rule_id", F.col("matched_file").alias("file")).distinct(), "SELECT DISTINCT rule_id, matched_file AS file FROM findings", FINDINGS)
R.add(
    "since_baseline", lambda s, d: audit.since_baseline(findings(s, d), findings(s, d).where("load_order % 5 = 0 and matched_file like 'src%'").select("rule_id", F.col("matched_file").alias("file"))).select("diff_id", "rule_id", "matched_file", "load_order"),
    "SELECT diff_id, rule_id, matched_file, load_order FROM findings f WHERE NOT EXISTS (SELECT 1 FROM findings b WHERE b.load_order % 5 = 0 AND b.matched_file LIKE 'src%' AND b.rule_id = f.rule_id AND b.matched_file = f.matched_file)", FINDINGS,
)
_IGNORES = [("security.*", ["test/*", "docs/*"]), ("collection.raw_type", []), ("*.leak", ["native/*"])]
_IGNORED = " OR ".join("(" + duck_globs("rule_id", [r]) + (" AND " + duck_globs("matched_file", f) if f else "") + ")" for r, f in _IGNORES)
R.add("ignore_filter", lambda s, d: audit.ignored(findings(s, d), _IGNORES)[0].select("diff_id", "rule_id", "matched_file", "load_order"), f"SELECT diff_id, rule_id, matched_file, load_order FROM findings WHERE NOT ({_IGNORED})", FINDINGS)
R.add("ignored_counts", lambda s, d: audit.ignored(findings(s, d), _IGNORES)[1].groupBy("rule_id").agg(F.count("*").alias("ignores")), f"SELECT rule_id, count(*) AS ignores FROM findings WHERE {_IGNORED} GROUP BY 1", FINDINGS)
R.add(
    "findings_grouping_sets",
    lambda s, d: findings(s, d).groupingSets([["matched_file"], ["rule_id"], ["severity"]], "matched_file", "rule_id", "severity").agg(F.count("*").alias("n")),
    "SELECT matched_file, rule_id, severity, count(*) AS n FROM findings GROUP BY GROUPING SETS ((matched_file), (rule_id), (severity))", FINDINGS,
)
R.add(
    "ci_gate",
    lambda s, d: audit.decisions(findings(s, d)).join(table(s, d, "events").groupBy(F.col("user_id").cast("long").alias("diff_id")).agg(F.bool_or(F.col("event_type") == "purchase").alias("acked")), "diff_id", "left").select("diff_id", ((F.col("review_level") == "critical") & ~F.coalesce("acked", F.lit(False))).alias("ci_fail")),
    f"SELECT f.diff_id, (bool_or(is_blocking) OR coalesce(max({_SCORE}) FILTER (NOT experimental), 0) >= 3) AND NOT coalesce(bool_or(a.acked), false) AS ci_fail FROM findings f LEFT JOIN (SELECT user_id, bool_or(event_type = 'purchase') AS acked FROM events GROUP BY 1) a ON a.user_id = f.diff_id GROUP BY 1", FINDINGS,
)


def comment_upsert(s, d):
    f = findings(s, d)
    old = f.where("load_order % 2 = 0").groupBy(F.col("rule_id").alias("tag")).agg(F.concat(F.lit("old "), F.count("*").cast("string")).alias("body"))
    new = f.where("severity = 'high'").groupBy(F.col("rule_id").alias("tag")).agg(F.concat(F.lit("new "), F.count("*").cast("string")).alias("body"))
    return reports.upsert(old, new)


R.add(
    "comment_upsert", comment_upsert,
    "SELECT coalesce(o.tag, n.tag) AS tag, coalesce(n.body, o.body) AS body, CASE WHEN n.body IS NULL THEN 'kept' WHEN o.body IS NULL THEN 'created' ELSE 'updated' END AS change FROM (SELECT rule_id AS tag, 'old ' || count(*) AS body FROM findings WHERE load_order % 2 = 0 GROUP BY 1) o FULL JOIN (SELECT rule_id AS tag, 'new ' || count(*) AS body FROM findings WHERE severity = 'high' GROUP BY 1) n ON o.tag = n.tag", FINDINGS,
)
R.add("inline_comment_body", lambda s, d: findings(s, d).select("load_order", F.concat(F.lit("**"), F.upper("severity"), F.lit("** "), "rule_id", F.lit(" in "), "matched_file").alias("body")), "SELECT load_order, '**' || upper(severity) || '** ' || rule_id || ' in ' || matched_file AS body FROM findings", FINDINGS)


def located(s, d):
    """(diff_id, load_order, rule_id, severity, matched_file): two findings of each diff, one in its first file, one in a file that it lacks."""
    first = parse.file_patches(corpus.diffs(s, d)).groupBy("diff_id").agg(F.min_by("file", "grp").alias("file"), F.max_by("file", "grp").alias("last"))
    f = first.withColumn("load_order", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("k", F.col("diff_id") + F.col("load_order"))
    return f.select("diff_id", "load_order", pick(RULE_IDS, F.col("k")).alias("rule_id"), pick(SEVERITY_OF, F.col("k")).alias("severity"), F.when(F.col("load_order") == 0, F.when(F.col("k") % 2 == 0, F.col("file")).otherwise(F.col("last"))).otherwise("no/such.file").alias("matched_file"))


LOCATED = f"""located AS (
  SELECT diff_id, load_order, {sql_pick(RULE_IDS, "diff_id + load_order")} AS rule_id, {sql_pick(SEVERITY_OF, "diff_id + load_order")} AS severity, CASE WHEN load_order = 1 THEN 'no/such.file' WHEN diff_id % 2 = 0 THEN file ELSE last END AS matched_file
  FROM (SELECT diff_id, arg_min(file, grp) AS file, arg_max(file, grp) AS last FROM patches WHERE file IS NOT NULL GROUP BY diff_id), (SELECT unnest([0, 1]) AS load_order)),
placed AS (  -- places by window functions
  SELECT *, row_number() OVER (PARTITION BY diff_id, grp ORDER BY pos) AS i, starts_with(line, '+') AND NOT starts_with(line, '+++') AS added FROM marked),
firsts AS (SELECT diff_id, grp, min(i) FILTER (added) AS first FROM placed GROUP BY ALL),
hunks AS (SELECT p.diff_id, p.grp, any_value(f.first) AS first, max(i) FILTER (starts_with(line, '@@') AND i < coalesce(f.first, 1000000)) AS hunk FROM placed p JOIN firsts f USING (diff_id, grp) GROUP BY ALL),
places AS (
  SELECT h.diff_id, h.grp, coalesce(any_value(h.first), any_value(h.hunk), 1) AS position,
    coalesce(CAST(max(regexp_extract(p.line, '[+](\\d+)', 1)) FILTER (p.i = h.hunk) AS BIGINT) + count(*) FILTER (p.i > h.hunk AND p.i < coalesce(h.first, 1000000) AND NOT (starts_with(p.line, '-') AND NOT starts_with(p.line, '---'))), 1) AS line
  FROM hunks h JOIN placed p USING (diff_id, grp) GROUP BY h.diff_id, h.grp),
of_files AS (SELECT q.diff_id, q.grp, f.file, q.position, q.line FROM places q JOIN patches f USING (diff_id, grp) WHERE f.file IS NOT NULL)"""
R.add(
    "inline_comments", lambda s, d: reports.inline_comments(located(s, d), parse.patch_positions(corpus.diffs(s, d))),
    """SELECT l.diff_id, l.load_order, l.rule_id, coalesce(o.path, f.path) AS path, CAST(coalesce(o.position, f.position) AS INTEGER) AS position, CAST(coalesce(o.line, f.line) AS INTEGER) AS line, '**' || upper(severity) || '** ' || rule_id AS body
FROM located l LEFT JOIN (SELECT diff_id, file AS path, arg_max(position, grp) AS position, arg_max(line, grp) AS line FROM of_files GROUP BY ALL) o ON o.diff_id = l.diff_id AND o.path = l.matched_file
LEFT JOIN (SELECT diff_id, arg_min(file, grp) AS path, arg_min(position, grp) AS position, arg_min(line, grp) AS line FROM of_files GROUP BY diff_id) f ON f.diff_id = l.diff_id""",
    DIFFS, LINES, PATCHES, LOCATED,
)

# --- catalogue --------------------------------------------------------------------------------------------------------
_ROWS = audit.rule_table(catalog.rows())
CATALOG = "catalog(load_order, rule_id, severity, language, rule_type, is_blocking, strategy) AS (VALUES " + ", ".join("({}, '{}', '{}', '{}', '{}', {}, '{}')".format(r["load_order"], r["rule_id"], r["severity"], r["language"], r["rule_type"], str(r["is_blocking"]).lower(), "code" if r["source"] == "code" else "signal" if r["signal"] else "regex") for r in _ROWS) + ")"


def _catalog(s):
    return catalog.catalogue(s).withColumn("strategy", F.when(F.col("source") == "code", "code").when(F.col("signal").isNotNull(), "signal").otherwise("regex"))


R.add("rules_catalog", lambda s, d: _catalog(s).select("load_order", "rule_id", "severity", "language", "rule_type", "is_blocking", "strategy"), "SELECT * FROM catalog", CATALOG)
R.add("rules_by_category", lambda s, d: catalog.by_category(catalog.catalogue(s)), "SELECT string_split(rule_id, '.')[1] AS category, count(*) AS n_rules, CAST(sum(CAST(is_blocking AS INTEGER)) AS BIGINT) AS n_blocking FROM catalog GROUP BY 1", CATALOG)
R.add("pro_by_domain", lambda s, d: catalog.catalogue(s).groupBy(F.split_part("rule_id", F.lit("."), F.lit(2)).alias("domain")).agg(F.count("*").alias("n")), "SELECT split_part(rule_id, '.', 2) AS domain, count(*) AS n FROM catalog GROUP BY 1", CATALOG)
R.add(
    "profile_filter",
    lambda s, d: catalog.by_profile(catalog.catalogue(s), "lightweight").select(F.lit("lightweight").alias("profile"), "rule_id").unionByName(catalog.by_profile(catalog.catalogue(s), "standard").select(F.lit("standard").alias("profile"), "rule_id")).unionByName(catalog.by_profile(catalog.catalogue(s), "strict").select(F.lit("strict").alias("profile"), "rule_id")),
    "SELECT 'lightweight' AS profile, rule_id FROM catalog WHERE severity = 'critical' UNION ALL SELECT 'standard', rule_id FROM catalog WHERE severity IN ('critical', 'high') UNION ALL SELECT 'strict', rule_id FROM catalog", CATALOG,
)
R.add("rules_union", lambda s, d: catalog.union(catalog.catalogue(s).where("source = 'code'"), catalog.catalogue(s).where("language = 'go'")).select("load_order", "rule_id"), "SELECT CAST(row_number() OVER (ORDER BY part, load_order) - 1 AS INTEGER) AS load_order, rule_id FROM (SELECT 0 AS part, * FROM catalog WHERE strategy = 'code' UNION ALL SELECT 1, * FROM catalog WHERE language = 'go')", CATALOG)


def rules_normalize(s, d):
    p = table(s, d, "part").select(F.col("p_partkey").cast("long").alias("k"))
    raw = p.select("k", pick(["added", "removed", "changed", ""], F.col("k")).alias("action"), pick(["critical", "high", "low"], F.col("k")).alias("severity"), F.when(F.col("k") % 5 == 0, F.lit(True)).when(F.col("k") % 5 == 1, F.lit(False)).alias("explicit"))
    kind = F.when(F.col("action").isin("removed", "deleted", "changed", "modified"), "regression").otherwise("absolute")
    return raw.select("k", kind.alias("rule_type"), F.coalesce("explicit", (kind == "absolute") & (F.col("severity") == "critical")).alias("is_blocking"))


R.add(
    "rules_normalize", rules_normalize,
    f"SELECT k, CASE WHEN a IN ('removed', 'changed') THEN 'regression' ELSE 'absolute' END AS rule_type, coalesce(x, a NOT IN ('removed', 'changed') AND v = 'critical') AS is_blocking FROM (SELECT CAST(p_partkey AS BIGINT) AS k, {sql_pick(['added', 'removed', 'changed', ''], 'p_partkey')} AS a, {sql_pick(['critical', 'high', 'low'], 'p_partkey')} AS v, CASE p_partkey % 5 WHEN 0 THEN true WHEN 1 THEN false END AS x FROM part)",
)
STATUSES = ["stable", "experimental", "beta", "deprecated", "disabled", "odd"]


def rule_lifecycle(s, d):
    p = table(s, d, "part").select(F.col("p_partkey").cast("long").alias("k"), pick(STATUSES, F.col("p_partkey")).alias("status"), pick(["critical", "high", "medium", "low"], F.col("p_size")).alias("severity"))
    on = F.col("k") % 2 == 0
    # unknown statuses count as experimental for the run decision
    runs_ = F.when(F.col("status") == "disabled", False).when(F.col("status").isin("experimental", "odd"), on).otherwise(True)
    return p.select("k", runs_.alias("should_run"), F.when(F.col("status") == "deprecated", "low").otherwise(F.col("severity")).alias("severity"))


R.add(
    "rule_lifecycle", rule_lifecycle,
    f"SELECT k, CASE WHEN st = 'disabled' THEN false WHEN st IN ('experimental', 'odd') THEN k % 2 = 0 ELSE true END AS should_run, CASE WHEN st = 'deprecated' THEN 'low' ELSE sev END AS severity FROM (SELECT CAST(p_partkey AS BIGINT) AS k, {sql_pick(STATUSES, 'p_partkey')} AS st, {sql_pick(['critical', 'high', 'medium', 'low'], 'p_size')} AS sev FROM part)",
)

# --- quality ----------------------------------------------------------------------------------------------------------
_Q = "q AS (SELECT rule_id, count(*) AS calls, count(*) FILTER (hit) AS hits, count(*) FILTER (ignored) AS ignores, CAST(sum(time_ns) AS BIGINT) AS time_ns FROM runs GROUP BY 1), ql AS (SELECT *, CASE WHEN hits = 0 THEN 1.0 ELSE round((hits - ignores)::DOUBLE / hits, 4) END AS precision FROM q)"
_STATUS = lambda least, lo, hi: f"CASE WHEN hits < {least} THEN 'insufficient' WHEN precision < {lo} THEN 'disabled' WHEN precision < {hi} THEN 'degraded' ELSE 'normal' END"
_counted = lambda s, d: reports.counters(runs(s, d))
R.add("rule_metrics", _counted, "SELECT * FROM q", RUNS, _Q)
R.add("quality_accumulate", lambda s, d: reports.accumulate(_counted(s, d), reports.counters(runs(s, d).where("hit"))), "SELECT rule_id, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(ignores) AS BIGINT) AS ignores, CAST(sum(time_ns) AS BIGINT) AS time_ns FROM (SELECT * FROM q UNION ALL SELECT rule_id, count(*), count(*), count(*) FILTER (ignored), sum(time_ns) FROM runs WHERE hit GROUP BY 1) GROUP BY 1", RUNS, _Q)
R.add("quality_status", lambda s, d: reports.quality(_counted(s, d)).select("rule_id", "precision", audit.quality_status(F.col("hits"), F.col("precision"), 30, 0.75, 0.7).alias("status")), f"SELECT rule_id, precision, {_STATUS(30, 0.7, 0.75)} AS status FROM ql", RUNS, _Q)
R.add("quality_report", lambda s, d: _counted(s, d).select("rule_id", "hits", F.greatest(F.lit(0), F.col("hits") - F.col("ignores")).alias("accepts"), F.round(F.col("ignores") / F.nullif(F.col("hits"), F.lit(0)), 3).alias("fp_rate")).orderBy(F.desc("hits"), "rule_id"), "SELECT rule_id, hits, greatest(0, hits - ignores) AS accepts, round(ignores::DOUBLE / nullif(hits, 0), 3) AS fp_rate FROM q", RUNS, _Q)
R.add("quality_warnings", lambda s, d: reports.warnings(reports.quality(_counted(s, d)), least=30, degrade=0.75, disable=0.7).orderBy("status", "precision"), f"SELECT * FROM (SELECT rule_id, {_STATUS(30, 0.7, 0.75)} AS status, precision FROM ql) WHERE status IN ('degraded', 'disabled')", RUNS, _Q)
R.add("rules_health", lambda s, d: reports.quality(_counted(s, d)).select("rule_id", "hits", F.when(F.col("hits") == 0, "normal").otherwise(audit.quality_status(F.col("hits"), F.col("precision"))).alias("health")), f"SELECT rule_id, hits, CASE WHEN hits = 0 THEN 'normal' ELSE {_STATUS(30, 0.3, 0.5)} END AS health FROM ql", RUNS, _Q)
R.add("rules_noisy", lambda s, d: _counted(s, d).select("rule_id", (F.coalesce(100.0 * F.col("ignores") / F.nullif(F.col("hits"), F.lit(0)), F.lit(0.0)) >= 25.0).alias("noisy")), "SELECT rule_id, coalesce(100.0 * ignores / nullif(hits, 0), 0) >= 25 AS noisy FROM q", RUNS, _Q)
R.add(
    "auto_tune",
    lambda s, d: reports.quality(_counted(s, d)).withColumn("status", audit.quality_status(F.col("hits"), F.col("precision"), 30, 0.75, 0.7)).where("status <> 'disabled'").select("rule_id", F.when(F.col("status") == "degraded", audit.downgraded(F.lit("critical"))).otherwise("critical").alias("severity")),
    f"SELECT rule_id, CASE WHEN st = 'degraded' THEN 'high' ELSE 'critical' END AS severity FROM (SELECT *, {_STATUS(30, 0.7, 0.75)} AS st FROM ql) WHERE st <> 'disabled'", RUNS, _Q,
)


def rule_stats_topk(s, d):
    q = _counted(s, d).withColumns({"avg_ns": F.round(F.col("time_ns") / F.col("calls"), 3), "fp_rate": F.round(F.col("ignores") / F.nullif(F.col("hits"), F.lit(0)), 3)})
    top = lambda c, name: q.orderBy(F.desc(c), "rule_id").limit(10).select(F.lit(name).alias("list"), "rule_id", F.col(c).cast("double").alias("value"))
    return top("avg_ns", "slow").unionByName(top("fp_rate", "noisy")).unionByName(top("hits", "triggered"))


_top = lambda e, n: f"(SELECT '{n}' AS list, rule_id, CAST({e} AS DOUBLE) AS value FROM q ORDER BY {e} DESC, rule_id LIMIT 10)"
R.add("rule_stats_topk", rule_stats_topk, " UNION ALL ".join([_top("round(time_ns::DOUBLE / calls, 3)", "slow"), _top("round(ignores::DOUBLE / nullif(hits, 0), 3)", "noisy"), _top("hits", "triggered")]), RUNS, _Q)
R.add("profile_rules", lambda s, d: _counted(s, d).orderBy(F.desc("time_ns"), "rule_id").limit(20).select("rule_id", "time_ns"), "SELECT rule_id, time_ns FROM q ORDER BY time_ns DESC, rule_id LIMIT 20", RUNS, _Q)
R.add("performance_summary", lambda s, d: runs(s, d).agg(F.count_distinct("rule_id").alias("rules_run"), F.round(100.0 * F.count_if("hit") / F.count("*"), 2).alias("hit_pct"), F.round(F.sum("time_ns") / 1e6, 3).alias("total_ms")), "SELECT count(DISTINCT rule_id) AS rules_run, round(100.0 * count(*) FILTER (hit) / count(*), 2) AS hit_pct, round(sum(time_ns) / 1e6, 3) AS total_ms FROM runs", RUNS)
R.add("replay_coverage", lambda s, d: audit.decisions(findings(s, d)).agg(F.count("*").alias("total"), F.count_if(F.col("review_level").isin("elevated", "critical")).alias("triggered"), F.round(F.count_if(F.col("review_level").isin("elevated", "critical")) / F.count("*"), 4).alias("hit_rate")), f"SELECT count(*) AS total, count(*) FILTER (c) AS triggered, round(count(*) FILTER (c)::DOUBLE / count(*), 4) AS hit_rate FROM (SELECT bool_or(is_blocking) OR coalesce(max({_SCORE}) FILTER (NOT experimental), 0) >= 3 AS c FROM findings GROUP BY diff_id)", FINDINGS)


def benchmark_precision(s, d):
    hits = findings(s, d).select("diff_id", "rule_id").distinct()
    expect = table(s, d, "customer").select(F.col("c_custkey").cast("long").alias("diff_id"), pick(RULE_IDS, F.col("c_custkey")).alias("whole"), pick(["security", "runtime", "null"], F.col("c_custkey")).alias("part"))
    both = hits.join(expect, "diff_id").withColumn("good", (F.col("rule_id") == F.col("whole")) | F.contains("rule_id", "part"))
    return both.agg(F.count_if("good").alias("tp"), F.count_if(~F.col("good")).alias("fp"), F.round(F.count_if("good") / F.nullif(F.count("*"), F.lit(0)), 4).alias("precision"))


R.add("benchmark_precision", benchmark_precision, f"SELECT count(*) FILTER (g) AS tp, count(*) FILTER (NOT g) AS fp, round(count(*) FILTER (g)::DOUBLE / nullif(count(*), 0), 4) AS precision FROM (SELECT f.rule_id = {sql_pick(RULE_IDS, 'c_custkey')} OR contains(f.rule_id, {sql_pick(['security', 'runtime', 'null'], 'c_custkey')}) AS g FROM (SELECT DISTINCT diff_id, rule_id FROM findings) f JOIN customer ON c_custkey = f.diff_id)", FINDINGS)

# --- reviews ----------------------------------------------------------------------------------------------------------
STATES = ["APPROVED", "COMMENTED", "CHANGES_REQUESTED", "APPROVED", "DISMISSED"]


def pr_approval(s, d):
    e = table(s, d, "events").select((F.col("event_id") % 200).alias("pr"), "user_id", pick(STATES, F.col("event_id")).alias("state"), "event_id")
    last = e.groupBy("pr", "user_id").agg(F.max_by("state", "event_id").alias("state"))
    return last.groupBy("pr").agg((F.bool_or(F.col("state") == "APPROVED") & ~F.bool_or(F.col("state") == "CHANGES_REQUESTED")).alias("approved"))


R.add("pr_approval", pr_approval, f"SELECT pr, bool_or(state = 'APPROVED') AND NOT bool_or(state = 'CHANGES_REQUESTED') AS approved FROM (SELECT event_id % 200 AS pr, user_id, arg_max({sql_pick(STATES, 'event_id')}, event_id) AS state FROM events GROUP BY 1, 2) GROUP BY 1")
R.add("ack_reaction", lambda s, d: table(s, d, "events").groupBy((F.col("event_id") % 500).alias("pr")).agg(F.bool_or(F.col("event_type").isin("signup", "purchase")).alias("acked")), "SELECT event_id % 500 AS pr, bool_or(event_type IN ('signup', 'purchase')) AS acked FROM events GROUP BY 1")
