"""Queries over diff structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.operators import parse
from riskweave.plans.base import DIFFS, FILES_CTE, LINES, PATCHES, SUMMARIES, Registry, effective_cte, summaries
from riskweave.sources import corpus, files
from riskweave.sources.corpus import table

R = Registry()
D = corpus.diffs

R.add("scan_diffs", lambda s, d: D(s, d).select("diff_id", F.length("raw_diff").alias("n_chars"), F.sha1("raw_diff").alias("digest")), "SELECT diff_id, CAST(length(raw_diff) AS INTEGER) AS n_chars, sha1(raw_diff) AS digest FROM diffs", DIFFS)
R.add("explode_lines", lambda s, d: parse.explode_lines(D(s, d)).select("diff_id", F.col("pos").cast("long").alias("pos"), "line"), "SELECT diff_id, CAST(pos AS BIGINT) AS pos, line FROM (SELECT *, max(pos) OVER (PARTITION BY diff_id) AS last FROM lines) WHERE pos < last OR line <> ''", DIFFS, LINES)
R.add(
    "json_guard",
    lambda s, d: table(s, d, "events").select("event_id", parse.is_json(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("diff --git "), "props")).otherwise(F.concat(F.lit("  "), "props"))).alias("is_json")),
    "SELECT event_id, event_id % 3 <> 0 AND regexp_matches(trim(props), '^[\\[{]') AS is_json FROM events",
)
R.add("patch_groups", lambda s, d: parse.grouped(D(s, d)).groupBy("diff_id", "grp").agg(F.count("*").alias("n_lines")), "SELECT diff_id, CAST(grp AS BIGINT) AS grp, count(*) AS n_lines FROM marked GROUP BY ALL", DIFFS, LINES)
R.add("patch_files", lambda s, d: parse.file_patches(D(s, d)).select("diff_id", "grp", "file"), "SELECT diff_id, CAST(grp AS BIGINT) AS grp, file FROM patches WHERE file IS NOT NULL", DIFFS, LINES, PATCHES)
R.add("new_files", lambda s, d: parse.file_patches(D(s, d)).where("is_new").select("diff_id", "file"), "SELECT diff_id, file FROM patches WHERE file IS NOT NULL AND is_new", DIFFS, LINES, PATCHES)
R.add("diff_files", lambda s, d: parse.diff_files(D(s, d)).select("diff_id", F.array_join("files", ",").alias("files")), "SELECT diff_id, array_to_string(files, ',') AS files FROM files_of", *SUMMARIES)
R.add("file_patches", lambda s, d: parse.file_patches(D(s, d)).select("diff_id", "grp", "file", F.md5("patch").alias("patch_md5"), "is_new"), "SELECT diff_id, CAST(grp AS BIGINT) AS grp, file, md5(patch) AS patch_md5, is_new FROM patches WHERE file IS NOT NULL", DIFFS, LINES, PATCHES)
R.add("diff_stats", lambda s, d: parse.diff_stats(D(s, d)).select("diff_id", "n_add", "n_del"), "SELECT diff_id, n_add, n_del FROM stats_of", *SUMMARIES)
_TYPE = "CASE WHEN regexp_matches(f, '[.](json|yaml|yml)$') THEN 'config' WHEN regexp_matches(f, '[.](ts|py|go|java)$') THEN 'logic' WHEN regexp_matches(f, '[.](md|txt)$') THEN 'doc' ELSE 'other' END"
R.add("change_types", lambda s, d: summaries(s, d).select("diff_id", F.array_join("change_types", ",").alias("change_types")), f"SELECT diff_id, array_to_string(list_sort(list_distinct(list_transform(files, lambda f: {_TYPE}))), ',') AS change_types FROM summaries", *SUMMARIES)
R.add("dedupe_by_digest", lambda s, d: parse.by_digest(D(s, d).withColumn("raw_diff", F.regexp_replace("raw_diff", "mod\\d+", "mod"))), "SELECT sha1(t) AS digest, count(*) AS n, min(diff_id) AS first_id FROM (SELECT diff_id, regexp_replace(raw_diff, 'mod\\d+', 'mod', 'g') AS t FROM diffs) GROUP BY 1", DIFFS)


def cache_hit_rate(s, d):
    keyed = D(s, d).withColumn("digest", F.sha1(F.regexp_replace("raw_diff", "mod\\d+", "mod")))
    memo = keyed.where("diff_id % 2 = 0").select("digest").distinct()
    got = keyed.join(memo.withColumn("hit", F.lit(1)), "digest", "left")
    return got.agg(F.count("*").alias("lookups"), F.count("hit").alias("hits"), F.round(100.0 * F.count("hit") / F.count("*"), 2).alias("hit_rate"))


R.add("cache_hit_rate", cache_hit_rate, "SELECT count(*) AS lookups, count(*) FILTER (h IN (SELECT h FROM k WHERE diff_id % 2 = 0)) AS hits, round(100.0 * count(*) FILTER (h IN (SELECT h FROM k WHERE diff_id % 2 = 0)) / count(*), 2) AS hit_rate FROM k", DIFFS, "k AS (SELECT diff_id, sha1(regexp_replace(raw_diff, 'mod\\d+', 'mod', 'g')) AS h FROM diffs)")
_LANG = "CASE regexp_extract(lower(file), '([.][^./]*)$', 1) WHEN '.java' THEN 'java' WHEN '.py' THEN 'python' WHEN '.go' THEN 'go' WHEN '.js' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.cpp' THEN 'cpp' ELSE 'unknown' END"
R.add("detect_language", lambda s, d: parse.file_patches(D(s, d)).groupBy(parse.language(F.col("file")).alias("language")).agg(F.count("*").alias("n")), f"SELECT {_LANG} AS language, count(*) AS n FROM patches WHERE file IS NOT NULL GROUP BY 1", DIFFS, LINES, PATCHES)
R.add(
    "first_added_position",
    lambda s, d: parse.first_added(D(s, d)).select("diff_id", F.col("position").cast("long").alias("position"), F.col("line").cast("long").alias("line")),
    """SELECT diff_id, min(pos) AS position, CAST(arg_min(new_line, pos) AS BIGINT) AS line FROM (
  SELECT *, first_value(start IGNORE NULLS) OVER w + sum(CASE WHEN NOT starts_with(line, '-') AND start IS NULL THEN 1 ELSE 0 END) OVER w - 1 AS new_line FROM (
    SELECT *, count(start) OVER (PARTITION BY diff_id ORDER BY pos) AS h FROM (
      SELECT *, CASE WHEN starts_with(line, '@@') THEN CAST(regexp_extract(line, '[+](\\d+)', 1) AS BIGINT) END AS start FROM lines))
  WINDOW w AS (PARTITION BY diff_id, h ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
WHERE starts_with(line, '+') AND NOT starts_with(line, '+++') AND h > 0 GROUP BY diff_id""",
    DIFFS, LINES,
)
R.add(
    "diff_validation",
    lambda s, d: D(s, d).select("diff_id", F.col("raw_diff").contains("diff --git").alias("has_git"), F.col("raw_diff").contains("\n+").alias("has_plus"), F.col("raw_diff").contains("\n-").alias("has_minus")),
    "SELECT diff_id, contains(raw_diff, 'diff --git') AS has_git, contains(raw_diff, chr(10) || '+') AS has_plus, contains(raw_diff, chr(10) || '-') AS has_minus FROM diffs", DIFFS,
)
R.add(
    "cache_prune_candidates",
    lambda s, d: table(s, d, "events").agg(F.count_if(F.col("ts") < F.lit("2024-01-11").cast("timestamp")).alias("candidates"), F.count("*").alias("entries")),
    "SELECT count(*) FILTER (ts < TIMESTAMP '2024-01-11') AS candidates, count(*) AS entries FROM events",
)
R.add(
    "cpp_split_files",
    # the header's third word loses all leading a and / characters, not the prefix a/
    lambda s, d: parse.explode_lines(D(s, d)).where("line like 'diff --git%'").select("diff_id", F.ltrim(F.get(F.split("line", " "), F.lit(2)), F.lit("a/")).alias("file")),
    "SELECT diff_id, ltrim(string_split(line, ' ')[3], 'a/') AS file FROM lines WHERE starts_with(line, 'diff --git')", DIFFS, LINES,
)


def rebuild_unified_diff(s, d):
    c = corpus.code_lines(s, d).groupBy("diff_id", "patch_no", "file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat("sign", "text").alias("l")))), lambda x: x.l), "\n").alias("body"))
    k = F.col("diff_id") + F.col("patch_no")
    changes = c.select("diff_id", F.col("patch_no").alias("pos"), F.when(k % 5 == 0, F.concat(F.lit("old/"), "file")).otherwise(F.col("file")).alias("old_path"), F.col("file").alias("new_path"), (k % 3 == 0).alias("is_new"), (k % 7 == 1).alias("is_deleted"), (k % 5 == 0).alias("is_renamed"), "body")
    return parse.rebuild(changes).select("diff_id", F.md5("raw_diff").alias("digest"))


R.add(
    "rebuild_unified_diff", rebuild_unified_diff,
    """SELECT diff_id, md5(string_agg('diff --git a/' || old || ' b/' || file || chr(10) || CASE WHEN k % 5 = 0 THEN 'rename from ' || old || chr(10) || 'rename to ' || file || chr(10) ELSE '' END
  || CASE WHEN k % 3 = 0 THEN '--- /dev/null' ELSE '--- a/' || old END || chr(10) || CASE WHEN k % 7 = 1 THEN '+++ /dev/null' ELSE '+++ b/' || file END || chr(10) || body, chr(10) ORDER BY patch_no)) AS digest
FROM (SELECT *, CASE WHEN k % 5 = 0 THEN 'old/' || file ELSE file END AS old FROM (
  SELECT diff_id, patch_no, file, diff_id + patch_no AS k, string_agg(sign || text, chr(10) ORDER BY pos) AS body FROM code_lines GROUP BY diff_id, patch_no, file)) GROUP BY diff_id""", DIFFS,
)


def diff_fallback(s, d):
    """Answers for a diff: every fifth is JSON, every seventh empty; change lists stand in, of which every nineteenth is cut off and every twenty-third lacking."""
    k = F.col("diff_id")
    raw = D(s, d).select("diff_id", F.when(k % 5 == 0, '{"message": "not found"}').when(k % 7 == 0, " ").otherwise(F.col("raw_diff")).alias("raw_diff"))
    c = corpus.code_lines(s, d).groupBy("diff_id", "patch_no", "file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat("sign", "text").alias("l")))), lambda x: x.l), "\n").alias("diff"))
    change = F.struct(F.concat(F.lit("old/"), "file").alias("old_path"), F.col("file").alias("new_path"), ((k + F.col("patch_no")) % 3 == 0).alias("new_file"), "diff")
    lists = c.groupBy("diff_id").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("patch_no", change.alias("c")))), lambda x: x["c"]).alias("changes"))).alias("body"))
    lists = lists.where("diff_id % 23 <> 0").withColumn("body", F.when(k % 19 == 0, F.substring("body", 1, 30)).otherwise(F.col("body")))
    return files.with_fallback(raw, lists).select("diff_id", "origin", F.md5("raw_diff").alias("digest"))


R.add(
    "diff_fallback", diff_fallback,
    """SELECT diff_id, CASE WHEN diff_id % 5 <> 0 AND diff_id % 7 <> 0 THEN 'raw' WHEN diff_id % 19 <> 0 AND diff_id % 23 <> 0 THEN 'changes' ELSE 'none' END AS origin,
  md5(CASE WHEN diff_id % 5 <> 0 AND diff_id % 7 <> 0 THEN raw_diff WHEN diff_id % 19 <> 0 AND diff_id % 23 <> 0 THEN rebuilt END) AS digest
FROM diffs JOIN (SELECT diff_id, string_agg('diff --git a/old/' || file || ' b/' || file || chr(10) || CASE WHEN (diff_id + patch_no) % 3 = 0 THEN '--- /dev/null' ELSE '--- a/old/' || file END || chr(10) || '+++ b/' || file || chr(10) || body, chr(10) ORDER BY patch_no) AS rebuilt
  FROM (SELECT diff_id, patch_no, file, string_agg(sign || text, chr(10) ORDER BY pos) AS body FROM code_lines GROUP BY ALL) GROUP BY diff_id) USING (diff_id)""", DIFFS,
)


def _effective(s, d):
    from riskweave.operators import audit

    return audit.effective(summaries(s, d))


R.add("skip_paths", lambda s, d: _effective(s, d).select("diff_id", F.size("files").alias("n_files"), F.size("effective").alias("n_effective")), "SELECT diff_id, CAST(len(files) AS INTEGER) AS n_files, CAST(len(eff) AS INTEGER) AS n_effective FROM effective", *SUMMARIES, effective_cte())
R.add("mostly_new", lambda s, d: _effective(s, d).select("diff_id", "mostly_new"), "SELECT diff_id, mostly_new FROM effective", *SUMMARIES, effective_cte())
R.add("analysis_tier", lambda s, d: summaries(s, d).select(F.size("files").alias("n_files"), F.when(F.size("files") > 30, "tier3").when(F.size("files") > 10, "light").otherwise("deep").alias("tier")).groupBy("tier", "n_files").agg(F.count("*").alias("n")), "SELECT CASE WHEN len(files) > 30 THEN 'tier3' WHEN len(files) > 10 THEN 'light' ELSE 'deep' END AS tier, CAST(len(files) AS INTEGER) AS n_files, count(*) AS n FROM summaries GROUP BY ALL", *SUMMARIES)
R.add("ast_cache_key", lambda s, d: parse.file_patches(D(s, d)).select("diff_id", "grp", F.sha1(F.concat(F.lit("class:"), "patch")).alias("cache_key")), "SELECT diff_id, CAST(grp AS BIGINT) AS grp, sha1('class:' || patch) AS cache_key FROM patches WHERE file IS NOT NULL", DIFFS, LINES, PATCHES)
