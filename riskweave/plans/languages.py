"""Queries over source text by language, and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.operators import builtin_rules, languages, parse
from riskweave.plans.base import DIFFS, LINES, PATCHES, Registry, sql_pick
from riskweave.sources import corpus
from riskweave.sources.corpus import pick, table
from riskweave.streaming import streams

R = Registry()
_q = lambda p: "'" + p.replace("'", "''") + "'"
EXTRA = ["defer f.Close()", "std::unique_ptr<Foo> p;", "strcpy(buf, src);", "func main() {", "export class A {", "mu.Lock()", "std::thread t(run);", "panic(err)", "await fetch(url)", "int *p = new int[5];", "select {", "x = a + 10", 'import "unsafe"', "func (s *S) run() {", "}}", "}"]


def source(s, d):
    """(file, line, text): a file a diff of code lines, with more lines of other languages."""
    c = corpus.code_lines(s, d)
    return c.select(F.col("diff_id").alias("file"), F.col("pos").alias("line"), F.when(F.col("pos") % 2 == 0, pick(EXTRA, F.col("diff_id") + F.col("pos"))).otherwise(F.col("text")).alias("text"))


SOURCE = f"source AS (SELECT diff_id AS file, pos AS line, CASE WHEN pos % 2 = 0 THEN {sql_pick(EXTRA, 'diff_id + pos')} ELSE text END AS text FROM code_lines)"


def ranges(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").cast("long").alias("k"))
    return o.select(F.col("k").alias("file"), (F.col("k") % 3 + 1).cast("int").alias("start_line"), (F.col("k") % 3 + 1 + F.col("k") % 4).cast("int").alias("end_line"))


RANGES = "ranges AS (SELECT CAST(o_orderkey AS BIGINT) AS file, o_orderkey % 3 + 1 AS start_line, o_orderkey % 3 + 1 + o_orderkey % 4 AS end_line FROM orders)"


DEPTHS = """depths AS (
  SELECT *, after - opened + closed AS before, max(line) OVER (PARTITION BY file) AS final FROM (SELECT *, sum(opened - closed) OVER (PARTITION BY file ORDER BY line) AS after FROM (
    SELECT *, len(text) - len(replace(text, chr(123), '')) AS opened, len(text) - len(replace(text, chr(125), '')) AS closed FROM source)))"""


def _nodes_sql(patterns: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT file, line, '{k}' AS node FROM source WHERE regexp_matches(text, {_q(p)})" for k, p in patterns.items())


for _name, _patterns, _ids in (("go", languages.GO_NODES, languages.GO_SIGNALS), ("cpp", languages.CPP_NODES, languages.CPP_SIGNALS), ("js", languages.JS_NODES, languages.JS_SIGNALS)):
    R.add(f"{_name}_line_nodes", lambda s, d, p=_patterns: languages.nodes(source(s, d), p), _nodes_sql(_patterns), DIFFS, SOURCE)
    R.add(
        f"{_name}_signals", lambda s, d, p=_patterns, i=_ids: languages.signals(languages.nodes(source(s, d), p), ranges(s, d), i),
        "SELECT file, line, CASE node " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _ids.items()) + f" END AS signal_id FROM ({_nodes_sql(_patterns)}) n WHERE node IN ({', '.join(map(repr, _ids))}) AND EXISTS (SELECT 1 FROM ranges r WHERE r.file = n.file AND n.line BETWEEN r.start_line AND r.end_line)", DIFFS, SOURCE, RANGES,
    )


R.add(
    "go_function_spans", lambda s, d: languages.brace_spans(source(s, d), languages.GO_NODES["function"]).select("file", "line", "last"),
    # the next line by whose end no more is open than before, searched for
    f"""SELECT r.file, r.line, coalesce(CASE WHEN r.after <= r.before THEN r.line END, min(c.line), any_value(r.final)) AS last
FROM depths r LEFT JOIN depths c ON c.file = r.file AND c.line > r.line AND c.after <= r.before AND c.after < c.before WHERE regexp_matches(r.text, {_q(languages.GO_NODES["function"])}) AND contains(r.text, chr(123)) GROUP BY r.file, r.line, r.after, r.before""",
    DIFFS, SOURCE, DEPTHS,
)
R.add(
    "go_changed_functions", lambda s, d: languages.signals(languages.brace_spans(source(s, d), languages.GO_NODES["function"]).withColumn("node", F.lit("function")), ranges(s, d), {"function": "function_changed"}).select("file", "line"),
    f"""SELECT DISTINCT f.file, f.line FROM (SELECT r.file, r.line, coalesce(CASE WHEN r.after <= r.before THEN r.line END, min(c.line), any_value(r.final)) AS last
FROM depths r LEFT JOIN depths c ON c.file = r.file AND c.line > r.line AND c.after <= r.before AND c.after < c.before WHERE regexp_matches(r.text, {_q(languages.GO_NODES["function"])}) AND contains(r.text, chr(123)) GROUP BY r.file, r.line, r.after, r.before) f
JOIN ranges g ON g.file = f.file AND g.start_line <= f.last AND g.end_line >= f.line""",
    DIFFS, SOURCE, DEPTHS, RANGES,
)
R.add("go_unsafe_imports", lambda s, d: languages.unsafe_imports(source(s, d)), "SELECT DISTINCT file, 0 AS line, 'runtime.security.unsafe_package_used' AS signal_id FROM source WHERE text = 'import \"unsafe\"'", DIFFS, SOURCE)


def _typed(s, d):
    kinds = {"goroutine": "high", "panic": "high", "mutex": "medium", "channel": "medium", "select": "low", "defer": "low"}
    return languages.nodes(source(s, d), {k: languages.GO_NODES[k] for k in kinds}).groupBy("node").agg(F.count("*").alias("n")).select("node", "n", F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("node")].alias("severity"))


R.add("go_enhanced_signals", _typed, f"SELECT node, count(*) AS n, CASE WHEN node IN ('goroutine', 'panic') THEN 'high' WHEN node IN ('mutex', 'channel') THEN 'medium' ELSE 'low' END AS severity FROM ({_nodes_sql({k: languages.GO_NODES[k] for k in ('goroutine', 'panic', 'mutex', 'channel', 'select', 'defer')})}) GROUP BY node", DIFFS, SOURCE)


def cpp_pattern_counts(s, d):
    x = source(s, d).select("file", F.explode(languages.pattern_counts(F.col("text"))).alias("x")).groupBy("x.pattern").agg(F.sum("x.n").alias("n"))
    group = F.create_map(*[F.lit(x) for kv in languages.CPP_PATTERN_GROUP.items() for x in kv])
    return x.select("pattern", "n", F.coalesce(group[F.col("pattern")], F.lit("none")).alias("category"))


R.add("cpp_pattern_counts", cpp_pattern_counts, " UNION ALL ".join(f"SELECT '{k}' AS pattern, CAST(sum(len(regexp_extract_all(text, {_q(p)}))) AS BIGINT) AS n, '{languages.CPP_PATTERN_GROUP.get(k, 'none')}' AS category FROM source" for k, p in languages.CPP_PATTERNS.items()), DIFFS, SOURCE)


def js_content_signals(s, d):
    p = parse.file_patches(corpus.diffs(s, d)).where("file like '%.js' or file like '%.ts'")
    found = F.filter(F.array(*[F.when(F.col("patch").rlike(x), k) for k, x in languages.JS_CONTENT.items()]), lambda x: x.isNotNull())
    return p.select("diff_id", "grp", F.explode(found).alias("signal_id"))


R.add("js_content_signals", js_content_signals, " UNION ALL ".join(f"SELECT diff_id, CAST(grp AS BIGINT) AS grp, '{k}' AS signal_id FROM patches WHERE (file LIKE '%.js' OR file LIKE '%.ts') AND regexp_matches(patch, {_q(p)})" for k, p in languages.JS_CONTENT.items()), DIFFS, LINES, PATCHES)
R.add("parser_dispatch", lambda s, d: parse.file_patches(corpus.diffs(s, d)).select("diff_id", "grp", F.when(parse.language(F.col("file")).isin("java", "go"), "none").when(parse.language(F.col("file")).isin("python", "javascript", "typescript", "cpp", "c"), parse.language(F.col("file"))).otherwise("none").alias("parser")), "SELECT diff_id, CAST(grp AS BIGINT) AS grp, CASE WHEN file LIKE '%.py' THEN 'python' WHEN file LIKE '%.js' THEN 'javascript' WHEN file LIKE '%.ts' THEN 'typescript' WHEN file LIKE '%.cpp' THEN 'cpp' ELSE 'none' END AS parser FROM patches WHERE file IS NOT NULL", DIFFS, LINES, PATCHES)


def python_nodes(s, d):
    lines = pick(["import os", "def f(a):\n    return g(a)", "class A:\n    x = 1", "y = open('p').read()", "def broken(:"], F.col("l_partkey"))
    files = table(s, d, "lineitem").where("l_linenumber = 1").groupBy(F.col("l_orderkey").cast("string").alias("file")).agg(F.array_join(F.array_sort(F.collect_list(lines)), "\n").alias("text"))
    return languages.python_nodes(files)


R.add("python_nodes", python_nodes)


def adapter_pattern_counts(s, d):
    langs = F.array(*[F.struct(F.lit(k).alias("language"), *[F.col("text").rlike(builtin_rules.java_regex(p)).cast("int").alias(n) for n, p in (("opens", v[0]), ("closes", v[1]), ("checks", v[2]))]) for k, v in builtin_rules.CROSS.items()])
    return source(s, d).select(F.explode(langs).alias("x")).groupBy("x.language").agg(*[F.sum(f"x.{n}").alias(n) for n in ("opens", "closes", "checks")])


R.add("adapter_pattern_counts", adapter_pattern_counts, " UNION ALL ".join("SELECT '" + k + "' AS language, " + ", ".join(f"CAST(sum(CAST(regexp_matches(text, {_q(builtin_rules.java_regex(p))}) AS INTEGER)) AS BIGINT) AS {n}" for n, p in (("opens", v[0]), ("closes", v[1]), ("checks", v[2]))) + " FROM source" for k, v in builtin_rules.CROSS.items()), DIFFS, SOURCE)

# --- streams: an extension; each query runs over the files that are there and ends -------------------------------------
R.add("stream_quality", streams.quality, f"SELECT {sql_pick(streams.RULE_IDS, 'user_id')} AS rule_id, count(*) AS runs, count(*) FILTER (event_type <> 'view') AS hits FROM events GROUP BY 1")
R.add("stream_window_findings", streams.windows, "SELECT CAST(CAST(date_trunc('day', ts) AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
R.add("stream_dedupe", streams.dedupe)
R.add("stream_diffs", streams.diffs)
_EVENT_RULE = sql_pick(streams.RULE_IDS, "user_id")
R.add(
    "stream_comment_upsert", streams.comments,
    f"SELECT tag, arg_max(body, seq) AS body, max(seq) AS seq FROM (SELECT {_EVENT_RULE} AS tag, event_type || ' ' || event_id AS body, CAST(event_id AS BIGINT) AS seq FROM events UNION ALL SELECT {_EVENT_RULE}, 'old', -1 FROM events WHERE event_id % 97 = 0) GROUP BY tag",
)
R.add("stream_counters", streams.counters, f"SELECT {_EVENT_RULE} AS rule_id, count(*) AS calls, count(*) FILTER (event_type <> 'view') AS hits, count(*) FILTER (event_type = 'error') AS ignores, CAST(sum(event_id % 1000 * 1000) AS BIGINT) AS time_ns FROM events GROUP BY 1")
