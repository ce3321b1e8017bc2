"""Queries over rule matching and detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.functions import dialect
from riskweave.operators import audit, builtin_rules, detect, snippets
from riskweave.plans.base import SUMMARIES, DIFFS, LINES, PATCHES, Registry, effective_cte, summaries
from riskweave.sources import catalog, corpus

R = Registry()
D = corpus.diffs


def _quote(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _effective(s, d):
    return audit.effective(summaries(s, d))


def _code(rules, semantics="compat"):
    def run(s, d):
        got = audit.match_code(summaries(s, d).withColumns({"effective": F.col("files"), "mostly_new": F.lit(False)}), None, rules, semantics)
        names = F.array(*[F.lit(r.rule_id) for r in rules])
        return got.select("diff_id", F.element_at(names, F.col("load_order") + 1).alias("rule_id"), "matched_file")

    return run


def _code_sql(rules) -> str | None:
    parts = [builtin_rules.duck(r) for r in rules]
    if any(p is None for p in parts):
        return None
    fits = lambda r: "len(files) > 0" if r.language == "*" else "len(list_filter(files, lambda f: " + " OR ".join(f"ends_with(f, '{e}')" for e in catalog.LANGUAGE_EXTENSIONS[r.language]) + ")) > 0"
    return "SELECT * FROM (" + "\nUNION ALL\n".join(f"SELECT diff_id, '{r.rule_id}' AS rule_id, {p} AS matched_file FROM summaries WHERE {fits(r)}" for r, p in zip(rules, parts, strict=True)) + ") WHERE matched_file IS NOT NULL"


for _r in builtin_rules.RULES:
    R.add("rule_" + _r.rule_id.replace(".", "_"), _code([_r]), _code_sql([_r]), *SUMMARIES)

_BY = {}
for _r in builtin_rules.RULES:
    _BY.setdefault(_r.strategy, []).append(_r)


def _checked(rules):
    return [r for r in rules if builtin_rules.duck(r) is not None]


for _key, _strategies in {
    "match_presence": ["any", "all"], "match_without": ["without"], "match_count_delta": ["fewer"], "match_type_pairs": ["downgrade"], "match_line": ["line", "raw_type"], "match_line_path": ["line_path", "catch_path"],
    "match_following": ["following"], "match_foreach_remove": ["foreach_remove"], "match_aslist_modify": ["aslist_modify"], "match_signature_change": ["signature"], "match_added_text": ["added_text"],
}.items():
    _some = [r for x in _strategies for r in _BY[x]]
    _some = _checked(_some) or _some
    R.add(_key, _code(_some), _code_sql(_some), *SUMMARIES)
_cross = [r for lang in builtin_rules.CROSS for r in builtin_rules.cross_rules(lang)]
R.add("match_context", _code([r for r in _cross if r.strategy == "context"]), _code_sql([r for r in _cross if r.strategy == "context"]), *SUMMARIES)
R.add("cross_language", _code([r for r in _cross if r.strategy != "context"]), _code_sql([r for r in _cross if r.strategy != "context"]), *SUMMARIES)
R.add("go_class_rules", _code(builtin_rules.GO_RULES), _code_sql(builtin_rules.GO_RULES), *SUMMARIES)
_adapter = [r for r in builtin_rules.RULES if r.rule_id in ("runtime.concurrency_regression", "runtime.thread_safety_removal")]
R.add("adapter_rules", _code(_adapter), _code_sql(_adapter), *SUMMARIES)
R.add("intended_semantics", _code([r for r in builtin_rules.RULES if r.strategy in ("any", "without")], "intended"))

# --- pattern rules ----------------------------------------------------------------------------------------------------


def _duck_rules() -> str:
    """The pattern rules that RE2 takes, as a table."""
    out = []
    for r in audit.rule_table(catalog.rows()):
        if r["match"] and not r["signal"] and catalog.valid_pattern(r["match"]):
            exts = catalog.LANGUAGE_EXTENSIONS.get(r["language"], [f".{r['language']}"])
            ext = "^" if r["language"] == "*" else "(" + "|".join(e.replace(".", "[.]").replace("+", "[+]") for e in exts) + ")$"
            out.append(f"({r['load_order']}, {_quote('(?m' + ('i' if r['flags'] == 'i' else '') + ')' + dialect.java_regex(r['match']))}, {_quote(dialect.file_glob_regex(r['file'] or '**'))}, {_quote('^' if r['scope'] == '**' else dialect.glob_regex(r['scope']))}, {_quote(ext)}, {str(r['rule_type'] == 'regression').lower()}, {str(r['language'] == '*' and r['scope'] == '**').lower()})")
    return "rules(load_order, pattern, file_regex, scope_regex, ext_regex, regression, everywhere) AS (VALUES " + ", ".join(out) + ")"


_ELIGIBLE = "(everywhere AND len(eff) > 0 OR len(list_filter(eff, lambda f: regexp_matches(f, ext_regex) AND regexp_matches(f, scope_regex))) > 0) AND NOT (regression AND mostly_new)"
R.add(
    "match_regex", lambda s, d: audit.match_regex(_effective(s, d), audit.compiled(s, catalog.rows())),
    f"SELECT diff_id, load_order, list_filter(files, lambda f: regexp_matches(f, file_regex))[1] AS matched_file FROM effective, rules WHERE {_ELIGIBLE} AND regexp_matches(raw_diff, pattern) AND len(list_filter(files, lambda f: regexp_matches(f, file_regex))) > 0",
    *SUMMARIES, effective_cte(), _duck_rules(),
)
R.add(
    "schedule_rules",
    lambda s, d: audit.scheduled_counts(_effective(s, d).drop("raw_diff"), audit.compiled(s, catalog.rows()).where("strategy = 'regex'")),
    f"SELECT load_order, count(*) AS n_diffs FROM effective, rules WHERE {_ELIGIBLE} GROUP BY 1", *SUMMARIES, effective_cte(), _duck_rules(),
)
R.add(
    "skip_regression",
    lambda s, d: _effective(s, d).groupBy("mostly_new").agg(F.count("*").alias("n_diffs"), F.sum(F.when(F.col("mostly_new"), 0).otherwise(len([r for r in builtin_rules.RULES if r.rule_type == "regression"]))).cast("long").alias("n_scheduled")),
    f"SELECT mostly_new, count(*) AS n_diffs, CAST(sum(CASE WHEN mostly_new THEN 0 ELSE {len([r for r in builtin_rules.RULES if r.rule_type == 'regression'])} END) AS BIGINT) AS n_scheduled FROM effective GROUP BY 1", *SUMMARIES, effective_cte(),
)
_FILE_RULES = [catalog.normalized({"id": f"touch.{k}", "file": g, "severity": "low"}, i, "rows") for i, (k, g) in enumerate([("dto", "*/dto/*"), ("go", "*.go"), ("lib", "lib/*"), ("pkg", "**/package.json")])]
R.add(
    "match_file", lambda s, d: audit.match_file(_effective(s, d), audit.compiled(s, _FILE_RULES)).select("load_order", "matched_file", "diff_id"),
    "SELECT * FROM (" + "\nUNION ALL\n".join(
        f"SELECT {r[0]} AS load_order, list_filter(files, lambda f: regexp_matches(f, {_quote(dialect.file_glob_regex(r[6]))}))[1] AS matched_file, diff_id FROM effective WHERE len(list_filter(eff, lambda f: regexp_matches(f, {_quote(dialect.glob_regex(r[6]))}))) > 0" for r in _FILE_RULES) + ") WHERE matched_file IS NOT NULL",
    *SUMMARIES, effective_cte(),
)
_GLOBS = ["*.py", "**/*.py", "src/*", "**/mod1.java", "[a-l]*/?od*", "**"]
R.add(
    "glob_match",
    lambda s, d: corpus.code_lines(s, d).select("file").distinct().select("file", *[F.col("file").rlike(dialect.file_glob_regex(g)).alias(f"g{i}") for i, g in enumerate(_GLOBS)]),
    # plain LIKE and GLOB forms of the same globs
    "SELECT DISTINCT file, file LIKE '%.py' AS g0, file LIKE '%/%.py' AS g1, file LIKE 'src/%' AS g2, file = 'mod1.java' OR file LIKE '%/mod1.java' AS g3, regexp_matches(file, '^[a-l].*/.od') AS g4, true AS g5 FROM code_lines", DIFFS,
)

# --- detection --------------------------------------------------------------------------------------------------------
SIDES = f"""sides AS (
  SELECT diff_id, grp, file, side, CAST(row_number() OVER (PARTITION BY diff_id, grp, side ORDER BY pos) AS INTEGER) AS n, text FROM (
    SELECT diff_id, grp, file, pos, CASE WHEN starts_with(line, '+') AND NOT starts_with(line, '+++') THEN 'added' WHEN starts_with(line, '-') AND NOT starts_with(line, '---') THEN 'removed' END AS side, trim(substr(line, 2)) AS text
    FROM (SELECT diff_id, grp, file, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT diff_id, grp, file, string_split(patch, chr(10)) AS l FROM patches
      WHERE regexp_matches(lower(file), '[.]({"|".join(e[1:] for e in detect.ANALYZABLE)})$')))) WHERE side IS NOT NULL),
tokenised AS (SELECT *, regexp_extract_all(regexp_replace(text, '//[^\\n]*|/\\*.*?\\*/', ' ', 'g'), {_quote(detect.TOKEN)}) AS t FROM sides)"""
SIDE = (DIFFS, LINES, PATCHES, SIDES)
R.add("analyzable_patches", lambda s, d: detect.side_lines(D(s, d)).groupBy("diff_id", "grp", "file").agg(F.count("*").alias("n")), "SELECT diff_id, CAST(grp AS BIGINT) AS grp, file, count(*) AS n FROM sides GROUP BY ALL", *SIDE)
R.add("added_removed_lines", lambda s, d: detect.side_lines(D(s, d)).select("diff_id", "grp", "side", "n", "text"), "SELECT diff_id, CAST(grp AS BIGINT) AS grp, side, n, text FROM sides", *SIDE)
R.add("tokens", lambda s, d: detect.tokenised(detect.side_lines(D(s, d))).select("diff_id", "grp", "side", "n", F.array_join("t", " ").alias("tokens")), "SELECT diff_id, CAST(grp AS BIGINT) AS grp, side, n, array_to_string(t, ' ') AS tokens FROM tokenised", *SIDE)


def _changes(s, d):
    lines = detect.tokenised(detect.side_lines(D(s, d)))
    return lines.select("diff_id", "grp", "side", "n", F.explode(detect.token_changes(*[F.col(c) for c in ("side", "text", "t", "g2", "g3")])).alias("c")).select("diff_id", "grp", "side", "n", "c.*")


def _tok(name: str, keep: str, cond: str, symbol: str | None = None) -> None:
    sym = symbol or "unnest(list_distinct(list_filter(t, lambda x: " + cond + ")))"
    where = f"WHERE {cond}" if symbol else ""
    R.add(name, lambda s, d: _changes(s, d).where(keep).select("diff_id", "side", "n", "symbol").distinct(), f"SELECT DISTINCT diff_id, side, n, {sym} AS symbol FROM tokenised {where}", *SIDE)


_g = lambda *ts: "contains(' ' || array_to_string(t, ' ') || ' ', ' " + " ".join(ts) + " ')"
_in = lambda words: "x IN (" + ", ".join(f"'{w}'" for w in words) + ")"
_tok("tok_modifier", "symbol in ('synchronized', 'volatile') and kind like 'MODIFIER%'", _in(["synchronized", "volatile"]))
_tok("tok_concurrent_map", "symbol = 'ConcurrentHashMap'", "side = 'removed' AND list_contains(t, 'ConcurrentHashMap')", "'ConcurrentHashMap'")
_tok("tok_pagination", "symbol in ('pageNo', 'pageSize', 'start', 'limit', 'offset')", _in(detect.PAGINATION))
_tok("tok_trigram", "symbol = 'sleep'", _g("Thread", ".", "sleep"), "'sleep'")
R.add("tok_critical_call", lambda s, d: _changes(s, d).where(F.col("symbol").isin(*detect.CRITICAL_CALLS)).select("diff_id", "side", "n", "symbol").distinct(), "SELECT DISTINCT diff_id, side, n, w AS symbol FROM tokenised, (SELECT unnest([" + ", ".join(f"'{w}'" for w in detect.CRITICAL_CALLS) + "]) AS w) WHERE contains(' ' || array_to_string(t, ' ') || ' ', ' ' || w || ' ( ')", *SIDE)
_tok("tok_secret", "symbol = 'hardcoded_secret'", "len(list_filter(t, lambda x: length(x) > 3 AND regexp_matches(lower(x), '" + "|".join(detect.SECRET_WORDS) + "') AND regexp_matches(x, '[=:]'))) > 0", "'hardcoded_secret'")
STREAM = f"""lexed AS (
  SELECT diff_id, grp, file, side, unnest(range(len(l))) AS p, unnest(l) AS w
  FROM (SELECT diff_id, grp, file, side, regexp_extract_all(string_agg(text, chr(10) ORDER BY n), {_quote(snippets.LEXEME)}) AS l FROM sides GROUP BY ALL)
  WHERE len(list_filter(l, lambda w: w IN ('"', chr(39), '#', chr(92), '`') OR starts_with(w, '/*') AND NOT (len(w) > 3 AND ends_with(w, '*/')))) = 0),
stream AS (
  SELECT diff_id, grp, file, side, CAST(n AS INTEGER) AS n, w, row_number() OVER (PARTITION BY diff_id, grp, side ORDER BY p) AS i FROM (
    SELECT *, 1 + coalesce(sum(len(w) - len(replace(w, chr(10), ''))) OVER (PARTITION BY diff_id, grp, side ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM lexed)
  WHERE w <> chr(10) AND NOT starts_with(w, '//') AND NOT starts_with(w, '/*'))"""


def _stream(s, d):
    return snippets.stream(snippets.sides(detect.side_lines(D(s, d))))


R.add("token_stream", lambda s, d: _stream(s, d).select("diff_id", "grp", "side", "i", "n", "w"), "SELECT diff_id, CAST(grp AS BIGINT) AS grp, side, CAST(i AS INTEGER) AS i, n, w FROM stream", *SIDE, STREAM)
R.add(
    # the context by a join of positions instead of a frame
    "tok_sql_concat", lambda s, d: snippets.sql_concatenations(_stream(s, d)).select("diff_id", "side", "n").distinct(),
    "SELECT DISTINCT a.diff_id, a.side, a.n FROM stream a JOIN stream b ON a.diff_id = b.diff_id AND a.grp = b.grp AND a.side = b.side AND b.i BETWEEN a.i - 20 AND a.i - 1 WHERE a.w IN ('+', 'concat', 'append') AND lower(b.w) IN (" + ", ".join(f"'{w.lower()}'" for w in snippets.SQL_WORDS) + ")",
    *SIDE, STREAM,
)
_tok("tok_weak_crypto", "symbol = 'weak_crypto'", "len(list_filter(t, lambda x: replace(x, '\"', '') IN (" + ", ".join(f"'{w}'" for w in detect.WEAK_CRYPTO) + "))) > 0", "'weak_crypto'")
_tok("tok_command", "symbol = 'command_execution'", "(" + " OR ".join(_g(w, "(") for w in detect.COMMANDS) + ")", "'command_execution'")
_TREE = {
    "static_unsafe": ("symbol = 'static_collection'", "side = 'added' AND regexp_matches(text, '\\bstatic\\b.*\\b(" + "|".join(detect.UNSAFE_COLLECTIONS) + ")\\b\\s*(<[^;=]*>)?\\s+\\w+\\s*[=;]')"),
    "tpe_creation": ("symbol = 'ThreadPoolExecutor'", "side = 'added' AND regexp_matches(text, '\\bnew\\s+ThreadPoolExecutor\\s*\\(')"),
    "unbounded_queue": ("symbol = 'LinkedBlockingQueue'", "side = 'added' AND regexp_matches(text, '\\bnew\\s+LinkedBlockingQueue\\s*(<[^>]*>)?\\s*\\(\\s*(Integer\\.MAX_VALUE)?\\s*\\)')"),
    "busy_wait": ("symbol = 'while_true'", "side = 'added' AND regexp_matches(text, '\\bwhile\\s*\\(\\s*true\\s*\\)')"),
    "twr_removed": ("symbol = 'try_with_resources'", "side = 'removed' AND regexp_matches(text, '\\btry\\s*\\(')"),
    "cache_evict_removed": ("symbol = 'cache'", "side = 'removed' AND regexp_matches(text, '(?i)cache|redis|map') AND (" + " OR ".join(_g(w, "(") for w in detect.EVICTIONS) + ")"),
    "timeout_removed": ("symbol = 'timeout'", "side = 'removed' AND regexp_matches(text, '(?i)\\w*timeout\\w*\\s*\\(')"),
    "eq_ops": ("symbol in ('equals', '==')", "side = 'removed' AND " + _g("equals", "(") + " OR side = 'added' AND list_contains(t, '==')"),
    "null_check_removed": ("symbol = 'null_check'", "side = 'removed' AND regexp_matches(text, '\\bif\\s*\\(\\s*(\\w+\\s*==\\s*null|null\\s*==\\s*\\w+)\\s*\\)')"),
    "general_calls": ("symbol in ('newFixedThreadPool', 'newCachedThreadPool', 'get')", "side = 'added' AND (" + _g("newFixedThreadPool", "(") + " OR " + _g("newCachedThreadPool", "(") + " OR regexp_matches(text, '\\.get\\s*\\(\\s*\\)'))"),
    "tree_calls": ("symbol = 'lock'", _g(".", "lock", "(") + " OR regexp_matches(text, '^\\s*lock\\s*\\(')"),
    "tree_modifiers": ("symbol in ('synchronized', 'volatile', 'final') and kind like 'MODIFIER%'", "list_contains(t, 'synchronized') OR list_contains(t, 'volatile') OR side = 'removed' AND list_contains(t, 'final')"),
}
for _k, (_keep, _cond) in _TREE.items():
    R.add(_k, lambda s, d, keep=_keep: _changes(s, d).where(keep).select("diff_id", "grp", "side", "n").distinct(), f"SELECT DISTINCT diff_id, CAST(grp AS BIGINT) AS grp, side, n FROM tokenised WHERE {_cond}", *SIDE)
_WORD = "regexp_matches({0}, '^[A-Za-z_$]') AND {0} NOT IN (" + ", ".join(f"'{w}'" for w in snippets.KEYWORDS) + ")"
AS_OF = f"""near AS (
  SELECT *, lag(w) OVER o AS before, lag(w, 2) OVER o AS before2, lag(w, 3) OVER o AS before3, lead(w) OVER o AS after FROM stream WINDOW o AS (PARTITION BY diff_id, grp, side ORDER BY i)),
named AS (SELECT * FROM near WHERE {_WORD.format("w")} AND w NOT IN ({", ".join(f"'{w}'" for w in snippets.BASIC_TYPES)}) AND after IN ('=', ';', ',')),
declared AS (  -- with type arguments one level deep, or without
  SELECT diff_id, grp, side, i, w, before AS type FROM named WHERE {_WORD.format("before")}
  UNION ALL
  SELECT n.diff_id, n.grp, n.side, n.i, n.w, o.before FROM named n ASOF JOIN (SELECT * FROM near WHERE w = '<') o ON n.diff_id = o.diff_id AND n.grp = o.grp AND n.side = o.side AND n.i > o.i WHERE n.before = '>' AND {_WORD.format("o.before")}),
called AS (SELECT * FROM near WHERE {_WORD.format("w")} AND after = '(' AND before = '.' AND {_WORD.format("before2")} AND coalesce(before3, '') <> '.')"""
R.add(
    "typed_calls", lambda s, d: snippets.typed_calls(_stream(s, d)).select("diff_id", "grp", "side", "n", "name", "var", "type"),
    "SELECT c.diff_id, CAST(c.grp AS BIGINT) AS grp, c.side, c.n, c.w AS name, c.before2 AS var, p.type FROM called c ASOF JOIN declared p ON c.diff_id = p.diff_id AND c.grp = p.grp AND c.side = p.side AND c.before2 = p.w AND c.i >= p.i",
    *SIDE, STREAM, AS_OF,
)
R.add("tree_parse", lambda s, d: snippets.wrappers(_stream(s, d)).select("diff_id", "grp", "side", "wrapper"))
R.add("var_types_fallback", lambda s, d: snippets.fallback_types(_stream(s, d)).select("diff_id", "grp", "side", "var", "type"))
R.add("atomic_set_removed", lambda s, d: snippets.atomic_sets(_stream(s, d)).where("side = 'removed'").select("diff_id", "grp", "side", "n", "var"))
TYPES = """typed AS (
  SELECT diff_id, grp, file, side, regexp_extract(text, p, 2) AS var, arg_max(regexp_extract(text, p, 1), n) AS type
  FROM sides, (SELECT '\\b([A-Z]\\w*)(?:<[^;=()]*>)?\\s+([a-z]\\w*)\\s*[=;,]' AS p) WHERE regexp_matches(text, p) GROUP BY ALL),
safe AS (SELECT unnest([""" + ", ".join(f"'{x}'" for x in detect.THREAD_SAFE) + """]) AS t),
downgrades AS (
  SELECT o.diff_id, o.grp, o.file, o.var, o.type AS old, n.type AS new FROM typed o JOIN typed n ON o.diff_id = n.diff_id AND o.grp = n.grp AND o.var = n.var
  WHERE o.side = 'removed' AND n.side = 'added' AND o.type IN (FROM safe) AND n.type NOT IN (FROM safe))"""
R.add("var_types", lambda s, d: detect.var_types(detect.side_lines(D(s, d))).select("diff_id", "grp", "side", "var", "type"), "SELECT diff_id, CAST(grp AS BIGINT) AS grp, side, var, type FROM (SELECT diff_id, grp, side, var, type FROM typed)", *SIDE, TYPES)
R.add("type_downgrade", lambda s, d: detect.type_downgrades(detect.side_lines(D(s, d))).select("diff_id", "var", "old", "new"), "SELECT diff_id, var, old, new FROM downgrades", *SIDE, TYPES)
R.add("thread_safe_lookup", lambda s, d: detect.var_types(detect.side_lines(D(s, d))).groupBy("type").agg(F.count("*").alias("n")).select("type", "n", F.col("type").isin(*detect.THREAD_SAFE).alias("thread_safe")), "SELECT type, count(*) AS n, type IN (FROM safe) AS thread_safe FROM typed GROUP BY type", *SIDE, TYPES)


def _both(left: str, right: str):
    def run(s, d):
        c = _changes(s, d)
        return c.groupBy("diff_id", "grp").agg(F.bool_or(F.expr(left)).alias("a"), F.bool_or(F.expr(right)).alias("b")).where("a and b").select("diff_id", "grp")

    return run


R.add("equals_to_ref", _both("side = 'removed' and symbol = 'equals'", "side = 'added' and symbol = '=='"), f"SELECT diff_id, CAST(grp AS BIGINT) AS grp FROM tokenised GROUP BY diff_id, grp HAVING bool_or(side = 'removed' AND {_g('equals', '(')}) AND bool_or(side = 'added' AND list_contains(t, '=='))", *SIDE)


def tpe_param_change(s, d):
    t = detect.side_lines(D(s, d)).where(F.col("text").rlike("\\bnew\\s+ThreadPoolExecutor\\s*\\("))
    return t.groupBy("diff_id", "grp").agg(F.count_distinct("side").alias("n")).where("n = 2").select("diff_id", "grp")


R.add("tpe_param_change", tpe_param_change, "SELECT diff_id, CAST(grp AS BIGINT) AS grp FROM sides WHERE regexp_matches(text, '\\bnew\\s+ThreadPoolExecutor\\s*\\(') GROUP BY diff_id, grp HAVING count(DISTINCT side) = 2", *SIDE)
R.add(
    "inline_ignores", lambda s, d: detect.inline_ignores(detect.side_lines(D(s, d))).where("size(ignores) > 0").select("diff_id", "grp", "side", "n", F.array_join("ignores", ",").alias("ignores")),
    f"SELECT diff_id, CAST(grp AS BIGINT) AS grp, side, n, concat_ws(',', own, before) AS ignores FROM (SELECT *, lag(own) OVER (PARTITION BY diff_id, grp, side ORDER BY n) AS before FROM (SELECT *, nullif(regexp_extract(text, '//\\s*{detect.IGNORE}:\\s*([\\w.*-]+)', 1), '') AS own FROM sides)) WHERE own IS NOT NULL OR before IS NOT NULL",
    *SIDE,
)
R.add("dedupe_changes", lambda s, d: detect.changes(D(s, d)).select("diff_id", "file", "kind", "symbol", "meta"))
R.add("change_to_signal", lambda s, d: detect.changes(D(s, d)).select("kind", "symbol", "meta", detect.signal_id(F.col("kind"), F.col("symbol"), F.col("meta")).alias("signal_id")).where("kind <> 'TYPE_CHANGED'").distinct())
R.add("kind_to_action", lambda s, d: detect.changes(D(s, d)).groupBy("kind").agg(F.count("*").alias("n")).select("kind", "n", detect.action(F.col("kind")).alias("action")))
R.add("suppress_inline", lambda s, d: detect.signals(D(s, d)).groupBy("signal_id").agg(F.count("*").alias("n")))
R.add("signals_by_file", lambda s, d: detect.signals(D(s, d)).groupBy("diff_id", "file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "signal_id"))), lambda x: x.signal_id), ",").alias("signals")))
R.add("match_signal", lambda s, d: audit.match_signal(_effective(s, d), detect.signals(D(s, d)), audit.compiled(s, catalog.rows())))
R.add("audit_findings", lambda s, d: audit.Engine(s).audit(D(s, d)).select("diff_id", "rule_id", "severity", "matched_file"))
R.add("audit_decisions", lambda s, d: audit.decisions(audit.Engine(s).audit(D(s, d)), D(s, d)).select("diff_id", "review_level", "suggested_action", "n_findings", "max_severity"))
