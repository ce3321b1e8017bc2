"""Rules against diffs: scheduling, matching, governance, decisions.

summaries(diff_id, raw_diff, files, new_files, n_add, n_del, ...) and signals(diff_id, seq, signal_id, file, action, ...) meet the rule
rows, which are a bounded table and broadcast. Rules in code are one projection over the raw text without a join. Pattern rules are found by an inverted
index: every match of a pattern holds one of its literals, a literal has a gram of GRAM characters, and a text's grams meet the index by equality; only
then the pattern runs. Files meet rules by extension. So no rule is tried on a text for being in the catalogue."""

from __future__ import annotations

import functools
import string
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions import dialect
from riskweave.operators import builtin_rules, detect, parse
from riskweave.sources import catalog, tables

#: Characters of a gram of the index of pattern rules.
GRAM = 3
#: Up to so many rules are counted by schedule in one projection with their patterns.
FEW = 400


def any_glob(file: Column, globs: list[str]) -> Column:
    return file.rlike("|".join(map(_found, globs))) if globs else F.lit(False)


def _found(glob: str) -> str:
    """A glob's pattern without a leading or trailing run of any characters, which a search needs not match."""
    whole = dialect.glob_regex(glob)
    if whole.startswith("^(?:[\\s\\S]*"):
        whole = "(?:" + whole[len("^(?:[\\s\\S]*") :]
    return whole[: -len("[\\s\\S]*)$")] + ")" if whole.endswith("[\\s\\S]*)$") else whole


def effective(summaries: DataFrame, skip: list[str] | None = None) -> DataFrame:
    """summaries with effective (files that no skip path matches) and mostly_new."""
    skip = catalog.SKIP_PATHS if skip is None else skip
    s = summaries.withColumn("effective", F.filter("files", lambda f: ~any_glob(f, skip)))
    return s.withColumn("mostly_new", parse.mostly_new(F.col("n_add"), F.col("n_del"), F.size("new_files"), F.size("effective")))


def _fits(language: str, scope: str):
    """Condition on a file: the rule's language and scope."""

    def cond(f: Column) -> Column:
        out = F.lit(True)
        if language != "*":
            ends = F.lit(False)
            for e in catalog.LANGUAGE_EXTENSIONS.get(language, [f".{language}"]):
                ends = ends | f.endswith(e)
            out = out & ends
        return out if scope == "**" else out & f.rlike(dialect.glob_regex(scope))

    return cond


def scheduled(language: str, scope: str, rule_type: str, files: Column, mostly_new: Column) -> Column:
    """Whether a rule is run on a diff: a file of its language and scope, and no regression rule on mostly new code."""
    fits = F.size(files) > 0 if language == "*" and scope == "**" else F.exists(files, _fits(language, scope))
    return fits & ~mostly_new if rule_type == "regression" else fits


def rule_table(rows: list[tuple]) -> list[dict]:
    names = [c.split()[0] for c in catalog.SCHEMA.split(", ")]
    return [dict(zip(names, r, strict=True)) for r in rows]


def grams(literals: dict[int, list[str]]) -> dict[int, list[tuple[str, str, list[str]]]]:
    """For each rule's literals (gram, literal, the literals before it): the gram that the fewest literals have. None if a literal is shorter than a gram."""
    literals = {k: xs if xs and min(map(len, xs)) >= GRAM else [] for k, xs in literals.items()}
    cut = lambda x: {x[i : i + GRAM] for i in range(len(x) - GRAM + 1)}
    uses = Counter(g for xs in literals.values() for x in xs for g in cut(x))
    return {k: [(min(cut(x), key=lambda g: (uses[g], g)), x, xs[:i]) for i, x in enumerate(xs)] for k, xs in literals.items()}


def compiled(spark, rows: list[tuple]) -> DataFrame:
    """Rule rows with Java patterns: match_regex, grams of the index, file_regex, scope_regex, ext_regex, exts."""
    out = []
    table = rule_table(rows)
    index = grams({r["load_order"]: dialect.required_literals(r["match"]) for r in table if catalog.valid_pattern(r["match"])})
    for r in table:
        ok = catalog.valid_pattern(r["match"])
        pattern = None if not ok else "(?m" + ("i" if r["flags"] == "i" else "") + ")(?d)" + dialect.java_regex(r["match"])
        exts = catalog.LANGUAGE_EXTENSIONS.get(r["language"], [f".{r['language']}"])
        out.append((
            r["load_order"], r["rule_id"], r["source"], r["signal"], r["action"], "never" if r["match"] and not ok else "signal" if r["signal"] else "regex" if ok else "file" if r["file"] else "never", pattern,
            index.get(r["load_order"], []), dialect.file_glob_regex(r["file"] or "**"), "^" if r["scope"] == "**" else dialect.glob_regex(r["scope"]),
            "^" if r["language"] == "*" else "(?:" + "|".join(e.replace(".", "\\.").replace("+", "\\+") for e in exts) + ")$", r["severity"], r["impact"], r["rule_type"], r["is_blocking"], r["status"], r["rationale"], r["language"] == "*" and r["scope"] == "**", ["*"] if r["language"] == "*" else exts,
        ))
    return spark.createDataFrame(out, "load_order int, rule_id string, source string, signal string, action string, strategy string, match_regex string, grams array<struct<gram:string,literal:string,earlier:array<string>>>, file_regex string, scope_regex string, ext_regex string, severity string, impact string, rule_type string, is_blocking boolean, status string, rationale string, everywhere boolean, exts array<string>")


def eligible(s: DataFrame, rules: DataFrame) -> Column:
    """The join condition that schedules a rule for a diff."""
    fits = F.col("everywhere") & (F.size("effective") > 0) | F.exists("effective", lambda f: F.rlike(f, F.col("ext_regex")) & F.rlike(f, F.col("scope_regex")))
    return fits & ~((F.col("rule_type") == "regression") & F.col("mostly_new"))


def scheduled_pairs(s: DataFrame, rules: DataFrame) -> DataFrame:
    """s with the columns of each rule that is scheduled for it, once: a diff's extensions, and * for any file, meet those of rules."""
    exts = F.array_distinct(F.transform("effective", lambda f: F.regexp_extract(f, "(\\.[^./]*)$", 1)))
    keyed = s.withColumn("keys", F.when(F.size("effective") > 0, F.concat(F.array(F.lit("*")), exts)))
    by = rules.withColumn("key", F.explode("exts"))
    # outer, as an inner explode would have the keys made twice, once to see whether there are some
    pairs = keyed.withColumn("key", F.explode_outer("keys")).join(F.broadcast(by), "key")
    # a rule with several of a diff's extensions counts for its first one
    return pairs.where(F.get(F.filter("exts", lambda x: F.array_contains("keys", x)), F.lit(0)) == F.col("key")).where(eligible(s, rules)).drop("key", "keys", "exts")


def scheduled_counts(s: DataFrame, rules: DataFrame) -> DataFrame:
    """(load_order, n_diffs): for how many diffs a rule is scheduled. Up to FEW rules are counted by language, scope and type, in one projection without pairs."""
    few = rules.limit(FEW + 1).collect()
    if not few or len(few) > FEW:
        return scheduled_pairs(s, rules).groupBy("load_order").agg(F.count("*").alias("n_diffs"))
    ready, runs = _scheduled(s.select("effective", "mostly_new"), few)
    counted = ready.agg(*[F.count_if(c).alias(c) for c in ready.columns if c.startswith("runs")])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(r["load_order"]).alias("load_order"), runs(r).alias("n_diffs")) for r in few])).alias("x")).select("x.*").where("n_diffs > 0")


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def text_grams(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


def _first_file(pattern: Column | str) -> Column:
    return F.get(F.filter("files", lambda f: F.rlike(f, pattern if isinstance(pattern, Column) else F.lit(pattern))), F.lit(0))


def match_regex(s: DataFrame, rules: DataFrame) -> DataFrame:
    """(diff_id, load_order, matched_file) of pattern rules: the first file that fits, if the raw text matches.

    Rules with literals are found by the index of their grams; the others, of which a catalogue has few, are one projection with fixed patterns."""
    some = rules.where("strategy = 'regex'").select("load_order", "match_regex", "grams", "file_regex", "scope_regex", "ext_regex", "rule_type", "everywhere")
    low = s.select("diff_id", "raw_diff", "files", "effective", "mostly_new").withColumn("low", lowered(F.col("raw_diff")))
    return _indexed(low, some).unionByName(_unrolled(low, some.where("size(grams) = 0").collect()))


def _indexed(low: DataFrame, some: DataFrame) -> DataFrame:
    index = some.where("size(grams) > 0").withColumn("g", F.explode("grams")).select(F.col("g.gram").alias("gram"), F.col("g.literal").alias("literal"), F.col("g.earlier").alias("earlier"), "load_order", "match_regex", "file_regex", "scope_regex", "ext_regex", "rule_type", "everywhere")
    met = low.withColumn("gram", F.explode_outer(text_grams(F.col("low")))).join(F.broadcast(index), "gram")
    # a rule with several literals counts for the first that the text holds
    held = F.contains("low", F.col("literal")) & ~F.exists("earlier", lambda x: F.contains(F.col("low"), x))
    found = met.where(held).where(eligible(low, some)).where(F.expr("raw_diff rlike match_regex"))
    return found.select("diff_id", "load_order", _first_file(F.col("file_regex")).alias("matched_file")).where("matched_file is not null")


def _unrolled(low: DataFrame, rules: list) -> DataFrame:
    if not rules:
        return low.sparkSession.createDataFrame([], "diff_id {}, load_order int, matched_file string".format(dict(low.dtypes)["diff_id"]))
    ready, runs = _scheduled(low, rules)
    hits = []
    for r in rules:
        hits.append(F.when(runs(r) & F.col("raw_diff").rlike(r["match_regex"]), F.struct(F.lit(r["load_order"]).alias("load_order"), _first_file(r["file_regex"]).alias("matched_file"))))
    return _hits(ready, hits)


def _scheduled(s: DataFrame, rules: list) -> tuple[DataFrame, Callable[..., Column]]:
    """s with a flag for each language, scope and type of rules, which are scheduled alike; the flag of a rule."""
    names = ("everywhere", "ext_regex", "scope_regex", "rule_type")
    kinds = {k: i for i, k in enumerate(dict.fromkeys(tuple(r[n] for n in names) for r in rules))}
    ready = s.withColumns({f"runs{i}": _runs(dict(zip(names, k, strict=True))) for k, i in kinds.items()})
    return ready, lambda r: F.col(f"runs{kinds[tuple(r[n] for n in names)]}")


def _hits(ready: DataFrame, hits: list[Column]) -> DataFrame:
    # an inner explode would have the whole array made twice, once to see whether it is empty
    found = ready.select("diff_id", F.filter(F.array_compact(F.array(*hits)), lambda x: x["matched_file"].isNotNull()).alias("hits")).select("diff_id", F.explode_outer("hits").alias("x"))
    return found.select("diff_id", "x.load_order", "x.matched_file").where("matched_file is not null")


def _runs(rule) -> Column:  # noqa: ANN001
    """eligible with a rule's values as constants."""
    fits = F.size("effective") > 0 if rule["everywhere"] else F.exists("effective", lambda f: F.rlike(f, F.lit(rule["ext_regex"])) & F.rlike(f, F.lit(rule["scope_regex"])))
    return fits & ~F.col("mostly_new") if rule["rule_type"] == "regression" else fits


def match_file(s: DataFrame, rules: DataFrame) -> DataFrame:
    some = rules.where("strategy = 'file'").select("load_order", "file_regex", "scope_regex", "ext_regex", "rule_type", "everywhere", "exts")
    return scheduled_pairs(s, some).select("diff_id", "load_order", _first_file(F.col("file_regex")).alias("matched_file")).where("matched_file is not null")


def match_signal(s: DataFrame, signals: DataFrame, rules: DataFrame) -> DataFrame:
    """Of a rule's signals in a diff, the first whose action and file fit."""
    some = rules.where("strategy = 'signal'").select("load_order", F.col("signal").alias("signal_id"), F.col("action").alias("wanted"), "file_regex", "scope_regex", "ext_regex", "rule_type", "everywhere")
    hit = signals.select("diff_id", "seq", "signal_id", "file", "action").join(F.broadcast(some), "signal_id").where((F.col("wanted").isNull() | (F.col("wanted") == F.col("action"))) & F.expr("file rlike file_regex"))
    first = hit.groupBy("diff_id", "load_order").agg(F.min_by("file", "seq").alias("matched_file"), *[F.first(c).alias(c) for c in ("scope_regex", "ext_regex", "rule_type", "everywhere")])
    return first.join(s.select("diff_id", "effective", "mostly_new"), "diff_id").where(eligible(s, some)).select("diff_id", "load_order", "matched_file")


def match_code(s: DataFrame, signals: DataFrame | None, rules: list[builtin_rules.Rule] | None = None, semantics: str = "compat", orders: list[int] | None = None) -> DataFrame:
    """Rules in code: one projection gives an array of (load_order, file), of which the matches are exploded."""
    rules = builtin_rules.ALL if rules is None else rules
    if signals is not None:
        few = signals.where("signal_id = 'runtime.concurrency.thread_safety_downgrade'").groupBy("diff_id").agg(F.array_sort(F.collect_list(F.struct("seq", "signal_id", "file"))).alias("sigs"))
        s = s.join(few, "diff_id", "left")
    # lines are made and schedules told once, not for each rule
    s = s.withColumns({"low": lowered(F.col("raw_diff")), "lines": F.split("raw_diff", "\n", -1)}).withColumn("added", F.filter("lines", lambda x: x.startswith("+")))
    kinds = {k: i for i, k in enumerate(dict.fromkeys((r.language, r.rule_type) for r in rules))}
    s = s.withColumns({f"runs{i}": scheduled(k[0], "**", k[1], F.col("effective"), F.col("mostly_new")) for k, i in kinds.items()})
    c = builtin_rules.Spark(F.col("raw_diff"), F.col("files"), F.col("sigs") if signals is not None else None, semantics, F.col("lines"), F.col("added"))
    hits = []
    for i, r in enumerate(rules):
        run = F.col(f"runs{kinds[r.language, r.rule_type]}")
        literals = builtin_rules.literals(r)
        if literals:
            run = run & functools.reduce(lambda a, b: a | b, [F.contains("low", F.lit(x)) for x in literals])
        hits.append(F.struct(F.lit(orders[i] if orders else i).alias("load_order"), F.when(run, builtin_rules.column(r, c)).alias("matched_file")))
    return _hits(s, hits)


def governed(rows: list[tuple], experimental: bool = True, overrides: dict[str, str] | None = None) -> list[tuple]:
    """Rule rows that may run: enabled and not disabled, experimental ones if asked for; a deprecated rule's severity is low and doesn't block. overrides: statuses by rule id."""
    names = [c.split()[0] for c in catalog.SCHEMA.split(", ")]
    out = []
    for r in rule_table(rows):
        r["status"] = (overrides or {}).get(r["rule_id"], r["status"])
        if not r["enabled"] or r["status"] == "disabled" or (r["status"] == "experimental" and not experimental):
            continue
        if r["status"] == "deprecated":
            r |= {"severity": "low", "is_blocking": False}
        out.append(tuple(r[n] for n in names))
    return out


class Engine:
    """The audit of a table of diffs: audit(diffs) gives findings, decisions(findings, diffs) a row a diff.

    ignores: (rule glob, file globs or none) whose findings are dropped. quality: a table (rule_id, hits, precision, one row a rule) by which
    rules are tuned: disabled ones don't run, degraded ones lose a step of severity. versions: {rule_id: (version in use or none,
    introduced, fixed)} of rules for packages: such a rule runs only if the version is known and affected. packages and dependencies: the
    same as tables, see barred. overrides: {rule_id: status}, which come before a rule's own status."""

    def __init__(self, spark, rows: list[tuple] | None = None, skip_paths: list[str] | None = None, semantics: str = "compat", ignores: list[tuple[str, list[str]]] | None = None, quality: DataFrame | None = None, versions: dict[str, tuple[str | None, list[str], list[str]]] | None = None, experimental: bool = True, packages: DataFrame | None = None, dependencies: DataFrame | None = None, overrides: dict[str, str] | None = None) -> None:
        self.spark, self.skip, self.semantics, self.ignores, self.quality = spark, skip_paths, semantics, ignores or [], quality
        self.rows = governed(catalog.rows() if rows is None else rows, experimental, overrides)
        self.rules = compiled(spark, self.rows)
        if versions:
            table = spark.createDataFrame([(k, *v) for k, v in versions.items()], "rule_id string, v string, i array<string>, f array<string>")
            idle = table.where(F.col("v").isNull() | ~version_affected(F.col("v"), F.col("i"), F.col("f")))
            self.rules = self.rules.join(F.broadcast(idle.select("rule_id")), "rule_id", "left_anti")
        if packages is not None and dependencies is not None:
            self.rules = self.rules.join(barred(packages, dependencies), "rule_id", "left_anti")

    def audit(self, diffs: DataFrame) -> DataFrame:
        """(diff_id, load_order, rule_id, severity, impact, rationale, matched_file, is_blocking, experimental): one row a diff and rule."""
        # every strategy reads what diffs are like, so they are parsed once
        s = tables.written(effective(parse.summaries(diffs), self.skip), "summaries")
        sig = detect.signals(diffs)
        code = {r.rule_id: r for r in builtin_rules.ALL}
        parts = [match_regex(s, self.rules), match_file(s, self.rules), match_signal(s, sig, self.rules)]
        own = {x["rule_id"]: x["load_order"] for x in rule_table(self.rows) if x["source"] == "code" and x["rule_id"] in code}
        if own:
            parts.append(match_code(s, sig, [code[x] for x in own], self.semantics, list(own.values())))
        hits = parts[0]
        for p in parts[1:]:
            hits = hits.unionByName(p)
        rules = self.rules.select("load_order", "rule_id", "severity", "impact", "rationale", "is_blocking", (F.col("status") == "experimental").alias("experimental"))
        if self.quality is not None:
            tuned = self.quality.select("rule_id", quality_status(F.col("hits"), F.col("precision")).alias("tuned"))
            severity = F.when(F.col("tuned") == "degraded", downgraded(F.col("severity"))).otherwise(F.col("severity"))
            rules = rules.join(tuned, "rule_id", "left").where("tuned is null or tuned <> 'disabled'").withColumn("severity", severity).drop("tuned")
        found = hits.join(F.broadcast(rules), "load_order")
        return ignored(found, self.ignores)[0] if self.ignores else found


def decisions(findings: DataFrame, diffs: DataFrame | None = None) -> DataFrame:
    """(diff_id, review_level, suggested_action, n_findings, max_severity, reasons): blocking or critical findings ask for review.

    With diffs, those without a finding get a row too: their level is normal."""
    score = dialect.severity_score(F.col("severity"))
    plain = ~F.col("experimental")
    reasons = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("load_order", "rule_id"))), lambda x: x.rule_id), ",")
    top = F.coalesce(F.max(F.when(plain, score)), F.lit(0))
    g = findings.groupBy("diff_id").agg(top.alias("top"), F.bool_or("is_blocking").alias("blocking"), F.count("*").alias("n_findings"), reasons.alias("reasons"))
    level = F.when(F.col("blocking") | (F.col("top") >= 3), "critical").otherwise("low")
    got = g.select("diff_id", level.alias("review_level"), F.when(level == "critical", "block_pr").otherwise("auto_merge").alias("suggested_action"), "n_findings", F.element_at(F.array(*map(F.lit, ["low", "medium", "high", "critical"])), F.col("top") + 1).alias("max_severity"), "reasons")
    if diffs is None:
        return got
    unfound = {"review_level": "normal", "suggested_action": "auto_merge", "n_findings": 0, "max_severity": "low", "reasons": ""}
    return diffs.select("diff_id").join(got, "diff_id", "left").fillna(unfound)


def impacts(findings: DataFrame) -> DataFrame:
    """(diff_id, impact, severity): the highest severity of each dimension; low ones aren't recorded."""
    score = dialect.severity_score(F.col("severity"))
    g = findings.where(~F.col("experimental") & (score > 0)).groupBy("diff_id", "impact").agg(F.max(score).alias("s"))
    return g.select("diff_id", "impact", F.element_at(F.array(*map(F.lit, ["low", "medium", "high", "critical"])), F.col("s") + 1).alias("severity"))


def ignored(findings: DataFrame, ignores: list[tuple[str, list[str]]]) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) findings under ignores of (rule glob, file globs or none)."""
    cond = F.lit(False)
    for rule, files in ignores:
        one = F.col("rule_id").rlike(dialect.glob_regex(rule))
        cond = cond | (one & any_glob(F.col("matched_file"), files) if files else one)
    return findings.where(~cond), findings.where(cond)


def since_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings whose rule and file the baseline lacks."""
    return findings.join(baseline.select("rule_id", F.col("file").alias("matched_file")).distinct(), ["rule_id", "matched_file"], "left_anti")


def quality_status(hits: Column, precision: Column, least: int = 30, degrade: float = 0.5, disable: float = 0.3) -> Column:
    return F.when(hits < least, "insufficient").when(precision < disable, "disabled").when(precision < degrade, "degraded").otherwise("normal")


def downgraded(severity: Column) -> Column:
    return F.when(severity == "critical", "high").when(severity == "high", "medium").when(severity == "medium", "low").otherwise(severity)


def version_bounds(introduced: Column, fixed: Column) -> tuple[Column, Column]:
    """Sortable keys of the least introduced and the least fixed version; null where there is none."""
    least = lambda xs: F.array_min(F.transform(F.filter(xs, lambda x: x != ""), dialect.version_key))
    return least(introduced), least(fixed)


def version_affected(version: Column, introduced: Column, fixed: Column) -> Column:
    """version lies in [least introduced, least fixed); a missing bound is open."""
    key, (low, high) = dialect.version_key(version), version_bounds(introduced, fixed)
    return F.coalesce(key >= low, F.lit(True)) & F.coalesce(key < high, F.lit(True))


def _package(c: str, lower: bool = False) -> Column:
    return F.lower(F.trim(F.col(c))) if lower else F.trim(F.col(c))


def affected_dependencies(packages: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(rule_id, ecosystem, package, version): dependencies(ecosystem, package, version) in the ranges of packages(rule_id, ecosystem, package, introduced, fixed).

    An equi-join by package whose versions are compared as sortable texts."""
    low, high = version_bounds(F.col("introduced"), F.col("fixed"))
    ranges = packages.select("rule_id", _package("ecosystem", True).alias("ecosystem"), _package("package").alias("package"), low.alias("low"), high.alias("high"))
    used = dependencies.where("version is not null").select(_package("ecosystem", True).alias("ecosystem"), _package("package").alias("package"), "version", dialect.version_key(F.col("version")).alias("key"))
    return ranges.join(used, ["ecosystem", "package"]).where("(low is null or key >= low) and (high is null or key < high)").select("rule_id", "ecosystem", "package", "version")


def barred(packages: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(rule_id): rules for packages that don't run: their ecosystem has dependencies, and no version of their package in it is affected."""
    known = dependencies.select(_package("ecosystem", True).alias("ecosystem")).distinct()
    asked = packages.where("trim(ecosystem) <> '' and trim(package) <> ''").select("rule_id", _package("ecosystem", True).alias("ecosystem"))
    return asked.join(known, "ecosystem", "left_semi").select("rule_id").distinct().join(affected_dependencies(packages, dependencies).select("rule_id"), "rule_id", "left_anti")
