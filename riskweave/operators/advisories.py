"""Advisories to rules: reading, classification, tiers, lint and version ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions import dialect

# Keywords and patterns of the classifications, in their order.
CPP_RELATED = r"\bc\+\+|c\+\+11|c\+\+17|c\+\+20|\bcpp\b|\(c\+\+\)|c/c\+\+|c\+\+ (?:library|code|application|component|project)|std::|stl\b|boost\.|qt\s+(?:framework|library)|native\s+code|compiled\s+(?:c\+\+|native)|\bcxx\b|clang\+\+|g\+\+|msvc|visual\s+studio\s+c\+\+"
CPP_CATEGORIES = [
    ("memory_safety.buffer_overflow", r"buffer\s+(overflow|overrun)|array\s+bounds?\s+(exceeded|violated)|stack\s+smash|heap\s+overflow"), ("memory_safety.use_after_free", r"use[-\s]?after[-\s]?free|dangling\s+pointer|access\s+freed\s+memory"),
    ("memory_safety.double_free", r"double[-\s]?free|free\s+twice|multiple\s+deletion"), ("concurrency.race_condition", r"race\s+condition|data\s+race|concurrent\s+access"), ("concurrency.deadlock", r"deadlock|circular\s+wait|mutex\s+ordering"),
    ("security.command_injection", r"command\s+injection|shell\s+injection|arbitrary\s+code\s+execution"), ("security.format_string", r"format\s+string\s+vulnerability|printf\s+without\s+format"),
]
PYTHON_FUNCTIONS = ["pickle.loads(", "pickle.load(", "yaml.load(", "eval(", "exec(", "os.system(", "subprocess.call(", "subprocess.run(", "open(", "Path(", "os.path.join(", "cursor.execute(", "db.execute("]
GO_FUNCTIONS = ["gob.Decode(", "json.Unmarshal(", "xml.Unmarshal(", "exec.Command(", "os/exec.Command(", "make(chan", "go func(", "sync.Mutex", "Lock()", "Unlock()"]
ECOSYSTEMS = {"java": ["maven"], "python": ["pypi"], "go": ["go"], "javascript": ["npm"], "cpp": ["conan", "vcpkg", "generic"]}


def severity_of(score: Column, text: Column | None = None) -> Column:
    """By CVSS score; without one by the text, else low."""
    by_text = F.lit("low") if text is None else F.when(F.lower(text).rlike("remote code execution|arbitrary code|complete system compromise"), "critical").when(F.lower(text).rlike("denial of service|information disclosure|privilege escalation"), "high").otherwise("medium")
    return F.when(score >= 9.0, "critical").when(score >= 7.0, "high").when(score >= 4.0, "medium").when(score.isNotNull(), "low").otherwise(by_text)


def cpp_category(text: Column) -> Column:
    out = None
    for name, p in CPP_CATEGORIES:
        out = F.when(F.lower(text).rlike(p), name) if out is None else out.when(F.lower(text).rlike(p), name)
    return out.otherwise("general.vulnerability")


def functions_in(text: Column, names: list[str]) -> Column:
    """Names whose text without the last character occurs."""
    return F.filter(F.array(*map(F.lit, names)), lambda p: F.contains(text, F.substr(p, F.lit(1), F.length(p) - 1)))


def python_class(found: Column) -> Column:
    j = F.array_join(found, " ")
    return F.when(j.rlike("pickle|yaml|eval"), "INSECURE_DESERIALIZATION").when(j.rlike("os\\.system|subprocess"), "COMMAND_INJECTION").when(j.contains("open"), "PATH_TRAVERSAL").when(j.contains("execute"), "SQL_INJECTION").otherwise("UNKNOWN_VULNERABILITY")


def go_class(found: Column) -> Column:
    j = F.array_join(found, " ")
    return F.when(j.rlike("gob\\.Decode|json\\.Unmarshal"), "INSECURE_DESERIALIZATION").when(j.contains("exec.Command"), "COMMAND_EXECUTION").when(j.contains("make(chan"), "GOROUTINE_LEAK").when(j.contains("sync.Mutex"), "RACE_CONDITION").otherwise("UNKNOWN_VULNERABILITY")


def osv_class(text: Column) -> Column:
    t = F.lower(text)
    return (
        F.when(t.rlike("denial of service|dos|hang"), "DENIAL_OF_SERVICE").when(t.contains("insecure") & t.rlike("deserialization|unmarshal"), "INSECURE_DESERIALIZATION")
        .when(t.rlike("path traversal|arbitrary file"), "PATH_TRAVERSAL").when(t.rlike("panic|infinite loop"), "DENIAL_OF_SERVICE").otherwise("UNKNOWN_VULNERABILITY")
    )


CVE5 = "cveMetadata struct<cveId:string,datePublished:string>, containers struct<cna:struct<descriptions:array<struct<lang:string,value:string>>,metrics:array<struct<cvssV3_1:struct<baseScore:double>,cvssV3_0:struct<baseScore:double>,cvssV2_0:struct<baseScore:double>>>,problemTypes:array<struct<descriptions:array<struct<cweId:string>>>>,affected:array<struct<product:string>>>>"
OSV = "id string, summary string, details string, published string, affected array<struct<package:struct<name:string,ecosystem:string>,ecosystem_specific:struct<imports:array<struct<path:string,symbols:array<string>>>>>>"


def flatten_cve5(json: DataFrame) -> DataFrame:
    """(cve_id, description, cvss_score, cwes) of json(body): English text first; scores of version 3.1, 3.0, 2.0 in this order."""
    r = json.select(F.from_json("body", CVE5).alias("r"))
    cna = F.col("r.containers.cna")
    text = F.coalesce(F.get(F.filter(cna["descriptions"], lambda x: x.lang.startswith("en")), F.lit(0)).value, F.get(cna["descriptions"], F.lit(0)).value, F.lit(""))
    score = lambda v: F.get(F.filter(F.transform(cna["metrics"], lambda m: m[v].baseScore), lambda x: x.isNotNull()), F.lit(0))
    cwes = F.array_distinct(F.filter(F.flatten(F.transform(cna["problemTypes"], lambda p: F.transform(p.descriptions, lambda x: x.cweId))), lambda x: x.isNotNull()))
    return r.select(F.col("r.cveMetadata.cveId").alias("cve_id"), text.alias("description"), F.coalesce(score("cvssV3_1"), score("cvssV3_0"), score("cvssV2_0")).alias("cvss_score"), F.coalesce(cwes, F.array().cast("array<string>")).alias("cwes"))


def osv_rules(json: DataFrame) -> DataFrame:
    """(rule_id, trigger, patterns) of json(body): distinct path.Symbol patterns; entries without any are skipped."""
    r = json.select(F.from_json("body", OSV).alias("r"))
    imports = F.flatten(F.transform("r.affected", lambda a: F.coalesce(a.ecosystem_specific.imports, F.array().cast("array<struct<path:string,symbols:array<string>>>"))))
    pats = F.array_distinct(F.flatten(F.transform(imports, lambda i: F.transform(F.filter(i.symbols, lambda x: (x != "") & (F.trim(i.path) != "")), lambda x: F.concat(F.trim(i.path), F.lit("."), x)))))
    text = F.concat_ws(" ", F.coalesce("r.summary", F.lit("")), F.coalesce("r.details", F.lit("")))
    return r.select(F.concat(F.lit("prorule.go."), dialect.slug(F.col("r.id"))).alias("rule_id"), osv_class(text).alias("trigger"), pats.alias("patterns")).where("size(patterns) > 0")


# An advisory of either shape; what doesn't fit its types goes to odd.
RECORD = (
    "id string, cve_id string, summary string, details string, description string, published string, aliases array<string>, severity string, affected_library string, references array<struct<type:string,url:string>>, "
    "database_specific struct<severity:string,cwe_ids:array<string>>, "
    "affected array<struct<package:struct<ecosystem:string,name:string>,ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string>>>>,versions:array<string>>>, odd string"
)


def _none() -> Column:
    return F.array().cast("array<string>")


def records(json: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Advisories of json(path, body), parsed, and (path, body, error) of the others: no JSON object, fields of other types, no id."""
    read = json.select("path", "body", F.from_json("body", RECORD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "odd"}).alias("r"))
    name = F.coalesce(F.nullif(F.trim("r.id"), F.lit("")), F.nullif(F.trim("r.cve_id"), F.lit("")))
    is_object = F.coalesce(F.col("body").rlike(r"(?s)\A\s*\{.*\}\s*\z"), F.lit(False))
    error = F.when(~is_object, "no JSON object").when(F.col("r.odd").isNotNull(), "malformed").when(name.isNull(), "no id")
    told = read.withColumn("error", error)
    return told.where("error is null").select("path", "r.*").drop("odd"), told.where("error is not null").select("path", "body", "error")


def _word(severity: Column) -> Column:
    s = F.lower(F.trim(severity))
    return F.when(s.isin(*dialect.SEVERITIES), s).otherwise("high")


def _first(xs: Column, n: int) -> Column:
    return F.slice(F.filter(F.coalesce(xs, _none()), lambda x: x.isNotNull()), 1, n)


def _packages(ecosystem: str) -> Column:
    return F.filter("affected", lambda a: F.lower(a.package.ecosystem) == ecosystem)


def npm_rules(advisories: DataFrame) -> DataFrame:
    """(rule_id, description, severity, package, patterns, aliases, tags, links, cwe, introduced) of records(...): a rule an advisory.

    Reviewed ones (GHSA-) are named by their id and take their first npm package, others by cve_id with affected_library. A severity that is
    none of the four words is high; descriptions have 500 characters, links 10, weaknesses 5, versions (of the first package of any kind) 3."""
    ghsa = F.coalesce(F.coalesce(F.nullif("id", F.lit("")), "cve_id").startswith("GHSA-"), F.lit(False))
    name = F.when(ghsa, F.col("id")).otherwise(F.coalesce("cve_id", F.lit("CVE-UNKNOWN")))
    package = F.when(ghsa, F.coalesce(F.nullif(F.trim(F.get(_packages("npm"), F.lit(0)).package["name"]), F.lit("")), F.lit("unknown"))).otherwise(F.trim(F.coalesce(F.nullif("affected_library", F.lit("")), F.lit("unknown"))))
    severity = F.when(ghsa, _word(F.col("database_specific.severity"))).otherwise(_word(F.col("severity")))
    text = F.when(ghsa, F.coalesce(F.nullif("summary", F.lit("")), "details")).otherwise(F.col("description"))
    links = F.filter(F.transform(F.coalesce(F.col("references"), F.array().cast("array<struct<type:string,url:string>>")), lambda r: r.url), lambda u: F.coalesce(u != "", F.lit(False)))
    found = advisories.select(
        F.concat(F.lit("prorule.javascript."), severity, F.lit("."), F.lower(F.replace(F.trim(name), F.lit("-"), F.lit("_")))).alias("rule_id"), F.substring(F.coalesce(text, F.lit("")), 1, 500).alias("description"), severity.alias("severity"),
        package.alias("package"), F.when(ghsa, F.coalesce("aliases", _none())).otherwise(F.array(name)).alias("aliases"), F.when(ghsa, F.lower(name)).otherwise(name).alias("tag"), F.when(ghsa, _first(links, 10)).otherwise(_none()).alias("links"),
        F.when(ghsa, _first(F.col("database_specific.cwe_ids"), 5)).otherwise(_none()).alias("cwe"), F.when(ghsa, _first(F.get("affected", F.lit(0)).versions, 3)).otherwise(_none()).alias("introduced"),
    )
    tags = F.array(*map(F.lit, ["cve", "vulnerability", "javascript", "npm"]), F.col("tag"))
    return found.select("rule_id", "description", "severity", "package", npm_patterns(F.col("package")).alias("patterns"), "aliases", tags.alias("tags"), "links", "cwe", "introduced")


def recent_npm(advisories: DataFrame, since: str) -> DataFrame:
    """records(...) with an npm package, published since a time; a time that can't be read counts as since."""
    at = F.try_to_timestamp(F.regexp_replace("published", "Z$", "+00:00"))
    return advisories.where(F.exists("affected", lambda a: F.coalesce(a.package.ecosystem == "npm", F.lit(False))) & F.coalesce(at >= F.lit(since).cast("timestamp"), F.lit(True)))


def package_ranges(advisories: DataFrame) -> DataFrame:
    """(advisory_id, ecosystem, package, introduced, fixed), a row a nested package of records(...): what audit.affected_dependencies joins with versions in use.

    Events of all its ranges count; an introduced of 0 is no bound. Packages without a name are left out."""
    each = advisories.select(F.coalesce(F.nullif("id", F.lit("")), "cve_id").alias("advisory_id"), F.explode("affected").alias("a"))
    events = F.flatten(F.transform(F.coalesce("a.ranges", F.array().cast("array<struct<type:string,events:array<struct<introduced:string,fixed:string>>>>")), lambda r: F.coalesce(r.events, F.array().cast("array<struct<introduced:string,fixed:string>>"))))
    some = lambda c: F.filter(F.transform(events, lambda e: e[c]), lambda x: F.coalesce((x != "") & (x != "0"), F.lit(False)))
    return each.where("trim(a.package.name) <> ''").select("advisory_id", F.col("a.package.ecosystem").alias("ecosystem"), F.col("a.package.name").alias("package"), some("introduced").alias("introduced"), some("fixed").alias("fixed"))


def maven_package(name: Column) -> tuple[Column, Column]:
    """(group, artifact) of group:artifact; a name without a colon is an artifact."""
    name, at = F.trim(name), F.locate(":", F.trim(name))
    return F.when(at > 0, F.substr(name, F.lit(1), at - 1)), F.when(at > 0, F.substr(name, at + 1)).otherwise(name)


def maven_patterns(name: Column) -> Column:
    """Texts by which a build file names the package; none without a name."""
    group, artifact = maven_package(name)
    n = F.trim(name)
    tag = lambda t, x: F.when(x != "", F.concat(F.lit(f"<{t}>"), x, F.lit(f"</{t}>")))
    # Configurations of a build.
    uses = [F.concat(F.lit(f"{c} '"), n, F.lit(":'")) for c in ("implementation", "compile", "compileOnly", "runtimeOnly", "testImplementation")]
    return F.when(F.coalesce(n != "", F.lit(False)), F.array_compact(F.array(tag("groupId", group), tag("artifactId", artifact), *uses))).otherwise(_none())


def java_rules(raw: DataFrame) -> DataFrame:
    """(rule_id, severity, language, group_id, artifact_id, package, introduced, fixed, patterns, aliases, tags) of raw(path, rule_id, ghsa_id, cve_id, severity,
    language, affected_packages, affected_versions, fixed_versions): the older schema.

    Ids come from the rule, else the advisory, else the file's name; the first package counts; a version 0 is no bound."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    advisory = F.coalesce(filled("ghsa_id"), filled("cve_id"))
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"(?<=.)\.[^.]*$", "")
    rule = F.coalesce(filled("rule_id"), F.concat(F.lit("prorule."), F.replace(F.lower(advisory), F.lit(" "), F.lit("-")), F.lit("_java")), F.concat(F.lit("prorule."), stem, F.lit("_java")))
    name = F.trim(F.coalesce(F.get("affected_packages", F.lit(0)), F.lit("")))
    texts = lambda c: F.filter(F.transform(F.coalesce(c, _none()), lambda x: F.trim(x)), lambda x: F.coalesce(x != "", F.lit(False)))
    group, artifact = maven_package(name)
    cve = filled("cve_id")
    tags = F.array_compact(F.array(*map(F.lit, ["cve", "vulnerability", "java", "maven"]), F.lower(advisory)))
    return raw.select(
        rule.alias("rule_id"), F.lower(F.coalesce(filled("severity"), F.lit("medium"))).alias("severity"), F.lower(F.coalesce(filled("language"), F.lit("java"))).alias("language"), F.coalesce(group, F.lit("")).alias("group_id"),
        artifact.alias("artifact_id"), name.alias("package"), F.filter(texts("affected_versions"), lambda x: x != "0").alias("introduced"), texts("fixed_versions").alias("fixed"), maven_patterns(name).alias("patterns"),
        F.when(cve.startswith("CVE-"), F.array(cve)).otherwise(_none()).alias("aliases"), tags.alias("tags"),
    )


def npm_patterns(name: Column) -> Column:
    n = F.trim(F.coalesce(name, F.lit("")))
    return F.when(n == "", F.array(F.lit("*"))).otherwise(F.array(F.concat(F.lit('require("'), n, F.lit('")')), F.concat(F.lit("require('"), n, F.lit("')")), F.concat(F.lit('from "'), n, F.lit('"')), F.concat(F.lit("from '"), n, F.lit("'")), F.concat(F.lit('"'), n, F.lit('":'))))


def new_java_id(old: Column, severity: Column) -> Column:
    part = F.regexp_extract(old, "(?i)^prorule\\.(ghsa-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4})_java$", 1)
    return F.when(part != "", F.concat(F.lit("prorule.java."), F.lower(severity), F.lit("."), F.lower(F.replace(part, F.lit("-"), F.lit("_"))))).otherwise(old)


def tier(severity: Column, score: Column) -> Column:
    s = F.lower(F.coalesce(severity, F.lit("")))
    return F.when(s == "critical", "tier1").when(s == "high", "tier2").when(s == "medium", "tier3").when(s == "low", "tier4").when(score >= 9, "tier1").when(score >= 7, "tier2").when(score >= 4, "tier3").otherwise("tier4")


def lint(rules: DataFrame) -> DataFrame:
    """(rule_id, level, message), a row a finding, of rules(rule_id, language, severity, ecosystem, package, introduced, fixed, patterns, legacy)."""
    c = F.col
    blank = lambda x: F.coalesce(F.trim(c(x)) == "", F.lit(True))
    expected = None
    for lang, names in ECOSYSTEMS.items():
        cond = (c("language") == lang) & ~c("ecosystem").isin(*names)
        expected = cond if expected is None else expected | cond
    found = [
        ("WARN", "legacy schema", c("legacy")), ("ERROR", "missing id", blank("rule_id")), ("ERROR", "missing language", blank("language")), ("ERROR", "missing severity", blank("severity")),
        ("WARN", "unknown severity", ~blank("severity") & ~F.lower("severity").isin(*dialect.SEVERITIES)), ("WARN", "missing package", c("package").isNull() & c("ecosystem").isNull()),
        ("ERROR", "missing package ecosystem", c("package").isNotNull() & blank("ecosystem")), ("ERROR", "language and ecosystem differ", ~blank("ecosystem") & F.coalesce(expected, F.lit(False))),
        ("WARN", "missing versions", c("introduced").isNull() & c("fixed").isNull()), ("WARN", "missing patterns", F.coalesce(F.size("patterns"), F.lit(0)) <= 0),
        ("WARN", "generic patterns only", (F.size("patterns") > 0) & F.forall("patterns", lambda p: F.length(p) <= 3)),
    ]
    rows = F.filter(F.array(*[F.when(cond, F.struct(F.lit(level).alias("level"), F.lit(text).alias("message"))) for level, text, cond in found]), lambda x: x.isNotNull())
    return rules.select("rule_id", F.explode(rows).alias("x")).select("rule_id", "x.level", "x.message")
