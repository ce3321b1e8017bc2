"""Queries over advisories: JSON derived from part and supplier."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskweave.functions import dialect
from riskweave.operators import advisories as A
from riskweave.operators import audit, parse
from riskweave.operators.audit import version_affected
from riskweave.plans.base import SUMMARIES, Registry, sql_pick
from riskweave.sources import corpus, rulestore, tables
from riskweave.sources.corpus import pick, table

R = Registry()
TEXTS = [
    "buffer overflow in the c++ library", "use-after-free in native code", "data race between threads", "command injection through os.system", "pickle.loads of untrusted input", "denial of service by a hang in exec.Command",
    "arbitrary file read", "insecure json.Unmarshal deserialization", "remote code execution in boost.asio", "information disclosure", "cursor.execute with user input", "nothing of note",
]
_q = lambda p: "'" + p.replace("'", "''") + "'"


def base(s, d):
    """(k, description, score, ecosystem, published) one row a part; every seventh lacks a score."""
    p = table(s, d, "part").select(F.col("p_partkey").cast("long").alias("k"), F.col("p_size").cast("long").alias("z"))
    return p.select("k", "z", pick(TEXTS, F.col("k")).alias("description"), F.when(F.col("k") % 7 != 0, (F.col("z") * 7 % 101) / 10.0).alias("score"), pick(["npm", "PyPI", "Go", "Maven"], F.col("k")).alias("ecosystem"), F.when(F.col("k") % 9 == 0, F.lit("bad date")).otherwise(F.concat(F.lit("2024-"), F.lpad((F.col("k") % 12 + 1).cast("string"), 2, "0"), F.lit("-15"))).alias("published"))


BASE = f"base AS (SELECT k, z, {sql_pick(TEXTS, 'k')} AS description, CASE WHEN k % 7 <> 0 THEN (z * 7 % 101) / 10.0::DOUBLE END AS score, {sql_pick(['npm', 'PyPI', 'Go', 'Maven'], 'k')} AS ecosystem, CASE WHEN k % 9 = 0 THEN 'bad date' ELSE '2024-' || lpad(CAST(k % 12 + 1 AS VARCHAR), 2, '0') || '-15' END AS published FROM (SELECT CAST(p_partkey AS BIGINT) AS k, CAST(p_size AS BIGINT) AS z FROM part))"
_SEV = lambda x, other="'low'": f"CASE WHEN {x} >= 9 THEN 'critical' WHEN {x} >= 7 THEN 'high' WHEN {x} >= 4 THEN 'medium' WHEN {x} IS NOT NULL THEN 'low' ELSE {other} END"
_TEXTSEV = "CASE WHEN regexp_matches(lower(description), 'remote code execution|arbitrary code|complete system compromise') THEN 'critical' WHEN regexp_matches(lower(description), 'denial of service|information disclosure|privilege escalation') THEN 'high' ELSE 'medium' END"

R.add("cvss_severity", lambda s, d: base(s, d).select("k", A.severity_of(F.col("score"), F.col("description")).alias("severity")), f"SELECT k, {_SEV('score', _TEXTSEV)} AS severity FROM base", BASE)
R.add("cpp_related", lambda s, d: base(s, d).select("k", F.lower("description").rlike(A.CPP_RELATED).alias("related")), f"SELECT k, regexp_matches(lower(description), {_q(A.CPP_RELATED)}) AS related FROM base", BASE)
R.add("cpp_categorize", lambda s, d: base(s, d).select("k", A.cpp_category(F.col("description")).alias("category")), "SELECT k, CASE " + " ".join(f"WHEN regexp_matches(lower(description), {_q(p)}) THEN '{n}'" for n, p in A.CPP_CATEGORIES) + " ELSE 'general.vulnerability' END AS category FROM base", BASE)


def cve_json(s, d):
    """(body) in version 5 of the record format."""
    b = base(s, d)
    q = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    score = F.when(F.col("score").isNull(), "{}").otherwise(F.concat(F.when(F.col("k") % 2 == 0, '{"cvssV3_1":{"baseScore":').otherwise('{"cvssV2_0":{"baseScore":'), F.col("score").cast("string"), F.lit("}}")))
    body = F.concat(
        F.lit('{"cveMetadata":{"cveId":"CVE-2024-'), F.col("k").cast("string"), F.lit('","datePublished":'), q(F.col("published")), F.lit('},"containers":{"cna":{"descriptions":[{"lang":"de","value":"-"},{"lang":"en","value":'), q(F.col("description")),
        F.lit('}],"metrics":['), score, F.lit('],"problemTypes":[{"descriptions":[{"cweId":"CWE-'), (F.col("k") % 5).cast("string"), F.lit('"},{"cweId":"CWE-'), (F.col("k") % 3).cast("string"), F.lit('"}]}]}}}'),
    )
    return b.select("k", body.alias("body"))


R.add("cve5_flatten", lambda s, d: A.flatten_cve5(cve_json(s, d)).select("cve_id", "description", "cvss_score", F.array_join(F.array_sort("cwes"), ",").alias("cwes")), "SELECT 'CVE-2024-' || CAST(k AS VARCHAR) AS cve_id, description, score AS cvss_score, array_to_string(list_sort(list_distinct(['CWE-' || CAST(k % 5 AS VARCHAR), 'CWE-' || CAST(k % 3 AS VARCHAR)])), ',') AS cwes FROM base", BASE)
R.add("cve_scan", lambda s, d: A.flatten_cve5(cve_json(s, d)).groupBy(A.severity_of(F.col("cvss_score"), F.col("description")).alias("severity")).agg(F.count("*").alias("n")), f"SELECT {_SEV('score', _TEXTSEV)} AS severity, count(*) AS n FROM base GROUP BY 1", BASE)
R.add("cve_recent_cpp", lambda s, d: base(s, d).where((F.expr("try_to_date(published)") >= F.lit("2024-06-01").cast("date")) & F.lower("description").rlike(A.CPP_RELATED)).select("k", "published"), f"SELECT k, published FROM base WHERE try_cast(published AS DATE) >= DATE '2024-06-01' AND regexp_matches(lower(description), {_q(A.CPP_RELATED)})", BASE)
R.add("ghsa_recent_npm", lambda s, d: base(s, d).where((F.col("ecosystem") == "npm") & F.coalesce(F.expr("try_to_date(published)") >= F.lit("2024-06-01").cast("date"), F.lit(True))).select("k", "published"), "SELECT k, published FROM base WHERE ecosystem = 'npm' AND coalesce(try_cast(published AS DATE) >= DATE '2024-06-01', true)", BASE)
_fn = lambda names: "list_filter([" + ", ".join(_q(n) for n in names) + "], lambda p: contains(description, substr(p, 1, length(p) - 1)))"


def cve_convert(s, d):
    b = base(s, d)
    py = b.withColumn("f", A.functions_in(F.col("description"), A.PYTHON_FUNCTIONS)).select("k", F.lit("python").alias("language"), A.python_class(F.col("f")).alias("type"), F.array_join("f", ";").alias("patterns"))
    go = b.withColumn("f", A.functions_in(F.col("description"), A.GO_FUNCTIONS)).select("k", F.lit("go").alias("language"), A.go_class(F.col("f")).alias("type"), F.array_join("f", ";").alias("patterns"))
    return py.unionByName(go)


R.add(
    "cve_convert", cve_convert,
    f"""SELECT k, 'python' AS language, CASE WHEN regexp_matches(f, 'pickle|yaml|eval') THEN 'INSECURE_DESERIALIZATION' WHEN regexp_matches(f, 'os\\.system|subprocess') THEN 'COMMAND_INJECTION' WHEN contains(f, 'open') THEN 'PATH_TRAVERSAL' WHEN contains(f, 'execute') THEN 'SQL_INJECTION' ELSE 'UNKNOWN_VULNERABILITY' END AS type, f AS patterns FROM (SELECT k, array_to_string({_fn(A.PYTHON_FUNCTIONS)}, ';') AS f FROM base)
UNION ALL SELECT k, 'go', CASE WHEN regexp_matches(f, 'gob\\.Decode|json\\.Unmarshal') THEN 'INSECURE_DESERIALIZATION' WHEN contains(f, 'exec.Command') THEN 'COMMAND_EXECUTION' WHEN contains(f, 'make(chan') THEN 'GOROUTINE_LEAK' WHEN contains(f, 'sync.Mutex') THEN 'RACE_CONDITION' ELSE 'UNKNOWN_VULNERABILITY' END, f FROM (SELECT k, array_to_string({_fn(A.GO_FUNCTIONS)}, ';') AS f FROM base)""", BASE,
)


def osv_json(s, d):
    b = base(s, d)
    body = F.concat(F.lit('{"id":"GO-2024-'), F.col("k").cast("string"), F.lit('","summary":"'), F.col("description"), F.lit('","affected":[{"package":{"name":"m","ecosystem":"Go"},"ecosystem_specific":{"imports":[{"path":"'), F.when(F.col("k") % 4 == 0, "").otherwise("net/http"), F.lit('","symbols":["A'), (F.col("k") % 3).cast("string"), F.lit('","B","B"]}]}}]}'))
    return b.select("k", body.alias("body"))


_OSV = "CASE WHEN regexp_matches(lower(description), 'denial of service|dos|hang') THEN 'DENIAL_OF_SERVICE' WHEN contains(lower(description), 'insecure') AND regexp_matches(lower(description), 'deserialization|unmarshal') THEN 'INSECURE_DESERIALIZATION' WHEN regexp_matches(lower(description), 'path traversal|arbitrary file') THEN 'PATH_TRAVERSAL' WHEN regexp_matches(lower(description), 'panic|infinite loop') THEN 'DENIAL_OF_SERVICE' ELSE 'UNKNOWN_VULNERABILITY' END"
R.add("osv_convert", lambda s, d: A.osv_rules(osv_json(s, d)).select("rule_id", "trigger", F.array_join("patterns", ",").alias("patterns")), f"SELECT 'prorule.go.go_2024_' || CAST(k AS VARCHAR) AS rule_id, {_OSV} AS trigger, 'net/http.A' || CAST(k % 3 AS VARCHAR) || ',net/http.B' AS patterns FROM base WHERE k % 4 <> 0", BASE)
R.add("osv_local", lambda s, d: A.osv_rules(osv_json(s, d)).groupBy("trigger").agg(F.count("*").alias("n")), f"SELECT {_OSV} AS trigger, count(*) AS n FROM base WHERE k % 4 <> 0 GROUP BY 1", BASE)
R.add("js_convert", lambda s, d: base(s, d).where("ecosystem = 'npm'").select("k", F.array_join(A.npm_patterns(F.when(F.col("k") % 3 == 0, "").otherwise(F.concat(F.lit("pkg-"), (F.col("k") % 10).cast("string")))), " ").alias("patterns")), "SELECT k, CASE WHEN k % 3 = 0 THEN '*' ELSE 'require(\"' || n || '\") require(''' || n || ''') from \"' || n || '\" from ''' || n || ''' \"' || n || '\":' END AS patterns FROM (SELECT *, 'pkg-' || CAST(k % 10 AS VARCHAR) AS n FROM base) WHERE ecosystem = 'npm'", BASE)
R.add(
    "java_normalize", lambda s, d: base(s, d).select("k", F.when(F.col("k") % 3 == 0, "org.x:lib").otherwise("lib").alias("name")).select("k", A.maven_package(F.col("name"))[0].alias("group_id"), A.maven_package(F.col("name"))[1].alias("artifact_id")),
    "SELECT k, CASE WHEN k % 3 = 0 THEN 'org.x' END AS group_id, 'lib' AS artifact_id FROM base", BASE,
)
_id = lambda: F.when(F.col("k") % 4 == 0, F.concat(F.lit("prorule.java.high.x"), F.col("k").cast("string"))).otherwise(F.concat(F.lit("prorule.ghsa-"), F.lpad((F.col("k") % 10000).cast("string"), 4, "0"), F.lit("-9f5a-33b3_java")))
R.add("id_normalize", lambda s, d: base(s, d).select("k", A.new_java_id(_id(), A.severity_of(F.col("score"))).alias("rule_id")), f"SELECT k, CASE WHEN k % 4 = 0 THEN 'prorule.java.high.x' || CAST(k AS VARCHAR) ELSE 'prorule.java.' || {_SEV('score')} || '.ghsa_' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') || '_9f5a_33b3' END AS rule_id FROM base", BASE)
_sev = lambda: pick(["critical", "HIGH", "medium", "low", ""], F.col("z"))
_TIER = f"CASE lower({sql_pick(['critical', 'HIGH', 'medium', 'low', ''], 'z')}) WHEN 'critical' THEN 'tier1' WHEN 'high' THEN 'tier2' WHEN 'medium' THEN 'tier3' WHEN 'low' THEN 'tier4' ELSE CASE WHEN score >= 9 THEN 'tier1' WHEN score >= 7 THEN 'tier2' WHEN score >= 4 THEN 'tier3' ELSE 'tier4' END END"
R.add("tier_assign", lambda s, d: base(s, d).select("k", A.tier(_sev(), F.col("score")).alias("tier")), f"SELECT k, {_TIER} AS tier FROM base", BASE)


def tier_distribution(s, d):
    g = base(s, d).groupBy(A.tier(_sev(), F.col("score")).alias("tier")).agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n").alias("total"))
    return g.crossJoin(F.broadcast(total)).select("tier", "n", F.round(100.0 * F.col("n") / F.col("total"), 2).alias("pct"))


R.add("tier_distribution", tier_distribution, f"SELECT tier, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM (SELECT {_TIER} AS tier FROM base) GROUP BY tier", BASE)


def stored(s, d):
    """The path of a rule a part, written by language and tier."""
    at = f"{tables.shared_folder(s)}/rules/{uuid.uuid4().hex}"
    k = F.col("k")
    rulestore.write(base(s, d).select(F.concat(F.lit("r"), k.cast("string")).alias("rule_id"), pick(["java", "Go", "python", "*", "javascript", "", "rust"], k).alias("language"), A.tier(_sev(), F.col("score")).alias("tier")), at)
    return at


_STORED = f"stored AS (SELECT 'r' || CAST(k AS VARCHAR) AS rule_id, lower({sql_pick(['java', 'Go', 'python', '*', 'javascript', '*', 'rust'], 'k')}) AS language, {_TIER} AS tier FROM base)"
R.add("tier_pruned_rules", lambda s, d: rulestore.read(s, stored(s, d), "standard").groupBy("tier").agg(F.count("*").alias("n")), f"SELECT tier, count(*) AS n FROM (SELECT {_TIER} AS tier FROM base) WHERE tier IN ('tier1', 'tier2') GROUP BY 1", BASE)
R.add(
    "rules_for_diffs", lambda s, d: rulestore.for_diffs(rulestore.read(s, stored(s, d), "lightweight"), parse.diff_files(corpus.diffs(s, d))).select("rule_id", "language", "tier"),
    "SELECT rule_id, language, tier FROM stored WHERE tier = 'tier1' AND (language = '*' OR language IN (SELECT DISTINCT CASE regexp_extract(file, '[^.]+$') WHEN 'java' THEN 'java' WHEN 'go' THEN 'go' WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'mjs' THEN 'javascript' WHEN 'cjs' THEN 'javascript' END FROM (SELECT unnest(files) AS file FROM files_of)))",
    BASE, _STORED, *SUMMARIES,
)
# the ranges leave gaps: a score such as 8.95 is in none
_RANGES = [(9.0, 10.0), (7.0, 8.9), (4.0, 6.9), (0.1, 3.9)]


def cve_distribution(s, d):
    r = s.createDataFrame([(f"{a}-{b}", a, b) for a, b in _RANGES], "bucket string, lo double, hi double")
    return base(s, d).join(F.broadcast(r), (F.col("score") >= F.col("lo")) & (F.col("score") <= F.col("hi"))).groupBy("bucket").agg(F.count("*").alias("n"))


R.add("cve_distribution", cve_distribution, "SELECT bucket, count(*) AS n FROM base JOIN (VALUES " + ", ".join(f"('{a}-{b}', {a}, {b})" for a, b in _RANGES) + ") r(bucket, lo, hi) ON score >= lo AND score <= hi GROUP BY 1", BASE)
R.add("cwe_top", lambda s, d: A.flatten_cve5(cve_json(s, d)).select(F.explode("cwes").alias("cwe")).groupBy("cwe").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cwe").limit(10), "SELECT cwe, count(*) AS n FROM (SELECT unnest(list_distinct(['CWE-' || CAST(k % 5 AS VARCHAR), 'CWE-' || CAST(k % 3 AS VARCHAR)])) AS cwe FROM base) GROUP BY 1 ORDER BY n DESC, cwe LIMIT 10", BASE)


def linted(s, d):
    k = F.col("k")
    return base(s, d).select(
        F.concat(F.lit("r"), k.cast("string")).alias("rule_id"), pick(["java", "python", "go", ""], k).alias("language"), pick(["critical", "odd", "low"], k).alias("severity"), F.when(k % 5 != 0, pick(["maven", "npm"], k)).alias("ecosystem"),
        F.when(k % 5 != 0, F.lit("p")).alias("package"), F.when(k % 2 == 0, F.array(F.lit("1.0"))).alias("introduced"), F.lit(None).cast("array<string>").alias("fixed"), F.when(k % 3 == 0, F.array(F.lit("*"))).when(k % 3 == 1, F.array(F.lit("import x"))).alias("patterns"), (k % 11 == 0).alias("legacy"),
    )


_LINT = " UNION ALL ".join(
    f"SELECT 'r' || CAST(k AS VARCHAR) AS rule_id, '{lv}' AS level, '{m}' AS message FROM base WHERE {c}"
    for lv, m, c in [
        ("WARN", "legacy schema", "k % 11 = 0"), ("ERROR", "missing language", "k % 4 = 3"), ("WARN", "unknown severity", "k % 3 = 1"), ("WARN", "missing package", "k % 5 = 0"),
        ("ERROR", "language and ecosystem differ", "k % 5 <> 0 AND (k % 4 = 0 AND k % 2 = 1 OR k % 4 = 1 OR k % 4 = 2)"), ("WARN", "missing versions", "k % 2 = 1"), ("WARN", "missing patterns", "k % 3 = 2"), ("WARN", "generic patterns only", "k % 3 = 0"),
    ]
)
R.add("rule_lint", lambda s, d: A.lint(linted(s, d)), _LINT, BASE)
R.add("rule_lint_summary", lambda s, d: A.lint(linted(s, d)).groupBy("level", "message").agg(F.count("*").alias("n")), f"SELECT level, message, count(*) AS n FROM ({_LINT}) GROUP BY 1, 2", BASE)


def cve_version_gate(s, d):
    k, z = F.col("k"), F.col("z")
    v = F.concat(z.cast("string"), F.lit("."), (k % 10).cast("string"), F.when(k % 3 == 0, "-beta2").otherwise(""))
    intro, fixed = F.array(F.lit("10.2"), F.lit("20.0.1")), F.when(k % 4 != 0, F.array(F.lit("30.5"), F.lit("40")))
    return base(s, d).select("k", v.alias("version"), version_affected(v, intro, fixed).alias("affected"))


R.add(
    "cve_version_gate", cve_version_gate,
    "SELECT k, version, seg >= [10, 2] AND (k % 4 = 0 OR seg < [30, 5]) AS affected FROM (SELECT k, version, list_transform(string_split(replace(version, '-', '.'), '.'), lambda x: coalesce(try_cast(nullif(regexp_replace(x, '[^0-9]', '', 'g'), '') AS INTEGER), 0)) AS seg FROM (SELECT k, CAST(z AS VARCHAR) || '.' || CAST(k % 10 AS VARCHAR) || CASE WHEN k % 3 = 0 THEN '-beta2' ELSE '' END AS version FROM base))", BASE,
)


def _packages(s, d):
    """(rule_id, ecosystem, package, introduced, fixed): a rule a part."""
    k, z = F.col("k"), F.col("z")
    text = lambda x: x.cast("string")
    intro = F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(text(z % 30), F.lit(".2")), F.concat(text(z % 30 + 1), F.lit(".0"))))
    fixed = F.when(k % 4 == 0, F.array(F.lit(""))).otherwise(F.array(F.concat(text(z % 30 + 3), F.lit(".10.1"))))
    return base(s, d).select(F.concat(F.lit("cve-"), text(k)).alias("rule_id"), F.when(k % 6 == 0, "").otherwise(F.concat(F.lit(" "), F.upper("ecosystem"))).alias("ecosystem"), F.concat(F.lit("p"), text(k % 40)).alias("package"), intro.alias("introduced"), fixed.alias("fixed"))


def _dependencies(s, d):
    """(ecosystem, package, version): a version a supplier; Maven has none."""
    k = F.col("s_suppkey").cast("long")
    v = F.concat((k * 7 % 40).cast("string"), F.lit("."), (k % 12).cast("string"), F.when(k % 3 == 0, "-rc1").otherwise(""))
    return table(s, d, "supplier").select(pick(["npm", "PyPI", "Go"], k).alias("ecosystem"), F.concat(F.lit("p"), (k % 37).cast("string")).alias("package"), F.when(k % 11 != 0, v).alias("version"))


PACKAGES = """packages AS (
  SELECT 'cve-' || k AS rule_id, CASE WHEN k % 6 = 0 THEN '' ELSE lower(ecosystem) END AS ecosystem, 'p' || (k % 40) AS package,
    CASE WHEN k % 5 <> 0 THEN [z % 30, 2] END AS low, CASE WHEN k % 4 <> 0 THEN [z % 30 + 3, 10, 1] END AS high FROM base),
dependencies AS (
  SELECT lower(['npm', 'PyPI', 'Go'][CAST(k % 3 + 1 AS INTEGER)]) AS ecosystem, 'p' || (k % 37) AS package,
    CASE WHEN k % 11 <> 0 THEN (k * 7 % 40) || '.' || (k % 12) || CASE WHEN k % 3 = 0 THEN '-rc1' ELSE '' END END AS version, CASE WHEN k % 3 = 0 THEN [k * 7 % 40, k % 12, 1] ELSE [k * 7 % 40, k % 12] END AS seg
  FROM (SELECT CAST(s_suppkey AS BIGINT) AS k FROM supplier)),
met AS (SELECT p.rule_id, p.ecosystem, p.package, d.version FROM packages p JOIN dependencies d USING (ecosystem, package) WHERE d.version IS NOT NULL AND (low IS NULL OR seg >= low) AND (high IS NULL OR seg < high))"""
R.add("affected_dependencies", lambda s, d: audit.affected_dependencies(_packages(s, d), _dependencies(s, d)), "SELECT * FROM met", BASE, PACKAGES)
R.add(
    "barred_rules", lambda s, d: audit.barred(_packages(s, d), _dependencies(s, d)),
    "SELECT rule_id FROM packages WHERE ecosystem IN (SELECT ecosystem FROM dependencies) AND rule_id NOT IN (SELECT rule_id FROM met)", BASE, PACKAGES,
)


# --- nested advisories ------------------------------------------------------------------------------------------------
def nested_json(s, d):
    """(path, body): an advisory a part: of every eleven one is cut off, one has a field of another type, one lacks an id, two are of the older shape."""
    k, text = F.col("k"), F.col("k").cast("string")
    q = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    package = lambda eco, name, low, high: F.concat(F.lit('{"package":{"ecosystem":'), q(eco), F.lit(',"name":'), q(name), F.lit('},"ranges":[{"type":"SEMVER","events":[{"introduced":'), q(low), F.lit('},{"fixed":'), q(high), F.lit('}]}],"versions":["1.0","1.1","1.2","1.3"]}'))
    other = package(F.lit("PyPI"), F.concat(F.lit("py-"), text), F.lit("0"), F.lit("2.0"))
    own = package(F.col("ecosystem"), F.concat(F.lit("pkg-"), (k % 10).cast("string")), (k % 7).cast("string"), F.concat((k % 7 + 2).cast("string"), F.lit(".1")))
    ghsa = F.concat(
        F.lit('{"id":"GHSA-'), text, F.lit('","severity":[{"type":"CVSS_V3","score":"x"}],"summary":'), q(F.when(k % 5 == 0, "").otherwise(F.col("description"))), F.lit(',"details":"more","published":'), q(F.col("published")),
        F.lit(',"references":[{"type":"WEB","url":"u"},{"type":"WEB"}],"database_specific":{"severity":'), q(pick(["CRITICAL", "MODERATE", " low"], k)), F.lit(',"cwe_ids":["CWE-1"]},"affected":['), F.when(k % 2 == 0, F.concat(other, F.lit(","))).otherwise(""), own, F.lit("]}"),
    )
    older = F.concat(F.lit('{"cve_id":"CVE-2024-'), text, F.lit('","description":'), q(F.col("description")), F.lit(',"severity":"Medium","affected_library":'), q(F.when(k % 2 == 0, "").otherwise("lib")), F.lit("}"))
    body = F.when(k % 11 == 0, F.substring(ghsa, 1, 40)).when(k % 11 == 1, F.lit('{"id":"GHSA-x","affected":"all"}')).when(k % 11 == 2, F.lit('{"summary":"no id"}')).when(k % 11 < 5, older).otherwise(ghsa)
    return base(s, d).select(F.concat(F.lit("a/"), text, F.lit(".json")).alias("path"), body.alias("body"))


_good = lambda s, d: A.records(nested_json(s, d))[0]
_GHSA = "nested AS (SELECT *, CASE k % 3 WHEN 0 THEN 'critical' WHEN 2 THEN 'low' ELSE 'high' END AS word, CASE WHEN ecosystem = 'npm' THEN 'pkg-' || (k % 10) ELSE 'unknown' END AS npm FROM base WHERE k % 11 >= 5), older AS (SELECT *, CASE WHEN k % 2 = 0 THEN 'unknown' ELSE 'lib' END AS lib FROM base WHERE k % 11 IN (3, 4))"
_REQUIRES = lambda n: "'require(\"' || " + n + " || '\")'"
R.add("advisory_rejects", lambda s, d: A.records(nested_json(s, d))[1].select("path", "error"), "SELECT 'a/' || k || '.json' AS path, ['no JSON object', 'malformed', 'no id'][CAST(k % 11 + 1 AS INTEGER)] AS error FROM base WHERE k % 11 < 3", BASE)
R.add(
    "npm_rules", lambda s, d: A.npm_rules(_good(s, d)).select("rule_id", "description", "severity", "package", F.col("patterns")[0].alias("pattern"), F.array_join("tags", ",").alias("tags"), F.array_join("links", ",").alias("links"), F.array_join("introduced", ",").alias("introduced")),
    f"""SELECT 'prorule.javascript.' || word || '.ghsa_' || k AS rule_id, CASE WHEN k % 5 = 0 THEN 'more' ELSE description END AS description, word AS severity, npm AS package, {_REQUIRES("npm")} AS pattern, 'cve,vulnerability,javascript,npm,ghsa-' || k AS tags, 'u' AS links, '1.0,1.1,1.2' AS introduced FROM nested
UNION ALL SELECT 'prorule.javascript.medium.cve_2024_' || k, description, 'medium', lib, {_REQUIRES("lib")}, 'cve,vulnerability,javascript,npm,CVE-2024-' || k, '', '' FROM older""",
    BASE, _GHSA,
)
R.add("recent_npm_advisories", lambda s, d: A.recent_npm(_good(s, d), "2024-06-01").select("id", "published"), "SELECT 'GHSA-' || k AS id, published FROM nested WHERE ecosystem = 'npm' AND coalesce(try_cast(published AS DATE) >= DATE '2024-06-01', true)", BASE, _GHSA)
R.add(
    "advisory_dependencies", lambda s, d: audit.affected_dependencies(A.package_ranges(_good(s, d)).withColumnRenamed("advisory_id", "rule_id"), _used(s, d)),
    """SELECT 'GHSA-' || k AS rule_id, lower(ecosystem) AS ecosystem, 'pkg-' || (k % 10) AS package, v || '.0' AS version FROM nested, (SELECT DISTINCT CAST(s_suppkey % 9 AS BIGINT) AS v, CAST(s_suppkey % 10 AS BIGINT) AS p FROM supplier WHERE s_suppkey % 3 = 0)
WHERE ecosystem = 'npm' AND p = k % 10 AND v >= k % 7 AND v < k % 7 + 3 AND (v < k % 7 + 2 OR [v, 0] < [k % 7 + 2, 1])""",
    BASE, _GHSA,
)


def _used(s, d):
    """(ecosystem, package, version): what some suppliers use."""
    k = F.col("s_suppkey")
    return table(s, d, "supplier").where(k % 3 == 0).select(F.lit("npm").alias("ecosystem"), F.concat(F.lit("pkg-"), (k % 10).cast("string")).alias("package"), F.concat((k % 9).cast("string"), F.lit(".0")).alias("version")).distinct()


def _older_java(s, d):
    k, text = F.col("k"), F.col("k").cast("string")
    return base(s, d).select(
        F.concat(F.lit("cve/x"), text, F.lit(".v.yaml")).alias("path"), F.when(k % 3 == 0, F.concat(F.lit("rule-"), text)).alias("rule_id"), F.when(k % 4 == 0, F.concat(F.lit("GHSA-A "), text)).otherwise("").alias("ghsa_id"),
        F.when(k % 5 == 0, F.concat(F.lit("CVE-"), text)).alias("cve_id"), pick(["HIGH", "", "low"], k).alias("severity"), F.lit(None).cast("string").alias("language"),
        F.when(k % 7 == 0, F.array().cast("array<string>")).when(k % 2 == 0, F.array(F.lit(" org.x:lib:y "), F.lit("second"))).otherwise(F.array(F.lit("plain"))).alias("affected_packages"),
        F.array(F.lit("0"), F.lit(" 1.2 "), F.lit("")).alias("affected_versions"), F.when(k % 2 == 0, F.array(F.lit("2"))).alias("fixed_versions"),
    )


R.add(
    "java_rules", lambda s, d: A.java_rules(_older_java(s, d)).select("rule_id", "severity", "language", "group_id", "artifact_id", F.array_join("introduced", ",").alias("introduced"), F.array_join("fixed", ",").alias("fixed"), F.array_join("patterns", "|").alias("patterns"), F.array_join("aliases", ",").alias("aliases"), F.array_join("tags", ",").alias("tags")),
    """SELECT CASE WHEN k % 3 = 0 THEN 'rule-' || k WHEN k % 4 = 0 THEN 'prorule.ghsa-a-' || k || '_java' WHEN k % 5 = 0 THEN 'prorule.cve-' || k || '_java' ELSE 'prorule.x' || k || '.v_java' END AS rule_id, ['high', 'medium', 'low'][CAST(k % 3 + 1 AS INTEGER)] AS severity, 'java' AS language,
  CASE WHEN k % 7 <> 0 AND k % 2 = 0 THEN 'org.x' ELSE '' END AS group_id, CASE WHEN k % 7 = 0 THEN '' WHEN k % 2 = 0 THEN 'lib:y' ELSE 'plain' END AS artifact_id, '1.2' AS introduced, CASE WHEN k % 2 = 0 THEN '2' ELSE '' END AS fixed,
  CASE WHEN k % 7 = 0 THEN '' ELSE CASE WHEN k % 2 = 0 THEN '<groupId>org.x</groupId>|<artifactId>lib:y</artifactId>' ELSE '<artifactId>plain</artifactId>' END || array_to_string(list_transform(['implementation', 'compile', 'compileOnly', 'runtimeOnly', 'testImplementation'], lambda c: '|' || c || ' ' || chr(39) || CASE WHEN k % 2 = 0 THEN 'org.x:lib:y' ELSE 'plain' END || ':' || chr(39)), '') END AS patterns,
  CASE WHEN k % 5 = 0 THEN 'CVE-' || k ELSE '' END AS aliases, 'cve,vulnerability,java,maven' || CASE WHEN k % 4 = 0 THEN ',ghsa-a ' || k WHEN k % 5 = 0 THEN ',cve-' || k ELSE '' END AS tags FROM base""", BASE,
)
R.add("slugify", lambda s, d: table(s, d, "customer").select("c_custkey", dialect.slug(F.col("c_name")).alias("slug")), "SELECT c_custkey, regexp_replace(lower(replace(c_name, '-', '_')), '[^a-z0-9_]', '_', 'g') AS slug FROM customer")
