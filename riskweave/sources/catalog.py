"""The rule catalogue: pattern and signal rules as rows, rule files, profiles and lookups.

A rule is a row; the strategies that code implements are in operators.builtin_rules."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions import dialect

FIELDS = ("rule_id", "signal", "match", "action", "file", "language", "severity", "impact", "flags", "rule_type", "blocking")

# Ids, signals, patterns, file globs, languages, severities, dimensions, flags, explicit type and blocking.
RULES = [
    ('absolute.concurrency.new_thread', '', 'new\\s+Thread\\(.*\\)', '', '', '*', 'high', 'runtime', '', 'absolute', 'true'),
    ('absolute.concurrency.fixed_threadpool_1', '', 'Executors\\.newFixedThreadPool\\(1\\)', '', '', '*', 'medium', 'runtime', '', 'absolute', ''),
    ('absolute.concurrency.sleep_long', '', 'Thread\\.sleep\\(\\d{4,}\\)', '', '', '*', 'high', 'runtime', '', 'absolute', ''),
    ('absolute.security.sql_injection', '', 'SELECT\\s+.*\\s+FROM\\s+.*\\s+WHERE\\s+.*\\s+\\+\\s+\\w+', '', '', '*', 'critical', 'security', '', 'absolute', 'true'),
    ('absolute.security.plaintext_token', '', '(token|password|secret|key)\\s*=\\s*["\'][a-zA-Z0-9_\\-]{16,}["\']', '', '', '*', 'critical', 'security', 'i', 'absolute', 'true'),
    ('absolute.security.http_url', '', 'http://[a-zA-Z0-9\\.\\-]+', '', '', '*', 'high', 'security', '', 'absolute', ''),
    ('absolute.stability.catch_exception', '', 'catch\\s*\\(\\s*Exception\\s+\\w+\\s*\\)', '', '', '*', 'medium', 'maintenance', '', 'absolute', ''),
    ('absolute.stability.optional_get', '', '\\.get\\(\\)', '', '**.java', '*', 'high', 'runtime', '', 'absolute', ''),
    ('runtime.concurrency_risk', 'runtime.concurrency.synchronized', '', 'added', '**/core/**', '*', 'high', 'runtime', '', '', ''),
    ('runtime.concurrency_synchronized_removed_critical', 'runtime.concurrency.synchronized', '', 'removed', '**', '*', 'critical', 'runtime', '', '', ''),
    ('runtime.concurrency_lock_risk', 'runtime.concurrency.lock', '', 'added', '**/core/**', '*', 'high', 'runtime', '', '', ''),
    ('runtime.concurrency_lock_removed_critical', 'runtime.concurrency.lock', '', 'removed', '**', '*', 'critical', 'runtime', '', '', ''),
    ('runtime.concurrency_volatile_risk', 'runtime.concurrency.volatile', '', 'added', '**/core/**', '*', 'high', 'runtime', '', '', ''),
    ('runtime.concurrency_volatile_removed_risk', 'runtime.concurrency.volatile', '', 'removed', '**', '*', 'critical', 'runtime', '', '', ''),
    ('runtime.concurrency_map_removed_risk', 'runtime.concurrency.concurrent_map', '', 'removed', '**', '*', 'high', 'runtime', '', '', ''),
    ('runtime.concurrency.thread_safety_downgrade', 'runtime.concurrency.thread_safety_downgrade', '', 'downgrade', '**', '*', 'critical', 'runtime', '', '', ''),
    ('runtime.concurrency.static_unsafe_collection', 'runtime.concurrency.static_unsafe_collection', '', 'added', '**', '*', 'high', 'runtime', '', '', ''),
    ('runtime.performance.sleep_added', 'runtime.performance.sleep_added', '', 'added', '**', '*', 'medium', 'performance', '', '', ''),
    ('runtime.concurrency.executors_factory_risk', 'runtime.concurrency.executors_factory_risk', '', 'added', '**', '*', 'critical', 'runtime', '', '', ''),
    ('runtime.concurrency.future_get_without_timeout', 'runtime.concurrency.future_get_without_timeout', '', 'added', '**', '*', 'critical', 'runtime', '', '', ''),
    ('runtime.concurrency.threadpool_creation', 'runtime.concurrency.threadpool_creation', '', 'added', '**', '*', 'high', 'runtime', '', '', ''),
    ('runtime.service_layer', 'api.method_signature_changed', '', '', '**/service/**', '*', 'medium', 'runtime', '', '', ''),
    ('data.destructive_schema', '', 'ALTER TABLE|DROP TABLE', '', '**/migrations/**', '*', 'high', 'data', '', '', ''),
    ('data.query_change', '', '^\\s*(SELECT|INSERT|UPDATE|DELETE)\\s+', 'changed', '', '*', 'medium', 'data', '', '', ''),
    ('architecture.dependency_change', '', '', '', '**/package.json', '*', 'high', 'architecture', '', '', ''),
    ('architecture.dependency_change_python', '', '', '', '**/requirements.txt', '*', 'high', 'architecture', '', '', ''),
    ('runtime.input_normalization_removed', 'runtime.input_normalization_removed', '', 'removed', '**', '*', 'high', 'runtime', '', '', ''),
    ('data.pagination_semantic_change', 'data.pagination_semantic_change', '', 'changed', '**', '*', 'high', 'data', '', '', ''),
    ('runtime.collection_mutation_inside_loop', 'runtime.collection_mutation_inside_loop', '', 'added', '**', '*', 'high', 'runtime', '', '', ''),
    ('security.behavior_change_auth', '', '', '', '**/auth/**', '*', 'high', 'security', '', '', ''),
    ('security.behavior_change_security', '', '', '', '**/security/**', '*', 'high', 'security', '', '', ''),
    ('runtime.validation_removed', '', '.*', '', '**/validation/**', '*', 'high', 'runtime', '', '', ''),
    ('runtime.concurrency.lock_removed', 'runtime.concurrency.lock_removed', '', 'removed', '**', '*', 'critical', 'runtime', '', '', ''),
    ('runtime.concurrency.volatile_removed', 'runtime.concurrency.volatile_removed', '', 'removed', '**', '*', 'critical', 'runtime', '', '', ''),
    ('runtime.concurrency.final_removed', 'runtime.concurrency.final_removed', '', 'removed', '**', '*', 'critical', 'runtime', '', '', ''),
    ('runtime.concurrency.atomic_to_non_atomic_write', 'runtime.concurrency.atomic_to_non_atomic_write', '', 'removed', '**', '*', 'critical', 'runtime', '', '', ''),
    ('runtime.concurrency.threadpool_param_change', 'runtime.concurrency.threadpool_param_change', '', 'changed', '**', '*', 'high', 'runtime', '', '', ''),
    ('runtime.concurrency.threadpool_unbounded_queue', 'runtime.concurrency.threadpool_unbounded_queue', '', 'added', '**', '*', 'critical', 'runtime', '', '', ''),
    ('runtime.concurrency.busy_wait_added', 'runtime.concurrency.busy_wait_added', '', 'added', '**', '*', 'critical', 'performance', '', '', ''),
    ('runtime.resource.try_with_resource_removed', 'runtime.resource.try_with_resource_removed', '', 'removed', '**', '*', 'high', 'runtime', '', '', ''),
    ('runtime.resource.cache_eviction_removed', 'runtime.resource.cache_eviction_removed', '', 'removed', '**', '*', 'high', 'runtime', '', '', ''),
    ('runtime.network.timeout_removed', 'runtime.network.timeout_removed', '', 'removed', '**', '*', 'high', 'runtime', '', '', ''),
    ('runtime.data.null_check_removed', 'runtime.data.null_check_removed', '', 'removed', '**', '*', 'medium', 'runtime', '', '', ''),
    ('runtime.data.equals_to_reference_compare', 'runtime.data.equals_to_reference_compare', '', 'changed', '**', '*', 'high', 'runtime', '', '', ''),
    ('security.hardcoded_secret', 'security.hardcoded_secret', '', 'added', '**', '*', 'critical', 'security', '', '', 'true'),
    ('security.sql_injection', 'security.sql_injection', '', 'added', '**', '*', 'critical', 'security', '', '', 'true'),
    ('security.weak_crypto', 'security.weak_crypto', '', 'added', '**', '*', 'high', 'security', '', '', ''),
    ('security.command_injection', 'security.command_injection', '', 'added', '**', '*', 'critical', 'security', '', '', 'true'),
    ('security.hardcoded_secret_removed', 'security.hardcoded_secret_removed', '', 'removed', '**', '*', 'medium', 'security', '', '', ''),
    ('cpp.exception.noexcept', '', 'noexcept', '', '**/*.cpp', 'cpp', 'medium', 'runtime', '', '', ''),
    ('cpp.exception.swallowed', '', 'catch\\(\\)', '', '**/*.cpp', 'cpp', 'high', 'runtime', '', '', ''),
    ('cpp.maintenance.magic_number', '', '1000', '', '**/*.cpp', 'cpp', 'low', 'maintenance', '', '', ''),
    ('cpp.null.dereference', '', '->', '', '**/*.cpp', 'cpp', 'high', 'runtime', '', '', ''),
    ('cpp.performance.inefficient_copy', '', 'push_back', '', '**/*.cpp', 'cpp', 'low', 'performance', '', '', ''),
    ('cpp.performance.unbounded_vector', '', 'push_back', '', '**/*.cpp', 'cpp', 'low', 'performance', '', '', ''),
    ('cpp.resource.leak', '', 'fopen', '', '**/*.cpp', 'cpp', 'high', 'runtime', '', '', ''),
    ('cpp.resource.memory_leak', '', '\\bnew\\b', '', '**/*.cpp', 'cpp', 'high', 'runtime', '', '', ''),
    ('cpp.resource.raw_pointer', '', 'int\\*', '', '**/*.cpp', 'cpp', 'medium', 'security', '', '', ''),
    ('cpp.runtime.data_race', '', 'std::', '', '**/*.cpp', 'cpp', 'high', 'runtime', '', '', ''),
    ('cpp.runtime.uninitialized', '', 'int x;', '', '**/*.cpp', 'cpp', 'high', 'runtime', '', '', ''),
    ('cpp.security.buffer_overflow', '', 'strcpy', '', '**/*.cpp', 'cpp', 'critical', 'security', '', '', ''),
    ('cpp.security.command_injection', '', 'system\\(', '', '**/*.cpp', 'cpp', 'critical', 'security', '', '', ''),
    ('cpp.security.integer_overflow', '', '\\+\\+', '', '**/*.cpp', 'cpp', 'high', 'security', '', '', ''),
    ('cpp.security.sql_injection', '', 'execute\\(', '', '**/*.cpp', 'cpp', 'critical', 'security', '', '', ''),
    ('cpp.security.unsafe_cast', '', 'reinterpret_cast', '', '**/*.cpp', 'cpp', 'high', 'security', '', '', ''),
    ('exception.error_ignored', '', '_\\s*=\\s*\\w+\\s*\\([^)]*\\)', '', '**/*.go', 'go', 'medium', 'maintenance', '', '', ''),
    ('null.nil_dereference', '', '\\*\\s*\\w+|\\w+\\s*\\.\\s*\\w+\\s*\\(', '', '**/*.go', 'go', 'high', 'runtime', '', '', ''),
    ('resource.channel_leak', '', 'make\\s*\\(\\s*chan|chan\\s+\\w+\\s*=', '', '**/*.go', 'go', 'high', 'runtime', '', '', ''),
    ('resource.defer_misuse', '', 'for\\s*\\{[\\s\\S]{0,200}\\bdefer\\s+|defer\\s+\\w+\\s*\\(\\s*\\w+\\s*[+\\-*/]', '', '**/*.go', 'go', 'medium', 'runtime', '', '', ''),
    ('resource.goroutine_leak', '', '\\bgo\\s+\\w+\\.?\\w*\\s*\\(', '', '**/*.go', 'go', 'high', 'runtime', '', '', ''),
    ('go.runtime.goroutine_in_loop', '', 'for\\s*\\{[\\s\\S]{0,200}\\bgo\\s+\\w', '', '**/*.go', 'go', 'high', 'runtime', '', '', ''),
    ('go.runtime.panic_added', '', '\\bpanic\\s*\\(', '', '**/*.go', 'go', 'medium', 'runtime', '', '', ''),
    ('runtime.race_condition', '', '\\bgo\\s+\\w+|\\bmap\\[|\\bslice\\b|\\bchan\\b', '', '**/*.go', 'go', 'high', 'runtime', '', '', ''),
    ('go.security.command_injection', '', 'exec\\.Command\\(', '', '**/*.go', 'go', 'high', 'security', '', '', ''),
    ('security.http_vulnerability', '', 'http\\.(Get|Post)\\s*\\([^)]*\\+|http\\.ListenAndServe\\s*\\(', '', '**/*.go', 'go', 'high', 'security', '', '', ''),
    ('go.security.path_traversal', '', '(?:os\\.Open|os\\.ReadFile|ioutil\\.ReadFile)\\([^)]*\\+', '', '**/*.go', 'go', 'high', 'security', '', '', ''),
    ('go.security.sql_injection', '', 'fmt\\.Sprintf\\(\\s*"(?:SELECT|INSERT|UPDATE|DELETE)\\b', '', '**/*.go', 'go', 'critical', 'security', '', '', ''),
    ('security.unsafe_usage', '', '\\bunsafe\\.(Pointer|Sizeof|Alignof|Offsetof)\\s*\\(', '', '**/*.go', 'go', 'high', 'security', '', '', ''),
    ('javascript.exception.promise_reject', '', '\\.reject\\(', '', '**/*.js', 'javascript', 'medium', 'runtime', '', '', ''),
    ('javascript.maintenance.debug_code', '', 'console.log', '', '**/*.js', 'javascript', 'low', 'maintenance', '', '', ''),
    ('javascript.maintenance.debugger', '', 'debugger', '', '**/*.js', 'javascript', 'low', 'maintenance', '', '', ''),
    ('javascript.maintenance.deprecated_api', '', 'defineGetter', '', '**/*.js', 'javascript', 'low', 'maintenance', '', '', ''),
    ('javascript.null.type_assertion', '', ' as ', '', '**/*.js', 'javascript', 'medium', 'runtime', '', '', ''),
    ('javascript.performance.dynamic_import', '', 'import\\(', '', '**/*.js', 'javascript', 'low', 'performance', '', '', ''),
    ('javascript.performance.regex_dos', '', '/.**/', '', '**/*.js', 'javascript', 'medium', 'performance', '', '', ''),
    ('javascript.security.code_injection', '', 'eval\\(', '', '**/*.js', 'javascript', 'critical', 'security', '', '', ''),
    ('javascript.security.command_injection', '', 'exec\\(', '', '**/*.js', 'javascript', 'critical', 'security', '', '', ''),
    ('javascript.security.open_redirect', '', 'location=', '', '**/*.js', 'javascript', 'medium', 'security', '', '', ''),
    ('javascript.security.prototype_pollution', '', '__proto__', '', '**/*.js', 'javascript', 'high', 'security', '', '', ''),
    ('javascript.security.sensitive_storage', '', 'localStorage', '', '**/*.js', 'javascript', 'medium', 'security', '', '', ''),
    ('javascript.security.xss', '', 'innerHTML', '', '**/*.js', 'javascript', 'high', 'security', '', '', ''),
    ('python.exception.swallowed', '', 'except:', '', '**/*.py', 'python', 'high', 'runtime', '', '', ''),
    ('python.exception.too_generic', '', 'except Exception', '', '**/*.py', 'python', 'medium', 'maintenance', '', '', ''),
    ('python.maintenance.debug_code', '', 'print\\(', '', '**/*.py', 'python', 'low', 'maintenance', '', '', ''),
    ('python.null.none_check', '', '\\.\\w+\\(', '', '**/*.py', 'python', 'high', 'runtime', '', '', ''),
    ('python.null.type_confusion', '', 'cast\\(', '', '**/*.py', 'python', 'medium', 'runtime', '', '', ''),
    ('python.performance.inefficient_loop', '', 'for.*range', '', '**/*.py', 'python', 'low', 'performance', '', '', ''),
    ('python.performance.memory', '', '\\.read\\(\\)', '', '**/*.py', 'python', 'medium', 'performance', '', '', ''),
    ('python.resource.file_leak', '', 'open\\(', '', '**/*.py', 'python', 'high', 'security', '', '', ''),
    ('python.runtime.mutable_default', '', 'def.*=', '', '**/*.py', 'python', 'high', 'maintenance', '', '', ''),
    ('python.security.code_injection', '', 'eval\\(', '', '**/*.py', 'python', 'high', 'security', '', '', ''),
    ('python.security.command_injection', '', 'os.system', '', '**/*.py', 'python', 'critical', 'security', '', '', ''),
    ('python.security.path_traversal', '', 'open\\(', '', '**/*.py', 'python', 'high', 'security', '', '', ''),
    ('python.security.sensitive_import', '', 'import os', '', '**/*.py', 'python', 'medium', 'security', '', '', ''),
    ('python.security.sql_injection', '', 'cursor.execute', '', '**/*.py', 'python', 'critical', 'security', '', '', ''),
    ('python.security.weak_crypto', '', 'md5\\(', '', '**/*.py', 'python', 'high', 'security', '', '', ''),
    ('typescript.exception.promise_reject', '', 'new\\s+Promise\\(|Promise\\.reject\\(', '', '**/*.ts*', 'typescript', 'medium', 'runtime', '', '', ''),
    ('typescript.maintenance.debugger', '', '\\bdebugger\\b', '', '**/*.ts*', 'typescript', 'low', 'maintenance', '', '', ''),
    ('typescript.security.command_injection', '', 'child_process\\.(exec|execSync|spawn)\\(', '', '**/*.ts*', 'typescript', 'critical', 'security', '', '', ''),
    ('typescript.security.prototype_pollution', '', '__proto__|prototype\\[', '', '**/*.ts*', 'typescript', 'high', 'security', '', '', ''),
    ('typescript.security.xss', '', 'innerHTML|dangerouslySetInnerHTML', '', '**/*.ts*', 'typescript', 'high', 'security', '', '', ''),
]

# Files that only decide whether rules are scheduled.
SKIP_PATHS = [
    "**/test/**", "**/tests/**", "**/*Test*.java", "**/spec/**", "**/__tests__/**", "**/*_test.py", "**/test_*.py", "**/docs/**", "**/*.md", "**/*.rst", "**/*.txt", "**/*.log",
    "**/CHANGELOG*", "**/.github/**", "**/.gitlab/**", "**/.vscode/**",
]

# Extensions of a rule's language.
LANGUAGE_EXTENSIONS = {
    "java": [".java"], "go": [".go"], "python": [".py"], "javascript": [".js", ".jsx", ".mjs", ".cjs"], "typescript": [".ts", ".tsx"], "cpp": [".cpp", ".cc", ".cxx", ".h", ".hpp", ".c++"], "c": [".c", ".h"],
}

SCHEMA = "load_order int, rule_id string, source string, signal string, match string, action string, file string, language string, scope string, severity string, impact string, flags string, rule_type string, is_blocking boolean, status string, enabled boolean, rationale string"


def normalized(row: dict, order: int, source: str) -> tuple:
    """A rule of any of the three file shapes as a row of SCHEMA: defaults, derived type and derived blocking."""
    get = lambda k, d="": row.get(k) if row.get(k) not in (None, "") else d
    action = str(get("action")).lower()
    kind = get("rule_type") or ("regression" if action in ("removed", "deleted", "changed", "modified") else "absolute")
    severity = get("severity", "low")
    explicit = row.get("is_blocking", row.get("blocking"))
    blocking = kind == "absolute" and severity == "critical" if explicit in (None, "") else str(explicit).lower() == "true"
    rule = get("rule_id") or get("id") or get("rule_name", "unknown")
    return (
        order, rule, source, get("signal") or None, get("match") or None, get("action") or None, get("file") or None, get("language", "*"), get("scope") or get("file", "**"), severity, get("impact", "runtime"),
        "i" if row.get("case_insensitive") or row.get("flags") == "i" else "", kind, blocking, str(get("status", "stable")).lower(), row.get("enabled", True) is not False, get("rationale", f"{rule} matched"),
    )


def rows() -> list[tuple]:
    """The whole catalogue in load order: rules in code first, then those in rows."""
    from riskweave.operators import builtin_rules

    found = [normalized(r, i, "code") for i, r in enumerate(builtin_rules.catalogue())]
    return found + [normalized(dict(zip(FIELDS, r, strict=True)), len(found) + i, "rows") for i, r in enumerate(RULES)]


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), SCHEMA)


def shaped(data: dict) -> list[tuple[dict, str]]:
    """(rule, kind of file) of a file's content in any of three shapes: a list under rules, a single rule, ids as keys."""
    if isinstance(data.get("rules"), list):
        return [(r, "multi") for r in data["rules"]]
    if "id" in data or "rule_name" in data:
        # a single advisory rule: nobody emits its signal
        return [({"signal": "security.vulnerability", "file": "**", "impact": "security", **data}, "single")]
    return [({"id": k, **v}, "keyed") for k, v in data.items() if isinstance(v, dict)]


def load_files(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a YAML file or of a folder, by sorted name within each folder, read by the driver; see rulestore for large trees."""
    import yaml  # optional

    names = [path] if os.path.isfile(path) else [os.path.join(d, f) for d, _, fs in sorted(os.walk(path)) for f in sorted(fs) if f.endswith((".yaml", ".yml"))]
    found: list[tuple] = []
    for name in names:
        with open(name, encoding="utf-8") as f:
            data = yaml.safe_load(f) or {}
        found += [normalized(r, len(found) + i, source) for i, (r, source) in enumerate(shaped(data))]
    return spark.createDataFrame(found, SCHEMA)


def union(*catalogues: DataFrame) -> DataFrame:
    """Catalogues one after the other, renumbered."""
    out = None
    for i, c in enumerate(catalogues):
        c = c.withColumn("part", F.lit(i))
        out = c if out is None else out.unionByName(c)
    from pyspark.sql import Window

    return out.withColumn("load_order", F.row_number().over(Window.orderBy("part", "load_order")) - 1).drop("part")


def by_profile(rules: DataFrame, profile: str) -> DataFrame:
    """lightweight keeps critical rules, standard critical and high ones, an unknown profile all that are enabled; strict and none keep everything."""
    if not profile or profile == "strict":
        return rules
    keep = {"lightweight": ["critical"], "standard": ["critical", "high"]}.get(profile, dialect.SEVERITIES)
    return rules.where(F.col("enabled") & F.lower("severity").isin(keep))


def by_category(rules: DataFrame) -> DataFrame:
    """The catalogue by the first part of the id."""
    return rules.groupBy(F.substring_index("rule_id", ".", 1).alias("category")).agg(F.count("*").alias("n_rules"), F.sum(F.col("is_blocking").cast("int")).alias("n_blocking"))


def valid_pattern(pattern: str | None) -> bool:
    return bool(pattern) and dialect.valid(pattern)
