"""Rules whose matching is more than one pattern: declared once, compiled to Spark columns and, for checking, to DuckDB SQL.

A rule names a strategy and its patterns. `column` gives the file that the rule reports (null: no match) from the raw diff, its files and
its signals, without a join or a Python worker. Patterns are searched in the whole raw text, context lines and headers included, as
one finding a rule and diff. `semantics="intended"` lets ^ match at every line in the rules that anchor without
multi-line mode; the default keeps their effect, a match at the start of the diff only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskweave.functions.dialect import java_regex, required_literals


@dataclass(frozen=True)
class Rule:
    rule_id: str
    severity: str
    impact: str
    rule_type: str
    strategy: str
    a: tuple[str, ...] = ()
    b: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()
    flags_a: str = ""
    flags_b: str = ""
    tags: tuple = ()
    language: str = "*"
    loaded: bool = True
    re2: dict = field(default_factory=dict)  # patterns for engines without lookaround, by strategy position


# Patterns, words and tags of the rules below.
CLOSEABLE = "InputStream|OutputStream|Reader|Writer|Socket|ServerSocket|Connection|Statement|ResultSet|BufferedReader|BufferedWriter"
COLLECTIONS = "List|Set|Map|Collection|ArrayList|HashSet|HashMap|TreeSet|TreeMap|LinkedList|LinkedHashMap"
WRAPPERS = "Integer|Long|Double|Float|Boolean|Character|Short|Byte"
CRITICAL_PATHS = ("/controller/", "/service/", "/biz/", "/business/", "/api/", "/handler/")
DATA_PATHS = ("/dto/", "/entity/", "/model/", "/vo/", "/bo/", "/domain/")
DOWNGRADES = [("ConcurrentHashMap", "HashMap", "Concurrent"), ("ConcurrentMap", "HashMap", "Concurrent"), ("CopyOnWriteArrayList", "ArrayList", "CopyOnWrite"), ("CopyOnWriteArraySet", "HashSet", ""), ("AtomicInteger", "Integer", "Atomic"), ("AtomicLong", "Long", "Atomic"), ("AtomicBoolean", "Boolean", "Atomic")]
METHOD = r"\s*(?:public|protected)\s+(?:static\s+)?(?:\w+(?:<[^>]+>)?\s+)+(\w+)\s*\(([^)]*)\)"

RULES = [
    Rule("runtime.threadpool_semantic_change", "high", "runtime", "absolute", "any", (r"new\s+ThreadPoolExecutor\s*\(\s*0\s*,\s*Integer\.MAX_VALUE", r"new\s+SynchronousQueue")),
    Rule("runtime.concurrency_regression", "high", "runtime", "regression", "downgrade"),
    Rule("runtime.thread_safety_removal", "high", "runtime", "regression", "fewer", tags=((r"\s.*synchronized", "synchronized_removed"), (r"\s.*volatile", "volatile_removed"), (r"\s.*\.(?:lock|unlock|tryLock)\(.*\)", "explicit_lock_removed"))),
    Rule("runtime.latch_misuse", "high", "runtime", "regression", "fewer", tags=((r"\s.*\.countDown\(\)", "latch_countdown_removed"),)),
    Rule("resource.closeable_leak", "high", "runtime", "absolute", "without", (rf"^\+.*\b(?:new\s+\w+(?:{CLOSEABLE})\s*\()",), (rf"^\+.*try\s*\([^)]*(?:{CLOSEABLE})", r"^\+.*\.close\(\)")),
    Rule("resource.database_connection_leak", "critical", "runtime", "absolute", "without", (r"^\+.*(?:DriverManager\.getConnection|DataSource\.getConnection|new\s+HikariDataSource|new\s+BasicDataSource)",), (r"^\+.*(?:connection|conn)\.close\(\)",), flags_b="i"),
    Rule("resource.stream_encoding_missing", "medium", "maintenance", "absolute", "any", (r"^\+.*(?:new\s+InputStreamReader\s*\(\s*(?!.*Charset|charset|StandardCharsets)|new\s+OutputStreamWriter\s*\(\s*(?!.*Charset|charset|StandardCharsets)|new\s+FileReader\s*\(|new\s+FileWriter\s*\()",), re2={"skip": True}),
    Rule("resource.stream_chaining_leak", "high", "runtime", "absolute", "any", (r"^\+.*new\s+\w+(?:InputStream|OutputStream|Reader|Writer)\s*\([^)]*\.get\s*\w*\s*\(\s*\)",)),
    Rule("resource.executor_shutdown_missing", "high", "runtime", "absolute", "without", (r"^\+.*(?:Executors\.(?:newFixedThreadPool|newCachedThreadPool|newSingleThreadExecutor)|new\s+ThreadPoolExecutor)\s*\(",), (r"^\+.*\.shutdown\s*\(\s*\)",)),
    Rule("exception.swallowed", "high", "maintenance", "absolute", "added_text", (r"catch\s*\([^)]+\)\s*{\s*}", r"catch\s*\([^)]+\)\s*{\s*//.*\s*}")),
    Rule("exception.too_generic", "low", "maintenance", "absolute", "line_path", (r"catch\s*\(\s*(?:Exception|Throwable|RuntimeException)\s+\w+\s*\)",), paths=CRITICAL_PATHS, flags_a="i"),
    Rule("exception.runtime_throw", "low", "maintenance", "absolute", "any", (r"^\+.*throw\s+new\s+(?:RuntimeException|IllegalStateException|NullPointerException|IllegalArgumentException|IndexOutOfBoundsException)\s*\(",)),
    Rule("exception.throws_removed", "medium", "runtime", "regression", "any", (r"^-.*throws\s+\w+",), flags_a="m"),
    Rule("exception.finally_missing", "medium", "runtime", "absolute", "following", (r"^\+.*(?:\.open\s*\(|\.create\s*\(|\.connect\s*\(|\.acquire\s*\(|\.lock\s*\()",), (r"finally\s*{",), flags_b="i"),
    Rule("exception.not_logged", "low", "maintenance", "absolute", "catch_path", (r"catch\s*\([^)]+\)\s*{\s*(?:logger|log|LOG)\.(?:error|warn|debug|info)\s*\(",), paths=CRITICAL_PATHS, flags_a="i"),
    Rule("null.return_ignored", "low", "runtime", "absolute", "line", (r"^\+.*(?:\.get\s*\([^)]+\))",), (r"(?:if\s*\([^)]*(?:==|!=|isNull|nonNull|Objects\.|Optional)|Optional\.|orElse|orElseGet)",), flags_b="i"),
    Rule("null.optional_unsafe_get", "low", "runtime", "absolute", "optional_get", (r"\.get\s*\(\s*\)", r"^\+.*(?<!\.)\.get\s*\(\s*\)"), (r"\.orElse(?:Get)?\s*\(", r"\.orElse(?:Get)?\s*\("), flags_a="m", re2={"skip": True}),
    Rule("null.autoboxing_npe", "high", "runtime", "absolute", "autobox", (rf"^\+.*(?:{WRAPPERS})\s*\w+\s*=\s*(?!new\s+(?:{WRAPPERS}))", r"^\+.*\.(?:get|getValue|getOrDefault)\s*\([^)]*\)\s*(?:[+\-*/]|compareTo)"), re2={"skip": True}),
    Rule("null.chained_call_unsafe", "low", "runtime", "absolute", "line_path", (r"^\+.*\w+\s*\.\s*\w+\s*\([^)]*\)\s*\.\s*\w+\s*\(",), (r"(?:Objects\.(?:requireNonNull|firstNonNull)|Optional\.ofNullable|\.map\s*\(|\?\.)",), paths=DATA_PATHS, flags_b="i"),
    Rule("null.array_index_unsafe", "medium", "runtime", "absolute", "any", (r"^\+.*\w+\s*\[\s*\w+\.(?:size|length)\s*[-+]\s*[1-9]",), flags_a="m"),
    Rule("null.string_concat_unsafe", "low", "maintenance", "absolute", "never"),
    Rule("collection.raw_type", "medium", "maintenance", "absolute", "raw_type", (rf"^\+.*(?:{COLLECTIONS})\s+\w+\s*=\s*new\s+(?:{COLLECTIONS})\s*<\s*>",), (r"<\s*\w+",)),
    Rule("collection.mutable_return", "medium", "maintenance", "absolute", "line", (r"^\+.*return\s+(?:this\.|m_)?(?:list|map|set|collection)\w*\s*;",), (r"Collections\.(?:unmodifiable|singleton)|List\.of|Map\.of|Set\.of|Collections\.empty",), flags_a="i", flags_b="i"),
    Rule("collection.concurrent_modification", "high", "runtime", "absolute", "foreach_remove", (r"for\s*\(\s*\w+\s+\w+\s*:\s*\w+\s*\)",), (r"\.remove\s*\(", r"\w+Iterator\.remove\s*\(\)")),
    Rule("collection.map_compute_opportunity", "low", "maintenance", "absolute", "all", (r"if\s*\(\s*!?map\.containsKey\s*\([^)]+\)\s*\)", r"\.put\s*\([^)]+\)")),
    Rule("collection.stream_collector_unsafe", "medium", "runtime", "absolute", "line", (r"\.collect\s*\(\s*Collectors\.toMap\s*\([^,]+,[^)]+\)\s*\)",)),
    Rule("collection.legacy_factory", "low", "maintenance", "absolute", "without", (r"^\+.*Collections\.(?:singletonList|singletonSet|singletonMap|emptyList|emptySet|emptyMap)\s*\(",), (r"(?:List|Set|Map|Collection)\.of\s*\(",), flags_a="m"),
    Rule("collection.aslist_modify", "high", "runtime", "absolute", "aslist_modify", (r"(\w+)\s*=\s*Arrays\.asList",), (r"\.(?:add|remove|clear)\s*\(",)),
    Rule("api.public_method_removed", "critical", "runtime", "regression", "without", (r"^-\s*(?:public|protected)\s+(?!.*test)(?!.*Test)\s*(?:static\s+)?(?:\w+(?:<[^>]+>)?\s+)?\w+\s*\([^)]*\)",), (r"^\+.*@Deprecated",), flags_a="m", flags_b="m", re2={"skip": True}),
    Rule("api.method_signature_changed", "high", "runtime", "regression", "signature", (METHOD,)),
    Rule("api.public_field_removed", "high", "runtime", "regression", "any", (r"^-\s*(?:public|protected)\s+(?!.*\bfinal\b)(?!.*\bstatic\b).*\s+\w+\s+\w+\s*;",), flags_a="m", re2={"skip": True}),
    Rule("api.constructor_removed", "high", "runtime", "regression", "any", (r"^-\s*(?:public|protected)\s+\w+\s*\([^)]*\)",), flags_a="m"),
    Rule("api.interface_changed", "medium", "runtime", "regression", "interface", (r"^\s*(?:public\s+)?(?:abstract\s+)?[\w<>,\s]+\s+\w+\s*\([^)]*\)\s*(?:;|default|{)?",), flags_a="m"),
    Rule("api.important_annotation_removed", "medium", "runtime", "regression", "any", (r"^-\s*@(?:Override|Deprecated|Nullable|Nonnull|NotNull|Transactional|Cacheable|Async|Scheduled)",), flags_a="m"),
    Rule("api.deprecated_added", "low", "maintenance", "absolute", "any", (r"^\+\s*@Deprecated(?:\([^)]*\))?",), flags_a="m"),
    Rule("api.serialversionuid_changed", "high", "runtime", "regression", "any", (r"^[-+].*serialVersionUID\s*=",), flags_a="m"),
]

# How resources open and close, null checks, calls that may give null and empty handlers, by language.
CROSS = {
    "python": (r"(?:open\s*\(|socket\.socket\(|connect\s*\()", r"(?:\.close\(\)|with\s+)", r"(?:if\s+\w+\s+(?:is|is\s+not|==|!=)\s+None)", (r"\.get\s*\(", r"\.pop\s*\(", r"\[.*\]"), r"(?:except\s+.*:\s*\n\s*pass)"),
    "javascript": (r"(?:fs\.open\(|fs\.createReadStream\(|new\s+Client\(\)\.connect\()", r"(?:\.close\(\)|\.end\(\)|\.destroy\(\))", r"(?:if\s*\(\s*\w+\s*(?:===|!==|==|!=)\s*(?:null|undefined)|if\s*\(\s*!\w+)", (r"\.get\s*\(", r"\.find\s*\(", r"\.findFirst\s*\(", r"\[.*\]"), r"(?:catch\s*\([^)]*\)\s*\{\s*\})"),
    "cpp": (r"(?:new\s+\w+|fopen\s*\(|ifstream\s*\()", r"(?:delete\s+|fclose\s*\(|close\s*\()", r"(?:if\s*\(\s*\w+\s*(?:==|!=)\s*nullptr|if\s*\(\s*!\w+)", (r"->\w+", r"\.at\s*\(", r"\[\s*\w+\s*\]"), r"(?:catch\s*\([^)]*\)\s*\{\s*\})"),
    "c": (r"(?:malloc\s*\(|fopen\s*\(|calloc\s*\()", r"(?:free\s*\(|fclose\s*\(|close\s*\()", r"(?:if\s*\(\s*\w+\s*(?:==|!=)\s*NULL|if\s*\(\s*!\w+)", (r"->\w+", r"\[\s*\w+\s*\]"), r"(?:if\s*\([^)]*error[^)]*\)\s*\{\s*\})"),
    "java": (r"(?:new\s+\w+(?:InputStream|OutputStream|Reader|Writer|Connection)\s*\()", r"(?:\.close\(\)|try\s*\([^)]*\.close)", r"(?:if\s*\([^)]*(?:==|!=)\s*null|Objects\.(?:nonNull|isNull)|Optional)", (r"\.get\s*\(", r"\.findFirst\s*\(", r"\.readLine\s*\("), r"(?:catch\s*\([^)]+\)\s*{\s*})"),
    "go": (r"(?:os\.Open|os\.Create|net\.Dial|sql\.Open|os\.Pipe)\s*\(", r"(?:\.Close\(\)|defer\s+.*\.Close)", r"(?:if\s+\w+\s*(?:==|!=)\s*nil|if\s+err\s*(?:!=|==)\s*nil)", (r"\.Read\s*\(", r"\.Next\s*\(", r"map\[.*\]"), r"(?:if\s+err\s*(?:!=|==)\s*nil\s*{\s*})"),
    "typescript": (r"(?:fs\.open\(|fs\.createReadStream\(|new\s+Client\(\)\.connect\()", r"(?:\.close\(\)|\.end\(\)|\.destroy\(\))", r"(?:if\s*\(\s*\w+\s*(?:===|!==|==|!=)\s*(?:null|undefined)|if\s*\(\s*!\w+)", (r"\.get\s*\(", r"\.find\s*\(", r"\[.*\]"), r"(?:catch\s*\([^)]*\)\s*\{\s*\})"),
}

#: Languages whose generic rules the catalogue loads.
LOADED_LANGUAGES = ("python", "javascript", "cpp", "c")


def cross_rules(language: str) -> list[Rule]:
    """Resource leak, null safety and swallowed exception for one language."""
    opened, closed, check, calls, empty = CROSS[language]
    on = language in LOADED_LANGUAGES
    return [
        Rule(f"prorule.{language}.resource_leak", "high", "runtime", "absolute", "without", (opened,), (closed,), language=language, loaded=on),
        Rule(f"prorule.{language}.null_safety", "high", "runtime", "absolute", "context", (r"^\+.*(?:" + "|".join(calls) + ")",), (check,), language=language, loaded=on),
        Rule(f"prorule.{language}.exception_swallowed", "high", "maintenance", "absolute", "added_text", (empty,), language=language, loaded=on),
    ]


# Go rules kept as an optional set; the catalogue has pattern rules in their place.
GO_RULES = [
    Rule("resource.goroutine_leak", "high", "runtime", "absolute", "without", (r"^\+.*\bgo\s+\w+\.?\w*\s*\(",), (r"(?:context\.Context|ctx|done\s*chan)", r"\bselect\s*{", r"\bdefer\s+"), flags_a="m", language="go", loaded=False),
    Rule("resource.channel_leak", "high", "runtime", "absolute", "without", (r"^\+.*(?:make\s*\(\s*chan|chan\s+\w+\s*=)",), (r"\bclose\s*\(",), language="go", loaded=False),
    Rule("resource.defer_misuse", "medium", "runtime", "absolute", "any", (r"(?:for\s+|range\s+)\s*{[^}]*defer\s+", r"defer\s+\w+\s*\(\s*\w+\s*[+\-*/]"), language="go", loaded=False),
    Rule("security.unsafe_usage", "high", "security", "absolute", "any", (r"^\+.*\bunsafe\.(?:Pointer|Sizeof|Alignof|Offsetof)\s*\(",), language="go", loaded=False),
    Rule("exception.error_ignored", "medium", "maintenance", "absolute", "line", (r"_\s*=\s*\w+\s*\([^)]*\)",), (r"if\s+err\s*(?:!=|==)\s*nil",), language="go", loaded=False),
    Rule("null.nil_dereference", "high", "runtime", "absolute", "context", (r"^\+.*\w+\s*\.\s*\w+\s*\(",), (r"(?:if\s+\w+\s*==\s*nil|if\s+\w+\s*!=\s*nil|\w+\s*==\s*nil\s*\?|nil\s*check)",), language="go", loaded=False),
    Rule("runtime.race_condition", "high", "runtime", "absolute", "without", (r"^\+.*(?:var\s+\w+\s+|:=\s*\w+\s*=).*(?:map|slice|chan)",), (r"(?:sync\.(?:Mutex|RWMutex)|\.Lock\(\)|\.Unlock\(\))", r"atomic\.(?:Load|Store|Add|Swap|CompareAndSwap)"), language="go", loaded=False),
    Rule("security.http_vulnerability", "high", "security", "absolute", "any", (r"http\.(?:Get|Post)\s*\([^)]*\+[^)]*\)", r"http\.ListenAndServe\s*\(\s*\"[^\"]*\""), language="go", loaded=False),
]

ALL = RULES + [r for lang in LOADED_LANGUAGES for r in cross_rules(lang)]


def catalogue() -> list[dict]:
    return [{"rule_id": r.rule_id, "severity": r.severity, "impact": r.impact, "rule_type": r.rule_type, "language": r.language, "blocking": "false"} for r in ALL]


class Spark:
    """Columns of a diff."""

    def __init__(self, raw: Column, files: Column, signals: Column | None = None, semantics: str = "compat", lines: Column | None = None, added: Column | None = None) -> None:
        self.raw, self.files, self.signals, self.semantics = raw, files, signals, semantics
        self.lines = F.split(raw, "\n", -1) if lines is None else lines
        self.added = F.filter(self.lines, lambda x: x.startswith("+")) if added is None else added
        self.first = F.coalesce(F.get(files, F.lit(0)), F.lit("unknown"))

    def pattern(self, p: str, flags: str = "") -> str:
        if self.semantics == "intended" and "^" in p and "m" not in flags:
            flags += "m"
        return (f"(?{flags})" if flags else "") + "(?d)" + java_regex(p)

    def has(self, text: Column, ps: tuple[str, ...], flags: str = "") -> Column:
        out = F.lit(False)
        for p in ps:
            out = out | text.rlike(self.pattern(p, flags))
        return out


#: Strategies without a match unless one of the patterns a matches a line or the text.
ANY_OF_A = ("any", "all", "without", "added_text", "line", "line_path", "following", "context", "raw_type", "optional_get", "autobox", "interface", "foreach_remove", "aslist_modify")


def literals(rule: Rule) -> list[str]:
    """Texts in lower case of which a diff that the rule matches holds one at least; empty if it needs none."""
    if rule.strategy not in ANY_OF_A:
        return []
    found = [required_literals(p) for p in rule.a]
    # texts of single lines are looked for in the whole text, so one over a break of lines tells nothing
    return sorted({x for xs in found for x in xs}) if all(found) and not any("\n" in x for xs in found for x in xs) else []


def column(rule: Rule, c: Spark) -> Column:
    """The reported file of a rule, null without a match."""
    s, a, b = rule.strategy, rule.a, rule.b
    of = lambda cond: F.when(cond, c.first)
    if s == "any":
        return of(c.has(c.raw, a, rule.flags_a))
    if s == "all":
        cond = F.lit(True)
        for p in a:
            cond = cond & c.has(c.raw, (p,), rule.flags_a)
        return of(cond)
    if s == "without":
        return of(c.has(c.raw, a, rule.flags_a) & ~c.has(c.raw, b, rule.flags_b))
    if s == "never":
        return F.lit(None).cast("string")
    if s == "added_text":
        return of(c.has(F.array_join(c.added, "\n"), a, rule.flags_a))
    if s == "line":
        return of(F.exists(c.added, lambda x: c.has(x, a, rule.flags_a) & ~c.has(x, b, rule.flags_b)))
    if s in ("line_path", "catch_path"):
        at = F.get(F.filter(c.files, lambda f: c.has(f, rule.paths, "i")), F.lit(0))
        if s == "line_path":
            hit = F.exists(c.added, lambda x: c.has(x, a, rule.flags_a) & ~c.has(x, b, rule.flags_b))
        else:
            hit = F.exists(c.added, lambda x: x.contains("catch") & x.contains("(") & x.contains(")") & ~x.contains("throw") & ~x.contains("return") & ~c.has(x, a, rule.flags_a))
        return F.when(hit, at)
    if s == "fewer":
        out = None
        for p, tag in rule.tags:
            gone, new = (F.regexp_count(c.raw, F.lit(c.pattern(f"^{sign}{p}", "m"))) for sign in ("-", r"\+"))
            out = F.when(gone > new, tag) if out is None else out.when(gone > new, tag)
        return out
    if s == "downgrade":
        out = F.lit(None).cast("string")
        if c.signals is not None:
            out = F.get(F.filter(c.signals, lambda x: x.signal_id == "runtime.concurrency.thread_safety_downgrade"), F.lit(0)).file
        pairs = None
        for strong, weak, prefix in DOWNGRADES:
            cond = c.raw.rlike(c.pattern(f"^-.*{strong}", "m")) & c.raw.rlike(c.pattern(r"^\+.*" + (f"(?<!{prefix})" if prefix else "") + weak, "m"))
            tag = f"regression_{strong}_to_{weak}"
            pairs = F.when(cond, tag) if pairs is None else pairs.when(cond, tag)
        return F.coalesce(out, pairs)
    if s == "following":
        # what follows the last hit is part of what follows any other, so that one decides
        last = F.array_max(F.transform(c.lines, lambda x, i: F.when(c.has(x, a), i)))
        return of(c.has(c.raw, a, "m") & F.coalesce(~c.has(F.array_join(F.slice(c.lines, last + 1, F.size(c.lines)), "\n"), b, rule.flags_b), F.lit(False)))
    if s == "context":
        edge = F.array_repeat(F.lit(None).cast("string"), 3)
        padded = F.concat(edge, c.lines, edge)
        near = F.arrays_zip(*[F.slice(padded, F.lit(k + 1), F.size(c.lines)).alias(f"l{k}") for k in range(7)])
        hit = F.exists(near, lambda x: c.has(x["l3"], a) & ~c.has(F.concat_ws("\n", *[x[f"l{k}"] for k in range(7)]), b))
        return of(c.has(c.raw, a, "m") & hit)
    if s == "raw_type":
        return of(F.exists(c.added, lambda x: c.has(x, a) & ~c.has(F.when(x.contains("="), F.get(F.split(x, "=", -1), F.lit(1))).otherwise(x), b)))
    if s == "optional_get":
        plain = F.exists(c.lines, lambda x: c.has(x, a[:1]) & ~c.has(x, b[:1]) & ~x.contains("//") & ~x.contains("/*"))
        return of(plain | (c.has(c.raw, a[1:], "m") & ~c.has(c.raw, b[1:])))
    if s == "autobox":
        return of(c.has(c.raw, a[:1]) | c.has(c.raw, a[1:], "m"))
    if s == "interface":
        return of(F.lower(c.raw).contains("interface ") & c.has(c.raw, a, "m") | F.lower(c.raw).contains("@interface") & c.has(c.raw, a, "m"))
    if s == "foreach_remove":
        # state: 0 outside, 1 in a loop, 2 found
        step = lambda st, x: F.when((st == 2) | ~x.startswith("+"), st).when(c.has(x, a), 1).when((st == 1) & c.has(x, b[:1]) & ~c.has(x, b[1:]), 2).when((st == 1) & F.trim(x).startswith("}"), 0).otherwise(st)
        return of(c.has(c.raw, a) & (F.aggregate(c.lines, F.lit(0), step) == 2))
    if s == "aslist_modify":
        grab = lambda x: F.regexp_extract(x, c.pattern(a[0]), 1)
        start = F.struct(F.lit("").alias("var"), F.lit(False).alias("hit"))
        step = lambda st, x: F.struct(F.when(grab(x) != "", grab(x)).otherwise(st["var"]).alias("var"), (st["hit"] | ((grab(x) == "") & (st["var"] != "") & c.has(x, b) & x.contains(st["var"]))).alias("hit"))
        return of(c.has(c.raw, a) & F.aggregate(c.added, start, step)["hit"])
    if s == "signature":
        names = lambda sign, g: F.regexp_extract_all(c.raw, F.lit(c.pattern(f"^{sign}{a[0]}", "m")), F.lit(g))
        both = lambda sign: F.arrays_zip(names(sign, 1).alias("n"), names(sign, 2).alias("p"))
        # a name of both sides with more than one list of parameters: equal names are neighbours once sorted
        pairs = F.array_sort(F.array_distinct(F.concat(both("-"), both(r"\+"))))
        next_ones = F.arrays_zip(F.slice(pairs, F.lit(1), F.greatest(F.size(pairs) - 1, F.lit(0))).alias("x"), F.slice(pairs, F.lit(2), F.greatest(F.size(pairs) - 1, F.lit(0))).alias("y"))
        several = F.transform(F.filter(next_ones, lambda z: z["x"]["n"] == z["y"]["n"]), lambda z: z["x"]["n"])
        return of(F.arrays_overlap(several, F.array_intersect(names("-", 1), names(r"\+", 1))))
    raise ValueError(s)


def duck(rule: Rule) -> str | None:
    """The same as a DuckDB expression over raw_diff and files, or None where its regex engine lacks what the patterns need."""
    if rule.re2.get("skip"):
        return None
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    esc = lambda p: java_regex(p)
    m = lambda x, ps, flags="": "(" + " OR ".join(f"regexp_matches({x}, {quote((f'(?{flags})' if flags else '') + esc(p))})" for p in ps) + ")" if ps else "false"
    s, a, b = rule.strategy, rule.a, rule.b
    first = "coalesce(files[1], 'unknown')"
    lines = "string_split(raw_diff, chr(10))"
    added = f"list_filter({lines}, lambda x: starts_with(x, '+'))"
    of = lambda cond: f"CASE WHEN {cond} THEN {first} END"
    some = lambda arr, cond: f"len(list_filter({arr}, lambda x: {cond})) > 0"
    if s == "any":
        return of(m("raw_diff", a, rule.flags_a))
    if s == "all":
        return of(" AND ".join(m("raw_diff", (p,)) for p in a))
    if s == "without":
        return of(f"{m('raw_diff', a, rule.flags_a)} AND NOT {m('raw_diff', b, rule.flags_b)}")
    if s == "never":
        return "CAST(NULL AS VARCHAR)"
    if s == "added_text":
        return of(m(f"array_to_string({added}, chr(10))", a))
    if s == "line":
        return of(some(added, f"{m('x', a, rule.flags_a)} AND NOT {m('x', b, rule.flags_b)}"))
    if s in ("line_path", "catch_path"):
        at = f"list_filter(files, lambda f: {m('f', rule.paths, 'i')})[1]"
        cond = f"{m('x', a, rule.flags_a)} AND NOT {m('x', b, rule.flags_b)}" if s == "line_path" else f"contains(x, 'catch') AND contains(x, '(') AND contains(x, ')') AND NOT contains(x, 'throw') AND NOT contains(x, 'return') AND NOT {m('x', a, rule.flags_a)}"
        return f"CASE WHEN {some(added, cond)} THEN {at} END"
    if s == "fewer":
        n = lambda p: f"len(regexp_extract_all(raw_diff, {quote('(?m)' + esc(p))}))"
        return "CASE " + " ".join(f"WHEN {n('^-' + p)} > {n('^[+]' + p)} THEN '{tag}'" for p, tag in rule.tags) + " END"
    if s == "downgrade":
        out = []
        for strong, weak, prefix in DOWNGRADES:
            text = f"replace(raw_diff, '{prefix}{weak}', '')" if prefix else "raw_diff"
            out.append(f"WHEN {m('raw_diff', (f'^-.*{strong}',), 'm')} AND {m(text, (f'^[+].*{weak}',), 'm')} THEN 'regression_{strong}_to_{weak}'")
        return "CASE " + " ".join(out) + " END"
    if s == "following":
        rest = f"array_to_string(({lines})[i:], chr(10))"
        return of(f"len(list_filter(range(1, len({lines}) + 1), lambda i: {m(f'({lines})[i]', a)} AND NOT {m(rest, b, rule.flags_b)})) > 0")
    if s == "context":
        near = f"array_to_string(({lines})[greatest(i - 3, 1):i + 3], chr(10))"
        return of(f"len(list_filter(range(1, len({lines}) + 1), lambda i: {m(f'({lines})[i]', a)} AND NOT {m(near, b)})) > 0")
    if s == "raw_type":
        return of(some(added, f"{m('x', a)} AND NOT {m('''CASE WHEN contains(x, '=') THEN string_split(x, '=')[2] ELSE x END''', b)}"))
    if s == "interface":
        return of(f"(contains(lower(raw_diff), 'interface ') OR contains(lower(raw_diff), '@interface')) AND {m('raw_diff', a, 'm')}")
    if s == "foreach_remove":
        # an added line never starts with a closing brace, so a loop stays open: a removal with a loop line before it
        at = f"({added})[i]"
        return of(f"len(list_filter(range(1, len({added}) + 1), lambda i: {m(at, b[:1])} AND NOT {m(at, b[1:])} AND NOT {m(at, a)} AND {m(f'array_to_string(({added})[1:i - 1], chr(10))', a)})) > 0")
    if s == "signature":
        g = lambda sign, k: f"regexp_extract_all(raw_diff, {quote('(?m)^' + sign + esc(a[0]))}, {k})"
        return of(f"len(list_filter(list_zip({g('-', 1)}, {g('-', 2)}), lambda x: len(list_filter(list_zip({g('[+]', 1)}, {g('[+]', 2)}), lambda y: x[1] = y[1] AND x[2] <> y[2])) > 0)) > 0")
    return None
