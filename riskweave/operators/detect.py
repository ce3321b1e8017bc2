"""Semantic changes and signals of diffs, line by line and without Python workers.

Each added or removed line of an analyzable patch is turned into tokens by one pattern; token and call predicates give changes
(kind, symbol, meta). Types of variables on the two sides of a patch meet in one join. What needs more than a line, contexts of joined SQL and types of
variables at a call, is found in the token streams of operators.snippets; other constructs that span lines are seen line by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.operators import parse, snippets
from riskweave.sources import tables

# Analyzable extensions and the words of the predicates.
ANALYZABLE = (".java", ".py", ".cpp", ".cc", ".cxx", ".c", ".h", ".hpp", ".js", ".jsx", ".ts", ".tsx")
PAGINATION = ["pageNo", "pageSize", "start", "limit", "offset"]
CRITICAL_CALLS = ["encode", "decode", "validate", "check", "normalize", "sanitize"]
SECRET_WORDS = ["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "accesskey", "private_key", "privatekey", "credential"]
WEAK_CRYPTO = ["DES", "RC4", "MD5", "SHA1", "MessageDigest", "setAlgorithm"]
COMMANDS = ["exec", "runtime", "processbuilder", "ProcessBuilder", "getRuntime", "system"]
UNSAFE_COLLECTIONS = ["HashMap", "ArrayList", "HashSet", "TreeMap", "LinkedList"]
THREAD_SAFE = [
    "ConcurrentHashMap", "AtomicInteger", "AtomicLong", "AtomicBoolean", "LongAdder", "DoubleAdder", "BlockingQueue", "ArrayBlockingQueue", "LinkedBlockingQueue", "PriorityBlockingQueue", "DelayQueue",
    "SynchronousQueue", "LinkedTransferQueue", "LinkedBlockingDeque", "CopyOnWriteArrayList", "CopyOnWriteArraySet", "ConcurrentLinkedQueue", "ConcurrentLinkedDeque", "ConcurrentSkipListMap", "ConcurrentSkipListSet",
    "ReentrantLock", "ReentrantReadWriteLock", "StampedLock", "Semaphore", "CountDownLatch", "CyclicBarrier", "Exchanger", "Phaser", "StringBuffer", "Hashtable", "Vector",
]
EVICTIONS = ["expire", "setExpire", "setTTL", "evict", "clear"]

IGNORE = "riskweave-ignore"
TOKEN = "\"[^\"\\\\]*(?:\\\\.[^\"\\\\]*)*\"|'[^'\\\\]*(?:\\\\.[^'\\\\]*)*'|[A-Za-z_$][A-Za-z0-9_$]*|[0-9][0-9A-Za-z_.]*|\\+\\+|--|[+*/%&|^!=<>-]=|&&|\\|\\||->|::|[^\\sA-Za-z0-9_$]"


def side_lines(diffs: DataFrame, ignores: bool = False) -> DataFrame:
    """(diff_id, grp, file, side, n, text): added and removed lines of analyzable patches, numbered within their side; with the ignores of inline_ignores if asked for.

    One projection and one explode: a side is an array, numbers are places in it, and a line's neighbour is the element before."""
    patches = F.filter("patches", lambda g: F.lower(F.regexp_extract(g["file"], "(\\.[^./]*)$", 1)).isin(*ANALYZABLE))

    def side(name: str, sign: str, lines: Column) -> Column:
        mine = F.filter(lines, lambda x: x.startswith(sign) & ~x.startswith(sign * 3))
        rows = F.transform(mine, lambda x, i: F.struct(F.lit(name).alias("side"), (i + 1).alias("n"), F.trim(F.substr(x, F.lit(2))).alias("text")))
        if not ignores:
            return rows
        own = lambda x: F.when(x["text"].contains(IGNORE), _ignored(x["text"]))
        both = F.transform(F.array(rows), lambda xs: F.transform(xs, lambda x, i: F.struct(x["side"].alias("side"), x["n"].alias("n"), x["text"].alias("text"), F.array_compact(F.array(own(x), own(F.get(xs, i - 1)))).alias("ignores"))))
        return F.get(both, F.lit(0))

    names = ["side", "n", "text", *["ignores"] * ignores]
    of = lambda g: F.transform(F.concat(side("added", "+", g["lines"]), side("removed", "-", g["lines"])), lambda x: F.struct(g["grp"].alias("grp"), g["file"].alias("file"), *[x[c].alias(c) for c in names]))
    # an inner explode would have the array made twice, once to see whether it is empty
    rows = parse.patch_arrays(diffs).select("diff_id", F.explode_outer(F.flatten(F.transform(patches, of))).alias("x"))
    return rows.where("x is not null").select("diff_id", *[f"x.{c}" for c in ["grp", "file", *names]])


def _ignored(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, f"//\\s*{IGNORE}:\\s*([\\w.*-]+)", 1), F.lit(""))


def inline_ignores(lines: DataFrame) -> DataFrame:
    """lines with ignores: the ids that a comment on the same or the previous line of the side names."""
    own = _ignored(F.col("text"))
    w = Window.partitionBy("diff_id", "grp", "side").orderBy("n")
    return lines.withColumn("own", own).withColumn("ignores", F.array_compact(F.array("own", F.lag("own").over(w)))).drop("own")


def tokens(text: Column) -> Column:
    """Tokens of a line without its comments."""
    return F.regexp_extract_all(F.regexp_replace(text, "//[^\\n]*|/\\*.*?\\*/", " "), F.lit(TOKEN), F.lit(0))


def ngrams(t: Column, n: int) -> Column:
    """n-token windows, joined by spaces."""
    return F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def tokenised(lines: DataFrame) -> DataFrame:
    """lines with t (tokens), g2 and g3 (pairs and triples), each worked out once."""
    return lines.withColumn("t", tokens(F.col("text"))).withColumn("g2", ngrams(F.col("t"), 2)).withColumn("g3", ngrams(F.col("t"), 3))


def token_changes(side: Column, text: Column, t: Column, g2: Column, g3: Column) -> Column:
    """Array of (kind, symbol, meta) of one line: every predicate is an array filter over the line's tokens."""
    added = side == "added"
    pm = lambda name: F.when(added, f"{name}_ADDED").otherwise(f"{name}_REMOVED")
    one = lambda kind, symbol, meta="": F.struct((kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"), (symbol if isinstance(symbol, Column) else F.lit(symbol)).alias("symbol"), (meta if isinstance(meta, Column) else F.lit(meta)).alias("meta"))
    none = F.array().cast("array<struct<kind:string,symbol:string,meta:string>>")
    when = lambda cond, *xs: F.when(F.coalesce(cond, F.lit(False)), F.array(*xs)).otherwise(none)
    call = lambda name: F.array_contains(g2, f"{name} (")
    has = lambda w: F.array_contains(t, w)
    each = lambda words, make: F.transform(F.filter(F.array_distinct(t), lambda x: x.isin(*words)), make)
    secret = F.filter(t, lambda x: (F.length(x) > 3) & F.lower(x).rlike("|".join(SECRET_WORDS)) & x.rlike("[=:]"))
    evict = F.exists(F.array(*map(F.lit, EVICTIONS)), lambda w: F.array_contains(g2, F.concat(w, F.lit(" ("))))
    pool = text.rlike("\\bnew\\s+ThreadPoolExecutor\\s*\\(")
    return F.flatten(F.array(
        when(has("synchronized"), one(pm("MODIFIER"), "synchronized")),
        when(has("volatile"), one(pm("MODIFIER"), "volatile")),
        when(~added & has("final"), one("MODIFIER_REMOVED", "final")),
        when(~added & has("ConcurrentHashMap"), one("UNKNOWN", "ConcurrentHashMap", "action=removed")),
        each(PAGINATION, lambda x: one("UNKNOWN", x, "action=changed")),
        when(F.array_contains(g3, ". lock (") | text.rlike("^\\s*lock\\s*\\("), one(pm("CALL"), "lock")),
        when(F.array_contains(g3, "Thread . sleep"), one(pm("CALL"), "sleep")),
        F.transform(F.filter(F.array(*map(F.lit, CRITICAL_CALLS)), lambda w: F.array_contains(g2, F.concat(w, F.lit(" (")))), lambda w: one(pm("CALL"), w)),
        F.transform(F.slice(secret, 1, 1), lambda x: one(pm("LITERAL"), "hardcoded_secret", F.concat(F.lit("value_hint="), F.substring(x, 1, 20)))),
        F.transform(F.slice(F.filter(t, lambda x: F.regexp_replace(x, "\"", "").isin(*WEAK_CRYPTO)), 1, 1), lambda x: one(pm("CALL"), "weak_crypto")),
        F.transform(F.slice(F.filter(F.array(*map(F.lit, COMMANDS)), lambda w: F.array_contains(g2, F.concat(w, F.lit(" (")))), 1, 1), lambda w: one(pm("CALL"), "command_execution")),
        when(added & text.rlike("\\bstatic\\b.*\\b(?:" + "|".join(UNSAFE_COLLECTIONS) + ")\\b\\s*(?:<[^;=]*>)?\\s+\\w+\\s*[=;]"), one("FIELD_ADDED", "static_collection", "static_unsafe=true")),
        when(added & pool, one("OBJECT_CREATION", "ThreadPoolExecutor", "param_change=true")),
        when(~added & pool, one("", "old pool")),
        when(added & text.rlike("\\bnew\\s+LinkedBlockingQueue\\s*(?:<[^>]*>)?\\s*\\(\\s*(?:Integer\\.MAX_VALUE)?\\s*\\)"), one("OBJECT_CREATION", "LinkedBlockingQueue", "unbounded=true")),
        when(added & text.rlike("\\bwhile\\s*\\(\\s*true\\s*\\)"), one("CALL_ADDED", "while_true")),
        when(~added & text.rlike("\\btry\\s*\\("), one("CALL_REMOVED", "try_with_resources")),
        when(~added & evict & text.rlike("(?i)cache|redis|map"), one("CALL_REMOVED", "cache", "cache_eviction=true")),
        when(~added & text.rlike("(?i)\\w*timeout\\w*\\s*\\("), one("CALL_REMOVED", "timeout", "timeout_removed=true")),
        when(~added & call("equals"), one("CALL_REMOVED", "equals")),
        when(added & has("=="), one("UNKNOWN", "==")),
        when(~added & text.rlike("\\bif\\s*\\(\\s*(?:\\w+\\s*==\\s*null|null\\s*==\\s*\\w+)\\s*\\)"), one("UNKNOWN", "null_check", "action=removed")),
        F.transform(F.filter(F.array(F.lit("newFixedThreadPool"), F.lit("newCachedThreadPool")), lambda w: added & F.array_contains(g2, F.concat(w, F.lit(" (")))), lambda w: one("CALL_ADDED", w)),
        when(added & text.rlike("\\.get\\s*\\(\\s*\\)"), one("CALL_ADDED", "get", "blocking_get=true")),
        *[when(call(name), one(pm("CALL"), name)) for name in ("acquire", "await")],
    ))


#: Every change needs one of these in its line; lines without them, which are most, aren't turned into tokens.
HINTS = "(?i)" + "|".join(sorted({w.lower().replace("_", "[_]") for w in [
    *PAGINATION, *CRITICAL_CALLS, *SECRET_WORDS, *WEAK_CRYPTO, *COMMANDS, *EVICTIONS, "synchronized", "volatile", "final", "ConcurrentHashMap", "lock", "sleep", "static", "ThreadPool", "LinkedBlockingQueue", "while", "try",
    "timeout", "equals", "null", "get", "acquire", "await"]})) + "|=="
TYPED = "\\b([A-Z]\\w*)(?:<[^;=()]*>)?\\s+([a-z]\\w*)\\s*[=;,]"


def var_types(lines: DataFrame) -> DataFrame:
    """(diff_id, grp, file, side, var, type): the last declaration of a variable on its side of the patch."""
    found = lines.where(F.col("text").rlike(TYPED)).select("diff_id", "grp", "file", "side", "n", F.regexp_extract("text", TYPED, 2).alias("var"), F.regexp_extract("text", TYPED, 1).alias("type"))
    return found.groupBy("diff_id", "grp", "file", "side", "var").agg(F.max_by("type", "n").alias("type"))


def type_downgrades(lines: DataFrame) -> DataFrame:
    """(diff_id, grp, file, var, old, new): variables whose thread-safe type became another."""
    v = var_types(lines)
    old = v.where((F.col("side") == "removed") & F.col("type").isin(*THREAD_SAFE)).select("diff_id", "grp", "file", "var", F.col("type").alias("old"))
    new = v.where((F.col("side") == "added") & ~F.col("type").isin(*THREAD_SAFE)).select("diff_id", "grp", "file", "var", F.col("type").alias("new"))
    return old.join(new, ["diff_id", "grp", "file", "var"])


def loop_removes(lines: DataFrame) -> DataFrame:
    """(diff_id, grp, file, n, ignores): added lines that call remove inside a loop.

    One scan over a side's tokens: a loop's word opens it, its body lasts to the matching brace, or without braces to the
    next semicolon; loops that were opened outside the added lines aren't seen. Only sides with both words have tokens made."""
    keep = ["diff_id", "grp", "file"]
    side = lines.where("side = 'added'").groupBy(*keep).agg(F.array_sort(F.collect_list(F.struct("n", "text", "ignores"))).alias("x"))
    side = side.where(F.exists("x", lambda r: r["text"].contains("remove")) & F.exists("x", lambda r: r["text"].rlike("\\b(?:for|while|do)\\b")))
    side = side.withColumn("x", F.transform("x", lambda r: F.struct(r["n"].alias("n"), tokens(r["text"]).alias("t"), r["ignores"].alias("ignores"))))
    side = side.where(F.exists("x", lambda r: F.array_contains(r["t"], "remove")) & F.exists("x", lambda r: F.arrays_overlap(r["t"], F.array(F.lit("for"), F.lit("while"), F.lit("do")))))
    toks = F.flatten(F.transform("x", lambda r: F.transform(r["t"], lambda w, i: F.struct(r["n"].alias("n"), w.alias("w"), (F.get(r["t"], i + 1) == "(").alias("call"), F.coalesce(F.get(r["t"], i - 1) == "new", F.lit(False)).alias("new")))))
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("paren"), F.lit(False).alias("open"), none.alias("loops"), none.alias("hits"))

    def step(a: Column, t: Column) -> Column:
        w, head = t["w"], t["w"].isin("for", "while", "do")
        body = a["open"] & (a["paren"] == 0)
        hit = (w == "remove") & F.coalesce(t["call"], F.lit(False)) & ~t["new"] & (a["open"] | (F.size(a["loops"]) > 0))
        return F.struct(
            F.when(w == "{", a["depth"] + 1).when(w == "}", a["depth"] - 1).otherwise(a["depth"]).alias("depth"),
            F.when(head, F.lit(0)).when(w == "(", a["paren"] + 1).when(w == ")", a["paren"] - 1).otherwise(a["paren"]).alias("paren"),
            F.when(head, F.lit(True)).when(body & w.isin("{", "}", ";"), F.lit(False)).otherwise(a["open"]).alias("open"),
            F.when(body & (w == "{"), F.concat(a["loops"], F.array(a["depth"] + 1))).when(w == "}", F.filter(a["loops"], lambda d: d < a["depth"])).otherwise(a["loops"]).alias("loops"),
            F.when(hit, F.concat(a["hits"], F.array(t["n"]))).otherwise(a["hits"]).alias("hits"),
        )

    found = side.select(*keep, "x", F.aggregate(toks, start, step, lambda a: a["hits"]).alias("hits"))
    return found.select(*keep, F.explode(F.filter("x", lambda r: F.array_contains(F.col("hits"), r["n"]))).alias("r")).select(*keep, "r.n", "r.ignores")


def changes(diffs: DataFrame) -> DataFrame:
    """Distinct (diff_id, seq, file, kind, symbol, meta, ignores); seq, a struct, orders them as they were found."""
    # several branches read the lines and two what is found in them, so each is made once
    every_line = tables.written(side_lines(diffs, ignores=True), "side-lines")
    lines = every_line.where("text <> ''")
    made = token_changes(*[F.col(c) for c in ("side", "text", "t", "g2", "g3")])
    split = tokenised(lines.where(F.col("text").rlike(HINTS)))
    found = tables.written(split.select("diff_id", "grp", "file", "side", "n", "ignores", F.posexplode_outer(made).alias("k", "c")).where("c is not null"), "line-changes")
    none = F.array().cast("array<string>")

    def at(phase: int, n: Column | int = 0, k: Column | int = 0) -> Column:
        """Changes of lines come first, those of the removed side before the added one's; then what both sides tell together."""
        side = F.when(F.col("side") == "added", 1).otherwise(0) if phase == 0 else F.lit(0)
        whole = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("int")
        return F.struct(F.col("grp").cast("long").alias("grp"), F.lit(phase).alias("phase"), side.alias("side"), whole(n).alias("n"), whole(k).alias("k")).alias("seq")

    rows = found.where("c.symbol not in ('equals', '==', 'old pool')").select("diff_id", "file", at(0, F.col("n"), F.col("k")), "c.kind", "c.symbol", "c.meta", "ignores")
    late = 1_000  # after what a line alone tells
    loops = loop_removes(lines).withColumn("side", F.lit("added")).select("diff_id", "file", at(0, F.col("n"), late), F.lit("CALL_ADDED").alias("kind"), F.lit("remove").alias("symbol"), F.lit("in_loop=true").alias("meta"), "ignores")
    sql, atomic = whole_side_changes(every_line)
    own = every_line.select(*snippets.SIDE, "n", "ignores")
    kind = F.when(F.col("side") == "added", "CALL_ADDED").otherwise("CALL_REMOVED").alias("kind")
    sql = sql.join(own, [*snippets.SIDE, "n"]).select("diff_id", "file", at(0, F.col("n"), late + 1), kind, F.lit("sql_concat").alias("symbol"), F.lit("risk=sql_injection").alias("meta"), "ignores")
    atomic = atomic.join(own, [*snippets.SIDE, "n"]).select("diff_id", "file", at(0, F.col("n"), late + 2), kind, F.lit("atomic_set").alias("symbol"), F.concat(F.lit("var="), "var").alias("meta"), "ignores")
    down = type_downgrades(lines).select("diff_id", "file", at(1), F.lit("TYPE_CHANGED").alias("kind"), F.col("var").alias("symbol"), F.concat(F.lit("downgrade=true;from="), "old", F.lit(";to="), "new").alias("meta"), none.alias("ignores"))
    both = found.groupBy("diff_id", "grp", "file").agg(
        F.bool_or((F.col("side") == "removed") & (F.col("c.symbol") == "equals")).alias("eq"), F.bool_or(F.col("c.symbol") == "old pool").alias("old_pool"), F.bool_or(F.col("c.symbol") == "ThreadPoolExecutor").alias("new_pool"), F.bool_or((F.col("side") == "added") & (F.col("c.symbol") == "==")).alias("ref"))
    refs = both.where("eq and ref").select("diff_id", "file", at(2), F.lit("UNKNOWN").alias("kind"), F.lit("equals_to_ref").alias("symbol"), F.lit("").alias("meta"), none.alias("ignores"))
    pools = both.where("old_pool and new_pool").select("diff_id", "file", at(3), F.lit("UNKNOWN").alias("kind"), F.lit("ThreadPoolExecutor").alias("symbol"), F.lit("param_change=true").alias("meta"), none.alias("ignores"))
    every = rows
    for more in (loops, sql, atomic, down, refs, pools):
        every = every.unionByName(more)
    first = every.groupBy("diff_id", "file", "kind", "symbol", "meta").agg(F.min(F.struct("seq", "ignores")).alias("x"))
    return first.select("diff_id", "x.seq", "file", "kind", "symbol", "meta", "x.ignores")


def whole_side_changes(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Joined SQL, and set on atomic variables of the removed side; only sides that hold such words are lexed."""
    sides = snippets.sides(lines)
    sql = sides.where(F.col("text").rlike("(?i)" + "|".join(snippets.SQL_WORDS)) & F.col("text").rlike("\\+|concat|append"))
    atomic = sides.where(F.col("text").contains("Atomic") & F.col("text").rlike("\\bset\\b") & (F.col("side") == "removed"))
    return snippets.sql_concatenations(snippets.stream(sql)), snippets.atomic_sets(snippets.stream(atomic))


def signal_id(kind: Column, symbol: Column, meta: Column) -> Column:
    """The signal of a change; the first that holds, in this order."""
    has = lambda k: meta.contains(k)
    p = "runtime.concurrency."
    return (
        F.when((kind == "TYPE_CHANGED") & has("downgrade"), p + "thread_safety_downgrade")
        .when((kind == "FIELD_ADDED") & has("static_unsafe"), p + "static_unsafe_collection")
        .when((symbol == "lock") & (kind == "CALL_REMOVED"), p + "lock_removed").when(symbol == "lock", p + "lock")
        .when((symbol == "synchronized") & (kind == "MODIFIER_REMOVED"), p + "lock_removed").when(symbol == "synchronized", p + "synchronized")
        .when((symbol == "volatile") & (kind == "MODIFIER_REMOVED"), p + "volatile_removed").when(symbol == "volatile", p + "volatile")
        .when((symbol == "final") & (kind == "MODIFIER_REMOVED"), p + "final_removed")
        .when((symbol == "atomic_set") & (kind == "CALL_REMOVED"), p + "atomic_to_non_atomic_write")
        .when((symbol == "ThreadPoolExecutor") & has("param_change"), p + "threadpool_param_change")
        .when((symbol == "LinkedBlockingQueue") & has("unbounded"), p + "threadpool_unbounded_queue")
        .when((symbol == "sleep") & (kind == "CALL_ADDED"), "runtime.performance.sleep_added")
        .when((symbol == "while_true") & (kind == "CALL_ADDED"), p + "busy_wait_added")
        .when((symbol == "try_with_resources") & (kind == "CALL_REMOVED"), "runtime.resource.try_with_resource_removed")
        .when(has("cache_eviction"), "runtime.resource.cache_eviction_removed").when(has("timeout_removed"), "runtime.network.timeout_removed")
        .when((symbol == "null_check") & has("action=removed"), "runtime.data.null_check_removed").when(symbol == "equals_to_ref", "runtime.data.equals_to_reference_compare")
        .when((symbol == "hardcoded_secret") & (kind == "LITERAL_ADDED"), "security.hardcoded_secret").when((symbol == "hardcoded_secret") & (kind == "LITERAL_REMOVED"), "security.hardcoded_secret_removed")
        .when((symbol == "sql_concat") & has("risk=sql_injection"), "security.sql_injection").when(symbol == "weak_crypto", "security.weak_crypto").when(symbol == "command_execution", "security.command_injection")
        .when((kind == "CALL_ADDED") & (symbol == "remove") & has("in_loop"), "runtime.collection_mutation_inside_loop")
        .when((kind == "CALL_ADDED") & symbol.isin("newFixedThreadPool", "newCachedThreadPool"), p + "executors_factory_risk")
        .when((kind == "CALL_ADDED") & (symbol == "get") & has("blocking_get"), p + "future_get_without_timeout")
        .when((kind == "OBJECT_CREATION") & (symbol == "ThreadPoolExecutor"), p + "threadpool_creation")
        .when((kind == "CALL_REMOVED") & symbol.isin(*CRITICAL_CALLS), "runtime.input_normalization_removed")
        .when(symbol == "ConcurrentHashMap", p + "concurrent_map").when(symbol.isin(*PAGINATION), "data.pagination_semantic_change")
    )


def action(kind: Column) -> Column:
    return (
        F.when(kind.isin("CALL_ADDED", "FIELD_ADDED", "MODIFIER_ADDED", "OBJECT_CREATION", "LITERAL_ADDED"), "added")
        .when(kind.isin("CALL_REMOVED", "FIELD_REMOVED", "MODIFIER_REMOVED", "LITERAL_REMOVED"), "removed").when(kind == "TYPE_CHANGED", "downgrade").otherwise("changed")
    )


def signals(diffs: DataFrame) -> DataFrame:
    """(diff_id, seq, signal_id, file, action, confidence, meta) of the changes whose signal no comment ignores."""
    c = changes(diffs).withColumn("signal_id", signal_id(F.col("kind"), F.col("symbol"), F.col("meta"))).where("signal_id is not null")
    c = c.where(~(F.array_contains("ignores", F.col("signal_id")) | F.array_contains("ignores", F.lit("all"))))
    return c.select("diff_id", "seq", "signal_id", "file", action(F.col("kind")).alias("action"), F.lit(1.0).alias("confidence"), "meta")


def analysis_tier(diffs: DataFrame) -> DataFrame:
    """(diff_id, n_files, tier): large refactors get no line analysis, medium ones a light one."""
    n = F.size("files")
    return parse.summaries(diffs).select("diff_id", n.alias("n_files"), F.when(n > 30, "tier3").when(n > 10, "light").otherwise("deep").alias("tier"))
