"""Line-level nodes and signals of source text by language, and ranges of changed lines.

lines(file, line, text) is the input; changed ranges (file, start_line, end_line) meet nodes, which may span lines, as intervals."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.operators import intervals

# What marks a node of each language, and the ids of their signals.
GO_NODES = {
    "function": r"func\s+(?:\([^)]+\)\s+)?[a-zA-Z_][a-zA-Z0-9_]*\s*\(", "goroutine": r" go |^\s*go ", "defer": r"defer ", "channel": r"<-|make\(chan", "mutex": r"sync\.(?:RW)?Mutex|\.(?:R?Lock|R?Unlock)\(\)", "select": r"\bselect\s*\{",
    "panic": r"\bpanic\(", "import": r'"[^"]+"',
}
GO_SIGNALS = {
    "goroutine": "runtime.concurrency.goroutine_created", "defer": "runtime.resource.defer_statement", "channel": "runtime.concurrency.channel_operation", "mutex": "runtime.concurrency.mutex_operation",
    "select": "runtime.concurrency.select_statement", "panic": "runtime.error.panic_called",
}
GO_UNSAFE = r'^\s*(?:import\s+)?(?:\w+\s+)?"unsafe"'
CPP_NODES = {"class": r"\b(?:class|struct)\s+\w+", "memory": r" new | delete |malloc", "smart_pointer": r"unique_ptr|shared_ptr|weak_ptr", "thread": r"std::thread|std::mutex", "unsafe_function": r"strcpy|strcat|sprintf|gets"}
CPP_SIGNALS = {"memory": "runtime.memory.operation", "smart_pointer": "runtime.memory.smart_pointer", "thread": "runtime.concurrency.thread_operation", "unsafe_function": "security.unsafe_function"}
JS_NODES = {
    "function": r"\bfunction\b|=>", "class": r"\bclass\s+\w+", "export": r"\bexport\b", "async": r"async |await |Promise", "code_injection": r"eval\(", "xss": r"innerHTML|outerHTML", "prototype_pollution": r"__proto__|constructor\.prototype",
    "event": r"addEventListener|\.on\(", "dom": r"document\.|getElementById|querySelector",
}
JS_SIGNALS = {"async": "runtime.async.operation", "code_injection": "security.code_injection", "xss": "security.xss", "prototype_pollution": "security.prototype_pollution", "event": "runtime.event.listener", "dom": "runtime.dom.access", "export": "api.export_changed"}
CPP_PATTERNS = {
    "memory_allocation": r"\b(?:new|delete)\b", "pointer_arithmetic": r"[a-zA-Z_]\s*\+\s*\d+|\d+\s*\+\s*[a-zA-Z_]", "raw_pointers": r"[a-zA-Z_]\s*\*\s*[a-zA-Z_]", "buffer_operations": r"\b(?:memcpy|memset|strcpy|strcat)\b",
    "smart_pointers": r"\b(?:std::unique_ptr|std::shared_ptr|std::weak_ptr)\b", "concurrency": r"\b(?:std::thread|std::mutex|std::lock_guard|std::unique_lock)\b", "templates": r"template\s*<[^>]*>", "macros": r"#define\s+[A-Z_][A-Z0-9_]*",
    "unsafe_casts": r"\b(?:static_cast|dynamic_cast|reinterpret_cast|const_cast)\b", "exception_handling": r"\b(?:try|catch|throw)\b",
}
CPP_PATTERN_GROUP = {"memory_allocation": "security", "pointer_arithmetic": "security", "raw_pointers": "security", "buffer_operations": "security", "unsafe_casts": "security", "templates": "performance", "macros": "performance", "concurrency": "concurrency", "exception_handling": "concurrency"}
JS_CONTENT = {
    "security.eval_usage": r"eval\(", "security.xss_dom": r"innerHTML|outerHTML", "security.prototype_pollution": r"__proto__|constructor\.prototype", "performance.promise_race": r"Promise\.race\(", "performance.zero_timeout": r"setTimeout\([\s\S]*0|0[\s\S]*setTimeout\(",
    "security.xss_document_write": r"document\.write\(", "security.open_redirect": r"location\.href.*=|=.*location\.href", "security.local_storage": r"localStorage\.setItem\(", "network.http_request": r"XMLHttpRequest|fetch\(",
}


def nodes(lines: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(file, line, node): a row for each kind of node that a line has."""
    found = F.filter(F.array(*[F.when(F.col("text").rlike(p), k) for k, p in patterns.items()]), lambda x: x.isNotNull())
    return lines.select("file", "line", F.explode_outer(found).alias("node")).where("node is not null")


def signals(found: DataFrame, ranges: DataFrame, ids: dict[str, str]) -> DataFrame:
    """(file, line, signal_id) of found(file, line, node), or (file, line, last, node) for nodes over several lines, that changed ranges touch."""
    name = F.create_map(*[F.lit(x) for kv in ids.items() for x in kv])
    last = F.col("last") if "last" in found.columns else F.col("line")
    spans = found.where(F.col("node").isin(*ids)).select("file", F.col("line").cast("long").alias("start"), last.cast("long").alias("end"), "line", "node")
    changed = ranges.select("file", F.col("start_line").cast("long").alias("start"), F.col("end_line").cast("long").alias("end"))
    return intervals.covered(spans, changed, ["file"]).select("file", "line", name[F.col("node")].alias("signal_id"))


def unsafe_imports(lines: DataFrame) -> DataFrame:
    """(file, line, signal_id): a file that imports the unsafe package, whatever lines changed; its line is 0."""
    return lines.where(F.col("text").rlike(GO_UNSAFE)).select("file", F.lit(0).alias("line"), F.lit("runtime.security.unsafe_package_used").alias("signal_id")).distinct()


def brace_spans(lines: DataFrame, pattern: str) -> DataFrame:
    """(file, line, last): from a line that matches and opens a brace to the line that closes it, or the file's last one.

    The depth after each line is a running sum. A line closes every level between the depths before and after it, so an opening meets
    the next closing of its level within (file, level), in order of lines."""
    w = Window.partitionBy("file").orderBy("line")
    opened, closed = F.regexp_count("text", F.lit("\\{")), F.regexp_count("text", F.lit("\\}"))
    rows = lines.withColumn("after", F.sum(opened - closed).over(w)).withColumn("before", F.col("after") - opened + closed).withColumn("end", F.max("line").over(Window.partitionBy("file")))
    begins = rows.where(F.col("text").rlike(pattern) & (opened > 0)).select("file", "line", F.col("before").alias("level"), "end", F.lit(1).alias("kind"), F.when(F.col("after") <= F.col("before"), F.col("line")).alias("own"))
    falls = rows.where("after < before").select("file", "line", F.explode(F.sequence("after", F.col("before") - 1)).alias("level"), "end", F.lit(0).alias("kind"), F.lit(None).cast("int").alias("own"))
    both = begins.unionByName(falls)
    later = Window.partitionBy("file", "level").orderBy("line").rangeBetween(1, Window.unboundedFollowing)
    to = F.coalesce("own", F.min(F.when(F.col("kind") == 0, F.col("line"))).over(later), "end")
    return both.withColumn("last", to).where("kind = 1").select("file", "line", "last")


def pattern_counts(text: Column) -> Column:
    """Array of (pattern, n, first ten matches)."""
    return F.array(*[F.struct(F.lit(k).alias("pattern"), F.regexp_count(text, F.lit(p)).alias("n"), F.slice(F.regexp_extract_all(text, F.lit(p), F.lit(0)), 1, 10).alias("matches")) for k, p in CPP_PATTERNS.items()])


def python_nodes(files: DataFrame) -> DataFrame:
    """(file, node, name, line) of files(file, text) by the ast module; a file that doesn't parse, or is nested too deeply to, has no nodes."""
    import ast

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, text in zip(frame["file"], frame["text"], strict=True):
                try:
                    tree = ast.parse(text or "")
                except (SyntaxError, ValueError, RecursionError, MemoryError):  # the last two: nested too deeply
                    continue
                for n in ast.walk(tree):
                    if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
                        rows.append((name, "function", n.name, n.lineno))
                    elif isinstance(n, ast.ClassDef):
                        rows.append((name, "class", n.name, n.lineno))
                    elif isinstance(n, ast.Import | ast.ImportFrom):
                        rows += [(name, "import", a.name, n.lineno) for a in n.names]
                    elif isinstance(n, ast.Call):
                        rows.append((name, "call", ast.unparse(n.func), n.lineno))
                    elif isinstance(n, ast.Assign):
                        rows.append((name, "assignment", ast.unparse(n.targets[0]), n.lineno))
            yield pd.DataFrame(rows, columns=["file", "node", "name", "line"])

    return files.select("file", "text").mapInPandas(run, "file string, node string, name string, line int")
