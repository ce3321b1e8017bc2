"""Token streams, contexts, declarations as of a call, and the automaton, against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from riskweave.operators import audit, detect, snippets


def sides(spark, texts, side="removed"):
    return spark.createDataFrame([(i, 1, "A.java", side, t) for i, t in enumerate(texts)], "diff_id long, grp long, file string, side string, text string")


def lexed(text):
    """[(word, line)] or nothing if a Java lexer would stop."""
    out, line = [], 1
    for w in re.findall(snippets.LEXEME, text):
        if w in ('"', "'", "#", "\\", "`") or (w.startswith("/*") and not re.fullmatch(r"/\*[\s\S]*\*/", w)):
            return []
        if w != "\n" and not w.startswith(("//", "/*")):
            out.append((w, line))
        line += w.count("\n")
    return out


PARTS = ['"SELECT id"', "SELECT", "sql", "+", "append", "(", ")", "{", "}", ";", "a", "b", "List<String>", "Map<String, List<Long>>", "AtomicLong", "=", ".", "set", "\n", "/* x\ny */", "// z\n", "new", "int", "#", "'c'", '"open']


def test_streams_and_contexts(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(PARTS[: len(PARTS) - (3 if i % 4 else 0)]) for _ in range(rng.randint(0, 50))) for i in range(150)]
    tokens = snippets.stream(sides(spark, texts)).persist()
    got = {}
    for r in tokens.orderBy("diff_id", "i").collect():
        got.setdefault(r.diff_id, []).append((r.w, r.n))
    assert got == {i: x for i, t in enumerate(texts) if (x := lexed(t))}
    want = {(i, n) for i, t in enumerate(texts) for k, (w, n) in enumerate(lexed(t)) if w in ("+", "append", "concat") and any(x.upper() in snippets.SQL_WORDS for x, _ in lexed(t)[max(0, k - 20) : k])}
    assert {(r.diff_id, r.n) for r in snippets.sql_concatenations(tokens).collect()} == want and len(want) > 20
    tokens.unpersist()


def declared(words):
    """(place of the name, name, type) by scanning for the bracket that closes each type's arguments."""
    ok = lambda w: re.match(r"[A-Za-z_$]", w) and w not in snippets.KEYWORDS
    out = []
    for i, w in enumerate(words):
        j = i + 1
        if not ok(w) or j >= len(words):
            continue
        if words[j] == "<":
            depth, j = 1, j + 1
            while j < len(words) and depth:
                depth += {"<": 1, ">": -1}.get(words[j], 0)
                j += 1
            if depth:
                continue
        if j + 1 < len(words) and ok(words[j]) and words[j] not in snippets.BASIC_TYPES and words[j + 1] in ("=", ";", ","):
            out.append((j, words[j], w))
    return out


def test_declarations_as_of_a_call(spark):
    rng = random.Random(4)
    parts = ["AtomicLong a =", "Long a =", "List<String> b;", "Map<String, List<Long>> a,", "a.set(1);", "a\n.set\n(2);", "x.a.set(3);", "new a.set(4);", "b.get();", "int c = 1;", "c.set();", "return a;", "f(", "}"]
    texts = ["\n".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(120)]
    tokens = snippets.stream(sides(spark, texts)).persist()
    want_d, want_c = set(), set()
    for i, t in enumerate(texts):
        x = lexed(t)
        words = [w for w, _ in x]
        found = declared(words)
        want_d |= {(i, j + 1, v, k) for j, v, k in found}
        for j, (w, n) in enumerate(x):
            if j > 1 and w in ("set", "get") and words[j - 1] == "." and j + 1 < len(words) and words[j + 1] == "(" and (j < 3 or words[j - 3] != ".") and words[j - 2] in "abc":
                before = [k for at, v, k in found if v == words[j - 2] and at < j]
                if before:
                    want_c.add((i, n, w, words[j - 2], before[-1]))
    assert {(r.diff_id, r.i, r.var, r.type) for r in snippets.declarations(tokens).collect()} == want_d
    assert {(r.diff_id, r.n, r.name, r.var, r.type) for r in snippets.typed_calls(tokens).collect()} == want_c and len(want_c) > 50
    tokens.unpersist()


WRAPPED = {
    "private int a = 1;\nvoid run() { a++; }": "class",
    "AtomicLong hits = new AtomicLong();": "class",
    "int[] xs = { 1, 2 };": "class",
    "@Override public Long load(String key) throws E { return get(key); }": "class",
    "synchronized void run() { }": "class",
    "AtomicLong hits = new AtomicLong();\nhits.set(\n1);": "method",
    "if (a) { b(); } else { c(); }": "method",
    "synchronized (this) { a = 1; }": "method",
    "a += 2;": "method",
    "return list;": "method",
    "public void run() { }\nlock.lock();": "fallback",
    "if (a) {": "fallback",
    "}": "fallback",
    "f(a]);": "fallback",
    "(])": "fallback",
    "int a": "fallback",
    "": None,
    '"open': None,
}


def test_wrappers(spark):
    got = {r.diff_id: r.wrapper for r in snippets.wrappers(snippets.stream(sides(spark, list(WRAPPED)))).collect()}
    assert [got.get(i) for i in range(len(WRAPPED))] == list(WRAPPED.values())


def test_unbalanced_sides_fall_back(spark):
    """Whatever else stands there: a side parses only if its brackets pair up."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice("()[]{};a=") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    got = {r.diff_id: r.wrapper for r in snippets.wrappers(snippets.stream(sides(spark, texts))).collect()}

    def balanced(t):
        while (s := re.sub(r"\(\)|\[\]|\{\}", "", t)) != t:
            t = s
        return not t

    assert all(got[i] == "fallback" for i, t in enumerate(texts) if not balanced(re.sub(r"[^()\[\]{}]", "", t)))


def test_atomic_sets_and_fallback_types(spark):
    texts = ["AtomicLong hits = new AtomicLong();\nhits.set(0L);", "AtomicLong hits = x;\nhits.set(0L);\nif (a) {", "Long hits = 0L;\nhits.set(0L);", "AtomicLong hits = x;\nLong hits = y;\nhits.set(0L);", "hits.set(0L);\nAtomicLong hits = x;"]
    tokens = snippets.stream(sides(spark, texts))
    assert [(r.diff_id, r.n, r.var) for r in snippets.atomic_sets(tokens).collect()] == [(0, 2, "hits")]
    assert [(r.diff_id, r.var, r.type) for r in snippets.fallback_types(tokens).collect()] == [(1, "hits", "AtomicLong")]


def text(*lines, file="src/A.java"):
    return "\n".join([f"diff --git a/{file} b/{file}", f"--- a/{file}", f"+++ b/{file}", "@@ -1,3 +1,3 @@", *lines])


def test_signals_of_whole_sides(spark):
    cases = [
        text("-AtomicLong hits = new AtomicLong();", "-hits.set(0L);"),
        text('+String q = "SELECT";', "+sql", "+  .append(name);"),
        text('+// riskweave-ignore: security.sql_injection', "+sql.append(name);"),
        text("+String a = b + c;"),
    ]
    df = spark.createDataFrame(list(enumerate(cases)), "diff_id long, raw_diff string")
    got = {(r.diff_id, r.signal_id, r.action) for r in detect.signals(df).collect()}
    assert got == {(0, "runtime.concurrency.atomic_to_non_atomic_write", "removed"), (1, "security.sql_injection", "added")}


@pytest.mark.parametrize("n", [25_000])
def test_changes_of_long_sides_keep_their_order(spark, n):
    """However many lines a side has: removed ones first, patches in order."""
    big = text(*(f"-int x{i};" for i in range(n)), "-lock.lock();", *(f"+int y{i};" for i in range(n)), "+Thread.sleep(1);", file="src/First.java") + "\n" + text("-volatile int a;", "+int b;", file="src/Second.java")
    df = spark.createDataFrame([(1, big)], "diff_id long, raw_diff string")
    got = [r.signal_id.split(".")[-1] for r in detect.signals(df).orderBy("seq").collect()]
    assert got == ["lock_removed", "sleep_added", "volatile_removed"]
    first = detect.signals(df).groupBy("diff_id").agg(F.min_by("file", "seq").alias("file")).first()
    assert first.file == "src/First.java" and audit.Engine(spark).audit(df).count() > 0
