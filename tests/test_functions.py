import fnmatch
import re

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskweave.functions import dialect
from riskweave.sources import catalog

PARTS = st.lists(st.sampled_from(["*", "**", "?", "a", "b", "/", ".", "[ab]", "[!a]", "py", "-"]), max_size=6).map("".join)
TEXT = st.text("ab/.py-x\n", max_size=12)


@given(PARTS, TEXT)
def test_globs_match_as_fnmatch_does(glob, text):
    assert bool(re.match(dialect.glob_regex(glob), text)) == fnmatch.fnmatchcase(text, glob)


SOURCES = [r[2] for r in catalog.RULES if r[2] and dialect.valid(r[2])] + ["(?:ab|cd)+e?", "(a(bc|d.e)|fgh)i", "x{2,3}yy", "(?:ab)?cd", "[ab]cd|ef$", "(?=abc)de", "a^b", "(?i)AbC|dE", "ab*", "(?:a|)b"]


@given(st.sampled_from(SOURCES), st.text("abcdefghixyABCDE()= .\"'+-", max_size=40))
def test_every_match_holds_a_required_literal(pattern, text):
    need = dialect.required_literals(pattern)
    for m in re.finditer(pattern, text):
        assert not need or any(x in m.group(0).lower() for x in need)


def test_required_literals_are_found():
    assert dialect.required_literals(r"os\.Open\(x+y") == ["os.open("]
    assert dialect.required_literals(r"ab?c") == ["a"]
    assert dialect.required_literals(r"(?i)aBc") == ["abc"]
    assert dialect.required_literals(r"abc|xcde") == ["abc", "xcde"] and dialect.required_literals(r"abc|x?") == []
    assert dialect.required_literals(r"x(?:abc|defg)+") == ["abc", "defg"] and dialect.required_literals(r"(?:abc)*") == []
    assert dialect.required_literals("(") == []


def test_file_globs():
    ok = lambda g, f: bool(re.search(dialect.file_glob_regex(g), f))
    assert ok("**/package.json", "package.json") and ok("**/package.json", "x/package.json") and not ok("**/package.json", "xpackage.json")
    assert ok("**", "a") and not ok("**/*.py", "x.py") and ok("**/*.py", "a/x.py")


def test_patterns_run_in_java(spark):
    ps = [r[2] for r in catalog.RULES if r[2] and dialect.valid(r[2])]
    row = spark.range(1).select(*[F.lit("x {y} catch(e){ }").rlike(dialect.java_regex(p)).alias(f"c{i}") for i, p in enumerate(ps)]).first()
    for i, p in enumerate(ps):
        assert row[i] == bool(re.search(p, "x {y} catch(e){ }")), p


def test_versions(spark):
    from riskweave.operators.audit import version_affected

    rows = [("9.0.72", True), ("9.0.80", False), ("8.5", False), ("9.0.72-beta", True), (None, True)]
    df = spark.createDataFrame(rows, "v string, e boolean").select("e", version_affected(F.col("v"), F.array(F.lit("9.0.1")), F.array(F.lit("9.0.80"))).alias("g"))
    assert all(r.e == r.g for r in df.collect())


def test_long_texts_do_not_overflow(spark):
    df = spark.createDataFrame([("a/" * 200_000,)], "f string")
    assert df.select(F.col("f").rlike(dialect.glob_regex("a*b*c"))).first()[0] is False
