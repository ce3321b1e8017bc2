"""Streams and the Python parser against plain versions; none has a DuckDB equivalent."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from riskweave.operators import languages
from riskweave.sources import corpus
from riskweave.streaming import streams

DIR = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def sha1(text):
    return hashlib.sha1(text.encode()).hexdigest()


@tables
def test_stream_dedupe(spark):
    props = [r["props"] for r in spark.read.parquet(f"{DIR}/events.parquet").select("props").collect()]
    got = [(r["digest"], r["n"]) for r in streams.dedupe(spark, DIR).collect()]
    assert props and sorted(got, key=str) == sorted(((None if p is None else sha1(p), 1) for p in set(props)), key=str)


@tables
def test_stream_diffs(spark):
    want = {(r["diff_id"], "\n+" in r["raw_diff"], sha1(r["raw_diff"])) for r in corpus.diffs(spark, DIR).select("diff_id", "raw_diff").collect()}
    got = [tuple(r) for r in streams.diffs(spark, DIR).select("diff_id", "has_plus", "digest").collect()]
    assert want and len(got) == len(want) and set(got) == want


def nodes(spark, *texts):
    files = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "file string, text string")
    return sorted((r["file"], r["line"], r["node"], r["name"]) for r in languages.python_nodes(files).collect())


def test_python_nodes(spark):
    text = "import os, sys\nfrom a import b\nclass A:\n    async def f(self):\n        x = os.getcwd()\n"
    want = [("0", 1, "import", "os"), ("0", 1, "import", "sys"), ("0", 2, "import", "b"), ("0", 3, "class", "A"), ("0", 4, "function", "f"), ("0", 5, "assignment", "x"), ("0", 5, "call", "os.getcwd")]
    assert nodes(spark, text) == want


def test_python_nodes_of_awkward_files(spark):
    """Files that don't parse give nothing and don't stop the others."""
    assert nodes(spark, None, "", "def broken(:", "a\x00b", "(" * 5000 + ")" * 5000, "-" * 100_000 + "1", "f()") == [("6", 1, "call", "f")]


def test_python_nodes_without_files(spark):
    none = spark.createDataFrame([], "file string, text string")
    assert languages.python_nodes(none.where(F.lit(True))).count() == 0
