"""Tables that batches update: a batch that comes again, or a run that starts again, changes nothing."""

import json

import pytest

from riskweave.operators import reports
from riskweave.sources import files
from riskweave.streaming import streams, upserts

BODY = "tag string, body string, seq long"
RUNS = "rule_id string, hit boolean, ignored boolean, time_ns long"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_replayed_batches(spark, tmp_path):
    table = upserts.comments(spark, str(tmp_path / "t")).start(spark.createDataFrame([("a", "old", 1), ("z", "kept", 1), ("a", "older", 0)], BODY))
    assert rows(table.current()) == [("a", "old", 1), ("z", "kept", 1)]
    first = spark.createDataFrame([("a", "new", 5), ("b", "x", 2), ("b", "y", 3), (None, "no tag", 1), ("n", "no order", None)], BODY)
    table.merge(first, 0)
    want = rows(table.current())
    assert want == sorted([("a", "new", 5), ("b", "y", 3), ("z", "kept", 1), (None, "no tag", 1), ("n", "no order", None)], key=str)
    table.merge(first, 0)
    assert rows(table.current()) == want
    # a batch that failed half way left other rows, which its second run replaces
    table.merge(spark.createDataFrame([("q", "half", 9)], BODY), 1)
    table.merge(spark.createDataFrame([("n", "now", 1), ("a", "late", 4)], BODY), 1)
    want = rows(table.current())
    assert ("n", "now", 1) in want and ("a", "new", 5) in want and "q" not in [t for t, _, _ in want]
    # equal orders: the later batch; started again: as it is
    table.merge(spark.createDataFrame([("a", "again", 5)], BODY), 2)
    again = upserts.comments(spark, str(tmp_path / "t")).start(spark.createDataFrame([("w", "ignored", 1)], BODY))
    want = rows(again.current())
    assert ("a", "again", 5) in want and "w" not in [t for t, _, _ in want]
    small = again.compacted(str(tmp_path / "small"))
    assert rows(small.current()) == want and [p.name for p in (tmp_path / "small").iterdir()] == ["batch=-1"]


def test_empty_table(spark, tmp_path):
    table = upserts.comments(spark, str(tmp_path / "t")).start()
    assert rows(table.current()) == []
    table.merge(spark.createDataFrame([], BODY), 0)
    assert rows(table.current()) == []


def test_restart_equals_one_run(spark, tmp_path):
    runs = spark.createDataFrame([(f"r{i % 7}" if i % 10 else None, i % 3 > 0, i % 6 == 1, i if i % 4 else None) for i in range(1000)], RUNS)
    runs.limit(0).write.parquet(str(tmp_path / "source"))
    got = []
    for part in runs.repartition(5).randomSplit([1.0, 1.0, 1.0], 3):
        part.write.mode("append").parquet(str(tmp_path / "source"))
        got = rows(upserts.count_runs(streams.by_file(spark, str(tmp_path / "source")), str(tmp_path / "at")))
    assert got == rows(reports.counters(runs)) and len(got) == 8
    # nothing new: nothing changes
    assert rows(upserts.count_runs(streams.by_file(spark, str(tmp_path / "source")), str(tmp_path / "at"))) == got


def test_a_lost_batch_is_run_again(spark, tmp_path):
    """The commit of the last batch is lost after its rows were merged: the restart runs it again."""
    at = tmp_path / "at"
    runs = spark.createDataFrame([(f"r{i % 3}", True, False, 1) for i in range(90)], RUNS)
    runs.repartition(3).write.parquet(str(tmp_path / "source"))
    want = rows(upserts.count_runs(streams.by_file(spark, str(tmp_path / "source")), str(at)))
    last = max((p for p in (at / "checkpoint" / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    for p in (last, last.with_name(f".{last.name}.crc")):
        p.unlink(missing_ok=True)
    assert rows(upserts.count_runs(streams.by_file(spark, str(tmp_path / "source")), str(at))) == want == [(f"r{i}", 30, 30, 0, 30) for i in range(3)]


def test_quality_files_round_trip(spark, tmp_path):
    counted = spark.createDataFrame([(f"r{i}", i, i // 2, 0, i * 10) for i in range(50)] + [("nulls", 1, None, None, None), (None, 1, 1, 1, 1)], "rule_id string, calls long, hits long, ignores long, time_ns long")
    files.write_quality(counted, str(tmp_path / "q"), 4)
    good, bad = files.quality(spark, str(tmp_path / "q"))
    assert bad.count() == 0 and rows(good) == sorted([(f"r{i}", i, i // 2, 0, i * 10) for i in range(50)] + [("nulls", 1, 0, 0, 0)], key=str)
    assert all(list(json.loads(p.read_text())) == ["rules"] for p in (tmp_path / "q").rglob("*.txt"))
    with pytest.raises(Exception, match="(?i)exists"):
        files.write_quality(counted, str(tmp_path / "q"))
