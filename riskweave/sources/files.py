"""Diffs, change lists, baselines and quality counters from folders of files, read by Spark in parallel.

A file is a row (path, body). What can't be read as what it should be is kept apart with its path instead of failing the read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators import parse
from riskweave.operators.advisories import records

CHANGES = "changes array<struct<old_path:string, new_path:string, new_file:boolean, deleted_file:boolean, renamed_file:boolean, diff:string>>"
BASELINE = "items array<struct<rule_id:string, file:string>>"
QUALITY = "rules map<string, struct<calls:bigint, hits:bigint, ignores:bigint, time_ns:bigint>>"


def bodies(spark: SparkSession, path: str | list[str], pattern: str = "*") -> DataFrame:
    """(path, body): the whole texts of files in a folder and all below it; an empty folder has none."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def diff_files(spark: SparkSession, path: str | list[str], pattern: str = "*.diff") -> DataFrame:
    """(diff_id, raw_diff): a diff a file, named by its path."""
    return bodies(spark, path, pattern).select(F.col("path").alias("diff_id"), F.col("body").alias("raw_diff"))


def parsed(rows: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose body is such a JSON object, with its fields, and the others. rows: any columns and body."""
    read = rows.withColumn("read", F.from_json("body", schema, {"mode": "PERMISSIVE"}))
    first = schema.split()[0]
    return read.where(F.col(f"read.{first}").isNotNull()).select(*rows.columns, "read.*"), read.where(F.col(f"read.{first}").isNull()).select(*rows.columns)


def from_changes(lists: DataFrame) -> DataFrame:
    """(diff_id, raw_diff) of lists(diff_id, changes): the diff that a list of changes stands for; an empty list has none."""
    each = lists.select("diff_id", F.posexplode("changes").alias("pos", "c"))
    no = F.lit(False)
    return parse.rebuild(each.select(
        "diff_id", "pos", F.coalesce("c.old_path", "c.new_path", F.lit("")).alias("old_path"), F.coalesce("c.new_path", "c.old_path", F.lit("")).alias("new_path"), F.coalesce("c.new_file", no).alias("is_new"),
        F.coalesce("c.deleted_file", no).alias("is_deleted"), F.coalesce("c.renamed_file", no).alias("is_renamed"), F.coalesce("c.diff", F.lit("")).alias("body")))


def with_fallback(diffs: DataFrame, lists: DataFrame) -> DataFrame:
    """(diff_id, raw_diff, origin): the raw diff; where that is JSON or empty, the one rebuilt from lists(diff_id, body); none where that can't be read either."""
    good, _ = parsed(lists.select("diff_id", "body"), CHANGES)
    # only what needs it is rebuilt
    bad = diffs.where(F.coalesce(F.trim("raw_diff") == "", F.lit(True)) | parse.is_json(F.col("raw_diff"))).select("diff_id")
    rebuilt = from_changes(good.join(bad, "diff_id", "left_semi")).select("diff_id", F.col("raw_diff").alias("rebuilt"))
    usable = ~F.coalesce(F.trim("raw_diff") == "", F.lit(True)) & ~parse.is_json(F.col("raw_diff"))
    both = diffs.select("diff_id", "raw_diff").join(rebuilt, "diff_id", "left")
    return both.select("diff_id", F.when(usable, F.col("raw_diff")).otherwise(F.col("rebuilt")).alias("raw_diff"), F.when(usable, "raw").when(F.col("rebuilt").isNotNull(), "changes").otherwise("none").alias("origin"))


def baseline(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(rule_id, file) of baseline files, for audit.since_baseline, and (path, body) of those that aren't one."""
    good, bad = parsed(bodies(spark, path, "*.json"), BASELINE)
    return good.select(F.explode("items").alias("x")).select(F.coalesce("x.rule_id", F.lit("")).alias("rule_id"), F.coalesce("x.file", F.lit("")).alias("file")).distinct(), bad


def quality(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Counters (rule_id, calls, hits, ignores, time_ns) of quality files, summed, and (path, body) of those that aren't one."""
    good, bad = parsed(bodies(spark, path, "*.{json,txt}"), QUALITY)
    rows = good.select(F.explode("rules").alias("rule_id", "x"))
    return rows.groupBy("rule_id").agg(*[F.sum(F.coalesce(f"x.{c}", F.lit(0))).alias(c) for c in ("calls", "hits", "ignores", "time_ns")]), bad


def write_quality(counters: DataFrame, path: str, files: int = 8) -> None:
    """Counters(rule_id, calls, hits, ignores, time_ns, one row a rule) as quality files in a new folder, which quality reads back.

    Rules are dealt out by their hash, a file's rules are one object. A folder that is there is refused, so none is ever half overwritten."""
    entry = F.struct("rule_id", F.struct("calls", "hits", "ignores", "time_ns"))
    dealt = counters.where("rule_id is not null").groupBy(F.pmod(F.xxhash64("rule_id"), F.lit(files)).alias("part")).agg(F.map_from_entries(F.collect_list(entry)).alias("rules"))
    dealt.select("part", F.to_json(F.struct("rules")).alias("value")).write.partitionBy("part").text(path)


def advisories(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Advisories of all JSON files of a tree, see operators.advisories.records, and (path, body, error) of those that aren't one."""
    return records(bodies(spark, path, "*.json"))
