"""Structured Streaming forms of the audit: files as a stream, run to their end.

The result of a stream is a table in the shared folder (spark.checkpoint.dir), where its checkpoint is too."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.sources import corpus, tables
from riskweave.sources.corpus import RULE_IDS, pick
from riskweave.streaming import upserts


def folder(spark: SparkSession) -> str:
    return f"{tables.shared_folder(spark)}/streams/{uuid.uuid4().hex}"


def source(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file or folder as a stream. The stream watches the parent folder of a single file and takes that file only."""
    schema = spark.read.parquet(path).schema
    parent, name = path.rstrip("/").rsplit("/", 1)
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{parent}/{name}*")


def finished(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs the stream over what is there and gives its output. Complete output replaces the table with every batch."""
    spark = stream.sparkSession
    at, schema = folder(spark), stream.schema
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", f"{at}/out")
    else:
        writer = stream.writeStream.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{at}/out"))
    writer.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{at}/out")


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running counters of rules."""
    e = source(spark, f"{sf_dir}/events.parquet")
    return finished(e.groupBy(pick(RULE_IDS, F.col("user_id")).alias("rule_id")).agg(F.count("*").alias("runs"), F.count(F.when(F.col("event_type") != "view", 1)).alias("hits")), "complete")


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling daily counts. Complete output: with append the windows that the watermark hasn't passed would be missing at the stream's end."""
    e = source(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return finished(e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")), "complete").select(F.col("w.start").cast("date").cast("string").alias("day"), "event_type", "n")


def dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a digest within the watermark."""
    e = source(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("digest", F.sha1(F.col("props"))).withWatermark("ts", "40 days")
    return finished(e.dropDuplicatesWithinWatermark(["digest"])).select("digest").groupBy("digest").agg(F.count("*").alias("n"))


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New diffs get rows of flags as they come."""
    at = folder(spark)
    corpus.diffs(spark, sf_dir).write.parquet(f"{at}/diffs.parquet")
    d = source(spark, f"{at}/diffs.parquet")
    return finished(d.select("diff_id", F.col("raw_diff").contains("\n+").alias("has_plus"), F.sha1("raw_diff").alias("digest")))


def in_files(df: DataFrame, by: str, n: int = 4) -> str:
    """df as n files or fewer, by ranges of a column, for streams that take a file a batch."""
    at = f"{folder(df.sparkSession)}/source"
    df.repartitionByRange(n, by).write.parquet(at)
    return at


def by_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tag, body, seq): the comment of each rule, as events rewrite older ones, over several batches."""
    e = corpus.table(spark, sf_dir, "events").select(pick(RULE_IDS, F.col("user_id")).alias("tag"), F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("body"), F.col("event_id").cast("long").alias("seq"))
    at = in_files(e, "seq")
    table = upserts.comments(spark, f"{at}-comments").start(e.where("seq % 97 = 0").withColumns({"body": F.lit("old"), "seq": F.lit(-1).cast("long")}))
    table.follow(by_file(spark, at), f"{at}-checkpoint")
    return table.current()


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rule_id, calls, hits, ignores, time_ns): totals over several batches, with a restart in between."""
    e = corpus.table(spark, sf_dir, "events")
    runs = e.select("event_id", pick(RULE_IDS, F.col("user_id")).alias("rule_id"), (F.col("event_type") != "view").alias("hit"), (F.col("event_type") == "error").alias("ignored"), (F.col("event_id") % 1000 * 1000).cast("long").alias("time_ns"))
    at = in_files(runs.where("event_id % 2 = 0"), "event_id", 2)
    upserts.count_runs(by_file(spark, at), f"{at}-counters")
    runs.where("event_id % 2 = 1").write.mode("append").parquet(at)
    return upserts.count_runs(by_file(spark, at), f"{at}-counters")
