"""Tables that micro-batches update by key: comments by tag, counters by rule.

A batch is written under its own id, so a batch that is run again after a failure replaces itself and changes nothing. The
table is the latest row of each key over all batches and the snapshot that it began with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Batches are numbered from 0; the snapshot comes before them.
SNAPSHOT = -1


class Table:
    """A table at a folder that driver and executors share. schema: its columns; key: those that name a row; order: a column by which the
    latest of a key's rows is told (a null is the earliest, equal ones are told by the batch, then by their values)."""

    def __init__(self, spark: SparkSession, at: str, schema: StructType, key: list[str], order: str) -> None:
        self.spark, self.at, self.schema, self.key, self.order = spark, at.rstrip("/"), schema, key, order
        self.rest = [c for c in schema.names if c not in key]

    def start(self, snapshot: DataFrame | None = None) -> Table:
        """Writes the rows to begin with, none without a snapshot. A table that is there already goes on as it is."""
        rows = self.spark.createDataFrame([], self.schema) if snapshot is None else snapshot.select(*self.schema.names)
        self._latest(rows.withColumn("batch", F.lit(SNAPSHOT).cast("long"))).write.mode("ignore").parquet(f"{self.at}/batch={SNAPSHOT}")
        return self

    def _latest(self, rows: DataFrame) -> DataFrame:
        newest = F.struct(F.col(self.order).isNotNull(), self.order, "batch", *self.rest)
        found = rows.groupBy(*self.key).agg(F.max_by(F.struct(*self.rest), newest).alias("x"))
        return found.select(*[F.col(c) if c in self.key else F.col(f"x.{c}").alias(c) for c in self.schema.names])

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch: the batch's latest row of each key, in place of what an earlier run of the same batch left."""
        rows = self._latest(batch.select(*self.schema.names).withColumn("batch", F.lit(batch_id).cast("long")))
        rows.write.mode("overwrite").parquet(f"{self.at}/batch={batch_id}")

    def current(self) -> DataFrame:
        """The latest row of each key."""
        fields = self.spark.read.schema(StructType([*self.schema.fields]).add("batch", "long")).parquet(self.at)
        return self._latest(fields)

    def compacted(self, at: str) -> Table:
        """The table at a new folder, as a snapshot: one row a key. Its stream goes on there with a checkpoint of its own."""
        return Table(self.spark, at, self.schema, self.key, self.order).start(self.current())

    def follow(self, stream: DataFrame, checkpoint: str, mode: str = "append") -> None:
        """Merges what the stream has, batch by batch, and returns; called again it goes on from the checkpoint."""
        stream.writeStream.outputMode(mode).foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def comments(spark: SparkSession, at: str) -> Table:
    """Comments by tag, (tag, body, seq): the one with the greatest seq stays."""
    return Table(spark, at, StructType().add("tag", "string").add("body", "string").add("seq", "long"), ["tag"], "seq")


COUNTERS = StructType().add("rule_id", "string").add("calls", "long").add("hits", "long").add("ignores", "long").add("time_ns", "long")


def counters(spark: SparkSession, at: str) -> Table:
    """Totals by rule; calls only grow, so the greatest are the latest."""
    return Table(spark, at, COUNTERS, ["rule_id"], "calls")


def count_runs(runs: DataFrame, at: str) -> DataFrame:
    """Totals (rule_id, calls, hits, ignores, time_ns) of a stream of runs(rule_id, hit, ignored, time_ns), kept at a folder.

    Rows of state are rules. The state is in the checkpoint, so a restart goes on where the last run ended; totals of updated rules are merged by batch."""
    spark = runs.sparkSession
    table = counters(spark, f"{at}/totals").start()
    totals = runs.groupBy("rule_id").agg(F.count("*").alias("calls"), F.count_if("hit").alias("hits"), F.count_if("ignored").alias("ignores"), F.sum("time_ns").alias("time_ns"))
    table.follow(totals, f"{at}/checkpoint", "update")
    return table.current()
