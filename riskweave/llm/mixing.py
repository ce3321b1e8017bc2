"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. Within a source documents are taken in the order of their keys, epoch after
epoch, until the source's budget of words is spent; the document at the cut is taken in part. Keys are range-sorted
into buckets of about BUCKET documents: the sums of buckets give each bucket's offset, and running sums are only formed within
a bucket, so a source with a third of all rows is dealt over as many tasks as it has buckets.

Weights 3, 1, 2 repeat over the sources in code-point order (null last). The sources share SHARE of all words by weight;
a target stops at LIMIT times its source's words and the excess is shared again by weight until none is above, which is
the water level where the targets' sum is reached.

Edge cases: a null text has no words; documents without words are taken 0 words; a source without words has the target 0;
rows that repeat a doc_id and size are interchangeable; null doc_ids share one key; an empty table gives an empty
result; other columns are kept by `mixed`, whatever their names, and ignored by `plan`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.llm import common

WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2.0
#: Documents in a bucket, about.
BUCKET = 8_000
SEED = "mix"


def words(text: Column) -> Column:
    """The number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from slim rows with source and size; one row a source."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # windows over one row a source
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = by.select("source", "source_size", F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), ((nth - 1) % len(WEIGHTS) + 1).cast("int")).alias("w"))
    w = w.withColumns({"cap": F.col("source_size") * LIMIT, "budget": F.sum("source_size").over(Window.partitionBy()) * SHARE})
    # sources by the level at which they are full; those before the first level that suffices are full
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    full, rest = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = w.withColumn("level", (F.col("budget") - full) / rest).withColumn("fits", F.col("level") <= F.col("cap") / F.col("w"))
    first = F.min(F.when(F.col("fits"), F.struct("nth", "level"))).over(Window.partitionBy())
    at = level.withColumn("nth", F.row_number().over(order)).withColumn("at", first)
    return at.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("at.level") * F.col("w"), F.col("cap"))).alias("target"))


def key() -> Column:
    return F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def planned(sizes: DataFrame) -> DataFrame:
    """Rows (doc_id, source, size) with source_size, target, key, epochs (whole), last (words of the cut epoch) and taken (words)."""
    count = sizes.count()
    digits = 1
    while count > BUCKET * 16**digits:
        digits += 1
    by = targets(sizes)
    rows = sizes.withColumn("key", key()).withColumn("bucket", F.substring("key", 1, digits))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("held"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("offset"))
    both = sums.withColumnRenamed("source", "s").join(by, F.col("s").eqNullSafe(F.col("source"))).drop("s").withColumnsRenamed({"source": "s", "bucket": "b"})
    got = rows.join(both, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    inside = Window.partitionBy("s", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget, epoch = F.round("target").cast("long"), F.greatest("source_size", F.lit(1))
    got = got.withColumns({"start": start, "epochs": F.floor(budget / epoch).cast("long")}).withColumn("left", budget - F.col("epochs") * F.col("source_size"))
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("start")))
    return got.select("doc_id", "source", "size", "source_size", "target", "key", "epochs", last.cast("long").alias("last"), (F.col("epochs") * F.col("size") + last).cast("long").alias("taken"))


def plan(docs: DataFrame) -> DataFrame:
    """planned() for each row with doc_id, text and source."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"))
    return planned(common.written(slim, "sizes"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix in whole documents: each row as often as it is taken, with its own columns only.

    The cut is a place in the order of keys, so a row a source is all that the documents have to meet. The document at
    the cut is kept if at least half of it fits; one without words is kept once, as it costs nothing."""
    names = docs.columns
    own_size, own_source, own_epochs, own_cut, own_times, own_copy = common.fresh(docs, "rw_size", "rw_source", "rw_epochs", "rw_cut", "rw_times", "rw_copy")
    rows = common.written(plan(docs), "plan")
    at = lambda c, d, n: F.struct(c.alias("key"), d.alias("doc_id"), n.alias("size"))
    inside = F.when((F.col("size") > 0) & (F.col("last") * 2 >= F.col("size")), at(F.col("key"), F.col("doc_id"), F.col("size")))
    cuts = common.written(rows.groupBy("source").agg(F.max("epochs").alias(own_epochs), F.max(inside).alias(own_cut)).withColumnRenamed("source", own_source), "cuts")
    both = docs.withColumn(own_size, words(F.col("text"))).join(cuts, F.col("source").cast("string").eqNullSafe(F.col(own_source)))
    more = F.coalesce(at(key(), F.col("doc_id").cast("long"), F.col(own_size)) <= F.col(own_cut), F.lit(False)).cast("int")
    times = F.when(F.col(own_size) == 0, 1).otherwise(F.col(own_epochs) + more).cast("int")
    return both.withColumn(own_times, times).where(F.col(own_times) > 0).withColumn(own_copy, F.explode(F.sequence(F.lit(1), F.col(own_times)))).select(*names)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over all documents."""
    return plan(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op10_mixing": op10_mixing}
ORACLE = {
    "op10_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^ \t-\r]+')) END AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS w
  FROM d GROUP BY source),
c AS (SELECT *, 2.0 * source_size AS cap, 1.5 * sum(source_size) OVER () AS budget FROM s),
l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT level FROM l f WHERE f.level <= f.cap / f.w ORDER BY f.cap / f.w, f.source NULLS LAST LIMIT 1) * w, cap)) AS target FROM l),
k AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
  CAST(budget // greatest(source_size, 1) * size + greatest(0, least(size, budget - budget // greatest(source_size, 1) * source_size - start)) AS BIGINT) AS taken
FROM k
""",
}
