"""What the corpus operators share: table access, shared-folder writes, bounded Arrow batches, components."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(modulus: int) -> Column:
    """crc32 of the doc_id as text, modulo; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), f"riskweave-{spark.sparkContext.applicationId}")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, so a lost executor costs no rework.

    Parquet rather than checkpoint(): columns can be pruned, and the plan runs once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/riskweave/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """These names, each with as many underscores as it takes not to be a column of docs."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def texts(batch: pa.RecordBatch) -> list[str | None]:
    return batch.column(batch.schema.get_field_index("text")).cast(pa.string()).to_pylist()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, after each partition of which the worker hands back the memory that it no longer uses.

    Workers outlive their tasks, and what allocators keep for them counts against the executor while later stages run."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    """Free memory goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library only
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about `limit` bytes of the text column, or a single longer text."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if batch.num_rows <= 1 or column.nbytes <= limit:
            yield batch
            continue
        lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        start = size = 0
        for i, n in enumerate(lengths):
            if size and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += int(n)
        yield batch.slice(start)


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of edges(a long, b long): (node, root), root being the smallest node reachable.

    Randomised contraction: in each round every node points to the neighbour, itself included, that a keyed
    hash of the round ranks first; edges are relabelled and made distinct. The number of edges falls by a
    constant factor a round whatever the shape of the graph. Minima and distinct rows combine before the
    shuffle and hub nodes only ever sit on the side of a join that Spark can split, so a node with a third of
    all edges isn't gathered anywhere. Nodes without edges aren't returned; loops are ignored."""
    spark = edges.sparkSession
    live = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-e0")
    maps: list[DataFrame] = []
    turn = 0
    while not live.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("n"))
        ends = live.select(F.col("a").alias("v"), F.least(rank("a"), rank("b")).alias("r")).unionByName(live.select(F.col("b").alias("v"), F.least(rank("a"), rank("b")).alias("r")))
        to = written(ends.groupBy("v").agg(F.min("r").alias("r")).select("v", F.col("r.n").alias("r")), f"{name}-m{turn}")
        maps.append(to)
        left = live.join(to.select(F.col("v").alias("a"), F.col("r").alias("ra")), "a").join(to.select(F.col("v").alias("b"), F.col("r").alias("rb")), "b")
        live = written(left.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), f"{name}-e{turn + 1}")
        turn += 1
    if not maps:
        return spark.createDataFrame([], "node long, root long")
    # every node that a later round still knows is the target of an earlier one, so the maps compose left to right
    node = maps[0].select(F.col("v").alias("node"), F.col("r").alias("at"))
    for to in maps[1:]:
        node = node.join(to.withColumnRenamed("v", "at"), "at", "left").select("node", F.coalesce("r", "at").alias("at"))
    node = written(node, f"{name}-n")
    least = node.groupBy("at").agg(F.min("node").alias("root"))
    return node.join(least, "at").select("node", "root")
