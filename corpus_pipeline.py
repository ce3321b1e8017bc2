"""The training-corpus pipeline: toxicity, near-dedup, PII surrogates, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents. The stages
are the operators of riskweave.llm with their production parameters, each over all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import byte_bpe, common, mixing, pii, simhash, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go."""
    return toxicity.keep_clean(docs, common.table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles have a Jaccard similarity of 0.8 or more, transitively, the smallest doc_id stays."""
    return simhash.dedup(docs, 5, 0.8)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes surrogates; n_chars follows the text."""
    out = pii.replaced(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source as often as its target has it."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, bpe_ids, exact): token ids, and whether they decode to the text's bytes."""
    return byte_bpe.round_trip(docs).select("doc_id", "source", F.size("bpe_ids").alias("n_tokens"), "bpe_ids", F.col("bpe_exact").alias("exact"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_neardup", drop_near_duplicates),
    ("pii_surrogates", replace_private),
    ("mixing", mix),
    ("byte_bpe", encode),
]

#: Byte-pair merges and shingle similarity aren't expressible; tests/llm hold the pipeline against planted rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again for the next."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
