"""Byte-level BPE encoding and decoding through a sentencepiece model serialised from the vocabulary.

Each byte string of the rank file is spelt in printable characters, one a byte, and becomes a piece scored by its
negative rank; normalisation is the identity. A text is cut by the tokenizer's pattern and each match encoded on its own;
decoding maps ids back to bytes. Entries of the vocabulary that merges alone don't reach are encoded by lookup, as
the rank-based encoder does.

Edge cases: a null or empty text has no tokens; special-token strings are ordinary text; long matches cost n log n;
repeated rows and ties don't matter, as a text's ids depend on it alone; an empty table gives an empty result; other
columns are kept by `encode`, `decode` and `round_trip`, but for columns named like their own (bpe_ids, bpe_exact, bpe_bytes), which are
replaced."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskweave.llm import common, vocab

#: Matches that a worker remembers.
CACHE = 150_000


class Codec:
    """encode: text -> ids; decode: ids -> bytes."""

    def __init__(self, path: str, pattern: str) -> None:
        self.words = vocab.byte_ranks(path)
        self.chars = {b: c for b, c in enumerate(vocab.byte_chars())}
        spelt = ["".join(map(self.chars.__getitem__, w)) for w in self.words]
        made = vocab.model([*((s, -float(i), vocab.NORMAL) for i, s in enumerate(spelt)), ("<unk>", 0.0, vocab.UNKNOWN)], vocab.BPE)
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=made)
        self.split = regex.compile(pattern).findall
        self.whole = {w: (i,) for i, (w, got) in enumerate(zip(self.words, self.sp.encode(spelt, num_threads=1), strict=True)) if got != [i]}
        self.known: dict[str, tuple[tuple[int, ...], str]] = {}

    def piece(self, match: str) -> tuple[tuple[int, ...], str]:
        raw = match.encode()
        ids = self.whole.get(raw) or tuple(self.sp.encode("".join(map(self.chars.__getitem__, raw))))
        if len(self.known) >= CACHE:
            self.known.clear()
        got = (ids, " ".join(map(str, ids)))
        if len(raw) <= 64:
            self.known[match] = got
        return got

    def parts(self, text: str | None) -> list[tuple[tuple[int, ...], str]]:
        get, piece = self.known.get, self.piece
        return [get(m) or piece(m) for m in self.split(text or "")]

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(p[0] for p in self.parts(text)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.words.__getitem__, ids))


@functools.cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _setup(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or vocab.tokenizer_path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs with bpe_ids added; a column of that name is replaced."""
    path, pattern = _setup(path, pattern)
    docs = docs.drop("bpe_ids")
    names, schema = docs.columns, StructType([*docs.schema.fields]).add("bpe_ids", _ints())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in common.slices(batches, "text", 4 << 20):
            ids = [c.encode(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "bpe_ids"])

    return docs.mapInArrow(common.lean(run), schema)


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """tokens, which have bpe_ids, with bpe_bytes added; a column of that name is replaced."""
    path, pattern = _setup(path, None)
    tokens = tokens.drop("bpe_bytes")
    names, schema = tokens.columns, StructType([*tokens.schema.fields, *StructType.fromDDL("bpe_bytes binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            raw = [c.decode(i or []) for i in batch.column(batch.schema.get_field_index("bpe_ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], [*names, "bpe_bytes"])

    return tokens.mapInArrow(common.lean(run), schema)


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs with bpe_ids and bpe_exact, whether they decode to the text's bytes, added in one pass; columns of these names are replaced."""
    path, pattern = _setup(path, pattern)
    docs = docs.drop("bpe_ids", "bpe_exact")
    names, schema = docs.columns, StructType([*docs.schema.fields, *StructType.fromDDL("bpe_ids array<int>, bpe_exact boolean").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in common.slices(batches, "text", 2 << 20):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            ids = [c.encode(t) for t in texts]
            exact = [c.decode(i) == (t or "").encode() for i, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(exact, pa.bool_())], [*names, "bpe_ids", "bpe_exact"])

    return docs.mapInArrow(common.lean(run), schema)


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): what encode and decode give, without shipping the ids."""
    path, pattern = _setup(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in common.slices(batches, "text"):
            n, a, b = [], [], []
            for text in batch.column(1).to_pylist():
                parts = c.parts(text)
                ids = list(chain.from_iterable(p[0] for p in parts))
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join([p[1] for p in parts]).encode()).hexdigest())
                b.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(common.lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _ints():
    from pyspark.sql.types import ArrayType, IntegerType

    return ArrayType(IntegerType())


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over all documents."""
    return digests(common.table(spark, sf_dir, "documents"))


QUERIES = {"op7_byte_bpe": op7_byte_bpe}
ORACLE: dict[str, str] = {}
