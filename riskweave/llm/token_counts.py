"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton lists all vocabulary matches by their end. Dynamic programming carries for each position the
best score and its number of pieces. The ties are those of the sentencepiece unigram encoder: it goes through starts in
order and replaces only what is strictly worse, so of equal scores the earliest start wins; a character without a piece
of its own costs the worst score less 10 and counts as its bytes. No piece has a space sign after another character, so
texts are cut before such spaces and each chunk is searched once and remembered.

Edge cases: a null or empty text has no tokens; repeated rows count alike; long chunks cost time in proportion to their
length; an empty table gives an empty result; other columns are kept by `counted`, whose column is n_tokens (a column of that name is
replaced)."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskweave.llm import common, vocab

CACHE = 300_000
UNKNOWN_PENALTY = 10.0
NEVER = -1e6


def floored(pieces: list[tuple[str, float, int]]) -> list[tuple[str, float, int]]:
    """The lone space sign is stored with a score of -1e9, beside which 32-bit sums can't tell other scores apart: pieces below NEVER get the worst other score less 1."""
    worst = min(s for _, s, t in pieces if t == vocab.NORMAL and s > NEVER) - 1
    return [(p, worst if t == vocab.NORMAL and s <= NEVER else s, t) for p, s, t in pieces]


class Counter:
    """Piece counts under a sentencepiece model file's pieces and scores."""

    def __init__(self, path: str) -> None:
        self.auto = ahocorasick.Automaton()
        normal = [(p, s) for p, s, t in floored(vocab.pieces(path)) if t == vocab.NORMAL]
        for p, s in normal:
            self.auto.add_word(p, (len(p), s))
        self.auto.make_automaton()
        self.single = {p for p, _ in normal if len(p) == 1}
        self.unknown = min(s for _, s in normal) - UNKNOWN_PENALTY
        if any(re.search(f"[^{vocab.SPACE}]{vocab.SPACE}", p) for p, _ in normal):
            raise ValueError("a piece crosses a space; chunks wouldn't be independent")
        self.split = re.compile(f"{vocab.SPACE}*[^{vocab.SPACE}]+|{vocab.SPACE}+").findall
        self.known: dict[str, int] = {}

    def chunk(self, text: str) -> int:
        """Pieces of the best segmentation of one chunk."""
        n = len(text)
        best: list[float | None] = [None] * (n + 1)
        count, since = [0] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        at = 0  # positions up to here are final
        single = self.single

        def unknown(upto: int) -> None:
            nonlocal at
            while at < upto:
                ch = text[at]
                if ch not in single:
                    score, old = best[at] + self.unknown, best[at + 1]  # type: ignore[operator]
                    # of equal scores the earlier start wins, and this is the latest start for the end
                    if old is None or score > old:
                        best[at + 1], count[at + 1], since[at + 1] = score, count[at] + len(ch.encode()), at
                at += 1

        for end, (size, piece) in self.auto.iter(text):
            # every end before this one is complete once its unknown character has been tried
            unknown(end)
            start = end + 1 - size
            score, old = best[start] + piece, best[end + 1]  # type: ignore[operator]
            if old is None or score > old or (score == old and start < since[end + 1]):
                best[end + 1], count[end + 1], since[end + 1] = score, count[start] + 1, start
        unknown(n)
        return count[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        total, known = 0, self.known
        for chunk in self.split(vocab.SPACE + text.replace(" ", vocab.SPACE)):
            got = known.get(chunk)
            if got is None:
                got = self.chunk(chunk)
                if len(chunk) <= 64:
                    if len(known) >= CACHE:
                        known.clear()
                    known[chunk] = got
            total += got
        return total


@functools.cache
def counter(path: str) -> Counter:
    return Counter(path)


def counted(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with n_tokens added."""
    path = path or vocab.tokenizer_path("piece_bpe_32k.model")
    docs = docs.drop("n_tokens")
    names, schema = docs.columns, StructType([*docs.schema.fields, *StructType.fromDDL("n_tokens long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in common.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.count(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()], pa.int64())], [*names, "n_tokens"])

    return docs.mapInArrow(run, schema)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens) of all documents."""
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return counted(docs).select("doc_id", "n_tokens")


QUERIES = {"op8_token_counts": op8_token_counts}
ORACLE: dict[str, str] = {}
