"""LM scoring by subword lattice likelihood.

A word's lattice has an arc for each match of a piece of an existing vocabulary; the word's lattice probability is the sum
over all segmentations, by a forward recursion in log space. The vocabulary's scores (ranks) give the first piece
probabilities, proportional to 1 / (rank + 1); forward-backward counts over the distinct training words replace them,
each round over every one. Each training word also has an arc of its own over the
whole word, weighted by its discounted count; the discounts' mass weights the pieces:

    P(word) = max(c - D, 0) / N + D V / N * lattice(word)

with D = n1 / (n1 + 2 n2), 0.95 at most, from the numbers of words seen once and twice. A document's probability is the product over its
words and one end.

Words that make up at least FREQUENT of all tokens are at most 1 / FREQUENT many; they are broadcast and looked up where
the documents are read. The rest of a document's words is sent to the word's own row (count and log probability), each
distinct word being scored once. So no word, however common, is gathered in one task, and nothing unbounded is broadcast.

Edge cases: a null or empty text is one end; characters without a piece are spelt in byte pieces; without training
documents all counts are zero and the vocabulary's own scores stand; rows that repeat a doc_id and text share their
sums; null doc_ids are grouped like any other; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import common, vocab

#: Share of all tokens from which a word is broadcast.
FREQUENT = 1e-6
#: Rounds of forward-backward counts, each over all distinct training words.
ROUNDS = 4
#: Added to a piece's expected count.
SMOOTH = 0.05
#: Distinct words that a worker counts before it hands them on.
HELD = 300_000
#: Rows that a task's piece counts take, and groups in which they are added up.
CHUNKS, SALTS = 16, 16
LN10 = math.log(10)


@dataclass(frozen=True)
class Lattice:
    """Pieces by number, the automaton that finds them (piece number and length), byte pieces and the end."""

    auto: ahocorasick.Automaton
    size: int
    single: frozenset[str]
    byte: tuple[int, ...]
    end: int


@functools.cache
def lattice(path: str) -> Lattice:
    auto, single, byte = ahocorasick.Automaton(), set(), [0] * 256
    rows = vocab.pieces(path)
    for i, (p, _, t) in enumerate(rows):
        if t == vocab.NORMAL:
            auto.add_word(p, (i, len(p)))
            if len(p) == 1:
                single.add(p)
        elif t == vocab.BYTE:
            byte[int(p[3:5], 16)] = i
    auto.make_automaton()
    end = next(i for i, (p, _, t) in enumerate(rows) if t == vocab.CONTROL and p == "</s>")
    return Lattice(auto, len(rows), frozenset(single), tuple(byte), end)


def initial(path: str) -> np.ndarray:
    """Log probabilities of the pieces from the vocabulary's order."""
    weight = np.zeros(len(rows := vocab.pieces(path)))
    order = sorted((i for i, (_, _, t) in enumerate(rows) if t == vocab.NORMAL), key=lambda i: (-rows[i][1], i))
    for rank, i in enumerate(order):
        weight[i] = 1 / (rank + 1)
    for i, (p, _, t) in enumerate(rows):
        if t == vocab.BYTE or (t == vocab.CONTROL and p == "</s>"):
            weight[i] = 1 / (len(order) + 1)
    with np.errstate(divide="ignore"):
        return np.log(weight / weight.sum())


def edges(word: str, lat: Lattice) -> Iterator[tuple[int, int, tuple[int, ...]]]:
    """(start, end, pieces) of all matches in the marked word, by end; a character without a piece is spelt in bytes."""
    text, at, single = vocab.SPACE + word, 0, lat.single
    for last, (piece, n) in lat.auto.iter(text):
        while at < last:
            if text[at] not in single:
                yield at, at + 1, tuple(lat.byte[b] for b in text[at].encode())
            at += 1
        yield last + 1 - n, last + 1, (piece,)
    while at < len(text):
        if text[at] not in single:
            yield at, at + 1, tuple(lat.byte[b] for b in text[at].encode())
        at += 1


def forward(word: str, lat: Lattice, lp: list[float]) -> float:
    """The log probability of the word, summed over all segmentations."""
    text = vocab.SPACE + word
    exp, log1p, none = math.exp, math.log1p, -math.inf
    alpha = [none] * (len(text) + 1)
    alpha[0] = 0.0
    if lat.single.issuperset(text):
        for last, (piece, n) in lat.auto.iter(text):
            x, y = alpha[last + 1 - n] + lp[piece], alpha[last + 1]
            alpha[last + 1] = x if y == none else y + log1p(exp(x - y)) if x < y else x + log1p(exp(y - x))
        return alpha[-1]
    for s, e, ps in edges(word, lat):
        x, y = alpha[s] + sum(map(lp.__getitem__, ps)), alpha[e]
        alpha[e] = x if y == none else y + log1p(exp(x - y)) if x < y else x + log1p(exp(y - x))
    return alpha[-1]


def backward_counts(word: str, lat: Lattice, prob: list[float], out: list[float]) -> None:
    """Adds the expected number of uses of each piece in the word."""
    text = vocab.SPACE + word
    n = len(text)
    if n <= 32 and lat.single.issuperset(text):
        # short enough for plain products
        a, rows = [0.0] * (n + 1), []
        a[0] = 1.0
        for last, (piece, m) in lat.auto.iter(text):
            s, q = last + 1 - m, prob[piece]
            a[last + 1] += a[s] * q
            rows.append((s, last + 1, piece, q))
        if a[n]:
            b = [0.0] * (n + 1)
            b[n] = 1 / a[n]
            for s, e, piece, q in reversed(rows):
                q *= b[e]
                b[s] += q
                out[piece] += a[s] * q
            return
    log, exp, log1p, none = math.log, math.exp, math.log1p, -math.inf
    rows = [(s, e, p, sum(log(prob[i]) if prob[i] else none for i in p)) for s, e, p in edges(word, lat)]
    alpha, beta = [none] * (n + 1), [none] * (n + 1)
    alpha[0] = beta[n] = 0.0
    add = lambda x, y: x if y == none else y if x == none else y + log1p(exp(x - y)) if x < y else x + log1p(exp(y - x))
    for s, e, _, x in rows:
        alpha[e] = add(alpha[s] + x, alpha[e])
    for s, e, _, x in reversed(rows):
        beta[s] = add(beta[e] + x, beta[s])
    for s, e, ps, x in rows:
        got = alpha[s] + x + beta[e] - alpha[n]
        if got > -30:
            for p in ps:
                out[p] += exp(got)


def maximised(counts: np.ndarray, usable: np.ndarray) -> np.ndarray:
    weight = np.where(usable, counts + SMOOTH, 0)
    with np.errstate(divide="ignore"):
        return np.log(weight / weight.sum())


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c, n): uses of each word in training documents and in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, Counter] = {True: Counter(), False: Counter()}

        def out() -> Iterator[pa.RecordBatch]:
            for train, seen in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array([train] * len(seen), pa.bool_()), pa.array(list(seen.values()), pa.int64())], ["word", "train", "n"])
                seen.clear()

        for batch in common.slices(batches, "text"):
            for text, train in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[train].update(tokens(text))
            if len(held[True]) + len(held[False]) > HELD:
                yield from out()
        yield from out()

    got = docs.select("text", "train").mapInArrow(run, "word string, train boolean, n long")
    return got.groupBy("word").agg(F.sum(F.when(F.col("train"), F.col("n")).otherwise(0)).alias("c"), F.sum("n").alias("n"))


def expected(words: DataFrame, path: str, lp: np.ndarray) -> np.ndarray:
    """Expected piece counts over the distinct words. Each task gives its sums in CHUNKS rows, whatever it has read; rows are
    added up in groups of a SALTS-th of the tasks, and the driver gets CHUNKS * SALTS of them."""
    prob = np.exp(lp).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lat = lattice(path)
        out = [0.0] * lat.size
        for batch in batches:
            for w in batch.column(0).to_pylist():
                backward_counts(w, lat, prob, out)
        salt = TaskContext.get().partitionId() % SALTS
        parts = [p.tobytes() for p in np.array_split(np.array(out), CHUNKS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([salt] * CHUNKS, pa.int32()), pa.array(parts, pa.binary())], ["chunk", "salt", "sums"])

    def added(table: pa.Table) -> pa.Table:
        rows = table.column("sums").to_pylist()
        total = np.frombuffer(rows[0], np.float64).copy()
        for r in rows[1:]:
            total += np.frombuffer(r, np.float64)
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    got = words.select("word").mapInArrow(run, "chunk int, salt int, sums binary").groupBy("chunk", "salt").applyInArrow(added, "chunk int, sums binary").collect()
    parts = [np.zeros(len(p)) for p in np.array_split(np.zeros(len(lp)), CHUNKS)]
    for r in got:
        parts[r["chunk"]] += np.frombuffer(r["sums"], np.float64)
    return np.concatenate(parts)


def likelihoods(words: DataFrame, path: str, lp: np.ndarray) -> DataFrame:
    """words(word, c) with the natural log probability lp."""
    probs = lp.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([forward(w, lat, probs) for w in batch.column(0).to_pylist()], pa.float64())], ["word", "c", "lp"])

    return words.select("word", "c").mapInArrow(run, "word string, c long, lp double")


def scored(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of docs(doc_id, text, train)."""
    path = path or vocab.tokenizer_path("piece_bpe_32k.model")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "train")
    spark = docs.sparkSession
    words = common.written(word_counts(docs), "words")
    n_docs = {r["train"]: r["count"] for r in docs.groupBy("train").count().collect()}
    ends = n_docs.get(True, 0)
    seen = lambda k: F.count(F.when(F.col("c") == k, 1))
    sums = words.agg(F.sum("c").alias("c"), F.sum("n").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v"), seen(1).alias("n1"), seen(2).alias("n2")).first()
    total, distinct, every = (sums["c"] or 0) + ends, sums["v"] + (ends > 0), sums["n"] or 0
    discount = min(0.95, sums["n1"] / (sums["n1"] + 2 * sums["n2"])) if sums["n1"] else 0.5
    # at most 1 / FREQUENT rows
    common_words = words.where(F.col("n") >= max(1.0, FREQUENT * every))
    train = words.where("c > 0")
    lp = initial(path)
    usable = np.isfinite(lp)
    lat = lattice(path)
    if total:
        for _ in range(ROUNDS):
            counts = expected(train, path, lp)
            counts[lat.end] += 1
            lp = maximised(counts, usable)
    frequent = {r["word"].encode(): (r["c"], r["lp"]) for r in likelihoods(common_words, path, lp).collect()}
    shared = spark.sparkContext.broadcast(frequent)
    tail = common.written(likelihoods(words.where(F.col("n") < max(1.0, FREQUENT * every)), path, lp), "tail")
    below, end_lp = math.log10(total + 0.5 * (distinct + 1)), float(lp[lat.end])
    rest = discount * distinct / total if total else 1.0
    base = lambda c: math.log10(c + 0.5) - below
    # a word that wasn't seen has the pieces' arcs only; its logarithm doesn't leave log space
    own = lambda c, x: math.log10((c - discount) / total + rest * math.exp(x)) if c else math.log10(rest) + x / LN10

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {w: (c > 0, base(c), own(c, x)) for w, (c, x) in shared.value.items()}
        schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("word", pa.string()), ("tf", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("b", pa.float64()), ("x", pa.float64())])
        for batch in common.slices(batches, "text", 2 << 20):
            cols: list[list] = [[] for _ in schema]
            for key, h, text, train in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                seen = Counter(tokens(text))
                n, k, b, x = 1, int(ends > 0), base(ends), own(ends, end_lp)
                for w, tf in seen.items():
                    got = known.get(w)
                    n += tf
                    if got is None:
                        for c, v in zip(cols, (key, h, w.decode(), tf, None, None, None, None, None), strict=True):
                            c.append(v)
                    else:
                        k += tf * got[0]
                        b += tf * got[1]
                        x += tf * got[2]
                for c, v in zip(cols, (key, h, None, 1, train, n, k, b, x), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    got = docs.select("doc_id", F.xxhash64("text").alias("h"), "text", "train").mapInArrow(run, "doc_id long, h long, word string, tf long, train boolean, n_tokens long, n_known long, b double, x double")
    got = common.written(got, "uses")
    c = F.col("c").cast("double")
    rare = got.where("word is not null").select("doc_id", "h", "word", "tf").join(tail, "word").select("doc_id", "h", (F.col("tf") * (F.col("c") > 0).cast("long")).alias("n_known"), (F.col("tf") * (F.log10(c + 0.5) - below)).alias("b"), (F.col("tf") * F.when(F.col("c") > 0, F.log10((c - discount) / max(1, total) + rest * F.exp("lp"))).otherwise(math.log10(rest) + F.col("lp") / LN10)).alias("x"))
    rare = rare.groupBy("doc_id", "h").agg(F.sum("n_known").alias("n_known"), F.sum("b").alias("b"), F.sum("x").alias("x"))
    mine = got.where("word is null").select("doc_id", "h", "train", "n_tokens", "n_known", "b", "x", F.lit(1).alias("rows"))
    both = mine.unionByName(rare.select("doc_id", "h", F.lit(None).cast("boolean").alias("train"), F.lit(None).cast("long").alias("n_tokens"), "n_known", "b", "x", F.lit(0).alias("rows")))
    # equal rows: their sums are alike, so the mean of each is the sum of one
    by = both.groupBy("doc_id", "h").agg(F.sum("rows").alias("rows"), F.max("train").alias("train"), F.max("n_tokens").alias("n_tokens"), *[F.sum(x).alias(x) for x in ("n_known", "b", "x")])
    by = by.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return by.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", (F.col("n_known") / F.col("rows")).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("b") / F.col("rows")).alias("base_score"), (F.col("x") / F.col("rows")).alias("score"))


def op5_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: learns from the rows whose crc32 modulo 5 isn't 1."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs.withColumn("train", common.fold(5) != 1))


QUERIES = {"op5_lattice_lm": op5_lattice_lm}
ORACLE: dict[str, str] = {}
