"""Toxicity by maximum-scoring segments.

Every token has a log-odds of toxic against clean documents under an informative Dirichlet prior whose weights are
shares of all documents. So that forms of a word that no labelled document has count too, tokens are scored by the
longest of their prefixes (the whole word being the longest) that tells the classes apart by itself: going from long to
short, a prefix whose words lean to a class by a likelihood ratio of LEAST_ROOT squared or more takes its words, and
shorter ones are judged by the rest, or by all their words where several longer ones took some and the rest doesn't differ from these. A word counts in a class as often as there are different words before it (but for
common words, whose documents are counted), so a text that is copied many times isn't many pieces of evidence.

A linear-time scan (Ruzzo and Tompa) over these scores, less a drift that makes neutral text cost something, finds all
maximal segments; a segment's expected number of chance hits in a text of n tokens is K n exp(-lambda S) (Karlin and
Altschul), with lambda from the token scores of clean text and K fitted to the best segments of clean documents.
Segments with few enough are the toxic passages. What they exceed chance by, summed over the document, and the chance that
clean text of this length has a segment as good as the best one (its extreme-value law, which every document has) are
turned into a probability by logistic regression on documents kept apart.

Edge cases: a null or empty text has no passage and gets the score of a text without evidence; labels that are null
or of unknown documents aren't learnt from; repeated labels of a document count once, as toxic if any says so; without
labels of both classes every score is the share of toxic labels (0 without any). `keep_clean` keeps all columns whatever their names;
`scored` replaces columns named like its own, toxic_score and toxic_passages. An empty table gives an empty result."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskweave.llm import common

#: Labelled documents to learn from, of each class, at most.
SAMPLE = 20_000
#: Weight of the prior, in tokens.
PRIOR = 1_000.0
#: Lengths of the prefixes that are scored beside whole words.
PREFIXES = (8, 6, 5, 4, 3, 2)
#: Root of the likelihood ratio by which the words of a prefix must lean to a class.
LEAST_ROOT = 4.0
#: Ends whole words among the prefixes.
END = "|"
#: Words whose score a worker remembers.
CACHE = 200_000
#: What a neutral token costs.
DRIFT = 0.1
#: Chance hits expected in the text below which a segment counts as significant.
MOST_EXPECTED = 0.05
THRESHOLD = 0.3

TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def prefix(word: str, known: dict | set) -> str | None:
    """The longest of the word's prefixes, itself first, that is known."""
    if (whole := word + END) in known:
        return whole
    for k in PREFIXES:
        if k < len(word) and (short := word[:k]) in known:
            return short
    return None


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    log_k: float = 0.0
    coef: tuple[float, float, float] = (0.0, 0.0, 0.0)
    base: float = 0.0
    fitted: bool = False
    memo: dict[str, float | None] = field(default_factory=dict)

    def weight(self, word: str) -> float | None:
        got = self.memo.get(word, self)
        if got is self:
            if len(self.memo) >= CACHE:
                self.memo.clear()
            known = prefix(word, self.weights)
            got = self.memo[word] = None if known is None else self.weights[known]
        return got  # type: ignore[return-value]


def segments(hits: list[tuple[int, float]]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score), in order; hits are (position, score before drift).

    Tokens between hits are worth -DRIFT each. Each hit is merged at most once, so the scan is linear."""
    found: list[tuple[int, int, float, float]] = []  # start, end, cumulative score before and after
    total = 0.0
    for at, score in hits:
        before = total - DRIFT * at
        total += score
        if score <= DRIFT:
            continue
        start, left, right = at, before, total - DRIFT * (at + 1)
        while True:
            # the last segment that begins lower than this one; what lies between can't be part of a better one
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j -= 1
            if j < 0 or found[j][3] >= right:
                found.append((start, at + 1, left, right))
                break
            start, left = found[j][0], found[j][2]
            del found[j:]
    return [(s, e, r - x) for s, e, x, r in found]


def scan(text: str | None, m: Model) -> tuple[list[tuple[int, int, float]], int]:
    """The maximal segments of a text, and its number of tokens."""
    words = tokens(text)
    return segments([(i, w) for i, w in enumerate(map(m.weight, words)) if w is not None]), len(words)


def passages(found: list[tuple[int, int, float]], n: int, m: Model) -> list[tuple[int, int, float, float]]:
    """The significant segments (start, end, score, chance hits) of a text of n tokens."""
    size = m.log_k + math.log(max(1, n))
    return [(s, e, x, math.exp(size - m.lam * x)) for s, e, x in found if size - m.lam * x <= math.log(MOST_EXPECTED)]


def features(scores: list[float], n: int, m: Model) -> tuple[float, float, float]:
    """One, what significant segments exceed chance by, and how unlikely the best one is in clean text, both as logarithms."""
    size = m.log_k + math.log(max(1, n))
    chances = [size - m.lam * x for x in scores]
    best = min(chances, default=size)
    # -log of the chance 1 - exp(-E) that clean text has such a segment, for E = exp(best)
    rare = -best if best < -30 else -math.log(-math.expm1(-math.exp(min(best, 30.0))))
    return 1.0, math.log1p(-sum(c for c in chances if c <= math.log(MOST_EXPECTED))), math.log1p(rare)


def probability(found: list[tuple[int, int, float]], n: int, m: Model) -> float:
    if not m.fitted:
        return m.base
    x = sum(a * b for a, b in zip(m.coef, features([f[2] for f in found], n, m), strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def labelled(labels: DataFrame, column: str, train) -> DataFrame:
    """(doc_id, y): the labelled documents, each once."""
    return labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & train).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).alias("y"))


def sample(known: DataFrame) -> DataFrame:
    """(doc_id, y, part): up to SAMPLE labelled documents of each class, those whose keyed hash is smallest. part 0 and 1 fit tokens, 2 calibrates."""
    key = F.xxhash64(F.col("doc_id"), F.lit("sample"))
    some = [known.where(F.col("y") == y).orderBy(key, "doc_id").limit(SAMPLE) for y in (0, 1)]
    return some[0].unionByName(some[1]).select("doc_id", "y", F.pmod(F.xxhash64("doc_id"), F.lit(3)).cast("int").alias("part"))


def _counts(docs: DataFrame) -> DataFrame:
    """(word, t, c): uses of each word in toxic and in clean documents, in different contexts.

    Contexts are counted by a set of 64 bits, to which the word before sets one; once it is full, documents are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[dict[str, list[int]], dict[str, list[int]]] = ({}, {})

        def out() -> pa.RecordBatch:
            rows = [(w, y, n, bits - (bits >> 63 << 64)) for y in (0, 1) for w, (n, bits) in seen[y].items()]
            seen[0].clear(), seen[1].clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64()))], ["word", "y", "n", "bits"])

        for batch in common.slices(batches, "text"):
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own: dict[str, int] = {}
                before = 0
                for w in tokens(text):
                    own[w] = own.get(w, 0) | 1 << before
                    before = zlib.crc32(w.encode()) & 63
                for w, bits in own.items():
                    got = seen[y].get(w)
                    if got is None:
                        seen[y][w] = [1, bits]
                    else:
                        got[0] += 1
                        got[1] |= bits
                if len(seen[0]) + len(seen[1]) > 200_000:
                    yield out()
        yield out()

    full = F.bit_count("bits")
    uses = F.when(full >= 60, F.col("n")).otherwise(F.least(F.col("n"), -64 * F.log(1 - F.least(full, F.lit(60)) / 64)))
    got = docs.select("text", F.col("y").cast("int").alias("y")).mapInArrow(common.lean(run), "word string, y int, n long, bits long")
    got = got.groupBy("word", "y").agg(F.sum("n").alias("n"), F.bit_or("bits").alias("bits")).withColumn("uses", uses)
    return got.groupBy("word").agg(F.sum(F.when(F.col("y") == 1, F.col("uses")).otherwise(0.0)).alias("t"), F.sum(F.when(F.col("y") == 0, F.col("uses")).otherwise(0.0)).alias("c"))


def leaning(t: float, c: float, nt: float, nc: float) -> float:
    """Twice the logarithm of the likelihood ratio that t and c uses of nt and nc lean to a class."""
    of = (t + c) / (nt + nc) if nt + nc else 0.0
    return 2 * ((t * math.log(t / (of * nt)) if t > 0 and nt > 0 else 0.0) + (c * math.log(c / (of * nc)) if c > 0 and nc > 0 else 0.0))


def telling(rows: DataFrame, nt: float, nc: float) -> dict[str, tuple[float, float]]:
    """The prefixes and whole words that lean to a class, with the uses (toxic, clean) of the words they take.

    rows(word, t, c) hold nt and nc uses. Only what leans by all its words, and what that is a form of, can lean by the
    words left to it; these few come to the driver. They are bounded by the sample's uses over LEAST_ROOT squared."""
    short = F.transform(F.filter(F.array(*map(F.lit, PREFIXES)), lambda k: k < F.length("word")), lambda k: F.substring("word", F.lit(1), k))
    sums = rows.select(F.explode(short).alias("node"), "t", "c").groupBy("node").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    sums = common.written(sums.unionByName(rows.select(F.concat("word", F.lit(END)).alias("node"), "t", "c")), "toxic-nodes")
    both = F.col("t") + F.col("c")
    term = lambda n, of: F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n) / (both * (of / (nt + nc))))).otherwise(0.0)
    left = {r["node"]: [r["t"], r["c"]] for r in sums.where(2 * (term("t", nt) + term("c", nc)) >= 0.99 * LEAST_ROOT**2).collect()}
    above = lambda node: [word[:k] for k in PREFIXES if k < len(word := node.removesuffix(END))]
    missing = sorted({x for node in left for x in above(node)} - left.keys())
    if missing:
        wanted = rows.sparkSession.createDataFrame(pa.table({"node": pa.array(missing, pa.string())}))
        left |= {r["node"]: [r["t"], r["c"]] for r in sums.join(wanted, "node", "left_semi").collect()}
    found: dict[str, tuple[float, float]] = {}
    whole, branches = {x: tuple(v) for x, v in left.items()}, Counter()
    for node in sorted(left, key=lambda x: (not x.endswith(END), -len(x), x)):
        t, c = (max(0.0, v) for v in left[node])
        uses = (t, c)
        if branches[node] > 1:
            gone = whole[node][0] - t, whole[node][1] - c
            if leaning(t, c, *whole[node]) + leaning(*gone, *whole[node]) < LEAST_ROOT**2:
                uses = whole[node]
        longer = above(node)
        if sum(uses) and leaning(*uses, nt, nc) >= LEAST_ROOT**2:
            found[node] = uses
            for x in longer:
                left[x][0] -= t
                left[x][1] -= c
            branches[node] = 1
        if longer:
            branches[longer[0]] += branches[node]
    return found


def _background(docs: DataFrame, known: dict) -> dict[str, int]:
    """How many distinct words of all documents, one by one, each known prefix takes; the key "" has the number of all."""
    names = set(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        memo: dict[str, str | None] = {}
        for batch in common.slices(batches, "text"):
            for text in batch.column(0).to_pylist():
                own = set(tokens(text))
                seen[""] += len(own)
                if len(memo) >= CACHE:
                    memo.clear()
                for w in own:
                    got = memo.get(w, "")
                    if got == "":
                        got = memo[w] = prefix(w, names)
                    if got is not None:
                        seen[got] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    return {r["word"]: r["n"] for r in docs.select("text").mapInArrow(common.lean(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}


def fit(docs: DataFrame, labels: DataFrame, train=None) -> Model:
    """Learns from the labelled documents for which `train`, a condition on labels, holds (all without it).

    Tokens and curve are learnt from a sample bounded by class; the classes' shares are those of all labelled documents."""
    train = F.lit(True) if train is None else train
    every = labelled(labels, "toxic", train)
    known = common.written(sample(every), "toxic-sample")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = common.written(docs.join(F.broadcast(known), "doc_id"), "toxic-docs")  # at most 2 * SAMPLE rows of known
    size = {r["y"]: r["count"] for r in own.groupBy("y").count().collect()}
    total = {r["y"]: r["count"] for r in docs.select("doc_id").join(every, "doc_id").groupBy("y").count().collect()}
    m = Model(base=total.get(1, 0) / max(1, sum(total.values())))
    if len(size) < 2:
        return m
    rows = common.written(_counts(own.where("part < 2")), "toxic-counts")
    totals = rows.agg(F.sum("t").alias("t"), F.sum("c").alias("c")).first()
    if not totals["t"] or not totals["c"]:
        return m
    nt, nc = float(totals["t"]), float(totals["c"])
    found = telling(rows, nt, nc)
    seen = _background(docs, found)
    spread, lam_terms, rest = max(1, seen.get("", 1)), [], 1.0
    for w, (t, c) in found.items():
        alpha = PRIOR * max(1, seen.get(w, 0)) / spread
        odds = lambda n, of, a=alpha: math.log((n + a) / max(1e-9, of + PRIOR - n - a))
        m.weights[w] = odds(t, nt) - odds(c, nc)
        share = (c + alpha) / (nc + PRIOR)
        lam_terms.append((share, m.weights[w] - DRIFT))
        rest -= share
    m.lam = _decay(lam_terms, max(0.0, rest))
    model = m

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            got = [scan(t, model) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([[x[2] for x in f] for f, _ in got], pa.list_(pa.float64())), pa.array([n for _, n in got], pa.int64())], ["y", "scores", "n"])

    # at most 2 * SAMPLE rows; of a text's segments those that could be significant for any K in use, and the best
    scores = F.expr(f"filter(scores, x -> x = array_max(scores) or {m.lam} * x >= ln(n) - 12 - ln({MOST_EXPECTED}))")
    got = own.where("part = 2").select("text", F.col("y").cast("int").alias("y")).mapInArrow(common.lean(run), "y int, scores array<double>, n long").select("y", scores.alias("scores"), "n").collect()
    # the mean of a Gumbel law: lambda S - ln n has the mean ln K + Euler's constant; clean texts without any hit fall below all chance
    calm = [m.lam * max(r["scores"], default=0.0) - math.log(r["n"]) for r in got if r["y"] == 0 and r["n"]]
    m.log_k = max(-12.0, min(0.0, (sum(calm) / len(calm) if calm else 0.0) - 0.5772156649))
    if len({r["y"] for r in got}) == 2:
        x = np.array([features(r["scores"], r["n"], m) for r in got])
        y = np.array([r["y"] for r in got])
        # a class that the sample cuts weighs what all its documents do
        weight = np.where(y == 1, total[1] / size[1], total[0] / size[0])
        m.coef, m.fitted = _rising(x, y.astype(float), weight / weight.mean()), True
    m.memo.clear()
    return m


def _rising(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Logistic coefficients, those of evidence not below zero."""
    use = np.ones(3)
    while True:
        w = logistic(x * use, y, weight) * use
        if (w[1:] >= 0).all():
            return tuple(map(float, w))  # type: ignore[return-value]
        use[1 + int(np.argmin(w[1:]))] = 0


def _decay(terms: list[tuple[float, float]], rest: float) -> float:
    """The positive solution of sum p exp(lambda s) = 1."""
    p, s = np.array([*(t[0] for t in terms), rest]), np.array([*(t[1] for t in terms), -DRIFT])
    if not (s > 0).any():
        return 1.0
    f = lambda lam: float(p @ np.exp(np.minimum(lam * s, 500)) - 1)
    lo, hi = 1e-3, 1e-3
    while f(hi) < 0 and hi < 50:
        lo, hi = hi, hi * 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return max(0.05, hi)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | float = 1.0, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps of a logistic regression, rows weighted."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (weight * (p - y)) + ridge * w)
    return w


def scored(docs: DataFrame, m: Model) -> DataFrame:
    """docs with toxic_score and toxic_passages (token start, token end, score, chance hits); columns of these names are replaced."""
    docs = docs.drop("toxic_score", "toxic_passages")
    names = docs.columns
    schema = StructType([*docs.schema.fields, *StructType.fromDDL("toxic_score double, toxic_passages array<struct<start:int,end:int,score:double,expected:double>>").fields])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            found = [scan(t, m) for t in common.texts(batch)]
            parts = [[dict(zip(("start", "end", "score", "expected"), p, strict=True)) for p in passages(f, n, m)] for f, n in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([probability(f, n, m) for f, n in found], pa.float64()), pa.array(parts, kind)], [*names, "toxic_score", "toxic_passages"])

    return docs.mapInArrow(common.lean(run), schema)


def keep_clean(docs: DataFrame, labels: DataFrame, train=None) -> DataFrame:
    """The documents scored below THRESHOLD, with all their columns."""
    m = fit(docs, labels, train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            yield batch.filter(pa.array([probability(*scan(t, m), m) < THRESHOLD for t in common.texts(batch)], pa.bool_()))

    return docs.mapInArrow(common.lean(run), docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: learns from the rows whose crc32 modulo 4 isn't 2."""
    docs, labels = common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "labels")
    got = scored(docs, fit(docs, labels, common.fold(4) != 2))
    score = F.col("toxic_score")
    return got.select("doc_id", (common.fold(4) == 2).alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"), F.size("toxic_passages").alias("n_passages"))


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLE: dict[str, str] = {}
