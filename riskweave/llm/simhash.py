"""SimHash near-dedup over a byte-position inverted index with count filtering.

A fingerprint is a row of positional bytes. Each distinct fingerprint is indexed under sets of positional bytes. For
every pair that meets under a set the positional bytes in common are tallied; pairs that reach the minimum are kept and
verified. Lists of a single positional byte would hold 1/256 of all rows each and be tallied quadratically, so an index
entry joins several bytes:

* exact mode (bits, max_distance d): two fingerprints that differ in at most d bits share at least bytes - d positional
  bytes, which is the minimum of the tally. The index has sets of bytes - d - 1 bytes such that whichever d bytes differ some set is
  without them, so no link is missed. A long list is dealt out by one more positional byte, of which such a pair shares one
  at least; that leaves d bytes free, which bounds a list by 256**d distinct fingerprints.
* similarity mode: wide fingerprints under `PAIRS` pairs of bytes find candidates for a Jaccard similarity, which is
  then verified on the documents' whole sets of shingle hashes. Bits that may differ outnumber the bytes there, so the
  tally has no guaranteed minimum beyond the pair of the index. Rows move once for all pairs of bytes that have one byte in
  common (`pivots`), as a group from which the lists are made where they are compared; only large groups and those with a
  long list move once a pair.

A pair is taken in the first list that it shares only, and a list gives a spanning forest of its pairs, so rows that
are found stay in proportion to fingerprints however dense a group is.

Edge cases, for both: a null text counts as empty; texts without words share the fingerprint zero and so one group;
repeated rows and equal texts fall into one group; an empty table gives an empty result; other columns are ignored
(`fingerprints`) or kept, whatever their names (`dedup`). Long texts are hashed in blocks, so memory is bounded by the text itself.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import common

#: A list longer than this is dealt out: by a further byte, or in blocks that meet pairwise.
BLOCK = 4096
#: Up to this many rows of a list, all its pairs are compared in one vector step per offset.
SHORT = 48
#: One fingerprint in so many tells which lists are long.
PROBE = 16
#: Long lists, at most, whose table is broadcast; more are joined by key.
BROADCAST = 50_000
#: Nodes with a candidate, at most, whose ids (8 bytes each) are broadcast to pick their texts; more are joined by key.
PICKED = 4_000_000
#: Rows that agree in one positional byte, at most, that move as one group for all lists with that byte.
GROUPED = 1 << 18
#: Rows of a group of candidates that are compared in one block, at least.
GROUP = 256
#: Pairs of positional bytes that index a 256-bit fingerprint in similarity mode.
PAIRS = 96
#: Of these, so many are taken before what they connect is left out.
FIRST = 8
#: Sets of up to so many shingle hashes are kept by their upper halves, which hardly ever agree by chance then; larger ones whole.
NARROW = 1024


def shingles(words: list[bytes], k: int) -> list[bytes]:
    """All k-word shingles, repeats included; fewer words: the whole sequence; none: nothing."""
    if not words:
        return []
    if len(words) <= k:
        return [b" ".join(words)]
    return [b" ".join(x) for x in zip(*(words[i:] for i in range(k)), strict=False)]


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the unsigned 64-bit values have each bit set, lowest bit first."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        part = np.unpackbits(h[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += part.sum(axis=0, dtype=np.int64)
    return total


def hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 with seed 42 of each shingle."""
    parts = shingles((text or "").encode().lower().split(), k)
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, itertools.repeat(42)), np.uint64, len(parts))


def fingerprint(h: np.ndarray, words64: int = 1) -> np.ndarray:
    """words64 unsigned words; a bit is set if it is in over half of the hashes. Words after the first use remixed hashes."""
    out = np.zeros(words64, np.uint64)
    for j in range(words64):
        x = h if j == 0 else mixed(h ^ np.uint64((0x9E3779B97F4A7C15 * j) & (2**64 - 1)))
        out[j] = np.packbits(bit_counts(x) * 2 > len(x), bitorder="little").view("<u8")[0] if len(x) else 0
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: independent bits from the same hash."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def fingerprints(docs: DataFrame, k: int = 3, words64: int = 1, distinct: bool = False) -> DataFrame:
    """(doc_id, fp binary[, digest binary]) for each row with doc_id and text.

    If distinct, a shingle counts once however often it occurs, as in the Jaccard similarity that the fingerprint
    stands for; the digest names the set of distinct shingles."""
    schema = "doc_id long, fp binary" + (", digest binary" if distinct else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            fps, digests = [], []
            for text in batch.column(1).to_pylist():
                h = hashes(text, k)
                if distinct:
                    h = np.unique(h)
                    digests.append(digest(h))
                fps.append(fingerprint(h, words64).astype("<u8").tobytes())
            cols = [batch.column(0), pa.array(fps, pa.binary())]
            names = ["doc_id", "fp"]
            if distinct:
                cols.append(pa.array(digests, pa.binary()))
                names.append("digest")
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(common.lean(run), schema)


def digest(h: np.ndarray) -> bytes:
    """A name for a set of hashes, given distinct and sorted."""
    return xxhash.xxh3_128_digest(h.astype("<u8").tobytes())


def shingle_sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """nodes(id, digest, fp) with hashes, the bytes of the set of distinct shingle hashes, and n_shingles, their number.

    The sets are made from the texts again, of the documents that name a node only. These are picked where texts are read, while
    their ids can be broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            names, kept, sizes = [], [], []
            for text in batch.column(1).to_pylist():
                h = np.unique(hashes(text, k))
                names.append(digest(h))
                kept.append((np.unique(h >> np.uint64(32)).astype("<u4") if len(h) <= NARROW else h.astype("<u8")).tobytes())
                sizes.append(len(h))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.binary()), pa.array(sizes, pa.int32()), pa.array(kept, pa.binary())], ["id", "digest", "n_shingles", "hashes"])

    ids = nodes.select("id")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    made = texts.join(F.broadcast(ids) if ids.count() <= PICKED else ids, "id", "left_semi").mapInArrow(common.lean(run), "id long, digest binary, n_shingles int, hashes binary")
    # rows may be repeated, and other texts may have the same doc_id
    made = made.groupBy("id", "digest").agg(F.min("n_shingles").alias("n_shingles"), F.min("hashes").alias("hashes"))
    return made.join(nodes.select("id", "digest", "fp"), ["id", "digest"]).select("id", "digest", "fp", "n_shingles", "hashes")


def byte_sets(n_bytes: int, max_distance: int | None) -> list[tuple[int, ...]]:
    """The sets of byte positions that index a fingerprint."""
    if max_distance is None:
        every = list(itertools.combinations(range(n_bytes), 2))
        return [every[i] for i in np.random.default_rng(1).permutation(len(every))[: min(PAIRS, len(every))]]
    # what a set leaves out: positions so chosen that any max_distance of them are left out together by some set
    left = set(itertools.combinations(range(n_bytes), max_distance))
    out = []
    while left:
        best = max(itertools.combinations(range(n_bytes), max_distance + 1), key=lambda x: (sum(y in left for y in itertools.combinations(x, max_distance)), x))
        left -= set(itertools.combinations(best, max_distance))
        out.append(tuple(i for i in range(n_bytes) if i not in best))
    return out


def pivots(sets: list[tuple[int, ...]], some: range) -> dict[int, list[int]]:
    """The sets of `some`, each under one of its positions; few positions in all."""
    left, out = list(some), {}
    while left:
        count = Counter(p for i in left for p in sets[i])
        best = max(count, key=lambda p: (count[p], -p))
        out[best] = [i for i in left if best in sets[i]]
        left = [i for i in left if best not in sets[i]]
    return out


def _group(p: int) -> Column:
    return F.xxhash64(F.lit(p), F.substring("fp", p + 1, 1))


def grouped(fps: DataFrame, pivot: dict[int, list[int]]) -> DataFrame:
    """A row (g, p, ...) of fps(id, fp, ...) for each pivot p; g names p and the byte there."""
    entry = [F.struct(_group(p).alias("g"), F.lit(p).cast("short").alias("p")) for p in pivot]
    return fps.select(F.explode(F.array(*entry)).alias("e"), *fps.columns).select("e.g", "e.p", *fps.columns)


def probed(fps: DataFrame) -> DataFrame:
    return fps.where(F.pmod(F.xxhash64("id", F.lit("probe")), F.lit(PROBE)) == 0)


def wide_groups(fps: DataFrame, sets: list[tuple[int, ...]], pivot: dict[int, list[int]]) -> DataFrame:
    """(g): the groups of over GROUPED rows or with a list of over BLOCK rows, as estimated from one fingerprint in PROBE. A pivot has 256 groups at most."""
    long = indexed(probed(fps), sets, pivot).groupBy("g", "key").agg((F.count("*") * PROBE).alias("n")).where(F.col("n") > BLOCK).select("g")
    large = grouped(probed(fps), pivot).groupBy("g").agg((F.count("*") * PROBE).alias("n")).where(F.col("n") > GROUPED).select("g")
    return common.written(long.unionByName(large).distinct(), "wide-groups")


def indexed(fps: DataFrame, sets: list[tuple[int, ...]], some: range | dict[int, list[int]]) -> DataFrame:
    """The inverted index of fps(id, fp, ...): a row (key, s, ...) for each set s of positional bytes of `some`; of pivots also g, the group."""
    at = [(i, {"g": _group(p)}) for p, x in some.items() for i in x] if isinstance(some, dict) else [(i, {}) for i in some]
    entry = [F.struct(F.xxhash64(F.lit(i), F.concat(*[F.substring("fp", p + 1, 1) for p in sets[i]])).alias("key"), F.lit(i).cast("short").alias("s"), *[v.alias(k) for k, v in more.items()]) for i, more in at]
    return fps.select(F.explode(F.array(*entry)).alias("e"), *fps.columns).select("e.*", *fps.columns)


def with_long_lists(fps: DataFrame, sets: list[tuple[int, ...]], some: range | dict[int, list[int]], wide: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """The index, of the groups `wide` only if given, with parts, the number of blocks of a list over BLOCK rows and null for others, and whether there is such a list.

    Which lists are that long is estimated from one fingerprint in PROBE; the estimate decides how work is dealt out, never
    what is compared. Blocks grow with the root of a list, so that the copies of its rows are in proportion to the power 1.5."""
    lists = lambda rows: indexed(rows, sets, some) if wide is None else indexed(rows, sets, some).join(F.broadcast(wide), "g", "left_semi").drop("g")
    probe = lists(probed(fps)).groupBy("key").agg((F.count("*") * PROBE).alias("n"))
    hot = common.written(probe.where(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / F.greatest(F.lit(BLOCK), F.sqrt("n") * 64)).cast("int").alias("parts")), "long-lists")
    index = lists(fps)
    if not (n_hot := hot.count()):
        return index.withColumn("parts", F.lit(None).cast("int")), False
    return index.join(F.broadcast(hot) if n_hot <= BROADCAST else hot, "key", "left"), True


def exact_candidates(fps: DataFrame, n_bytes: int, most: int) -> DataFrame:
    """(a, b, d): a part of the pairs of fps(id, fp) that differ in `most` bits or fewer (d), which connects at any smaller distance too what all do."""
    sets = byte_sets(n_bytes, most)
    index, _ = with_long_lists(fps.select("id", "fp"), sets, range(len(sets)))
    # the positions that a set leaves out: a link shares one of them at least
    table = F.array(*[F.array(*[F.lit(p).cast("short") for p in range(n_bytes) if p not in x]) for x in sets])
    deep = F.when(F.col("parts").isNull(), F.array(F.lit(-1).cast("short"))).otherwise(F.element_at(table, F.col("s").cast("int") + 1))
    got = index.select("key", "s", F.explode(deep).alias("r"), "id", "fp")
    key = F.when(F.col("r") < 0, F.col("key")).otherwise(F.xxhash64("key", "r", F.substr("fp", F.col("r") + 1, F.lit(1))))
    return pairs(got.select(key.alias("key"), "s", "r", "id", "fp", F.col("id").alias("label")), sets, most, n_bytes - most, True)


def similar_candidates(fps: DataFrame, sets: list[tuple[int, ...]], most: int) -> DataFrame:
    """(a, b, d): a part of the pairs of fps(id, fp) that share a set and differ in `most` bits or fewer (d), which connects what all do.

    After the first sets only pairs of rows that aren't connected yet are sought, so a dense group gives rows for a few lists only."""
    found: list[DataFrame] = []

    def labelled() -> DataFrame:
        every = found[0]
        for x in found[1:]:
            every = every.unionByName(x)
        root = common.components(every.select("a", "b"), "lists").select(F.col("node").alias("id"), "root")
        return fps.select("id", "fp").join(root, "id", "left").select("id", "fp", F.coalesce("root", "id").alias("label"))

    for some in (range(min(FIRST, len(sets))), range(FIRST, len(sets))):
        if not some:
            break
        rows = fps.select("id", "fp", F.col("id").alias("label")) if not found else common.written(labelled(), "labelled")
        pivot = pivots(sets, some)
        wide, groups = wide_groups(rows, sets, pivot), grouped(rows, pivot)
        some_wide = not wide.isEmpty()
        if some_wide:
            groups = groups.join(F.broadcast(wide), "g", "left_anti")
        moved = groups.select(F.col("g").alias("key"), F.col("p").alias("s"), F.lit(-1).cast("short").alias("r"), "id", "fp", "label")
        found.append(common.written(pairs(moved, sets, most, 2, False, pivot), "groups"))
        if not some_wide:
            continue
        index, split = with_long_lists(rows, sets, pivot, wide)
        part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
        own = F.when(F.col("parts").isNull(), F.col("key")).otherwise(F.xxhash64("key", part, part))
        found.append(common.written(pairs(index.select(own.alias("key"), "s", F.lit(-1).cast("short").alias("r"), "id", "fp", "label"), sets, most, 2, False), "own-blocks"))
        if split:
            # blocks of one list meet, r being the side
            index, _ = with_long_lists(common.written(labelled(), "labelled"), sets, pivot, wide)
            rows = index.where("parts is not null").withColumn("p", part).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("o <> p")
            meet = rows.select(F.xxhash64("key", F.least("p", "o"), F.greatest("p", "o")).alias("key"), "s", (F.col("p") > F.col("o")).cast("short").alias("r"), "id", "fp", "label")
            found.append(common.written(pairs(meet, sets, most, 2, False), "met-blocks"))
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    return every


def thinned(u: np.ndarray, v: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Which of the links (u, v) at d differing bits between n rows form a minimum spanning forest (Boruvka)."""
    keep = np.zeros(len(u), bool)
    label = np.arange(n)
    order = np.argsort(d, kind="stable")
    rank = np.empty(len(u), np.int64)
    rank[order] = np.arange(len(u))
    live = np.arange(len(u))
    while len(live):
        a, b = label[u[live]], label[v[live]]
        live = live[a != b]
        if not len(live):
            break
        a, b = label[u[live]], label[v[live]]
        first = np.full(n, len(u))
        np.minimum.at(first, a, rank[live])
        np.minimum.at(first, b, rank[live])
        picked = order[np.unique(first[first < len(u)])]
        keep[picked] = True
        # each component takes the smaller label over its picked links, until nothing changes
        a, b = label[u[picked]], label[v[picked]]
        root = np.arange(n)
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        label = root[label]
    return keep


def near(ids: np.ndarray, fps: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All pairs (i, j, differing bits) of rows of one list at `most` bits or fewer, in parts, each once.

    Where few bits vary, every way to flip `most` of them is looked up; otherwise rows are compared."""
    n, width = fps.shape
    free = np.bitwise_or.reduce(fps ^ fps[0], axis=0)
    bits = [i for i in range(64) if int(free[0]) >> i & 1] if width == 1 else []
    flips = sum(len(list(itertools.combinations(bits, k))) for k in range(1, most + 1)) if width == 1 and most <= 2 else n
    if flips * 8 < n:
        order = np.argsort(fps[:, 0], kind="stable")
        x = fps[order, 0]
        for k in range(1, most + 1):
            for flip in itertools.combinations(bits, k):
                other = x ^ np.uint64(sum(1 << i for i in flip))
                at = np.searchsorted(x, other)
                found = np.flatnonzero((at < n) & (x[np.minimum(at, n - 1)] == other) & (other > x))
                if len(found):
                    yield order[found], order[at[found]], np.full(len(found), k)
        return
    step = max(1, (1 << 20) // (n * width))
    for at in range(0, n, step):
        upto = min(n, at + step)
        d = np.bitwise_count(fps[at:upto, None, :] ^ fps[None, at:, :]).sum(axis=2, dtype=np.int16)
        i, j = np.nonzero(d <= most)
        ok = j > i
        yield i[ok] + at, j[ok] + at, d[i[ok], j[ok]].astype(np.int64)


def pairs(blocks: DataFrame, sets: list[tuple[int, ...]], most: int, min_bytes: int, deep: bool, pivot: dict[int, list[int]] | None = None) -> DataFrame:
    """(a, b, d) of rows (key, s, r, id, fp, label): of each list, which is a key, a minimum spanning forest of its pairs of
    different labels at `most` differing bits or fewer whose tally of shared positional bytes is at least min_bytes.

    A pair counts in the first set s that it shares only. r is -1, or if deep a further positional byte of the list's, and a
    pair counts in the first of these it shares only, or else a side, and pairs of different sides count. With pivots a key
    is a group and s its pivot; the lists of a group are made here, one for each set under the pivot and byte beside it.

    Any threshold on the differing bits up to `most` connects the same rows by the forest as by all pairs. That holds for
    bits only: links by another measure are sought among all the rows that the forests connect (`within`)."""
    spots = np.array(sets)
    rest = np.array([[p for p in range(spots.max() + 1) if p not in x] for x in sets]) if deep else None
    # by pivot, its sets and the other byte of each
    under = np.full((spots.max() + 1, max(map(len, pivot.values()))), -1) if pivot else None
    beside = np.zeros_like(under) if pivot else None
    for p, at in (pivot or {}).items():
        under[p, : len(at)] = at
        beside[p, : len(at)] = [sum(sets[i]) - p for i in at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def counted(u: np.ndarray, v: np.ndarray, cols: list[np.ndarray]) -> np.ndarray:
            """Which of the pairs of rows count: the tally, the first list, and sides or labels."""
            _, s, r, ids, fps, label = cols
            out = np.zeros(len(u), bool)
            use = np.flatnonzero(label[u] != label[v])
            for at in range(0, len(use), 1 << 14):
                part = use[at : at + (1 << 14)]
                a, b = u[part], v[part]
                same = (fps[a] ^ fps[b]).view(np.uint8) == 0
                ok = (same.sum(axis=1) >= min_bytes) & (same[:, spots].all(axis=2).argmax(axis=1) == s[a])
                at_r = np.flatnonzero(r[a] >= 0)
                if deep and len(at_r):
                    own = rest[s[a[at_r]]]
                    ok[at_r] &= own[np.arange(len(at_r)), np.take_along_axis(same[at_r], own, axis=1).argmax(axis=1)] == r[a[at_r]]
                elif len(at_r):
                    ok &= r[a] != r[b]
                out[part] = ok
            return out

        def some(cols: list[np.ndarray]) -> pa.RecordBatch:
            key, _, _, ids, fps, label = cols
            # rows of one label are one node
            node = np.unique(label, return_inverse=True)[1]
            cut = np.flatnonzero(key[1:] != key[:-1]) + 1
            starts, ends = np.r_[0, cut], np.r_[cut, len(ids)]
            run_of = np.repeat(np.arange(len(starts)), ends - starts)
            long = (ends - starts) > SHORT
            few = np.flatnonzero(~long[run_of])
            links = [np.zeros((3, 0), np.int64)]

            def add(u: np.ndarray, v: np.ndarray, d: np.ndarray) -> None:
                ok = counted(u, v, cols)
                links.append(np.stack([u[ok], v[ok], d[ok]]))
                if sum(x.shape[1] for x in links[1:]) > 4 * len(ids):
                    every = np.concatenate(links, axis=1)
                    links[:] = [every[:, thinned(node[every[0]], node[every[1]], every[2], len(ids))]]

            for step in range(1, SHORT):
                at = np.flatnonzero(run_of[few[step:]] == run_of[few[:-step]]) if len(few) > step else np.zeros(0, np.int64)
                if not len(at):
                    break
                u, v = few[at], few[at + step]
                d = np.bitwise_count(fps[u] ^ fps[v]).sum(axis=1).astype(np.int64)
                add(u[d <= most], v[d <= most], d[d <= most])
            for a, b in zip(starts[long], ends[long], strict=True):
                for u, v, d in near(ids[a:b], fps[a:b], most):
                    add(u + a, v + a, d)
            u, v, d = np.concatenate(links, axis=1)
            keep = thinned(node[u], node[v], d, len(ids))
            u, v, d = ids[u[keep]], ids[v[keep]], d[keep]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v), pa.int64()), pa.array(np.maximum(u, v), pa.int64()), pa.array(d, pa.int32())], ["a", "b", "d"])

        def lists(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if not pivot:
                yield some(cols)
                return
            key, p, r, ids, fps, label = cols
            group = np.cumsum(np.append(False, key[1:] != key[:-1]))
            for of, other in zip(under.T, beside.T, strict=True):
                at = np.flatnonzero(of[p] >= 0)
                if len(at):
                    own = group[at] * 256 + fps.view(np.uint8)[at, other[p[at]]]
                    order = np.argsort(own, kind="stable")
                    at = at[order]
                    yield some([own[order], of[p[at]], r[at], ids[at], fps[at], label[at]])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, s, r, ids, label = (np.asarray(batch.column(i)).astype(np.int64) for i in (0, 1, 2, 3, 5))
            fps = np.frombuffer(b"".join(batch.column(4).to_pylist()), "<u8").reshape(batch.num_rows, -1)
            cols = [key, s, r, ids, fps, label]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            other = np.flatnonzero(cols[0] != cols[0][-1])
            last = int(other[-1]) + 1 if len(other) else 0
            held = [x[last:] for x in cols]
            if last:
                yield from lists([x[:last] for x in cols])
        if held is not None:
            yield from lists(held)

    return blocks.select("key", "s", "r", "id", "fp", "label").repartition("key").sortWithinPartitions("key", "id").mapInArrow(common.lean(run), "a long, b long, d int")


def link_components(docs: DataFrame, k: int = 3, max_distance: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): documents whose 64-bit fingerprints link at max_distance or fewer bits, transitively."""
    rows = common.written(fingerprints(docs, k), "fingerprints")
    # equal fingerprints are one node, named by its smallest document
    nodes = common.written(rows.groupBy("fp").agg(F.min("doc_id").alias("id")).where("id is not null"), "nodes")
    edges = exact_candidates(nodes, 8, max_distance)
    roots = common.components(edges.select("a", "b"), "simhash")
    named = nodes.join(roots, nodes["id"] == roots["node"], "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    return rows.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def jaccard(a, b, na: int, nb: int) -> float:
    """Jaccard similarity of two sets of na and nb shingle hashes, given as bytes."""
    x, y = (np.frombuffer(v, "<u4" if n <= NARROW else "<u8") for v, n in ((a, na), (b, nb)))
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    if x.dtype != y.dtype:
        x, y = (v if v.itemsize == 4 else np.unique(v >> np.uint64(32)).astype("<u4") for v in (x, y))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def picked(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of these ids where they are read, while the ids can be broadcast, so that a join moves no other sets; else all."""
    return nodes.join(F.broadcast(ids), "id", "left_semi") if ids.count() <= PICKED else nodes


def verified(edges: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The (a, b) of edges whose sets of shingles have a Jaccard similarity of at least `least`."""
    left = nodes.select(F.col("id").alias("a"), F.col("hashes").alias("sa"), F.col("n_shingles").alias("na"))
    right = nodes.select(F.col("id").alias("b"), F.col("hashes").alias("sb"), F.col("n_shingles").alias("nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = batch.column(2), batch.column(3)
            na, nb = np.asarray(batch.column(4)), np.asarray(batch.column(5))
            # sets are looked at where they lie, one pair at a time
            some = np.flatnonzero(np.minimum(na, nb) >= least * np.maximum(na, nb) - 1e-6).tolist()
            ok = pa.array([i for i in some if jaccard(sa[i].as_buffer(), sb[i].as_buffer(), int(na[i]), int(nb[i])) >= least], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(ok), batch.column(1).take(ok)], ["a", "b"])

    both = edges.select("a", "b").join(left, "a").join(right, "b")
    # the similarity is at most the ratio of the sizes
    both = both.where(F.least("na", "nb") >= least * F.greatest("na", "nb") - 1e-6)
    return both.select("a", "b", "sa", "sb", "na", "nb").mapInArrow(common.lean(run), "a long, b long")


def joined(ids: np.ndarray, fps: np.ndarray, part: np.ndarray, side: np.ndarray, sets: list, sizes: np.ndarray, least: float, most: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the parts of one block: all pairs at `most` bits or fewer are verified but those already in one part."""
    label, found = np.unique(part, return_inverse=True)[1], []
    both = len(set(side.tolist())) > 1
    for i in range(len(ids) - 1):
        rest = slice(i + 1, None)
        ok = label[rest] != label[i]
        if both:
            ok &= side[rest] != side[i]
        # the similarity is at most the ratio of the sizes
        ok &= np.minimum(sizes[rest], sizes[i]) >= least * np.maximum(sizes[rest], sizes[i]) - 1e-6
        at = np.flatnonzero(ok) + i + 1
        d = np.bitwise_count(fps[at] ^ fps[i]).sum(axis=1)
        for j in at[d <= most][np.argsort(d[d <= most], kind="stable")].tolist():
            if label[i] != label[j] and jaccard(sets[i], sets[j], int(sizes[i]), int(sizes[j])) >= least:
                found.append((int(ids[i]), int(ids[j])))
                label[label == label[j]] = label[i]
    return found


def within(edges: DataFrame, sure: DataFrame, nodes: DataFrame, least: float, most: int) -> DataFrame:
    """(a, b): what connects, beyond `sure`, the rows linked by similarity within each group that the candidates `edges` connect.

    A group that `sure` connects whole is done. In the others every pair at `most` bits or fewer is verified unless its rows
    are in one verified component by then, so only verified links are ever thinned. Large groups are split into blocks that
    meet pairwise; a block gives fewer links than it has rows."""
    group, part = common.components(edges.select("a", "b"), "group"), common.components(sure, "part")
    member = group.select(F.col("node").alias("id"), F.col("root").alias("grp")).join(part.select(F.col("node").alias("id"), F.col("root").alias("part")), "id", "left")
    member = common.written(member.select("id", "grp", F.coalesce("part", "id").alias("part")), "members")
    size = F.greatest(F.lit(GROUP), F.sqrt("n") * 16)
    left = member.groupBy("grp").agg(F.count("*").alias("n"), F.min("part").alias("x"), F.max("part").alias("y")).where("x < y").select("grp", F.ceil(F.col("n") / size).cast("int").alias("parts"))
    rows = member.join(left, "grp").withColumn("s", F.pmod(F.xxhash64("id", F.lit("side")), F.col("parts")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    needed = common.written(member.join(left, "grp", "left_semi").select("id"), "apart-members")
    rows = rows.select(F.xxhash64("grp", F.least("s", "o"), F.greatest("s", "o")).alias("key"), "s", "id", "part").join(picked(nodes, needed), "id")
    # sides are told apart only where two meet
    dealt = rows.select("key", "id", "part", "s", "fp", "n_shingles", "hashes").repartition("key").sortWithinPartitions("key", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of one block

        def out() -> pa.RecordBatch:
            col = lambda i: [x for b in held for x in b.column(i)]
            num = lambda i: np.concatenate([np.asarray(b.column(i)) for b in held])
            fps = np.frombuffer(b"".join(x.as_py() for x in col(4)), "<u8").reshape(sum(b.num_rows for b in held), -1)
            links = joined(num(1), fps, num(2), num(3), [x.as_buffer() for x in col(6)], num(5), least, most)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([min(x) for x in links], pa.int64()), pa.array([max(x) for x in links], pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.asarray(batch.column(0))
            cut = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for i, j in itertools.pairwise(cut):
                if held and held[0].column(0)[0].as_py() != int(key[i]):
                    yield out()
                held.append(batch.slice(i, j - i))
        if held:
            yield out()

    return dealt.mapInArrow(common.lean(run), "a long, b long")


def similar_components(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, digest, component_id): documents linked, transitively, by a Jaccard similarity of their k-word shingles.

    Candidates come from 256-bit fingerprints: at similarity s two of them differ in about acos(2s / (1 + s)) / pi of
    the bits; pairs up to four standard deviations beyond that are verified. First each node's nearest candidate is
    verified, of the other edges of the forests only those between what is still apart. That is only a start that saves
    most of the work in large groups: in each group of candidates that it leaves in parts all pairs are then verified."""
    bits = 256
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    most = int(bits * p + 4 * np.sqrt(bits * p * (1 - p)))
    rows = common.written(fingerprints(docs, k, bits // 64, distinct=True), "fingerprints")
    # equal sets of shingles are one node, named by its smallest document
    nodes = common.written(rows.groupBy("digest").agg(F.min("doc_id").alias("id"), F.min("fp").alias("fp")).where("id is not null"), "nodes")
    found = similar_candidates(nodes, byte_sets(bits // 8, None), most)
    edges = common.written(found.groupBy("a", "b").agg(F.min("d").alias("d")), "candidates")
    # only nodes with a candidate have their sets made and moved
    ids = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct()
    linked = common.written(shingle_sets(docs, common.written(nodes.join(ids, "id", "left_semi"), "picked"), k), "linked")
    nearest = edges.groupBy("b").agg(F.min(F.struct("d", "a")).alias("x")).select(F.col("x.a").alias("a"), "b")
    sure = common.written(verified(nearest, linked, similarity), "verified")
    first = common.written(common.components(sure, "near"), "near")
    ra, rb = first.select(F.col("node").alias("a"), F.col("root").alias("ra")), first.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    apart = edges.join(nearest, ["a", "b"], "left_anti").join(ra, "a", "left").join(rb, "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b"))
    apart = common.written(apart.select("a", "b"), "apart")
    ends = apart.select(F.col("a").alias("id")).unionByName(apart.select(F.col("b").alias("id"))).distinct()
    sure = common.written(sure.unionByName(verified(apart, picked(linked, ends), similarity)), "sure")
    roots = common.components(sure.unionByName(within(edges, sure, linked, similarity, most)), "similar")
    named = nodes.join(roots, nodes["id"] == roots["node"], "left").select("digest", F.coalesce("root", "id").alias("component_id"))
    return rows.select("doc_id", "digest").join(named, "digest", "left")


def dedup(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without near-duplicates: of each group the document with the smallest doc_id stays; all columns are kept.

    Rows with a null doc_id are kept, as nothing names them; of rows that repeat a doc_id one is kept."""
    found = common.written(similar_components(docs, k, similarity).select("doc_id", "component_id"), "groups")
    gone = common.written(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    # ids rather than whole texts move, while they can be broadcast
    left = docs.join(F.broadcast(gone) if gone.count() <= PICKED else gone, "doc_id", "left_anti")
    repeated = found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1")
    if not repeated.isEmpty():
        left = left.where("doc_id is null").unionByName(left.where("doc_id is not null").dropDuplicates(["doc_id"]))
    return left.select(*docs.columns)


def op1_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: 3-word shingles, 64 bits, links at 2 or fewer differing bits."""
    found = link_components(common.table(spark, sf_dir, "documents"), 3, 2)
    return found.select("doc_id", F.lower(F.hex(_big_endian("fp"))).alias("fingerprint"), "component_id")


def _big_endian(name: str):
    return F.concat(*[F.substring(name, i, 1) for i in range(8, 0, -1)])


QUERIES = {"op1_simhash_neardup": op1_simhash_neardup}
ORACLE: dict[str, str] = {}
