"""Suffix-array dedup: bytes covered by a string of LENGTH bytes that starts anywhere else too are removed.

Shards. A window is a string of LENGTH bytes; its key is the least hash of the ANCHOR-byte strings inside, so equal windows have equal keys,
and consecutive windows with one key are a piece. Only a key with two different contents of pieces, or one content that may repeat
within itself, is compared at all; equal contents are counted before anything is shuffled with its bytes. Pieces of one key meet in one
shard, whose suffixes are sorted by external induced sorting (riskweave.llm.induced); neighbours that share LENGTH bytes are repeats.

Hot keys. A key with over MOST different contents (a passage that a third of all documents share, in as many contexts) isn't sent to one
shard: its pieces are cut in halves by the distance from the anchor to the window's start, and named anew by all bytes that the windows of a half share.
Halves beyond the passage's edge thereby part, those inside become equal; after nine halvings a piece is a single window, so this ends.

Edge cases: a null text is empty; matches don't cross documents; texts shorter than LENGTH keep all; equal texts of LENGTH bytes or more are removed
whole in every copy; rows that repeat a doc_id, or have none, are documents of their own; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import common, induced

LENGTH = 400
ANCHOR = 32
#: Different contents of a key beyond which it's cut.
MOST = 2048
#: Bytes that a shard is planned for; it may hold any number.
SHARD = 2 << 20
#: Bytes of an array of a shard beyond which it lies in a file.
MEMORY = 24 << 20
#: Bytes of text that are worked on at once; longer texts are read in overlapping pieces.
UNIT = 1 << 20

Batches = Iterator[pa.RecordBatch]
PIECE = "t long, start long, n int, key long, content long, inside boolean, anchor long"


def _bytes() -> Column:
    return F.coalesce(F.col("text").cast("string").cast("binary"), F.lit("").cast("binary")).alias("bytes")


def _hashes(b: np.ndarray) -> np.ndarray:
    """A hash of each ANCHOR-byte string, made from those of half the length."""
    h, base, size = b.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15, 1
    while size < ANCHOR:
        h = h[:-size] * np.uint64(pow(base, size, 1 << 64)) + h[size:]
        size *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    size = 1
    while size * 2 <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if width > size else h


def _runs(b: np.ndarray, length: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of joined texts: (first window, windows, key), the hashes, and the windows whose own first hash is the key. starts: whether a window may start there."""
    h = _hashes(b)
    least = _least(h, length - ANCHOR + 1)
    at = np.flatnonzero(starts[: len(least)])
    if not len(at):
        return at, at, h[:0], h, np.zeros(0, np.int64)
    key = least[at]
    new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1)))
    own = np.append(0, np.cumsum(h[at] == key))
    ends = np.append(new[1:], len(at))
    return at[new], ends - new, key[new], h, own[ends - 1] - own[new]


def _units(batch: pa.RecordBatch, length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (row, offset, bytes) of about UNIT bytes in all; parts of a text overlap by a window less one byte."""
    column, unit, size = batch.column(batch.schema.get_field_index("bytes")), [], 0
    for i in range(batch.num_rows):
        raw = column[i].as_buffer()
        for offset in range(0, max(1, len(raw) - length + 1), UNIT):
            part = raw.slice(offset, min(UNIT + length - 1, len(raw) - offset)).to_pybytes()
            if len(part) < length:
                continue
            unit.append((i, offset, part))
            size += len(part)
            if size >= UNIT:
                yield unit
                unit, size = [], 0
    if unit:
        yield unit


def pieces(texts: DataFrame, length: int) -> DataFrame:
    """The pieces of texts(t, bytes). Two contents are equal if they agree in key and in another hash of 64 bits."""
    width = length - ANCHOR + 1

    def run(batches: Batches) -> Batches:
        for whole in batches:
            for batch in common.slices(iter([whole]), "bytes"):
                t = np.asarray(batch.column(batch.schema.get_field_index("t"))).astype(np.int64)
                for unit in _units(batch, length):
                    joined = b"".join(x[2] for x in unit)
                    size = np.array([len(x[2]) for x in unit])
                    begin = np.cumsum(size) - size
                    starts = np.ones(len(joined), bool)
                    for e in (begin + size).tolist():
                        starts[max(0, e - length + 1) : e] = False
                    first, n, key, h, own = _runs(np.frombuffer(joined, np.uint8), length, starts)
                    of = np.searchsorted(begin, first, "right") - 1
                    rows = np.array([x[0] for x in unit])[of]
                    offset = np.array([x[1] for x in unit], np.int64)[of] + first - begin[of]
                    last = first + n - 1
                    content = [xxhash.xxh3_64_intdigest(joined[a : z + length]) for a, z in zip(first.tolist(), last.tolist(), strict=True)]
                    # the key's string twice: once inside windows before the last, or twice in the last
                    inside = [own[i] + np.count_nonzero(h[z : z + width] == key[i]) > 1 for i, z in enumerate(last.tolist())]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(t[rows]), pa.array(offset), pa.array(n.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(np.array(content, np.uint64).view(np.int64)), pa.array(inside, pa.bool_()), pa.nulls(len(n), pa.int64()),
                    ], [x.split()[0] for x in PIECE.split(", ")])

    return texts.select("t", "bytes").mapInArrow(common.lean(run), PIECE)


def halved(texts: DataFrame, hot: DataFrame, length: int, step: int) -> DataFrame:
    """The hot pieces, each window by its first anchor: those whose distances to it are in one of 2^step ranges make a piece, named by the bytes they share."""
    width = length - ANCHOR + 1
    span = max(1, (1 << (width - 1).bit_length()) >> step)
    grouped = hot.groupBy("t").agg(F.collect_list(F.struct("start", "n", "key", "anchor")).alias("x"))
    rows = grouped.join(texts, "t").select("t", "x", "bytes")

    def cut(raw: memoryview, start: int, n: int, key: int, anchor: int | None) -> Iterator[tuple]:
        if anchor is None:  # the first step finds the anchors
            h = _hashes(np.frombuffer(raw[start : start + n - 1 + length], np.uint8))
            found = np.flatnonzero(h.view(np.int64) == key)
            anchors = found[np.searchsorted(found, np.arange(n))] + start
        else:
            anchors = np.full(n, anchor)
        windows = np.arange(start, start + n)
        part = (anchors - windows) // span
        new = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (anchors[1:] != anchors[:-1])))
        for i, j in zip(new.tolist(), [*new[1:].tolist(), n], strict=True):
            p, a = int(anchors[i]), int(part[i]) * span
            core = raw[p - a : p - min(a + span, width) + 1 + length]
            first, last = int(windows[i]), int(windows[j - 1])
            # a piece of one anchor holds no window twice unless the anchor's bytes come again
            again = np.count_nonzero(_hashes(np.frombuffer(raw[first : last + length], np.uint8)).view(np.int64) == _hashes(np.frombuffer(raw[p : p + ANCHOR], np.uint8)).view(np.int64)[0]) > 1
            yield first, j - i, xxhash.xxh3_64_intdigest(core, step) - (1 << 63), xxhash.xxh3_64_intdigest(raw[first : last + length]) - (1 << 63), bool(again and j - i > 1), p

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for i in range(batch.num_rows):
                t, x = (batch.column(c)[i].as_py() for c in range(2))
                raw = memoryview(batch.column(2)[i].as_buffer())
                found = [c for q in x for c in cut(raw, q["start"], q["n"], q["key"], q["anchor"])]
                for at in range(0, len(found), 4096):
                    some = found[at : at + 4096]
                    yield pa.RecordBatch.from_pylist([{"t": t} | dict(zip(("start", "n", "key", "content", "inside", "anchor"), c, strict=True)) for c in some], schema=_arrow())

    return rows.mapInArrow(common.lean(run), PIECE)


def _arrow() -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in PIECE.split(", ")])


def sharded(texts: DataFrame, live: DataFrame, length: int, memory: int = MEMORY) -> DataFrame:
    """(t, start, n): repeated windows of live(key, single, t, start, n), one row a content; only contents that occur once are reported."""
    size = live.agg(F.sum(F.col("n") + F.lit(length - 1))).first()[0] or 0
    grouped = live.groupBy("t").agg(F.collect_list(F.struct("start", "n", "key", "single")).alias("x"))
    rows = grouped.join(texts, "t").select("t", "x", "bytes")

    def take(batches: Batches) -> Batches:
        for batch in batches:
            for i in range(batch.num_rows):
                t, x = (batch.column(c)[i].as_py() for c in range(2))
                raw = memoryview(batch.column(2)[i].as_buffer())
                for at in range(0, len(x), 1024):
                    some = x[at : at + 1024]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([q["key"] for q in some], pa.int64()), pa.array([t] * len(some), pa.int64()), pa.array([q["start"] for q in some], pa.int64()),
                        pa.array([q["single"] for q in some], pa.bool_()), pa.array([bytes(raw[q["start"] : q["start"] + q["n"] - 1 + length]) for q in some], pa.binary()),
                    ], ["key", "t", "start", "single", "part"])

    def sort(batches: Batches) -> Batches:
        scratch = induced.Scratch(memory)
        text, where = induced.Growing(scratch, np.int16), []
        for batch in batches:
            for part in batch.column(4):
                text.add(np.append(np.frombuffer(part.as_buffer(), np.uint8).astype(np.int16) + 2, np.int16(1)))
            where.append([np.asarray(batch.column(c)) for c in (1, 2, 3)] + [np.array([len(x.as_buffer()) for x in batch.column(4)], np.int64)])
        if not text.n:
            return
        text.add(np.zeros(1, np.int16))
        twice = induced.repeated(text.done(), length, scratch)
        t, start, single, size = (np.concatenate([w[c] for w in where]) for c in range(4))
        begin = np.cumsum(size + 1) - (size + 1)
        for i in range(0, len(size), 4096):
            found = []
            for j in np.flatnonzero(single[i : i + 4096]) + i:
                hit = np.flatnonzero(twice[begin[j] : begin[j] + size[j] - length + 1])
                if len(hit):
                    first = np.flatnonzero(np.append(True, np.diff(hit) > 1))
                    last = np.append(first[1:], len(hit)) - 1
                    found += [(t[j], start[j] + hit[a], hit[z] - hit[a] + 1) for a, z in zip(first, last, strict=True)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in range(3)], ["t", "start", "n"])

    parts = rows.mapInArrow(common.lean(take), "key long, t long, start long, single boolean, part binary")
    return parts.repartition(size // SHARD + 1, "key").mapInArrow(common.lean(sort), "t long, start long, n long")


def repeated_windows(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(t, start, n): runs of windows that start elsewhere too, of texts(t, bytes)."""
    found, step = [], 0
    now = common.written(pieces(texts, length), "pieces")
    while True:
        made = now.groupBy("key", "content").agg(F.count("*").alias("occurs"), F.bool_or("inside").alias("inside"), F.min(F.struct("t", "start", "n")).alias("at"))
        contents = common.written(made, f"contents-{step}")
        keys = contents.groupBy("key").agg(F.count("*").alias("different"), F.bool_or("inside").alias("within")).where("different > 1 or within")
        keys = common.written(keys, f"keys-{step}")
        # a content that occurs twice repeats whole
        twice = contents.where("occurs > 1").select("key", "content")
        found.append(now.join(twice, ["key", "content"]).select("t", "start", F.col("n").cast("long").alias("n")))
        live = contents.join(keys.where(F.col("different") <= MOST).select("key"), "key")
        found.append(sharded(texts, live.select("key", (F.col("occurs") == 1).alias("single"), "at.t", "at.start", "at.n"), length))
        hot = keys.where(F.col("different") > MOST).select("key")
        if hot.isEmpty():
            break
        step += 1
        now = common.written(halved(texts, now.join(hot, "key"), length, step), f"pieces-{step}")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def kept(texts: DataFrame, windows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(t, spans, kept, digest) of texts from which bytes go: the removed runs as (start, end), what is left and its digest."""
    grouped = windows.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("start", "n"))).alias("x"))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = memoryview(batch.column(2)[i].as_buffer())
                x = batch.column(1)[i].values.flatten()
                start = np.asarray(x[0]).astype(np.int64)
                end = start + np.asarray(x[1]).astype(np.int64) - 1 + length
                reach = np.maximum.accumulate(end)
                new = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
                spans = list(zip(start[new].tolist(), reach[np.append(new[1:], len(start)) - 1].tolist(), strict=True))
                cuts = [0, *(v for s in spans for v in s), len(raw)]
                left = b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, 1), pa.array([[{"start": a, "end": b} for a, b in spans]], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([left], pa.binary()),
                    pa.array([hashlib.sha256(left).hexdigest()]),
                ], ["t", "spans", "kept", "digest"])

    rows = grouped.join(texts, "t").select("t", "x", "bytes")
    return rows.mapInArrow(common.lean(run), "t long, spans array<struct<start:long,end:long>>, kept binary, digest string")


def numbered(docs: DataFrame) -> DataFrame:
    """(t, doc_id, bytes): documents with a number each, in buckets by it, so that what is found about a few of them meets them without another shuffle of all texts."""
    spark = docs.sparkSession
    width, name = common.shuffle_width(spark), f"texts_{uuid.uuid4().hex}"
    rows = docs.select("doc_id", _bytes()).withColumn("t", F.monotonically_increasing_id()).repartition(width, "t")
    rows.write.format("parquet").bucketBy(width, "t").sortBy("t").option("path", f"{common.shared_folder(spark)}/riskweave/{name}").saveAsTable(name)
    return spark.table(name)


def _left(texts: DataFrame, length: int) -> DataFrame:
    some = texts.select("t", "bytes")
    return kept(some, repeated_windows(some.where(F.octet_length("bytes") >= length), length), length)


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs(doc_id, text) as (doc_id, n_bytes, spans, kept, kept_sha256): what is removed and what is left."""
    texts = numbered(docs)
    # only texts from which bytes go have been through Python
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    out = texts.join(_left(texts, length), "t", "left")
    return out.select("doc_id", F.octet_length("bytes").cast("long").alias("n_bytes"), F.coalesce("spans", none).alias("spans"), F.coalesce("kept", "bytes").alias("kept"), F.coalesce("digest", F.sha2("bytes", 256)).alias("kept_sha256"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: repeats of 400 bytes."""
    texts = numbered(common.table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    left = _left(texts, LENGTH).select("t", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "digest")
    slim = texts.select("t", "doc_id", F.octet_length("bytes").cast("long").alias("n_bytes"), F.sha2("bytes", 256).alias("whole"))
    zero = F.lit(0).cast("long")
    return slim.join(left, "t", "left").select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("digest", "whole").alias("kept_sha256"))


QUERIES = {"op12_suffix_dedup": op12_suffix_dedup}
ORACLE: dict[str, str] = {}  # a row a byte and its 400 followers is beyond SQL on whole tables; tests/llm hold the query against brute force
