"""Embedding near-dedup by collision-counting projections.

Unit vectors are projected on many random directions. Two vectors at cosine c differ in each projection by a normal
law of variance 2 - 2c, so in a window of WINDOW standard deviations centred on one of them the other is found with a
known chance; a pair's collisions over all projections are then binomial, and the count that a pair at the threshold
reaches with probability RECALL is the filter. Pairs that pass are verified by their cosine in double precision.

A window of one projection holds about a fifth of all vectors, so sorting each projection and tallying every window
would be quadratic. The projections are therefore taken in tables of several: rows are sorted by the joint cell of a
table's projections, and the windows of all projections are counted for pairs that share a cell of some table. The
number of projections in a table grows with the logarithm of the largest label, the number of tables follows from
RECALL. A pair is counted in the first table in which it shares a cell, so nothing has to be made distinct; blocks
return sums and spanning links rather than pairs, so dense groups cost arithmetic but no rows.

Edge cases: vectors that are null, zero, or hold null or non-finite components, or have a null label or id, link with
nothing; vectors of different length aren't compared; equal vectors form one class, whose members all link; every row
is a vector, repeated rows included; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import common

RECALL = 0.998
#: Width of a cell, and half width of a window in standard deviations of the difference at the threshold.
CELL = 1.1
WINDOW = 1.5
BLOCK = 1024
SHORT = 32


def calibrate(threshold: float, largest: int) -> tuple[int, int, float, int]:
    """Projections in a table, tables, half width of a window, and collisions needed."""
    spread = math.sqrt(2 - 2 * threshold)
    per = max(4, math.ceil(math.log(max(2, largest)) / 1.17) - 2)  # 1.17: what one more projection divides unrelated pairs by, as a logarithm
    grid = np.linspace(0, CELL, 2001)
    near = float(np.trapezoid((1 - grid / CELL) * 2 * np.exp(-(grid**2) / (2 * spread**2)) / (spread * math.sqrt(2 * math.pi)), grid))
    tables = math.ceil(math.log(1 - RECALL) / math.log(1 - near**per))
    m, p = per * tables, math.erf(WINDOW / math.sqrt(2))
    below, need = 0.0, 0
    while (below := below + math.comb(m, need) * p**need * (1 - p) ** (m - need)) < 1 - RECALL:
        need += 1
    return per, tables, WINDOW * spread, need


def directions(dim: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([dim, m, 20])
    return rng.standard_normal((dim, m)), rng.uniform(0, CELL, m)


def project(x: np.ndarray, labels: np.ndarray, per: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """Projections of unit vectors, and for each table the key of the cell."""
    dim, m = x.shape[1], per * tables
    a, shift = directions(dim, m)
    # element by element products summed over rows of one vector: the same vector gives the same cell in any batch
    proj = np.stack([(x * a[:, j]).sum(axis=1) for j in range(m)], axis=1)
    cell = np.floor((proj + shift) / CELL).astype(np.int64).astype(np.uint64).reshape(len(x), tables, per)
    key = np.zeros((len(x), tables), np.uint64)
    key += labels.astype(np.int64).astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(tables, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(dim)
    for j in range(per):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + cell[:, :, j]
    return proj.astype(np.float32), (key ^ (key >> np.uint64(32))).astype(np.int64)


def unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Slim rows (vec_id, k1, k2, ok) and classes of equal vectors (k1, k2, id, n, label, embedding)."""
    e = F.col("embedding").cast("array<double>")
    # labels of any type are told apart by a hash of their text; zero is one label, whatever its sign
    kind = dict(vectors.dtypes)["label"]
    label = F.col("label") + F.lit(0.0).cast(kind) if kind in ("float", "double") else F.col("label")
    label = F.when(F.col("label").isNotNull(), F.xxhash64(label.cast("string")))
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("e").isNotNull() & ~bad & F.exists("e", lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), e.alias("e")).withColumn("ok", ok)
    rows = rows.withColumn("e", F.transform("e", lambda x: x + F.lit(0.0)))  # no negative zeros
    rows = rows.withColumns({"k1": F.xxhash64("label", "e"), "k2": F.xxhash64(F.lit("2"), "e", "label")})
    made = rows.where("ok").groupBy("k1", "k2").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("e").alias("e"))
    return rows.select("vec_id", "k1", "k2", "ok"), made


def _cells(made: DataFrame, per: int, tables: int) -> DataFrame:
    """(key, id, n, label, v) for each class and table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, label = (np.asarray(batch.column(i)).astype(np.int64) for i in range(3))
            vecs = batch.column(3)
            size = np.asarray(pc.list_value_length(vecs))
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                raw = np.asarray(vecs.take(pa.array(at)).flatten()).reshape(len(at), int(dim))
                _, keys = project(unit(raw), label[at], per, tables)
                v = [r.tobytes() for r in raw.astype("<f8")]
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[:, t]), pa.array(ids[at]), pa.array(n[at]), pa.array(label[at]), pa.array(v, pa.binary()), pa.array(np.full(len(at), t, np.int32))], ["key", "id", "n", "label", "v", "t"])

    return made.select("id", "n", "label", "e").mapInArrow(run, "key long, id long, n long, label long, v binary, t int")


def _blocks(cells: DataFrame) -> DataFrame:
    """Cells dealt out and sorted; those with over BLOCK rows are split into blocks that meet pairwise. At most rows / BLOCK keys are that long."""
    hot = cells.groupBy("key").count().where(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts"))
    salt = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    other = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
    got = cells.join(F.broadcast(hot), "key", "left").select("*", salt.alias("s"), other.alias("o")).select("key", F.least("s", "o").alias("i"), F.greatest("s", "o").alias("j"), "s", "id", "n", "label", "t", "v")
    return got.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id")


def _links(blocks: DataFrame, threshold: float, per: int, tables: int, window: float, need: int) -> DataFrame:
    """(kind, x, y): kind 0, vector x links with y vectors of other classes; kind 1, classes x and y are linked."""

    def some(rows: list) -> Iterator[pa.RecordBatch]:
        key, s, ids, n, label, t, vs = rows
        add: dict[int, int] = {}
        edges: list[np.ndarray] = []
        cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        starts, ends = np.r_[0, cut], np.r_[cut, len(ids)]
        size = ends - starts
        use = np.flatnonzero(np.repeat(size, size) > 1)
        if not len(use):
            return
        group = np.repeat(np.arange(len(starts)), size)[use]
        key, s, ids, n, label, t, vs = key[use], s[use], ids[use], n[use], label[use], t[use], [vs[i] for i in use]
        length = np.array([len(v) for v in vs])
        for dim in np.unique(length):
            at = np.flatnonzero(length == dim)
            x = unit(np.frombuffer(b"".join(vs[i] for i in at), "<f8").reshape(len(at), -1))
            proj, keys = project(x, label[at], per, tables)
            g, gs, gi, gn, gt, gj = group[at], s[at], ids[at], n[at], t[at], key[at]

            def check(u: np.ndarray, v: np.ndarray) -> np.ndarray:
                ok = (label[at][u] == label[at][v]) & ((keys[u] == keys[v]).argmax(axis=1) == gt[u])  # noqa: B023
                u, v = u[ok], v[ok]
                ok = (np.abs(proj[u] - proj[v]) <= window).sum(axis=1) >= need  # noqa: B023
                u, v = u[ok], v[ok]
                ok = np.einsum("ij,ij->i", x[u], x[v]) >= threshold  # noqa: B023
                u, v = u[ok], v[ok]
                for a, b in ((u, v), (v, u)):
                    for i, c in zip(gi[a].tolist(), gn[b].tolist(), strict=True):  # noqa: B023
                        add[i] = add.get(i, 0) + c
                return np.stack([u, v], axis=1)

            first = np.r_[0, np.flatnonzero(g[1:] != g[:-1]) + 1]
            last = np.r_[first[1:], len(g)]
            short = np.repeat((last - first) <= SHORT, last - first)
            few = np.flatnonzero(short)
            for step in range(1, SHORT):
                same = np.flatnonzero(g[few][step:] == g[few][:-step]) if len(few) > step else []
                if not len(same):
                    break
                u, v = few[same], few[same + step]
                ok = gi[u] != gi[v]
                got = check(u[ok], v[ok])
                edges.append(np.stack([gi[got[:, 0]], gi[got[:, 1]]], axis=1))
            for a, b in zip(first, last, strict=True):
                if b - a <= SHORT:
                    continue
                own, cross = np.arange(a, b), gj[a][1] != gj[a][2]
                tree = np.arange(b - a)  # smallest neighbour so far, spread along links
                linked: list[np.ndarray] = []
                for at0 in range(a, b, 64):
                    u = np.repeat(np.arange(at0, min(b, at0 + 64)), b - a)
                    v = np.tile(own, min(b, at0 + 64) - at0)
                    ok = v > u
                    if cross:
                        ok &= gs[u] != gs[v]
                    linked.append(check(u[ok], v[ok]) - a)
                got = np.concatenate(linked)
                while len(got):  # labels fall until nothing changes; a link that lowers a label is kept
                    low = np.minimum(tree[got[:, 0]], tree[got[:, 1]])
                    new = tree.copy()
                    np.minimum.at(new, got[:, 0], low)
                    np.minimum.at(new, got[:, 1], low)
                    new = new[new]
                    if (new == tree).all():
                        break
                    tree = new
                away = np.flatnonzero(tree != np.arange(len(tree)))
                edges.append(np.stack([gi[a + away], gi[a + tree[away]]], axis=1))
        if add:
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(add), np.int32)), pa.array(list(add), pa.int64()), pa.array(list(add.values()), pa.int64())], ["kind", "x", "y"])
        if edges and len(e := np.concatenate(edges)):
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(e), np.int32)), pa.array(e[:, 0]), pa.array(e[:, 1])], ["kind", "x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {c: batch.column(batch.schema.get_field_index(c)) for c in ("key", "i", "j", "s", "id", "n", "label", "t", "v")}
            key = np.stack([np.asarray(cols[c]).astype(np.int64) for c in ("key", "i", "j")], axis=1)
            now = [key, *(np.asarray(cols[c]).astype(np.int64) for c in ("s", "id", "n", "label", "t")), cols["v"].to_pylist()]
            if rest is not None:
                now = [np.concatenate([a, b]) if isinstance(a, np.ndarray) else a + b for a, b in zip(rest, now, strict=True)]
            other = np.flatnonzero((now[0] != now[0][-1]).any(axis=1))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield from some([x[:cut] for x in now])
            rest = [x[cut:] for x in now]
        if rest is not None:
            yield from some(rest)

    return blocks.mapInArrow(run, "kind int, x long, y long")


def neardup(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row with vec_id, label and embedding."""
    rows, made = classes(vectors)
    made = common.written(made, "vector-classes")
    largest = made.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    per, tables, window, need = calibrate(threshold, largest)
    found = common.written(_links(_blocks(_cells(made, per, tables)), threshold, per, tables, window, need), "vector-links")
    sums = found.where("kind = 0").groupBy(F.col("x").alias("id")).agg(F.sum("y").alias("others"))
    roots = common.components(found.where("kind = 1").select(F.col("x").alias("a"), F.col("y").alias("b")), "vectors")
    named = made.select("k1", "k2", "id", "n").join(sums, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    named = named.select("k1", "k2", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("root", "id").alias("root"))
    single = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    linked = rows.where("ok").join(named, ["k1", "k2"]).select("vec_id", F.col("links").cast("long").alias("n_links"), F.col("root").alias("component_id"))
    return linked.unionByName(single).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op4_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: cosine 0.98 within a label."""
    return neardup(common.table(spark, sf_dir, "embeddings"), 0.98)


QUERIES = {"op4_embedding_neardup": op4_embedding_neardup}
ORACLE = {
    "op4_embedding_neardup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
roots AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, r.component_id, e.vec_id = r.component_id AS kept
FROM embeddings e JOIN roots r USING (vec_id) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) n USING (vec_id)
""",
}
