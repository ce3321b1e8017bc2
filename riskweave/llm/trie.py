"""Conversation prefix trie from mergeable partial tries.

A node is named by its path: every turn is hashed together with its depth, and the name of a prefix is the exclusive or of its
turns' hashes (two of 64 bits). Names of later prefixes follow from those of earlier ones without an order of work, so a conversation
that holds a third of all turns is cut into runs whose names are put together afterwards, and a node's parent is its name with the last turn taken out again.

Each partition's prefixes are combined into a partial node table (members, smallest member), partial tables are merged by name in
a tree of MERGES, and lists of ended conversations are merged with them. A list has rows of SPAN consecutive ids, so no row is
unbounded; its digest streams over these. Sums over subtrees are rolled up by doubling: in round k every node adds its sum to
its ancestor 2^k levels up, which takes as many rounds as the depth has binary digits.

Edge cases: rows without conv_id belong to no conversation and are dropped; null roles and texts are empty; equal turns are ordered by role, then by the
digest of role and text; repeated rows are turns of their own; negative ids follow SQL's remainder, which keeps the sign; an empty table has no
nodes, not even a root; other columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.llm import common

#: The conversation whose head another one takes: the first of FAMILY ids. Heads have up to HEAD - 1 turns.
FAMILY = 5
HEAD = 9
#: Partial tables that a name's partial results are merged into, round by round.
MERGES = (16, 1)
#: Consecutive ids in a row of an end list.
SPAN = 1 << 16
NAME = ["ka", "kb"]


def head_length() -> Column:
    return (F.crc32(F.col("c").cast("string").cast("binary")) % HEAD).cast("int")


def _step(d: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """What a turn at depth d adds to its prefix's name."""
    return F.xxhash64(d.cast("int"), a, b), F.xxhash64(b, d.cast("int"), a)


def _turns(conversations: DataFrame) -> DataFrame:
    """(run, c, r, a, b, size): turns without their texts; runs are ranges of the order by c and turn, r counts within c and run."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("c"), "turn", role.alias("role"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit("second"), text, role).alias("b"), F.octet_length(text).alias("size"))
    order = ["turn", "role", "a", "b"]
    # equal rows are interchangeable; a number of their own lets ranges part them too
    dealt = slim.withColumn("own", F.monotonically_increasing_id()).repartitionByRange(common.shuffle_width(conversations.sparkSession), "c", *order, "own").withColumn("run", F.spark_partition_id())
    r = F.row_number().over(Window.partitionBy("run", "c").orderBy(*order, "own"))
    return common.written(dealt.select("run", "c", r.alias("r"), "a", "b", "size"), "turns")


def _before(runs: DataFrame) -> DataFrame:
    """(run, c, before) for conversations in several runs: their turns in earlier ones. A border between runs is in one conversation, so there are at most two rows a run."""
    several = runs.join(runs.groupBy("c").agg(F.count("*").alias("k")).where("k > 1").select("c"), "c", "left_semi")
    earlier = Window.partitionBy("c").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    return several.select("run", "c", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))


def _heads(turns: DataFrame, before: DataFrame) -> DataFrame:
    """(base, steps): the first turns of conversations that others take them from, as (a, b, size) in order."""
    early = turns.where((F.col("c") % FAMILY == 0) & (F.col("r") < HEAD)).join(F.broadcast(before), ["run", "c"], "left")
    p = F.col("r") + F.coalesce("before", F.lit(0))
    few = early.select("c", p.alias("p"), "a", "b", "size").where(F.col("p") < HEAD)
    return few.groupBy(F.col("c").alias("base")).agg(F.array_sort(F.collect_list(F.struct("p", "a", "b", "size"))).alias("steps"))


def _path(steps: Column) -> Column:
    """Names of the prefixes of a head, the empty one first: (d, ka, kb, size, pa, pb)."""
    root = F.struct(F.lit(0).alias("d"), F.lit(0).cast("long").alias("ka"), F.lit(0).cast("long").alias("kb"), F.lit(0).alias("size"), F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"))

    def grow(path: Column, x: Column) -> Column:
        last = F.element_at(path, -1)
        d = last["d"] + 1
        a, b = _step(d, x["a"], x["b"])
        return F.concat(path, F.array(F.struct(d.alias("d"), last["ka"].bitwiseXOR(a).alias("ka"), last["kb"].bitwiseXOR(b).alias("kb"), x["size"].alias("size"), last["ka"].alias("pa"), last["kb"].alias("pb"))))

    return F.aggregate(steps, F.array(root), grow)


def prefixes(conversations: DataFrame) -> DataFrame:
    """(c, d, ka, kb, pa, pb, size, ends): a row a rebuilt conversation and prefix; size of the last text, ends if it is the whole."""
    turns = _turns(conversations)
    runs = common.written(turns.groupBy("run", "c").agg(F.max("r").alias("n")), "runs")
    before = common.written(_before(runs), "runs-before")
    convs = runs.groupBy("c").agg(F.sum("n").alias("n")).withColumns({"h": head_length(), "base": F.col("c") - F.col("c") % FAMILY})
    convs = convs.join(_heads(turns, before), "base", "left").select("c", "n", "h", F.slice(F.coalesce("steps", F.array().cast("array<struct<p:bigint,a:bigint,b:bigint,size:int>>")), F.lit(1), F.col("h")).alias("steps"))
    convs = common.written(convs.select("c", "n", "h", _path(F.col("steps")).alias("path")), "heads")
    heads = convs.select("c", "n", "h", F.size("path").alias("k"), F.explode("path").alias("x"))
    heads = heads.select("c", "x.d", "x.ka", "x.kb", "x.pa", "x.pb", "x.size", ((F.col("x.d") == F.col("k") - 1) & (F.col("n") <= F.col("h"))).alias("ends"))

    # runs rather than conversations are joined and windowed, so none is longer than a partition of the order
    top = F.element_at("path", -1)
    info = runs.select("run", "c").join(convs.where("n > h").select("c", F.col("n").alias("n_turns"), "h", top["d"].alias("m"), top["ka"].alias("ha"), top["kb"].alias("hb")), "c").join(F.broadcast(before), ["run", "c"], "left")
    tails = turns.join(info, ["run", "c"]).withColumn("p", F.col("r") + F.coalesce("before", F.lit(0))).where("p > h")
    tails = tails.withColumn("d", (F.col("p") - F.col("h") + F.col("m")).cast("int"))
    tails = tails.withColumns(dict(zip(("ga", "gb"), _step(F.col("d"), F.col("a"), F.col("b")), strict=True)))
    # what the earlier runs of a conversation add to its names
    whole = tails.join(F.broadcast(before.select("run", "c")), ["run", "c"], "left_semi").groupBy("run", "c").agg(F.bit_xor("ga").alias("xa"), F.bit_xor("gb").alias("xb"))
    earlier = Window.partitionBy("c").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    carried = common.written(whole.select("run", "c", F.bit_xor("xa").over(earlier).alias("ca"), F.bit_xor("xb").over(earlier).alias("cb")), "names-before")
    inside = Window.partitionBy("run", "c").orderBy("r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = tails.withColumns({"la": F.bit_xor("ga").over(inside), "lb": F.bit_xor("gb").over(inside)}).join(F.broadcast(carried), ["run", "c"], "left")
    rows = rows.withColumns({"ka": F.col("ha").bitwiseXOR(F.col("la")).bitwiseXOR(F.coalesce("ca", F.lit(0))), "kb": F.col("hb").bitwiseXOR(F.col("lb")).bitwiseXOR(F.coalesce("cb", F.lit(0)))})
    rows = rows.select("c", "d", "ka", "kb", F.col("ka").bitwiseXOR(F.col("ga")).alias("pa"), F.col("kb").bitwiseXOR(F.col("gb")).alias("pb"), "size", (F.col("p") == F.col("n_turns")).alias("ends"))
    return heads.unionByName(rows)


def merged(tables: DataFrame) -> DataFrame:
    """Partial node tables (part, name, ...) merged by name, from many to one."""
    for parts in MERGES:
        tables = tables.groupBy(*NAME, (F.col("part") % parts).alias("part")).agg(F.first("pa").alias("pa"), F.first("pb").alias("pb"), F.max("d").alias("d"), F.max("size").alias("size"), F.sum("n").alias("n"), F.min("c").alias("c"))
    return tables.drop("part")


def end_digests(ends: DataFrame) -> DataFrame:
    """(ka, kb, ends_sha256) of ends(ka, kb, c): ids in order, joined by commas."""
    rows = ends.groupBy(*NAME, F.floor(F.col("c") / SPAN).alias("span")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, hashlib.sha256()

        def done(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], [*NAME, "ends_sha256"])

        for batch in batches:
            found = []
            for a, b, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if now != (a, b):
                    if now:
                        found.append((*now, state.hexdigest()))
                    now, state = (a, b), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if found:
                yield done(found)
        if now:
            yield done([(*now, state.hexdigest())])

    return rows.repartition(*NAME).sortWithinPartitions(*NAME, "span").select(*NAME, "span", "ids").mapInArrow(run, "ka long, kb long, ends_sha256 string")


def rolled_up(nodes: DataFrame, values: list[str]) -> DataFrame:
    """nodes(ka, kb, pa, pb, d, *values) as (ka, kb, *values), each value summed over its subtree."""
    deepest = nodes.agg(F.max("d")).first()[0] or 0
    state = nodes.select(*NAME, F.col("pa").alias("qa"), F.col("pb").alias("qb"), *values)  # q: the ancestor 2^k levels up, if there is one
    for k in range(deepest.bit_length()):
        state = common.written(state, f"rollup-{k}")
        gifts = state.where("qa is not null").groupBy(F.col("qa").alias("ka"), F.col("qb").alias("kb")).agg(*[F.sum(v).alias(f"{v}_more") for v in values])
        if k + 1 < deepest.bit_length():
            up = state.where("qa is not null").select(F.col("ka").alias("qa"), F.col("kb").alias("qb"), F.col("qa").alias("ra"), F.col("qb").alias("rb"))
            # nodes without such an ancestor, more each round, take no part in the join
            far = state.where("qa is not null").join(up, ["qa", "qb"], "left").select(*NAME, F.col("ra").alias("qa"), F.col("rb").alias("qb"), *values)
            state = far.unionByName(state.where("qa is null"))
        state = state.join(gifts, NAME, "left").select(*NAME, "qa", "qb", *[(F.col(v) + F.coalesce(f"{v}_more", F.lit(0))).alias(v) for v in values])
    return state.select(*NAME, *values)


def trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row a node of the trie of conversations(conv_id, turn, role, text)."""
    found = common.written(prefixes(conversations), "prefixes")
    part = F.pmod(F.xxhash64("c"), F.lit(MERGES[0]))
    nodes = common.written(merged(found.select(*NAME, "pa", "pb", "d", "size", "c", F.lit(1).cast("long").alias("n"), part.alias("part"))), "nodes")
    ends = end_digests(found.where("ends").select(*NAME, "c"))
    kids = nodes.where("pa is not null").groupBy(F.col("pa").alias("ka"), F.col("pb").alias("kb")).agg(F.count("*").alias("kids"))
    own = nodes.join(kids, NAME, "left").withColumns({"n_children": F.coalesce("kids", F.lit(0)).cast("long"), "n_leaves": F.col("kids").isNull().cast("long"), "saved_tokens": (F.col("n") - 1) * F.col("size")})
    own = common.written(own.select(*NAME, "pa", "pb", F.col("d").cast("long").alias("depth"), "d", F.col("c").alias("conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens"), "node-values")
    sums = rolled_up(own.select(*NAME, "pa", "pb", "d", "n_leaves", "saved_tokens"), ["n_leaves", "saved_tokens"])
    parents = own.where("n_children > 0").select(F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    out = own.drop("n_leaves", "saved_tokens").join(parents, ["pa", "pb"], "left").join(sums, NAME).join(ends, NAME, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(common.table(spark, sf_dir, "conversations"))


QUERIES = {"op11_conversation_trie": op11_conversation_trie}
ORACLE = {
    "op11_conversation_trie": f"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
crc AS (  -- bit by bit: eight shifts a byte
  SELECT c, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda s, byte: list_reduce([xor(s, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, _: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) AS crc
  FROM (SELECT DISTINCT c FROM turns)),
convs AS (SELECT c, any_value(crc) % {HEAD} AS h, list({{'role': role, 'text': text}} ORDER BY p) AS t FROM turns JOIN crc USING (c) GROUP BY c),
rebuilt AS (SELECT a.c, list_concat(coalesce(b.t[1:a.h], []), a.t[a.h + 1:]) AS s FROM convs a LEFT JOIN convs b ON b.c = a.c - a.c % {FAMILY}),
nodes AS (
  SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (whole), '') AS ends
  FROM (SELECT c, s[1:d] AS k, d, d = len(s) AS whole FROM (SELECT c, s, unnest(range(len(s) + 1)) AS d FROM rebuilt)) GROUP BY k, d),
family AS (SELECT u.conv_id, u.d, count(*) FILTER (v.d = u.d + 1) AS n_children FROM nodes u LEFT JOIN nodes v ON v.d = u.d + 1 AND v.k[1:u.d] = u.k GROUP BY ALL),
up AS (SELECT conv_id, d, k, n_convs, unnest(range(d + 1)) AS at FROM nodes),
sums AS (
  SELECT u.conv_id, u.d, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(CASE WHEN v.d = 0 THEN 0 ELSE (v.n_convs - 1) * strlen(v.k[v.d].text) END) AS saved
  FROM nodes u JOIN up v ON v.at = u.d AND v.k[1:u.d] = u.k JOIN family f ON f.conv_id = v.conv_id AND f.d = v.d GROUP BY ALL)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, f.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN family f USING (conv_id, d) JOIN sums s USING (conv_id, d) LEFT JOIN nodes p ON p.d = n.d - 1 AND n.k[1:p.d] = p.k
""",
}
