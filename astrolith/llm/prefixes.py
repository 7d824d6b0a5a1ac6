"""Conversation prefix trie: the distinct sequences of first turns, how much they share, and totals of all their subtrees.

A node is a distinct sequence of the first d turns (role, text) of some conversation; the root has none. What a prefix cache
saves below a node is the sum over its subtree of (conversations - 1) times the code points of a node's last text.

**Identity.** A turn is hashed with its place to four 32-bit numbers, and a prefix is known by its depth and the sums of its
turns' numbers (128 bits), so that prefixes are running sums and a parent's identity is a child's less one turn.
Texts are hashed where they are read and are not shuffled.

**Scale.** Turns are dealt by ranges of (conversation, turn), so that a conversation of any length spreads over tasks; places
and running sums inside a range get what earlier ranges hold of the conversation, one row per range. Nodes, children
and sums are combined before they are shuffled. Subtree totals come from parallel tree contraction (``contraction``). The
digest of a node's ending conversations is taken from sorted chunks of ids in a stream, so that no task holds all
ids of a node.

Nulls: a null turn comes first; null roles and texts are empty; rows without a conv_id belong to no conversation and are left
out. Ties in turn are ordered by the MD5 of role and text. Repeated rows are repeated turns. Texts of any length
count whole. An empty table gives an empty result (no root). Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from astrolith.llm.contraction import subtree_totals
from astrolith.session import cut

SUMS = [f"s{i}" for i in range(4)]
#: Ids that a chunk of a digest's input holds.
CHUNK = 4096


def ordered_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows ``(_range, conv_id, k, mark, chars)`` with places k = 0, 1, ... in each conversation, and its pieces ``(_range, conv_id, start, len)``."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    mark = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    base = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", mark.alias("mark"), F.length(text).cast("long").alias("chars"))
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(base.repartitionByRange(n, "conv_id", "turn", "mark").withColumn("_range", F.spark_partition_id()))
    pieces = cut(dealt.groupBy("_range", "conv_id").agg(F.count("*").alias("n")))
    earlier = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("_range", "conv_id", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy("conv_id")).alias("len"))
    inside = Window.partitionBy("_range", "conv_id").orderBy("turn", "mark")
    rows = dealt.withColumn("_k", F.row_number().over(inside)).join(pieces.select("_range", "conv_id", "start"), ["_range", "conv_id"])
    return rows.select("_range", "conv_id", (F.col("start") + F.col("_k") - 1).alias("k"), "mark", "chars"), pieces


def as_they_are(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations for ``trie``, without any rebuilding."""
    rows, pieces = ordered_turns(turns)
    return rows, pieces.where("start = 0").select("conv_id", "len")


def with_shared_heads(turns: DataFrame, family: int = 100, longest: int = 5) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations rebuilt: the first h turns of conversation c - c % family, then c's own turns after its first h.

    h is crc32(c in decimal) % (longest + 1); a conversation may end without turns. A family shares the turns of its first member.
    """
    rows, pieces = ordered_turns(turns)
    rows, pieces = cut(rows), cut(pieces)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (longest + 1)).cast("long")
    base = F.col("conv_id") - F.col("conv_id") % family
    lens = pieces.where("start = 0").select("conv_id", "len")
    at_base = lens.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.col("len").alias("_len"))
    taken = F.least("h", F.coalesce("_len", F.lit(0)))
    convs = cut(lens.select("conv_id", "len", h.alias("h"), base.alias("base")).join(at_base, "base", "left").select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.lit(0), F.col("len") - F.col("h"))).alias("new_len")))
    heads = rows.where((F.col("conv_id") % family == 0) & (F.col("k") < longest)).select(F.col("conv_id").alias("base"), "k", "mark", "chars")
    first = convs.join(heads, "base").where(F.col("k") < F.col("h")).select(F.lit(-1).alias("_range"), "conv_id", "k", "mark", "chars")
    # A conversation's rows meet its numbers range by range.
    numbers = pieces.select("_range", "conv_id").join(convs.select("conv_id", "h", "taken"), "conv_id")
    own = rows.join(numbers, ["_range", "conv_id"]).where(F.col("k") >= F.col("h"))
    own = own.select("_range", "conv_id", (F.col("k") - F.col("h") + F.col("taken")).alias("k"), "mark", "chars")
    return first.unionByName(own), convs.select("conv_id", F.col("new_len").alias("len"))


def _numbers() -> list[Column]:
    """Four 32-bit numbers of a turn and its place."""
    one, two = F.xxhash64(F.lit(1), F.col("k"), F.col("mark")), F.xxhash64(F.col("mark"), F.lit(2), F.col("k"))
    half = F.lit((1 << 32) - 1)
    return [one.bitwiseAND(half), F.shiftrightunsigned(one, 32), two.bitwiseAND(half), F.shiftrightunsigned(two, 32)]


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *(s.cast("string") for s in sums)).cast("binary")))


def prefixes(rows: DataFrame) -> DataFrame:
    """``(conv_id, depth, key, parent, chars)``: one row for each turn, as the prefix that ends with it."""
    numbered = cut(rows.select("_range", "conv_id", "k", "chars", *(n.alias(s) for n, s in zip(_numbers(), SUMS))))
    inside = Window.partitionBy("_range", "conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = numbered.groupBy("_range", "conv_id").agg(*(F.sum(s).alias(s) for s in SUMS)).select("_range", "conv_id", *(F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"_{s}") for s in SUMS))
    here = [F.sum(s).over(inside).alias(f"r{i}") for i, s in enumerate(SUMS)]
    run = numbered.select("*", *here).join(before, ["_range", "conv_id"])
    total = [F.col(f"r{i}") + F.col(f"_{s}") for i, s in enumerate(SUMS)]
    depth = F.col("k") + 1
    return run.select("conv_id", depth.alias("depth"), _key(depth, total).alias("key"), _key(F.col("k"), [t - F.col(s) for t, s in zip(total, SUMS)]).alias("parent"), "chars")


def _digests(ends: DataFrame) -> DataFrame:
    """``(key, ends_sha256)`` of ``(key, conv_id)``: SHA-256 of a key's ids in ascending order, joined by commas."""
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array([key], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], names=["key", "first", "ids"])

        for batch in batches:
            for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (k != key or len(ids) >= CHUNK):
                    yield out()
                    ids = []
                key = k
                ids.append(i)
        if ids:
            yield out()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            keys, shas = [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if state is not None and k == key:
                    state.update(b"," + text.encode())
                    continue
                if state is not None:
                    keys.append(key)
                    shas.append(state.hexdigest())
                key, state = k, hashlib.sha256(text.encode())
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(shas, pa.string())], names=["key", "ends_sha256"])
        if state is not None:
            yield pa.record_batch([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])

    chunks = ends.select("key", "conv_id").repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(pack, "key binary, first long, ids string")
    return chunks.repartition(n, "key").sortWithinPartitions("key", "first").mapInArrow(digest, "key binary, ends_sha256 string")


def trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``, a row for each node.

    ``rows`` and ``convs`` come from ``as_they_are`` or ``with_shared_heads``; a node is named by its least member.
    """
    members = cut(prefixes(rows))
    root = _key(F.lit(0), [F.lit(0)] * 4)
    top = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    top = top.select(root.alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars"), "n_convs", "conv_id")
    nodes = members.groupBy("key").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("chars").alias("chars"), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    nodes = cut(nodes.unionByName(top))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = cut(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    tree = nodes.select(F.col("key").alias("id"), "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    totals = subtree_totals(tree, ["n_leaves", "saved_tokens"]).withColumnRenamed("id", "key")
    last = members.join(convs.where("len > 0").select("conv_id", F.col("len").alias("depth")), ["conv_id", "depth"]).select("key", "conv_id")
    ends = _digests(last.unionByName(convs.where("len = 0").select(root.alias("key"), "conv_id")))
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(totals, "key").join(ends, "key", "left").join(parents, "parent", "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


#: Prefixes as hashes of joined hashes; subtrees by the ancestors of each node's least member.
ORACLE = """
WITH RECURSIVE
steps(i, c, k) AS (SELECT range, range::BIGINT, 0 FROM range(256) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
t AS (SELECT conv_id, turn, coalesce(text, '') AS text, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS mark FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, mark, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, mark) - 1 AS k FROM t),
l AS (SELECT conv_id, count(*) AS len FROM o GROUP BY 1),
c AS (SELECT conv_id, len, conv_id - conv_id % 100 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT for x in string_split(conv_id::VARCHAR, '')]), lambda s, x: xor(s >> 8, t[(xor(s, x) & 255) + 1])), 4294967295)::BIGINT % 6 AS h FROM l, crc),
r AS (SELECT c.conv_id, o.k, o.mark, o.text FROM c JOIN o ON o.conv_id = c.base AND o.k < c.h
  UNION ALL SELECT c.conv_id, o.k - c.h + least(c.h, coalesce(b.len, 0)), o.mark, o.text FROM c JOIN o ON o.conv_id = c.conv_id AND o.k >= c.h LEFT JOIN l b ON b.conv_id = c.base),
p AS (SELECT conv_id, k + 1 AS depth, length(text) AS chars, md5(string_agg(mark, ',') OVER (PARTITION BY conv_id ORDER BY k)) AS key FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM c),
lens AS (SELECT conv_id, max(depth) AS len FROM p GROUP BY 1),
n AS (SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, min(chars) AS chars, sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE len = depth), '')) AS ends_sha256 FROM p JOIN lens USING (conv_id) GROUP BY 1, 2),
up AS (SELECT n.*, q.key AS parent, m.conv_id AS parent_conv_id FROM n LEFT JOIN p q ON q.conv_id = n.conv_id AND q.depth = n.depth - 1 LEFT JOIN n m ON m.depth = q.depth AND m.key = q.key),
kids AS (SELECT depth - 1 AS depth, parent AS key, count(*) AS n_children FROM up WHERE depth > 0 GROUP BY 1, 2),
f AS (SELECT up.*, coalesce(n_children, 0) AS n_children FROM up LEFT JOIN kids USING (depth, key)),
s AS (SELECT a.depth, a.key, count(*) FILTER (WHERE f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.chars)::BIGINT AS saved_tokens FROM f JOIN p a ON a.conv_id = f.conv_id AND a.depth <= f.depth GROUP BY 1, 2)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM f JOIN s USING (depth, key)
"""
