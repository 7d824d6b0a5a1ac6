"""Joins of trees as frontiers: rounds of equi-joins on node keys, driven by a user's column expressions.

A node table has ``depth, node, leaf`` and the columns that the expressions read. In an expression the target's columns
are ``t.*`` and the source's ``s.*``. Each round moves the frontier down one level, so there are at most as many
rounds as levels, and only pairs that the ``open`` expression keeps apart go on. Rounds end when the frontier is empty; more of
them than a tree of 64-bit keys can have levels are an error (a node table whose inner nodes have no leaves below).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from astrolith.session import cut


#: Levels of a tree of one bit a level, and the root.
MOST_LEVELS = 64


@dataclass(frozen=True)
class JoinSpec:
    """``open``: true to go below a pair, false to accept it as a whole, null to drop it. ``mirrored``: both orders of a
    pair of different nodes are kept (dual joins). ``own``: a leaf meets itself."""

    open: Column
    mirrored: bool = True
    own: bool = True


def children(nodes: DataFrame) -> DataFrame:
    """A node table with the key of each node's parent."""
    return nodes.withColumns({"up_depth": F.col("depth") - 1, "up_node": F.shiftright("node", 3)})


def top_down(targets: DataFrame, nodes: DataFrame, spec: JoinSpec, counts: list | None = None, opened: list | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, leaves): rows of structs ``t`` and ``s``. Targets stay as they are, sources are opened from the root down.

    ``counts``, if given, gets (round, opened, accepted, leaf pairs); ``opened`` gets a table a round of the opened inner sources.
    """
    source = cut(nodes)
    ups = children(source)
    s_all = F.struct(*source.columns).alias("s")
    front = targets.select(F.struct(*targets.columns).alias("t")).withColumn("_d", F.lit(0)).join(source.where("depth = 0").select(s_all, F.lit(0).alias("_d")), "_d").select("t", "s")
    accepted, near = None, None
    for k in range(MOST_LEVELS + 1):
        judged = cut(front.withColumn("open", spec.open).where("open is not null"))
        if k and judged.isEmpty():
            break
        take = judged.where("not open").select("t", "s")
        meet = judged.where("open and s.leaf").select("t", "s")
        if not spec.own:
            meet = meet.where("not (t.depth = s.depth and t.node = s.node)")
        if counts is not None:
            r = judged.agg(F.count_if("open"), F.count_if(~F.col("open")), F.count_if(F.col("open") & F.col("s.leaf"))).first()
            counts.append((k, *r))
        if opened is not None:
            opened.append(judged.where("open and not s.leaf").select("s.*"))
        accepted = take if accepted is None else accepted.unionByName(take)
        near = meet if near is None else near.unionByName(meet)
        down = judged.where("open and not s.leaf").select("t", F.col("s.depth").alias("up_depth"), F.col("s.node").alias("up_node"))
        front = down.join(ups, ["up_depth", "up_node"]).select("t", F.struct(*(F.col(c) for c in source.columns)).alias("s"))
    else:
        raise RuntimeError(f"the frontier is not empty after {MOST_LEVELS} levels")
    return accepted, near


def visit_all(nodes: DataFrame) -> DataFrame:
    """One row: ``opened`` and ``met``, the sums of the sources' counts over the opened inner nodes and the leaves that each
    target leaf meets when nothing is pruned, and ``visits``, the pairs of points that the met leaves hold.

    As nothing is pruned, all target leaves meet the same nodes: one target, with their number and their points, walks for all of
    them, so the walk has a row for each node, not for each pair.
    """
    targets = cut(nodes.where("leaf").agg(F.count("*").alias("leaves"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")))
    leaves = F.lit(targets.first()["leaves"])
    opened: list[DataFrame] = []
    _, near = top_down(targets, nodes.select("depth", "node", "n", "leaf"), JoinSpec(F.lit(True)), opened=opened)
    inner = opened[0]
    for more in opened[1:]:
        inner = inner.unionByName(more)
    met = near.agg(F.coalesce(F.sum(F.col("t.leaves") * F.col("s.n")), F.lit(0)).alias("met"), F.coalesce(F.sum(F.col("t.n") * F.col("s.n")), F.lit(0)).alias("visits"))
    return inner.agg((leaves * F.coalesce(F.sum("n"), F.lit(0))).alias("opened")).select("opened", F.lit(1).alias("_k")).join(met.withColumn("_k", F.lit(1)), "_k").drop("_k")


def dual(nodes: DataFrame, spec: JoinSpec) -> tuple[DataFrame, DataFrame]:
    """(accepted, leaf pairs) of a tree with itself: both sides go down together; a leaf waits for the other side.

    Without ``mirrored`` each unordered pair comes once, the lower (first key of its range) side first.
    """
    source = cut(nodes.withColumn("at", F.call_function("shiftleft", F.col("node"), (F.lit(63) - 3 * F.col("depth")).cast("int"))))
    both = F.struct(*source.columns)
    ups = children(source).select("up_depth", "up_node", both.alias("n"))
    root = source.where("depth = 0").select(both.alias("t"), both.alias("s"))
    front, accepted, near = root, None, None

    def lower(rows: DataFrame, side: str) -> DataFrame:
        other = "s" if side == "t" else "t"
        leaf = rows.where(f"{side}.leaf").select("t", "s")
        inner = rows.where(f"not {side}.leaf").select(other, F.col(f"{side}.depth").alias("up_depth"), F.col(f"{side}.node").alias("up_node"))
        return inner.join(ups, ["up_depth", "up_node"]).select(F.col("n").alias(side), other).select("t", "s").unionByName(leaf)

    order = (F.col("t.at") < F.col("s.at")) | (F.col("t.node") == F.col("s.node")) & (F.col("t.depth") == F.col("s.depth")) | (F.col("t.at") == F.col("s.at"))
    for k in range(MOST_LEVELS + 1):
        judged = cut(front.withColumn("open", spec.open).where("open is not null"))
        if k and judged.isEmpty():
            break
        take = judged.where("not open").select("t", "s")
        meet = judged.where("open and t.leaf and s.leaf").select("t", "s")
        if not spec.own:
            meet = meet.where("t.node <> s.node or t.depth <> s.depth")
        accepted = take if accepted is None else accepted.unionByName(take)
        near = meet if near is None else near.unionByName(meet)
        front = lower(lower(judged.where("open and not (t.leaf and s.leaf)").select("t", "s"), "t"), "s")
        if not spec.mirrored:
            front = front.where(order)
    else:
        raise RuntimeError(f"the frontier is not empty after {MOST_LEVELS} levels")
    return accepted, near
