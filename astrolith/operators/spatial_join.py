"""Fixed-radius joins by a grid, and nearest neighbours by walks over tree nodes with shrinking bounds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from astrolith.functions.geometry import AXES, box_max2, box_min2, periodic_dist2
from astrolith.session import cut, shuffled

#: The 13 neighbours of a cell that come after it in (x, y, z) order.
FORWARD = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) > (0, 0, 0)]
ALL = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]


def grid_size(radius: float, period: float = 0.0) -> tuple[float, int]:
    """Cell size of at least ``radius`` (a hair more, so that rounding can't part neighbours), and cells per period (0: open)."""
    if period > 0:
        count = max(1, int(math.floor(period / (radius * (1 + 1e-9)))))
        return period / count, count
    return radius * (1 + 1e-9), 0


def cells(size: float, count: int, origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> list[Column]:
    out = []
    for c, o in zip(AXES, origin):
        k = F.floor((F.col(c) - F.lit(o)) / F.lit(size))
        out.append((F.pmod(k, F.lit(count)) if count else k).cast("long"))
    return out


def _shifted(offsets: list[tuple[int, int, int]], count: int) -> Column:
    def move(c: str, d: int) -> Column:
        k = F.col(c) + d
        return (F.pmod(k, F.lit(count)) if count else k).cast("long")

    structs = [F.struct(move("cx", a).alias("cx"), move("cy", b).alias("cy"), move("cz", c).alias("cz")) for a, b, c in offsets]
    # In a narrow periodic grid several offsets lead to the same cell.
    return F.explode(F.array_distinct(F.array(*structs)) if count else F.array(*structs))


def radius_pairs(points: DataFrame, radius: float, period: float = 0.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(src, dst, d2)`` for each unordered pair with ``d2 <= radius^2`` and src < dst, by an equi-join on grid cells.

    Only id and position are shuffled (and ``keep`` columns, returned as ``src_*`` and ``dst_*``), and neither side is broadcast. One side is
    copied to the forward half of the 27 cells, so that each pair of cells meets once. A dense cell is a
    skewed key, which adaptive execution splits; for clusters use ``fof``, which first contracts dense cells.
    """
    size, count = grid_size(radius, period)
    cx, cy, cz = cells(size, count)
    base = points.select("id", *AXES, *keep, cx.alias("cx"), cy.alias("cy"), cz.alias("cz"))
    narrow = 0 < count < 3  # forward offsets would meet a pair of cells twice
    offsets = ALL if narrow else [(0, 0, 0), *FORWARD]
    near = base.withColumn("to", _shifted(offsets, count)).select("id", *AXES, *keep, ((F.col("to.cx") == F.col("cx")) & (F.col("to.cy") == F.col("cy")) & (F.col("to.cz") == F.col("cz"))).alias("own"), "to.cx", "to.cy", "to.cz")
    d2 = periodic_dist2("a", "b", period)
    once = F.col("a.id") < F.col("b.id") if narrow else (~F.col("a.own") | (F.col("a.id") < F.col("b.id")))
    pairs = near.alias("a").join(shuffled(base).alias("b"), ["cx", "cy", "cz"]).where((F.col("a.id") != F.col("b.id")) & once & (d2 <= F.lit(radius * radius)))
    flip = F.col("a.id") > F.col("b.id")
    ends = [F.when(flip, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(f"src_{c}") for c in keep] + [F.when(flip, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(f"dst_{c}") for c in keep]
    return pairs.select(F.least("a.id", "b.id").alias("src"), F.greatest("a.id", "b.id").alias("dst"), d2.alias("d2"), *ends)


def radius_join(queries: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """``(id, nbr, d2)`` of points within ``radius`` of each query point, itself left out by id."""
    size, _ = grid_size(radius)
    cx, cy, cz = cells(size, 0)
    named = [cx.alias("cx"), cy.alias("cy"), cz.alias("cz")]
    left = queries.select("id", *AXES, *named).withColumn("to", _shifted(ALL, 0)).select("id", *AXES, "to.cx", "to.cy", "to.cz")
    right = points.select("id", *AXES, *named)
    d2 = periodic_dist2("a", "b", 0.0)
    return left.alias("a").join(shuffled(right).alias("b"), ["cx", "cy", "cz"]).where((F.col("a.id") != F.col("b.id")) & (d2 <= F.lit(radius * radius))).select(F.col("a.id").alias("id"), F.col("b.id").alias("nbr"), d2.alias("d2"))


def _least_ids(points: DataFrame, most: int, salts: int = 64) -> DataFrame:
    """``(x, y, z, copies, ids)``: different positions with the ``most`` least ids at each, sorted; first by shares of a position."""
    share = F.pmod(F.xxhash64("id"), F.lit(salts))
    part = Window.partitionBy(*AXES, "_s").orderBy("id")
    few = points.select("id", *AXES, share.alias("_s")).withColumn("_k", F.row_number().over(part)).where(F.col("_k") <= most)
    ids = few.groupBy(*AXES).agg(F.slice(F.array_sort(F.collect_list("id")), 1, most).alias("ids"))
    copies = points.groupBy(*AXES).agg(F.count("*").alias("copies"))
    return copies.join(ids, [*AXES])


def _leaf_tree(places: DataFrame, leaf_size: int, payload: dict) -> tuple[DataFrame, DataFrame]:
    """(positions with their leaf, node table) of a tree over different positions."""
    from astrolith.operators import partition, tree, universe

    keyed = cut(universe.with_key(places))
    leaf = partition.leaves(keyed, leaf_size)
    deepest = leaf.agg(F.max("depth")).first()[0] or 0
    placed = cut(partition.assign_cells(keyed, leaf, deepest))
    return placed, cut(tree.nodes_above(placed, deepest, tree.box_payload() | payload))


def nearest(points: DataFrame, k: int, queries: DataFrame | None = None, leaf_size: int = 16, counts: dict | None = None) -> DataFrame:
    """``(id, rank, nbr, d2)``: the ``k`` nearest points of other id, ties by id; fewer only if there are fewer other points.

    An up-and-down walk: a leaf of targets begins with a bound from its own leaf, or its parent's, if these hold enough
    points. Then all leaves of targets go down the tree of sources from its root. Each round drops the nodes beyond a
    leaf's bound, and shrinks the bound to the distance within which the nearest nodes still met hold enough points. Only
    positions within the last bound become rows. Equal positions count as one place with its least ids, since no other
    ids of a place can be among the nearest; so a clump, or many points at one place, costs no more than others.
    ``counts``, if given, gets the numbers of node pairs met and of candidate pairs of positions.
    """
    points = points.select("id", *AXES)
    targets = points if queries is None else queries.select("id", *AXES)
    kinds = "id long, rank int, nbr long, d2 double"
    want = k + 1  # of other or own id
    leaf_size = max(leaf_size, want)
    places = cut(_least_ids(points, want))
    total = min(want, places.agg(F.sum("copies")).first()[0] or 0)
    if k < 1 or not total or targets.isEmpty():
        return points.sparkSession.createDataFrame([], kinds)
    members = {"members": (F.sum("copies"), F.sum("members"))}
    placed, nodes = _leaf_tree(places, leaf_size, members)
    box = [f"{c}_{e}" for c in AXES for e in ("lo", "hi")]
    if queries is None:
        own, leaves_of = placed, nodes.where("leaf")
        up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("node").alias("_up"), F.struct(*box).alias("up"))
        begin = leaves_of.withColumn("_up", F.shiftright("node", 3)).join(up, ["depth", "_up"], "left").withColumn("t", F.struct(*box))
        # A leaf of too few points is below a parent of enough.
        bound = F.when(F.col("members") >= total, box_max2("t", "t")).otherwise(F.coalesce(box_max2("t", "up"), F.lit(float("inf"))))
        begin = begin.withColumn("bound", bound).select(F.struct("depth", "node", *box).alias("t"), "bound")
    else:
        own, own_nodes = _leaf_tree(targets.select(*AXES).distinct(), leaf_size, {})
        begin = own_nodes.where("leaf").select(F.struct("depth", "node", *box).alias("t"), F.lit(float("inf")).alias("bound"))
    source = F.struct("depth", "node", "leaf", "members", *box).alias("s")
    below = nodes.where("depth > 0").select((F.col("depth") - 1).alias("up_depth"), F.shiftright("node", 3).alias("up_node"), source)
    front = begin.crossJoin(F.broadcast(nodes.where("depth = 0").select(source)))  # one row
    key = [F.col("t.depth"), F.col("t.node")]
    nearer = Window.partitionBy(*key).orderBy("far").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = 0
    while True:
        judged = front.withColumn("near", box_min2("t", "s")).where(F.col("near") <= F.col("bound") * (1 + 1e-12)).withColumn("far", box_max2("t", "s"))
        summed = judged.withColumn("enough", F.sum("s.members").over(nearer) >= total)
        shrunk = F.least("bound", F.coalesce(F.min(F.when(F.col("enough"), F.col("far"))).over(Window.partitionBy(*key)), F.lit(float("inf"))))
        kept = cut(summed.withColumn("bound", shrunk).where(F.col("near") <= F.col("bound") * (1 + 1e-12)).select("t", "s", "bound"))
        if counts is not None:
            met += kept.count()
        inner = kept.where("not s.leaf").select("t", "bound", F.col("s.depth").alias("up_depth"), F.col("s.node").alias("up_node"))
        if inner.isEmpty():
            break
        front = kept.where("s.leaf").select("t", "bound", "s").unionByName(inner.join(below, ["up_depth", "up_node"]).select("t", "bound", "s"))
    a = own.select(F.struct("depth", "node").alias("ta"), F.struct(*AXES).alias("a"))
    b = placed.select(F.struct("depth", "node").alias("sb"), F.struct(*AXES).alias("b"), "copies", "ids")
    pairs = kept.select(F.struct("t.depth", "t.node").alias("ta"), F.struct("s.depth", "s.node").alias("sb"), "bound").join(a, "ta").join(b, "sb")
    pairs = pairs.withColumn("d2", periodic_dist2("a", "b", 0.0)).where(F.col("d2") <= F.col("bound") * (1 + 1e-12)).select("a", "d2", "copies", "ids")
    if counts is not None:
        counts |= {"node_pairs": met, "candidates": pairs.count()}
    # Places before which enough points are nearer drop out; ties stay for their ids.
    upto, tied = Window.partitionBy("a").orderBy("d2"), Window.partitionBy("a", "d2")
    few = pairs.withColumn("_before", F.sum("copies").over(upto) - F.sum("copies").over(tied)).where(F.col("_before") < want).select("a", "d2", F.explode("ids").alias("nbr"))
    first = few.withColumn("_k", F.row_number().over(Window.partitionBy("a").orderBy("d2", "nbr"))).where(F.col("_k") <= want).select("a.*", "nbr", "d2")
    rows = targets.join(first, [*AXES]).where("id <> nbr")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("d2", "nbr"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "rank", "nbr", "d2")
