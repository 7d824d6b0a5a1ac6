"""Trees as tables: leaves, and node payloads folded from the leaves to all ancestors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from astrolith.functions import keys
from astrolith.functions.geometry import AXES
from astrolith.operators.partition import global_rank, leaves, running_sum
from astrolith.operators.universe import bounds
from astrolith.session import cut

#: Payloads: name -> (from points, from child nodes). Anything that merges can be added by the caller.
Payload = dict[str, tuple[Column, Column]]


def box_payload() -> Payload:
    return {str(f"{c}_{e}"): (f(c), f(f"{c}_{e}")) for c in AXES for e, f in (("lo", F.min), ("hi", F.max))} | {"n": (F.count("*"), F.sum("n"))}


def moment_payload() -> Payload:
    """Mass, mass-weighted positions and the box."""
    return box_payload() | {"mass": (F.sum("mass"), F.sum("mass"))} | {f"m{c}": (F.sum(F.col("mass") * F.col(c)), F.sum(f"m{c}")) for c in AXES}


def range_payload(column: str) -> Payload:
    return box_payload() | {"least": (F.min(column), F.min("least")), "most": (F.max(column), F.max("most"))}


def rollup(keyed: DataFrame, depth: int, payload: Payload, bits: int = 3) -> DataFrame:
    """``(depth, node, payload...)`` for all levels: points are read once, and each level folds the one below it."""
    level = keyed.groupBy(keys.prefix(F.col("key"), depth, bits).alias("node")).agg(*(p.alias(k) for k, (p, _) in payload.items()))
    out = level.withColumn("depth", F.lit(depth))
    for d in range(depth - 1, -1, -1):
        level = level.groupBy(keys.parent(F.col("node"), bits).alias("node")).agg(*(m.alias(k) for k, (_, m) in payload.items()))
        out = out.unionByName(level.withColumn("depth", F.lit(d)))
    return out.select("depth", "node", *payload)


def nodes_above(placed: DataFrame, deepest: int, payload: Payload, bits: int = 3) -> DataFrame:
    """``(depth, node, payload..., leaf)`` of points' leaves (``placed`` has depth and node) and all cells above these.

    Points are read once, for the leaves; a leaf's payload goes to each cell above it and is folded there, in one shuffle. So the
    plan does not grow with the depth."""
    at_leaves = cut(placed.groupBy("depth", "node").agg(*(p.alias(k) for k, (p, _) in payload.items())))
    out = at_leaves.withColumn("leaf", F.lit(True))
    if deepest == 0:
        return out
    up = at_leaves.where("depth > 0").withColumn("_up", F.explode(F.sequence(F.lit(0), F.col("depth") - 1)))
    node = F.call_function("shiftright", F.col("node"), (F.lit(bits) * (F.col("depth") - F.col("_up"))).cast("int"))
    inner = up.withColumns({"node": node, "depth": F.col("_up")}).drop("_up").groupBy("depth", "node").agg(*(m.alias(k) for k, (_, m) in payload.items()))
    return out.unionByName(inner.withColumn("leaf", F.lit(False)))


def tree_leaves(keyed: DataFrame, leaf_size: int, max_depth: int | None = None, floor_depth: int = 0, bits: int = 3) -> DataFrame:
    """``(depth, node, n)``: cells of at most ``leaf_size`` points, never above ``floor_depth``; the deepest level takes what is left."""
    found = leaves(keyed, leaf_size, max_depth, bits)
    if not floor_depth:
        return found
    deep = found.where(F.col("depth") >= floor_depth)
    at_floor = keyed.groupBy(keys.prefix(F.col("key"), floor_depth, bits).alias("node")).agg(F.count("*").alias("n")).where(F.col("n") <= leaf_size)
    return deep.where(F.col("depth") > floor_depth).unionByName(at_floor.select(F.lit(floor_depth).alias("depth"), "node", "n"))


def with_centres(nodes: DataFrame) -> DataFrame:
    """Adds the centre of mass (without mass: of the box), and the opening radius: from it to the farthest corner, half of the
    box's diagonal for rows that a ``leaf`` column marks, 1 for single points."""
    out = nodes.withColumns({f"c{c}": F.coalesce(F.try_divide(f"m{c}", "mass"), (F.col(f"{c}_lo") + F.col(f"{c}_hi")) / 2) for c in AXES})
    far = sum((F.pow(F.greatest(F.col(f"c{c}") - F.col(f"{c}_lo"), F.col(f"{c}_hi") - F.col(f"c{c}")), 2) for c in AXES), F.lit(0.0))
    radius = F.sqrt(far)
    if "leaf" in nodes.columns:
        diagonal = sum((F.pow(F.col(f"{c}_hi") - F.col(f"{c}_lo"), 2) for c in AXES), F.lit(0.0))
        radius = F.when(F.col("leaf"), 0.5 * F.sqrt(diagonal)).otherwise(radius)
    return out.withColumn("radius", F.when(F.col("n") <= 1, F.lit(1.0)).otherwise(radius))


def subtree(nodes: DataFrame, depth: int, node: int, levels: int, bits: int = 3) -> DataFrame:
    """The nodes of a subtree, ``levels`` deep."""
    return nodes.where((F.col("depth") >= depth) & (F.col("depth") <= depth + levels) & keys.is_prefix(F.lit(node), F.lit(depth), F.col("node"), F.col("depth"), bits))


def flattened(nodes: DataFrame, bits: int = 3) -> DataFrame:
    """Adds breadth-first numbers: ``index``; ``child_begin`` (the place of a node's first child, -1 for leaves) and ``n_children``;
    ``part_begin``, the place of its first point in key order; and ``n_below``, its points.

    ``nodes`` has ``depth, node, n, leaf``; leaves hold all points. Children follow each other, and so do a node's points."""
    ranked = global_rank(nodes, "depth", "node").withColumnRenamed("rank", "index")
    kids = ranked.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), keys.parent(F.col("node"), bits).alias("node")).agg(F.min("index").alias("child_begin"), F.count("*").alias("n_children"))
    begin = F.call_function("shiftleft", F.col("node"), (F.lit(3 * keys.BITS) - F.lit(bits) * F.col("depth")).cast("int"))
    # In the order of first keys a node comes before all leaves below it, and after all points before it.
    placed = running_sum(nodes.select("depth", "node", begin.alias("_begin"), F.when(F.col("leaf"), F.col("n")).otherwise(0).alias("_n")), "_n", "_begin", "depth").select("depth", "node", F.col("before").alias("part_begin"))
    out = ranked.join(kids, ["depth", "node"], "left").join(placed, ["depth", "node"])
    return out.withColumns({"child_begin": F.coalesce("child_begin", F.lit(-1)), "n_children": F.coalesce("n_children", F.lit(0)), "n_below": F.col("n")})


def check_flat(flat: DataFrame) -> DataFrame:
    """One row of counts that must be zero: nodes whose children aren't the next ones in a row, whose children's points aren't
    theirs, leaves with children, and inner nodes without."""
    own = flat.where("n_children > 0").select("index", F.explode(F.sequence(F.col("child_begin"), F.col("child_begin") + F.col("n_children") - 1)).alias("child"), F.col("depth").alias("_d"), F.col("part_begin").alias("_p"), F.col("n_below").alias("_n"))
    child = flat.select(F.col("index").alias("child"), "depth", "part_begin", "n_below")
    sums = own.join(child, "child", "left").groupBy("index", "_p", "_n").agg(F.min(F.coalesce(F.col("depth") == F.col("_d") + 1, F.lit(False))).alias("below"), F.min("part_begin").alias("first"), F.sum("n_below").alias("sum"), F.max(F.col("part_begin") + F.col("n_below")).alias("end"))
    bad = sums.agg(F.count_if(~F.col("below")).alias("bad_children"), F.count_if((F.col("first") != F.col("_p")) | (F.col("sum") != F.col("_n")) | (F.col("end") != F.col("_p") + F.col("_n"))).alias("bad_points"))
    return bad.crossJoin(flat.agg(F.count_if(F.col("leaf") & (F.col("n_children") > 0)).alias("bad_leaves"), F.count_if(~F.col("leaf") & (F.col("n_children") == 0)).alias("bad_inner")))  # one row each


def newest(nodes: DataFrame, key: list[str], generation: str) -> DataFrame:
    """One row per key: that of the latest generation."""
    names = [c for c in nodes.columns if c not in key]
    best = nodes.groupBy(*key).agg(F.max(F.struct(generation, *(c for c in names if c != generation))).alias("_b"))
    return best.select(*key, *(F.col(f"_b.{c}").alias(c) for c in names))


def dot(nodes: DataFrame, most: int = 10_000) -> str:
    """Graphviz text of a small tree; more than ``most`` nodes are refused."""
    rows = nodes.select("depth", "node", "n").orderBy("depth", "node").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} nodes")
    lines = [f'  "{r.depth}/{r.node}" [label="{r.n}"];' for r in rows] + [f'  "{r.depth - 1}/{r.node >> 3}" -> "{r.depth}/{r.node}";' for r in rows if r.depth]
    return "\n".join(["digraph tree {", *lines, "}"])


def map_groups(points: DataFrame, by: list[str], function, schema: str) -> DataFrame:
    """A user's pandas function on each leaf or piece."""
    return points.groupBy(*by).applyInPandas(function, schema)


__all__ = ["bounds", "box_payload", "check_flat", "dot", "flattened", "map_groups", "moment_payload", "newest", "nodes_above", "range_payload", "rollup", "subtree", "tree_leaves", "with_centres"]
