"""Friends-of-friends by walks over tree nodes with certificates, for data of any clumping.

Nodes carry their box, the least and the largest label of their points (a node is uniform if these are equal), and their
count. Two trees go down together, and each pair of nodes gets a verdict from its boxes:

* apart: the boxes are farther from each other than the link; dropped;
* settled: both nodes are uniform and have one label; dropped;
* certain: the farthest corners are within the link, so all points of both nodes are friends; taken as a whole;
* open: its children meet, and two leaves' points are tested.

What is certain costs one row whatever the nodes hold. Equal positions are friends and stand for one point, so
a leaf has few positions, or is so small that its pairs are certain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from astrolith.functions.geometry import AXES, box_max2, box_min2, box_min2_periodic, may_certify, periodic_dist2
from astrolith.operators import partition, tree, universe
from astrolith.operators.traversal import JoinSpec, dual
from astrolith.session import cut, shuffled


def _label_payload() -> tree.Payload:
    return tree.box_payload() | {"least": (F.min("label"), F.min("least")), "most": (F.max("label"), F.max("most"))}


def _verdict(link: float, period: float) -> Column:
    """Null: apart or settled; false: certain; true: open."""
    b2 = link * link
    near = box_min2_periodic("t", "s", period) if period > 0 else box_min2("t", "s")
    uniform = (F.col("t.least") == F.col("t.most")) & (F.col("s.least") == F.col("s.most"))
    settled = uniform & (F.col("t.least") == F.col("s.least"))
    # Corners of the boxes as they lie: a pair that is certain without images is certain with them.
    certain = may_certify("t", "s", b2) & (box_max2("t", "s") <= b2 * (1 - 1e-12))
    return F.when((near > b2 * (1 + 1e-12)) | settled, F.lit(None)).otherwise(~certain)


def label_edges(points: DataFrame, link: float, period: float = 0.0, leaf_size: int = 16, counts: dict | None = None) -> DataFrame:
    """``(lo, hi)`` pairs of labels with the components of all pairs of labels that friends join.

    ``points`` have positions and ``label``. ``counts``, if given, gets the numbers of certain pairs of nodes, of open pairs of
    leaves and of tested pairs of points.
    """
    at_place = cut(points.groupBy(*AXES).agg(F.min("label").alias("label"), F.count("*").alias("_n"), F.max("label").alias("_most")))
    shared = at_place.where("label <> _most").select(*AXES, F.col("label").alias("lo"))
    same = points.select(*AXES, "label").join(shuffled(shared), [*AXES]).where("label <> lo").select("lo", F.col("label").alias("hi"))
    places = cut(universe.with_key(at_place.select(*AXES, "label")))
    leaf = partition.leaves(places, leaf_size)
    deepest = leaf.agg(F.max("depth")).first()[0]
    if deepest is None:
        return same.distinct()
    placed = cut(partition.assign_cells(places, leaf, deepest).select(*AXES, "label", "depth", "node"))
    nodes = cut(tree.nodes_above(placed, deepest, _label_payload()))
    taken, near = dual(nodes, JoinSpec(_verdict(link, period), mirrored=False))
    taken = cut(taken.select("t.depth", "t.node", F.col("t.least").alias("least"), F.col("s.depth").alias("s_depth"), F.col("s.node").alias("s_node"), F.col("s.least").alias("s_least")))
    across = taken.where("least <> s_least").select(F.least("least", "s_least").alias("lo"), F.greatest("least", "s_least").alias("hi"))
    # All labels below a node of a certain pair are one.
    whole = taken.select("depth", "node").unionByName(taken.select(F.col("s_depth").alias("depth"), F.col("s_node").alias("node"))).distinct()
    inside = _labels_below(nodes, placed, whole)
    near = cut(near.select(F.struct("t.depth", "t.node").alias("a"), F.struct("s.depth", "s.node").alias("b")))
    side = lambda c: placed.select(F.struct("depth", "node").alias(c), F.struct("label", *AXES).alias(f"{c}p"))
    met = near.join(shuffled(side("a")), "a").join(shuffled(side("b")), "b").where("ap.label <> bp.label")
    if counts is not None:
        counts |= {"certain": taken.count(), "open_leaves": near.count(), "tested": met.count()}
    tested = met.where(periodic_dist2("ap", "bp", period) <= link * link).select(F.least("ap.label", "bp.label").alias("lo"), F.greatest("ap.label", "bp.label").alias("hi"))
    return same.unionByName(across).unionByName(inside).unionByName(tested).distinct()


def _labels_below(nodes: DataFrame, placed: DataFrame, whole: DataFrame) -> DataFrame:
    """Edges from the least label of each whole node to all labels below it: a leaf takes that of the highest whole node above."""
    marked = shuffled(nodes.join(whole, ["depth", "node"]).select(F.col("depth").alias("_up"), F.col("node").alias("_at"), F.col("least").alias("to")))
    above = nodes.where("leaf").select("depth", "node", F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("_up"))
    above = above.withColumn("_at", F.call_function("shiftright", F.col("node"), (3 * (F.col("depth") - F.col("_up"))).cast("int")))
    leaves = above.join(marked, ["_up", "_at"]).groupBy("depth", "node").agg(F.min_by("to", "_up").alias("to"))
    return placed.select("depth", "node", "label").join(shuffled(leaves), ["depth", "node"]).where("label <> to").select(F.least("label", "to").alias("lo"), F.greatest("label", "to").alias("hi"))


def friends_of_friends(points: DataFrame, link: float, period: float = 0.0, leaf_size: int = 16, counts: dict | None = None) -> DataFrame:
    """``(id, label)``: the least id of each point's component."""
    from astrolith.operators.fof import label_by_edges

    edges = label_edges(points.select(F.col("id").alias("label"), *AXES), link, period, leaf_size, counts)
    return label_by_edges(points, edges.select(F.col("lo").alias("src"), F.col("hi").alias("dst")))


def merge_edges(points: DataFrame, labels: DataFrame, link: float, period: float = 0.0, leaf_size: int = 16, counts: dict | None = None) -> DataFrame:
    """``(lo, hi)`` pairs of fragment labels: those of ``fof.merge_edges`` or others with the same components.

    ``labels`` are complete inside each piece, so pairs of nodes inside one fragment are settled without a test."""
    return label_edges(points.select("id", *AXES).join(labels.select("id", "label"), "id"), link, period, leaf_size, counts)
