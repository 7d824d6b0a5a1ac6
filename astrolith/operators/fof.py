"""Friends-of-friends: connected components of the fixed-radius graph."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolith.functions.geometry import AXES
from astrolith.operators.components import connected_components
from astrolith.operators.spatial_join import cells, radius_pairs
from astrolith.session import cut, shuffled


def label_by_edges(points: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, label)``: the least id of each point's component; points without an edge label themselves."""
    comp = connected_components(edges)
    return points.select("id").join(shuffled(comp), "id", "left").select("id", F.coalesce("component", "id").alias("label"))


def _dense_size(link: float, period: float) -> tuple[float, int]:
    """Side of cells whose points, and those of cells that share a face, are friends; and cells per period (0: open)."""
    size = link / math.sqrt(6.0) * (1 - 1e-9)
    if period > 0:
        count = math.ceil(period / size)
        return period / count, count
    return size, 0


def dense_cells(points: DataFrame, link: float, period: float = 0.0) -> DataFrame:
    """``(cx, cy, cz, n, rep)``: cells of side link/sqrt(6) (a hair less, or what divides the period), whose points are all
    friends, and so are those of cells that share a face."""
    cx, cy, cz = cells(*_dense_size(link, period))
    return points.select("id", cx.alias("cx"), cy.alias("cy"), cz.alias("cz")).groupBy("cx", "cy", "cz").agg(F.count("*").alias("n"), F.min("id").alias("rep"))


#: Offsets of cells that may hold friends: gaps of |d| - 1 cells on each axis must not exceed sqrt(6) cells in all.
STENCIL = [(i, j, k) for i in range(-3, 4) for j in range(-3, 4) for k in range(-3, 4) if (i, j, k) > (0, 0, 0) and sum(max(abs(d) - 1, 0) ** 2 for d in (i, j, k)) <= 6]
FACES = {(0, 0, 1), (0, 1, 0), (1, 0, 0)}
#: Different positions of a cell that come as one array.
CELL_BLOCK = 512


def _first_friend(pairs: DataFrame, link: float, period: float) -> DataFrame:
    """Of pairs of blocks those that hold two friends: ``(src, dst)``. Arrays have about ``CELL_BLOCK`` positions at most."""
    b2 = link * link

    def place(cell: pa.StructArray) -> np.ndarray:
        return np.stack([cell.field(c).to_numpy(zero_copy_only=False) for c in AXES], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                a, b = place(batch.column(2)[k].values), place(batch.column(3)[k].values)
                for at in range(0, len(a), 256):
                    d = a[at : at + 256, None, :] - b[None, :, :]
                    if period > 0:
                        d -= period * np.round(d / period)
                    if ((d * d).sum(axis=2) <= b2).any():
                        hit[k] = True
                        break
            yield pa.record_batch([c.filter(pa.array(hit)) for c in (batch.column(0), batch.column(1))], names=["src", "dst"])

    return pairs.select("src", "dst", "p", "q").mapInArrow(run, "src long, dst long").distinct()


def contracted_edges(points: DataFrame, link: float, period: float = 0.0) -> DataFrame:
    """Edges with the components of all friend pairs, without a test inside cells or between cells that share a face.

    For dense data: rows are cells, not pairs of points, so a clump costs its number of cells.
    Points in one cell are joined to the cell's least id; cells of the stencil are tested up to the first friends, over
    their different positions in blocks of bounded size. In a periodic box (longer than two links) cells divide the
    period and the stencil wraps around.
    """
    size, count = _dense_size(link, period)
    names = ["cx", "cy", "cz"]
    placed = points.select("id", *AXES, *(c.alias(n) for c, n in zip(cells(size, count), names)))
    inside_of = cut(placed.groupBy(*names).agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    inside = placed.select("id", *names).join(inside_of, names).where("id <> rep").select(F.col("rep").alias("src"), F.col("id").alias("dst"))
    moved = lambda c, d: F.pmod(F.col(c) + d, F.lit(count)).cast("long") if count else F.col(c) + d
    offsets = F.array(*(F.struct(moved("cx", i).alias("cx"), moved("cy", j).alias("cy"), moved("cz", k).alias("cz"), F.lit((i, j, k) in FACES).alias("face")) for i, j, k in STENCIL))
    keys = inside_of.select(F.col("rep").alias("src"), F.explode(F.array_distinct(offsets) if count else offsets).alias("o")).select("src", "o.*")
    met = cut(keys.join(inside_of.select(*names, F.col("rep").alias("dst")), names).where("src <> dst").groupBy("src", "dst").agg(F.max("face").alias("face")))
    faces = met.where("face").select("src", "dst")
    # A block is a share of the cell's positions by hash, so that equal positions fall together and cells of any size are cut.
    blocks = F.ceil(F.col("n") / F.lit(CELL_BLOCK))
    dealt = placed.select(*AXES, *names).distinct().join(inside_of, names).groupBy("rep", F.pmod(F.xxhash64(*AXES), blocks).alias("block")).agg(F.collect_list(F.struct(*AXES)).alias("ps"))
    dealt = cut(dealt)
    rest = met.where("not face").join(dealt.select(F.col("rep").alias("src"), F.col("ps").alias("p")), "src").join(dealt.select(F.col("rep").alias("dst"), F.col("ps").alias("q")), "dst")
    return inside.unionByName(faces).unionByName(_first_friend(rest, link, period))


def friends_of_friends(points: DataFrame, link: float, period: float = 0.0, method: str = "pairs") -> DataFrame:
    """``(id, label)``. ``method="cells"`` contracts dense cells first, ``"certified"`` walks trees of nodes with certificates
    (for clumps of any density); all give the same labels."""
    if method == "cells":
        return label_by_edges(points, contracted_edges(points, link, period))
    if method == "certified":
        from astrolith.operators import certified

        return certified.friends_of_friends(points, link, period)
    return label_by_edges(points, radius_pairs(points, link, period).select("src", "dst"))


def fragments(points: DataFrame, link: float, piece: str = "piece", period: float = 0.0) -> DataFrame:
    """``(id, piece, label)``: friends-of-friends inside each piece only."""
    edges = radius_pairs(points, link, period, keep=(piece,)).where(F.col(f"src_{piece}") == F.col(f"dst_{piece}")).select("src", "dst")
    return points.select("id", piece).join(label_by_edges(points, edges), "id").select("id", piece, "label")


def merge_edges(points: DataFrame, labels: DataFrame, link: float, piece: str = "piece", period: float = 0.0, within: str | None = None) -> DataFrame:
    """Distinct ``(lo, hi)`` pairs of fragment labels that friends in different pieces join; with ``within``, only inside a region."""
    pairs = radius_pairs(points, link, period, keep=(piece, within) if within else (piece,))
    if within:
        pairs = pairs.where(F.col(f"src_{within}") == F.col(f"dst_{within}"))
    cross = pairs.where(F.col(f"src_{piece}") != F.col(f"dst_{piece}")).select("src", "dst")
    a, b = labels.select(F.col("id").alias("src"), F.col("label").alias("la")), labels.select(F.col("id").alias("dst"), F.col("label").alias("lb"))
    return cross.join(a, "src").join(b, "dst").where("la <> lb").select(F.least("la", "lb").alias("lo"), F.greatest("la", "lb").alias("hi")).distinct()


def relabel(labels: DataFrame, changes: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """Replaces labels by a map; a label that isn't in it stays."""
    return labels.join(changes.select(F.col(old).alias("label"), F.col(new).alias("_new")), "label", "left").select("id", F.coalesce("_new", "label").alias("label"))


def merged_labels(labels: DataFrame, merges: DataFrame) -> DataFrame:
    """Labels of the whole from fragments and merge edges."""
    comp = connected_components(merges, "lo", "hi").select(F.col("id").alias("old"), F.col("component").alias("new"))
    return relabel(labels.select("id", "label"), comp)


def merged_by_regions(points: DataFrame, labels: DataFrame, link: float, piece: str = "piece", region: str = "region", period: float = 0.0) -> DataFrame:
    """Merges in two rounds, inside regions (each holds whole pieces) and then between them over fewer labels: the same labels."""
    inside = cut(merged_labels(labels, merge_edges(points, labels, link, piece, period, within=region)))
    return merged_labels(inside, merge_edges(points, inside, link, region, period))


def untouched(labels: DataFrame, merges: DataFrame) -> DataFrame:
    """Fragment labels that no merge edge names."""
    ends = merges.select(F.col("lo").alias("label")).unionByName(merges.select(F.col("hi").alias("label"))).distinct()
    return labels.select("label").distinct().join(ends, "label", "left_anti")


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count("*").alias("size"))


def size_histogram(labels: DataFrame, min_members: int = 1) -> DataFrame:
    """``(bin, n_components, n_points, max_size)`` by floor(log2(size)), for components of ``min_members`` and more."""
    sizes = component_sizes(labels).where(F.col("size") >= min_members)
    log2 = (F.length(F.bin("size")) - 1).cast("int")
    return sizes.groupBy(log2.alias("bin")).agg(F.count("*").alias("n_components"), F.sum("size").alias("n_points"), F.max("size").alias("max_size"))


def check_labels(labels: DataFrame) -> DataFrame:
    """One row of counts that must be zero: null labels, labels above their id, labels that aren't a point of the component."""
    own = labels.select(F.col("id").alias("label"), F.col("label").alias("of"))
    return labels.join(own, "label", "left").agg(
        F.count_if(F.col("label").isNull()).alias("null_labels"), F.count_if(F.col("label") > F.col("id")).alias("above"), F.count_if(F.col("of").isNull() | (F.col("of") != F.col("label"))).alias("foreign")
    )


def same_partition(a: DataFrame, b: DataFrame) -> DataFrame:
    """Points on which two labelings differ, after both are made canonical (least id)."""
    canon = lambda d: d.join(d.groupBy("label").agg(F.min("id").alias("least")), "label").select("id", F.col("least").alias("label"))
    x, y = canon(a), canon(b)
    return x.exceptAll(y).unionByName(y.exceptAll(x))


