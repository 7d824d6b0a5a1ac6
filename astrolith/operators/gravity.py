"""Gravity (G = 1): direct sums, opening of tree nodes level by level, and the leapfrog step."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from astrolith.functions import keys
from astrolith.functions.geometry import AXES, sphere_meets_box
from astrolith.operators.blocks import block_pairs
from astrolith.operators.partition import assign_cells, leaves
from astrolith.operators.tree import moment_payload, nodes_above, with_centres
from astrolith.operators.universe import Universe, with_key
from astrolith.session import cut


def softened(r2: Column, h: Column) -> Column:
    """``1 / r^3`` softened by a cubic spline with support ``h`` (the sum of both softenings)."""
    r = F.sqrt(r2)
    u = 2.0 * r / h
    inner = 8.0 / (h * h * h) * (4.0 / 3.0 - 1.2 * u * u + 0.5 * u * u * u)
    outer = 1.0 / (r2 * r) * (-1.0 / 15.0 + 8.0 / 3.0 * u * u * u - 3.0 * u * u * u * u + 1.2 * u * u * u * u * u - 1.0 / 6.0 * u * u * u * u * u * u)
    return F.when((h <= 0) | (r >= h), 1.0 / (r2 * r)).when(u < 1, inner).otherwise(outer)


def softened_array(r2: np.ndarray, h: np.ndarray) -> np.ndarray:
    r = np.sqrt(r2)
    with np.errstate(divide="ignore", invalid="ignore"):
        u = 2.0 * r / h
        inner = 8.0 / h**3 * (4.0 / 3.0 - 1.2 * u**2 + 0.5 * u**3)
        outer = (-1.0 / 15.0 + 8.0 / 3.0 * u**3 - 3.0 * u**4 + 1.2 * u**5 - u**6 / 6.0) / (r2 * r)
        far = 1.0 / (r2 * r)
    out = np.where((h <= 0) | (r >= h), far, np.where(u < 1, inner, outer))
    return np.where(r2 > 0, out, 0.0)  # coincident points exert nothing


FORCE = ["id", "x", "y", "z", "mass", "soft"]
PULLS = "id long, ax double, ay double, az double"


#: Targets and sources of a round of the kernel, so that its arrays stay in a core's cache; blocks whose sums a task holds.
TARGETS, SOURCES, HELD = 128, 1024, 64


def _pull_of_block(same: bool, a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """What the points of two blocks exert on each other, as ``(3, n)`` sums of either; each pair of points is looked at
    once. Of a block with itself only the first is of use. Coincident points exert nothing."""
    on_a, on_b = np.zeros((3, len(a[0]))), np.zeros((3, len(b[0])))
    flat, low = np.empty((5, TARGETS * SOURCES)), np.empty(TARGETS * SOURCES, bool)
    h2 = (a[5].max() + b[5].max()) ** 2
    for i in range(0, len(a[0]), TARGETS):
        p = [c[i : i + TARGETS] for c in a]
        for j in range(0, len(b[0]), SOURCES):
            q = [c[j : j + SOURCES] for c in b]
            m, n = len(p[0]), len(q[0])
            *d, r2, w = (c[: m * n].reshape(m, n) for c in flat)
            for k in range(3):
                np.subtract(q[k + 1], p[k + 1][:, None], out=d[k])
            np.multiply(d[0], d[0], out=r2)
            for k in (1, 2):
                np.add(r2, np.multiply(d[k], d[k], out=w), out=r2)
            np.multiply(np.sqrt(r2, out=w), r2, out=w)
            with np.errstate(divide="ignore"):
                np.divide(1.0, w, out=w)
            # Few pairs are near enough to be softened.
            near = np.flatnonzero(np.less_equal(r2.ravel(), h2, out=low[: m * n]))
            w.ravel()[near] = softened_array(r2.ravel()[near], p[5][near // n] + q[5][near % n])
            for k in range(3):
                f = np.multiply(d[k], w, out=r2)
                on_a[k, i : i + m] += f @ q[4]
                if not same:
                    on_b[k, j : j + n] -= p[4] @ f
    return on_a, on_b


def _pull_of_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks to a row for each of their points; a task adds up for as many blocks as it may hold."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sums() -> pa.RecordBatch:
        ids, acc = np.concatenate([v[0] for v in held.values()]), np.concatenate([v[1] for v in held.values()], axis=1)
        held.clear()
        return pa.record_batch([pa.array(ids), *(pa.array(c) for c in acc)], names=["id", "ax", "ay", "az"])

    for batch in batches:
        for i in range(batch.num_rows):
            ta, tb = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            a, b = ([batch.column(k)[i].values.field(c).to_numpy(zero_copy_only=False) for c in FORCE] for k in (2, 3))
            on_a, on_b = _pull_of_block(ta == tb, a, b)
            for block, ids, acc in ((ta, a[0], on_a), (tb, b[0], on_b))[: 1 + (ta != tb)]:
                held[block] = (ids, held[block][1] + acc) if block in held else (ids, acc)
            if len(held) >= HELD:
                yield sums()
    if held:
        yield sums()


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Starts and lengths of lists of points, and the points' columns."""
    ends = column.offsets.to_numpy()
    rows = column.values
    return ends[:-1].astype(np.int64), np.diff(ends).astype(np.int64), [rows.field(k).to_numpy(zero_copy_only=False) for k in FORCE]


def _pull_of_leaves(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """One row for each target of each pair of small blocks: all pairs of a batch at once, ``most`` pairs of points at a time."""
    for batch in batches:
        a0, na, a = _flat(batch.column(0))
        b0, nb, b = _flat(batch.column(1))
        ends = np.cumsum(na * nb)
        at = 0
        while at < len(na):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            # A target of a pair is a run of that pair's sources.
            pair = np.repeat(np.arange(at, stop), na[at:stop])
            first = np.cumsum(na[at:stop]) - na[at:stop]
            target = a0[pair] + np.arange(len(pair)) - np.repeat(first, na[at:stop])
            size = nb[pair]
            run = np.cumsum(size) - size
            i = np.repeat(target, size)
            j = np.repeat(b0[pair] - run, size) + np.arange(size.sum())
            d = [b[k][j] - a[k][i] for k in (1, 2, 3)]
            w = softened_array(d[0] * d[0] + d[1] * d[1] + d[2] * d[2], a[5][i] + b[5][j]) * b[4][j]
            yield pa.record_batch([pa.array(a[0][target]), *(pa.array(np.add.reduceat(x * w, run)) for x in d)], names=["id", "ax", "ay", "az"])
            at = stop


def direct(points: DataFrame, size: int = 1024) -> DataFrame:
    """``(id, ax, ay, az)`` by the sum over all other points; action and reaction of a pair of blocks are found together."""
    return block_pairs(points, FORCE, ["id"], size, True).mapInArrow(_pull_of_pairs, PULLS).groupBy("id").agg(*(F.sum(c).alias(c) for c in ("ax", "ay", "az")))


def _pull(weight: Column, a: str, b: Callable[[str], str]) -> list[Column]:
    return [((F.col(b(c)) - F.col(f"{a}.{c}")) * weight).alias(f"a{c}") for c in AXES]


def _leaf_blocks(placed: DataFrame, size: int) -> DataFrame:
    """``(depth, node, rows)``: a leaf's points in arrays of bounded size. Leaves are small unless points coincide; a hash
    of the id deals a leaf of more than ``size`` points to several blocks."""
    counts = placed.groupBy("depth", "node").agg(F.ceil(F.count("*") / size).alias("_blocks"))
    dealt = placed.join(counts, ["depth", "node"]).withColumn("_block", F.pmod(F.xxhash64("id"), F.col("_blocks")))
    return dealt.groupBy("depth", "node", "_block").agg(F.collect_list(F.struct(*FORCE)).alias("rows"))


def tree_forces(points: DataFrame, theta: float = 0.7, leaf_size: int = 16, max_depth: int | None = None, open_at_most: int = 6, block: int = 512) -> DataFrame:
    """``(id, ax, ay, az)`` by the tree: a frontier of (target leaf, node) moves down one level a round.

    A node is opened if it holds few points, or if the sphere of ``radius * sqrt(4/3) / theta``
    around its centre of mass meets the target leaf's box; else its monopole acts on all of the leaf's points.
    Points of opened leaves pull one by one: pairs of leaves meet as arrays of bounded size, and a kernel reduces each
    to one row a target, so that pairs of points are never rows. Each round is one equi-join on the node key. The tree is
    as deep as its points need. With theta 0 no node is accepted and each leaf meets each leaf; the walk would list all these pairs
    as rows, so all points meet in blocks, as in ``direct``.
    """
    if theta <= 0:
        return direct(points)
    u = Universe.of(points)
    keyed = cut(with_key(points, u))
    cells = cut(leaves(keyed, leaf_size, max_depth))
    deepest = cells.agg(F.max("depth")).first()[0] or 0
    placed = cut(assign_cells(keyed, cells, deepest).select("depth", "node", *FORCE))
    nodes = cut(with_centres(nodes_above(placed, deepest, moment_payload())))
    box = [f"{c}_{e}" for c in AXES for e in ("lo", "hi")]
    sources = nodes.select("depth", "node", "n", "leaf", "mass", "radius", *(f"c{c}" for c in AXES))
    front = nodes.where("leaf").select(F.col("depth").alias("td"), F.col("node").alias("tn"), *box, F.lit(0).alias("depth"), F.lit(0).cast("long").alias("node"))
    far, near = None, None
    for _ in range(deepest + 1):
        here = front.join(sources, ["depth", "node"])
        reach = sphere_meets_box("", *(F.col(f"c{c}") for c in AXES), F.col("radius") * F.col("radius") * (4.0 / 3.0) / (theta * theta))
        judged = cut(here.withColumn("open", (F.col("n") <= open_at_most) | reach))
        accepted = judged.where("not open").select("td", "tn", "mass", *(f"c{c}" for c in AXES))
        opened = judged.where("open and leaf").select("td", "tn", F.col("depth").alias("sd"), F.col("node").alias("sn"))
        far = accepted if far is None else far.unionByName(accepted)
        near = opened if near is None else near.unionByName(opened)
        below = F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.shiftleft(F.col("node"), 3) + i))
        front = judged.where("open and not leaf").select("td", "tn", *box, (F.col("depth") + 1).alias("depth"), below.alias("node"))
    t = placed.select(F.col("depth").alias("td"), F.col("node").alias("tn"), *FORCE).alias("t")
    r2 = sum(((F.col(f"f.c{c}") - F.col(f"t.{c}")) * (F.col(f"f.c{c}") - F.col(f"t.{c}")) for c in AXES), F.lit(0.0))
    mono = t.join(far.alias("f"), ["td", "tn"]).withColumn("w", F.when(r2 > 0, F.col("f.mass") / (r2 * F.sqrt(r2))).otherwise(0.0)).select("t.id", *_pull(F.col("w"), "t", lambda c: f"f.c{c}"))
    blocks = cut(_leaf_blocks(placed, block))
    a = blocks.select(F.col("depth").alias("td"), F.col("node").alias("tn"), F.col("rows").alias("a"))
    b = blocks.select(F.col("depth").alias("sd"), F.col("node").alias("sn"), F.col("rows").alias("b"))
    pair = near.join(a, ["td", "tn"]).join(b, ["sd", "sn"]).select("a", "b").mapInArrow(_pull_of_leaves, PULLS)
    return mono.unionByName(pair).groupBy("id").agg(*(F.sum(c).alias(c) for c in ("ax", "ay", "az")))


def compare(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: rms and largest relative error."""
    a, b = approx.alias("a"), exact.alias("b")
    err = sum((F.pow(F.col(f"a.a{c}") - F.col(f"b.a{c}"), 2) for c in AXES), F.lit(0.0))
    norm = sum((F.pow(F.col(f"b.a{c}"), 2) for c in AXES), F.lit(0.0))
    return a.join(b, "id").select(F.sqrt(err / norm).alias("rel")).agg(F.sqrt(F.avg(F.col("rel") * F.col("rel"))).alias("rms"), F.max("rel").alias("worst"))


def momentum(points: DataFrame, forces: DataFrame) -> DataFrame:
    """One row: the sums of mass times acceleration, which are zero for exact forces."""
    return points.join(forces, "id").agg(*(F.sum(F.col("mass") * F.col(f"a{c}")).alias(f"p{c}") for c in AXES))


def leapfrog(points: DataFrame, forces: DataFrame, dt: float) -> DataFrame:
    """One kick and drift: both half kicks take the same acceleration, and the drift takes the fully kicked velocity."""
    joined = points.join(forces, "id", "left")
    acc = {c: F.coalesce(f"a{c}", F.lit(0.0)) for c in AXES}
    kicked = joined.withColumns({f"v{c}": F.col(f"v{c}") + acc[c] * dt / 2 + acc[c] * dt / 2 for c in AXES})
    return kicked.withColumns({c: F.col(c) + F.col(f"v{c}") * dt for c in AXES}).drop("ax", "ay", "az")


def opposing(effects: DataFrame) -> DataFrame:
    """Sums effects sent back to their sources: ``(id, ax, ay, az)`` rows to one row per id."""
    return effects.groupBy("id").agg(*(F.sum(c).alias(c) for c in ("ax", "ay", "az")))


def simulate(points: DataFrame, steps: int, dt: float, forces: Callable[[DataFrame], DataFrame] = tree_forces, before=None, after=None) -> DataFrame:
    """A driver loop with hooks before and after each step; every step cuts its lineage."""
    for k in range(steps):
        if before:
            points = before(points, k)
        points = cut(leapfrog(points, forces(points), dt).select(*points.columns))
        if after:
            points = after(points, k)
    return points
