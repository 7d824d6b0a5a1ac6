"""Connected components by randomised contraction.

Each round gives every vertex a pseudo-random rank, points it at the lowest ranked
vertex among itself and its neighbours, and replaces the edges by edges between the
vertices pointed at. Fresh ranks in each round make the expected number of vertices
fall by a constant factor whatever the shape of the graph (long chains included), so
there are O(log n) rounds and their total size is a small multiple of the input.
All state is DataFrames; the driver sees one count per round. Once no more than ``FEW``
edges are left, one task joins their ends, which saves the many rounds with little in them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolith.session import cut, shuffled

#: Edges that one task may hold.
FEW = 1 << 16


def _rank(col: str, seed: int):
    return F.struct(F.xxhash64(F.col(col), F.lit(seed)).alias("h"), F.col(col).alias("id"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(id, to)`` of the ends of all edges: the root of each tree of a union-find forest."""
    up: dict[int, int] = {}

    def root(v: int) -> int:
        while up[v] != v:
            up[v] = v = up[up[v]]
        return v

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for v in (a, b):
                up.setdefault(v, v)
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    ids = list(up)
    yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([root(v) for v in ids], pa.int64())], names=["id", "to"])


def roots(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 200) -> DataFrame:
    """``(id, root)`` for every vertex of ``edges``: vertices are connected if they share a root.

    Self loops, repeated and mirrored edges are allowed; null ends are ignored. An empty
    edge table gives an empty result.
    """
    spark = edges.sparkSession
    a, b = F.col(src), F.col(dst)
    live = cut(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        .distinct()
    )
    maps: list[DataFrame] = []
    for k in range(max_rounds):
        left = live.limit(FEW + 1).count()
        if not left:
            break
        if left <= FEW:
            maps.append(cut(live.select(F.col("a").cast("long"), F.col("b").cast("long")).coalesce(1).mapInArrow(_joined, "id long, to long")))
            break
        both = live.select(F.col("a").alias("id"), F.col("b").alias("nbr")).unionByName(
            live.select(F.col("b").alias("id"), F.col("a").alias("nbr"))
        )
        step = (
            both.groupBy("id")
            .agg(F.min(_rank("nbr", k)).alias("best"))
            .select("id", F.least(_rank("id", k), F.col("best"))["id"].alias("to"))
        )
        to_a = step.select(F.col("id").alias("a"), F.col("to").alias("ta"))
        to_b = step.select(F.col("id").alias("b"), F.col("to").alias("tb"))
        # One write a round: the edges with the vertices that their ends point at give both the map and the next edges.
        moved = cut(live.join(to_a, "a").join(to_b, "b"))
        maps.append(
            moved.select(F.col("a").alias("id"), F.col("ta").alias("to"))
            .unionByName(moved.select(F.col("b").alias("id"), F.col("tb").alias("to")))
            .distinct()
        )
        live = (
            moved.where(F.col("ta") != F.col("tb"))
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
            .distinct()
        )
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if not maps:
        return live.select(F.col("a").alias("id"), F.col("b").alias("root"))
    final = maps[-1].select("id", F.col("to").alias("root"))
    for step in reversed(maps[:-1]):
        later = final.select(F.col("id").alias("to"), F.col("root").alias("later"))
        final = step.join(shuffled(later), "to", "left").select("id", F.coalesce("later", "to").alias("root"))
    return cut(final)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(id, component)``: component is the smallest id of the vertex's connected component."""
    root = roots(edges, src, dst)
    least = root.groupBy("root").agg(F.min("id").alias("component"))
    return root.join(least, "root").select("id", "component")
