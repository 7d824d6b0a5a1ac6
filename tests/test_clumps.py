"""Clumped, coinciding and periodic points against brute force."""

import math

import numpy as np
import pytest

from astrolith.operators import blocks, certified, fof, gravity, spatial_join, universe
from astrolith.sources import snapshots


def frame(spark, xyz, **more):
    cols = list(more)
    rows = [(k, *map(float, p), *(more[c][k] for c in cols)) for k, p in enumerate(xyz)]
    return spark.createDataFrame(rows, "id long, x double, y double, z double" + "".join(f", {c} long" for c in cols)).repartition(3)


def clumps(seed, n=240):
    """A dense clump, a point that many share, a line, and a thin rest."""
    rng = np.random.default_rng(seed)
    return np.r_[rng.normal(0.5, 0.004, (n // 2, 3)), np.tile([[0.2, 0.3, 0.4]], (n // 6, 1)), np.c_[np.linspace(0.01, 0.99, n // 6), np.full(n // 6, 0.9), np.full(n // 6, 0.02)], rng.random((n // 6, 3))]


def labels_of(xyz, link, period=0.0):
    d = xyz[:, None] - xyz[None]
    if period:
        d -= period * np.round(d / period)
    near = (d * d).sum(2) <= link * link
    label = np.arange(len(xyz))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label.tolist()
        label = new


@pytest.mark.parametrize("period", [0.0, 1.0])
@pytest.mark.parametrize("method", ["cells", "certified"])
def test_clusters_of_clumps(spark, method, period):
    xyz = clumps(1)
    xyz[-3:] = [[0.001, 0.5, 0.5], [0.999, 0.5, 0.5], [0.95, 0.999, 0.001]]
    link = 0.2 if period else 0.03
    got = fof.friends_of_friends(frame(spark, xyz), link, period, method=method)
    assert [r.label for r in got.orderBy("id").collect()] == labels_of(xyz, link, period)


def test_contraction_cuts_large_cells(spark, monkeypatch):
    monkeypatch.setattr(fof, "CELL_BLOCK", 8)
    xyz = clumps(2)
    got = fof.friends_of_friends(frame(spark, xyz), 0.05, method="cells")
    assert [r.label for r in got.orderBy("id").collect()] == labels_of(xyz, 0.05)
    assert fof.friends_of_friends(frame(spark, xyz[:0]), 0.05, method="cells").count() == 0
    assert certified.friends_of_friends(frame(spark, xyz[:0]), 0.05).count() == 0


def neighbours(xyz, at, k, own):
    out = []
    for i, p in enumerate(at):
        d2 = ((xyz - p) ** 2).sum(1)
        out += [(i, r, j) for r, j in enumerate([j for j in np.lexsort((np.arange(len(xyz)), d2)) if not own or j != i][:k], 1)]
    return out


def test_neighbours_in_clumps(spark):
    xyz = np.round(clumps(4, 120), 4)
    counts: dict = {}
    got = spatial_join.nearest(frame(spark, xyz), 3, leaf_size=12, counts=counts).collect()
    assert sorted((r.id, r["rank"], r.nbr) for r in got) == neighbours(xyz, xyz, 3, True)
    assert counts["candidates"] < 80 * len(xyz)
    # Other targets, some far away; ids of targets that are also ids of points are left out.
    at = np.r_[np.random.default_rng(5).random((6, 3)), [[9, 9, 9], [0.2, 0.3, 0.4]]]
    queries = frame(spark, at).selectExpr("id + 10000 AS id", "x", "y", "z")
    got = spatial_join.nearest(frame(spark, xyz), 2, queries=queries).collect()
    assert sorted((r.id - 10_000, r["rank"], r.nbr) for r in got) == neighbours(xyz, at, 2, False)


def test_fewer_points_than_neighbours(spark):
    for n, k, rows in ((0, 2, 0), (3, 5, 6)):
        xyz = np.random.default_rng(n).random((n, 3)) if n else np.zeros((0, 3))
        assert spatial_join.nearest(frame(spark, xyz), k).count() == rows


def test_candidates_of_a_clump_grow_with_the_points(spark):
    made = []
    for n in (200, 800):
        counts: dict = {}
        spatial_join.nearest(frame(spark, np.r_[np.random.default_rng(6).normal(0.5, 1e-4, (3 * n // 4, 3)), np.random.default_rng(7).random((n // 4, 3))]), 3, counts=counts)
        made.append(counts["candidates"])
    assert made[1] < 6 * made[0]


def test_histogram_by_nodes(spark):
    xyz = np.r_[np.random.default_rng(8).random((70, 3)), np.tile([[0.2, 0.3, 0.4]], (20, 1))]
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(2))[~np.eye(len(xyz), dtype=bool)]
    counts: dict = {}
    got = {r["bin"]: r.n for r in blocks.pair_histogram(universe.with_key(frame(spark, xyz)), 0.02, 0.9, 6, leaf_size=8, counts=counts).collect()}
    d = d[(d >= 0.02) & (d < 0.9)]
    want = np.bincount(np.floor((np.log(d) - math.log(0.02)) / (math.log(0.9) - math.log(0.02)) * 6).astype(int), minlength=6)
    assert got == {k: int(n) for k, n in enumerate(want) if n}
    assert counts["accepted"] > 0 and counts["tested"] < len(xyz) * (len(xyz) - 1) / 2
    assert blocks.pair_histogram(universe.with_key(frame(spark, xyz[:0])), 0.02, 0.9, 6).count() == 0


def test_blocks_meet_once_in_tiles(spark):
    df = frame(spark, np.random.default_rng(9).random((50, 3)))
    for side in (1, 2, 3, 7):
        for symmetric in (True, False):
            got = [(r.ta, r.tb) for r in blocks.block_pairs(df, ["x"], ["id"], 8, symmetric, side).select("ta", "tb").collect()]
            assert sorted(got) == [(a, b) for a in range(7) for b in range(7) if a <= b or not symmetric]


def test_unknown_families_are_refused(spark, tmp_path):
    rows = frame(spark, np.zeros((2, 3))).selectExpr("*", "'ghost' AS family", "1D AS mass", "0D AS vx", "0D AS vy", "0D AS vz", "0D AS soft")
    with pytest.raises(ValueError, match="ghost"):
        snapshots.write_records(rows, str(tmp_path / "out"))


def test_hooks_run_around_each_step(spark):
    xyz = np.random.default_rng(1).random((20, 3))
    rows = frame(spark, xyz).selectExpr("*", "'dark' AS family", "1D AS mass", "0D AS vx", "0D AS vy", "0D AS vz", "0.01D AS soft")
    seen: list = []
    gravity.simulate(rows, 2, 0.01, before=lambda p, k: (seen.append(("before", k, p.count())), p)[1], after=lambda p, k: (seen.append(("after", k, p.count())), p)[1])
    assert seen == [("before", 0, 20), ("after", 0, 20), ("before", 1, 20), ("after", 1, 20)]
