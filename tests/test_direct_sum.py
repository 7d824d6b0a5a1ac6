"""The direct sum by pairs of blocks, each looked at once."""

import numpy as np

from astrolith.operators import gravity


def frame(spark, rows):
    return spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(rows)], "id long, x double, y double, z double, mass double, soft double").repartition(3)


def particles(n=150):
    rng = np.random.default_rng(4)
    xyz = np.r_[rng.random((n - 30, 3)), np.tile([[0.2, 0.3, 0.4]], (10, 1)), 0.6 + 0.01 * rng.random((20, 3))]
    return np.c_[xyz, rng.random(n), np.where(np.arange(n) % 3, 0.05 * rng.random(n), 0.0)]


def brute(rows):
    p, mass, soft = rows[:, :3], rows[:, 3], rows[:, 4]
    d = p[None] - p[:, None]
    w = gravity.softened_array((d**2).sum(2), soft[:, None] + soft[None]) * mass
    return (d * w[..., None]).sum(1)


def test_unequal_masses_and_softenings(spark, monkeypatch):
    rows = particles()
    for targets, sources, held in ((128, 1024, 64), (7, 11, 3)):
        monkeypatch.setattr(gravity, "TARGETS", targets)
        monkeypatch.setattr(gravity, "SOURCES", sources)
        monkeypatch.setattr(gravity, "HELD", held)
        a = [np.arange(len(rows)), *rows.T]
        on_a, on_b = gravity._pull_of_block(False, [c[:60] for c in a], [c[60:] for c in a])
        one, two = gravity._pull_of_block(True, [c[:60] for c in a], [c[:60] for c in a])[0], gravity._pull_of_block(True, [c[60:] for c in a], [c[60:] for c in a])[0]
        assert np.allclose(np.concatenate([on_a + one, on_b + two], 1).T, brute(rows), rtol=1e-9, atol=1e-9)
    got = gravity.direct(frame(spark, rows), size=40).orderBy("id").collect()
    assert np.allclose([r[1:] for r in got], brute(rows), rtol=1e-9, atol=1e-9) and len(got) == len(rows)


def test_opening_every_node_makes_no_rows_of_pairs_of_leaves(spark, monkeypatch):
    rows = particles()
    monkeypatch.setattr(gravity, "nodes_above", None)  # no walk
    got = gravity.tree_forces(frame(spark, rows), 0.0).orderBy("id").collect()
    assert np.allclose([r[1:] for r in got], brute(rows), rtol=1e-9, atol=1e-9)
