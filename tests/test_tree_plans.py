"""Plans over deep trees stay small, and components end in one task once few edges are left."""

import numpy as np
from pyspark.sql import functions as F

from astrolith.operators import components, partition, tree


def placed(spark):
    # A chain of cells down to the last level, with a point beside each.
    rows = [(k, 1 << k, float(k)) for k in range(0, 63, 3)] + [(100, 0, -1.0)]
    keyed = spark.createDataFrame(rows, "id long, key long, x double").withColumns({"y": F.lit(0.0), "z": F.col("x") * 2})
    found = partition.leaves(keyed, 1)
    return partition.assign_cells(keyed, found, 21), found


def test_roll_up_of_a_deep_tree_is_one_shuffle(spark):
    points, found = placed(spark)
    nodes = tree.nodes_above(points, 21, tree.box_payload())
    assert nodes._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    got = {(r.depth, r.node): (r.n, r.x_lo, r.z_hi, r.leaf) for r in nodes.collect()}
    want: dict = {}
    for r in points.collect():
        for d in range(r.depth + 1):
            n, low, high, _ = want.get((d, r.key >> (63 - 3 * d)), (0, np.inf, -np.inf, False))
            want[d, r.key >> (63 - 3 * d)] = (n + 1, min(low, r.x), max(high, r.z), d == r.depth)
    assert got == want and len({r.depth for r in found.collect()}) == 21
    few = partition.level_counts(points.select("key"), 21)
    assert few._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") <= 3


def test_components_by_rounds_and_in_one_task(spark, monkeypatch):
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(7, 7), (5000, 4000), (4000, 5000), (None, 3)]
    df = spark.createDataFrame(edges, "src long, dst long")
    answers = []
    for few in (0, 50, 10_000):
        monkeypatch.setattr(components, "FEW", few)
        answers.append(sorted(map(tuple, components.connected_components(df).collect())))
    assert answers[0] == answers[1] == answers[2] and len(answers[0]) == 301 + 200 + 2
    assert {c for _, c in answers[0]} == {0, 1000, 4000}
    # However many rounds the graph would take, few edges take one.
    monkeypatch.setattr(components, "FEW", 10_000)
    assert components.roots(df, max_rounds=1).count() == 503
