"""No table that grows with the input is broadcast, however small Spark takes it to be."""

import contextlib

import numpy as np

from astrolith.operators import fof, spatial_join
from astrolith.plans import registry

SF = "/root/testdata/sf0.001"


@contextlib.contextmanager
def threshold(spark, size):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_radius_joins_are_not_broadcast(spark):
    with threshold(spark, "10m"):
        assert "BroadcastHashJoin" not in plan(registry.queries()["fixed_radius_pairs"](spark, SF))
        xyz = [(k, *map(float, p)) for k, p in enumerate(np.random.default_rng(1).random((40, 3)))]
        p = spark.createDataFrame(xyz, "id long, x double, y double, z double")
        assert "BroadcastHashJoin" not in plan(spatial_join.radius_join(p, p, 0.2))


def test_clusters_of_orders_are_not_broadcast(spark, monkeypatch):
    plans, real = [], fof.connected_components
    monkeypatch.setattr(fof, "connected_components", lambda edges: plans.append(plan(edges)) or real(edges))
    with threshold(spark, "10m"):
        plans.append(plan(registry.queries()["fof_orders"](spark, SF)))
    assert len(plans) == 2 and not any("BroadcastHashJoin" in p for p in plans)
