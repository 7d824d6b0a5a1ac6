"""``knn_orders`` over orders that lie farther apart than its SQL looks."""

import datetime

import duckdb

from astrolith.operators import spatial_join
from astrolith.plans import registry
from astrolith.sources.views import order_points


def test_far_orders_follow_the_sql(spark, tmp_path):
    day = datetime.date(1995, 1, 1)
    rows = [(1, 1, 1000.0, day), (2, 1, 1500.0, day), (3, 1, 1500.0, day + datetime.timedelta(5)), (4, 1, 48_000.0, day), (5, 1, 400_000.0, day), (6, 9, 1000.0, day)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate date").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(1, 11).selectExpr("id AS c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = registry.queries()["knn_orders"](spark, str(tmp_path)).select("id", "rank", "nbr").collect()
    want = con.execute(f"SELECT id, rank, nbr FROM ({registry.oracle_sql()['knn_orders']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and {r.id for r in got} == {1, 2, 3, 4}
    # The operator itself has no such bound.
    assert spatial_join.nearest(order_points(spark, str(tmp_path)), 2).count() == 12
