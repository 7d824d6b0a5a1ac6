"""``fixed_radius_pairs_pbc`` over points that lie outside of one period."""

import duckdb
import numpy as np

from astrolith.plans import registry


def test_points_beyond_a_period_follow_the_sql(spark, tmp_path):
    rng = np.random.default_rng(3)
    xyz = np.r_[rng.uniform(-1.3, 1.3, (150, 3)), [[-0.4, 0, 0], [0.4, 0, 0], [1.2, 0, 0], [0.01, 0.79, -0.79]]]
    rows = [(k, [*map(float, p), 0.0, 0.0, 0.0], k % 3) for k, p in enumerate(xyz)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()["fixed_radius_pairs_pbc"]).fetchall()
    got = [tuple(r) for r in registry.queries()["fixed_radius_pairs_pbc"](spark, str(tmp_path)).select("src", "dst").collect()]
    assert sorted(got) == sorted(want) and len(want) > 100
