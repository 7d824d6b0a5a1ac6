import numpy as np
import pytest

from astrolith.operators import stats
from astrolith.sources import generators, mersenne, snapshots


def test_the_published_number_and_any_start():
    assert int(mersenne.stream(mersenne.seeded(5489), 10_000)[-1]) == 9981545732273789042
    whole = mersenne.uniform_from(7, 0, 40_000)
    for start in (0, 1, 311, 312, 313, 5_000, 39_900):
        assert (mersenne.uniform_from(7, start, 100) == whole[start : start + 100]).all()
    assert whole.min() >= 0 and whole.max() < 1 and abs(whole.mean() - 0.5) < 0.01


def test_points_do_not_depend_on_blocks(spark):
    one = generators.uniform(spark, 1000, 3).orderBy("id").collect()
    assert one == generators.uniform(spark, 1000, 3, block=130).repartition(3).orderBy("id").collect()
    xyz = mersenne.uniform_from(3, 0, 3000).astype(np.float32).reshape(1000, 3)
    assert [[r.x, r.y, r.z] for r in one] == xyz.astype(float).tolist()
    assert generators.uniform(spark, 0).count() == 0


@pytest.mark.parametrize("kind", ["=f4", "=f8"])
def test_model_files(spark, tmp_path, kind):
    points = generators.uniform(spark, 50, 2)
    path = str(tmp_path / "model.dat")
    snapshots.write_model(points, path, kind)
    back = snapshots.read_points(spark, path).orderBy("id").collect()
    assert [r.x for r in back] == [r.x for r in points.orderBy("id").collect()] and {r.soft for r in back} == {0.05}
    assert snapshots.read_model(spark, path, rows=7, soft=None).where("abs(soft - 0.001) > 1e-9").count() == 0
    with open(path, "ab") as f:
        f.write(b"1")
    with pytest.raises(ValueError):
        snapshots.read_model(spark, path)


def test_edge_dump(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2), (3, 9)], "src long, dst long")
    assert stats.dump_edges(edges, str(tmp_path / "edges")).first()[:] == stats.edge_checksum(edges).first()[:] == (2, 4, 11)
