import numpy as np
import pytest
from pyspark.sql import functions as F

from astrolith import config
from astrolith.functions import geometry as g
from astrolith.functions import keys
from astrolith.operators import components, fof, gravity, partition, spatial_join, stats, tree, universe
from astrolith.schema import POINTS
from astrolith.sources import generators, snapshots


def points(spark, xyz, **more):
    rows = [(i, "dark", 1.0, *map(float, p), 0.0, 0.0, 0.0, more.get("soft", 0.0)) for i, p in enumerate(xyz)]
    return spark.createDataFrame(rows, POINTS)


def brute_labels(xyz, b, period=0.0):
    d = xyz[:, None] - xyz[None]
    if period:
        d -= period * np.sign(d / period) * np.floor(np.abs(d / period) + 0.5)
    near = (d**2).sum(2) <= b * b
    lab = np.arange(len(xyz))
    while True:
        new = np.where(near, lab[None, :], len(xyz)).min(1)
        if (new == lab).all():
            return lab.tolist()
        lab = new


def box_frame(spark, a, b):
    names = [f"{c}_{e}" for c in "xyz" for e in ("lo", "hi")]
    s = lambda v, n: F.struct(*(F.lit(float(x)).alias(k) for x, k in zip(v, names))).alias(n)
    return spark.range(1).select(s(a, "a"), s(b, "b"))


@pytest.mark.parametrize(
    "a,b,want", [((0, 1, 0, 0, 0, 0), (2, 3, 0, 0, 0, 0), 9), ((0, 1, 0, 1, 0, 1), (0, 1, 0, 1, 0, 1), 3), ((0, 0, 0, 4, 0, 0), (0, 0, 1, 2, 0, 0), 9)]
)
def test_farthest_corners(spark, a, b, want):
    assert box_frame(spark, a, b).select(g.box_max2("a", "b")).first()[0] == want


def test_periodic_gaps(spark):
    f = box_frame(spark, (0, 0.1, 0, 0, 0, 0), (0.85, 0.95, 0, 0, 0, 0))
    assert f.select(F.sqrt(g.box_min2_periodic("a", "b", 1.0))).first()[0] == pytest.approx(0.05)
    assert f.select(F.sqrt(g.box_min2("a", "b"))).first()[0] == pytest.approx(0.75)
    assert f.select(g.encloses("a", "a"), g.encloses("a", "b")).first()[:] == (True, False)


def test_morton_and_hilbert_keys(spark):
    rows = [(x, y, z) for x in (0, 1, 5, 2**21 - 1) for y in (0, 3, 2**20) for z in (0, 7, 2**21 - 1)]
    f = spark.createDataFrame(rows, "x long, y long, z long")
    for r in f.select("*", keys.morton(F.col("x"), F.col("y"), F.col("z")).alias("k")).collect():
        assert r.k == sum((v >> b & 1) << (3 * b + s) for b in range(21) for v, s in ((r.x, 2), (r.y, 1), (r.z, 0)))
    cube = spark.range(512).select(*((F.floor(F.col("id") / d) % 8).cast("long").alias(c) for c, d in (("x", 64), ("y", 8), ("z", 1))))
    walk = cube.withColumn("k", keys.hilbert(F.col("x"), F.col("y"), F.col("z"))).orderBy("k").collect()
    steps = {abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) for a, b in zip(walk, walk[1:])}
    assert steps == {1} and len({r.k for r in walk}) == 512


def test_friends_of_friends_edge_cases(spark):
    chain = points(spark, [(0.5 * k, 0, 0) for k in range(12)])
    for method in ("pairs", "cells"):
        assert {r.label for r in fof.friends_of_friends(chain, 0.5, method=method).collect()} == {0}
    same = points(spark, [(1, 1, 1)] * 5 + [(-3, 0, 0)])
    assert sorted(r.label for r in fof.friends_of_friends(same, 0.1, method="cells").collect()) == [0] * 5 + [5]
    assert fof.friends_of_friends(chain.limit(0), 0.5).count() == 0
    assert [r.label for r in fof.friends_of_friends(chain.limit(1), 0.5).collect()] == [0]


def test_friends_of_friends_against_brute_force(spark):
    xyz = np.random.default_rng(5).uniform(-1, 1, (220, 3))
    p = points(spark, xyz)
    for b in (0.15, 0.3):
        want = brute_labels(xyz, b)
        for method in ("pairs", "cells"):
            assert [r.label for r in fof.friends_of_friends(p, b, method=method).orderBy("id").collect()] == want
    for period, b in ((2.0, 0.2), (2.0, 0.9)):  # the second has two cells on each axis only
        assert [r.label for r in fof.friends_of_friends(p, b, period).orderBy("id").collect()] == brute_labels(xyz, b, period)
    with pytest.raises(ValueError):
        universe.check_period(1.0, universe.Universe.of(p), 0.1)


def test_components_of_long_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(7, 7), (5000, 4000), (4000, 5000), (None, 3)]
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[k] == 0 for k in range(301)) and all(got[1000 + k] == 1000 for k in range(200)) and got[5000] == 4000


def test_trees_conserve_points(spark):
    xyz = np.r_[np.random.default_rng(1).random((150, 3)), np.tile([[0.5, 0.5, 0.5]], (40, 1))]
    keyed = universe.with_key(points(spark, xyz))
    for leaf in (1, 16):
        found = tree.tree_leaves(keyed, leaf, 6).collect()
        assert sum(r.n for r in found) == 190 and all(r.n <= leaf or r.depth == 6 for r in found)
    deep = tree.tree_leaves(keyed, 500, 6, floor_depth=1).collect()
    assert sum(r.n for r in deep) == 190 and {r.depth for r in deep} == {1}
    nodes = tree.rollup(keyed, 2, tree.moment_payload())
    assert {r.depth: r.s for r in nodes.groupBy("depth").agg(F.sum("n").alias("s")).collect()} == {0: 190, 1: 190, 2: 190}
    table = tree.flattened(nodes.select("depth", "node", "n", (F.col("depth") == 2).alias("leaf")))
    flat = table.orderBy("index").collect()
    assert flat[0].child_begin == 1 and [r["index"] for r in flat] == list(range(len(flat)))
    assert [r.part_begin for r in flat if r.depth == 2] == np.r_[0, np.cumsum([r.n for r in flat if r.depth == 2])[:-1]].tolist()
    assert tree.check_flat(table).first()[:] == (0, 0, 0, 0)
    wrong = table.withColumns({"part_begin": F.when(F.col("index") == 3, 7).otherwise(F.col("part_begin")), "child_begin": F.when(F.col("index") == 1, 2).otherwise(F.col("child_begin"))})
    assert min(tree.check_flat(wrong).first()[:2]) > 0
    assert tree.dot(nodes.where("depth < 2")).startswith("digraph")


def test_cuts_by_counting_equal_ranks(spark):
    rng = np.random.default_rng(2)
    for rows in ([(int(rng.choice([0, 5, 2**62 + 3, rng.integers(2**62)])), i - 50) for i in range(300)], [(7, i) for i in range(30)], [(1, 1)]):
        got = {(r.key, r.id): r.piece for r in partition.by_key_ranges(spark.createDataFrame(rows, "key long, id long").repartition(3), 4).collect()}
        ranges = [partition.range_of_reader(len(rows), p, 4) for p in range(4)]
        assert got == {r: p for p, (start, n) in enumerate(ranges) for r in sorted(rows)[start : start + n]}


def test_ranks_do_not_depend_on_partitions(spark):
    f = spark.range(1000).select(F.pmod(F.col("id") * 7, F.lit(1000)).alias("v")).repartition(5)
    assert all(r.rank == r.v for r in partition.global_rank(f, "v").collect())
    assert [partition.range_of_reader(10, k, 4) for k in range(4)] == [(0, 3), (3, 3), (6, 2), (8, 2)]


def test_placements(spark):
    pieces = spark.createDataFrame([(k, 10, float(k % 4), float(k // 4), 0.0) for k in range(16)], "piece long, n long, x double, y double, z double")
    assert {r["count"] for r in partition.place_by_prefix(pieces, 4).groupBy("worker").count().collect()} == {4}


def test_leaves_have_no_depth_cap(spark):
    # A dense clump of cells that differ in their last bits only, three equal keys, and single points.
    ids = [5] * 3 + [(1 << 62) + k for k in range(40)] + [k << 57 for k in range(1, 20)]
    keyed = spark.createDataFrame([(k, v) for k, v in enumerate(ids)], "id long, key long")
    for bits in (3, 1):
        got = {(r.depth, r.node): r.n for r in partition.leaves(keyed, 2, bits=bits).collect()}
        want = {}
        deepest = 63 // bits
        for v in ids:
            d = next(d for d in range(deepest + 1) if d == deepest or sum(x >> (63 - bits * d) == v >> (63 - bits * d) for x in ids) <= 2)
            want[d, v >> (63 - bits * d)] = sum(x >> (63 - bits * d) == v >> (63 - bits * d) for x in ids)
        assert got == want
        cells = spark.createDataFrame([(*k, n) for k, n in got.items()], "depth int, node long, n long")
        assert partition.assign_cells(keyed, cells, deepest, bits).count() == len(ids)


def test_zero_mass_has_the_centre_of_its_box(spark):
    nodes = spark.createDataFrame([(2, 0.0, *[0.0] * 3, *[0.0, 2.0] * 3)], "n long, mass double, mx double, my double, mz double, x_lo double, x_hi double, y_lo double, y_hi double, z_lo double, z_hi double")
    r = tree.with_centres(nodes).first()
    assert (r.cx, r.cy, r.cz) == (1.0, 1.0, 1.0) and abs(r.radius - 3**0.5) < 1e-12


def test_forces(spark):
    xyz = np.random.default_rng(2).random((300, 3))
    p = points(spark, xyz, soft=0.02)
    exact = gravity.direct(p, size=64)
    one = gravity.compare(gravity.tree_forces(p, 0.0), exact).first()
    assert one.worst < 1e-9
    assert gravity.compare(gravity.tree_forces(p, 0.7), exact).first().rms < 0.05
    assert max(map(abs, gravity.momentum(p, exact).first())) < 1e-8
    two = gravity.direct(points(spark, [(0, 0, 0), (0, 0, 0)])).collect()
    assert all(r.ax == r.ay == r.az == 0 for r in two)


def test_known_forces(spark):
    from astrolith.sources.views import embedding_points

    p = embedding_points(spark, "/root/testdata/sf0.01").withColumns({"mass": F.lit(1 / 500), "soft": F.lit(0.05)})
    r = gravity.direct(p).where("id = 0").first()
    assert [r.ax, r.ay, r.az] == pytest.approx([-3.4876255154, -11.4609214519, 2.6337802907], abs=1e-8)


def test_nearest(spark):
    xyz = np.r_[np.random.default_rng(3).random((80, 3)), [[9, 9, 9]]]
    got = spatial_join.nearest(points(spark, xyz), 2).orderBy("id", "rank").collect()
    d = ((xyz[:, None] - xyz[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    assert [r.nbr for r in got] == np.argsort(d, axis=1, kind="stable")[:, :2].ravel().tolist()


def test_attribute_files(spark, tmp_path):
    top = str(tmp_path / "snap")
    value = lambda fam, i, c: 0.125 * fam + 0.03125 * i + 0.5 * c
    sizes = {"gas": (7, ">f4"), "dark": (130, ">f8"), "star": (3, ">f4")}
    for fam, (name, (n, kind)) in enumerate(sizes.items()):
        snapshots.write_field(f"{top}/{name}/pos", np.array([[value(fam, i, c) for c in range(3)] for i in range(n)]), kind, 3.5)
    snapshots.write_field(f"{top}/dark/vel", np.array([[value(5, i, c) for c in range(3)] for i in range(130)]))
    snapshots.write_field(f"{top}/gas/mass", 0.5 + np.arange(7))
    snapshots.write_field(f"{top}/dark/mass", np.full(130, 0.0625), omit_constant=True)
    snapshots.write_field(f"{top}/star/mass", 100 + np.arange(3), ">i4")
    snapshots.write_field(f"{top}/dark/soft", 1_000_000 + np.arange(130), ">i8")
    got = snapshots.read_points(spark, top).orderBy("id").collect()
    assert len(got) == 140 and [r.id for r in got] == list(range(140)) and got[10].family == "dark"
    assert (got[8].x, got[8].vy, got[8].mass, got[8].soft) == (value(1, 1, 0), value(5, 1, 1), 0.0625, 1_000_001) and got[139].mass == 102 and got[0].soft == 0
    sliced = snapshots.read_fields(spark, top, rows=9).orderBy("id").collect()
    assert sliced == got
    with pytest.raises(ValueError):
        snapshots.read_field(f"{top}/gas/pos", 5, 3, 3)
    with pytest.raises(ValueError):
        snapshots.read_field(f"{top}/gas/mass", 0, 3, 3)
    with pytest.raises(ValueError):
        snapshots.decode_header(b"\0" * 28)
    (tmp_path / "snap/star/mass").unlink()
    with pytest.raises(FileNotFoundError):
        snapshots.read_fields(spark, top)
    (tmp_path / "none").mkdir()
    assert snapshots.read_fields(spark, str(tmp_path / "none")).count() == 0


def test_record_files(spark, tmp_path):
    rows = [(i, f, 1.0 + i, 0.5, 0.25 * i, 2.0, 1.0, 0.0, -1.0, 0.0 if f == "star" else 0.125) for i, f in enumerate(["gas"] * 3 + ["dark"] * 5 + ["star"] * 2)]
    p = spark.createDataFrame(rows, POINTS)
    path = str(tmp_path / "a.snap")
    snapshots.write_records(p, path, 1.5)
    assert snapshots.read_points(spark, path).orderBy("id").collect() == p.orderBy("id").collect()
    snapshots.records_to_fields(spark, path, str(tmp_path / "b"))
    assert snapshots.read_points(spark, str(tmp_path / "b")).orderBy("id").collect() == p.orderBy("id").collect()
    snapshots.write_attribute(p, ["x", "y"], str(tmp_path / "x.txt"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "x.txt")).collect()]
    assert len(lines) == 21 and "10" in lines
    with open(path, "r+b") as f:
        f.truncate(100)
    with pytest.raises(ValueError):
        snapshots.read_records(spark, path)


def test_generators(spark):
    u = generators.uniform(spark, 1000, 3)
    assert u.count() == 1000 and u.orderBy("id").collect() == generators.uniform(spark, 1000, 3).repartition(3).orderBy("id").collect()
    r = generators.plummer_pair(spark, 2000).agg(F.avg("x"), F.sum("mass"), F.max("vx")).first()
    assert abs(r[0]) < 1e-9 and r[1] == pytest.approx(1) and r[2] < 2


def test_config():
    c, rest = config.load(["--theta", "0.5", "--leaf-size=12", "go"], "theta = 0.9 # wide\n\nmin_pieces=4\n")
    assert (c.theta, c.leaf_size, c.min_pieces, rest) == (0.5, 12, 4, ["go"])
    with pytest.raises(ValueError):
        config.parse_file("a = 1\na = 2")
    with pytest.warns(UserWarning):
        config.load([], "nothing = 1")


def test_stream_equals_batch(spark, tmp_path):
    from astrolith.streaming.incremental import LabelStore, stream_components

    edges = [(k, k + 1) for k in range(20) if k % 5] + [(30, 20), (7, 30)]
    for k, part in enumerate((edges[:8], edges[8:])):
        spark.createDataFrame(part, "src long, dst long").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema("src long, dst long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    store = LabelStore(spark, str(tmp_path / "labels"))
    stream_components(stream, store, str(tmp_path / "cp")).awaitTermination()
    want = {r.id: r.component for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {r.id: r.label for r in store.read().collect()} == want


def test_stream_of_points_equals_batch(spark, tmp_path):
    from astrolith.streaming.incremental import PointStore, stream_components

    xyz = np.random.default_rng(12).random((60, 3))
    schema, rows = "id long, x double, y double, z double", [(k, *map(float, p)) for k, p in enumerate(xyz)]
    for k, part in enumerate((rows[40:], rows[20:40], rows[:20] + rows[35:45])):  # some come twice
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    store = PointStore(spark, str(tmp_path / "points"), 0.22)
    stream_components(stream, store, str(tmp_path / "cp")).awaitTermination()
    assert [r.label for r in store.read().orderBy("id").collect()] == brute_labels(xyz, 0.22)


def test_pair_owners_agree_from_both_sides(spark):
    f = spark.range(400).select((F.col("id") % 20).alias("a"), F.floor(F.col("id") / 20).cast("long").alias("b"))
    p, q = F.lit(3), F.lit(8)
    f = f.withColumns({"one": keys.pair_owner(F.col("a"), F.col("b"), p, q), "two": keys.pair_owner(F.col("b"), F.col("a"), q, p)})
    got = f.agg(F.count_if(F.col("one") != F.col("two")), F.count_if(F.col("one") == 3), F.count_if(F.col("one").isin(3, 8))).first()
    assert got[0] == 0 and 120 < got[1] < 280 and got[2] == 400


def test_small_helpers(spark, tmp_path):
    cuts = spark.createDataFrame([(4,), (10,), (31,)], "at long")
    others = spark.createDataFrame([(2,), (6,), (11,), (20,)], "at long")
    assert {r["at"]: r["to"] for r in partition.align(cuts, others).collect()} == {4: 2, 10: 11, 31: 20}
    sizes = spark.createDataFrame([(10,), (10,), (40,)], "n long")
    assert partition.needs_rebuild(sizes, 1.5) and not partition.needs_rebuild(sizes, 2.5) and not partition.needs_rebuild(sizes.limit(0), 1.0)
    assert {r.metric: r.value for r in stats.metrics({"a": 1, "b": 2.5}, sizes).collect()} == {"a": 1.0, "b": 2.5}
    f = box_frame(spark, (0, 0.1, 0, 0.1, 0, 0.1), (0.2, 0.3, 0, 0.1, 0, 0.1))
    assert f.select(g.may_certify("a", "b", 0.04), g.may_certify("a", "b", 0.02)).first()[:] == (True, False)
    effects = spark.createDataFrame([(1, 1.0, 2.0, 3.0), (1, -1.0, 0.5, 0.0), (2, 0.0, 0.0, 1.0)], "id long, ax double, ay double, az double")
    assert {r.id: r[1:] for r in gravity.opposing(effects).collect()} == {1: (0.0, 2.5, 3.0), 2: (0.0, 0.0, 1.0)}
    dependent = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, 4.0, 3.0), (3.0, 6.0, 4.0), (None, 1.0, 1.0)], "a double, b double, y double")
    r = stats.fit_many(dependent, ["a", "b"], "y").first()
    assert r.coefficients is None and r.n == 3


def test_clumps_pull_in_blocks(spark):
    # More coincident points than a block holds, beside a few others; the tree is deeper than any fixed cap.
    rng = np.random.default_rng(8)
    xyz = np.r_[rng.random((40, 3)), np.tile([[0.25, 0.5, 0.75]], (90, 1)), 0.6 + 1e-5 * rng.random((60, 3))]
    p = points(spark, xyz, soft=0.01)
    exact = gravity.direct(p, size=64)
    assert gravity.compare(gravity.tree_forces(p, 0.0, block=32), exact).first().worst < 1e-9
    assert gravity.tree_forces(p.limit(0)).count() == 0
