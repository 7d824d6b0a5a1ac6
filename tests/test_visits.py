"""A walk without pruning has rows in proportion to the nodes."""

from astrolith.operators import traversal


def test_visits_of_all_leaves_by_one_walk(spark, monkeypatch):
    nodes = [(0, 0, 40, False), (1, 1, 5, True), (1, 2, 30, False), (1, 7, 5, True), (2, 16, 12, True), (2, 20, 18, True)]
    df = spark.createDataFrame(nodes, "depth int, node long, n long, leaf boolean")
    rows, real = [], traversal.cut
    monkeypatch.setattr(traversal, "cut", lambda d: (rows.append(d.count()), real(d))[1])
    got = traversal.visit_all(df).first()
    leaves = [n for *_, n, leaf in nodes if leaf]
    assert got.asDict() == {"opened": len(leaves) * 70, "met": len(leaves) * sum(leaves), "visits": sum(leaves) ** 2}
    assert max(rows) <= len(nodes)  # the table itself, and no frontier of pairs
    assert traversal.visit_all(df.limit(0)).first().asDict() == {"opened": 0, "met": 0, "visits": 0}
