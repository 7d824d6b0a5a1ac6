"""Fixed-radius pairs, friends-of-friends, neighbours and distance histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolith.functions import geometry, keys
from astrolith.operators import blocks, certified, fof, neighbours, partition, spatial_join, stats, traversal, tree, universe
from astrolith.plans.sql import CUBE, D2, EMB, KEYED, LINE, ORD, REACH, edges, levels, link, periodic_d2
from astrolith.session import checkpoint_dir, cut
from astrolith.sources.views import embedding_points, line_points, order_points
from astrolith.streaming.incremental import fold, fold_points

F_EMB, F_ORD, PERIOD = 0.4, 0.2, 0.8
#: Links order lines that differ by a step of quantity, discount or tax only.
LINE_LINK = 0.021


def _emb(spark, sf) -> tuple[DataFrame, float]:
    p = embedding_points(spark, sf)
    return p, universe.Universe.of(p).link_length(F_EMB)


def _ord(spark, sf) -> tuple[DataFrame, float]:
    p = order_points(spark, sf)
    return p, universe.Universe.of(p).link_length(F_ORD)


def fixed_radius_pairs(spark, sf):
    return spatial_join.radius_pairs(*_ord(spark, sf)).select("src", "dst", F.round("d2", 12).alias("d2"))


def fixed_radius_pairs_pbc(spark, sf):
    """Pairs whose nearest images are friends. Points may lie outside of one period, as in the SQL: cells and differences wrap around."""
    p = embedding_points(spark, sf)
    return spatial_join.radius_pairs(p, universe.Universe.of(p).link_length(0.6), PERIOD).select("src", "dst")


def edge_checksum(spark, sf):
    return stats.edge_checksum(spatial_join.radius_pairs(*_emb(spark, sf)))


def fof_components(spark, sf):
    return fof.friends_of_friends(*_emb(spark, sf))


def fof_components_cells(spark, sf):
    return fof.friends_of_friends(*_emb(spark, sf), method="cells")


def fof_orders(spark, sf):
    return fof.friends_of_friends(*_ord(spark, sf))


def fof_histogram(spark, sf):
    return fof.size_histogram(fof.friends_of_friends(*_emb(spark, sf)))


def fof_surviving(spark, sf):
    return fof.size_histogram(fof.friends_of_friends(*_emb(spark, sf)), 3)


def fof_certified(spark, sf):
    """Clusters by certificates over tree nodes: the same labels as by pairs of points."""
    return certified.friends_of_friends(*_emb(spark, sf))


def fof_certified_pbc(spark, sf):
    p = embedding_points(spark, sf)
    return certified.friends_of_friends(p, universe.Universe.of(p).link_length(F_EMB), PERIOD)


def fof_certified_lines(spark, sf):
    """Order lines, of which many coincide: by pairs of points each position alone would cost the square of its lines."""
    return certified.friends_of_friends(_lines(spark, sf), LINE_LINK)


def fof_certified_merges(spark, sf):
    """Fragments merged by certificates."""
    p, b = _pieces(spark, sf)
    labels = cut(fof.fragments(p, b))
    return fof.merged_labels(labels, certified.merge_edges(p, labels, b))


def fof_sweep(spark, sf):
    """Histograms at two link factors."""
    p = embedding_points(spark, sf)
    u = universe.Universe.of(p)
    one = lambda f: fof.size_histogram(fof.friends_of_friends(p, u.link_length(f))).select(F.lit(f).alias("factor"), "bin", "n_components")
    return one(0.2).unionByName(one(0.4))


def _lines(spark, sf) -> DataFrame:
    """One point for each line number of an order: the least of those that share it."""
    least = line_points(spark, sf).groupBy("id").agg(F.min(F.struct("x", "y", "z")).alias("p"))
    return least.select("id", "p.*")


def _pieces(spark, sf) -> tuple[DataFrame, float]:
    p = embedding_points(spark, sf)
    u = universe.Universe.of(p)
    return cut(universe.with_key(p, u).withColumn("piece", keys.prefix(F.col("key"), 1)).select("id", "x", "y", "z", "piece")), u.link_length(F_EMB)


def fof_fragments(spark, sf):
    return fof.fragments(*_pieces(spark, sf))


def _merges(spark, sf):
    p, b = _pieces(spark, sf)
    labels = cut(fof.fragments(p, b))
    return labels, cut(fof.merge_edges(p, labels, b))


def fragment_histogram(spark, sf):
    """Sizes of the fragments before any merge."""
    return fof.size_histogram(fof_fragments(spark, sf))


def fof_regions(spark, sf):
    """Fragments of small pieces, merged inside regions first and then between them."""
    p, b = _pieces(spark, sf)
    small = cut(universe.with_key(embedding_points(spark, sf)).select("id", "x", "y", "z", keys.prefix(F.col("key"), 2).alias("piece"), keys.prefix(F.col("key"), 1).alias("region")))
    return fof.merged_by_regions(small, cut(fof.fragments(small, b)), b)


def labelings_differ(spark, sf):
    """Points on which the two ways to the clusters differ: none."""
    return fof.same_partition(fof_components(spark, sf), fof_two_phases(spark, sf)).agg(F.count("*").alias("differing"))


def fof_merge_edges(spark, sf):
    return _merges(spark, sf)[1]


def fof_two_phases(spark, sf):
    """Fragments first, then merges: the same labels as all at once."""
    return fof.merged_labels(*_merges(spark, sf))


def untouched_fragments(spark, sf):
    return fof.untouched(*_merges(spark, sf))


def fof_cells(spark, sf):
    return fof.dense_cells(*_emb(spark, sf)).select("cx", "cy", "cz", "n", "rep")


def fof_pbc(spark, sf):
    p = embedding_points(spark, sf)
    return fof.friends_of_friends(p, universe.Universe.of(p).link_length(F_EMB), PERIOD)


def fof_pbc_cells(spark, sf):
    """The same on a torus of cells that divide the period."""
    p = embedding_points(spark, sf)
    return fof.friends_of_friends(p, universe.Universe.of(p).link_length(F_EMB), PERIOD, method="cells")


def fof_cells_lines(spark, sf):
    return fof.friends_of_friends(_lines(spark, sf), LINE_LINK, method="cells")


def label_checks(spark, sf):
    return fof.check_labels(fof.friends_of_friends(*_emb(spark, sf)))


def pair_distance_histogram(spark, sf):
    return blocks.pair_histogram(universe.with_key(embedding_points(spark, sf)), 0.01, 1.0, 5)


def knn(spark, sf):
    return _ranked(spatial_join.nearest(embedding_points(spark, sf), 3))


def _ranked(found: DataFrame) -> DataFrame:
    return found.select("id", F.col("rank").cast("int").alias("rank"), "nbr", F.round("d2", 12).alias("d2"))


def knn_orders(spark, sf):
    """The two nearest orders of each order, as far as they lie within a squared distance of a hundredth, as in the SQL."""
    return _ranked(neighbours.nearest(order_points(spark, sf), 2, 0.01))


def knn_lines(spark, sf):
    """The three nearest order lines of each line, nearly all of which coincide with others."""
    return _ranked(spatial_join.nearest(_lines(spark, sf), 3))


def _tree(spark, sf) -> tuple[DataFrame, float]:
    p, b = _emb(spark, sf)
    keyed = universe.with_key(p)
    leaf = partition.leaves(keyed, 16)
    deepest = leaf.agg(F.max("depth")).first()[0]
    return cut(tree.nodes_above(partition.assign_cells(keyed, leaf, deepest), deepest, tree.box_payload())), b


def visit_all(spark, sf):
    return traversal.visit_all(_tree(spark, sf)[0])


def _within(b: float):
    return F.when(geometry.box_min2("t", "s") <= F.lit(b * b), F.lit(True))


def leaf_pairs_dual(spark, sf):
    """Unordered pairs of different leaves that may hold friends: both trees go down together."""
    nodes, b = _tree(spark, sf)
    _, near = traversal.dual(nodes, traversal.JoinSpec(_within(b), mirrored=False, own=False))
    at = lambda x: F.struct(f"{x}.depth", f"{x}.node")
    low, high = F.least(at("t"), at("s")), F.greatest(at("t"), at("s"))
    return near.select(low["depth"].alias("a_depth"), low["node"].alias("a"), high["depth"].alias("b_depth"), high["node"].alias("b"))


def leaf_pairs_top_down(spark, sf):
    """The same pairs in both orders, with each leaf as a target."""
    nodes, b = _tree(spark, sf)
    _, near = traversal.top_down(nodes.where("leaf"), nodes, traversal.JoinSpec(_within(b), own=False))
    return near.select(F.col("t.depth").alias("a_depth"), F.col("t.node").alias("a"), F.col("s.depth").alias("b_depth"), F.col("s.node").alias("b"))


def incremental_components(spark, sf):
    """Edges folded in two batches, as a stream would bring them."""
    checkpoint_dir(spark)
    p, b = _emb(spark, sf)
    pairs = cut(spatial_join.radius_pairs(p, b).select("src", "dst"))
    labels = p.select("id", F.col("id").alias("label"))
    for k in range(2):
        labels = cut(fold(labels, pairs.where(F.pmod(F.xxhash64("src", "dst"), F.lit(2)) == k)))
    return labels


def incremental_points(spark, sf):
    """Points folded in two batches, as a stream would bring them."""
    p, b = _emb(spark, sf)
    state = spark.createDataFrame([], "id long, x double, y double, z double, label long")
    for k in range(2):
        state = cut(fold_points(state, p.where(F.pmod(F.xxhash64("id"), F.lit(2)) == k), b))
    return state.select("id", "label")


def _flat(spark, sf) -> DataFrame:
    return tree.flattened(_tree(spark, sf)[0].select("depth", "node", "n", "leaf"))


def flat_tree(spark, sf):
    """The tree as a breadth-first array."""
    return _flat(spark, sf).select("depth", "node", F.col("index").cast("long").alias("index"), F.col("child_begin").cast("long").alias("child_begin"), F.col("n_children").cast("long").alias("n_children"), F.col("part_begin").cast("long").alias("part_begin"), "n_below")


def flat_tree_checks(spark, sf):
    return tree.check_flat(cut(_flat(spark, sf)))


QUERIES = {
    f.__name__: f
    for f in (
        fixed_radius_pairs, fixed_radius_pairs_pbc, edge_checksum, fof_components, fof_components_cells, fof_orders, fof_histogram, fof_surviving, fof_sweep, fof_fragments, fof_merge_edges, fof_two_phases, untouched_fragments, fof_cells, fof_pbc,
        label_checks, pair_distance_histogram, knn, knn_orders, knn_lines, visit_all, leaf_pairs_dual, leaf_pairs_top_down, incremental_components,
        fragment_histogram, fof_regions, labelings_differ, fof_certified, fof_certified_pbc, fof_certified_lines, fof_certified_merges, fof_pbc_cells, fof_cells_lines, incremental_points, flat_tree, flat_tree_checks,
    )
}

_LABELS = f"WITH RECURSIVE {EMB}, {CUBE}, {link(F_EMB)}, {edges()}, {REACH}"
_PIECES = f"{EMB}, {CUBE}, {KEYED}, {link(F_EMB)}"
_E_IN = f"e AS (SELECT a.id AS s, c.id AS t FROM k a JOIN k c ON a.id <> c.id AND a.key >> 60 = c.key >> 60, b WHERE {D2} <= b.b * b.b)"
_E_OUT = f"x AS (SELECT a.id AS s, c.id AS t FROM k a JOIN k c ON a.id <> c.id AND a.key >> 60 <> c.key >> 60, b WHERE {D2} <= b.b * b.b)"
_MERGES = f"WITH RECURSIVE {_PIECES}, {_E_IN}, {REACH}, {_E_OUT}, m AS (SELECT DISTINCT least(f.label, g.label) AS lo, greatest(f.label, g.label) AS hi FROM x JOIN labels f ON f.id = x.s JOIN labels g ON g.id = x.t WHERE f.label <> g.label)"
_HIST = "SELECT floor(log2(size))::INT AS bin, count(*) AS n_components, sum(size)::BIGINT AS n_points, max(size) AS max_size FROM (SELECT label, count(*) AS size FROM labels GROUP BY 1) WHERE size >= {} GROUP BY 1"

_LEAVES = " UNION ALL ".join(f"SELECT {d} AS depth, key >> {63 - 3 * d} AS node, count(*) AS n, min(x) AS x_lo, max(x) AS x_hi, min(y) AS y_lo, max(y) AS y_hi, min(z) AS z_lo, max(z) AS z_hi FROM k GROUP BY 2" for d in range(keys.BITS + 1))
_GAP = " + ".join(f"pow(greatest(0.0, a.{c}_lo - c.{c}_hi, c.{c}_lo - a.{c}_hi), 2)" for c in "xyz")
_LEAF_PAIRS = f"""WITH {_PIECES}, lv AS MATERIALIZED ({_LEAVES}), f AS (SELECT lv.* FROM lv LEFT JOIN lv up ON up.depth = lv.depth - 1 AND up.node = lv.node >> 3 WHERE (lv.n <= 16 OR lv.depth = {keys.BITS}) AND (lv.depth = 0 OR up.n > 16))
SELECT a.depth AS a_depth, a.node AS a, c.depth AS b_depth, c.node AS b FROM f a JOIN f c ON {{}}, b WHERE {_GAP} <= b.b * b.b"""

_FLAT = f"""WITH {EMB}, {CUBE}, {KEYED}, {levels(keys.BITS)}, nd AS MATERIALIZED (SELECT lv.*, lv.n <= 16 OR lv.depth = {keys.BITS} AS leaf FROM lv LEFT JOIN lv up ON up.depth = lv.depth - 1 AND up.node = lv.node >> 3 WHERE lv.depth = 0 OR up.n > 16),
ix AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY depth, node) - 1 AS index, (SELECT count(*) FROM k WHERE key < nd.node << (63 - 3 * nd.depth)) AS part_begin FROM nd),
flat AS MATERIALIZED (SELECT a.depth, a.node, a.leaf, a.index, coalesce(min(c.index), -1) AS child_begin, count(c.index) AS n_children, a.part_begin, a.n AS n_below FROM ix a LEFT JOIN ix c ON c.depth = a.depth + 1 AND c.node >> 3 = a.node GROUP BY ALL)"""

_LINES = f"{LINE.replace('p AS', 'all_lines AS', 1)}, p AS MATERIALIZED (SELECT id, x, y, z FROM all_lines QUALIFY row_number() OVER (PARTITION BY id ORDER BY x, y, z) = 1)"
_LINE_LABELS = f"""{_LINES}, q AS MATERIALIZED (SELECT x, y, z, min(id) AS id FROM p GROUP BY 1, 2, 3),
e AS MATERIALIZED (SELECT a.id AS s, c.id AS t FROM q a JOIN q c ON a.id <> c.id AND abs(a.x - c.x) <= {LINE_LINK!r}::DOUBLE WHERE {D2} <= {LINE_LINK * LINE_LINK!r}::DOUBLE),
r(id, l) AS (SELECT id, id FROM q UNION SELECT e.t, r.l FROM r JOIN e ON e.s = r.id WHERE r.l < e.t), least AS (SELECT id, min(l) AS label FROM r GROUP BY 1),
labels AS (SELECT p.id, least.label FROM p JOIN q USING (x, y, z) JOIN least ON least.id = q.id)"""

SQL = {
    "leaf_pairs_dual": _LEAF_PAIRS.format("(a.depth, a.node) < (c.depth, c.node)"),
    "leaf_pairs_top_down": _LEAF_PAIRS.format("(a.depth, a.node) <> (c.depth, c.node)"),
    "fixed_radius_pairs": f"WITH {ORD}, {CUBE}, {link(F_ORD)} SELECT a.id AS src, c.id AS dst, round({D2}, 12) AS d2 FROM p a JOIN p c ON a.id < c.id AND abs(a.x - c.x) <= 0.05, b WHERE {D2} <= b.b * b.b",
    "fixed_radius_pairs_pbc": f"WITH {EMB}, {CUBE}, {link(0.6)} SELECT a.id AS src, c.id AS dst FROM p a JOIN p c ON a.id < c.id, b WHERE {periodic_d2(f'{PERIOD!r}::DOUBLE')} <= b.b * b.b",
    "edge_checksum": f"WITH {EMB}, {CUBE}, {link(F_EMB)}, {edges()} SELECT count(*) AS n, sum(s)::BIGINT AS sum_src, sum(t)::BIGINT AS sum_dst FROM e WHERE s < t",
    "fof_components": f"{_LABELS} SELECT id, label FROM labels",
    "fof_components_cells": f"{_LABELS} SELECT id, label FROM labels",
    "fof_orders": f"WITH RECURSIVE {ORD}, {CUBE}, {link(F_ORD)}, e AS (SELECT a.id AS s, c.id AS t FROM p a JOIN p c ON a.id <> c.id AND abs(a.x - c.x) <= 0.05, b WHERE {D2} <= b.b * b.b), {REACH} SELECT id, label FROM labels",
    "fof_histogram": f"{_LABELS} {_HIST.format(1)}",
    "fof_surviving": f"{_LABELS} {_HIST.format(3)}",
    "fof_sweep": f"""WITH RECURSIVE {EMB}, {CUBE}, f AS (SELECT unnest([0.2::DOUBLE, 0.4::DOUBLE]) AS factor),
b AS (SELECT factor, factor * pow(side * side * side / n, 1.0::DOUBLE / 3.0::DOUBLE) AS b FROM u, f), e AS (SELECT factor, a.id AS s, c.id AS t FROM p a JOIN p c ON a.id <> c.id, b WHERE {D2} <= b.b * b.b),
r(factor, id, l) AS (SELECT factor, id, id FROM p, f UNION SELECT e.factor, e.t, r.l FROM r JOIN e ON e.s = r.id AND e.factor = r.factor WHERE r.l < e.t), labels AS (SELECT factor, id, min(l) AS label FROM r GROUP BY 1, 2)
SELECT factor, floor(log2(size))::INT AS bin, count(*) AS n_components FROM (SELECT factor, label, count(*) AS size FROM labels GROUP BY 1, 2) GROUP BY 1, 2""",
    "fof_fragments": f"WITH RECURSIVE {_PIECES}, {_E_IN}, {REACH} SELECT labels.id, key >> 60 AS piece, label FROM labels JOIN k USING (id)",
    "fof_merge_edges": f"{_MERGES} SELECT lo, hi FROM m",
    "fof_two_phases": f"{_LABELS} SELECT id, label FROM labels",
    "untouched_fragments": f"{_MERGES} SELECT DISTINCT label FROM labels WHERE label NOT IN (SELECT lo FROM m UNION SELECT hi FROM m)",
    "fof_certified": f"{_LABELS} SELECT id, label FROM labels",
    "fof_certified_merges": f"{_LABELS} SELECT id, label FROM labels",
    "fof_certified_pbc": f"WITH RECURSIVE {EMB}, {CUBE}, {link(F_EMB)}, {edges(periodic_d2(f'{PERIOD!r}::DOUBLE'))}, {REACH} SELECT id, label FROM labels",
    "incremental_points": f"{_LABELS} SELECT id, label FROM labels",
    "flat_tree": f"{_FLAT} SELECT depth, node, index, child_begin, n_children, part_begin, n_below FROM flat",
    "flat_tree_checks": f"""{_FLAT}, c AS (SELECT p.index, p.part_begin AS pb, p.n_below AS pn, p.depth AS pd, c.* FROM flat p JOIN flat c ON c.index >= p.child_begin AND c.index < p.child_begin + p.n_children AND p.n_children > 0),
g AS (SELECT index, count(*) FILTER (WHERE depth <> pd + 1) AS off, min(part_begin) <> any_value(pb) OR sum(n_below) <> any_value(pn) OR max(part_begin + n_below) <> any_value(pb + pn) AS bad FROM c GROUP BY 1)
SELECT count(*) FILTER (WHERE off > 0) AS bad_children, count(*) FILTER (WHERE bad) AS bad_points, (SELECT count(*) FROM flat WHERE leaf AND n_children > 0) AS bad_leaves, (SELECT count(*) FROM flat WHERE NOT leaf AND n_children = 0) AS bad_inner FROM g""",
    "fof_pbc_cells": f"WITH RECURSIVE {EMB}, {CUBE}, {link(F_EMB)}, {edges(periodic_d2(f'{PERIOD!r}::DOUBLE'))}, {REACH} SELECT id, label FROM labels",
    "fof_cells_lines": f"WITH RECURSIVE {_LINE_LABELS} SELECT id, label FROM labels",
    "fof_certified_lines": f"WITH RECURSIVE {_LINE_LABELS} SELECT id, label FROM labels",
    "fof_cells": f"WITH {EMB}, {CUBE}, {link(F_EMB)}, s AS (SELECT b / sqrt(6.0::DOUBLE) * (1 - 1e-9::DOUBLE) AS s FROM b) SELECT floor(x / s)::BIGINT AS cx, floor(y / s)::BIGINT AS cy, floor(z / s)::BIGINT AS cz, count(*) AS n, min(id) AS rep FROM p, s GROUP BY 1, 2, 3",
    "fof_pbc": f"WITH RECURSIVE {EMB}, {CUBE}, {link(F_EMB)}, {edges(periodic_d2(f'{PERIOD!r}::DOUBLE'))}, {REACH} SELECT id, label FROM labels",
    "label_checks": f"""{_LABELS} SELECT count(*) FILTER (WHERE l.label IS NULL) AS null_labels, count(*) FILTER (WHERE l.label > l.id) AS above,
count(*) FILTER (WHERE o.label IS NULL OR o.label <> l.label) AS "foreign" FROM labels l LEFT JOIN labels o ON o.id = l.label""",
    "pair_distance_histogram": f"""WITH {EMB}, d AS (SELECT sqrt({D2}) AS d FROM p a JOIN p c ON a.id <> c.id)
SELECT floor((ln(d) - ln(0.01::DOUBLE)) / (ln(1.0::DOUBLE) - ln(0.01::DOUBLE)) * 5)::INT AS bin, count(*) AS n FROM d WHERE d >= 0.01 AND d < 1.0 GROUP BY 1""",
    "knn": f"WITH {EMB} SELECT id, rank::INT AS rank, nbr, round(d2, 12) AS d2 FROM (SELECT a.id, c.id AS nbr, {D2} AS d2, row_number() OVER (PARTITION BY a.id ORDER BY {D2}, c.id) AS rank FROM p a JOIN p c ON a.id <> c.id) WHERE rank <= 3",
    "knn_orders": f"WITH {ORD.replace('p AS', 'p AS MATERIALIZED', 1)} SELECT id, rank::INT AS rank, nbr, round(d2, 12) AS d2 FROM (SELECT a.id, c.id AS nbr, {D2} AS d2, row_number() OVER (PARTITION BY a.id ORDER BY {D2}, c.id) AS rank FROM p a JOIN p c ON a.id <> c.id AND abs(a.x - c.x) <= 0.1 WHERE {D2} <= 0.01) WHERE rank <= 2",
    "knn_lines": f"""WITH {_LINES}, q AS MATERIALIZED (SELECT x, y, z, list(id ORDER BY id)[1:4] AS ids FROM p GROUP BY 1, 2, 3),
n AS MATERIALIZED (SELECT a.x, a.y, a.z, unnest(c.ids) AS nbr, {D2} AS d2 FROM q a JOIN q c ON abs(a.x - c.x) <= 0.2 AND abs(a.y - c.y) <= 0.2 AND abs(a.z - c.z) <= 0.2),
f AS MATERIALIZED (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY x, y, z ORDER BY d2, nbr) <= 4)
SELECT p.id, row_number() OVER (PARTITION BY p.id ORDER BY d2, nbr)::INT AS rank, nbr, round(d2, 12) AS d2 FROM p JOIN f USING (x, y, z) WHERE p.id <> nbr QUALIFY rank <= 3""",
    "visit_all": f"""WITH {_PIECES}, lv AS MATERIALIZED ({_LEAVES}), nodes AS (SELECT lv.n, lv.n <= 16 OR lv.depth = {keys.BITS} AS leaf FROM lv LEFT JOIN lv up ON up.depth = lv.depth - 1 AND up.node = lv.node >> 3 WHERE lv.depth = 0 OR up.n > 16)
SELECT sum(s.n) FILTER (WHERE NOT s.leaf)::BIGINT AS opened, sum(s.n) FILTER (WHERE s.leaf)::BIGINT AS met, sum(t.n * s.n) FILTER (WHERE s.leaf)::BIGINT AS visits FROM nodes t, nodes s WHERE t.leaf""",
    "fragment_histogram": f"WITH RECURSIVE {_PIECES}, {_E_IN}, {REACH} {_HIST.format(1)}",
    "fof_regions": f"{_LABELS} SELECT id, label FROM labels",
    "labelings_differ": f"""{_MERGES}, c AS (SELECT f.label AS s, g.label AS t FROM x JOIN labels f ON f.id = x.s JOIN labels g ON g.id = x.t), w(s, l) AS (SELECT label, label FROM labels UNION SELECT c.t, w.l FROM w JOIN c ON c.s = w.s WHERE w.l < c.t),
two AS (SELECT id, min(l) AS label FROM labels JOIN w ON w.s = labels.label GROUP BY 1), e1 AS (SELECT * FROM e UNION ALL SELECT * FROM x), r1(id, l) AS (SELECT id, id FROM p UNION SELECT e1.t, r1.l FROM r1 JOIN e1 ON e1.s = r1.id WHERE r1.l < e1.t),
one AS (SELECT id, min(l) AS label FROM r1 GROUP BY 1) SELECT count(*) FILTER (WHERE one.label <> two.label) AS differing FROM one JOIN two USING (id)""",
    "incremental_components": f"{_LABELS} SELECT id, label FROM labels",
}
