"""Universe, keys, partitions, trees and boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolith.functions import geometry as g
from astrolith.functions import keys
from astrolith.operators import partition, stats, tree, universe
from astrolith.plans.sql import CUBE, EMB, KEYED, LINE, ORD, leaves
from astrolith.session import table
from astrolith.sources.views import embedding_points, line_points, order_points

PIECES, LEAF, DEPTH = 8, 16, keys.BITS
ROUND = 9


def _keyed(spark, sf) -> DataFrame:
    return universe.with_key(embedding_points(spark, sf))


def universe_box(spark, sf):
    s = universe.cube(universe.summary(embedding_points(spark, sf)))
    return s.select(*(f"{c}_{e}" for c in g.AXES for e in ("lo", "hi")), "n", "n_gas", "n_dark", "n_star", *(F.round(c, ROUND).alias(c) for c in ("side", "mass", "ke", "max_speed")))


def points_families(spark, sf):
    return embedding_points(spark, sf).groupBy("family").agg(F.count("*").alias("n"), F.round(F.sum("mass"), ROUND).alias("mass"))


def gas_points(spark, sf):
    return embedding_points(spark, sf).where(g.is_family("gas")).select("id", "x", "y", "z")


def softening_override(spark, sf):
    return stats.with_soft(embedding_points(spark, sf), 0.05).groupBy("soft").agg(F.count("*").alias("n"))


def reader_ranges(spark, sf):
    p = embedding_points(spark, sf).select("id")
    return partition.global_rank(p, "id").withColumn("reader", partition.tile(F.col("rank"), p.count(), 7)).groupBy("reader").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


def morton_key(spark, sf):
    return _keyed(spark, sf).select("id", "key", keys.prefix(F.col("key"), 3).alias("prefix3"))


def node_parent_child(spark, sf):
    nodes = _keyed(spark, sf).groupBy(keys.prefix(F.col("key"), 3).alias("node")).agg(F.count("*").alias("n"))
    return nodes.select("node", keys.parent(F.col("node")).alias("parent"), "n")


def sfc_partition(spark, sf):
    return partition.by_key_ranges(universe.with_key(order_points(spark, sf)), PIECES).groupBy("piece").agg(F.count("*").alias("n"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


def oct_partition(spark, sf):
    return partition.octants(_keyed(spark, sf), PIECES, DEPTH)


def binary_oct_partition(spark, sf):
    return partition.octants(_keyed(spark, sf), PIECES, 3 * DEPTH, bits=1)


def octant_of_point(spark, sf):
    k = _keyed(spark, sf)
    return partition.assign_cells(k, partition.octants(k, PIECES, DEPTH), DEPTH).select("id", "depth", "node")


def kd_partition(spark, sf):
    return partition.kd_cells(embedding_points(spark, sf), 3).select("id", "cell")


def kd_tree(spark, sf):
    return partition.kd_tree_cells(embedding_points(spark, sf), 3).select("id", "cell")


def longest_dim_partition(spark, sf):
    return partition.longest_side_cells(embedding_points(spark, sf), 3).select("id", "cell")


def piece_placement(spark, sf):
    cells = partition.octants(_keyed(spark, sf), 32, DEPTH)
    ordered = cells.withColumn("at", F.call_function("shiftleft", F.col("node"), (3 * (keys.BITS - F.col("depth"))).cast("int")))
    pieces = partition.global_rank(ordered, "at").select(F.col("rank").alias("piece"), "n")
    return partition.place_by_prefix(pieces, 4)


def tree_leaves(spark, sf):
    return tree.tree_leaves(_keyed(spark, sf), LEAF, DEPTH)


def node_annotation(spark, sf):
    k = _keyed(spark, sf).withColumn("density", 3.0 * F.col("id"))
    return tree.rollup(k, 3, tree.range_payload("density"))


def node_moments(spark, sf):
    n = tree.with_centres(tree.rollup(_keyed(spark, sf), 3, tree.moment_payload()))
    return n.select("depth", "node", "n", *(F.round(c, ROUND).alias(c) for c in ("mass", "cx", "cy", "cz", "radius")))


def _boxes(spark, sf) -> DataFrame:
    return tree.rollup(_keyed(spark, sf), 1, tree.box_payload()).where("depth = 1").drop("depth")


def box_pair_distances(spark, sf):
    boxes = _boxes(spark, sf)
    # Eight boxes at most; each is paired with the later ones.
    other = F.explode(F.sequence(F.col("node"), F.lit(7).cast("long"))).alias("to")
    pairs = boxes.select("*", other).alias("a").join(boxes.alias("b"), F.col("a.to") == F.col("b.node")).where("a.node < b.node")
    low, high = g.sphere_bounds("a", "b")
    r = lambda c, name: F.round(c, ROUND).alias(name)
    return pairs.select(F.col("a.node").alias("a"), F.col("b.node").alias("b"), r(g.box_min2("a", "b"), "min2"), r(g.box_max2("a", "b"), "max2"), r(g.box_min2_periodic("a", "b", 1.0), "min2_periodic"), r(low, "sphere_low"), r(high, "sphere_high"))


def leaf_densities(spark, sf):
    n = tree.rollup(_keyed(spark, sf), 2, tree.box_payload()).where("depth = 2").withColumn("volume", g.volume(""))
    return n.where("volume > 0").select("node", "n", F.round(F.col("n") / F.col("volume"), 4).alias("density"))


def _sized(spark, sf) -> DataFrame:
    return tree.rollup(_keyed(spark, sf), 2, tree.box_payload()).where("depth = 2").withColumn("volume", g.volume("")).where("volume > 0")


def balance_stats(spark, sf):
    return stats.balance(_sized(spark, sf)).select("least", F.round("mean", 6).alias("mean"), "most", F.round("ratio", 6).alias("ratio"))


def pearson_density(spark, sf):
    d = _sized(spark, sf).withColumn("proxy", F.col("n") * F.col("n") / F.col("volume"))
    return stats.pearson(d, "n", "proxy").select(F.round("r", 6).alias("r"))


def cost_fit(spark, sf):
    f = stats.fit(_sized(spark, sf).withColumn("cost", F.col("n") * F.col("n") / F.col("volume")), "n", "cost", logs=True)
    return f.select(*(F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2")), "n")


def cost_proxies(spark, sf):
    return stats.cost_proxies(_sized(spark, sf)).select(*(F.round(c, 3).alias(c) for c in ("density", "power", "surface")))


def heaviest_share(spark, sf):
    return stats.top_share(table(spark, sf, "orders").select(F.col("o_totalprice").cast("double").alias("w")), "w", 0.1).select(F.round("share", 6).alias("share"))


def coincident_points(spark, sf):
    """How many order lines coincide in all three coordinates, as a log2 histogram."""
    return stats.log2_histogram(line_points(spark, sf).groupBy("x", "y", "z").agg(F.count("*").alias("size")), "size")


def _moved(spark, sf):
    p = embedding_points(spark, sf).select("id", F.col("id").alias("label"))
    return p, p.where(F.col("id") % 3 == 0).select("id", (-F.col("id") - 1).alias("label"))


def relabel_join(spark, sf):
    p, c = _moved(spark, sf)
    return stats.update(p, c, "label")


def key_semi_join(spark, sf):
    p, c = _moved(spark, sf)
    return stats.pick(p, c).select("id")


def delete_by_order(spark, sf):
    p, c = _moved(spark, sf)
    return stats.delete(p, c).select("id")


def wrapped_positions(spark, sf):
    p = embedding_points(spark, sf).withColumn("x", F.col("x") + 2.5)
    u = universe.Universe(1, -0.5, -0.5, -0.5, 1.0)
    return universe.wrapped(p, u).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def hilbert_key(spark, sf):
    return universe.with_key(embedding_points(spark, sf), curve="hilbert").select("id", "key")


def hilbert_partition(spark, sf):
    keyed = universe.with_key(line_points(spark, sf), curve="hilbert")
    return partition.by_key_ranges(keyed, PIECES).groupBy("piece").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def owner_codes(spark, sf):
    code = keys.encode_owner(F.pmod("id", F.lit(7)), F.col("id"))
    return embedding_points(spark, sf).select("id", code.alias("code"), keys.owner_of(code).alias("owner"), keys.label_of(code).alias("label"))


def longest_side_tree(spark, sf):
    return partition.longest_side_tree_cells(embedding_points(spark, sf), 3).select("id", "cell")


def line_tree_leaves(spark, sf):
    """Leaves over all order lines, many of which coincide."""
    return tree.tree_leaves(universe.with_key(line_points(spark, sf)), 64)


def tree_floor(spark, sf):
    return tree.tree_leaves(_keyed(spark, sf), LEAF, floor_depth=2)


def subtree_nodes(spark, sf):
    """The first octant's cells, two levels down."""
    return tree.subtree(tree.rollup(_keyed(spark, sf), 3, tree.box_payload()), 1, 0, 2).select("depth", "node", "n")


def overlap_costs(spark, sf):
    """Expected friends of each cell with itself."""
    d = _sized(spark, sf).select("node", F.struct("n", "volume", *(f"{c}_{e}" for c in g.AXES for e in ("lo", "hi"))).alias("a"))
    return d.select("node", F.round(stats.overlap_cost("a", "a", 0.1), 9).alias("cost"))


def pair_concentration(spark, sf):
    """How often a part comes from the same supplier, as a log2 histogram."""
    return stats.concentration(table(spark, sf, "lineitem").select("l_partkey", "l_suppkey"), "l_partkey", "l_suppkey")


def cost_fit_many(spark, sf):
    """The price of an order line by its quantity and its discount."""
    p = table(spark, sf, "lineitem").select(*(F.col(f"l_{c}").cast("double").alias(c) for c in ("extendedprice", "quantity", "discount")))
    f = stats.fit_many(p, ["quantity", "discount"], "extendedprice")
    return f.select(*(F.round(F.col("coefficients")[k], 4).alias(c) for k, c in enumerate(("constant", "quantity", "discount"))), F.round("r2", 6).alias("r2"), "n")


def key_order_falls(spark, sf):
    """Places where the curve key falls along the points' ids."""
    return partition.is_sorted(_keyed(spark, sf), "key", "id")


def piece_homes(spark, sf):
    """For each piece of the curve the rounded mean of its points' cells."""
    k = _keyed(spark, sf)
    pieces = partition.by_key_ranges(k, PIECES).select("id", "piece").join(partition.kd_tree_cells(k, 3).select("id", F.col("cell").alias("part")), "id")
    return stats.weighted_home(pieces)


def reader_slice(spark, sf):
    """The rows of the third of seven readers."""
    p = embedding_points(spark, sf)
    return partition.row_slice(p, *partition.range_of_reader(p.count(), 2, 7)).select("id")


def newest_orders(spark, sf):
    """The latest order of each customer, the larger number on a tie."""
    o = table(spark, sf, "orders").select("o_custkey", F.struct(F.col("o_orderdate").cast("date"), "o_orderkey").alias("at"))
    return tree.newest(o, ["o_custkey"], "at").select("o_custkey", F.col("at.o_orderkey").alias("o_orderkey"))


def leaf_extents(spark, sf):
    """A user's function on each piece: the widest side of its points' box."""
    keyed = _keyed(spark, sf).select(keys.prefix(F.col("key"), 1).alias("node"), "x", "y", "z")

    def widest(pdf):
        return pdf.groupby("node")[["x", "y", "z"]].agg(lambda c: c.max() - c.min()).max(axis=1).reset_index(name="side")

    return tree.map_groups(keyed, ["node"], widest, "node long, side double").select("node", F.round("side", ROUND).alias("side"))


QUERIES = {
    f.__name__: f
    for f in (
        universe_box, points_families, gas_points, softening_override, reader_ranges, morton_key, node_parent_child, sfc_partition, oct_partition, binary_oct_partition, octant_of_point, kd_partition, kd_tree, longest_dim_partition,
        piece_placement, tree_leaves, node_annotation, node_moments, box_pair_distances, leaf_densities, balance_stats, pearson_density, cost_fit, cost_proxies, heaviest_share, coincident_points, relabel_join, key_semi_join, delete_by_order, wrapped_positions,
        hilbert_key, hilbert_partition, owner_codes, longest_side_tree, line_tree_leaves, tree_floor, subtree_nodes, overlap_costs, pair_concentration, cost_fit_many, key_order_falls, piece_homes, reader_slice, newest_orders, leaf_extents,
    )
}


def _leaves_sql(most: str, depth: int, bits: int, source: str = EMB, top: int = 0) -> str:
    return f"WITH {source}, {CUBE}, {KEYED}, {leaves(most, depth, bits, top)} SELECT depth, node, n FROM lf"


_BOX = "min(x) AS x_lo, max(x) AS x_hi, min(y) AS y_lo, max(y) AS y_hi, min(z) AS z_lo, max(z) AS z_hi"
_SIZED = f"""WITH {EMB}, {CUBE}, {KEYED}, d AS (SELECT *, (x_hi - x_lo) * (y_hi - y_lo) * (z_hi - z_lo) AS volume FROM (SELECT key >> 57 AS node, count(*) AS n, {_BOX} FROM k GROUP BY 1))"""




def _kd_sql(route: bool) -> str:
    out, prev = [], "c0"
    for level, axis in enumerate("xyz"):
        if route:
            cut = f"quantile_disc({axis}, 0.5) OVER (PARTITION BY cell)"
            side = f"CASE WHEN {axis} > {cut} THEN 1 ELSE 0 END"
        else:
            side = f"CASE WHEN row_number() OVER (PARTITION BY cell ORDER BY {axis}, id) > ceil(count(*) OVER (PARTITION BY cell) / 2.0) THEN 1 ELSE 0 END"
        out.append(f"c{level + 1} AS (SELECT * EXCLUDE (cell), cell * 2 + {side} AS cell FROM {prev})")
        prev = f"c{level + 1}"
    return f"WITH {EMB}, c0 AS (SELECT id, x, y, z, 0 AS cell FROM p), {', '.join(out)} SELECT id, cell FROM {prev}"


def _longest_tree_sql() -> str:
    out, prev = [], "c0"
    for level in range(3):
        w = "OVER (PARTITION BY cell)"
        out.append(f"w{level} AS (SELECT *, max(x) {w} - min(x) {w} AS sx, max(y) {w} - min(y) {w} AS sy, max(z) {w} - min(z) {w} AS sz FROM {prev})")
        place = "CASE WHEN sx >= sy AND sx >= sz THEN x WHEN sy >= sz THEN y ELSE z END"
        out.append(f"c{level + 1} AS (SELECT id, x, y, z, cell * 2 + CASE WHEN row_number() OVER (PARTITION BY cell ORDER BY {place}, id) > ceil(count(*) {w} / 2.0) THEN 1 ELSE 0 END AS cell FROM w{level})")
        prev = f"c{level + 1}"
    return f"WITH {EMB}, c0 AS (SELECT id, x, y, z, 0 AS cell FROM p), {', '.join(out)} SELECT id, cell FROM {prev}"


def _hilbert(source: str) -> str:
    """Keys ``hk(id, key)``: the distinct cells, by a recursion over their bits, one axis after the other."""
    q, low = "(1::BIGINT << k)", "((1::BIGINT << k) - 1)"
    at = "ox, oy, oz"
    first = f"SELECT {at}, k, CASE WHEN vx & {q} <> 0 THEN xor(vx, {low}) ELSE vx END AS vx, vy, vz FROM h WHERE k > 0"
    second = f"SELECT {at}, k, CASE WHEN vy & {q} <> 0 THEN xor(vx, {low}) ELSE xor(vx, xor(vx, vy) & {low}) END AS vx, CASE WHEN vy & {q} <> 0 THEN vy ELSE xor(vy, xor(vx, vy) & {low}) END AS vy, vz FROM ({first})"
    third = f"SELECT {at}, k - 1, CASE WHEN vz & {q} <> 0 THEN xor(vx, {low}) ELSE xor(vx, xor(vx, vz) & {low}) END, vy, CASE WHEN vz & {q} <> 0 THEN vz ELSE xor(vz, xor(vx, vz) & {low}) END FROM ({second})"
    return f"""{source}, {CUBE}, {KEYED}, h({at}, k, vx, vy, vz) AS (SELECT DISTINCT cx, cy, cz, 20, cx::BIGINT, cy::BIGINT, cz::BIGINT FROM cell UNION ALL {third}),
gray AS (SELECT {at}, vx AS ga, xor(vx, vy) AS gb, xor(xor(vx, vy), vz) AS gc FROM h WHERE k = 0),
bits AS (SELECT {at}, b, (ga >> b) & 1 AS a0, (gb >> b) & 1 AS b0, (gc >> b) & 1 AS c0, bit_count(gc >> (b + 1)) % 2 AS flip FROM gray, range(21) AS r(b)),
hc AS (SELECT {at}, sum((xor(a0, flip) * 4 + xor(b0, flip) * 2 + xor(c0, flip)) << (3 * b))::BIGINT AS key FROM bits GROUP BY ALL),
hk AS (SELECT id, hc.key FROM cell JOIN hc ON cx = ox AND cy = oy AND cz = oz)"""




def _longest_sql() -> str:
    out, prev = [], "c0"
    for level in range(3):
        w = "OVER (PARTITION BY cell)"
        out.append(f"w{level} AS (SELECT *, max(x) {w} - min(x) {w} AS sx, max(y) {w} - min(y) {w} AS sy, max(z) {w} - min(z) {w} AS sz, avg(x) {w} AS mx, avg(y) {w} AS my, avg(z) {w} AS mz FROM {prev})")
        big = "greatest(sx, sy, sz)"
        out.append(f"c{level + 1} AS (SELECT id, x, y, z, cell * 2 + CASE WHEN (CASE WHEN sx = {big} THEN x - mx WHEN sy = {big} THEN y - my ELSE z - mz END) > 0 THEN 1 ELSE 0 END AS cell FROM w{level})")
        prev = f"c{level + 1}"
    return f"WITH {EMB}, c0 AS (SELECT id, x, y, z, 0 AS cell FROM p), {', '.join(out)} SELECT id, cell FROM {prev}"


_NODES = " UNION ALL ".join(f"SELECT {d} AS depth, key >> {63 - 3 * d} AS node, count(*) AS n, {_BOX}, sum(mass) AS mass, sum(mass * x) / sum(mass) AS cx, sum(mass * y) / sum(mass) AS cy, sum(mass * z) / sum(mass) AS cz, min(3.0::DOUBLE * id) AS least, max(3.0::DOUBLE * id) AS most FROM k GROUP BY 2" for d in range(4))

SQL = {
    "hilbert_key": f"WITH RECURSIVE {_hilbert(EMB)} SELECT id, key FROM hk",
    "hilbert_partition": f"WITH RECURSIVE {_hilbert(LINE)} SELECT (piece - 1)::INT AS piece, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM (SELECT id, ntile({PIECES}) OVER (ORDER BY key, id) AS piece FROM hk) GROUP BY 1",
    "owner_codes": f"WITH {EMB} SELECT id, ((id % 7) << 43) | id AS code, id % 7 AS owner, id AS label FROM p",
    "longest_side_tree": _longest_tree_sql(),
    "line_tree_leaves": _leaves_sql("64", DEPTH, 3, LINE),
    "tree_floor": _leaves_sql(str(LEAF), DEPTH, 3, top=2),
    "subtree_nodes": f"WITH {EMB}, {CUBE}, {KEYED} {' UNION ALL '.join(f'SELECT {d} AS depth, key >> {63 - 3 * d} AS node, count(*) AS n FROM k WHERE key >> 60 = 0 GROUP BY 2' for d in (1, 2, 3))}",
    "overlap_costs": f"{_SIZED} SELECT node, round(n / volume * n / volume * volume * (4.0::DOUBLE / 3 * pi()) * 0.001::DOUBLE, 9) AS cost FROM d WHERE volume > 0",
    "pair_concentration": "SELECT floor(log2(times))::INT AS bin, count(*) AS n, max(times) AS most FROM (SELECT count(*) AS times FROM lineitem GROUP BY l_partkey, l_suppkey) GROUP BY 1",
    "cost_fit_many": """WITH t AS (SELECT l_extendedprice::DOUBLE AS y, l_quantity::DOUBLE AS a, l_discount::DOUBLE AS b FROM lineitem),
m AS (SELECT var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS byy, var_pop(y) AS yy, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, count(*) AS n FROM t),
c AS (SELECT *, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS ca, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS cb FROM m)
SELECT round(my - ca * ma - cb * mb, 4) AS "constant", round(ca, 4) AS quantity, round(cb, 4) AS discount, round((ca * ay + cb * byy) / yy, 6) AS r2, n FROM c""",
    "key_order_falls": f"WITH {EMB}, {CUBE}, {KEYED} SELECT count(*) FILTER (WHERE nxt < key) AS falls FROM (SELECT key, lead(key) OVER (ORDER BY id) AS nxt FROM k)",
    "piece_homes": f"""WITH {EMB}, {CUBE}, {KEYED}, q AS (SELECT id, (ntile({PIECES}) OVER (ORDER BY key, id) - 1)::INT AS piece FROM k), t AS ({_kd_sql(False)})
SELECT piece, floor(avg(cell) + 0.5)::INT AS home FROM q JOIN t USING (id) GROUP BY 1""",
    "reader_slice": f"WITH {EMB} SELECT id FROM (SELECT id, ntile(7) OVER (ORDER BY id) AS r FROM p) WHERE r = 3",
    "newest_orders": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE DESC, o_orderkey DESC) = 1",
    "leaf_extents": f"WITH {EMB}, {CUBE}, {KEYED} SELECT key >> 60 AS node, round(greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)), {ROUND}) AS side FROM k GROUP BY 1",
    "universe_box": f"""WITH {EMB}, {CUBE} SELECT x_lo, x_hi, y_lo, y_hi, z_lo, z_hi, n, n_gas, n_dark, n_star, round(side, 9) AS side, round(mass, 9) AS mass, round(ke, 9) AS ke, round(max_speed, 9) AS max_speed
FROM u, (SELECT count(*) FILTER (WHERE family = 'gas') AS n_gas, count(*) FILTER (WHERE family = 'dark') AS n_dark, count(*) FILTER (WHERE family = 'star') AS n_star, sum(mass) AS mass, sum(0.5::DOUBLE * mass * (vx * vx + vy * vy + vz * vz)) AS ke, sqrt(max(vx * vx + vy * vy + vz * vz)) AS max_speed FROM p)""",
    "points_families": f"WITH {EMB} SELECT family, count(*) AS n, round(sum(mass), 9) AS mass FROM p GROUP BY 1",
    "gas_points": f"WITH {EMB} SELECT id, x, y, z FROM p WHERE family = 'gas'",
    "softening_override": f"WITH {EMB} SELECT 0.05::DOUBLE AS soft, count(*) AS n FROM p",
    "reader_ranges": f"WITH {EMB} SELECT (k - 1)::INT AS reader, count(*) AS n, min(id) AS first, max(id) AS last FROM (SELECT id, ntile(7) OVER (ORDER BY id) AS k FROM p) GROUP BY 1",
    "morton_key": f"WITH {EMB}, {CUBE}, {KEYED} SELECT id, key, key >> 54 AS prefix3 FROM k",
    "node_parent_child": f"WITH {EMB}, {CUBE}, {KEYED} SELECT key >> 54 AS node, key >> 57 AS parent, count(*) AS n FROM k GROUP BY 1, 2",
    "sfc_partition": f"WITH {ORD}, {CUBE}, {KEYED} SELECT (piece - 1)::INT AS piece, count(*) AS n, min(key) AS first_key, max(key) AS last_key FROM (SELECT key, ntile({PIECES}) OVER (ORDER BY key, id) AS piece FROM k) GROUP BY 1",
    "oct_partition": _leaves_sql(f"(SELECT count(*) // {PIECES} FROM k)", DEPTH, 3),
    "binary_oct_partition": _leaves_sql(f"(SELECT count(*) // {PIECES} FROM k)", 3 * DEPTH, 1),
    "octant_of_point": f"WITH {EMB}, {CUBE}, {KEYED}, {leaves(f'(SELECT count(*) // {PIECES} FROM k)', DEPTH)} SELECT k.id, lf.depth, lf.node FROM lf JOIN k ON k.key >> (63 - 3 * lf.depth) = lf.node",
    "kd_partition": _kd_sql(True),
    "kd_tree": _kd_sql(False),
    "longest_dim_partition": _longest_sql(),
    "piece_placement": f"""WITH q AS ({_leaves_sql("(SELECT count(*) // 32 FROM k)", DEPTH, 3)}), o AS (SELECT row_number() OVER (ORDER BY node::HUGEINT << (63 - 3 * depth)) - 1 AS piece, n FROM q)
SELECT piece, n, least(3, floor((sum(n) OVER (ORDER BY piece) - n) * 4 / sum(n) OVER ()))::INT AS worker FROM o""",
    "tree_leaves": _leaves_sql(str(LEAF), DEPTH, 3),
    "node_annotation": f"WITH {EMB}, {CUBE}, {KEYED} SELECT depth, node, x_lo, x_hi, y_lo, y_hi, z_lo, z_hi, n, least, most FROM ({_NODES})",
    "node_moments": f"""WITH {EMB}, {CUBE}, {KEYED} SELECT depth, node, n, round(mass, 9) AS mass, round(cx, 9) AS cx, round(cy, 9) AS cy, round(cz, 9) AS cz,
round(CASE WHEN n <= 1 THEN 1.0 ELSE sqrt(pow(greatest(cx - x_lo, x_hi - cx), 2) + pow(greatest(cy - y_lo, y_hi - cy), 2) + pow(greatest(cz - z_lo, z_hi - cz), 2)) END, 9) AS radius FROM ({_NODES})""",
    "box_pair_distances": f"""WITH {EMB}, {CUBE}, {KEYED}, x AS (SELECT key >> 60 AS node, {_BOX} FROM k GROUP BY 1),
j AS (SELECT a.node AS a, c.node AS b, {", ".join(f"greatest(0.0, a.{k}_lo - c.{k}_hi, c.{k}_lo - a.{k}_hi) AS g{k}, least(greatest(0.0, a.{k}_lo - c.{k}_hi, c.{k}_lo - a.{k}_hi), greatest(0.0, a.{k}_lo - 1 - c.{k}_hi, c.{k}_lo - a.{k}_hi + 1), greatest(0.0, a.{k}_lo + 1 - c.{k}_hi, c.{k}_lo - a.{k}_hi - 1)) AS w{k}, greatest(abs(a.{k}_hi - c.{k}_lo), abs(c.{k}_hi - a.{k}_lo)) AS f{k}, (a.{k}_lo + a.{k}_hi - c.{k}_lo - c.{k}_hi) / 2 AS d{k}, a.{k}_hi - a.{k}_lo AS p{k}, c.{k}_hi - c.{k}_lo AS q{k}" for k in "xyz")} FROM x a JOIN x c ON a.node < c.node),
h AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS d, 0.5 * sqrt(px * px + py * py + pz * pz) + 0.5 * sqrt(qx * qx + qy * qy + qz * qz) AS r FROM j)
SELECT a, b, round(gx * gx + gy * gy + gz * gz, 9) AS min2, round(fx * fx + fy * fy + fz * fz, 9) AS max2, round(wx * wx + wy * wy + wz * wz, 9) AS min2_periodic, round(d - r, 9) AS sphere_low, round(d + r, 9) AS sphere_high FROM h""",
    "leaf_densities": f"{_SIZED} SELECT node, n, round(n / volume, 4) AS density FROM d WHERE volume > 0",
    "balance_stats": f"{_SIZED} SELECT min(n) AS least, round(avg(n), 6) AS mean, max(n) AS most, round(max(n) / avg(n), 6) AS ratio FROM d WHERE volume > 0",
    "pearson_density": f"{_SIZED} SELECT round(corr(n, n * n / volume), 6) AS r FROM d WHERE volume > 0",
    "cost_fit": f"{_SIZED} SELECT round(regr_slope(ln(n * n / volume), ln(n)), 6) AS slope, round(regr_intercept(ln(n * n / volume), ln(n)), 6) AS intercept, round(regr_r2(ln(n * n / volume), ln(n)), 6) AS r2, count(*) AS n FROM d WHERE volume > 0",
    "cost_proxies": f"{_SIZED} SELECT round(sum(n * n / volume), 3) AS density, round(sum(pow(n, 1.28)), 3) AS power, round(sum(n * n / pow(volume, 4.0 / 3.0::DOUBLE)), 3) AS surface FROM d WHERE volume > 0",
    "heaviest_share": "SELECT round(sum(w) FILTER (WHERE k <= ceil(n * 0.1)) / sum(w), 6) AS share FROM (SELECT o_totalprice::DOUBLE AS w, row_number() OVER (ORDER BY o_totalprice DESC) AS k, count(*) OVER () AS n FROM orders)",
    "coincident_points": "SELECT (floor(log2(size)))::INT AS bin, count(*) AS n, max(size) AS most FROM (SELECT count(*) AS size FROM lineitem GROUP BY l_quantity, l_discount, l_tax) GROUP BY 1",
    "relabel_join": f"WITH {EMB} SELECT id, CASE WHEN id % 3 = 0 THEN -id - 1 ELSE id END AS label FROM p",
    "key_semi_join": f"WITH {EMB} SELECT id FROM p WHERE id % 3 = 0",
    "delete_by_order": f"WITH {EMB} SELECT id FROM p WHERE id % 3 <> 0",
    "wrapped_positions": f"WITH {EMB} SELECT id, round(x + 2.5 - floor(x + 2.5 + 0.5), 6) AS x, round(y - floor(y + 0.5), 6) AS y FROM p",
}
