"""Gravity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from astrolith.functions import keys
from astrolith.operators import gravity, partition, tree, universe
from astrolith.plans.sql import CUBE, D2, EMB, KEYED
from astrolith.session import cut
from astrolith.sources.views import embedding_points

DT = 0.001
DIGITS = 6
THETA, LEAF = 0.7, 16


def _points(spark, sf):
    """Unit total mass."""
    p = embedding_points(spark, sf)
    return p.withColumn("mass", F.lit(1.0 / p.count()))


def gravity_direct(spark, sf):
    return gravity.direct(_points(spark, sf)).select("id", *(F.round(c, DIGITS).alias(c) for c in ("ax", "ay", "az")))


def gravity_tree_exact(spark, sf):
    """Every node opened: equal to the direct sum."""
    return gravity.tree_forces(_points(spark, sf), 0.0).select("id", *(F.round(c, DIGITS).alias(c) for c in ("ax", "ay", "az")))


def gravity_barnes_hut(spark, sf):
    return gravity.tree_forces(_points(spark, sf), THETA).select("id", *(F.round(c, DIGITS).alias(c) for c in ("ax", "ay", "az")))


def gravity_errors(spark, sf):
    p = cut(_points(spark, sf))
    return gravity.compare(gravity.tree_forces(p, THETA), cut(gravity.direct(p))).select(*(F.round(c, DIGITS).alias(c) for c in ("rms", "worst")))


def tree_moments(spark, sf):
    """All nodes of the tree with their centres of mass and opening radii."""
    keyed = cut(universe.with_key(_points(spark, sf)))
    cells = cut(partition.leaves(keyed, LEAF))
    deepest = cells.agg(F.max("depth")).first()[0] or 0
    placed = partition.assign_cells(keyed, cells, deepest)
    n = tree.with_centres(tree.nodes_above(placed, deepest, tree.moment_payload()))
    return n.select("depth", "node", "n", "leaf", *(F.round(c, 9).alias(c) for c in ("mass", "cx", "cy", "cz", "radius")))


def leapfrog_run(spark, sf):
    """Two steps by the driver's loop."""
    out = gravity.simulate(cut(_points(spark, sf)), 2, DT, gravity.direct)
    return out.select("id", *(F.round(c, DIGITS).alias(c) for c in ("x", "y", "z", "vx", "vy", "vz")))


def leapfrog_step(spark, sf):
    p = cut(_points(spark, sf))
    return gravity.leapfrog(p, gravity.direct(p), DT).select("id", *(F.round(c, DIGITS).alias(c) for c in ("x", "y", "z", "vx", "vy", "vz")))


QUERIES = {f.__name__: f for f in (gravity_direct, gravity_tree_exact, gravity_barnes_hut, gravity_errors, leapfrog_step, leapfrog_run, tree_moments)}

_U = "2 * sqrt(d2) / h"
_W = f"""CASE WHEN sqrt(d2) >= h THEN 1 / (d2 * sqrt(d2)) WHEN {_U} < 1 THEN 8 / (h * h * h) * (4.0::DOUBLE / 3 - 1.2 * pow({_U}, 2) + 0.5 * pow({_U}, 3))
ELSE (-1.0::DOUBLE / 15 + 8.0::DOUBLE / 3 * pow({_U}, 3) - 3 * pow({_U}, 4) + 1.2 * pow({_U}, 5) - pow({_U}, 6) / 6) / (d2 * sqrt(d2)) END"""
_ACC = f"""{EMB}, t AS (SELECT a.id, c.x - a.x AS dx, c.y - a.y AS dy, c.z - a.z AS dz, 1.0::DOUBLE / (SELECT count(*) FROM p) AS m, {D2} AS d2, a.soft + c.soft AS h FROM p a JOIN p c ON a.id <> c.id),
acc AS (SELECT id, sum(dx * m * ({_W})) AS ax, sum(dy * m * ({_W})) AS ay, sum(dz * m * ({_W})) AS az FROM t WHERE d2 > 0 GROUP BY id)"""
_DIRECT = f"WITH {_ACC} SELECT id, round(ax, {DIGITS}) AS ax, round(ay, {DIGITS}) AS ay, round(az, {DIGITS}) AS az FROM acc"

# The tree: cells below cells of more than LEAF points, and the walk down from its root for each leaf.
_CELLS = " UNION ALL ".join(
    f"SELECT {d} AS depth, key >> {63 - 3 * d} AS node, count(*) AS n, {', '.join(f'min({c}) AS {c}_lo, max({c}) AS {c}_hi, avg({c}) AS c{c}' for c in 'xyz')} FROM k GROUP BY 2" for d in range(keys.BITS + 1)
)
_CORNER = " + ".join(f"pow(greatest(lv.c{c} - lv.{c}_lo, lv.{c}_hi - lv.c{c}), 2)" for c in "xyz")
_DIAGONAL = " + ".join(f"pow(lv.{c}_hi - lv.{c}_lo, 2)" for c in "xyz")
_TREE = f"""{EMB}, {CUBE}, {KEYED}, lv AS MATERIALIZED ({_CELLS}),
nodes AS MATERIALIZED (SELECT lv.*, lv.n <= {LEAF} OR lv.depth = {keys.BITS} AS leaf, lv.n * 1.0::DOUBLE / (SELECT count(*) FROM p) AS mass,
  CASE WHEN lv.n <= 1 THEN 1.0 WHEN lv.n <= {LEAF} OR lv.depth = {keys.BITS} THEN 0.5 * sqrt({_DIAGONAL}) ELSE sqrt({_CORNER}) END AS radius
  FROM lv LEFT JOIN lv up ON up.depth = lv.depth - 1 AND up.node = lv.node >> 3 WHERE lv.depth = 0 OR up.n > {LEAF})"""
_MEETS = " + ".join(f"pow(greatest(0.0, t.{c}_lo - s.c{c}, s.c{c} - t.{c}_hi), 2)" for c in "xyz") + f" <= s.radius * s.radius * (4.0::DOUBLE / 3) / ({THETA}::DOUBLE * {THETA}::DOUBLE)"
_T_BOX = ", ".join(f"t.{c}_{e}" for c in "xyz" for e in ("lo", "hi"))
_S = f"s.depth, s.node, s.leaf, s.mass, s.cx, s.cy, s.cz, (s.n <= 6 OR {_MEETS}) AS opened"
_R2 = "pow(w.cx - a.x, 2) + pow(w.cy - a.y, 2) + pow(w.cz - a.z, 2)"
_WALK = f"""{_TREE}, w AS (SELECT t.depth AS td, t.node AS tn, {_T_BOX}, {_S} FROM nodes t, nodes s WHERE t.leaf AND s.depth = 0
  UNION ALL SELECT t.td, t.tn, {_T_BOX}, {_S} FROM w t JOIN nodes s ON s.depth = t.depth + 1 AND s.node >> 3 = t.node WHERE t.opened AND NOT t.leaf),
pts AS MATERIALIZED (SELECT k.*, n.depth AS td, n.node AS tn FROM k JOIN nodes n ON n.leaf AND k.key >> (63 - 3 * n.depth) = n.node),
one AS (SELECT a.id, w.mass / ({_R2}) / sqrt({_R2}) AS f, w.cx - a.x AS dx, w.cy - a.y AS dy, w.cz - a.z AS dz FROM pts a JOIN w USING (td, tn) WHERE NOT w.opened AND {_R2} > 0),
two AS (SELECT a.id, c.x - a.x AS dx, c.y - a.y AS dy, c.z - a.z AS dz, 1.0::DOUBLE / (SELECT count(*) FROM p) AS m, {D2} AS d2, a.soft + c.soft AS h FROM pts a JOIN w USING (td, tn) JOIN pts c ON c.td = w.depth AND c.tn = w.node WHERE w.opened AND w.leaf AND a.id <> c.id),
both_ AS (SELECT id, f, dx, dy, dz FROM one UNION ALL SELECT id, m * ({_W}), dx, dy, dz FROM two WHERE d2 > 0),
walked AS (SELECT id, sum(dx * f) AS ax, sum(dy * f) AS ay, sum(dz * f) AS az FROM both_ GROUP BY id)"""
_KICK = "p.id, x, y, z, vx + ax * {dt} AS vx, vy + ay * {dt} AS vy, vz + az * {dt} AS vz"
_AGAIN = _ACC.removeprefix(EMB).replace("FROM p a JOIN p c", "FROM p1 a JOIN p1 c").replace(", t AS", "t2 AS", 1).replace("FROM t WHERE", "FROM t2 WHERE").replace("acc AS", "acc2 AS")

SQL = {
    "gravity_barnes_hut": f"WITH RECURSIVE {_WALK} SELECT id, round(ax, {DIGITS}) AS ax, round(ay, {DIGITS}) AS ay, round(az, {DIGITS}) AS az FROM walked",
    "gravity_errors": f"""WITH RECURSIVE {_WALK}, {_ACC.removeprefix(EMB + ", ")},
rel AS (SELECT sqrt((pow(v.ax - acc.ax, 2) + pow(v.ay - acc.ay, 2) + pow(v.az - acc.az, 2)) / (pow(acc.ax, 2) + pow(acc.ay, 2) + pow(acc.az, 2))) AS rel FROM walked v JOIN acc USING (id))
SELECT round(sqrt(avg(rel * rel)), {DIGITS}) AS rms, round(max(rel), {DIGITS}) AS worst FROM rel""",
    "tree_moments": f"WITH {_TREE} SELECT depth, node, n, leaf, round(mass, 9) AS mass, round(cx, 9) AS cx, round(cy, 9) AS cy, round(cz, 9) AS cz, round(radius, 9) AS radius FROM nodes",
    "leapfrog_run": f"""WITH {_ACC}, k1 AS (SELECT {_KICK.format(dt=DT)}, soft FROM p JOIN acc USING (id)),
p1 AS (SELECT id, x + vx * {DT} AS x, y + vy * {DT} AS y, z + vz * {DT} AS z, vx, vy, vz, soft FROM k1), {_AGAIN},
k2 AS (SELECT {_KICK.format(dt=DT).replace("p.id", "p1.id")} FROM p1 JOIN acc2 USING (id))
SELECT id, round(x + vx * {DT}, {DIGITS}) AS x, round(y + vy * {DT}, {DIGITS}) AS y, round(z + vz * {DT}, {DIGITS}) AS z, round(vx, {DIGITS}) AS vx, round(vy, {DIGITS}) AS vy, round(vz, {DIGITS}) AS vz FROM k2""",
    "gravity_direct": _DIRECT,
    "gravity_tree_exact": _DIRECT,
    "leapfrog_step": f"""WITH {_ACC}, k AS (SELECT p.id, x, y, z, vx + ax * {DT} AS vx, vy + ay * {DT} AS vy, vz + az * {DT} AS vz FROM p JOIN acc USING (id))
SELECT id, round(x + vx * {DT}, {DIGITS}) AS x, round(y + vy * {DT}, {DIGITS}) AS y, round(z + vz * {DT}, {DIGITS}) AS z, round(vx, {DIGITS}) AS vx, round(vy, {DIGITS}) AS vy, round(vz, {DIGITS}) AS vz FROM k""",
}
