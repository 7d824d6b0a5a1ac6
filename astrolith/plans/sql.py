"""Pieces of SQL that the oracles share."""

from astrolith.operators.universe import PAD
from astrolith.sources.views import EMBEDDING_SQL, LINE_SQL, ORDER_SQL

EMB, LINE, ORD = EMBEDDING_SQL, LINE_SQL, ORDER_SQL

#: One row: the padded cube.
CUBE = f"""bb AS (SELECT min(x) AS x_lo, max(x) AS x_hi, min(y) AS y_lo, max(y) AS y_hi, min(z) AS z_lo, max(z) AS z_hi, count(*) AS n FROM p),
u AS (SELECT *, (x_lo + x_hi) / 2 - side / 2 AS x0, (y_lo + y_hi) / 2 - side / 2 AS y0, (z_lo + z_hi) / 2 - side / 2 AS z0
  FROM (SELECT *, greatest(x_hi - x_lo, y_hi - y_lo, z_hi - z_lo) * (1 + {PAD!r}::DOUBLE) AS side FROM bb))"""


def spread(c: str) -> str:
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        c = f"(({c} | ({c} << {shift})) & {mask}::HUGEINT)"
    return c


#: Points with their curve key, at most one bit operation per line of thought: cells first, then spread bits.
KEYED = f"""cell AS MATERIALIZED (SELECT p.*, {", ".join(f"greatest(0, least(2097151, floor(({c} - {c}0) / side * 2097152.0::DOUBLE)))::HUGEINT AS c{c}" for c in "xyz")} FROM p, u),
s1 AS MATERIALIZED (SELECT *, (cx | (cx << 32)) & {0x1F00000000FFFF}::HUGEINT AS ax, (cy | (cy << 32)) & {0x1F00000000FFFF}::HUGEINT AS ay, (cz | (cz << 32)) & {0x1F00000000FFFF}::HUGEINT AS az FROM cell),
s2 AS MATERIALIZED (SELECT * REPLACE ((ax | (ax << 16)) & {0x1F0000FF0000FF}::HUGEINT AS ax, (ay | (ay << 16)) & {0x1F0000FF0000FF}::HUGEINT AS ay, (az | (az << 16)) & {0x1F0000FF0000FF}::HUGEINT AS az) FROM s1),
s3 AS MATERIALIZED (SELECT * REPLACE ((ax | (ax << 8)) & {0x100F00F00F00F00F}::HUGEINT AS ax, (ay | (ay << 8)) & {0x100F00F00F00F00F}::HUGEINT AS ay, (az | (az << 8)) & {0x100F00F00F00F00F}::HUGEINT AS az) FROM s2),
s4 AS MATERIALIZED (SELECT * REPLACE ((ax | (ax << 4)) & {0x10C30C30C30C30C3}::HUGEINT AS ax, (ay | (ay << 4)) & {0x10C30C30C30C30C3}::HUGEINT AS ay, (az | (az << 4)) & {0x10C30C30C30C30C3}::HUGEINT AS az) FROM s3),
s5 AS MATERIALIZED (SELECT * REPLACE ((ax | (ax << 2)) & {0x1249249249249249}::HUGEINT AS ax, (ay | (ay << 2)) & {0x1249249249249249}::HUGEINT AS ay, (az | (az << 2)) & {0x1249249249249249}::HUGEINT AS az) FROM s4),
k AS MATERIALIZED (SELECT * EXCLUDE (ax, ay, az, cx, cy, cz), ((ax << 2) | (ay << 1) | az)::BIGINT AS key FROM s5)"""


def link(factor: float) -> str:
    return f"b AS (SELECT {factor!r}::DOUBLE * pow(side * side * side / n, 1.0::DOUBLE / 3.0::DOUBLE) AS b FROM u)"


D2 = "(a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y) + (a.z - c.z) * (a.z - c.z)"


def periodic_d2(length: str) -> str:
    one = lambda c: f"(a.{c} - c.{c} - {length} * round((a.{c} - c.{c}) / {length}))"
    return " + ".join(f"{one(c)} * {one(c)}" for c in "xyz")


def edges(d2: str = D2, where: str = "true") -> str:
    return f"e AS (SELECT a.id AS s, c.id AS t FROM p a JOIN p c ON a.id <> c.id, b WHERE {d2} <= b.b * b.b AND {where})"


REACH = """r(id, l) AS (SELECT id, id FROM p UNION SELECT e.t, r.l FROM r JOIN e ON e.s = r.id WHERE r.l < e.t),
labels AS (SELECT id, min(l) AS label FROM r GROUP BY id)"""


def levels(depth: int, bits: int = 3, top: int = 0) -> str:
    """``lv (depth, node, n)``: points are counted once, at the deepest level, and each level sums up the one below it."""
    ctes = [f"l{depth} AS MATERIALIZED (SELECT key >> {63 - bits * depth} AS node, count(*) AS n FROM k GROUP BY 1)"]
    ctes += [f"l{d} AS MATERIALIZED (SELECT node >> {bits} AS node, sum(n)::BIGINT AS n FROM l{d + 1} GROUP BY 1)" for d in range(depth - 1, top - 1, -1)]
    every = " UNION ALL ".join(f"SELECT {d} AS depth, node, n FROM l{d}" for d in range(top, depth + 1))
    return ", ".join([*ctes, f"lv AS MATERIALIZED ({every})"])


def leaves(most: str, depth: int, bits: int = 3, top: int = 0) -> str:
    """``lf (depth, node, n)``: cells without a split, small ones (or the deepest) below a large parent."""
    return f"""{levels(depth, bits, top)}, t AS MATERIALIZED (SELECT {most} AS most),
lf AS MATERIALIZED (SELECT lv.depth, lv.node, lv.n FROM lv LEFT JOIN lv up ON up.depth = lv.depth - 1 AND up.node = lv.node >> {bits}
WHERE (lv.n <= (SELECT most FROM t) OR lv.depth = {depth}) AND (lv.depth = {top} OR up.n > (SELECT most FROM t)))"""
