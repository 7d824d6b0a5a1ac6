"""Geometry as column expressions. Boxes are structs or prefixes of six columns ``x_lo .. z_hi``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def col(prefix: str, name: str) -> Column:
    return F.col(f"{prefix}.{name}" if prefix else name)


def square(c: Column) -> Column:
    return c * c


def dist2(a: str, b: str) -> Column:
    """Squared distance of two points with columns x, y, z."""
    return square(col(a, "x") - col(b, "x")) + square(col(a, "y") - col(b, "y")) + square(col(a, "z") - col(b, "z"))


def wrap(delta: Column, period: float) -> Column:
    """The shortest image of a difference in a periodic box (halves round away from zero)."""
    return delta - period * F.round(delta / period) if period > 0 else delta


def periodic_dist2(a: str, b: str, period: float) -> Column:
    return sum((square(wrap(col(a, c) - col(b, c), period)) for c in AXES), F.lit(0.0))


def _gap(a: str, b: str, c: str, shift: float = 0.0) -> Column:
    return F.greatest(F.lit(0.0), col(a, f"{c}_lo") + shift - col(b, f"{c}_hi"), col(b, f"{c}_lo") - (col(a, f"{c}_hi") + shift))


def box_min2(a: str, b: str) -> Column:
    """Least squared distance of two boxes."""
    return sum((square(_gap(a, b, c)) for c in AXES), F.lit(0.0))


def box_min2_periodic(a: str, b: str, period: float) -> Column:
    """The same with images one period away on each axis."""
    return sum((square(F.least(*(_gap(a, b, c, s) for s in (-period, 0.0, period)))) for c in AXES), F.lit(0.0))


def box_max2(a: str, b: str) -> Column:
    """Squared distance of the farthest corners."""
    return sum((square(F.greatest(F.abs(col(a, f"{c}_hi") - col(b, f"{c}_lo")), F.abs(col(b, f"{c}_hi") - col(a, f"{c}_lo")))) for c in AXES), F.lit(0.0))


def box_measure(a: str) -> Column:
    """Sum of the side lengths; ``(m_a + m_b)^2 <= 12 b^2`` is needed before a whole-box certificate can hold."""
    return sum((col(a, f"{c}_hi") - col(a, f"{c}_lo") for c in AXES), F.lit(0.0))


def may_certify(a: str, b: str, b2: float) -> Column:
    return square(box_measure(a) + box_measure(b)) <= 12.0 * b2


def half_diagonal(a: str) -> Column:
    return 0.5 * F.sqrt(sum((square(col(a, f"{c}_hi") - col(a, f"{c}_lo")) for c in AXES), F.lit(0.0)))


def centre_distance(a: str, b: str) -> Column:
    return F.sqrt(sum((square((col(a, f"{c}_lo") + col(a, f"{c}_hi")) / 2 - (col(b, f"{c}_lo") + col(b, f"{c}_hi")) / 2) for c in AXES), F.lit(0.0)))


def sphere_bounds(a: str, b: str) -> tuple[Column, Column]:
    """Bounds of distances by the boxes' bounding spheres."""
    d, r = centre_distance(a, b), half_diagonal(a) + half_diagonal(b)
    return d - r, d + r


def sphere_meets_box(box: str, cx: Column, cy: Column, cz: Column, r2: Column) -> Column:
    near = sum((square(F.greatest(F.lit(0.0), col(box, f"{c}_lo") - p, p - col(box, f"{c}_hi"))) for c, p in zip(AXES, (cx, cy, cz))), F.lit(0.0))
    return near <= r2


def encloses(outer: str, inner: str) -> Column:
    out = F.lit(True)
    for c in AXES:
        out = out & (col(outer, f"{c}_lo") <= col(inner, f"{c}_lo")) & (col(outer, f"{c}_hi") >= col(inner, f"{c}_hi"))
    return out


def volume(a: str) -> Column:
    return (col(a, "x_hi") - col(a, "x_lo")) * (col(a, "y_hi") - col(a, "y_lo")) * (col(a, "z_hi") - col(a, "z_lo"))


def is_family(name: str) -> Column:
    return F.col("family") == name
