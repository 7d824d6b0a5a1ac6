"""The universe of a point table: bounds, sums, the padded cube, and keys inside it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from astrolith.functions import keys
from astrolith.functions.geometry import AXES

PAD = 1.91e-6


def bounds() -> list[Column]:
    return [f(c).alias(f"{c}_{end}") for c in AXES for end, f in (("lo", F.min), ("hi", F.max))]


def summary(points: DataFrame) -> DataFrame:
    """One row: box, counts by family, mass, kinetic energy. An empty table has null bounds and zero sums."""
    speed2 = F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy") + F.col("vz") * F.col("vz")
    zero = F.lit(0.0)
    return points.agg(
        *bounds(),
        F.count("*").alias("n"),
        *(F.count_if(F.col("family") == f).alias(f"n_{f}") for f in ("gas", "dark", "star")),
        F.coalesce(F.sum("mass"), zero).alias("mass"),
        F.coalesce(F.sum(0.5 * F.col("mass") * speed2), zero).alias("ke"),
        F.coalesce(F.sqrt(F.max(speed2)), zero).alias("max_speed"),
    )


def cube(summary_: DataFrame) -> DataFrame:
    """Adds the padded cube that is centred on the box: ``side`` and its lower corner."""
    side = F.greatest(*(F.col(f"{c}_hi") - F.col(f"{c}_lo") for c in AXES)) * (1 + PAD)
    out = summary_.withColumn("side", side)
    for c in AXES:
        out = out.withColumn(f"{c}0", (F.col(f"{c}_lo") + F.col(f"{c}_hi")) / 2 - F.col("side") / 2)
    return out


@dataclass(frozen=True)
class Universe:
    """The cube's numbers, for use as literals in plans: the result of one small aggregate."""

    n: int
    x0: float
    y0: float
    z0: float
    side: float

    @classmethod
    def of(cls, points: DataFrame) -> Universe:
        r = cube(points.agg(*bounds(), F.count("*").alias("n"))).first()
        if not r["n"]:
            return cls(0, 0.0, 0.0, 0.0, 1.0)
        return cls(r["n"], r["x0"], r["y0"], r["z0"], r["side"] or 1.0)

    @property
    def volume(self) -> float:
        return self.side * self.side * self.side

    def link_length(self, factor: float) -> float:
        """``factor`` times the mean spacing in the padded cube."""
        return factor * (self.volume / self.n) ** (1.0 / 3.0) if self.n else 0.0


def check_period(period: float, universe: Universe, link: float) -> None:
    """A periodic box must hold all points, and a link must be shorter than half of it."""
    if period < universe.side / (1 + PAD) * (1 - 1e-4):
        raise ValueError(f"period {period} is smaller than the points' extent")
    if link >= period / 2:
        raise ValueError(f"link length {link} is not below half of period {period}")


def with_cells(points: DataFrame, u: Universe) -> DataFrame:
    return points.withColumns({f"{c}_cell": keys.axis_cell(F.col(c), o, u.side) for c, o in zip(AXES, (u.x0, u.y0, u.z0))})


def with_key(points: DataFrame, u: Universe | None = None, curve: str = "morton") -> DataFrame:
    """Adds ``key``: the point's place on the curve through the padded cube."""
    u = u or Universe.of(points)
    cells = with_cells(points, u)
    make = keys.morton if curve == "morton" else keys.hilbert
    return cells.withColumn("key", make(*(F.col(f"{c}_cell") for c in AXES))).drop(*(f"{c}_cell" for c in AXES))


def wrapped(points: DataFrame, u: Universe) -> DataFrame:
    """Positions moved by whole sides into the universe's cube."""
    return points.withColumns({c: F.col(c) - u.side * F.floor((F.col(c) - F.lit(o)) / u.side) for c, o in zip(AXES, (u.x0, u.y0, u.z0))})
