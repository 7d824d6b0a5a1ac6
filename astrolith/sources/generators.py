"""Generated points. Each block of ids has its own seed, or its own place in one sequence, so that the result does not depend on partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from astrolith.schema import POINTS
from astrolith.sources.mersenne import uniform_from

BLOCK, UNIFORM_BLOCK = 65_536, 1 << 20


def _blocks(spark: SparkSession, n: int, make, block: int = BLOCK, real=np.float64) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for k in df["id"]:
                first, size = int(k) * block, min(block, n - int(k) * block)
                pos, vel = make(int(k), first, size)
                yield pd.DataFrame({"id": np.arange(first, first + size), "family": "dark", "mass": float(real(1.0 / n)), "x": pos[:, 0], "y": pos[:, 1], "z": pos[:, 2], "vx": vel[:, 0], "vy": vel[:, 1], "vz": vel[:, 2], "soft": float(real(0.001))})

    blocks = -(-n // block)
    return spark.range(0, blocks, 1, max(1, min(blocks, 10_000))).mapInPandas(run, POINTS)


def uniform(spark: SparkSession, n: int, seed: int = 1, real=np.float32, block: int = UNIFORM_BLOCK) -> DataFrame:
    """Points at rest, even in the unit cube; masses sum to 1.

    Point i has numbers 3i to 3i + 2 of the 64-bit Mersenne Twister's sequence (upper 53 bits), rounded to ``real``; a task
    jumps to the number that its first point begins with.
    """

    def make(k: int, first: int, size: int):
        xyz = uniform_from(seed, 3 * first, 3 * size).reshape(size, 3)
        return xyz.astype(real).astype(np.float64), np.zeros((size, 3))

    return _blocks(spark, n, make, block, real)


def _sphere(rng: np.random.Generator, size: int) -> np.ndarray:
    v = rng.normal(size=(size, 3))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def plummer_sample(rng: np.random.Generator, size: int, most: float = 9.0) -> tuple[np.ndarray, np.ndarray]:
    """A Plummer model by inverted radii (farther than ``most`` drawn again) and speeds by rejection."""
    r = np.zeros(0)
    while len(r) < size:
        more = 1 / np.sqrt(rng.random(2 * size + 16) ** (-2 / 3) - 1)
        r = np.concatenate([r, more[more <= most]])
    r = r[:size]
    q = np.zeros(0)
    while len(q) < size:
        x, y = rng.random(8 * size + 16), 0.1 * rng.random(8 * size + 16)
        q = np.concatenate([q, x[y < x**2 * (1 - x**2) ** 3.5]])
    speed = q[:size] * np.sqrt(2) * (1 + r**2) ** -0.25
    return r[:, None] * _sphere(rng, size), speed[:, None] * _sphere(rng, size)


def plummer_pair(spark: SparkSession, n: int, seed: int = 1, offset: float = 4.0) -> DataFrame:
    """Two Plummer models; the second half of the ids lies ``offset`` away on each axis. Means are moved to zero."""

    def make(k: int, first: int, size: int):
        pos, vel = plummer_sample(np.random.default_rng((seed, k)), size)
        pos[np.arange(first, first + size) >= n // 2] += offset
        return pos, vel

    points = _blocks(spark, n, make)
    m = points.agg(*(F.avg(c).alias(c) for c in ("x", "y", "z", "vx", "vy", "vz"))).first()
    return points.withColumns({c: F.col(c) - F.lit(m[c]) for c in ("x", "y", "z", "vx", "vy", "vz")}) if n else points
