"""Readers and writers of snapshot files: one record file, or a folder with a file for each attribute.

Record file (big-endian): time (f8), number of points, dimensions, numbers of gas, dark and star points, padding (i4
each); then gas records (mass, pos, vel, density, temperature, smoothing, metals, potential), dark records (mass, pos,
vel, softening, potential) and star records (mass, pos, vel, metals, formation time, softening, potential), all f4.

Attribute file (big-endian): 28-byte header (magic, time, count, dimensions, type code), least and largest value, values. If
least and largest are equal the values may be missing. Folders gas, dark and star hold pos, mass (both required), vel and
soft.

Model file (of generators; the machine's byte order): number of points and dimensions (i4), time (f4 or f8), then x, y, z, vx, vy, vz,
mass and softening of each point in the same precision.

Large files are read in slices: each task opens the part of the file that it decodes.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from astrolith.schema import FAMILIES, POINTS

HEADER = struct.Struct(">dIIIII4x")
FIELDS = {"gas": 12, "dark": 9, "star": 11}
#: Place of the softening in a record; stars keep 0.
SOFT = {"gas": 9, "dark": 7}
#: Attribute files: magic number and numpy types by code (fixed values of the format).
MAGIC = 1062053
TYPES = {1: ">i1", 2: ">u1", 3: ">i2", 4: ">u2", 5: ">i4", 6: ">u4", 7: ">i8", 8: ">u8", 9: ">f4", 10: ">f8"}
FIELD_HEADER = struct.Struct(">idqii")
ROWS = 1 << 20


@dataclass(frozen=True)
class FieldHeader:
    time: float
    count: int
    dims: int
    code: int

    @property
    def kind(self) -> np.dtype:
        return np.dtype(TYPES[self.code])


def decode_header(head: bytes) -> FieldHeader:
    if len(head) < FIELD_HEADER.size:
        raise ValueError("file is too short for its header")
    magic, time, count, dims, code = FIELD_HEADER.unpack(head[: FIELD_HEADER.size])
    if magic != MAGIC:
        raise ValueError(f"bad magic number {magic}")
    if dims not in (1, 3) or code not in TYPES or count < 0:
        raise ValueError(f"bad dimensions {dims}, type {code} or count {count}")
    return FieldHeader(time, count, dims, code)


def read_field(path: str, start: int, count: int, dims: int) -> np.ndarray:
    """Values ``[start, start + count)`` as doubles, with one row each; any type code is converted."""
    with open(path, "rb") as f:
        h = decode_header(f.read(FIELD_HEADER.size))
        if h.dims != dims:
            raise ValueError(f"{path}: {h.dims} dimensions, {dims} wanted")
        if start < 0 or start + count > h.count:
            raise ValueError(f"{path}: rows {start} to {start + count} of {h.count}")
        width = h.kind.itemsize * dims
        low, high = (np.frombuffer(f.read(width), h.kind) for _ in range(2))
        if (low == high).all():
            return np.tile(low.astype(float), (count, 1))
        f.seek(FIELD_HEADER.size + width * (2 + start))
        raw = f.read(width * count)
        if len(raw) < width * count:
            raise ValueError(f"{path}: file ends early")
        return np.frombuffer(raw, h.kind).astype(float).reshape(count, dims)


def write_field(path: str, values: np.ndarray, kind: str = ">f4", time: float = 0.0, omit_constant: bool = False) -> None:
    values = np.asarray(values)
    flat = values.reshape(len(values), -1).astype(kind)
    code = next(k for k, v in TYPES.items() if np.dtype(v) == np.dtype(kind))
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(FIELD_HEADER.pack(MAGIC, time, len(flat), flat.shape[1], code))
        low = flat.min(axis=0) if len(flat) else np.zeros(flat.shape[1], kind)
        high = flat.max(axis=0) if len(flat) else low
        f.write(low.astype(kind).tobytes() + high.astype(kind).tobytes())
        if not (omit_constant and (low == high).all()):
            f.write(flat.tobytes())


def _slices(spark: SparkSession, counts: dict[str, int], rows: int) -> DataFrame:
    base, parts = 0, []
    for family in FAMILIES:
        n = counts.get(family, 0)
        parts += [(family, at, min(rows, n - at), base + at) for at in range(0, n, rows)]
        base += n
    return spark.createDataFrame(parts, "family string, start long, n long, id long").repartition(max(1, len(parts)))


def _frame(family: str, first: int, pos, vel, mass, soft) -> pd.DataFrame:
    n = len(pos)
    return pd.DataFrame({"id": np.arange(first, first + n), "family": family, "mass": mass, "x": pos[:, 0], "y": pos[:, 1], "z": pos[:, 2], "vx": vel[:, 0], "vy": vel[:, 1], "vz": vel[:, 2], "soft": soft})


def read_fields(spark: SparkSession, folder: str, rows: int = ROWS) -> DataFrame:
    """Points of a folder of attribute files. Velocity and softening are 0 where they are missing; an empty folder has no points."""
    counts = {}
    for family in FAMILIES:
        if not os.path.isdir(f"{folder}/{family}"):
            continue
        for needed in ("pos", "mass"):
            if not os.path.exists(f"{folder}/{family}/{needed}"):
                raise FileNotFoundError(f"{folder}/{family}/{needed} is required")
        with open(f"{folder}/{family}/pos", "rb") as f:
            counts[family] = decode_header(f.read(FIELD_HEADER.size)).count

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for r in df.itertuples():
                at = f"{folder}/{r.family}"
                get = lambda name, dims, at=at, r=r: read_field(f"{at}/{name}", r.start, r.n, dims) if os.path.exists(f"{at}/{name}") else np.zeros((r.n, dims))
                yield _frame(r.family, r.id, get("pos", 3), get("vel", 3), get("mass", 1)[:, 0], get("soft", 1)[:, 0])

    return _slices(spark, counts, rows).mapInPandas(run, POINTS)


def read_records(spark: SparkSession, path: str, rows: int = ROWS) -> DataFrame:
    """Points of a record file, gas, dark and star in this order."""
    with open(path, "rb") as f:
        head = f.read(HEADER.size)
    if len(head) < HEADER.size:
        raise ValueError("file is too short for its header")
    _, n, dims, *each = HEADER.unpack(head)
    counts = dict(zip(FAMILIES, each))
    size = HEADER.size + sum(4 * FIELDS[f] * c for f, c in counts.items())
    if dims != 3 or n != sum(each) or os.path.getsize(path) < size:
        raise ValueError("header and file size don't agree")
    starts, at = {}, HEADER.size
    for f in FAMILIES:
        starts[f] = at
        at += 4 * FIELDS[f] * counts[f]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for r in df.itertuples():
                k = FIELDS[r.family]
                v = np.fromfile(path, ">f4", r.n * k, offset=starts[r.family] + 4 * k * r.start).astype(float).reshape(r.n, k)
                soft = v[:, SOFT[r.family]] if r.family in SOFT else np.zeros(r.n)
                yield _frame(r.family, r.id, v[:, 1:4], v[:, 4:7], v[:, 0], soft)

    return _slices(spark, counts, rows).mapInPandas(run, POINTS)


#: Softening of points that come from a model file (a fixed value of the conversion).
MODEL_SOFT = 0.05


def read_model(spark: SparkSession, path: str, rows: int = ROWS, soft: float | None = MODEL_SOFT) -> DataFrame:
    """Points of a model file, all dark; ``soft=None`` keeps the file's softening. The size tells the precision."""
    with open(path, "rb") as f:
        n, dims = np.frombuffer(f.read(8), "=i4")
    n, size = int(n), os.path.getsize(path)
    kind = next((np.dtype(k) for k in ("=f4", "=f8") if size == 8 + np.dtype(k).itemsize * (1 + 8 * n)), None)
    if dims != 3 or n < 0 or kind is None:
        raise ValueError("header and file size don't agree")
    head = 8 + kind.itemsize

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for r in df.itertuples():
                v = np.fromfile(path, kind, 8 * r.n, offset=head + 8 * kind.itemsize * r.start).astype(float).reshape(r.n, 8)
                yield _frame("dark", r.id, v[:, :3], v[:, 3:6], v[:, 6], v[:, 7] if soft is None else np.full(r.n, soft))

    return _slices(spark, {"dark": n}, rows).mapInPandas(run, POINTS)


def write_model(points: DataFrame, path: str, kind: str = "=f4", time: float = 0.0) -> None:
    """One model file, in the order of ids, partition by partition."""
    n = points.count()
    if n > 2**31 - 1:
        raise ValueError("too many points for one file")
    with open(path, "wb") as f:
        f.write(np.array([n, 3], "=i4").tobytes() + np.array([time], kind).tobytes())
        for r in points.select("x", "y", "z", "vx", "vy", "vz", "mass", "soft", "id").orderBy("id").toLocalIterator():
            f.write(np.array(r[:8], kind).tobytes())


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """A folder of Parquet files, a folder of attribute files, a Parquet file, a model file (``.dat``) or a record file."""
    if os.path.isdir(path):
        if any(name.endswith(".parquet") for name in os.listdir(path)):
            return spark.read.parquet(path)
        return read_fields(spark, path)
    if path.endswith(".dat"):
        return read_model(spark, path)
    return spark.read.parquet(path) if path.endswith(".parquet") else read_records(spark, path)


def write_records(points: DataFrame, path: str, time: float = 0.0) -> None:
    """One record file. The format is one file with a 32-bit count, so it is written in order, partition by partition."""
    counts = {r["family"]: r["count"] for r in points.groupBy("family").count().collect()}
    if others := set(counts) - set(FAMILIES):
        raise ValueError(f"the format has no place for points of {sorted(map(str, others))}")
    n = sum(counts.values())
    if n > 2**31 - 1:
        raise ValueError("too many points for one file")
    with open(path, "wb") as f:
        f.write(HEADER.pack(time, n, 3, *(counts.get(k, 0) for k in FAMILIES)))
        for family in FAMILIES:
            for r in points.where(F.col("family") == family).orderBy("id").toLocalIterator():
                v = np.zeros(FIELDS[family], ">f4")
                v[0], v[1:4], v[4:7] = r["mass"], (r["x"], r["y"], r["z"]), (r["vx"], r["vy"], r["vz"])
                if family in SOFT:
                    v[SOFT[family]] = r["soft"]
                f.write(v.tobytes())


def records_to_fields(spark: SparkSession, path: str, folder: str, kind: str = ">f4") -> None:
    """Converts a record file, an attribute at a time."""
    points = read_records(spark, path)
    for family in FAMILIES:
        one = points.where(F.col("family") == family).orderBy("id")
        if one.isEmpty():
            continue
        for name, cols in (("pos", ["x", "y", "z"]), ("vel", ["vx", "vy", "vz"]), ("mass", ["mass"]), ("soft", ["soft"])):
            write_field(f"{folder}/{family}/{name}", one.select(*cols).toPandas().to_numpy(), kind)


def write_attribute(points: DataFrame, column: list[str], path: str) -> None:
    """Text parts: the count first, then the values of each column in turn, in the order of ids."""
    n = points.count()
    rows = points.select("id", F.posexplode(F.array(*column)).alias("axis", "value"))
    head = points.sparkSession.range(1).select(F.lit(-1).alias("axis"), F.lit(-1).cast("long").alias("id"), F.lit(str(n)).alias("value"))
    both = head.unionByName(rows.select("axis", "id", F.col("value").cast("string").alias("value")))
    both.repartitionByRange("axis", "id").sortWithinPartitions("axis", "id").select("value").write.mode("overwrite").text(path)


def write_steps(points: DataFrame, folder: str, step: int) -> None:
    """Parquet parts of one step."""
    points.write.mode("overwrite").parquet(f"{folder}/step={step}")
