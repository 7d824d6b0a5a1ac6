"""Space-filling-curve keys: 21 bits an axis, 63 bits in all, so that keys are never negative."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 21
#: Shifts and masks that spread 21 bits over every third bit: fixed values of the well-known bit trick.
SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


def axis_cell(c: Column, low: float, side: float) -> Column:
    """The 21-bit cell of a coordinate in ``[low, low + side)``; what lies outside goes to the border cells."""
    top = (1 << BITS) - 1
    return F.greatest(F.lit(0), F.least(F.lit(top), F.floor((c - F.lit(low)) / F.lit(side) * F.lit(float(1 << BITS))))).cast("long")


def spread(c: Column) -> Column:
    for shift, mask in SPREAD:
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


def morton(x: Column, y: Column, z: Column) -> Column:
    """Interleaved bits of three cells; x has the highest bit of each triple."""
    return F.shiftleft(spread(x), 2).bitwiseOR(F.shiftleft(spread(y), 1)).bitwiseOR(spread(z))


def prefix(key: Column, depth: int, bits: int = 3) -> Column:
    """The ancestor's key at ``depth``, with ``bits`` bits a level (3: octants, 1: halves)."""
    return F.shiftright(key, 3 * BITS - bits * depth)


def parent(key: Column, bits: int = 3) -> Column:
    return F.shiftright(key, bits)


def child(key: Column, i: int, bits: int = 3) -> Column:
    return F.shiftleft(key, bits).bitwiseOR(F.lit(i).cast("long"))


def is_prefix(ancestor: Column, ancestor_depth: Column, key: Column, depth: Column, bits: int = 3) -> Column:
    """Whether a node lies below another (or is it); depths may be columns."""
    move = ((depth - ancestor_depth) * bits).cast("int")
    return (depth >= ancestor_depth) & (F.call_function("shiftright", key, F.greatest(F.lit(0), move)) == ancestor)


def encode_owner(owner: Column, label: Column) -> Column:
    """Owner and label in one number: 43 bits for the label."""
    return F.shiftleft(owner.cast("long"), 43).bitwiseOR(label)


def owner_of(code: Column) -> Column:
    return F.shiftright(code, 43)


def label_of(code: Column) -> Column:
    return code.bitwiseAND(F.lit((1 << 43) - 1))


def pair_owner(a: Column, b: Column, p: Column, q: Column) -> Column:
    """Which of two owners handles a pair of keys: one bit of a hash of both, the same from either side."""
    bit = F.xxhash64(F.least(a, b), F.greatest(a, b)).bitwiseAND(F.lit(1))
    return F.when(bit == 1, F.least(p, q)).otherwise(F.greatest(p, q))


@F.pandas_udf(T.LongType())
def hilbert(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
    """Hilbert-curve key of three 21-bit cells: Gray-code transposition, all rows at once."""
    v = [s.to_numpy(np.int64).copy() for s in (x, y, z)]
    q = 1 << (BITS - 1)
    while q > 1:
        p = q - 1
        for i in range(3):
            on = (v[i] & q) != 0
            t = np.where(on, 0, (v[0] ^ v[i]) & p)
            v[0] ^= np.where(on, p, t)
            v[i] ^= t
        q >>= 1
    for i in (1, 2):
        v[i] ^= v[i - 1]
    t, q = np.zeros_like(v[0]), 1 << (BITS - 1)
    while q > 1:
        t ^= np.where((v[2] & q) != 0, q - 1, 0)
        q >>= 1
    out = np.zeros_like(t)
    for b in range(BITS - 1, -1, -1):
        for i in range(3):
            out = (out << 1) | (((v[i] ^ t) >> b) & 1)
    return pd.Series(out)
