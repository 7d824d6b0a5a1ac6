"""The point table's columns."""

from pyspark.sql import types as T

FAMILIES = ("gas", "dark", "star")

POINTS = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("family", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in ("mass", "x", "y", "z", "vx", "vy", "vz", "soft")]
)
