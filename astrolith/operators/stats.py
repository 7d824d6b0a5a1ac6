"""Statistics of work and balance, and small relational helpers on labelled points."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from astrolith.functions.geometry import AXES


def balance(loads: DataFrame, weight: str = "n") -> DataFrame:
    """One row: least, average and largest load, and the ratio of the last two."""
    return loads.agg(F.min(weight).alias("least"), F.avg(weight).alias("mean"), F.max(weight).alias("most"), (F.max(weight) / F.avg(weight)).alias("ratio"))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.corr(x, y).alias("r"))


def density_proxy(n: Column, volume: Column) -> Column:
    return n * n / volume


def cost_proxies(boxes: DataFrame) -> DataFrame:
    """One row over boxes with ``n`` and ``volume``: sums of n^2/V, n^1.28 and n^2/V^(4/3)."""
    n, v = F.col("n").cast("double"), F.col("volume")
    return boxes.agg(F.sum(n * n / v).alias("density"), F.sum(F.pow(n, F.lit(1.28))).alias("power"), F.sum(n * n / F.pow(v, F.lit(4.0 / 3.0))).alias("surface"))


def overlap_cost(a: str, b: str, link: float) -> Column:
    """Expected friend pairs of two boxes: both densities times the shared volume times a sphere's volume."""
    shared = F.lit(1.0)
    for c in AXES:
        low = F.greatest(F.col(f"{a}.{c}_lo"), F.col(f"{b}.{c}_lo"))
        high = F.least(F.col(f"{a}.{c}_hi"), F.col(f"{b}.{c}_hi"))
        shared = shared * F.greatest(F.lit(0.0), high - low)
    return F.col(f"{a}.n") / F.col(f"{a}.volume") * F.col(f"{b}.n") / F.col(f"{b}.volume") * shared * (4.0 / 3.0 * 3.141592653589793) * link**3


def fit(df: DataFrame, x: str, y: str, logs: bool = False) -> DataFrame:
    """One row: slope, intercept, r2 and n of a least-squares line, of logarithms if asked for (positive rows only)."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    if logs:
        df = df.where((a > 0) & (b > 0))
        a, b = F.log(a), F.log(b)
    return df.agg(F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.regr_r2(b, a).alias("r2"), F.regr_count(b, a).alias("n"))


def fit_many(df: DataFrame, xs: list[str], y: str) -> DataFrame:
    """One row: ``coefficients`` (the constant first), ``r2`` and ``n`` of least squares on several columns.

    One aggregate gives the sums of the normal equations, so the driver solves a system of ``len(xs) + 1`` unknowns;
    rows with a null are left out. Coefficients are null where the columns depend on each other.
    """
    terms = [F.lit(1.0), *(F.col(x).cast("double") for x in xs)]
    to = F.col(y).cast("double")
    k = len(terms)
    sums = [F.sum(terms[i] * terms[j]).alias(f"x{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(t * to).alias(f"y{i}") for i, t in enumerate(terms)]
    r = df.dropna(subset=[*xs, y]).agg(*sums, F.sum(to * to).alias("yy"), F.count("*").alias("n")).first()
    coefficients, r2 = None, None
    if r["n"]:
        xtx = np.array([[r[f"x{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        xty = np.array([r[f"y{i}"] for i in range(k)])
        if np.linalg.matrix_rank(xtx) == k:
            solved = np.linalg.solve(xtx, xty)
            spread = r["yy"] - xty[0] ** 2 / r["n"]
            coefficients, r2 = [float(c) for c in solved], float(1 - (r["yy"] - solved @ xty) / spread) if spread > 0 else 0.0
    return df.sparkSession.createDataFrame([(coefficients, r2, r["n"])], "coefficients array<double>, r2 double, n long")


def top_share(df: DataFrame, weight: str, share: float) -> DataFrame:
    """One row: the part of the total weight that the heaviest ``share`` of rows has; ties at the border count."""
    from astrolith.operators.partition import global_rank

    n = df.count()
    ranked = global_rank(df.select((-F.col(weight)).alias("_neg")), "_neg")
    kept = F.ceil(F.lit(n * share))
    return ranked.agg((F.sum(F.when(F.col("rank") < kept, -F.col("_neg")).otherwise(0)) / F.sum(-F.col("_neg"))).alias("share"))


def log2_histogram(df: DataFrame, value: str) -> DataFrame:
    """``(bin, n, most)`` by floor(log2(value)) of positive whole values."""
    return df.where(F.col(value) > 0).groupBy((F.length(F.bin(value)) - 1).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.max(value).alias("most"))


def concentration(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Log2 histogram of how often each pair occurs."""
    return log2_histogram(pairs.groupBy(a, b).agg(F.count("*").alias("times")), "times")


def edge_checksum(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    return edges.agg(F.count("*").alias("n"), F.sum(src).alias("sum_src"), F.sum(dst).alias("sum_dst"))


def dump_edges(edges: DataFrame, path: str) -> DataFrame:
    """Writes ``(src, dst)`` as Parquet parts and returns the checksum of what is read back."""
    edges.select("src", "dst").write.mode("overwrite").parquet(path)
    return edge_checksum(edges.sparkSession.read.parquet(path))


def metrics(values: dict[str, float], like: DataFrame) -> DataFrame:
    """``(metric, value)`` rows."""
    rows = F.array(*(F.struct(F.lit(k).alias("metric"), F.lit(float(v)).alias("value")) for k, v in values.items()))
    return like.sparkSession.range(1).select(F.explode(rows).alias("r")).select("r.*")


def with_soft(points: DataFrame, soft: float) -> DataFrame:
    """One softening for all points; a negative one keeps their own."""
    return points.withColumn("soft", F.lit(soft)) if soft >= 0 else points


def pick(points: DataFrame, keys_: DataFrame, key: str = "id") -> DataFrame:
    return points.join(keys_.select(key).distinct(), key, "left_semi")


def update(points: DataFrame, changes: DataFrame, column: str, key: str = "id") -> DataFrame:
    """Replaces ``column`` where ``changes`` has the key."""
    return points.join(changes.select(key, F.col(column).alias("_new")), key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new").select(*points.columns)


def delete(points: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return points.join(gone.select(key), key, "left_anti")


def weighted_home(points: DataFrame, piece: str = "piece", part: str = "part") -> DataFrame:
    """``(piece, home)``: the rounded mean of a piece's work partitions."""
    return points.groupBy(piece).agg(F.floor(F.avg(part) + 0.5).cast("int").alias("home"))
