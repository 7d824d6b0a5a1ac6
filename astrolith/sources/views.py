"""Point tables from the given tables, each also as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from astrolith.session import table


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six numbers of each embedding as position and velocity; mass 1; family by label."""
    e = F.col("embedding")
    at = lambda i: F.element_at(e, i).cast("double")
    family = F.element_at(F.array(*map(F.lit, ("gas", "dark", "star"))), (F.col("label") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), family.alias("family"), F.lit(1.0).alias("mass"), at(1).alias("x"), at(2).alias("y"), at(3).alias("z"), at(4).alias("vx"), at(5).alias("vy"), at(6).alias("vz"), F.lit(0.01).alias("soft")
    )


EMBEDDING_SQL = """p AS (SELECT vec_id AS id, CASE label % 3 WHEN 0 THEN 'gas' WHEN 1 THEN 'dark' ELSE 'star' END AS family, 1.0::DOUBLE AS mass,
  embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS vx, embedding[5]::DOUBLE AS vy, embedding[6]::DOUBLE AS vz, 0.01::DOUBLE AS soft FROM embeddings)"""


def order_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price, date and customer of each order, each scaled to about [0, 1]."""
    n = table(spark, sf_dir, "customer").count()
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("double")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.lit("dark").alias("family"), F.lit(1.0).alias("mass"), (F.col("o_totalprice").cast("double") / F.lit(500000.0)).alias("x"), (days / F.lit(2405.0)).alias("y"),
        (F.col("o_custkey").cast("double") / F.lit(float(n))).alias("z"), *(F.lit(0.0).alias(c) for c in ("vx", "vy", "vz")), F.lit(0.01).alias("soft"),
    )


ORDER_SQL = """p AS (SELECT o_orderkey AS id, o_totalprice::DOUBLE / 500000.0::DOUBLE AS x, date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::DOUBLE / 2405.0::DOUBLE AS y,
  o_custkey::DOUBLE / (SELECT count(*) FROM customer)::DOUBLE AS z FROM orders)"""


def line_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity, discount and tax of each order line: many points coincide."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("id"), F.lit("dark").alias("family"), F.lit(1.0).alias("mass"), (F.col("l_quantity").cast("double") / 50.0).alias("x"),
        (F.col("l_discount").cast("double") * 10.0).alias("y"), (F.col("l_tax").cast("double") * 10.0).alias("z"), *(F.lit(0.0).alias(c) for c in ("vx", "vy", "vz")), F.lit(0.01).alias("soft"),
    )


LINE_SQL = """p AS (SELECT (l_orderkey * 8 + l_linenumber)::BIGINT AS id, l_quantity::DOUBLE / 50.0::DOUBLE AS x, l_discount::DOUBLE * 10.0::DOUBLE AS y, l_tax::DOUBLE * 10.0::DOUBLE AS z FROM lineitem)"""
