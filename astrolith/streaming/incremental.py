"""Incremental components: batches of edges, or of points, are folded into a table of labels as they come.

Unions commute and may be repeated, so that batches can come in any order and a batch can be processed twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from astrolith.functions.geometry import AXES
from astrolith.operators.certified import label_edges
from astrolith.operators.components import connected_components
from astrolith.operators.spatial_join import ALL, _shifted, cells, grid_size
from astrolith.session import cut

LABELS = "id long, label long"


def fold(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, label)`` after new edges: only labels that a new edge touches are joined, then mapped in one pass."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    fresh = ends.join(labels, "id", "left_anti").select("id", F.col("id").alias("label"))
    known = labels.unionByName(fresh)
    a, b = known.select(F.col("id").alias("src"), F.col("label").alias("la")), known.select(F.col("id").alias("dst"), F.col("label").alias("lb"))
    merges = edges.select("src", "dst").join(a, "src").join(b, "dst").where("la <> lb").select("la", "lb")
    comp = connected_components(merges, "la", "lb").select(F.col("id").alias("label"), "component")
    return known.join(comp, "label", "left").select("id", F.coalesce("component", "label").alias("label"))


def fold_points(known: DataFrame, batch: DataFrame, link: float) -> DataFrame:
    """``(id, x, y, z, label)`` after new points: friends-of-friends labels (least ids) of all points so far.

    Only known points in cells next to a new point are met, by their cell. New points begin with their own id as label, and
    merges between labels come from node certificates, so that a dense neighbourhood is not taken pair by pair. A
    point that is already known is left as it is; of a batch's rows of one id the least position counts.
    """
    fresh = batch.groupBy("id").agg(F.min(F.struct(*AXES)).alias("p")).select("id", "p.*").join(known, "id", "left_anti")
    fresh = cut(fresh.select("id", *AXES, F.col("id").alias("label")))
    size, _ = grid_size(link)
    here = [c.alias(n) for c, n in zip(cells(size, 0), ("cx", "cy", "cz"))]
    around = fresh.select(*here).distinct().select(_shifted(ALL, 0).alias("to")).select("to.*").distinct()
    near = known.select("*", *here).join(around, ["cx", "cy", "cz"], "left_semi").select("id", *AXES, "label")
    merges = label_edges(near.unionByName(fresh), link)
    comp = connected_components(merges, "lo", "hi").select(F.col("id").alias("label"), "component")
    return known.unionByName(fresh).join(comp, "label", "left").select("id", *AXES, F.coalesce("component", "label").alias("label"))


class LabelStore:
    """Versions of the label table in a folder; a batch writes the version after its own number, so a retry overwrites it."""

    SCHEMA = LABELS

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.version = spark, folder.rstrip("/"), -1

    def read(self, version: int | None = None) -> DataFrame:
        v = self.version if version is None else version
        return self.spark.createDataFrame([], self.SCHEMA) if v < 0 else self.spark.read.parquet(f"{self.folder}/v{v}")

    def apply(self, edges: DataFrame, batch: int) -> None:
        fold(self.read(batch - 1), edges).write.mode("overwrite").parquet(f"{self.folder}/v{batch}")
        self.version = batch


class PointStore(LabelStore):
    """The same for points and their labels."""

    SCHEMA = "id long, x double, y double, z double, label long"

    def __init__(self, spark: SparkSession, folder: str, link: float):
        super().__init__(spark, folder)
        self.link = link

    def apply(self, points: DataFrame, batch: int) -> None:
        fold_points(self.read(batch - 1), points, self.link).write.mode("overwrite").parquet(f"{self.folder}/v{batch}")
        self.version = batch


def stream_components(edges: DataFrame, store: LabelStore, checkpoint: str):
    """Starts a streaming query that folds each micro-batch into the store: of ``(src, dst)``, or of points for a ``PointStore``."""
    return edges.writeStream.foreachBatch(lambda df, k: store.apply(df, k)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
