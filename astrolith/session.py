"""Session helpers: lineage cuts in shared storage, and reading the given tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: ``spark.checkpoint.dir`` if the cluster names one.

    Where it is unset, a local run (as in tests) gets a temporary folder; a cluster
    without the setting is an error, because executors share no local folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage.

    A lost executor costs a re-read of the files, not a recomputation, and nothing
    is kept in one executor's memory only.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as one side of an equi-join that sorts and merges, whatever Spark takes its size to be.

    Sizes are guessed from compressed files, so a table of many times the broadcast threshold can pass for a small one, and
    to broadcast it the driver would have to hold it.
    """
    return df.hint("merge")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
